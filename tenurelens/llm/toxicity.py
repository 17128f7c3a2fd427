"""Toxicity by a classifier chain: each category's linear model sees the earlier categories' probabilities."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurelens.llm import text as T
from tenurelens.llm.tables import documents, give_back, ship, stored

U = np.uint64
#: Labelled documents used at most; features kept; documents a feature needs; folds; steps and penalty of a fit.
MOST_LABELLED, FEATURES, LEAST_DOCS, FOLDS, STEPS, PENALTY = 20_000, 4096, 5, 4, 250, 1.0
#: First bytes of a word that count as features beside the whole word.
PREFIXES = (4, 5, 6)


@dataclass
class Chain:
    """A fitted chain: ascending feature hashes, and for each category its name, weights and bias."""

    categories: list
    features: np.ndarray
    weights: list
    bias: list

    def probabilities(self, row: np.ndarray, col: np.ndarray, n: int) -> list[np.ndarray]:
        """Each category's probabilities for ``n`` documents that hold the features (row, col)."""
        out = []
        for w, b in zip(self.weights, self.bias):
            z = np.bincount(row, weights=w[col], minlength=n)[:n] + b
            for k, earlier in enumerate(out):
                z = z + w[len(self.features) + k] * logit(earlier)
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return out


def logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def word_features(table) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased) and word beginnings of each text, with its row; repeats included."""
    data, offsets = T.utf8(table.column("text"))
    rows, hashes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=U)]
    for i, j in T.slices(offsets):
        own = T.lowered(data[offsets[i]:offsets[j]])
        s, e, first = T.words(own, offsets[i:j + 1] - offsets[i])
        row = np.repeat(np.arange(i, j), np.diff(first))
        sums = T.prefix_sums(T._BYTE[own], T._BASE)
        for k in (0, *PREFIXES):
            take = slice(None) if k == 0 else e - s >= k
            a, b = s[take], e[take] if k == 0 else s[take] + k
            with np.errstate(over="ignore"):
                hashes.append(T.mix(T.range_hashes(sums, a, b, T._BASE) + U(k) * U(0x2545F4914F6CDD1D)))
            rows.append(row[take])
    return np.concatenate(rows), np.concatenate(hashes)


def small(batches, rows: int = 512):
    """The same rows in batches whose word hashes stay small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    give_back()


def held(table, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, place in ``features``) of the texts."""
    row, h = word_features(table)
    if not len(features):
        return row[:0], row[:0]
    at = np.minimum(np.searchsorted(features, h), len(features) - 1)
    hit = features[at] == h
    pairs = np.unique(row[hit] * len(features) + at[hit])
    return pairs // len(features), pairs % len(features)


def fit_logistic(row, col, y, n_features: int, extra: np.ndarray, steps: int, penalty: float) -> np.ndarray:
    """Weights of the features, the extra columns and the bias, by Adam on all rows."""
    n, k = len(y), extra.shape[1]
    if n == 0:
        return np.append(np.zeros(n_features + k), -30.0)
    w, rate = np.zeros(n_features + k + 1), np.clip(y.mean(), 1e-6, 1 - 1e-6)
    w[-1] = np.log(rate / (1 - rate))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=w[col], minlength=n) + extra @ w[n_features:-1] + w[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        grad = np.concatenate((np.bincount(col, weights=g[row], minlength=n_features), extra.T @ g, [g.sum()]))
        grad[:-1] += penalty / n * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.1 * (1 - t / (steps + 1)) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
    return w


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], most_labelled: int = MOST_LABELLED, features: int = FEATURES, folds: int = FOLDS,
              steps: int = STEPS, penalty: float = PENALTY, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Learns the chain from labelled documents; ``categories`` are 0/1 columns of ``labels``, in chain order.

    At most ``most_labelled`` documents are learned from, chosen by a hash of the id.  Feature
    statistics are aggregated over them on the cluster; ``features`` of them are kept.  A
    category is fitted on all rows, and once without each fold; the probabilities of the
    documents left out are what later categories see in training.  Labels with a null id or category
    are left out, of equal ids the largest labels count.  Without labelled documents every
    probability is 0.
    """
    d = documents(docs, id_col, text_col)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c).cast("double").alias(c) for c in categories]).dropna()
    known = known.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    sample = stored(d.join(known, "doc_id"), "labelled")
    names = [f"n_{c}" for c in categories]

    def tally(batches):
        for b in small(batches):
            row, h = word_features(b)
            order = np.lexsort((row, h))
            row, h = row[order], h[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            row, h = row[new], h[new]
            uniq, at = np.unique(h, return_inverse=True)
            y = [b.column(c).to_numpy() for c in categories]
            yield pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), pa.array(np.bincount(at, minlength=len(uniq)).astype(np.int64)),
                                              *[pa.array(np.bincount(at, weights=v[row], minlength=len(uniq)).astype(np.float64)) for v in y]], ["feature", "n", *names])

    totals = sample.agg(F.count(F.lit(1)), *[F.sum(c) for c in categories]).first()
    rates = [min(max((t or 0) / max(1, totals[0]), 1e-6), 1 - 1e-6) for t in totals[1:]]
    counts = sample.mapInArrow(tally, "feature long, n long, " + ", ".join(f"{x} double" for x in names)).groupBy("feature").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names])
    z = [F.abs(F.col(x) - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p)) for x, p in zip(names, rates)]
    strength = F.greatest(*z) if len(z) > 1 else z[0]
    top = counts.where(F.col("n") >= LEAST_DOCS).orderBy(F.desc(strength), "feature").limit(features).select("feature").collect()
    chosen = np.sort(np.array([r.feature for r in top], dtype=np.int64).view(U))

    def vectors(batches):
        for b in small(batches):
            row, col = held(b, chosen)
            ends = np.searchsorted(row, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(col, pa.int32())), *[b.column(c) for c in categories]], ["doc_id", "cols", *categories])

    rows = sample.mapInArrow(vectors, "doc_id long, cols array<int>, " + ", ".join(f"{c} double" for c in categories))
    weights, bias, earlier = [], [], []
    for c in categories:
        rows, w = fit_link(rows, c, earlier, len(chosen), folds, steps, penalty)
        earlier = [*earlier, f"oof_{c}"]
        weights.append(w[:-1])
        bias.append(float(w[-1]))
    return Chain(list(categories), chosen, weights, bias)


def fit_link(rows: DataFrame, category: str, earlier: list[str], n_features: int, folds: int, steps: int, penalty: float):
    """Fits one category; returns the rows with its out-of-fold probabilities, and its weights. One task per fold and one for all rows."""
    every = rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(category)), F.lit(folds)).cast("int"))
    copies = every.withColumn("fit", F.explode(F.array(*[F.lit(i) for i in range(folds + 1)])))

    schema = pa.schema([("doc_id", pa.int64()), ("p", pa.float64()), ("w", pa.list_(pa.float64()))])

    def fit(key, table):
        i = int(key[0].as_py())
        table = table.combine_chunks().sort_by("doc_id")
        cols = table.column("cols").combine_chunks()
        n = table.num_rows
        row, col = np.repeat(np.arange(n), pc.list_value_length(cols).to_numpy(zero_copy_only=False)), cols.flatten().to_numpy().astype(np.int64)
        extra = np.column_stack([logit(table.column(e).to_numpy()) for e in earlier]) if earlier else np.zeros((n, 0))
        y, out = table.column(category).to_numpy(), table.column("fold").to_numpy() == i
        take = np.cumsum(~out) - 1
        inside = ~out[row]
        w = fit_logistic(take[row[inside]], col[inside], y[~out], n_features, extra[~out], steps, penalty)
        if i == folds:
            give_back()
            return pa.table([pa.array([None], pa.int64()), pa.array([None], pa.float64()), pa.array([w.tolist()], schema.field("w").type)], schema=schema)
        z = np.bincount(row, weights=w[col], minlength=n) + extra @ w[n_features:-1] + w[-1]
        return pa.table([table.column("doc_id").filter(pa.array(out)), pa.array(1 / (1 + np.exp(-np.clip(z[out], -30, 30)))), pa.nulls(int(out.sum()), schema.field("w").type)], schema=schema)

    got = stored(copies.groupBy("fit").applyInArrow(fit, "doc_id long, p double, w array<double>"), "chain")
    w = got.where("w is not null").first()
    oof = got.where("doc_id is not null").groupBy("doc_id").agg(F.first("p").alias(f"oof_{category}"))
    return rows.join(oof, "doc_id"), np.array(w.w) if w else np.append(np.zeros(n_features + len(earlier)), -30.0)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``p_<category>`` of every document's whole text.

    Null or empty text has no features: the categories' base rates.  Null ids give rows too.
    """
    names = [f"p_{c}" for c in chain.categories]

    def run(batches):
        for b in small(batches):
            row, col = held(b, chain.features)
            p = chain.probabilities(row, col, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(x, pa.float64()) for x in p]], ["doc_id", *names])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names))


#: Categories of the registered query, in chain order, as conditions on the labels.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def learned(docs: DataFrame, labels: DataFrame, **how) -> Chain:
    """The chain over CATEGORIES."""
    given = labels.select("doc_id", *[F.expr(e).cast("int").alias(c) for c, e in CATEGORIES.items()])
    return fit_chain(docs, given, list(CATEGORIES), **how)


def without_toxic(docs: DataFrame, chain: Chain, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` whose last category's probability is below ``threshold``; one pass, nothing is shuffled.

    Null and empty texts have the base rate; repeated rows, equal and null ids are each judged by their text. No row of an
    empty table. All columns pass through as they are, whatever their names.
    """

    # only the texts go to Python, and one mark a row comes back
    @F.arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        found = [np.zeros(0, dtype=bool)]
        for b in small([pa.RecordBatch.from_arrays([text], ["text"])]):
            row, col = held(b, chain.features)
            found.append(chain.probabilities(row, col, b.num_rows)[-1] < threshold)
        return pa.array(np.concatenate(found))

    ship(docs.sparkSession)
    return docs.where(clean(F.col(text_col).cast("string")))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """``doc_id``, the probability of each category, and ``toxic``: whether the last one reaches ``threshold``."""
    scored = score(docs, learned(docs, labels, **how))
    return scored.withColumn("toxic", F.col("p_toxic") >= threshold)
