"""Importance resampling, source mixing and the filter audit against plain-Python versions."""
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import brute
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tenurelens.llm import filter_audit, importance, mixing

SCHEMA = "doc_id long, text string, source string"
#: Names that the operators use for columns of their own.
CLASHES = ("key", "range", "number", "size", "target", "rest", "bits", "part", "filter", "before", "mark", "n", "digest", "score", "weight", "n_words", "above", "tie", "fails", "_b")


def corpus(seed=5, n=90):
    """Texts of several sources, one of them large, with copies, capitals, marks, blanks, nulls and equal ids."""
    r = random.Random(seed)
    known = ["".join(r.choice("abcdeéü1") for _ in range(r.randint(1, 7))) for _ in range(60)]
    rows = []
    for i in range(n):
        words = [r.choice(known[:5] if i % 7 == 0 else known) for _ in range(r.choice((3, 30, 60, 200)))]
        text = " ".join(w.upper() if r.random() < (0.5 if i % 6 == 0 else 0.02) else w for w in words) + (" 5% & more" if i % 5 == 0 else "")
        rows.append((i, text, "big" if i % 3 else f"src{i % 4}"))
    rows += [(n, rows[3][1], "big"), (n + 1, rows[3][1], "src1"), (n + 2, "", None), (n + 3, None, None), (n + 4, None, ""), (n + 5, "x " * 5000, "src2"), (n + 6, "\t \n", "blank"),
             (7, "another text under a known id", "src2"), (8, rows[8][1], rows[8][2]), (None, "no id at all", "src1"), (None, rows[3][1], "big"), (n + 7, "naïve ÉTÉ Zürich 中文 word-word", "ü")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in CLASHES:
        df = df.withColumn(c, F.lit("x"))
    return df


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_importance(rows, target, low, high, buckets, percent, least):
    grams = lambda t: [" ".join(w[i:i + n]) for w in [words_of(t)] for n in range(low, high + 1) for i in range(len(w) - n + 1)]
    at = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (collections.Counter(at(g) for x in texts for g in grams(x)) for texts in ([x for _, x, _ in rows], target))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (S + buckets) / ((s[b] + 1.0) * (T + buckets)))) for b in range(buckets)]
    out, able = [], []
    for i, text, _ in rows:
        g = grams(text)
        h = int(hashlib.sha256(f"2024:{brute.sha(text or '') if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[at(x)] for x in g)
        out.append([i, len(g), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(words_of(text)) >= least:
            able.append(len(out) - 1)
    able.sort(key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0))
    for rank, k in enumerate(able[:len(able) * percent // 100]):
        out[k][4] = rank + 1
    return out


@pytest.mark.parametrize("low,high,percent", [(1, 1, 10), (1, 3, 55), (2, 2, 100)])
def test_importance(spark, table, rows, low, high, percent):
    target = [" ".join(t.split()[:20]) for _, t, _ in rows[:9]] + [None, "", "zz"]
    bench = spark.createDataFrame(list(enumerate(target)), "item_id long, text string").withColumn("bucket", F.lit(1))
    got = importance.importance_resampling(table, bench, low, high, 500, percent).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got), key=key) == sorted(map(tuple, brute_importance(rows, target, low, high, 500, percent, 20)), key=key)
    assert percent == 10 or sum(r["rank"] is not None for r in got) > 20


def test_interning_tells_equal_keys_apart(monkeypatch):
    """With keys that all collide, bytes alone decide."""
    words = [w.encode() for w in ["a", "ab", "a", "abcdefgh", "abcdefghi", "abcdefghj", "abcdefghi", "é" * 20, "é" * 19 + "è", "é" * 20] * 7]
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    for collide in (False, True):
        if collide:
            monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda b: 9)
        slot, bucket, count = importance.intern(data, starts, ends, 1000)
        assert len(set(slot.tolist())) == len(set(words)) == len(set(zip(slot.tolist(), words)))
        assert all(bucket[s] == zlib.crc32(w) % 1000 and count[s] == words.count(w) for s, w in zip(slot.tolist(), words))


def test_grams_in_several_tables(rows, monkeypatch):
    """A table takes so many n-grams and no more; together they hold all."""
    import pyarrow as pa
    texts = pa.array([t for _, t, _ in rows])

    def counts():
        out = np.zeros(100, dtype=np.int64)
        for _, _, tables in importance.gram_tables(texts, 1, 2, 100):
            for _, bucket, count, _ in tables:
                np.add.at(out, bucket, count)
        return out

    whole = counts()
    monkeypatch.setattr(importance, "AT_ONCE", 7)
    assert (whole == counts()).all() and whole.sum() == sum(max(0, 2 * len(words_of(t)) - 1) for _, t, _ in rows)


def test_importance_reruns_and_empties(table, rows, spark):
    bench = spark.createDataFrame([(1, rows[0][1])], "item_id long, text string")
    a = importance.importance_resampling(table, bench, 1, 2, 100).collect()
    assert sorted(map(str, a)) == sorted(map(str, importance.importance_resampling(table.repartition(11), bench, 1, 2, 100).collect()))
    assert importance.importance_resampling(spark.createDataFrame([], SCHEMA), bench).count() == 0
    none = importance.importance_resampling(table, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(none) == len(rows) and sum(r["rank"] is not None for r in none) > 0


def brute_targets(sizes, weights, percent=100.0, most=3):
    """Targets by the words of the contract: reshare until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()) * percent / 100, {}
    while True:
        free = [s for s in order if s not in fixed]
        left, share = total - sum(fixed.values()), sum(weight[s] for s in free)
        now = {s: left * weight[s] / share for s in free}
        over = [s for s in free if now[s] > most * sizes[s]]
        if not over:
            return {**fixed, **now}
        fixed |= {s: float(most * sizes[s]) for s in over}


@pytest.mark.parametrize("weights,percent", [((1, 2, 3), 100.0), ((50, 1, 1), 100.0), ((1, 9), 250.0), ((5,), 1.0)])
def test_mixing(table, rows, weights, percent):
    got = mixing.mix_sources(table, weights, percent).collect()
    count = lambda t: len(brute.words(t))
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += count(t)
    want = brute_targets(sizes, weights, percent)
    assert len(got) == len(rows)
    assert collections.Counter((r.doc_id, r.size, r.source, r.source_size) for r in got) == collections.Counter((i, count(t), s, sizes[s]) for i, t, s in rows)
    taken = collections.Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == math.floor(t + 1e-9) for s, t in want.items())
    for s in want:  # whole rounds for all, and one document at most is cut
        times = [r.taken / r.size for r in got if r.source == s and r.size]
        assert sum(x != int(x) for x in times) <= 1 and max(times, default=0) - min(times, default=0) <= 1
    again = mixing.mix_sources(table.repartition(7), weights, percent).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))


def test_mixing_order_and_empties(spark, table, rows):
    one = mixing.mix_sources(table, (1, 2, 3), seed=1).collect()
    assert collections.Counter(map(tuple, one)) != collections.Counter(map(tuple, mixing.mix_sources(table, (1, 2, 3), seed=2).collect()))
    assert mixing.mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = mixing.mix_sources(spark.createDataFrame([(1, None, "a"), (2, " ", "b")], SCHEMA)).collect()
    assert [(r.size, r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 2


def brute_audit(rows, labels):
    def fails(i, t):
        t = t or ""
        w = brute.words(t)
        return {n for n, bad in (("A", len(w) < 50), ("B", 100 * len(set(w)) < 65 * len(w)), ("C", 100 * len(re.findall("[A-Z]", t)) > 5 * len(t)), ("D", bool(re.search("[#$%&*|]", t))),
                                 ("E", i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows))) if bad}

    good, bad = ({i for i, q, x in labels if i is not None and (q, x)[k] == 1} for k in (0, 1))
    docs = [(s or "", i, fails(i, t)) for i, t, s in rows]
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for p in itertools.permutations("ABCDE"):
            for k, f in enumerate(p):
                removed = [d for d in own if f in d[2] and not d[2] & set(p[:k])]
                out[part, "".join(p), k + 1] = [sum(not d[2] & set(p[:k + 1]) for d in own), len(removed), sum(f in d[2] for d in own) - len(removed), sum(d[2] == {f} for d in own),
                                                sum(d[1] in good for d in removed), sum(d[1] in bad for d in removed)]
    value = collections.Counter()
    for (part, p, k), v in out.items():
        value[part, p[k - 1]] += v[1]
    return {key: (*v, value[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def test_audit(spark, table, rows):
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 80, 2)] + [(i, 0, 0) for i in (4, 6)] + [(None, 1, 1), (90, 1, 1), (91, None, 1), (7, 1, None)]
    labels = [(i, q, None if x is None else int(x)) for i, q, x in labels]
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mark", F.lit("m"))
    got = filter_audit.filter_audit(table, given).collect()
    want = brute_audit(rows, labels)
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got} == want
    assert len(got) == len(want) and sum(v[4] for v in want.values()) and sum(v[5] for v in want.values()) and sum(v[3] for v in want.values())


def test_audit_other_filters_and_empties(spark, table, rows):
    given = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(spark.createDataFrame([], SCHEMA), given).count() == 0
    got = filter_audit.filter_audit(table, given, {"L": lambda t: F.length(t) > 100}, repeated="R").where("filter_order = 'RL'").collect()
    parts = {s or "" for _, _, s in rows}
    assert {(r.part, r.step) for r in got} == {(p, k) for p in parts for k in (1, 2)} and not any(r.good_lost or r.toxic_lost for r in got)
    clean = filter_audit.filter_audit(table, given, {"L": lambda t: F.lit(False)}, repeated="R").where("filter_order = 'LR' and step = 1").collect()
    assert all(r.removed == 0 for r in clean) and sum(r.kept for r in clean) == len(rows)


def test_stored_relations(spark, table, rows):
    """Each filter's failing ids are a folder of their own."""
    found, sizes = filter_audit.failing_ids(table, filter_audit.text_filters(), "E", "doc_id", "text", "source")
    assert sum(r.n for r in sizes.collect()) == len(rows)
    for f in "ABCDE":
        plan = found.where(F.col("filter") == f)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(filter" in plan
    assert {r["filter"] for r in found.select("filter").distinct().collect()} == set("ABCDE")
