"""The registered queries and the pipeline, with their own parameters, on a small folder of tables, against plain-Python versions."""
import collections
import hashlib
import os
import random
import sys

import brute
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_sampling_operators import brute_audit, brute_importance, brute_targets

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402
from tenurelens.llm import packing, toxicity  # noqa: E402
from tenurelens.llm import queries as Q  # noqa: E402


def corpus(seed=11, n=150):
    """Texts of four sources with exact and near copies, a passage of 80 words in many, capitals, marks, blanks, a null, and a bad word in some."""
    r = random.Random(seed)
    known = ["".join(r.choice("abcdefghijklmnoprstuvwé") for _ in range(r.randint(2, 9))) for _ in range(900)]
    text = lambda k: " ".join(r.choice(known) for _ in range(k))
    passage, base = text(80), text(150)
    rows = []
    for i in range(n):
        t = text(r.choice((5, 40, 120, 260)))
        if i % 6 == 0:
            t = text(30) + "\n" + passage + " " + text(20)
        if i % 9 == 1:
            w = base.split(" ")
            w[r.randrange(len(w))] = f"changed{i % 4}"
            t = " ".join(w)
        if i % 5 == 2:
            t += " vile vileness slur" * 3
        if i % 10 == 3:
            t = t.upper() + " 7% &"
        rows.append((i, t, "en", f"src{i % 4}", len(t)))
    again = [(n + k, rows[4][1], "en", "src1", 1) for k in range(4)] + [(n + 5, None, None, None, None), (n + 6, "", "en", "src2", 0), (n + 7, " \n ", "en", "src2", 3), (n + 8, text(4000), "de", "src3", 1)]
    return rows + again


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out, rows = tmp_path_factory.mktemp("tables"), corpus()
    pq.write_table(pa.table({c: pa.array([x[i] for x in rows], t) for i, (c, t) in enumerate((("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())))}), out / "documents.parquet")
    labels = [(i, int("vile" not in t), int("vile" in t.lower())) for i, t, *_ in rows[:120]]
    pq.write_table(pa.table({c: pa.array([x[i] for x in labels], t) for i, (c, t) in enumerate((("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())))}), out / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array(range(9)), "text": pa.array([t for _, t, *_ in rows[:8]] + [None])}), out / "benchmark.parquet")
    rng, vectors = np.random.default_rng(4), []
    centres = rng.standard_normal((12, 24))
    for i in range(240):
        vectors.append((i, (centres[i % 12] + rng.standard_normal(24) * (0.12 if i % 3 else 1.5)).astype(np.float32).tolist(), int(i % 2)))
    vectors += [(300, None, 0), (301, [0.0] * 24, 1), (302, vectors[5][1], 1), (303, vectors[5][1], None)]
    pq.write_table(pa.table({"vec_id": pa.array([v[0] for v in vectors]), "embedding": pa.array([v[1] for v in vectors], pa.list_(pa.float32())), "label": pa.array([v[2] for v in vectors], pa.int32())}), out / "embeddings.parquet")
    return str(out), {i: t for i, t, *_ in rows}, rows, labels, vectors


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_op1(spark, folder):
    want = brute.substring(folder[1], 50)
    got = by_id(Q.QUERIES["op1_substring_dedup"](spark, folder[0]))
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == {i: (a, b, brute.sha(c)) for i, (a, b, c) in want.items()} and any(w[1] for w in want.values())


def pieces_right(spark, pieces, texts):
    """Pieces hold each text's ids; sequences are filled without gaps and overlaps."""
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    places, got = collections.defaultdict(list), collections.defaultdict(dict)
    for r in pieces:
        got[r.doc_id][r.piece] = r
        places[r.sequence_id].append((r.offset, r.length))
    assert set(got) == set(texts)
    for i, text in texts.items():
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        assert {(k, r.start, r.length, r.ids_crc32) for k, r in got[i].items()} == {(k, 2048 * k, len(p), brute.crc(p)) for k, p in enumerate([ids[x:x + 2048] for x in range(0, len(ids), 2048)])}
    for p in places.values():
        p.sort()
        assert all(a + b == c for (a, b), (c, _) in zip(p, p[1:])) and p[0][0] == 0 and sum(p[-1]) <= 2048
    total = sum(n for p in places.values() for _, n in p)
    assert len(places) <= 1.2 * total / 2048 + 1


def test_op2(spark, folder):
    pieces_right(spark, Q.QUERIES["op2_best_fit_packing"](spark, folder[0]).collect(), folder[1])


def test_op4(spark, folder):
    want = brute.cosine(folder[4], 0.93)
    got = {r.vec_id: r for r in Q.QUERIES["op4_embedding_near_dedup"](spark, folder[0]).collect()}
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == want and sum(n > 3 for n, _ in want.values()) > 50
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_op5(spark, folder):
    groups = collections.defaultdict(list)
    for i, t in folder[1].items():
        groups[t or ""].append(i)
    got = by_id(Q.QUERIES["op5_exact_dedup"](spark, folder[0]))
    assert {i: (r.keep_id, r.group_size, r.kept, r.text_sha256) for i, r in got.items()} == {i: (max(g), len(g), i == max(g), brute.sha(t)) for t, g in groups.items() for i in g}


def plain_chain(spark, texts, labels):
    """Probabilities of both categories of every text, by dense matrices and the same steps."""
    def features(t):
        w = [x.encode() for x in brute.words(t, lower=True)]
        return {(0, x) for x in w} | {(k, x[:k]) for x in w for k in toxicity.PREFIXES if len(x) >= k}

    ids = sorted(i for i, *_ in labels)
    held, count = {i: features(t) for i, t in texts.items()}, collections.Counter(f for i in ids for f in features(texts[i]))
    vocabulary = sorted(f for f, n in count.items() if n >= toxicity.LEAST_DOCS)
    assert len(vocabulary) <= toxicity.FEATURES
    matrix = lambda some: np.array([[f in held[i] for f in vocabulary] for i in some], dtype=float)
    y = {"low_quality": {i: int(q == 0) for i, q, _ in labels}, "toxic": {i: x for i, _, x in labels}}
    logit = lambda p: np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4)))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(x, t):
        n, w = len(t), np.zeros(x.shape[1] + 1)
        rate = np.clip(t.mean(), 1e-6, 1 - 1e-6)
        w[-1] = np.log(rate / (1 - rate))
        m, v = np.zeros_like(w), np.zeros_like(w)
        for s in range(1, toxicity.STEPS + 1):
            g = (sigmoid(x @ w[:-1] + w[-1]) - t) / n
            grad = np.append(x.T @ g + toxicity.PENALTY / n * w[:-1], g.sum())
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
            w -= 0.1 * (1 - s / (toxicity.STEPS + 1)) * (m / (1 - 0.9 ** s)) / (np.sqrt(v / (1 - 0.99 ** s)) + 1e-9)
        return w

    train, every, order = matrix(ids), matrix(sorted(texts)), sorted(texts)
    out = {}
    for c in ("low_quality", "toxic"):
        t = np.array([y[c][i] for i in ids], dtype=float)
        fold = {r.doc_id: r.f for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(c)), F.lit(toxicity.FOLDS)).alias("f")).collect()}
        f, oof = np.array([fold[i] for i in ids]), np.zeros(len(ids))
        for k in range(toxicity.FOLDS):
            w = fit(train[f != k], t[f != k])
            oof[f == k] = sigmoid(train[f == k] @ w[:-1] + w[-1])
        w = fit(train, t)
        out[c] = sigmoid(every @ w[:-1] + w[-1])
        train, every = np.column_stack((train, logit(oof))), np.column_stack((every, logit(out[c])))
    return {i: (out["low_quality"][k], out["toxic"][k]) for k, i in enumerate(order)}


@pytest.fixture(scope="module")
def chain(spark, folder):
    return plain_chain(spark, folder[1], folder[3])


def test_op6(spark, folder, chain):
    got = by_id(Q.QUERIES["op6_toxicity"](spark, folder[0]))
    assert set(got) == set(chain)
    for i, (a, b) in chain.items():
        assert (got[i].p_low_quality, got[i].p_toxic) == pytest.approx((a, b), abs=1e-6), i
    assert {i for i, r in got.items() if r.toxic} == {i for i, t in folder[1].items() if "vile" in (t or "").lower()}


def test_op8(spark, folder):
    got = by_id(Q.QUERIES["op8_ngram_jaccard_join"](spark, folder[0]))
    want = brute.jaccard(folder[1], 3, 90)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want and sum(i != c for i, (_, c) in want.items()) > 5


def test_op9(spark, folder):
    import base64

    import public_tokenizers
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in by_id(Q.QUERIES["op9_byte_bpe"](spark, folder[0])).items():
        ids = codec.encode_ordinary(folder[1][i] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(folder[1][i] or ""))


def test_op10(spark, folder):
    want = brute.suffix(folder[1], 200)
    got = by_id(Q.QUERIES["op10_suffix_array_dedup"](spark, folder[0]))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == {i: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for i, w in want.items()}
    assert any(w[1] for w in want.values())


def test_op11_to_op13(spark, folder):
    path, texts, rows, labels, _ = folder
    given = [(i, t, s) for i, t, _, s, _ in rows]
    target = [t for t in pq.read_table(f"{path}/benchmark.parquet").column("text").to_pylist()]
    got = Q.QUERIES["op11_importance_resampling"](spark, path).collect()
    assert sorted((r.doc_id, r.n_features, r.weight, r.score, r["rank"] or 0) for r in got) == sorted((*x[:4], x[4] or 0) for x in brute_importance(given, target, 1, 1, 10_000, 10, 20))
    sizes = collections.Counter()
    for _, t, s in given:
        sizes[s] += len(brute.words(t))
    want, taken = brute_targets(sizes, (1, 2, 3)), collections.Counter()
    for r in Q.QUERIES["op12_source_mixing"](spark, path).collect():
        assert r.target == pytest.approx(want[r.source]) and r.taken <= 3 * r.size == 3 * len(brute.words(texts[r.doc_id]))
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= 1 for s, t in want.items())
    audit = Q.QUERIES["op13_filter_audit"](spark, path).collect()
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in audit} == brute_audit(given, labels)


def test_pipeline(spark, folder, chain):
    """Every stage of ``run`` on what the one before kept."""
    path, texts, rows, _, _ = folder
    docs, left = spark.read.parquet(f"{path}/documents.parquet"), dict(texts)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "ngram_jaccard_join", "suffix_array_dedup", "best_fit_packing"]
    left = {i: t for i, t in left.items() if chain[i][1] < 0.5}
    keep = {}
    for i in sorted(left):
        keep[left[i] or ""] = i
    exact = {i: left[i] for i in keep.values()}
    near = {i: exact[i] for i, (_, c) in brute.jaccard(exact, 5, 80).items() if i == c}
    cut = {i: w[3].decode("utf-8", "ignore") for i, w in brute.suffix(near, 200).items()}
    assert len(texts) > len(left) > len(exact) > len(near) and any((near[i] or "") != t for i, t in cut.items())
    for name, want in zip(list(stages)[:4], (left, exact, near, cut)):
        docs = spark.createDataFrame([tuple(r) for r in stages[name](spark, docs, path).collect()], docs.schema)
        got = {r.doc_id: r for r in docs.collect()}
        assert {i: r.text or "" for i, r in got.items()} == {i: t or "" for i, t in want.items()}, name
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    pieces_right(spark, corpus_pipeline.run(spark, path).collect(), cut)
