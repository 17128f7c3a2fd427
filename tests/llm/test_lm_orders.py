"""The language model at order 3 with every gram kept, against a plain-Python version."""
import collections
import math

import brute
import numpy as np
import pytest
from test_llm_operators import EMPTY, corpus, rows

from tenurelens.llm import lm
from tenurelens.llm.tables import documents


def factors(by, k=5):
    a = (k + 1) * by[k + 1] / by[1] if by[1] else 1.0
    out = {}
    for c in range(1, k + 1):
        d = ((c + 1) * by[c + 1] / (c * by[c]) - a) / (1 - a) if by[c] and a != 1 else -a / (1 - a) if a != 1 else 0
        out[c] = d if 0 < d < 1 else (c - 0.5) / c
    return out


def katz(docs, order):
    """{id: score}, P(word | history), the words, the histories of the longest order and the counts by order, with every gram kept."""
    tokens = {i: [(w,) for w in brute.words(t, lower=True)] + ["end"] for i, t in docs.items()}
    train = [i for i in docs if not lm.held_out(i)]
    gram = lambda t, i, n: tuple((["start"] * (n - 1) + t[:i + 1])[-n:])
    counts = {n: collections.Counter(gram(tokens[i], j, n) for i in train for j in range(len(tokens[i]))) for n in range(1, order + 1)}
    total = sum(counts[1].values())
    d = {n: factors(collections.Counter(counts[n].values())) for n in counts}
    of = {n: collections.Counter() for n in counts}
    for n in counts:
        for g, c in counts[n].items():
            of[n][g[:-1]] += c
    left = sum(c * (1 - d[1].get(c, 1)) for c in counts[1].values())
    after = {n: collections.defaultdict(list) for n in counts}
    for n in counts:
        for g in counts[n]:
            after[n][g[:-1]].append(g[-1])
    memo = {}

    def parts(h):
        if h not in memo:
            n = len(h) + 1
            own = {w: d[n].get(counts[n][(*h, w)], 1) * counts[n][(*h, w)] / of[n][h] for w in after[n][h]}
            mass, lower = sum(own.values()), sum(p(h[1:], w) for w in own)
            scale = of[n][h] / (of[n][h] + 1) / mass if mass > 1 - 1e-9 else 1
            memo[h] = {w: s * scale for w, s in own.items()}, (1 - mass * scale) / max(1 - lower, 1e-15)
        return memo[h]

    def p(h, w):
        if not h:
            c = counts[1][(w,)]
            if left <= 0:
                return (c or 0.5) / (total + 0.5)
            return d[1].get(c, 1) * c / total if c else left / total
        if h not in after[len(h) + 1]:
            return p(h[1:], w)
        own, weight = parts(h)
        return own[w] if w in own else weight * p(h[1:], w)

    scores = {i: sum(math.log10(p(gram(t, j, order)[:-1], t[j])) for j in range(len(t))) for i, t in tokens.items()}
    return scores, p, [g[0] for g in counts[1]], list(after[order]), counts


@pytest.mark.parametrize("order,share,block_bytes", [(2, 1 / 1024, 4000), (3, 1 / 1024, 4000), (3, 0.02, 4000), (3, 2.0, 1 << 20)])
def test_all_grams_and_longer_histories(spark, monkeypatch, order, share, block_bytes):
    monkeypatch.setattr(lm, "HOT_SHARE", share)
    docs = corpus(4, 50, 40)
    df = spark.createDataFrame(list(docs.items()), EMPTY).repartition(3)
    model = lm.fit(documents(df), block_bytes, order, 1)
    want, p, vocabulary, histories, counts = katz(docs, order)
    got = rows(lm.evaluate(model))
    assert {i: got[i].score for i in want} == pytest.approx(want, rel=1e-9)
    assert 1 in counts[order].values()
    for h in histories[:40]:
        assert sum(p(h, w) for w in vocabulary) + p(h, "?") == pytest.approx(1, abs=1e-9)
    for n in range(2, order + 1):
        assert sorted(r["count"] for r in lm.stored_grams(model, n).collect()) == sorted(counts[n].values())


def test_query_keeps_pairs_seen_once(spark, tmp_path):
    from tenurelens.llm import queries as Q
    docs = corpus(4, 50, 40)
    spark.createDataFrame(list(docs.items()), EMPTY).write.parquet(str(tmp_path / "documents.parquet"))
    got = rows(Q.QUERIES["op3_lm_scoring"](spark, str(tmp_path)))
    assert {i: r.score for i, r in got.items()} == pytest.approx(katz(docs, 3)[0], rel=1e-9)


def test_grams_take_little_room(spark):
    import random
    from pathlib import Path

    r = random.Random(5)
    words = ["".join(r.choices("abcdefghij", k=r.randint(3, 8))) for _ in range(9000)]
    docs = {i: " ".join(words[min(int(r.paretovariate(0.6)), 9000) - 1] for _ in range(400)) for i in range(200)}
    model = lm.fit(documents(spark.createDataFrame(list(docs.items()), EMPTY)), 1 << 18, 3, 1)
    files = [f for p in model.paths for f in Path(p.removeprefix("file:")).rglob("*.parquet")]
    assert files and sum(f.stat().st_size for f in files) < 3 * sum(map(len, docs.values()))


def test_history_seen_once_is_settled_in_its_block(spark):
    train = [i for i in range(40) if not lm.held_out(i)]
    out = [i for i in range(40) if lm.held_out(i)]
    docs = {i: f"a{i} b{i} c{i} d{i}" for i in train} | {out[0]: f"a{train[0]} b{train[0]} x d{train[0]}"}
    model = lm.fit(documents(spark.createDataFrame(list(docs.items()), EMPTY)), 400, 3, 1)
    want, _, _, _, counts = katz(docs, 3)
    got = rows(lm.evaluate(model))
    assert {i: got[i].score for i in want} == pytest.approx(want, rel=1e-9)
    for n in (2, 3):
        grams = lm.stored_grams(model, n).collect()
        assert len({(r["history"], r["word"]) for r in grams}) == len(grams) == len(counts[n])
    told = [len(lm.unpacked(r["data"])[5]) for r in lm.stored(spark, model.paths[2], "tables").collect()]
    assert sum(told) < len(counts[3]) / 2
