"""Equal ids, repeated rows and clashing names: defined results where rows are not one document each."""
import collections
import itertools
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tenurelens.llm import embedding_dedup, exact_dedup, jaccard_join, toxicity

DOCS = "doc_id long, text string"


def components_of_rows(rows, linked):
    """Smallest id reachable, where rows with equal ids are one node."""
    pairs = [(a[0], b[0]) for a, b in itertools.combinations([r for r in rows if r[0] is not None], 2) if linked(a, b)]
    return brute.component_ids({r[0] for r in rows if r[0] is not None}, pairs)


def test_jaccard_equal_ids(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefgh") + r.choice("xyz") for _ in range(40)) for _ in range(6)]
    rows = [(3, texts[0]), (5, texts[0]), (5, texts[1]), (7, texts[1]), (9, texts[2]), (10, texts[2]), (10, texts[3]), (11, texts[3]), (11, texts[4]), (4, texts[4]), (20, texts[5]), (20, texts[5]),
            (21, ""), (21, texts[5]), (30, None), (30, None), (None, texts[0])]
    sets = {t: {tuple(t.split()[k:k + 3]) for k in range(38)} for t in texts}
    linked = lambda a, b: a[1] and b[1] and 100 * len(sets[a[1]] & sets[b[1]]) >= 90 * len(sets[a[1]] | sets[b[1]])
    want = components_of_rows(rows, linked)
    assert want[7] == 3 and want[11] == 4 and want[21] == 20
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    assert collections.Counter((x.doc_id, x.component_id) for x in got) == collections.Counter((i, want.get(i)) for i, _ in rows)


def test_vectors_equal_ids(spark):
    """An id may hold several vectors, of several labels and lengths; links stay within a label."""
    rng = np.random.default_rng(1)
    base = {k: rng.standard_normal(16) for k in range(6)}
    near = lambda k: (base[k] + 0.05 * rng.standard_normal(16)).tolist()
    rows = [(3, near(0), "a"), (5, near(0), "a"), (5, near(1), "a"), (7, near(1), "a"), (7, near(2), "b"), (12, near(2), "b"), (12, near(2), "a"), (5, near(1), "a"),
            (20, near(3), "a"), (21, near(3), "b"), (22, near(4), "c"), (22, near(4)[:8], "c"), (23, near(4), "c"), (2, near(5), "d"), (24, near(5), "d"), (24, None, "a"), (25, None, None), (None, near(0), "a"), (None, None, None)]

    def linked(a, b):
        if a[1] is None or b[1] is None or a[2] != b[2] or a[2] is None or len(a[1]) != len(b[1]):
            return False
        x, y = np.array(a[1]), np.array(b[1])
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93

    want = components_of_rows(rows, linked)
    assert want[7] == 3 and want[12] == 3 and want[24] == 2 and want[21] == 21
    n = [sum(linked(a, b) for j, b in enumerate(rows) if j != i and b[0] is not None) if a[0] is not None else 0 for i, a in enumerate(rows)]
    got = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(3)).collect()
    assert collections.Counter((x.vec_id, x.n_links, x.component_id) for x in got) == collections.Counter((r[0], k, want.get(r[0])) for r, k in zip(rows, n))
    assert all(x.kept == (x.vec_id == x.component_id) for x in got)


def test_one_row_per_text(spark):
    rows = [(1, "t", 1), (1, "t", 1), (1, "t", 2), (2, "u", 1), (3, "u", 1), (None, "v", 1), (None, "v", 1), (4, None, 1), (5, "", 1), (6, "w", None), (None, "u", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int").withColumn("n", F.lit("x")).withColumn("text_sha256", F.lit("y"))
    out = exact_dedup.without_copies(df)
    assert out.columns == df.columns
    got = collections.Counter((r.doc_id, r.text) for r in out.collect())
    assert got == {(1, "t"): 1, (3, "u"): 1, (None, "v"): 1, (5, ""): 1, (6, "w"): 1}
    assert sorted(map(str, out.collect())) == sorted(map(str, exact_dedup.without_copies(df.repartition(5)).collect()))


@pytest.mark.parametrize("name", ["_text", "fold", "row"])
def test_toxic_stage_keeps_columns(spark, name):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["fine", "good", "plain", "text"]) for _ in range(20)) + (" vile slur" if i % 3 == 0 else "")) for i in range(120)] + [(None, None), (500, "")]
    df = spark.createDataFrame(rows, DOCS).withColumn(name, F.lit("mine"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(0, 120)], "doc_id long, quality int, toxic int")
    got = toxicity.without_toxic(df, toxicity.learned(df, labels)).collect()
    assert {x[name] for x in got} == {"mine"} and {x.doc_id for x in got} == {i for i in range(120) if i % 3} | {None, 500}
