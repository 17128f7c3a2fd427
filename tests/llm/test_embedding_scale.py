"""Near-duplicate vectors: neighbours across partitions, and recall under one large label."""
import numpy as np
import pytest

from tenurelens.llm import embedding_dedup as E


def classes_of(spark, v):
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    return spark.createDataFrame([(0, i, bytearray(u.tobytes())) for i, u in enumerate(unit)], "label int, rep long, unit binary")


@pytest.mark.parametrize("partitions", [1, 40])
def test_partitions_part_no_neighbours(spark, monkeypatch, partitions):
    monkeypatch.setattr(E, "RUN", 32)
    monkeypatch.setattr(E, "partitions_for", lambda spark, parts: partitions, raising=False)
    r = np.random.default_rng(4)
    v = r.standard_normal((1, 16)) + 0.02 * r.standard_normal((200, 16))  # all are links
    # one order, a window of one: only if no neighbours are parted do the links join all rows
    got = E.neighbour_links(classes_of(spark, v), 200, 0.93, 1, 48, 1, 7).collect()
    assert len({x for e in got for x in e}) == 200
    assert len(E.forest([tuple(e) for e in got])) == 199


def test_labels_within_the_window_are_exact(spark):
    import brute
    r = np.random.default_rng(6)
    v = r.standard_normal((400, 256))
    pairs = np.concatenate((v, 0.53 * v + np.sqrt(1 - 0.53 ** 2) * r.standard_normal(v.shape)))
    given = [(i, x.tolist(), 0) for i, x in enumerate(pairs)]
    df = spark.createDataFrame(given, "vec_id long, embedding array<double>, label int")
    got = {x.vec_id: (x.n_links, x.component_id) for x in E.embedding_dedup(df, 0.5).collect()}
    assert got == brute.cosine(given, 0.5)
    assert sum(n for n, _ in got.values()) > 400


def test_passes_grow_with_the_largest_label():
    assert E.orders_for(0, 0.93)[0] == E.orders_for(1024, 0.93)[0] == 1
    passes = [E.orders_for(n, 0.93)[0] for n in (2_000, 100_000, 1_000_000, 40_000_000)]
    assert passes == sorted(passes) and passes[-1] > 2 * passes[1]
