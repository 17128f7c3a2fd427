"""Near-duplicate vectors by sorted projection passes."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurelens.llm.components import components, same_id_links
from tenurelens.llm.tables import ship, stored, write
from tenurelens.sources.shared import new_path

#: Bits of an order, rows of a run (more for wide windows), members of a block, rows compared at a time.
BITS, RUN, BLOCK, STEP = 48, 4096, 512, 256
#: Smallest and largest window, share of lone pairs at the threshold that all orders together may miss, least orders where the window isn't the whole label.
WINDOWS, MISSED, LEAST_PASSES = (1024, 4096), 0.03, 4
_PLANES: dict = {}


def planes(dim: int, passes: int, bits: int, seed: int) -> np.ndarray:
    """Normals of random hyperplanes, the same in every task."""
    key = (dim, passes, bits, seed)
    if key not in _PLANES:
        _PLANES[key] = np.random.default_rng([seed, dim]).standard_normal((dim, passes * bits))
    return _PLANES[key]


def orders_for(largest: int, threshold: float) -> tuple[int, int]:
    """Passes and window for a label of ``largest`` distinct vectors; one pass whose window holds them all is exact.

    Two vectors at the threshold agree in a bit with 1 - angle / pi, and are neighbours if they
    agree in the bits that cut the label to a window: log2(largest / window) of them for vectors
    spread evenly, 1.71 times that where two vectors have a cosine of 0.5 on average.
    """
    window = int(min(WINDOWS[1], max(WINDOWS[0], 2 ** np.ceil(np.log2(max(1, largest)) / 2))))
    if largest <= window:
        return 1, window
    near = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** (1.71 * np.log2(largest / window))
    return (max(LEAST_PASSES, int(np.ceil(np.log(MISSED) / np.log1p(-near)))) if near < 1 else LEAST_PASSES), window


def vectors_of(column) -> np.ndarray:
    """Rows of a binary column of doubles."""
    if not len(column):
        return np.zeros((0, 0))
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(len(column), -1)


def forest(pairs) -> list[tuple[int, int]]:
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def valid_classes(rows: DataFrame) -> DataFrame:
    """Each distinct usable vector once: ``label``, ``v`` (array of doubles), ``rep`` (its smallest id), ``copies``, ``unit`` (binary, length 1)."""
    v = F.col("v")
    ok = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    usable = rows.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))
    classes = usable.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))

    def unit(batches):
        for b in batches:
            out = []
            for x in b.column("v"):
                a = np.array(x.values, dtype=np.float64)
                a = a / np.abs(a).max()  # so that squares neither overflow nor vanish
                out.append((a / np.sqrt(a @ a)).tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("label", "v", "rep", "copies")), pa.array(out, pa.binary())], ["label", "v", "rep", "copies", "unit"])

    return classes.mapInArrow(unit, f"label {rows.schema['label'].dataType.simpleString()}, v array<double>, rep long, copies long, unit binary")


def linked_pairs(v: np.ndarray, ids: np.ndarray, threshold: float, window: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs at ``window`` places or fewer (and some farther ones) that reach the threshold."""
    out = []
    for x in range(0, len(v), STEP):
        low = max(0, x - window)
        r, c = np.nonzero(v[x:x + STEP] @ v[low:x + STEP].T >= threshold)
        r += x - low
        root = np.arange(min(len(v), x + STEP) - low)
        while len(r):  # the smallest place of each group of linked rows
            least = np.minimum(root[r], root[c])
            np.minimum.at(root, r, least)
            np.minimum.at(root, c, least)
            root = root[root]
            apart = root[r] != root[c]
            r, c = r[apart], c[apart]
        i = np.flatnonzero(root != np.arange(len(root)))
        out += zip(ids[low + i].tolist(), ids[low + root[i]].tolist())
    return forest(out)


def neighbour_links(classes: DataFrame, total: int, threshold: float, passes: int, bits: int, window: int, seed: int) -> DataFrame:
    """Verified pairs (a, b), thinned to a spanning forest per run, from all passes.

    In a pass every vector gets the signs of its projections on the pass's own hyperplanes as one
    sort key.  Rows are sorted by label, length and key over the whole cluster and numbered, and
    each is compared with the ``window`` rows before it: a run of rows gets the last ``window``
    of the run before, so neither partitions nor the session's settings part neighbours.
    """
    spark = classes.sparkSession
    label = classes.schema["label"].dataType.simpleString()
    run = max(RUN, 4 * window)

    def keyed(batches):
        for b in batches:
            by_dim: dict = {}
            for i, x in enumerate(b.column("unit")):
                by_dim.setdefault(len(x.as_py()), []).append(i)
            for size, rows in by_dim.items():
                part = b.take(pa.array(rows))
                v = vectors_of(part.column("unit"))
                n = len(v)
                for p in range(passes):
                    sign = v @ planes(v.shape[1], passes, bits, seed)[:, p * bits:(p + 1) * bits] >= 0
                    keys = np.packbits(sign, axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p, dtype=np.int32)), part.column("label"), pa.array(np.full(n, size, dtype=np.int32)),
                                                      pa.array([k.tobytes() for k in keys], pa.binary()), part.column("rep"), part.column("unit")],
                                                     ["pass", "label", "size", "key", "rep", "unit"])

    rows = classes.mapInArrow(keyed, f"pass int, label {label}, size int, key binary, rep long, unit binary")
    n = max(1, -(-total * passes // run))
    ordered = rows.repartitionByRange(n, "pass", "label", "size", "key", "rep").sortWithinPartitions("pass", "label", "size", "key", "rep")
    path = new_path(spark, "ordered")
    write(ordered.select("pass", "label", "size", "rep", "unit", F.monotonically_increasing_id().alias("at")), path)
    part = F.shiftright("at", 33)
    ordered = spark.read.parquet(path).withColumn("part", part)
    counts = sorted((r["part"], r["count"]) for r in ordered.groupBy("part").count().collect())
    starts = np.cumsum([0] + [c for _, c in counts]).tolist()
    starts = spark.createDataFrame([(p, s) for (p, _), s in zip(counts, starts)], "part long, start long")
    place = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = ordered.join(starts, "part").withColumn("place", place).withColumn("run", F.floor(F.col("place") / run))
    both = F.when(F.col("place") % run >= run - window, F.array(F.col("run"), F.col("run") + 1)).otherwise(F.array("run"))
    runs = placed.withColumn("run", F.explode(both)).select("run", "place", "pass", "label", "size", "rep", "unit")

    def compare(table):
        table = table.combine_chunks().sort_by("place")
        group = list(zip(*(table.column(c).to_pylist() for c in ("pass", "label", "size"))))
        cut = [i for i in range(len(group)) if i == 0 or group[i] != group[i - 1]] + [len(group)]
        rep, unit, found = table.column("rep").to_numpy(), table.column("unit"), []
        for x, y in zip(cut[:-1], cut[1:]):
            found += linked_pairs(vectors_of(unit.slice(x, y - x)), rep[x:y], threshold, window)
        return pa.table([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return runs.groupBy("run").applyInArrow(compare, "a long, b long")


def count_links(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links of each class within its component (``comp``, ``rep``, ``copies``, ``unit``): blocks against blocks, one number per row and block."""
    size = members.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    dealt = members.join(size, "comp").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("block", F.xxhash64("comp", "part"))  # a key of its own, so that a large component's blocks go to many tasks

    def stored(table):
        table = table.combine_chunks().sort_by("rep")
        reps, copies = (table.column(c).to_numpy().astype(np.int64).tobytes() for c in ("rep", "copies"))
        return pa.table({"comp": table.column("comp").slice(0, 1), "part": table.column("part").slice(0, 1), "reps": pa.array([reps], pa.binary()),
                         "copies": pa.array([copies], pa.binary()), "units": pa.array([b"".join(table.column("unit").to_pylist())], pa.binary())})

    packed = dealt.select("block", "comp", "part", "rep", "copies", "unit").groupBy("block").applyInArrow(stored, "comp long, part int, reps binary, copies binary, units binary")
    other = packed.select("comp", F.col("reps").alias("reps2"), F.col("copies").alias("copies2"), F.col("units").alias("units2"))

    def compare(batches):
        for b in batches:
            ids, counts = [], []
            for r, u, r2, c2, u2 in zip(*(b.column(c).to_pylist() for c in ("reps", "units", "reps2", "copies2", "units2"))):
                r, r2, c2 = (np.frombuffer(x, dtype=np.int64) for x in (r, r2, c2))
                v, v2 = (np.frombuffer(x, dtype=np.float64).reshape(n, -1) for x, n in ((u, len(r)), (u2, len(r2))))
                linked = v @ v2.T >= threshold
                linked &= r[:, None] != r2[None, :]
                ids.append(r)
                counts.append(linked @ c2)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, dtype=np.int64)) for x in (ids, counts)], ["rep", "n"])

    return packed.join(other, "comp").select("reps", "units", "reps2", "copies2", "units2").mapInArrow(compare, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("others"))


def embedding_dedup(vectors: DataFrame, threshold: float = 0.93, passes: int | None = None, bits: int = BITS, window: int | None = None, block: int = BLOCK, seed: int = 7,
                    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Only vectors with equal, non-null labels and equal lengths are compared, by cosine in
    doubles.  Equal vectors are one class.  Each of ``passes`` orders brings most close pairs within
    ``window`` places; both follow from the largest label's number of classes unless given
    (``orders_for``; labels of up to 1,024 classes are exact).  Pairs that reach the threshold join components (every pair is verified,
    so no link is false, and a link is missed only if no order brings it or a chain of others
    together).  Links are then counted exactly inside each component, in blocks of ``block``; their
    number is returned, never the pairs.

    Vectors that are null, empty, zero or hold null or non-finite components, and those with a
    null label, link with nothing.  Rows with equal ids are one node.  A row with a null id has a
    null component and is kept.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    classes = stored(valid_classes(rows).withColumn("cls", F.monotonically_increasing_id()), "vectors")
    sizes = classes.groupBy("label", F.size("v").alias("size")).count().agg(F.sum("count"), F.max("count")).first()
    total, largest = sizes[0] or 0, sizes[1] or 0
    derived = orders_for(largest, threshold)
    passes, window = passes or derived[0], window or derived[1]
    # the nodes here are classes, so a component is within one label
    named = classes.select("label", F.col("cls").alias("rep"), "unit", "copies")
    comp = stored(components(neighbour_links(named.drop("copies"), total, threshold, passes, bits, window, seed)), "comp")
    members = named.join(comp, F.col("rep") == F.col("id")).select(F.col("component_id").alias("comp"), "rep", "copies", "unit")
    counted = count_links(members, threshold, block)
    per_class = classes.select("label", "v", "cls", "rep", "copies").join(counted.withColumnRenamed("rep", "of"), F.col("cls") == F.col("of"), "left").join(comp, F.col("cls") == F.col("id"), "left")
    per_class = per_class.select("label", "v", "rep", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("_n"), F.coalesce("component_id", "cls").alias("_c"))
    # then the smallest id of each component, and components that an id with several vectors joins; rows that nothing can link
    # don't take part in the joins
    whole = F.col("label").isNotNull() & F.col("v").isNotNull() & F.col("vec_id").isNotNull()
    found = stored(rows.where(whole).join(per_class, ["label", "v"], "left").select("vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), "_c", "rep"), "linked")
    smallest = found.where("_c is not null").groupBy("_c").agg(F.min("rep").alias("_first"))
    alone = found.where("_c is null").select("vec_id").unionByName(rows.where(~whole).select("vec_id")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("_first"))
    each = found.join(smallest, "_c").select("vec_id", "n_links", "_first").unionByName(alone)
    joined = components(same_id_links(each.where("vec_id is not null").select("vec_id", "_first"), "vec_id", "_first")).select(F.col("id").alias("_first"), "component_id")
    return each.join(joined, "_first", "left").select("vec_id", "n_links", F.coalesce("component_id", "_first").alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
