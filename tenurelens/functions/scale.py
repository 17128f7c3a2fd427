"""Building blocks that keep ranks, quantiles and running sums spread over the cluster.

A window over one hot group runs in one task, so these helpers first count equal
values, then cut the value axis into fixed buckets.  The bucket of a value depends
on nothing but the value: a lost executor recomputes the same buckets.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenurelens.schema import SMALL_ROWS
from tenurelens.sources.shared import new_path

BUCKETS_PER_E_FOLD = 4096.0


def pin_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Evaluate a small table once; Spark then knows its size and may broadcast it.

    A table with more than ``rows`` rows is returned as it was and is joined by shuffle.
    """
    got = df.limit(rows + 1).toArrow()
    if got.num_rows > rows:
        return df
    # from Arrow it becomes a local relation whose size the planner can see
    return df.sparkSession.createDataFrame(got, df.schema)


def value_bucket(c: Column) -> Column:
    """Monotone bucket number of a real value, about 0.02 % wide."""
    c = c.cast("double")
    return F.floor(F.signum(c) * F.log1p(F.abs(c) * 1e6) * BUCKETS_PER_E_FOLD).cast("long")


def running_totals(df: DataFrame, by, order: str, totals, descending=False) -> DataFrame:
    """Inclusive running sums ``cum_<c>`` and sums of the whole group ``all_<c>``, in two stages.

    The sums run along ``order`` within ``by``; ``df`` holds one row per (by, order).
    Totals per bucket give each bucket its offset; the sums inside a bucket then
    need only that bucket's rows.
    """
    by = list(by)
    d = df.withColumn("_b", value_bucket(F.col(order)))
    per_bucket = d.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in totals])
    b = F.desc("_b") if descending else F.asc("_b")
    before = W.partitionBy(*(by or [F.lit(0)])).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*(by or [F.lit(0)]))
    offsets = per_bucket.select(
        *by, "_b", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in totals],
        *[F.sum(f"_t_{c}").over(whole).alias(f"all_{c}") for c in totals])
    inside = W.partitionBy(*by, "_b").orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(
        W.unboundedPreceding, 0)
    joined = null_safe_join(d, by_shuffle(offsets), by + ["_b"], "inner")
    kept = [c for c in df.columns]
    return joined.select(*kept, *[(F.sum(c).over(inside) + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in totals],
                         *[f"all_{c}" for c in totals])


def range_ranks(df: DataFrame, by, order, out: str) -> DataFrame:
    """Place of each row (from 1) along ``order`` within ``by``; ``order`` must not leave ties.

    Rows are range-partitioned by group and order and numbered where they are; how many rows of its group come before a
    partition makes the number a rank.  So neither a group, nor a value, nor a common beginning of texts is one task.  The
    numbered rows are written first: ranges come from samples and must not change when a lost task is run again.
    """
    by = list(by)
    spark, given = df.sparkSession, df.columns
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, "ranges")
    df.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    d = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    here = d.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    up = W.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    here = here.select(*by, "_part", "_first", F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_before"))
    return null_safe_join(d, here, [*by, "_part"], "inner").select(*given, (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(out))


def value_before(df: DataFrame, by, order: str, value: str, out: str) -> DataFrame:
    """``value`` of the row before along a real-valued ``order`` within ``by``; null at the first. Fixed buckets of ``order`` hand their last value on."""
    by = list(by)
    d = df.withColumn("_b", value_bucket(F.col(order)))
    last = d.groupBy(*by, "_b").agg(F.max_by(value, order).alias("_last"))
    carry = last.select(*by, "_b", F.lag("_last").over(W.partitionBy(*(by or [F.lit(0)])).orderBy("_b")).alias("_carry"))
    own = F.lag(value).over(W.partitionBy(*by, "_b").orderBy(order))
    return null_safe_join(d.withColumn("_own", own), by_shuffle(carry), [*by, "_b"], "inner").withColumn(out, F.coalesce("_own", "_carry")).drop("_b", "_own", "_carry")


def by_shuffle(df: DataFrame) -> DataFrame:
    """A table that grows with the input, to be joined by shuffle and merge: shuffled files of a few MB can be hundreds of MB on the driver
    when they are broadcast."""
    return df.hint("merge")


def null_safe_join(left: DataFrame, right: DataFrame, on, how="left") -> DataFrame:
    """Equi-join on ``on`` where null keys meet null keys; right-hand keys are dropped."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in on])


def summed_arrays(df: DataFrame, numbers) -> np.ndarray:
    """Element-wise sum of what ``numbers(columns)`` gives for each batch of ``df``.

    ``columns`` maps names to float arrays (null is NaN).  Each task adds up its own batches; the
    arrays of the tasks are then added position by position, so the driver gets one array.
    """
    names = df.columns

    def run(batches):
        total = None
        for b in batches:
            part = numbers({c: b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names})
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["a"])

    parts = df.mapInArrow(run, "a array<double>").select(F.posexplode("a").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    return np.array([r["v"] for r in sorted(parts.collect(), key=lambda r: r["i"])])


def percent_rank_by(df: DataFrame, by, order: str, out: str) -> DataFrame:
    """``percent_rank`` of ``order`` within ``by`` without a window over people.

    Rows with a null ``order`` are kept with a null rank.
    """
    by = list(by)
    counts = df.where(F.col(order).isNotNull()).groupBy(*by, order).agg(F.count(F.lit(1)).alias("_n"))
    size = F.col("all__n")
    ranks = running_totals(counts, by, order, ["_n"]).select(
        *by, order, F.when(size > 1, (F.col("cum__n") - F.col("_n")) / (size - 1)).otherwise(0.0).alias(out))
    on = by + [order]
    return null_safe_join(df, by_shuffle(ranks), on, "left")


def exact_quantiles(df: DataFrame, by, value: str, probs: dict) -> DataFrame:
    """Exact quantiles (linear interpolation), one row per group, one column per name.

    ``probs`` maps output names to probabilities.  A histogram over fixed buckets
    locates the buckets that hold the wanted ranks; only values in those buckets
    are then counted one by one.
    """
    by = list(by)
    key = by or ["_all"]
    src = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    src = src.where(~F.isnan("_v"))
    if not by:
        src = src.withColumn("_all", F.lit(0))
    src = src.withColumn("_b", value_bucket(F.col("_v")))
    hist = src.groupBy(*key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    wanted = pin_small(_wanted_buckets(hist, key, probs))
    buckets = wanted.groupBy(*key, "_b").agg(F.max("_below").alias("_below"))
    values = null_safe_join(src, buckets, key + ["_b"], "inner").groupBy(*key, "_b", "_below", "_v").agg(
        F.count(F.lit(1)).alias("_c"))
    out = _quantiles_of(values, wanted, key, list(probs))
    return out if by else out.drop("_all")


def _wanted_buckets(hist: DataFrame, key, probs: dict) -> DataFrame:
    """Of a histogram (key, _b, _n) the buckets that hold the wanted ranks, with the ranks."""
    up = W.partitionBy(*key).orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*key)
    hist = hist.select(*key, "_b", (F.sum("_n").over(up) - F.col("_n")).alias("_below"),
                       "_n", F.sum("_n").over(whole).alias("_size"))
    want = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in probs.items()]))
    hist = hist.withColumn("_w", want).select("*", "_w.name", "_w.p").drop("_w")
    pos = (F.col("_size") - 1) * F.col("p")
    hist = hist.withColumn("_lo", F.floor(pos)).withColumn("_hi", F.ceil(pos)).withColumn("_frac", pos - F.floor(pos))
    hit = ((F.col("_lo") >= F.col("_below")) & (F.col("_lo") < F.col("_below") + F.col("_n"))) | (
        (F.col("_hi") >= F.col("_below")) & (F.col("_hi") < F.col("_below") + F.col("_n")))
    return hist.where(hit).select(*key, "_b", "name", "_below", "_lo", "_hi", "_frac")


def _quantiles_of(values: DataFrame, wanted: DataFrame, key, names) -> DataFrame:
    """Quantiles from the counted values (key, _b, _below, _v, _c) of the wanted buckets; one row per key."""
    inside = W.partitionBy(*key, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    values = values.select(*key, "_b", "_v", (F.col("_below") + F.sum("_c").over(inside)).alias("_upto"), "_c")
    got = null_safe_join(values, wanted.drop("_below"), key + ["_b"], "inner")
    first = F.col("_upto") - F.col("_c")
    at = lambda r: F.max(F.when((F.col(r) >= first) & (F.col(r) < F.col("_upto")), F.col("_v")))
    per = got.groupBy(*key, "name").agg(at("_lo").alias("_a"), at("_hi").alias("_z"), F.max("_frac").alias("_frac"))
    per = per.withColumn("_q", F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_frac"))
    return per.groupBy(*key).agg(*[F.max(F.when(F.col("name") == n, F.col("_q"))).alias(n) for n in names])


def column_quantiles(df: DataFrame, columns, probs: dict) -> DataFrame:
    """As ``exact_quantiles`` for many columns at once: ``column_name`` and one column per name of ``probs``.

    A batch counts the buckets of all its columns in place; a second pass counts, again in place, only the values in the few
    buckets that hold a wanted rank.  No row is unfolded into one per column.
    """
    columns = list(columns)
    data = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])

    def numbers(batch):
        for i in range(len(columns)):
            v = batch.column(i).to_numpy(zero_copy_only=False).astype(float)
            v = v[~np.isnan(v)]
            yield i, v, np.floor(np.sign(v) * np.log1p(np.abs(v) * 1e6) * BUCKETS_PER_E_FOLD).astype(np.int64)

    def histograms(batches):
        for batch in batches:
            found = [(i, *np.unique(b, return_counts=True)) for i, _, b in numbers(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(len(b), i, dtype=np.int32) for i, b, _ in found])),
                                              pa.array(np.concatenate([b for _, b, _ in found])), pa.array(np.concatenate([n for *_, n in found]))], ["_k", "_b", "_n"])

    hist = data.mapInArrow(histograms, "_k int, _b long, _n long").groupBy("_k", "_b").agg(F.sum("_n").alias("_n"))
    wanted = pin_small(_wanted_buckets(hist, ["_k"], probs))
    below = {(r["_k"], r["_b"]): r["_below"] for r in wanted.select("_k", "_b", "_below").distinct().collect()}
    hit = {i: np.array(sorted(b for k, b in below if k == i), dtype=np.int64) for i in range(len(columns))}

    def refined(batches):
        for batch in batches:
            rows = [(np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64))]
            for i, v, b in numbers(batch):
                in_ = np.isin(b, hit[i])
                value, at, n = np.unique(v[in_], return_index=True, return_counts=True)
                rows.append((np.full(len(value), i, dtype=np.int32), b[in_][at], value, n))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[j] for r in rows])) for j in range(4)], ["_k", "_b", "_v", "_c"])

    values = data.mapInArrow(refined, "_k int, _b long, _v double, _c long").groupBy("_k", "_b", "_v").agg(F.sum("_c").alias("_c"))
    offsets = df.sparkSession.createDataFrame([(k, b, n) for (k, b), n in below.items()], "_k int, _b long, _below long")
    got = _quantiles_of(values.join(offsets, ["_k", "_b"]), wanted, ["_k"], list(probs))
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "_k int, column_name string")
    return got.join(names, "_k").drop("_k").select("column_name", *probs)


def column_value_counts(df: DataFrame, columns) -> DataFrame:
    """``column_name``, ``value`` (text) and ``n`` of many columns at once; each batch counts its own values first."""
    columns = list(columns)

    def counts(batches):
        for batch in batches:
            found = [pc.value_counts(batch.column(i)) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(columns), dtype=np.int32), [len(f) for f in found])),
                                              pa.concat_arrays([f.field(0) for f in found]), pa.concat_arrays([f.field(1) for f in found])], ["_k", "value", "n"])

    texts = df.select(*[F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate(columns)])
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "_k int, column_name string")
    n = texts.mapInArrow(counts, "_k int, value string, n long").groupBy("_k", "value").agg(F.sum("n").alias("n"))
    return n.join(names, "_k").select("column_name", "value", "n")


def previous_value(df: DataFrame, by, date: str, value: str, tiebreak=(), out="prev_value") -> DataFrame:
    """Value of the preceding row per group, ordered by date, tie-break and value.

    The rows of a group are split by year and month; the last value of each
    earlier month is handed over in a small summary table, so a group with very
    many rows is still worked on by many tasks.
    """
    by = list(by)
    d = df.withColumn("_m", F.year(date) * 12 + F.month(date))
    order = [date, *tiebreak, value]
    w = W.partitionBy(*by, "_m").orderBy(*order)
    d = d.withColumn("_p", F.lag(value).over(w)).withColumn("_rn", F.row_number().over(w))
    last = df.withColumn("_m", F.year(date) * 12 + F.month(date)).groupBy(*by, "_m").agg(
        F.max_by(value, F.struct(*order)).alias("_last"))
    carry = last.select(*by, "_m", F.lag("_last").over(W.partitionBy(*by).orderBy("_m")).alias("_carry"))
    j = d.join(by_shuffle(carry), by + ["_m"], "left")
    return j.withColumn(out, F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_p"))).drop(
        "_m", "_p", "_rn", "_carry")
