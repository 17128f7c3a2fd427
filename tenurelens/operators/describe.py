"""Data description: overview, coverage, distributions, outliers, correlations, profile."""
from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenurelens.functions.columns import one_row, ratio, stack
from tenurelens.functions.scale import column_quantiles, column_value_counts, pin_small, summed_arrays
from tenurelens.operators.quality import distinct_counts, moments, null_counts, numeric_columns, text_columns
from tenurelens.rules import AGE_LIMITS, CRITICAL_FEATURES, FEATURE_GROUPS, FEATURE_RULES, MAX_SPAN, MAX_TENURE_DAYS, SALARY_LIMITS, group_of
from tenurelens.schema import PERSON, VANTAGE

PERCENTILES = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns, distinct persons, split and vantage counts as (metric, key, value)."""
    total = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(PERSON).alias("persons")).select(
        F.explode(F.array(F.struct(F.lit("rows").alias("metric"), F.lit("").alias("key"), F.col("rows").alias("value")),
                          F.struct(F.lit("persons").alias("metric"), F.lit("").alias("key"), F.col("persons").alias("value")),
                          F.struct(F.lit("columns").alias("metric"), F.lit("").alias("key"), F.lit(len(df.columns)).cast("long").alias("value"))))
        .alias("r")).select("r.*")
    n = df.groupBy("dataset_split", VANTAGE).agg(F.count(F.lit(1)).alias("n"))
    split = n.groupBy("dataset_split").agg(F.sum("n").alias("value")).select(F.lit("split").alias("metric"), F.col("dataset_split").alias("key"), "value")
    day = n.groupBy(VANTAGE).agg(F.sum("n").alias("value")).select(F.lit("vantage").alias("metric"), F.col(VANTAGE).cast("string").alias("key"), "value")
    return total.unionByName(split).unionByName(day)


def group_coverage(df: DataFrame, groups=None) -> DataFrame:
    """Per feature group: expected, available, coverage and mean null rate in percent."""
    spark, groups = df.sparkSession, groups or FEATURE_GROUPS
    rows = [(g, f, f in df.columns) for g, fs in groups.items() for f in fs]
    table = spark.createDataFrame(rows, "feature_group string, column_name string, available boolean")
    have = [f for _, f, ok in rows if ok]
    rates = null_counts(df, have).select("column_name", (ratio("n_null", "n_rows", 0.0) * 100).alias("null_rate"))
    j = table.join(rates, "column_name", "left")
    ok = F.count_if("available")
    return j.groupBy("feature_group").agg(
        F.count(F.lit(1)).alias("total_features"), ok.alias("available_features"),
        (ok / F.count(F.lit(1)) * 100).alias("coverage_percentage"), F.coalesce(F.avg("null_rate"), F.lit(0.0)).alias("avg_null_rate"))


def null_rates(df: DataFrame) -> DataFrame:
    """Null rate per column with its feature group and the >50 % mark."""
    names = [(c, group_of(c)) for c in df.columns]
    groups = df.sparkSession.createDataFrame(names, "column_name string, feature_group string")
    n = null_counts(df).withColumn("null_percentage", ratio("n_null", "n_rows", 0.0) * 100)
    return n.join(groups, "column_name").select("column_name", "feature_group", "null_percentage", (F.col("null_percentage") > 50).alias("high_null"))


def quality_metrics(df: DataFrame) -> DataFrame:
    """Cells, nulls, null rate, score 100 - null rate, and counts of sparse and constant columns."""
    n = null_counts(df).agg(F.sum("n_rows").alias("total_cells"), F.sum("n_null").alias("total_nulls"),
                            F.count_if(F.col("n_null") > F.col("n_rows") * 0.5).alias("high_null_columns"))
    # a column is constant when its smallest and largest values agree
    nums = numeric_columns(df)
    flat = df.agg(*[F.when(F.min(c) == F.max(c), 1).when(F.min(c).isNull(), 1).otherwise(0).alias(c) for c in nums])
    zero = flat.select(sum((F.col(c) for c in nums), F.lit(0)).alias("zero_variance_columns"))
    rate = ratio("total_nulls", "total_cells", 0.0) * 100
    return one_row(n, zero).withColumns(
        {"overall_null_rate": rate, "quality_score": 100 - rate})


def numeric_distributions(df: DataFrame, columns=None) -> DataFrame:
    """Moments and exact percentiles of every numeric column."""
    columns = columns or numeric_columns(df)
    return moments(df, columns).join(column_quantiles(df, columns, PERCENTILES), "column_name", "left")


def top_categories(df: DataFrame, columns=None, k=10) -> DataFrame:
    """The ``k`` most frequent values per text column, with the distinct count (null counts as a value)."""
    columns = columns or [c for c in text_columns(df) if c != PERSON]
    n = column_value_counts(df, columns)
    # keep the k best per partition of values first, so that no window sees a whole key-like column
    best = W.partitionBy("column_name", "_p").orderBy(F.desc("n"), F.asc_nulls_first("value"))
    part = n.withColumn("_p", F.pmod(F.xxhash64("value"), F.lit(64)))
    few = part.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= k).drop("_p", "_rn")
    rank = W.partitionBy("column_name").orderBy(F.desc("n"), F.asc_nulls_first("value"))
    top = few.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    distinct = n.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    return top.join(distinct, "column_name")


def temporal_patterns(df: DataFrame) -> DataFrame:
    """Vantage x split counts, survival time statistics and the event cross table, long form."""
    cells = df.groupBy(VANTAGE, "dataset_split").agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("vantage_split").alias("metric"), F.concat_ws("/", F.col(VANTAGE).cast("string"), "dataset_split").alias("key"), "value")
    cross = df.groupBy("event_indicator_all", "event_indicator_vol").agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("events").alias("metric"), F.concat_ws("/", F.col("event_indicator_all").cast("string"), F.col("event_indicator_vol").cast("string")).alias("key"), "value")
    stats = moments(df, ["survival_time_days"])
    times = stack(stats, ["n", "mean", "std", "min", "max"], name="key", value="value", cast="double").select(
        F.lit("survival_time").alias("metric"), "key", "value")
    return cells.unionByName(cross).unionByName(times)


def business_counts(df: DataFrame) -> DataFrame:
    """Rows outside the business limits, one row per check."""
    outside = lambda c, lo, hi: (F.col(c) < lo) | (F.col(c) > hi)
    checks = {"invalid_ages": ("age_at_vantage", *AGE_LIMITS), "invalid_salaries": ("baseline_salary", *SALARY_LIMITS),
              "invalid_tenure": ("tenure_at_vantage_days", 0, MAX_TENURE_DAYS), "excessive_manager_span": ("manager_span_control", float("-inf"), MAX_SPAN)}
    use = {k: v for k, v in checks.items() if v[0] in df.columns}
    return stack(df.agg(*[F.count_if(outside(*v)).alias(k) for k, v in use.items()]), list(use), name="metric", value="n_bad")


def completeness(df: DataFrame, by: str) -> DataFrame:
    """Non-null percentage per column within each value of ``by``."""
    n = null_counts(df, [c for c in df.columns if c != by], [by])
    return n.select(F.lit(by).alias("dimension"), F.col(by).cast("string").alias("key"), "column_name", "n_rows",
                    ((F.col("n_rows") - F.col("n_null")) / F.col("n_rows") * 100).alias("completeness"))


def outliers(df: DataFrame, columns=None) -> DataFrame:
    """Tukey fences per numeric column and the rows beyond them."""
    columns = columns or [c for c in numeric_columns(df) if c in FEATURE_RULES]
    q = pin_small(column_quantiles(df, columns, {"q1": 0.25, "q3": 0.75}))  # one row per column: the quantiles are found once
    fences = {r["column_name"]: (r["q1"] - 1.5 * (r["q3"] - r["q1"]), r["q3"] + 1.5 * (r["q3"] - r["q1"])) for r in q.collect()}
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[
        F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(c) for c, (lo, hi) in fences.items()])
    counted = stack(row, list(fences), ["_rows"], value="outlier_count")
    iqr = F.col("q3") - F.col("q1")
    return q.join(counted, "column_name").join(moments(df, columns).select("column_name", "mean", "std"), "column_name").select(
        "column_name", "q1", "q3", iqr.alias("iqr"), (F.col("q1") - 1.5 * iqr).alias("lower_bound"), (F.col("q3") + 1.5 * iqr).alias("upper_bound"),
        "mean", "std", "outlier_count", (F.col("outlier_count") / F.col("_rows") * 100).alias("outlier_percentage"))


def correlations(df: DataFrame, columns=None, threshold=0.8) -> DataFrame:
    """Pairs of numeric columns with absolute correlation above the threshold; all pairs in one pass."""
    columns = columns or numeric_columns(df)
    k = len(columns)
    x = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    middle = [v or 0.0 for v in x.agg(*[F.avg(c) for c in x.columns]).first()] if k else []

    def sums(cols):
        # of every pair of columns, over the rows that hold both: rows, sums, squares and products
        m = np.column_stack(list(cols.values())) - middle
        there = ~np.isnan(m)
        m, there = np.where(there, m, 0.0), there.astype(float)
        return np.concatenate([y.ravel() for y in (there.T @ there, m.T @ there, (m * m).T @ there, m.T @ m)])

    got = summed_arrays(x, sums) if k > 1 else np.zeros(0)
    rows = []
    if len(got):
        n, s, q, p = got.reshape(4, k, k)
        with np.errstate(all="ignore"):
            sd = np.sqrt(np.maximum(q / n - (s / n) ** 2, 0))
            r = np.abs((p / n - (s / n) * (s.T / n)) / (sd * sd.T))
        rows = [(columns[i], columns[j], float(r[i, j])) for i, j in combinations(range(k), 2) if r[i, j] > threshold]
    return df.sparkSession.createDataFrame(rows, "feature1 string, feature2 string, correlation double")


def feature_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, nulls, group, rule marks, moments or cardinality."""
    meta = [(f.name, f.dataType.simpleString(), group_of(f.name), f.name in CRITICAL_FEATURES, f.name in FEATURE_RULES) for f in df.schema.fields]
    table = df.sparkSession.createDataFrame(
        meta, "column_name string, data_type string, feature_group string, is_critical boolean, has_validation_rules boolean")
    n = null_counts(df)
    stats = moments(df, numeric_columns(df)).drop("n")
    card = distinct_counts(df, text_columns(df))
    filled = F.col("n_rows") - F.col("n_null")
    return table.join(n, "column_name").join(stats, "column_name", "left").join(card, "column_name", "left").select(
        "column_name", "data_type", "feature_group", "is_critical", "has_validation_rules", "n_rows", "n_null", filled.alias("n_filled"),
        (ratio("n_null", "n_rows", 0.0) * 100).alias("null_percentage"), "min", "max", "mean", "std", "n_distinct",
        F.when(F.col("n_distinct").isNotNull(), ratio("n_distinct", filled, 0.0)).alias("cardinality"))


def split_metrics(df: DataFrame) -> DataFrame:
    return df.groupBy("dataset_split").agg(F.count(F.lit(1)).alias("record_count"), F.count_distinct(PERSON).alias("unique_persons"))


def dashboard(df: DataFrame) -> dict:
    """Tables behind the validation dashboard."""
    return {"group_completeness": group_coverage(df).drop("avg_null_rate"), "null_rates": null_rates(df).drop("high_null"),
            "split_metrics": split_metrics(df)}


def describe_all(df: DataFrame) -> DataFrame:
    """Every description report as one long table (report, key, metric, value)."""
    def long(report, d, key, metrics):
        return stack(d, metrics, [key], "metric", "value", "double").select(
            F.lit(report).alias("report"), F.col(key).cast("string").alias("key"), "metric", "value")

    parts = [
        overview(df).select(F.lit("overview").alias("report"), "key", "metric", F.col("value").cast("double").alias("value")),
        long("groups", group_coverage(df), "feature_group", ["total_features", "available_features", "coverage_percentage", "avg_null_rate"]),
        long("quality", quality_metrics(df).withColumn("all", F.lit("all")), "all", ["total_cells", "total_nulls", "overall_null_rate", "quality_score"]),
        long("numeric", numeric_distributions(df), "column_name", ["n", "mean", "std", "min", "max", *PERCENTILES]),
        top_categories(df).select(F.lit("categories").alias("report"), F.concat_ws("=", "column_name", F.coalesce("value", F.lit("null"))).alias("key"),
                                  F.lit("n").alias("metric"), F.col("n").cast("double").alias("value")),
        temporal_patterns(df).select(F.lit("temporal").alias("report"), "key", "metric", "value"),
        business_counts(df).select(F.lit("business").alias("report"), F.lit("all").alias("key"), "metric", F.col("n_bad").cast("double").alias("value")),
        *[completeness(df, by).select(F.lit(f"completeness:{by}").alias("report"), F.concat_ws("/", "key", "column_name").alias("key"),
                                      F.lit("completeness").alias("metric"), F.col("completeness").alias("value")) for by in ("dataset_split", VANTAGE)],
        long("outliers", outliers(df), "column_name", ["q1", "q3", "iqr", "lower_bound", "upper_bound", "outlier_count", "outlier_percentage"]),
        correlations(df).select(F.lit("correlation").alias("report"), F.concat_ws("/", "feature1", "feature2").alias("key"),
                                F.lit("abs_corr").alias("metric"), F.col("correlation").alias("value")),
    ]
    return reduce(DataFrame.unionByName, parts)
