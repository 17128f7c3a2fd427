"""Validation suite: every check is rows of one report (check, column, n_bad, passed)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenurelens.functions.columns import ratio, stack, unpivot_stats
from tenurelens.rules import FEATURE_RULES
from tenurelens.schema import ENTITY, PERSON, VANTAGE

# fixed values: date columns that may not lie after the vantage date, durations that
# may not be negative, columns that may not be present, 0/1 flags, 0..1 ranks
DATE_COLUMNS = ["event_eff_dt", "rec_eff_start_dt_mod", "rec_eff_end_dt", "termination_date", "hire_date", "last_promotion_date"]
DURATIONS = ["days_since_promot", "days_since_transfer", "time_since_last_promotion", "manager_changes_count"]
FORBIDDEN = ["termination_date", "future_salary", "post_termination_indicator"]
FLAGS = ["event_indicator_all", "event_indicator_vol", "promot_2yr_ind", "demot_2yr_ind"]
RANKS = ["compensation_percentile_company", "compensation_percentile_industry"]


def numeric_columns(df: DataFrame):
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame):
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def count_report(df: DataFrame, checks) -> DataFrame:
    """Count bad rows of all checks in one pass; ``checks`` is [(check, column, condition)]."""
    if not checks:
        return df.sparkSession.createDataFrame([], "check string, column_name string, n_bad long, passed boolean")
    row = df.agg(*[F.count_if(cond).alias(f"n{i}") for i, (_, _, cond) in enumerate(checks)])
    cells = [F.struct(F.lit(name).alias("check"), F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n_bad"))
             for i, (name, c, _) in enumerate(checks)]
    return row.select(F.explode(F.array(*cells)).alias("r")).select("r.*", (F.col("r.n_bad") == 0).alias("passed"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    return _duplicates(df, df.columns, "duplicate_rows", "*")


def duplicate_persons(df: DataFrame) -> DataFrame:
    return _duplicates(df, ENTITY, "duplicate_persons", ",".join(ENTITY))


def _duplicates(df, keys, name, label):
    extra = df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("_x")).agg(F.coalesce(F.sum("_x"), F.lit(0)).alias("n_bad"))
    return extra.select(F.lit(name).alias("check"), F.lit(label).alias("column_name"), "n_bad", (F.col("n_bad") == 0).alias("passed"))


def duplicate_samples(df: DataFrame, k=5) -> DataFrame:
    """The ``k`` most repeated entities."""
    n = df.groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return n.orderBy(F.desc("n"), *ENTITY).limit(k)


def temporal_checks(df):
    return [("after_vantage", c, F.col(c) > F.col(VANTAGE)) for c in DATE_COLUMNS if c in df.columns]


def range_checks(df, rules=None):
    out = []
    for name, rule in (rules or FEATURE_RULES).items():
        if name not in df.columns:
            continue
        c = F.col(name)
        v = c.try_cast("double") if name in text_columns(df) else c
        if rule.minimum is not None:
            out.append(("below_minimum", name, v < rule.minimum))
        if rule.maximum is not None:
            out.append(("above_maximum", name, v > rule.maximum))
        if rule.values:
            out.append(("unknown_value", name, ~c.isin(*rule.values)))
        if not rule.allow_null:
            out.append(("null_value", name, c.isNull()))
    return out


def business_checks(df):
    has = set(df.columns)
    out = []
    if "age_at_vantage" in has:
        out.append(("age_16_85", "age_at_vantage", (F.col("age_at_vantage") < 16) | (F.col("age_at_vantage") > 85)))
    if {"tenure_at_vantage_days", "age_at_vantage"} <= has:
        out.append(("tenure_over_age", "tenure_at_vantage_days", F.col("tenure_at_vantage_days") / 365.25 > F.col("age_at_vantage") - 14))
    if "num_promot_2yr" in has:
        out.append(("many_promotions", "num_promot_2yr", F.col("num_promot_2yr") > 5))
    out += [("rank_0_1", c, (F.col(c) < 0) | (F.col(c) > 1)) for c in RANKS if c in has]
    out += [("flag_0_1", c, ~F.col(c).isin(0, 1)) for c in FLAGS if c in has]
    return out


def leakage_checks(df):
    has = set(df.columns)
    out = [("forbidden_column", c, F.lit(True)) for c in FORBIDDEN if c in has and "event_indicator_all" in has]
    out += [("negative_duration", c, F.col(c) < 0) for c in DURATIONS if c in has]
    if {"event_indicator_all", "survival_time_days"} <= has:
        out.append(("censored_before_end", "survival_time_days",
                    (F.col("event_indicator_all") == 0) & (F.col("survival_time_days") != 365)))
    return out


def validate_temporal_consistency(df: DataFrame) -> DataFrame:
    return count_report(df, temporal_checks(df))


def validate_feature_ranges(df: DataFrame, rules=None) -> DataFrame:
    return count_report(df, range_checks(df, rules))


def validate_business_logic(df: DataFrame) -> DataFrame:
    return count_report(df, business_checks(df))


def detect_data_leakage(df: DataFrame) -> DataFrame:
    return count_report(df, leakage_checks(df))


def distinct_counts(df: DataFrame, columns) -> DataFrame:
    """Exact distinct non-null values per column: count values once, then count the counts."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, n_distinct long")
    values = stack(df, columns, cast="string").where(F.col("value").isNotNull()).distinct()
    return values.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))


def moments(df: DataFrame, columns) -> DataFrame:
    """count, mean, sample deviation, min, max per numeric column, one pass."""
    stats = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}__{s}") for c in columns for s, f in stats.items()])
    return unpivot_stats(row, columns, list(stats))


def null_counts(df: DataFrame, columns=None, by=()) -> DataFrame:
    """Rows and nulls per column (and group) in one pass without unfolding rows."""
    columns = columns or [c for c in df.columns if c not in by]
    row = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"{c}__n") for c in columns])
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}__n`").alias("n_null")) for c in columns]
    return row.select(*by, "n_rows", F.explode(F.array(*cells)).alias("c")).select(*by, "n_rows", "c.*")


def validate_feature_distributions(df: DataFrame) -> DataFrame:
    """Null rate above .95, few distinct values, more than 1 % beyond five deviations, text keys.

    One row per column with its measures and the names of the findings.
    """
    skip = [PERSON, VANTAGE, "dataset_split"]
    cols = [c for c in df.columns if c not in skip]
    nums = [c for c in numeric_columns(df) if c in cols]
    texts = [c for c in text_columns(df) if c != PERSON]
    nulls = null_counts(df, cols)
    stats = df.agg(*[f(c).alias(f"{c}__{n}") for c in nums for f, n in ((F.avg, "m"), (F.stddev_samp, "s"))]).first()
    far = [F.count_if(F.abs(F.col(c) - F.lit(stats[f"{c}__m"])) > 5 * F.lit(stats[f"{c}__s"])).alias(f"{c}__far") for c in nums
           if stats[f"{c}__m"] is not None and stats[f"{c}__s"]]
    names = [c for c in nums if stats[f"{c}__m"] is not None and stats[f"{c}__s"]]
    row = df.agg(*far) if far else None
    out = nulls.join(distinct_counts(df, list(dict.fromkeys(nums + texts))), "column_name", "full")
    if row is not None:
        cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}__far`").alias("n_far")) for c in names]
        out = out.join(row.select(F.explode(F.array(*cells)).alias("c")).select("c.*"), "column_name", "left")
    else:
        out = out.withColumn("n_far", F.lit(None).cast("long"))
    rows = df.agg(F.count(F.lit(1)).alias("_all")).first()["_all"]
    out = out.withColumns({"n_rows": F.lit(rows), "n_distinct": F.coalesce("n_distinct", F.lit(0)), "n_far": F.coalesce("n_far", F.lit(0))})
    is_num, is_text = F.col("column_name").isin(nums), F.col("column_name").isin(texts)
    finding = [("mostly_null", ratio("n_null", "n_rows", 0.0) > 0.95), ("constant", is_num & (F.col("n_distinct") <= 1)),
               ("few_values", is_num & F.col("n_distinct").between(2, 3)), ("outliers", ratio("n_far", "n_rows", 0.0) > 0.01),
               ("key_like", is_text & (ratio("n_distinct", "n_rows", 0.0) > 0.8))]
    text = F.concat_ws(",", *[F.when(cond, F.lit(name)) for name, cond in finding])
    return out.select("column_name", "n_rows", F.coalesce("n_null", F.lit(0)).alias("n_null"), "n_distinct", "n_far", text.alias("findings"))


def run_validations(df: DataFrame) -> DataFrame:
    """All seven checks, one row per check with its bad count; only the first two need a shuffle of rows."""
    single = count_report(df, [(f"{g}:{n}", c, cond) for g, checks in (
        ("temporal", temporal_checks(df)), ("range", range_checks(df)), ("business", business_checks(df)),
        ("leakage", leakage_checks(df))) for n, c, cond in checks])
    # many promotions, early censoring and negative durations are reported but do not fail the suite
    warn = F.col("check").isin("business:many_promotions", "leakage:negative_duration", "leakage:censored_before_end")
    single = single.select(F.substring_index("check", ":", 1).alias("check"), F.when(warn, 0).otherwise(F.col("n_bad")).alias("n_bad"))
    dist = validate_feature_distributions(df).select(
        F.lit("distribution").alias("check"), F.when(F.col("findings").rlike("mostly_null|constant"), 1).otherwise(0).cast("long").alias("n_bad"))
    parts = [duplicate_rows(df).select("check", "n_bad"), duplicate_persons(df).select("check", "n_bad"), single, dist]
    return reduce(DataFrame.unionByName, parts).groupBy("check").agg(F.sum("n_bad").alias("n_bad")).withColumn(
        "passed", F.col("n_bad") == 0)
