"""Features from effective-dated history, never looking past the vantage date."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenurelens.functions.scale import by_shuffle, percent_rank_by, previous_value
from tenurelens.operators.run_summary import history_summary
from tenurelens.schema import EFFECTIVE, ENTITY, VANTAGE
from tenurelens.sources.keys import NO_MANAGER


def point_in_time(df: DataFrame, date=EFFECTIVE, closed=True) -> DataFrame:
    """Rows known at the vantage date (``closed``: on the day itself too)."""
    known = F.col(date) <= F.col(VANTAGE) if closed else F.col(date) < F.col(VANTAGE)
    return df.where(known)


def attach(df: DataFrame, features: DataFrame, fills=None, on=ENTITY) -> DataFrame:
    """Left join features to the entity table and fill the gaps."""
    out = df.join(by_shuffle(features), list(on), "left")
    if not fills:
        return out
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})


def enrich(df: DataFrame, right: DataFrame, on, source: DataFrame | None = None) -> DataFrame:
    """Left join a table keyed by ``on``.

    With ``source`` (the entity table a chain of steps started from) only its key
    columns are shuffled to the lookup; the wide table is then joined on the
    entity key, the partitioning it already has.  It also keeps the plan of a
    long chain linear in the number of steps.
    """
    on = list(on)
    if source is None:
        return df.join(right, on, "left")
    narrow = source.select(*dict.fromkeys([*ENTITY, *on])).join(right, on, "left")
    return df.join(by_shuffle(narrow.drop(*[c for c in on if c not in ENTITY])), ENTITY, "left")


def as_of(value: str, date=EFFECTIVE, not_after: Column | None = None) -> Column:
    """Aggregate: latest ``value`` dated at or before a day (largest value on equal days)."""
    order = F.struct(date, value)
    if not_after is not None:
        order = F.when(F.col(date) <= not_after, order)
    return F.max_by(value, order)


def salary_history(history: DataFrame) -> DataFrame:
    """Distinct known salary records with the preceding salary."""
    keys = [*ENTITY, EFFECTIVE, "annl_cmpn_amt", "mnthly_cmpn_amt"]
    rows = point_in_time(history).where(F.col("annl_cmpn_amt").isNotNull()).select(*keys).distinct()
    return previous_value(rows, ENTITY, EFFECTIVE, "annl_cmpn_amt", out="prev_salary")


def salary_as_of(history: DataFrame, days=(0, 365)) -> DataFrame:
    """Salary at the vantage date and ``days`` before it."""
    rows = point_in_time(history).where(F.col("annl_cmpn_amt").isNotNull())
    return rows.groupBy(*ENTITY).agg(
        *[as_of("annl_cmpn_amt", not_after=F.date_sub(VANTAGE, d)).alias(f"salary_{d}d_ago") for d in days])


def change_points(history: DataFrame, value: str) -> DataFrame:
    """Known records where ``value`` differs from the preceding one, or comes first."""
    rows = point_in_time(history).where(F.col(value).isNotNull()).select(*ENTITY, EFFECTIVE, value).distinct()
    prev = previous_value(rows, ENTITY, EFFECTIVE, value)
    return prev.where(F.col("prev_value").isNull() | (F.col(value) != F.col("prev_value")))


PAY = ["salary_growth_rate_12m", "comp_chang_freq_per_year", "compensation_volatility", "avg_salary_last_quarter", "pay_grade_stagnation_months"]


def compensation_aggregates(history: DataFrame) -> DataFrame:
    """Growth, change frequency, volatility, last-quarter pay and stagnation of everyone with a known salary."""
    return history_summary(history, ["pay"]).where(F.col("salary_0d_ago").isNotNull()).select(*ENTITY, *PAY)


def pay_frequency_consistency(history: DataFrame) -> DataFrame:
    """Gini impurity of the pay-frequency codes of the last year, and its band."""
    return history_summary(history, ["frequency"]).where(F.col("pay_freq_diversity_score").isNotNull())


def pay_percentiles(df: DataFrame) -> DataFrame:
    """Rank of the baseline salary within company and within industry; nulls are not ranked."""
    out = percent_rank_by(df, ["clnt_obj_id", VANTAGE], "baseline_salary", "compensation_percentile_company")
    out = percent_rank_by(out, ["naics_cd", VANTAGE], "baseline_salary", "compensation_percentile_industry")
    return out.withColumn("compensation_percentile_industry",
                          F.when(F.col("naics_cd").isNotNull(), F.col("compensation_percentile_industry")))


def add_pay_percentiles(df: DataFrame, source: DataFrame) -> DataFrame:
    narrow = pay_percentiles(source.select(*ENTITY, "clnt_obj_id", "naics_cd", "baseline_salary"))
    return attach(df, narrow.drop("clnt_obj_id", "naics_cd", "baseline_salary"))


def add_compensation_features(df: DataFrame, history: DataFrame | None, source: DataFrame | None = None) -> DataFrame:
    """Pay percentiles and the pay features of the history; ``history`` None: they are in ``df`` already."""
    fills = {"salary_growth_rate_12m": 0.0, "compensation_volatility": 0.0, "pay_grade_stagnation_months": 0.0}
    out = pay_percentiles(df) if source is None else add_pay_percentiles(df, source)
    if history is not None:
        out = attach(out, history_summary(history, ["pay", "frequency"]).select(*ENTITY, *PAY, "pay_freq_consistency_score"))
    out = out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fills.items()})
    return pay_frequency_preference(out)


def pay_frequency_preference(df: DataFrame) -> DataFrame:
    """Hourly 1, salaried 2, other 0; total growth repeats the salary growth where present."""
    pref = F.when(F.col("pay_rt_type_cd") == "H", 1).when(F.col("pay_rt_type_cd") == "S", 2).otherwise(0)
    out = df.withColumn("pay_frequency_preference", pref)
    if "salary_growth_rate_12m" in df.columns:
        out = out.withColumn("total_compensation_growth", F.col("salary_growth_rate_12m"))
    return out


def level_promotions(history: DataFrame) -> DataFrame:
    """Promotions read from history: the manager level rises against the preceding record."""
    rows = point_in_time(history).where(F.col("mngr_lvl_cd").isNotNull()).select(*ENTITY, EFFECTIVE, "mngr_lvl_cd").distinct()
    prev = previous_value(rows, ENTITY, EFFECTIVE, "mngr_lvl_cd", out="prev_level")
    return prev.where(F.col("mngr_lvl_cd") > F.col("prev_level")).select(*ENTITY, F.col(EFFECTIVE).alias("event_eff_dt"))


def level_promotion_features(history: DataFrame) -> DataFrame:
    """Days since the last rise, mean gap between rises, and rises per year between first and last."""
    return history_summary(history, ["level"]).where(F.col("n_promotions").isNotNull())


def time_in_current(history: DataFrame, value: str, out: str) -> DataFrame:
    """Days since the earliest record that carries the latest known ``value``."""
    rows = point_in_time(history).where(F.col(value).isNotNull())
    per = rows.groupBy(*ENTITY, value).agg(F.min(EFFECTIVE).alias("_since"), F.max(EFFECTIVE).alias("_latest"))
    now = per.groupBy(*ENTITY).agg(F.max_by("_since", F.struct("_latest", value)).alias("_since"))
    return now.select(*ENTITY, F.datediff(VANTAGE, "_since").alias(out))


def manager_changes(history: DataFrame, bounded=True, out="manager_changes_count") -> DataFrame:
    """Distinct real managers, up to the vantage date or (first version) over all records."""
    rows = point_in_time(history) if bounded else history
    return rows.where(~F.col("mngr_pers_obj_id").isin(NO_MANAGER)).groupBy(*ENTITY).agg(
        F.count_distinct("mngr_pers_obj_id").alias(out))


def assignment_frequency(history: DataFrame) -> DataFrame:
    recent = point_in_time(history).where(F.col(EFFECTIVE) >= F.date_sub(VANTAGE, 365))
    return recent.groupBy(*ENTITY).agg(F.count_distinct("work_asgmnt_nbr").alias("assignment_frequency_12m"))


def add_work_patterns_features(df: DataFrame, history: DataFrame | None, places: DataFrame | None = None) -> DataFrame:
    """Assignments of the last year and changes of location, city and state; ``history`` None: they are in ``df`` already."""
    counts = ["assignment_frequency_12m", "work_location_changes_count", "num_city_chng", "num_state_chng"]
    out = df if history is None else attach(df, history_summary(history, ["assignment", "location", "place"], places))
    optional = [c for c in counts[2:] if c not in out.columns]
    return out.withColumns({c: F.lit(0) if c in optional else F.coalesce(c, F.lit(0)) for c in counts})


def add_tenure_dynamics_features(df: DataFrame, history: DataFrame | None, source: DataFrame | None = None) -> DataFrame:
    """Tenure in the present role and tenure percentile; ``history`` None: the former is in ``df`` already."""
    role = "tenure_in_current_role"
    out = df.withColumn(role, F.coalesce(role, F.lit(0))) if history is None else attach(df, time_in_current(history, "job_cd", role), {role: 0})
    return tenure_percentile(out) if source is None else attach(out, tenure_percentile_features(source))


def tenure_percentile_features(source: DataFrame, industry=False) -> DataFrame:
    keep = ["clnt_obj_id", "naics_cd", "tenure_at_vantage_days"]
    return tenure_percentile(source.select(*ENTITY, *keep), industry).drop(*keep)


def tenure_percentile(df: DataFrame, industry=False) -> DataFrame:
    """Company tenure percentile on 1..100 (null tenure 0); industry rank on 0..1 on request."""
    out = percent_rank_by(df, ["clnt_obj_id", VANTAGE], "tenure_at_vantage_days", "_pr")
    out = out.withColumn("company_tenure_percentile", F.coalesce(F.col("_pr") * 99 + 1, F.lit(0.0))).drop("_pr")
    if industry:
        out = percent_rank_by(out, ["naics_cd", VANTAGE], "tenure_at_vantage_days", "industry_tenure_percentile")
    return out
