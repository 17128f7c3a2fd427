"""Features from the snapshot itself: demographics, job, manager, team, company, calendar."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurelens.functions.columns import flag, ladder, ratio
from tenurelens.operators.history import attach, enrich
from tenurelens.operators.run_summary import history_summary
from tenurelens.schema import ENTITY, PERSON, VANTAGE
from tenurelens.sources.keys import parse_composite_id


def add_demographic_features(df: DataFrame) -> DataFrame:
    """Age, career stage, cohort and tenure relations; one projection."""
    age = F.months_between(F.to_date(VANTAGE), "birth_dt") / 12
    years = F.col("tenure_at_vantage_days") / 365.25
    work = F.when(age.isNotNull(), F.greatest(F.lit(0.0), age - 25)).otherwise(0.0)
    cohort = [(1997, "Gen Z"), (1981, "Millennial"), (1965, "Gen X"), (1946, "Baby Boomer")]
    return df.select(
        "*", age.alias("age_at_vantage"),
        ladder(age, [(30, "Early"), (45, "Mid"), (60, "Late")], "Senior").alias("career_stage"),
        F.when(age.isNotNull(), F.greatest(F.lit(0.0), 65 - age)).alias("retirement_eligibility_years"),
        F.year("birth_dt").alias("birth_year"),
        ladder(F.year("birth_dt"), cohort, "Silent Generation", ">=").alias("generation_cohort"),
        years.alias("tenure_at_vantage_years"),
        F.when(age > 0, years / age).otherwise(0.0).alias("tenure_age_ratio"),
        work.alias("working_age"),
        F.when((work <= 5) & (years <= 2), "early_career")
         .when((work > 5) & (work <= 15) & (years <= 5), "mid_career_joiner")
         .when((work > 15) & (years <= 5), "late_career_joiner")
         .when(years > 5, "experienced_loyal").otherwise("other").alias("career_joiner_stage"),
        F.when((age <= 30) & (years >= 5), "burnout_risk")
         .when((age >= 50) & (years <= 2), "retirement_on_disengagement_risk").otherwise("normal").alias("tenure_age_risk"))


def job_characteristics(df: DataFrame) -> DataFrame:
    """Job level, complexity from the level (text levels count as low), stability."""
    level = F.col("mngr_lvl_cd").try_cast("int")
    stable = (F.col("full_tm_part_tm_cd") == "F") & (F.col("reg_temp_cd") == "R") & F.col("flsa_stus_cd").isin("E", "N")
    return df.withColumns({
        "job_level": F.col("mngr_lvl_cd"),
        "role_complexity_score": ladder(level, [(5, 3), (3, 2)], 1, ">="),
        "job_stability_ind": F.when(stable, 1.0).when(F.col("reg_temp_cd") == "T", 0.0).otherwise(0.5)})


def group_turnover(df: DataFrame, leavers: DataFrame, group: str, date: str, out: str, days=730) -> DataFrame:
    """Leavers of the last ``days`` over leavers plus active people, per group and vantage date."""
    key = [group, VANTAGE]
    gone = leavers.where(F.col(date).between(F.date_sub(VANTAGE, days), F.col(VANTAGE))).groupBy(*key).agg(
        F.count_distinct(PERSON).alias("_gone"))
    here = df.groupBy(*key).agg(F.count_distinct(PERSON).alias("_here"))
    left = F.coalesce("_gone", F.lit(0))
    return here.join(gone, key, "left").select(*key, ratio(left, left + F.col("_here")).alias(out))


def add_job_characteristics_features(df: DataFrame, leavers: DataFrame, source: DataFrame | None = None) -> DataFrame:
    rate = group_turnover(df if source is None else source, leavers, "job_cd", "termination_date", "job_family_turnover_rate")
    return enrich(job_characteristics(df), rate, ["job_cd", VANTAGE], source)


MANAGER_KEY = ["mgr_sup_id", "clnt_obj_id", "db_schema", VANTAGE]


def manager_tenure(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Tenure of each person's manager, found by the manager's own row (keys parsed from the id)."""
    people = parse_composite_id(df)
    rows = people if source is None else parse_composite_id(source)
    own = rows.groupBy(F.col("employee_id").alias("mgr_sup_id"), *MANAGER_KEY[1:]).agg(
        F.max("tenure_at_vantage_days").alias("manager_tenure_days"))
    return enrich(people, own, MANAGER_KEY, None if source is None else rows)


def manager_span(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Distinct reports per manager, joined back to each report."""
    span = (df if source is None else source).groupBy(*MANAGER_KEY).agg(F.count_distinct(PERSON).alias("manager_span_control"))
    return enrich(df, span, MANAGER_KEY, source)


def manager_indicator(df: DataFrame, snapshots: DataFrame, missing=None, source: DataFrame | None = None) -> DataFrame:
    """``is_manager_ind`` from yearly snapshots keyed by (ooid, aoid, vantage date)."""
    s = snapshots.select(F.col("ooid").alias("clnt_obj_id"), F.col("aoid").alias("prsn_obj_id"), VANTAGE,
                         F.col("is_manager_").alias("is_manager_ind"))
    out = enrich(df, s, ["clnt_obj_id", "prsn_obj_id", VANTAGE], source)
    return out if missing is None else out.withColumn("is_manager_ind", F.coalesce("is_manager_ind", F.lit(missing)))


def add_manager_environment_features(df: DataFrame, history: DataFrame | None, snapshots: DataFrame | None = None,
                                     source: DataFrame | None = None) -> DataFrame:
    """Managers so far, tenure and span of the present one; ``history`` None: what comes from it is in ``df`` already."""
    out = df if history is None else attach(df, history_summary(history, ["manager"]))
    out = out.withColumn("manager_changes_count", F.coalesce("manager_changes_count", F.lit(0)))
    out = manager_span(manager_tenure(out, source), source)
    if snapshots is None:
        return out.withColumn("is_manager_ind", F.lit(None).cast("int"))
    return manager_indicator(out, snapshots, source=source)


def peer_salary_ratio(df: DataFrame) -> DataFrame:
    r = F.when(F.col("team_avg_comp") > 0, ratio("baseline_salary", "team_avg_comp")).otherwise(1.0)
    return df.withColumn("peer_salary_ratio", r)


def add_team_environment_features(df: DataFrame, leavers: DataFrame, source: DataFrame | None = None) -> DataFrame:
    rate = group_turnover(df if source is None else source, leavers, "mngr_pers_obj_id", "latest_termination_date",
                          "team_turnover_rate")
    return enrich(peer_salary_ratio(df), rate, ["mngr_pers_obj_id", VANTAGE], source)


def add_company_factors_features(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Size tier by headcount of client and vantage date; the layoff flag is a constant placeholder."""
    key = ["clnt_obj_id", VANTAGE]
    tier = (df if source is None else source).groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).select(
        *key, ladder("_n", [(100, "Small"), (1000, "Medium"), (10000, "Large")], "Enterprise").alias("company_size_tier"))
    out = enrich(df, tier, key, source)
    return out.withColumns({"company_size_tier": F.coalesce("company_size_tier", F.lit("Unknown")),
                            "company_layoff_indicator": F.lit(0)})


def add_temporal_features(df: DataFrame) -> DataFrame:
    """Hire month, season, fiscal year end and fiscal quarter (USA from October, CAN from April)."""
    hire, country = F.col("ltst_hire_dt"), F.col("work_loc_cntry_cd")
    month = F.month(hire)
    season = F.when(month.isin(12, 1, 2), "Winter").when(month.isin(3, 4, 5), "Spring").when(
        month.isin(6, 7, 8), "Summer").otherwise("Fall")

    def fiscal(start):
        return F.year(hire) + flag(month >= start)

    year = F.when(country == "USA", fiscal(10)).when(country == "CAN", fiscal(4))
    end = F.when(country == "USA", F.make_date(year, F.lit(9), F.lit(30))).when(
        country == "CAN", F.make_date(year, F.lit(3), F.lit(31)))
    # months since the fiscal year began, in blocks of three
    since = F.when(country == "USA", (month + 2) % 12).when(country == "CAN", (month + 8) % 12)
    quarter = F.concat(F.lit("Q"), (F.floor(since / 3) + 1).cast("string"))
    return df.withColumns({"hire_month": month, "hire_quarter": F.quarter(hire), "hire_date_seasonality": season,
                           "fiscal_year": year, "fiscal_date": end, "fiscal_year_effect": F.datediff(end, hire),
                           "quarter_effect": quarter})
