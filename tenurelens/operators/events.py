"""Features from career events: windows, reason codes, gaps and rates."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurelens.functions.columns import flag, ratio, same_text
from tenurelens.operators.history import attach
from tenurelens.schema import ENTITY, PERSON, VANTAGE

# fixed values: event codes and the reason codes of each reading
PROMOTION, DEMOTION, TRANSFER = "PRO", "DEM", "XFR"
JOB_CHANGE = ["JTC", "PJC", "POS", "JRC"]
PERFORMANCE = ["OPR", "OUTSTANDING PERFORMANCE", "PTP", "OP", "PER"]
TITLE_CHANGE = ["JOB", "TC", "T", "PRO", "M28", "TCH", "TTL", "PTC", "PNP", "JTC", "OFC"]
MARKET_ADJUSTMENT = ["MKT", "MRK", "MKA"]
COMPANY_REORG = ["RES", "REO", "MOR", "TRP", "ORG", "MPC", "ROS"]
PERFORMANCE_ISSUES = ["USP", "UNSATISFACTORY PERFORMANCE", "PER", "DEMOTE - PERFORMANCE", "PERFORMANCE", "UNS",
                      "DEMOTE PERFORMANCE", "UNSATISFACTORY PERFORMANCE - USP", "301", "USJ", "UP",
                      "PERFORMANCE-DRIVEN", "DUP", "PEF", "TPR", "S07", "PNU"]
EMPLOYEE_REQUEST = ["EER", "EMPLOYEE REQUEST", "ER2", "ER1", "EE"]
SKILL_BASED = "TRANSFER - SKILL-BASED"
RELOCATION = ["RELOCATION", "REL"]
ASSIGNMENT = ["TMP", "EXPATRIATE ASSIGNMENT", "ASC", "EXP", "1", "SAB", "SPA", "IPA"]
FULL_TO_PART = ["FTPT", "FT2PT"]
NONEXEMPT_TO_EXEMPT = ["NEX", "NXX"]
NEVER = 9999


def entity_events(df: DataFrame, events: DataFrame, closed=True) -> DataFrame:
    """Events of each entity known at its vantage date."""
    ev = events.select(PERSON, "event_cd", "event_rsn_cd", "event_eff_dt")
    known = F.col("event_eff_dt") <= F.col(VANTAGE) if closed else F.col("event_eff_dt") < F.col(VANTAGE)
    return df.select(*ENTITY).join(ev, PERSON).where(known)


def is_code(code: str):
    return F.upper("event_cd") == code


def within(days: int | None = None, months: int | None = None):
    """Event not older than a number of days or of calendar months."""
    start = F.date_sub(VANTAGE, days) if days is not None else F.add_months(VANTAGE, -months)
    return F.col("event_eff_dt") >= start


def last_and_gap(when, last: str, gap: str):
    """Aggregates: days since the latest matching event, mean days between matching events.

    The gaps of consecutive dates add up to last minus first, so no ordering is needed.
    """
    day = F.when(when, F.col("event_eff_dt"))
    n = F.count(day)
    return [F.datediff(F.first(VANTAGE), F.max(day)).alias(last),
            F.try_divide(F.datediff(F.max(day), F.min(day)).cast("double"), (n - 1).cast("double")).alias(gap)]


def promotion_history(df: DataFrame, events: DataFrame) -> DataFrame:
    """Days since the last promotion (9999 if none) and mean gap (0 if none) over all known events."""
    agg = entity_events(df, events).where(is_code(PROMOTION)).groupBy(*ENTITY).agg(
        *last_and_gap(F.lit(True), "time_since_last_promotion", "promotion_velocity"))
    return attach(df, agg, {"time_since_last_promotion": NEVER, "promotion_velocity": 0.0})


PROMOTION_FILLS = {"promot_2yr_ind": 0, "demot_2yr_ind": 0, "transfer_2yr_ind": 0, "num_promot_2yr": 0,
                   "num_demot_2yr": 0, "num_transfer_2yr": 0, "promot_2yr_perf_ind": 0, "promot_2yr_titlechng_ind": 0,
                   "promot_2yr_mktadjst_ind": 0, "demot_2yr_compreorg_ind": 0, "demot_2yr_perfissue_ind": 0,
                   "promot_veloc": 0.0, "days_since_promot": NEVER, "days_since_transfer": NEVER}


def promotion_event_aggregates(days=730):
    """Aggregates over ``entity_events`` for promotions, demotions and transfers of two years."""
    window = within(days=days)
    pro, dem, xfr = [is_code(c) & window for c in (PROMOTION, DEMOTION, TRANSFER)]
    any_ = lambda cond: F.max(flag(cond))
    n = lambda cond: F.sum(flag(cond))
    rsn = lambda codes: same_text("event_rsn_cd", codes)
    return [any_(pro).alias("promot_2yr_ind"), any_(dem).alias("demot_2yr_ind"), any_(xfr).alias("transfer_2yr_ind"),
            n(pro).alias("num_promot_2yr"), n(dem).alias("num_demot_2yr"), n(xfr).alias("num_transfer_2yr"),
            any_(pro & rsn(PERFORMANCE)).alias("promot_2yr_perf_ind"),
            any_(pro & rsn(TITLE_CHANGE)).alias("promot_2yr_titlechng_ind"),
            any_(pro & rsn(MARKET_ADJUSTMENT)).alias("promot_2yr_mktadjst_ind"),
            any_(dem & rsn(COMPANY_REORG)).alias("demot_2yr_compreorg_ind"),
            any_(dem & rsn(PERFORMANCE_ISSUES)).alias("demot_2yr_perfissue_ind"),
            *last_and_gap(pro, "days_since_promot", "promot_veloc"),
            last_and_gap(xfr, "days_since_transfer", "_gap")[0]]


JOB_FILLS = {"job_chng_2yr_ind": 0, "num_job_chng_2yr": 0, "job_chng_fulltopart_ind": 0, "job_chng_nexmptoexmp_ind": 0}


def job_change_aggregates(mode="days"):
    """Job-change indicators: ``days`` counts rows of 730 days, ``months`` distinct dates of 24 months."""
    job = same_text("event_cd", JOB_CHANGE) & (within(days=730) if mode == "days" else within(months=24))
    number = F.sum(flag(job)) if mode == "days" else F.count_distinct(F.when(job, F.col("event_eff_dt")))
    rsn = lambda codes: F.max(flag(job & same_text("event_rsn_cd", codes)))
    return [F.max(flag(job)).alias("job_chng_2yr_ind"), number.alias("num_job_chng_2yr"),
            rsn(FULL_TO_PART).alias("job_chng_fulltopart_ind"), rsn(NONEXEMPT_TO_EXEMPT).alias("job_chng_nexmptoexmp_ind")]


def add_promotion_event_features(df: DataFrame, events: DataFrame, source: DataFrame | None = None) -> DataFrame:
    agg = entity_events(df if source is None else source, events).groupBy(*ENTITY).agg(*promotion_event_aggregates())
    return attach(df, agg, PROMOTION_FILLS)


def add_job_change_event_features(df: DataFrame, events: DataFrame, mode="days",
                                  source: DataFrame | None = None) -> DataFrame:
    agg = entity_events(df if source is None else source, events).groupBy(*ENTITY).agg(*job_change_aggregates(mode))
    return attach(df, agg, JOB_FILLS)


def add_event_features(df: DataFrame, events: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Career, promotion and job-change features in one join and one aggregation."""
    career = last_and_gap(is_code(PROMOTION), "time_since_last_promotion", "promotion_velocity")
    people = df if source is None else source
    agg = entity_events(people, events).groupBy(*ENTITY).agg(*career, *promotion_event_aggregates(), *job_change_aggregates())
    return attach(df, agg, {"time_since_last_promotion": NEVER, "promotion_velocity": 0.0, **PROMOTION_FILLS, **JOB_FILLS})


def event_counts_24_months(df: DataFrame, events: DataFrame) -> DataFrame:
    """First version: promotions and demotions of the last 24 calendar months, people with events only."""
    pro, dem = [is_code(c) & within(months=24) for c in (PROMOTION, DEMOTION)]
    return entity_events(df, events).groupBy(*ENTITY).agg(
        F.max(flag(pro)).alias("promot_2yr_ind"), F.max(flag(dem)).alias("demot_2yr_ind"),
        F.sum(flag(pro)).alias("num_promot_2yr"), F.sum(flag(dem)).alias("num_demot_2yr"))


def reason_indicators(df: DataFrame, events: DataFrame) -> DataFrame:
    """First version: reason flags before the vantage date (strictly), transfers with five readings.

    Reason flags look at all earlier events, except demotions and the transfer
    totals, which look back 730 days.
    """
    rsn, recent = (lambda codes: same_text("event_rsn_cd", codes)), within(days=730)
    pro, dem, xfr = [is_code(c) for c in (PROMOTION, DEMOTION, TRANSFER)]
    any_ = lambda cond: F.max(flag(cond))
    return entity_events(df, events, closed=False).groupBy(*ENTITY).agg(
        any_(pro & rsn(PERFORMANCE)).alias("promot_2yr_perf_ind"),
        any_(pro & rsn(TITLE_CHANGE)).alias("promot_2yr_titlechng_ind"),
        any_(pro & rsn(MARKET_ADJUSTMENT)).alias("promot_2yr_mktadjst_ind"),
        any_(dem & rsn(COMPANY_REORG) & recent).alias("demot_2yr_compreorg_ind"),
        any_(dem & rsn(PERFORMANCE_ISSUES) & recent).alias("demot_2yr_perfissue_ind"),
        any_(xfr & recent).alias("transfer_2yr_ind"), F.sum(flag(xfr & recent)).alias("num_transfer_2yr"),
        any_(xfr & rsn(COMPANY_REORG)).alias("transfer_2yr_reorg_ind"),
        any_(xfr & rsn(EMPLOYEE_REQUEST)).alias("transfer_2yr_req_ind"),
        any_(xfr & F.upper("event_rsn_cd").contains(SKILL_BASED)).alias("transfer_2yr_skill_ind"),
        any_(xfr & rsn(RELOCATION)).alias("transfer_2yr_reloc_ind"),
        any_(xfr & rsn(ASSIGNMENT)).alias("transfer_2yr_asgnmt_ind"),
        last_and_gap(xfr, "days_since_transfer", "_gap")[0])


def promotion_time_features(df: DataFrame, events: DataFrame) -> DataFrame:
    """First version: mean gap, promotions per day between first and last, days since the last one."""
    day = F.col("event_eff_dt")
    agg = entity_events(df, events, closed=False).where(is_code(PROMOTION)).groupBy(*ENTITY).agg(
        *last_and_gap(F.lit(True), "days_since_promot", "promot_veloc"),
        ratio(F.count(F.lit(1)), F.datediff(F.max(day), F.min(day)), 0.0).alias("promot_rt"))
    out = attach(df.select(*ENTITY).distinct(), agg, {"promot_veloc": 0.0, "promot_rt": 0.0, "days_since_promot": 0})
    return out.withColumn("promot_veloc", F.when(
        (F.col("promot_rt") == 1) & (F.col("promot_veloc") == 0), None).otherwise(F.col("promot_veloc")))
