"""All features of the effective-dated history in one pass over it.

Records become one row per entity and day first, with the day's distinct values of every
column asked for.  On those rows one window carries the last value forward, for all columns at once,
and one aggregation folds an entity's days.  Days are pre-aggregated where they are read, so an
entity with very many records has no more rows to sort than the calendar has days.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenurelens.functions.columns import ladder, ratio
from tenurelens.schema import EFFECTIVE, ENTITY, VANTAGE
from tenurelens.sources.keys import NO_MANAGER

# fixed values: texts that stand for a missing place
NO_PLACE = ["UNKNOWN", "MISSING", "NULL"]
LOCATION = ["db_schema", "clnt_obj_id", "work_loc_cd"]
#: Columns that each part reads.
PARTS = {"pay": ["annl_cmpn_amt", "mnthly_cmpn_amt"], "frequency": ["hr_cmpn_freq_cd"], "level": ["mngr_lvl_cd"], "job": ["job_cd"],
         "manager": ["mngr_pers_obj_id"], "assignment": ["work_asgmnt_nbr"], "location": ["work_loc_cd"], "place": LOCATION}
#: Run columns (value changes along the days) of the parts.
RUNS = {"level": {"level": "mngr_lvl_cd"}, "location": {"location": "work_loc_cd"}, "place": {"city": "city_nm", "state": "state_prov_nm"}}
#: Columns whose present value and its first day are wanted.
CURRENT = {"job": ("job_cd", "tenure_in_current_role"), "manager": ("mngr_pers_obj_id", "time_with_current_manager")}


def _values(parts) -> dict[str, Column]:
    """What is collected of each day: its distinct values per column, nulls and stand-ins for missing places left out."""
    out = {}
    if "pay" in parts:
        out["pay"] = F.when(F.col("annl_cmpn_amt").isNotNull(), F.struct(F.col("annl_cmpn_amt").alias("annual"), F.col("mnthly_cmpn_amt").alias("monthly")))
    for part in parts:
        for name, c in RUNS.get(part, {}).items():
            out[name] = F.when(~F.upper(c).isin(NO_PLACE), F.col(c)) if part == "place" else F.col(c)
    for part, c in (("job", "job_cd"), ("manager", "mngr_pers_obj_id"), ("assignment", "work_asgmnt_nbr")):
        if part in parts:
            out[part] = F.col(c)
    return out


def days_of(history: DataFrame, parts, places: DataFrame | None = None) -> DataFrame:
    """One row per entity and day known at the vantage date: sets of values, and for ``frequency`` the codes of the last year with their records."""
    rows = history.where(F.col(EFFECTIVE) <= F.col(VANTAGE))
    if "place" in parts:
        rows = rows.join(places.select(*LOCATION, "city_nm", "state_prov_nm"), LOCATION, "left")
    values = _values(parts)
    sets = [F.collect_set(c).alias(n) for n, c in values.items()]
    if "frequency" not in parts:
        return rows.groupBy(*ENTITY, EFFECTIVE).agg(*sets)
    by_code = rows.groupBy(*ENTITY, EFFECTIVE, "hr_cmpn_freq_cd").agg(*sets, F.count(F.lit(1)).alias("records"))
    recent = F.col("hr_cmpn_freq_cd").isNotNull() & (F.col(EFFECTIVE) >= F.date_sub(VANTAGE, 365))
    code = F.when(recent, F.struct(F.col("hr_cmpn_freq_cd").alias("code"), F.col("records").cast("double").alias("n")))
    # an entity's days come together here; what follows needs no further shuffle
    return by_code.repartition(*ENTITY).groupBy(*ENTITY, EFFECTIVE).agg(
        *[F.array_distinct(F.flatten(F.collect_list(n))).alias(n) for n in values], F.collect_list(code).alias("codes"))


def history_summary(history: DataFrame, parts=tuple(PARTS), places: DataFrame | None = None) -> DataFrame:
    """One row per entity with the features of all ``parts`` (see PARTS; ``place`` needs ``places``); null where nothing is known.

    A change is a distinct value (in order of day, then value) that differs from the one before; nulls don't count.
    """
    parts = [p for p in parts if p != "place" or places is not None]
    day = days_of(history, parts, places)
    runs = [n for p in parts for n in RUNS.get(p, {})]
    before = W.partitionBy(*ENTITY).orderBy(EFFECTIVE).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*ENTITY)
    of = {n: F.col(n) for n in runs}
    if "pay" in parts:
        of["salary"] = F.array_distinct(F.transform("pay", lambda x: x["annual"]))
    day = day.withColumns({k: v for n, c in of.items() for k, v in ((f"{n}_low", F.array_min(c)), (f"{n}_high", F.array_max(c)), (f"{n}_n", F.size(c)))})
    carried = {f"{n}_prev": F.last(f"{n}_high", ignorenulls=True).over(before) for n in of}
    if "pay" in parts:
        day = day.withColumns({"pay_n": F.size("pay"), "pay_mean": F.try_divide(F.aggregate("pay", F.lit(0.0), lambda s, x: s + x["annual"]), F.size("pay"))})
        carried["pay_all"] = F.try_divide(F.sum(F.col("pay_n") * F.col("pay_mean")).over(whole), F.sum("pay_n").over(whole))
    for p in (p for p in CURRENT if p in parts):
        carried[f"{p}_now"] = F.max(F.when(F.size(p) > 0, F.struct(EFFECTIVE, F.array_max(p).alias("value")))).over(whole)["value"]
    return _folded(day.withColumns(carried), parts)


def _folded(day: DataFrame, parts) -> DataFrame:
    """The aggregation of an entity's days."""
    agg, out = {}, {}
    # distinct values of a day follow each other in order, so all but the first are changes (and rises) of that day
    starts = lambda n: F.col(f"{n}_prev").isNull() | (F.col(f"{n}_low") != F.col(f"{n}_prev"))
    some = lambda n: F.col(f"{n}_n") > 0
    if "pay" in parts:
        known, changed = some("salary"), (F.col("salary_n") > 1) | starts("salary")
        raised = (F.col("salary_n") > 1) | (F.col("salary_low") > F.col("salary_prev"))
        ago = F.when(F.col(EFFECTIVE) <= F.date_sub(VANTAGE, 365), F.col(EFFECTIVE))
        monthly = F.transform("pay", lambda x: x["monthly"])
        quarter = F.when(F.col(EFFECTIVE) >= F.date_sub(VANTAGE, 90), F.filter(monthly, lambda x: x.isNotNull()))
        spread = F.aggregate("pay", F.lit(0.0), lambda s, x: s + (x["annual"] - F.col("pay_mean")) * (x["annual"] - F.col("pay_mean")))
        agg |= {"_now": F.max_by("salary_high", F.when(known, F.col(EFFECTIVE))), "_ago": F.max_by("salary_high", F.when(known, ago)),
                "_changes": F.sum(F.when(known, F.col("salary_n") - F.when(starts("salary"), 0).otherwise(1))),
                "_last_change": F.max(F.when(known & changed, F.col(EFFECTIVE))), "_first_change": F.min(F.when(known & changed, F.col(EFFECTIVE))),
                "_last_raise": F.max(F.when(known & raised, F.col(EFFECTIVE))), "_pays": F.sum("pay_n"),
                "_squares": F.sum(F.when(known, spread + F.col("pay_n") * (F.col("pay_mean") - F.col("pay_all")) * (F.col("pay_mean") - F.col("pay_all")))),
                "_quarter": F.sum(F.aggregate(quarter, F.lit(0.0), lambda s, x: s + x)), "_quarter_n": F.sum(F.size(quarter))}
        there, span, extra = F.col("_pays") > 0, F.datediff("_last_change", "_first_change"), (F.col("_changes") - 1).cast("double")
        out |= {"salary_0d_ago": F.col("_now"), "salary_365d_ago": F.col("_ago"),
                "salary_growth_rate_12m": F.when(there, ratio(F.col("_now") - F.col("_ago"), "_ago", 0.0)),
                "comp_chang_freq_per_year": F.when(span > 365, extra * 365.0 / F.greatest(span, F.lit(1))).otherwise(extra),
                "compensation_volatility": F.when(there, F.coalesce(F.sqrt(F.try_divide(F.col("_squares"), F.col("_pays") - 1)), F.lit(0.0))),
                "avg_salary_last_quarter": F.try_divide(F.col("_quarter"), F.greatest("_quarter_n", F.lit(0))),
                "pay_grade_stagnation_months": F.when(there, F.coalesce(F.months_between(VANTAGE, "_last_raise"), F.lit(0.0)))}
    if "frequency" in parts:
        agg["_codes"] = F.flatten(F.collect_list("codes"))
        names = F.array_distinct(F.transform("_codes", lambda x: x["code"]))
        total = lambda c: F.aggregate(F.filter("_codes", lambda x: x["code"] == c), F.lit(0.0), lambda s, x: s + x["n"])
        per_code = F.transform(names, total)
        squares, n = F.aggregate(per_code, F.lit(0.0), lambda s, x: s + x * x), F.aggregate(per_code, F.lit(0.0), lambda s, x: s + x)
        # fixed values: bands of the diversity score
        bands = [(0.2, 1.0), (0.5, 0.7), (0.8, 0.4)]
        out["pay_freq_diversity_score"] = 1.0 - F.try_divide(squares, n * n)
        out["pay_freq_consistency_score"] = F.when(F.size("_codes") > 0, ladder(1.0 - F.try_divide(squares, n * n), bands, 0.1, "<="))
    if "level" in parts:
        rises = F.when(some("level"), F.col("level_n") - 1 + F.when(F.col("level_low") > F.col("level_prev"), 1).otherwise(0))
        agg |= {"_rises": F.sum(rises), "_last_rise": F.max(F.when(rises > 0, F.col(EFFECTIVE))), "_first_rise": F.min(F.when(rises > 0, F.col(EFFECTIVE)))}
        span, rose = F.datediff("_last_rise", "_first_rise"), F.when(F.col("_rises") > 0, F.col("_rises"))
        out |= {"n_promotions": rose, "time_since_last_promotion": F.datediff(VANTAGE, "_last_rise"),
                "promotion_velocity": F.when(rose.isNotNull(), ratio(span, rose - 1, 0.0)), "promotions_per_year": F.when(rose.isNotNull(), ratio(rose, span / 365.25, 0.0))}
    for p in (p for p in CURRENT if p in parts):
        agg[f"_{p}_since"] = F.min(F.when(F.array_contains(p, F.col(f"{p}_now")), F.col(EFFECTIVE)))
        out[CURRENT[p][1]] = F.datediff(VANTAGE, f"_{p}_since")
    if "manager" in parts:
        agg["_managers"] = F.array_distinct(F.flatten(F.collect_list(F.filter("manager", lambda x: ~x.isin(NO_MANAGER)))))
        out["manager_changes_count"] = F.size("_managers").cast("long")
    if "assignment" in parts:
        agg["_assignments"] = F.array_distinct(F.flatten(F.collect_list(F.when(F.col(EFFECTIVE) >= F.date_sub(VANTAGE, 365), F.col("assignment")))))
        out["assignment_frequency_12m"] = F.size("_assignments").cast("long")
    for name, c in (("location", "work_location_changes_count"), ("city", "num_city_chng"), ("state", "num_state_chng")):
        if f"{name}_n" in day.columns:
            moved = F.col(f"{name}_n") - 1 + F.when(F.col(f"{name}_low") != F.col(f"{name}_prev"), 1).otherwise(0)
            agg[c] = F.sum(F.when(some(name), moved).otherwise(0))
            out[c] = F.col(c)
    return day.groupBy(*ENTITY).agg(*[v.alias(k) for k, v in agg.items()]).select(*ENTITY, *[v.alias(k) for k, v in out.items()])
