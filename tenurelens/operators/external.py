"""Features from reference data, and code normalisation."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurelens.functions.columns import ratio
from tenurelens.operators.history import enrich
from tenurelens.sources.keys import first_per_key, parse_composite_id
from tenurelens.sources.tables import or_constant

LOCATION = ["db_schema", "clnt_obj_id", "work_loc_cd"]
# fixed values: codes that survive normalisation or are dropped by it
NORMALIZE_RULES = {"reg_temp_cd": {"keep": ["T", "R"]}, "naics_cd": {"drop": ["null"]},
                   "full_tm_part_tm_cd": {"keep": ["F", "P"]}, "quarter_effect": {"keep": ["Q1", "Q2", "Q3", "Q4"]},
                   "fscl_actv_ind": {"keep": ["Y", "N"]}, "gender_cd": {"keep": ["F", "M"]}}


def salary_growth_to_cpi(df: DataFrame, locations: DataFrame, regions: DataFrame, cpi: DataFrame,
                         source: DataFrame | None = None) -> DataFrame:
    """Salary growth over the price growth of the region of the work location; 0 where unknown."""
    out = "salary_growth_rate12m_to_cpi_rate"

    def build(d):
        loc = locations.select(*LOCATION, F.upper("state_prov_nm").alias("_state"))
        reg = regions.select(F.upper("State").alias("_state"), "Region")
        price = cpi.select("Region", F.col("1_Jan_23").cast("double").alias("_early"), F.col("1_Jan_24").cast("double").alias("_late"))
        known = loc.join(reg, "_state", "left").join(price, "Region", "left").select(*LOCATION, "_early", "_late")
        j = enrich(d, known, LOCATION, source)
        rate = F.when(F.col("dataset_split").isin("train", "val"), F.col("_early")).otherwise(F.col("_late"))
        return j.withColumn(out, ratio("salary_growth_rate_12m", rate, 0.0)).drop("_early", "_late")

    gates = [(locations, LOCATION + ["state_prov_nm"]), (regions, ["State", "Region"]), (cpi, ["Region", "1_Jan_23", "1_Jan_24"])]
    return or_constant(df, gates, out, 0.0, build)


def normalized_flsa(df: DataFrame, mapping: DataFrame | None, source: DataFrame | None = None) -> DataFrame:
    """Client-specific status code to exempt / non-exempt / others."""
    out = "flsa_status_desc"

    def build(d):
        m = mapping.select("clnt_obj_id", "flsa_stus_cd", F.col("flsa_stus_cd_normalized").alias(out))
        j = enrich(d, m, ["clnt_obj_id", "flsa_stus_cd"], source)
        return j.withColumn(out, F.coalesce(out, F.lit("others")))

    return or_constant(df, [(mapping, ["clnt_obj_id", "flsa_stus_cd", "flsa_stus_cd_normalized"])], out, "others", build)


def neighborhood_salary_ratio(df: DataFrame, people: DataFrame, geocodes: DataFrame, income: DataFrame | None,
                              month="202301", source: DataFrame | None = None) -> DataFrame:
    """Baseline salary over the median income of the home census tract; 0 where unknown."""
    out = "sal_nghb_ratio"

    def build(d):
        geo = first_per_key(geocodes.where(F.col("yyyymm") == month).select(
            "employee_guid", "home_census_block_group", "home_congressional_district"), ["employee_guid"],
            "home_congressional_district")
        geo = geo.select("employee_guid", F.substring("home_census_block_group", 1, 11).alias("_tract"))
        inc = income.select(F.expr("substring(GEO_ID, -11, 11)").alias("_tract"),
                            F.col("S1903_C03_001E").try_cast("double").alias("median_household_income"))
        who = first_per_key(people.where(F.col("yyyymm") == month).select("ooid", "aoid", "employee_guid", "source_hr"),
                            ["aoid", "ooid"], "source_hr")
        known = who.join(geo, "employee_guid", "left").join(inc, "_tract", "left").select(
            F.col("ooid").alias("clnt_obj_id"), F.col("aoid").alias("employee_id"), "median_household_income")
        start = None if source is None else parse_composite_id(source)
        j = enrich(parse_composite_id(d), known, ["clnt_obj_id", "employee_id"], start)
        r = F.when(F.col("median_household_income") > 0, ratio("baseline_salary", "median_household_income"))
        return j.withColumn(out, F.coalesce(r, F.lit(0.0)))

    gates = [(people, ["ooid", "aoid", "employee_guid", "source_hr", "yyyymm"]),
             (geocodes, ["employee_guid", "yyyymm", "home_census_block_group", "home_congressional_district"]),
             (income, ["GEO_ID", "S1903_C03_001E"])]
    return or_constant(df, gates, out, 0.0, build)


def normalize(df: DataFrame, rules=None, suffix="_raw") -> DataFrame:
    """Replace codes outside the keep list, or on the drop list, by null; keep the raw column."""
    cols = {}
    for c, rule in (rules or NORMALIZE_RULES).items():
        if c not in df.columns:
            continue
        cols[c + suffix] = F.col(c)
        if rule.get("keep"):
            cols[c] = F.when(F.col(c).isin(rule["keep"]), F.col(c))
        if rule.get("drop"):
            cols[c] = F.when(~F.col(c).isin(rule["drop"]), F.col(c))
    return df.withColumns(cols)
