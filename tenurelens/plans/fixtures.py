"""Workforce views over the commerce test tables, in Spark and in SQL.

``customer`` plays the employee, ``orders`` the effective-dated history and
``lineitem`` the career events; see FIXTURES.md.  Each view exists twice: as a
DataFrame builder and as SQL text for the oracle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenurelens.sources.shared import materialize
from tenurelens.sources.tables import read_table
from tenurelens.schema import ENTITY, PERSON

VANTAGES = ["1998-01-01", "2000-01-01"]


def _with_vantage(df: DataFrame) -> DataFrame:
    return df.withColumn("vantage_date", F.explode(F.array(*[F.lit(v).cast("date") for v in VANTAGES])))


def dealt(df: DataFrame, key: str, rows: int = 20_000) -> DataFrame:
    """A table dealt by its key in parts of about ``rows`` rows: a file of few row groups is read by few tasks, whatever its size,
    and all that follows would be theirs.  A table of one part stays as it is."""
    n = -(-df.count() // rows)
    return df.repartition(n, key) if n > 1 else df


def base(spark: SparkSession, sf: str) -> DataFrame:
    """Employee snapshot: one row per person and vantage date."""
    k = F.col("c_custkey")
    c = _with_vantage(dealt(read_table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"), "c_custkey"))
    nation = F.col("c_nationkey").cast("string")
    vd = F.col("vantage_date")
    tenure = ((k * 13) % 9000).cast("int")
    return c.select(
        F.concat_ws("_", F.lit("core"), F.lit("util"), nation, k.cast("string")).alias(PERSON),
        vd,
        F.when(vd == F.lit(VANTAGES[1]).cast("date"), "oot").when(k % 5 == 0, "val").otherwise("train").alias("dataset_split"),
        F.lit("core_util").alias("db_schema"),
        nation.alias("clnt_obj_id"),
        k.cast("string").alias("prsn_obj_id"),
        k.alias("cid"),
        F.col("c_mktsegment").alias("naics_cd"),
        F.when(k % 10 < 6, "USA").when(k % 10 < 9, "CAN").otherwise("MEX").alias("work_loc_cntry_cd"),
        F.when(k % 97 == 0, "UNKNOWN").otherwise(F.floor(k / 10).cast("string")).alias("mngr_pers_obj_id"),
        F.floor(k / 10).cast("string").alias("mgr_sup_id"),
        F.when(k % 50 == 0, None).otherwise(F.round((F.col("c_acctbal") + 1000) * 10, 1)).alias("baseline_salary"),
        F.when(k % 3 == 0, "H").when(k % 3 == 1, "S").alias("pay_rt_type_cd"),
        F.when(k % 41 == 0, None).otherwise(F.date_add(F.lit("1935-01-01").cast("date"), ((k * 37) % 25000).cast("int"))).alias("birth_dt"),
        tenure.alias("tenure_at_vantage_days"),
        F.date_sub(vd, tenure).alias("ltst_hire_dt"),
        F.when(k % 8 == 7, "M").otherwise((k % 8).cast("string")).alias("mngr_lvl_cd"),
        F.concat(F.lit("J"), (k % 12).cast("string")).alias("job_cd"),
        F.when(k % 4 < 2, "F").when(k % 4 == 2, "P").otherwise("X").alias("full_tm_part_tm_cd"),
        F.when(k % 7 < 4, "R").when(k % 7 < 6, "T").alias("reg_temp_cd"),
        F.when(k % 5 < 2, "E").when(k % 5 < 4, "N").otherwise("O").alias("flsa_stus_cd"),
        F.concat(F.lit("L"), (k % 25).cast("string")).alias("work_loc_cd"),
        ((k * 31) % 900 * 101.0).alias("team_avg_comp"),
        (1 + k % 30).cast("int").alias("team_size"),
        (1 + (k * 11) % 365).cast("int").alias("survival_time_days"),
        F.when(k % 3 == 0, 1).otherwise(0).alias("event_indicator_all"),
        F.when(k % 6 == 0, 1).otherwise(0).alias("event_indicator_vol"),
    )


BASE = """base as (
 select 'core_util_' || c_nationkey || '_' || c_custkey as person_composite_id, vantage_date,
  case when vantage_date = date '2000-01-01' then 'oot' when c_custkey%5=0 then 'val' else 'train' end dataset_split,
  'core_util' db_schema, cast(c_nationkey as varchar) clnt_obj_id, cast(c_custkey as varchar) prsn_obj_id,
  c_custkey cid, c_mktsegment naics_cd,
  case when c_custkey%10<6 then 'USA' when c_custkey%10<9 then 'CAN' else 'MEX' end work_loc_cntry_cd,
  case when c_custkey%97=0 then 'UNKNOWN' else cast(c_custkey//10 as varchar) end mngr_pers_obj_id,
  cast(c_custkey//10 as varchar) mgr_sup_id,
  case when c_custkey%50=0 then null else round((c_acctbal+1000)*10,1) end baseline_salary,
  case when c_custkey%3=0 then 'H' when c_custkey%3=1 then 'S' end pay_rt_type_cd,
  case when c_custkey%41=0 then null else date '1935-01-01' + cast((c_custkey*37)%25000 as integer) end birth_dt,
  cast((c_custkey*13)%9000 as integer) tenure_at_vantage_days,
  vantage_date - cast((c_custkey*13)%9000 as integer) ltst_hire_dt,
  case when c_custkey%8=7 then 'M' else cast(c_custkey%8 as varchar) end mngr_lvl_cd,
  'J' || (c_custkey%12) job_cd,
  case when c_custkey%4<2 then 'F' when c_custkey%4=2 then 'P' else 'X' end full_tm_part_tm_cd,
  case when c_custkey%7<4 then 'R' when c_custkey%7<6 then 'T' end reg_temp_cd,
  case when c_custkey%5<2 then 'E' when c_custkey%5<4 then 'N' else 'O' end flsa_stus_cd,
  'L' || (c_custkey%25) work_loc_cd,
  cast((c_custkey*31)%900*101 as double) team_avg_comp,
  cast(1+c_custkey%30 as integer) team_size,
  cast(1+(c_custkey*11)%365 as integer) survival_time_days,
  case when c_custkey%3=0 then 1 else 0 end event_indicator_all,
  case when c_custkey%6=0 then 1 else 0 end event_indicator_vol
 from customer cross join (values (date '1998-01-01'),(date '2000-01-01')) v(vantage_date))"""


def _orders_with_person(spark: SparkSession, sf: str, *cols) -> DataFrame:
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", *cols)
    c = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.withColumn(PERSON, F.concat_ws("_", F.lit("core"), F.lit("util"), F.col("c_nationkey").cast("string"),
                                            F.col("c_custkey").cast("string")))


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Start-stop history: effective-dated records repeated per vantage date."""
    o = _orders_with_person(spark, sf, "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus")
    k = F.col("o_orderkey")
    d = o.select(
        PERSON, F.col("o_orderdate").cast("date").alias("rec_eff_start_dt_mod"), k.alias("seq"),
        F.when(k % 37 == 0, None).otherwise(F.round(F.col("o_totalprice"), 0)).alias("annl_cmpn_amt"),
        (F.col("o_totalprice") / 12).alias("mnthly_cmpn_amt"),
        F.col("o_orderstatus").alias("hr_cmpn_freq_cd"),
        F.col("o_orderpriority").alias("job_cd"),
        F.when(k % 29 == 0, None).otherwise((k % 9).cast("int")).alias("mngr_lvl_cd"),
        (k % 5).cast("string").alias("mngr_pers_obj_id"),
        (k % 4).cast("string").alias("work_asgmnt_nbr"),
        F.concat(F.lit("L"), (k % 25).cast("string")).alias("work_loc_cd"),
        F.lit("core_util").alias("db_schema"), F.col("c_nationkey").cast("string").alias("clnt_obj_id"))
    return _with_vantage(d)


HIST = """hist as (
 select 'core_util_' || c_nationkey || '_' || c_custkey as person_composite_id, vantage_date,
  cast(o_orderdate as date) rec_eff_start_dt_mod, o_orderkey seq,
  case when o_orderkey%37=0 then null else round(o_totalprice,0) end annl_cmpn_amt,
  o_totalprice/12 mnthly_cmpn_amt, o_orderstatus hr_cmpn_freq_cd, o_orderpriority job_cd,
  case when o_orderkey%29=0 then null else cast(o_orderkey%9 as integer) end mngr_lvl_cd,
  cast(o_orderkey%5 as varchar) mngr_pers_obj_id, cast(o_orderkey%4 as varchar) work_asgmnt_nbr,
  'L' || (o_orderkey%25) work_loc_cd, 'core_util' db_schema, cast(c_nationkey as varchar) clnt_obj_id
 from orders join customer on o_custkey=c_custkey
 cross join (values (date '1998-01-01'),(date '2000-01-01')) v(vantage_date))"""


def event_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Work-event fact rows as a warehouse would deliver them (key parts apart)."""
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate")
    o = _orders_with_person(spark, sf).drop(PERSON)
    n = F.col("l_linenumber")
    promo = F.col("l_returnflag") == "A"
    moved = F.col("l_returnflag") == "N"
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.lit("core_util").alias("db_schema"), F.col("c_nationkey").cast("string").alias("clnt_obj_id"),
        F.col("c_custkey").cast("string").alias("pers_obj_id"),
        F.when(n == 6, "JTC").when(n == 7, "POS").when(promo, "PRO").when(F.col("l_returnflag") == "R", "DEM")
         .otherwise("XFR").alias("event_cd"),
        F.when(n == 6, "FTPT").when(n == 7, "NEX")
         .when(moved, F.when(n == 1, "EER").when(n == 2, "REL").when(n == 3, "TMP").when(n == 4, "REO")
               .otherwise("Transfer - Skill-based"))
         .otherwise(F.when(n == 1, "OPR").when(n == 2, "JOB").when(n == 3, "MKT").when(n == 4, "REO").otherwise("USP"))
         .alias("event_rsn_cd"),
        F.col("l_shipdate").cast("date").alias("event_eff_dt"))


FACT = """fact as (
 select 'core_util' db_schema, cast(c_nationkey as varchar) clnt_obj_id, cast(c_custkey as varchar) pers_obj_id,
  case when l_linenumber=6 then 'JTC' when l_linenumber=7 then 'POS' when l_returnflag='A' then 'PRO'
       when l_returnflag='R' then 'DEM' else 'XFR' end event_cd,
  case when l_linenumber=6 then 'FTPT' when l_linenumber=7 then 'NEX'
   when l_returnflag='N' then case l_linenumber when 1 then 'EER' when 2 then 'REL' when 3 then 'TMP' when 4 then 'REO'
        else 'Transfer - Skill-based' end
   else case l_linenumber when 1 then 'OPR' when 2 then 'JOB' when 3 then 'MKT' when 4 then 'REO' else 'USP' end end event_rsn_cd,
  cast(l_shipdate as date) event_eff_dt
 from lineitem join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey)"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Career events keyed by the composite person id."""
    return event_facts(spark, sf).select(
        F.concat_ws("_", "db_schema", "clnt_obj_id", "pers_obj_id").alias(PERSON),
        "event_cd", "event_rsn_cd", "event_eff_dt")


EV = FACT + """,
ev as (select db_schema || '_' || clnt_obj_id || '_' || pers_obj_id person_composite_id, event_cd, event_rsn_cd,
  event_eff_dt from fact)"""


def terminations(spark: SparkSession, sf: str) -> DataFrame:
    """Leavers with their termination date, one row per person and vantage date."""
    b = base(spark, sf).where(F.col("cid") % 3 == 1)
    gone = F.date_sub("vantage_date", ((F.col("cid") * 17) % 1500).cast("int"))
    return b.select(*ENTITY, "dataset_split", "job_cd", "mngr_pers_obj_id", gone.alias("termination_date"),
                    gone.alias("latest_termination_date"))


TERM = """term as (
 select person_composite_id, vantage_date, dataset_split, job_cd, mngr_pers_obj_id,
  vantage_date - cast((cid*17)%1500 as integer) termination_date,
  vantage_date - cast((cid*17)%1500 as integer) latest_termination_date
 from base where cid%3=1)"""


def survival(spark: SparkSession, sf: str) -> DataFrame:
    """Right-censored times, written once per session: most evaluations read them several times."""
    return materialize(spark, "survival", sf, lambda: build_survival(spark, sf))


def build_survival(spark: SparkSession, sf: str) -> DataFrame:
    """Days to the next order, censored at status P, data end or day 365."""
    o = read_table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("od"), "o_orderdate", "o_orderstatus",
        "o_orderpriority", "o_totalprice")
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    g = o.withColumn("nd", F.lead("od").over(w)).withColumn("ns", F.lead("o_orderstatus").over(w))
    gap = F.coalesce(F.datediff("nd", "od"), F.lit(100000))
    fu = F.datediff(F.lit("2001-08-01").cast("date"), F.col("od"))
    return g.select(
        F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_orderpriority").alias("stratum"), "o_orderstatus",
        "o_totalprice",
        F.greatest(F.lit(1), F.least(gap, fu, F.lit(365))).cast("int").alias("time"),
        F.when((gap <= F.least(fu, F.lit(365))) & (F.col("ns") != "P"), 1).otherwise(0).alias("event"),
        F.when(F.col("od") < F.lit("1999-01-01").cast("date"),
               F.when(F.col("o_orderkey") % 5 == 0, "val").otherwise("train")).otherwise("oot").alias("dataset"))


SURV = """og as (
 select o_orderkey, o_custkey, cast(o_orderdate as date) od, o_orderstatus, o_orderpriority, o_totalprice,
  lead(cast(o_orderdate as date)) over (partition by o_custkey order by o_orderdate, o_orderkey) nd,
  lead(o_orderstatus) over (partition by o_custkey order by o_orderdate, o_orderkey) ns
 from orders),
ot as (select *, coalesce(datediff('day',od,nd),100000) gap, datediff('day',od,date '2001-08-01') fu from og),
surv as (select o_orderkey id, o_custkey, o_orderpriority stratum, o_orderstatus, o_totalprice,
 cast(greatest(1,least(gap,fu,365)) as integer) time,
 case when gap<=least(fu,365) and ns<>'P' then 1 else 0 end event,
 case when od<date '1999-01-01' then case when o_orderkey%5=0 then 'val' else 'train' end else 'oot' end dataset
 from ot)"""


SIGMA = 1.2


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Survival rows with a fixed-formula location ``eta``; scale 1.2, logistic."""
    s = survival(spark, sf)
    return s.withColumn("eta", 4.6 + 0.3 * (F.log("time") - 4.6) + 0.4 * ((F.col("id") * 37) % 11 - 5) / 5.0)


SCORED = SURV + """,
scored as (select *, 4.6 + 0.3*(ln(time) - 4.6) + 0.4*((id*37)%11 - 5)/5.0 eta from surv)"""
