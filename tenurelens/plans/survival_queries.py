"""Registered queries: descriptive survival."""
from __future__ import annotations

from pyspark.sql import functions as F

from tenurelens.functions.bootstrap import percentile_interval, replicate_means
from tenurelens.functions.columns import r6
from tenurelens.operators import survival as sv
from tenurelens.plans import fixtures as fx
from tenurelens.plans.registry import query


def km_sql(name, source, by, time="time", event="event", where="true"):
    """SQL twin of ``km_curve``: CTEs ``name_c`` (counts) and ``name`` (curve)."""
    b = "".join(f"{c}," for c in by)
    p = f"partition by {','.join(by)}" if by else ""
    return f"""{name}_n as (select {b} {time} t, sum({event}) d, count(*) n from {source} where {where} group by {b} {time}),
{name}_c as (select *, sum(n) over ({p} order by t rows between current row and unbounded following) n_risk from {name}_n),
{name}_s as (select *, case when sum(case when d=n_risk then 1 else 0 end) over w > 0 then 0.0
  else exp(sum(case when d<n_risk then ln(1.0-cast(d as double)/cast(n_risk as double)) else 0 end) over w) end S
 from {name}_c window w as ({p} order by t rows between unbounded preceding and current row)),
{name} as (select *, coalesce(lag(S) over ({p} order by t),1.0) S_left from {name}_s)"""


RET = ", ".join(f"round(coalesce(min(case when t<={h} then S end),1.0),6) retention_{h}d" for h in (30, 90, 180, 365))
RET_RAW = ", ".join(f"coalesce(min(case when t<={h} then S end),1.0) retention_{h}d" for h in (30, 90, 180, 365))


def base_sql(name, source, by, time="time", event="event", where="true"):
    """SQL twin of ``population_baseline``."""
    b = "".join(f"{c}," for c in by)
    g = f"group by {','.join(by)}" if by else ""
    return km_sql(f"{name}_k", source, by, time, event, where) + f""",
{name} as (select {b} max(n_risk) population, sum(d) events, {RET_RAW}, min(case when S<=0.5 then t end) median_days,
  sum(d)/cast(max(n_risk) as double) event_rate, 1-sum(d)/cast(max(n_risk) as double) censoring_rate
 from {name}_k {g})"""


ROUND_BASE = ", ".join(["population", "cast(events as bigint) events", "round(event_rate,6) event_rate",
                        "round(censoring_rate,6) censoring_rate", "median_days"] +
                       [f"round(retention_{h}d,6) retention_{h}d" for h in (30, 90, 180, 365)])


def erf_sql(x):
    t = f"(1.0/(1.0+0.3275911*abs({x})))"
    poly = f"{t}*(0.254829592+{t}*(-0.284496736+{t}*(1.421413741+{t}*(-1.453152027+{t}*1.061405429))))"
    return f"(sign({x})*(1.0-{poly}*exp(-({x})*({x}))))"


def tidy(df, ints=(), keep=()):
    """Round every double column; the shape every registered report has."""
    out = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        if t in ("double", "float"):
            out.append(r6(f.name).alias(f.name))
        elif t.startswith("decimal"):
            out.append(r6(F.col(f.name).cast("double")).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


@query("f1_km_curve_by_stratum", f"""with {fx.SURV}, {km_sql('k', 'surv', ['stratum'])}
select stratum, t, cast(d as bigint) d, cast(n_risk as bigint) n_risk, round(S,6) S, round(S_left,6) S_left from k""")
def f1(spark, sf):
    k = sv.km_curve(fx.survival(spark, sf), ["stratum"])
    return tidy(k.select("stratum", "t", "d", "n_risk", "S", "S_left"))


@query("f2_retention_at_horizons", f"""with {fx.SURV}, {km_sql('k', 'surv', ['stratum'])}, h(horizon) as (values (30),(90),(180),(365))
select stratum, horizon, round(coalesce(min(case when t<=horizon then S end),1.0),6) retention from k, h group by stratum, horizon""")
def f2(spark, sf):
    return tidy(sv.retention_long(sv.km_curve(fx.survival(spark, sf), ["stratum"]), ["stratum"]))


@query("f3_median_survival", f"""with {fx.SURV}, {km_sql('k', 'surv', ['dataset'])}
select dataset, coalesce(min(case when S<=0.5 then t end),cast('infinity' as double)) median_days from k group by dataset""")
def f3(spark, sf):
    return sv.median_survival(sv.km_curve(fx.survival(spark, sf), ["dataset"]), ["dataset"])


@query("f4_population_baseline", f"""with {fx.SURV}, {base_sql('b', 'surv', [], where="dataset in ('train','val')")} select {ROUND_BASE} from b""")
def f4(spark, sf):
    return tidy(sv.population_baseline(fx.survival(spark, sf).where(F.col("dataset").isin("train", "val"))))


@query("f5_bootstrap_event_rate")
def f5(spark, sf):
    d = fx.survival(spark, sf)
    cells = d.groupBy("dataset", "event").agg(F.sum("event").alias("events"), F.count(F.lit(1)).alias("n"))
    reps = replicate_means(cells, ["dataset"], "events", "n", 1000, cell_key=["dataset", "event"])
    return tidy(percentile_interval(reps, ["dataset"]))


LOGRANK = """select dataset, round(O,6) observed, round(E,6) expected, round(V,6) variance, round((O-E)*(O-E)/V,6) statistic
from (select dataset, sum(d1) O, sum(d*r1/r) E, sum(case when r>1 then d*(r1/r)*(1-r1/r)*(r-d)/(r-1) else 0 end) V
 from (select dataset, t, d, d1, cast(sum(n) over w as double) r, cast(sum(n1) over w as double) r1 from (
   select dataset, time t, sum(event) d, count(*) n, sum(case when o_orderstatus='F' then event else 0 end) d1,
    sum(case when o_orderstatus='F' then 1 else 0 end) n1 from surv where o_orderstatus in ('F','O') group by dataset, time)
   window w as (partition by dataset order by t rows between current row and unbounded following)) group by dataset)"""


@query("f6_log_rank", f"with {fx.SURV} {LOGRANK}")
def f6(spark, sf):
    t = sv.log_rank(fx.survival(spark, sf), "o_orderstatus", "F", "O", ["dataset"])
    return tidy(t.select("dataset", F.col("observed").cast("double").alias("observed"), "expected", "variance", "statistic"))


COHORT = "surv2 as (select *, case when dataset in ('train','val') then 'A' else 'B' end cohort from surv)"


def _cohorts(spark, sf):
    return fx.survival(spark, sf).withColumn("cohort", F.when(F.col("dataset").isin("train", "val"), "A").otherwise("B"))


@query("f7_temporal_trends", f"""with {fx.SURV}, {COHORT}, {base_sql('b', 'surv2', ['cohort'])},
lr as (select (O-E)*(O-E)/V stat from (select sum(d1) O, sum(d*r1/r) E, sum(case when r>1 then d*(r1/r)*(1-r1/r)*(r-d)/(r-1) else 0 end) V
 from (select t, d, d1, cast(sum(n) over w as double) r, cast(sum(n1) over w as double) r1 from (
   select time t, sum(event) d, count(*) n, sum(case when cohort='A' then event else 0 end) d1,
    sum(case when cohort='A' then 1 else 0 end) n1 from surv2 group by time)
   window w as (order by t rows between current row and unbounded following))))
select a.population population_earlier, z.population population_later, round(a.event_rate,6) event_rate_earlier,
 round(z.event_rate,6) event_rate_later, a.median_days median_days_earlier, z.median_days median_days_later,
 {', '.join(f'round(a.retention_{h}d,6) retention_{h}d_earlier, round(z.retention_{h}d,6) retention_{h}d_later, round(z.retention_{h}d-a.retention_{h}d,6) change_{h}d' for h in (30, 90, 180, 365))},
 round(stat,6) statistic, round(1-{erf_sql('sqrt(stat/2.0)')},6) p_value, stat > 3.841458820694124 significant
from b a, b z, lr where a.cohort='A' and z.cohort='B' and z.population>=1000""")
def f7(spark, sf):
    return tidy(sv.temporal_trends(_cohorts(spark, sf), "cohort", "A", "B"))


@query("f8_industry_patterns", f"""with {fx.SURV}, sm as (select s.*, c_mktsegment segment from surv s join customer on o_custkey=c_custkey where dataset in ('train','val')),
{base_sql('b', 'sm', ['segment'])},
top as (select *, row_number() over (order by population desc, segment) rn from b where population>=1000)
select segment, {ROUND_BASE}, rank() over (order by retention_365d desc, segment) as rank from top where rn<=10""")
def f8(spark, sf):
    return tidy(sv.ranked_strata(_industry(spark, sf), "segment", min_rows=1000, top_n=10))


def _industry(spark, sf):
    c = fx.read_table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    s = fx.survival(spark, sf)
    early = s.where(F.col("dataset").isin("train", "val"))
    return early.join(c, s.o_custkey == c.c_custkey).withColumnRenamed("c_mktsegment", "segment")


@query("f8_industry_spread", f"""with {fx.SURV}, sm as (select s.*, c_mktsegment segment from surv s join customer on o_custkey=c_custkey where dataset in ('train','val')),
{base_sql('b', 'sm', ['segment'])},
top as (select *, row_number() over (order by population desc, segment) rn from b where population>=1000)
select count(*) strata, arg_max(segment, retention_365d) best, arg_min(segment, retention_365d) worst,
 round(max(retention_365d)-min(retention_365d),6) as range, round(avg(retention_365d),6) mean, round(stddev_pop(retention_365d),6) std
from top where rn<=10""")
def f8_spread(spark, sf):
    ranked = sv.ranked_strata(_industry(spark, sf), "segment", min_rows=1000, top_n=10)
    return tidy(sv.strata_spread(ranked, "segment"))


AGE = """(((extract(year from vantage_date)-extract(year from birth_dt))*12 + extract(month from vantage_date)-extract(month from birth_dt)
 + case when extract(day from vantage_date)=extract(day from birth_dt)
   or (vantage_date=last_day(vantage_date) and birth_dt=last_day(birth_dt)) then 0
   else (extract(day from vantage_date)-extract(day from birth_dt))/31.0 end)/12.0)"""
AGED = f"aged as (select *, round({AGE},8) age_at_vantage from base)"
GROUPS = f"""{AGED}, grp as (select *,
 case when age_at_vantage is null or age_at_vantage<0 then null when age_at_vantage<=25 then '<25' when age_at_vantage<=35 then '25-35'
  when age_at_vantage<=45 then '35-45' when age_at_vantage<=55 then '45-55' when age_at_vantage<=65 then '55-65' else '65+' end age_group,
 case when tenure_at_vantage_days/365.25<=0.5 then '<6mo' when tenure_at_vantage_days/365.25<=1 then '6mo-1yr'
  when tenure_at_vantage_days/365.25<=2 then '1-2yr' when tenure_at_vantage_days/365.25<=3 then '2-3yr'
  when tenure_at_vantage_days/365.25<=5 then '3-5yr' else '5yr+' end tenure_group,
 case when baseline_salary is null or baseline_salary<0 then null when baseline_salary<=40000 then '<40K' when baseline_salary<=60000 then '40-60K'
  when baseline_salary<=80000 then '60-80K' when baseline_salary<=120000 then '80-120K' when baseline_salary<=200000 then '120-200K'
  else '200K+' end salary_group from aged)"""


def _grouped(spark, sf):
    b = fx.base(spark, sf).withColumn("age_at_vantage", F.round(F.months_between("vantage_date", "birth_dt") / 12, 8))
    return sv.demographic_groups(b)


@query("f9_demographic_groups", f"""with {fx.BASE}, {GROUPS}
select person_composite_id, vantage_date, age_group, tenure_group, salary_group from grp""")
def f9(spark, sf):
    return _grouped(spark, sf).select("person_composite_id", "vantage_date", "age_group", "tenure_group", "salary_group")


SEGMENTS = f"""{GROUPS}, seg as (
 select 'age_group' segment_type, age_group segment, survival_time_days time, event_indicator_all event from grp where age_group is not null
 union all select 'tenure_group', tenure_group, survival_time_days, event_indicator_all from grp
 union all select 'salary_group', salary_group, survival_time_days, event_indicator_all from grp where salary_group is not null),
{base_sql('b', 'seg', ['segment_type', 'segment'])}"""


@query("f10_demographic_segments", f"""with {fx.BASE}, {SEGMENTS}
select segment_type, segment, {ROUND_BASE}, rank() over (partition by segment_type order by retention_365d desc, segment) as rank
from b where population>=500""")
def f10(spark, sf):
    return tidy(_segments(spark, sf))


def _segments(spark, sf):
    return sv.segment_patterns(_grouped(spark, sf), ["age_group", "tenure_group", "salary_group"],
                               "survival_time_days", "event_indicator_all")


@query("f11_context_insights", f"""with {fx.BASE}, {SEGMENTS}, big as (select * from b where population>=500),
{base_sql('ind', 'base', ['naics_cd'], 'survival_time_days', 'event_indicator_all')},
{base_sql('tr', "(select *, case when dataset_split='oot' then 'B' else 'A' end cohort from base)", ['cohort'], 'survival_time_days', 'event_indicator_all')},
lr as (select (O-E)*(O-E)/V stat from (select sum(d1) O, sum(d*r1/r) E, sum(case when r>1 then d*(r1/r)*(1-r1/r)*(r-d)/(r-1) else 0 end) V
 from (select t, d, d1, cast(sum(n) over w as double) r, cast(sum(n1) over w as double) r1 from (
   select survival_time_days t, sum(event_indicator_all) d, count(*) n, sum(case when dataset_split<>'oot' then event_indicator_all else 0 end) d1,
    sum(case when dataset_split<>'oot' then 1 else 0 end) n1 from base group by survival_time_days)
   window w as (order by t rows between current row and unbounded following))))
select 'gap:' || segment_type factor, round(max(retention_365d)-min(retention_365d),6) impact,
 case when max(retention_365d)-min(retention_365d)>0.2 then 1 else 0 end flag from big group by segment_type
union all select 'coverage', round(c,6), case when c<0.5 then 1 else 0 end from (
 select coalesce(sum(population),0)/cast((select count(*) from base) as double) c from ind where population>=400)
union all select 'shift', round(abs(z.retention_365d-a.retention_365d),6), case when stat>3.841458820694124 then 1 else 0 end
 from tr a, tr z, lr where a.cohort='A' and z.cohort='B' and z.population>=1000""")
def f11(spark, sf):
    b = fx.base(spark, sf).withColumn("cohort", F.when(F.col("dataset_split") == "oot", "B").otherwise("A"))
    t, e = "survival_time_days", "event_indicator_all"
    strata = sv.ranked_strata(b, "naics_cd", (), t, e, 400)
    trend = sv.temporal_trends(b, "cohort", "A", "B", t, e)
    return tidy(sv.context_insights(_segments(spark, sf), sv.coverage(strata, b), trend))


@query("f12_time_density", f"""with {fx.SURV}, x as (
 select event, 'days' scale, cast(floor(time/30.0) as integer) bin, 30.0 w from surv union all
 select event, 'log_days', cast(floor(ln(time)/0.25) as integer), 0.25 from surv)
select event, scale, bin, count(*) n, round(count(*)/cast(sum(count(*)) over (partition by event, scale) as double)/w,6) density
from x group by event, scale, bin, w""")
def f12(spark, sf):
    return tidy(sv.day_density(fx.survival(spark, sf)))


@query("f12_kernel_density", f"""with {fx.SURV}, v as (select event, 'days' scale, cast(time as double) v from surv where time>0 union all select event, 'log_days', ln(time) from surv where time>0),
st as (select event, scale, count(*) n, stddev_samp(v)*pow(count(*),-0.2) h, min(v) lo, max(v) hi from v group by 1,2),
b as (select event, scale, least(floor((v-lo)/((hi-lo)/2048)),2047) bin, count(*) k from v join st using (event, scale) where hi>lo group by 1,2,3),
p as (select *, case when scale='days' then greatest(lo-3*h,0) else lo-3*h end a, hi+3*h z from st where hi>lo),
x as (select event, scale, cast(i as integer) as point, a+(z-a)*i/199 x from p, range(200) r(i))
select event, scale, x.point as point, round(x,6) x, round(sum(k*exp(-0.5*pow((x-(lo+(bin+0.5)*(hi-lo)/2048))/h,2)))/(any_value(n)*any_value(h)*sqrt(2*pi())),6) density, any_value(n) n, round(any_value(h),6) bandwidth
from x join st using (event, scale) join b using (event, scale) group by event, scale, x.point, x""")
def f12_kernel(spark, sf):
    return tidy(sv.kernel_density(fx.survival(spark, sf)))
