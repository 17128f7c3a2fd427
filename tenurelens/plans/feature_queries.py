"""Registered queries: ingestion, keys and point-in-time features."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tenurelens.operators import events as ev
from tenurelens.operators import external as ex
from tenurelens.operators import history as hi
from tenurelens.operators import profile as pr
from tenurelens.plans import features as pipeline
from tenurelens.plans import fixtures as fx
from tenurelens.plans.registry import query
from tenurelens.plans.survival_queries import AGE, tidy
from tenurelens.schema import ENTITY, PERSON, VANTAGE
from tenurelens.sources import keys
from tenurelens.sources.shared import new_path
from tenurelens.sources.tables import read_csv, save_bucketed, read_table, save_features

E = "person_composite_id, vantage_date"
BH = f"with {fx.BASE}, {fx.HIST}"
PIT = "rec_eff_start_dt_mod <= vantage_date"


@query("a1_source_filter", f"""{BH}, b as (select * from base where work_loc_cntry_cd in ('USA','CAN') and mngr_pers_obj_id not in ('UNKNOWN','ONE','','0'))
select {E}, cast(count(seq) as bigint) n_history from b left join hist using (person_composite_id, vantage_date) group by {E}""")
def a1(spark, sf):
    b = keys.source_filter(fx.base(spark, sf))
    h = keys.restrict_to(fx.history(spark, sf), b).groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("n_history"))
    return hi.attach(b.select(*ENTITY), h, {"n_history": 0})


@query("a2_vantage_by_split", """with s as (select distinct c_custkey pid, case when c_custkey%4=0 then 'oot' when c_custkey%4=1 then 'val' when c_custkey%4=2 then 'train' else 'extra' end sp from customer)
select cast(o_orderkey as bigint) o_orderkey, cast(o_custkey as varchar) person_composite_id, sp dataset_split,
 case sp when 'oot' then date '2024-01-01' when 'extra' then null else date '2023-01-01' end vantage_date from orders join s on pid=o_custkey""")
def a2(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias(PERSON))
    k = F.col("c_custkey")
    split = F.when(k % 4 == 0, "oot").when(k % 4 == 1, "val").when(k % 4 == 2, "train").otherwise("extra")
    s = read_table(spark, sf, "customer").select(k.cast("string").alias(PERSON), split.alias("dataset_split"))
    return keys.with_vantage_by_split(o, s)


DIM = """dim as (select clnt_obj_id, db_schema, event_cd, event_rsn_cd, min(event_cd || ' event') event_dsc, min(event_rsn_cd || ' reason') event_rsn_dsc
 from fact where event_rsn_cd in ('OPR','JOB','MKT') group by 1,2,3,4)"""


@query("a3_event_table", f"""with {fx.FACT}, {DIM}
select db_schema || '_' || clnt_obj_id || '_' || pers_obj_id person_composite_id, event_cd, event_rsn_cd, event_eff_dt, event_dsc, event_rsn_dsc
from fact left join dim using (clnt_obj_id, db_schema, event_cd, event_rsn_cd)""")
def a3(spark, sf):
    f = fx.event_facts(spark, sf)
    dim = f.where(F.col("event_rsn_cd").isin("OPR", "JOB", "MKT")).groupBy(
        "clnt_obj_id", "db_schema", "event_cd", "event_rsn_cd").agg(
        F.min(F.concat("event_cd", F.lit(" event"))).alias("event_dsc"),
        F.min(F.concat("event_rsn_cd", F.lit(" reason"))).alias("event_rsn_dsc"))
    t = keys.event_table(spark, f, dim)
    return t.select(PERSON, "event_cd", "event_rsn_cd", "event_eff_dt", "event_dsc", "event_rsn_dsc")


@query("a4_composite_id", f"""with {fx.BASE} select person_composite_id, prsn_obj_id employee_id, clnt_obj_id, db_schema from base""")
def a4(spark, sf):
    b = fx.base(spark, sf).withColumn(PERSON, keys.composite_id(person="prsn_obj_id")).select(PERSON)
    return keys.parse_composite_id(b)


@query("a5_unique_key_dimension", """select s_nationkey, min(s_name) s_name, min(s_suppkey) s_suppkey from supplier group by s_nationkey having count(*)=1
union all select cast(p_size as integer), min(p_name), min(p_partkey) from (select *, p_size*100000+floor(p_retailprice) k from part) group by p_size, k having count(*)=1""")
def a5(spark, sf):
    s = read_table(spark, sf, "supplier").select("s_nationkey", "s_name", "s_suppkey")
    p = read_table(spark, sf, "part").select(F.col("p_size").cast("int").alias("s_nationkey"), F.col("p_name").alias("s_name"),
                                             F.col("p_partkey").alias("s_suppkey"), F.floor("p_retailprice").alias("k"))
    return keys.unique_key_rows(s, ["s_nationkey"]).unionByName(
        keys.unique_key_rows(p, ["s_nationkey", "k"]).drop("k"))


@query("a6_first_per_key", """select o_custkey, st, o_orderkey from (select o_custkey, case when o_orderstatus='F' then null else o_orderstatus end st, o_orderkey,
 row_number() over (partition by o_custkey order by case when o_orderstatus='F' then null else o_orderstatus end nulls last, o_orderkey) rn from orders) where rn=1""")
def a6(spark, sf):
    o = read_table(spark, sf, "orders").select(
        "o_custkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("st"), "o_orderkey")
    return keys.first_per_key(o, ["o_custkey"], "st", ["o_orderkey"])


SNAP = """snap as (select clnt_obj_id ooid, prsn_obj_id aoid, vantage_date, is_manager_ from (
 select *, row_number() over (partition by prsn_obj_id, clnt_obj_id, vantage_date order by source_hr nulls last, is_manager_) rn from (
 select cast(c_nationkey as varchar) clnt_obj_id, cast(c_custkey as varchar) prsn_obj_id,
  case when o_orderkey%2=0 then date '1998-01-01' else date '2000-01-01' end vantage_date,
  case when o_orderkey%3=0 then null else o_orderpriority end source_hr, cast(o_orderkey%2 + o_orderkey%5%2 as integer) is_manager_
 from orders join customer on o_custkey=c_custkey where o_orderkey%7<5)) where rn=1)"""


def _monthly(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    k = F.col("o_orderkey")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_nationkey").cast("string").alias("ooid"), F.col("c_custkey").cast("string").alias("aoid"),
        F.when(k % 7 >= 5, "199901").when(k % 2 == 0, "199801").otherwise("200001").alias("yyyymm"),
        F.when(k % 3 != 0, F.col("o_orderpriority")).alias("source_hr"), (k % 2 + k % 5 % 2).cast("int").alias("is_manager_"),
        F.col("c_custkey").cast("string").alias("employee_guid"))


MONTHS = {"199801": "1998-01-01", "200001": "2000-01-01"}


def _snapshots(spark, sf):
    return keys.yearly_snapshots(_monthly(spark, sf).drop("employee_guid"), months=MONTHS)


@query("a7_yearly_snapshots", f"with {SNAP} select * from snap")
def a7(spark, sf):
    return _snapshots(spark, sf).select("ooid", "aoid", VANTAGE, "is_manager_")


@query("b1_salary_as_of", f"""{BH} select {E}, max_by(annl_cmpn_amt, struct_pack(a:=rec_eff_start_dt_mod, b:=annl_cmpn_amt)) salary_0d_ago,
 max_by(annl_cmpn_amt, struct_pack(a:=rec_eff_start_dt_mod, b:=annl_cmpn_amt)) filter (where rec_eff_start_dt_mod <= vantage_date - 365) salary_365d_ago
from hist where {PIT} and annl_cmpn_amt is not null group by {E}""")
def b1(spark, sf):
    return hi.salary_as_of(fx.history(spark, sf))


COMP = f"""sal as (select distinct {E}, rec_eff_start_dt_mod d, annl_cmpn_amt s, mnthly_cmpn_amt m from hist where {PIT} and annl_cmpn_amt is not null),
lg as (select *, lag(s) over (partition by {E} order by d, s) p from sal),
ca as (select {E}, max_by(s, struct_pack(a:=d, b:=s)) now_s, max_by(s, struct_pack(a:=d, b:=s)) filter (where d <= vantage_date-365) ago,
  count(*) filter (where p is null or p<>s) nc, max(d) filter (where p is null or p<>s) lc, min(d) filter (where p is null or p<>s) fc,
  stddev_samp(s) sd, avg(m) filter (where d >= vantage_date-90) lq, max(d) filter (where s>p) lr from lg group by {E})"""
MB = """case when lr is null then 0.0 else round(((extract(year from vantage_date)-extract(year from lr))*12 + extract(month from vantage_date)-extract(month from lr)
 + case when extract(day from vantage_date)=extract(day from lr) then 0 else (extract(day from vantage_date)-extract(day from lr))/31.0 end),6) end"""


@query("b2_salary_growth", f"{BH}, {COMP} select {E}, round(case when ago is null or ago=0 then 0 else (now_s-ago)/ago end,6) salary_growth_rate_12m from ca")
def b2(spark, sf):
    return tidy(hi.compensation_aggregates(fx.history(spark, sf)).select(*ENTITY, "salary_growth_rate_12m"))


@query("b3_pay_percentiles", f"""with {fx.BASE}, c as (select {E}, percent_rank() over (partition by clnt_obj_id, vantage_date order by baseline_salary) pc,
 percent_rank() over (partition by naics_cd, vantage_date order by baseline_salary) pi from base where baseline_salary is not null)
select {E}, round(pc,6) compensation_percentile_company, round(pi,6) compensation_percentile_industry from base left join c using ({E})""")
def b3(spark, sf):
    return tidy(hi.pay_percentiles(fx.base(spark, sf)).select(*ENTITY, "compensation_percentile_company", "compensation_percentile_industry"))


@query("b4_change_points", f"""{BH}, x as (select distinct {E}, rec_eff_start_dt_mod, hr_cmpn_freq_cd from hist where {PIT}),
y as (select *, lag(hr_cmpn_freq_cd) over (partition by {E} order by rec_eff_start_dt_mod, hr_cmpn_freq_cd) prev_value from x)
select * from y where prev_value is null or prev_value<>hr_cmpn_freq_cd""")
def b4(spark, sf):
    return hi.change_points(fx.history(spark, sf), "hr_cmpn_freq_cd")


@query("b5_change_frequency", f"""{BH}, {COMP} select {E}, round(case when lc-fc>365 then (nc-1)*365.0/(lc-fc) else nc-1 end,6) comp_chang_freq_per_year from ca""")
def b5(spark, sf):
    return tidy(hi.compensation_aggregates(fx.history(spark, sf)).select(*ENTITY, "comp_chang_freq_per_year"))


@query("b6_compensation_volatility", f"{BH}, {COMP} select {E}, round(coalesce(sd,0),4) compensation_volatility from ca")
def b6(spark, sf):
    h = hi.compensation_aggregates(fx.history(spark, sf))
    return h.select(*ENTITY, F.round("compensation_volatility", 4).alias("compensation_volatility"))


@query("b7_last_quarter_pay", f"{BH}, {COMP} select {E}, round(lq,6) avg_salary_last_quarter from ca")
def b7(spark, sf):
    return tidy(hi.compensation_aggregates(fx.history(spark, sf)).select(*ENTITY, "avg_salary_last_quarter"))


FREQ = f"""pf as (select {E}, hr_cmpn_freq_cd, cast(count(*) as double) n from hist where {PIT} and hr_cmpn_freq_cd is not null
  and rec_eff_start_dt_mod >= vantage_date-365 group by {E}, hr_cmpn_freq_cd),
pg as (select {E}, 1-sum(n*n)/(sum(n)*sum(n)) g from pf group by {E}),
pc as (select {E}, round(g,6) pay_freq_diversity_score, case when g<=0.2 then 1.0 when g<=0.5 then 0.7 when g<=0.8 then 0.4 else 0.1 end pay_freq_consistency_score from pg)"""


@query("b8_pay_frequency_consistency", f"{BH}, {FREQ} select * from pc")
def b8(spark, sf):
    return tidy(hi.pay_frequency_consistency(fx.history(spark, sf)))


@query("b9_pay_stagnation_months", f"{BH}, {COMP} select {E}, {MB} pay_grade_stagnation_months from ca")
def b9(spark, sf):
    return tidy(hi.compensation_aggregates(fx.history(spark, sf)).select(*ENTITY, "pay_grade_stagnation_months"))


@query("b10_pay_frequency_preference", f"with {fx.BASE} select {E}, case pay_rt_type_cd when 'H' then 1 when 'S' then 2 else 0 end pay_frequency_preference from base")
def b10(spark, sf):
    return hi.pay_frequency_preference(fx.base(spark, sf)).select(*ENTITY, "pay_frequency_preference")


@query("b1_b10_compensation_features", f"""{BH}, {COMP}, {FREQ}, c as (select {E}, percent_rank() over (partition by clnt_obj_id, vantage_date order by baseline_salary) cpc,
 percent_rank() over (partition by naics_cd, vantage_date order by baseline_salary) cpi from base where baseline_salary is not null)
select {E}, round(cpc,6) compensation_percentile_company, round(cpi,6) compensation_percentile_industry,
 round(case when ago is null or ago=0 then 0 else (now_s-ago)/ago end,6) salary_growth_rate_12m,
 round(case when ago is null or ago=0 then 0 else (now_s-ago)/ago end,6) total_compensation_growth,
 round(case when lc-fc>365 then (nc-1)*365.0/(lc-fc) else nc-1 end,6) comp_chang_freq_per_year,
 round(coalesce(sd,0),4) compensation_volatility, round(lq,6) avg_salary_last_quarter, {MB} pay_grade_stagnation_months,
 pay_freq_consistency_score, case pay_rt_type_cd when 'H' then 1 when 'S' then 2 else 0 end pay_frequency_preference
from base left join c using ({E}) left join ca using ({E}) left join pc using ({E})""")
def b1_b10(spark, sf):
    f = hi.add_compensation_features(fx.base(spark, sf), fx.history(spark, sf))
    return tidy(f.select(
        *ENTITY, "compensation_percentile_company", "compensation_percentile_industry", "salary_growth_rate_12m",
        "total_compensation_growth", "comp_chang_freq_per_year",
        F.round("compensation_volatility", 4).alias("compensation_volatility"), "avg_salary_last_quarter",
        "pay_grade_stagnation_months", "pay_freq_consistency_score", "pay_frequency_preference"))


BE = f"with {fx.BASE}, {fx.EV}, ee as (select {E}, event_cd c, event_rsn_cd r, event_eff_dt d from base join ev using (person_composite_id) where event_eff_dt <= vantage_date)"


@query("b11_promotion_history", f"""{BE}, p as (select *, d - lag(d) over (partition by {E} order by d) gap from ee where c='PRO'),
a as (select {E}, max(d) last, avg(gap) g from p group by {E})
select {E}, coalesce(cast(vantage_date-last as integer),9999) time_since_last_promotion, round(coalesce(g,0),6) promotion_velocity from base left join a using ({E})""")
def b11(spark, sf):
    f = ev.promotion_history(fx.base(spark, sf), fx.events(spark, sf))
    return tidy(f.select(*ENTITY, "time_since_last_promotion", "promotion_velocity"))


@query("b12_level_promotions", f"""{BH}, x as (select distinct {E}, rec_eff_start_dt_mod d, mngr_lvl_cd l from hist where {PIT} and mngr_lvl_cd is not null),
y as (select *, lag(l) over (partition by {E} order by d, l) p from x), z as (select *, d - lag(d) over (partition by {E} order by d) gap from y where l>p)
select {E}, count(*) n_promotions, cast(vantage_date-max(d) as integer) time_since_last_promotion, round(coalesce(avg(gap),0),6) promotion_velocity,
 round(case when max(d)=min(d) then 0 else count(*)/((max(d)-min(d))/365.25) end,6) promotions_per_year from z group by {E}""")
def b12(spark, sf):
    return tidy(hi.level_promotion_features(fx.history(spark, sf)))


@query("b13_demographics", f"""with {fx.BASE}, a as (select *, round({AGE}*12.0,8)/12 age, tenure_at_vantage_days/365.25 ty, extract(year from birth_dt) bye from base),
w as (select *, case when age is not null then greatest(0.0, age-25) else 0.0 end wa from a)
select {E}, round(age,6) age_at_vantage, case when age<30 then 'Early' when age<45 then 'Mid' when age<60 then 'Late' else 'Senior' end career_stage,
 round(case when age is not null then greatest(0.0,65-age) end,6) retirement_eligibility_years, cast(bye as integer) birth_year,
 case when bye>=1997 then 'Gen Z' when bye>=1981 then 'Millennial' when bye>=1965 then 'Gen X' when bye>=1946 then 'Baby Boomer' else 'Silent Generation' end generation_cohort,
 round(ty,6) tenure_at_vantage_years, round(case when age>0 then ty/age else 0 end,6) tenure_age_ratio, round(wa,6) working_age,
 case when wa<=5 and ty<=2 then 'early_career' when wa>5 and wa<=15 and ty<=5 then 'mid_career_joiner' when wa>15 and ty<=5 then 'late_career_joiner'
  when ty>5 then 'experienced_loyal' else 'other' end career_joiner_stage,
 case when age<=30 and ty>=5 then 'burnout_risk' when age>=50 and ty<=2 then 'retirement_on_disengagement_risk' else 'normal' end tenure_age_risk from w""")
def b13(spark, sf):
    f = pr.add_demographic_features(fx.base(spark, sf))
    return tidy(f.select(*ENTITY, "age_at_vantage", "career_stage", "retirement_eligibility_years", "birth_year",
                         "generation_cohort", "tenure_at_vantage_years", "tenure_age_ratio", "working_age",
                         "career_joiner_stage", "tenure_age_risk"))


@query("b14_job_characteristics", f"""with {fx.BASE} select {E}, mngr_lvl_cd job_level,
 case when try_cast(mngr_lvl_cd as integer)>=5 then 3 when try_cast(mngr_lvl_cd as integer)>=3 then 2 else 1 end role_complexity_score,
 case when full_tm_part_tm_cd='F' and reg_temp_cd='R' and flsa_stus_cd in ('E','N') then 1.0 when reg_temp_cd='T' then 0.0 else 0.5 end job_stability_ind from base""")
def b14(spark, sf):
    return pr.job_characteristics(fx.base(spark, sf)).select(*ENTITY, "job_level", "role_complexity_score", "job_stability_ind")


def turnover_sql(group, date, out):
    return f"""(select h.{group}, h.vantage_date, round(coalesce(g,0)/cast(coalesce(g,0)+n as double),6) {out} from
 (select {group}, vantage_date, count(distinct person_composite_id) n from base group by 1,2) h left join
 (select {group}, vantage_date, count(distinct person_composite_id) g from term where {date} between vantage_date-730 and vantage_date group by 1,2) t
 on h.{group}=t.{group} and h.vantage_date=t.vantage_date)"""


@query("b15_job_family_turnover", f"""with {fx.BASE}, {fx.TERM} select {E}, job_family_turnover_rate from base
 join {turnover_sql('job_cd', 'termination_date', 'job_family_turnover_rate')} r using (job_cd, vantage_date)""")
def b15(spark, sf):
    f = pr.add_job_characteristics_features(fx.base(spark, sf), fx.terminations(spark, sf))
    return tidy(f.select(*ENTITY, "job_family_turnover_rate"))


@query("b15_team_turnover", f"""with {fx.BASE}, {fx.TERM} select {E}, team_turnover_rate, round(case when team_avg_comp>0 then baseline_salary/team_avg_comp else 1.0 end,6) peer_salary_ratio
 from base join {turnover_sql('mngr_pers_obj_id', 'latest_termination_date', 'team_turnover_rate')} r using (mngr_pers_obj_id, vantage_date)""")
def b15_team(spark, sf):
    f = pr.add_team_environment_features(fx.base(spark, sf), fx.terminations(spark, sf))
    return tidy(f.select(*ENTITY, "team_turnover_rate", "peer_salary_ratio"))


@query("b16_manager_changes", f"""{BH}, a as (select {E}, count(distinct mngr_pers_obj_id) filter (where {PIT}) n1, count(distinct mngr_pers_obj_id) n2
 from hist where mngr_pers_obj_id not in ('UNKNOWN','ONE','','0') group by {E})
select {E}, cast(coalesce(n1,0) as bigint) manager_changes_count, cast(coalesce(n2,0) as bigint) distinct_managers_all from base left join a using ({E})""")
def b16(spark, sf):
    h = fx.history(spark, sf)
    out = hi.attach(fx.base(spark, sf).select(*ENTITY), hi.manager_changes(h), {"manager_changes_count": 0})
    return hi.attach(out, hi.manager_changes(h, False, "distinct_managers_all"), {"distinct_managers_all": 0})


def current_sql(col, out):
    return f"""(select {E}, cast(vantage_date-max_by(s, struct_pack(a:=l, b:={col})) as integer) {out} from (
 select {E}, {col}, min(rec_eff_start_dt_mod) s, max(rec_eff_start_dt_mod) l from hist where {PIT} and {col} is not null group by {E}, {col}) group by {E})"""


@query("b17_time_in_current", f"""{BH} select * from {current_sql('mngr_pers_obj_id', 'time_with_current_manager')} a
 full join {current_sql('job_cd', 'tenure_in_current_role')} b using ({E})""")
def b17(spark, sf):
    h = fx.history(spark, sf)
    return hi.time_in_current(h, "mngr_pers_obj_id", "time_with_current_manager").join(
        hi.time_in_current(h, "job_cd", "tenure_in_current_role"), ENTITY, "full")


@query("b18_manager_tenure", f"""with {fx.BASE}, m as (select prsn_obj_id mgr_sup_id, clnt_obj_id, db_schema, vantage_date, max(tenure_at_vantage_days) manager_tenure_days from base group by 1,2,3,4)
select {E}, manager_tenure_days from base left join m using (mgr_sup_id, clnt_obj_id, db_schema, vantage_date)""")
def b18(spark, sf):
    return pr.manager_tenure(fx.base(spark, sf)).select(*ENTITY, "manager_tenure_days")


@query("b19_manager_span", f"""with {fx.BASE}, m as (select mgr_sup_id, clnt_obj_id, db_schema, vantage_date, count(distinct person_composite_id) manager_span_control from base group by 1,2,3,4)
select {E}, manager_span_control from base left join m using (mgr_sup_id, clnt_obj_id, db_schema, vantage_date)""")
def b19(spark, sf):
    return pr.manager_span(fx.base(spark, sf)).select(*ENTITY, "manager_span_control")


@query("b20_manager_indicator", f"""with {fx.BASE}, {SNAP} select {E}, coalesce(is_manager_,0) is_manager_ind, is_manager_ is_manager_or_null
 from base left join snap on ooid=clnt_obj_id and aoid=prsn_obj_id and snap.vantage_date=base.vantage_date""".replace(f"select {E}", "select person_composite_id, base.vantage_date"))
def b20(spark, sf):
    b, s = fx.base(spark, sf), _snapshots(spark, sf)
    return pr.manager_indicator(b, s).select(*ENTITY, F.coalesce("is_manager_ind", F.lit(0)).alias("is_manager_ind"),
                                             F.col("is_manager_ind").alias("is_manager_or_null"))


@query("b21_peer_salary_ratio", f"with {fx.BASE} select {E}, round(case when team_avg_comp>0 then baseline_salary/team_avg_comp else 1.0 end,6) peer_salary_ratio from base")
def b21(spark, sf):
    return tidy(pr.peer_salary_ratio(fx.base(spark, sf)).select(*ENTITY, "peer_salary_ratio"))


@query("b22_tenure_percentile", f"""with {fx.BASE} select {E}, round(percent_rank() over (partition by clnt_obj_id, vantage_date order by tenure_at_vantage_days)*99+1,6) company_tenure_percentile,
 round(percent_rank() over (partition by naics_cd, vantage_date order by tenure_at_vantage_days),6) industry_tenure_percentile from base""")
def b22(spark, sf):
    f = hi.tenure_percentile(fx.base(spark, sf), industry=True)
    return tidy(f.select(*ENTITY, "company_tenure_percentile", "industry_tenure_percentile"))


@query("b23_assignment_frequency", f"{BH} select {E}, count(distinct work_asgmnt_nbr) assignment_frequency_12m from hist where {PIT} and rec_eff_start_dt_mod >= vantage_date-365 group by {E}")
def b23(spark, sf):
    return hi.assignment_frequency(fx.history(spark, sf))


# nation names serve as states and cities; two of them are missing markers
PLACES = """places as (select 'core_util' db_schema, cast(c.n_nationkey as varchar) clnt_obj_id, 'L' || l.n_nationkey work_loc_cd,
 case when l.n_nationkey=3 then 'Unknown' else l.n_name end city_nm, case when l.n_nationkey=7 then 'MISSING' else r_name end state_prov_nm
 from nation c, nation l join region on l.n_regionkey=r_regionkey)"""


def _places(spark, sf):
    """Location dimension: every client has all nation codes (25 per client)."""
    n = read_table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf, "region").select("r_regionkey", "r_name")
    k = F.col("n_nationkey")
    loc = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.concat(F.lit("L"), k.cast("string")).alias("work_loc_cd"), F.when(k == 3, "Unknown").otherwise(F.col("n_name")).alias("city_nm"),
        F.when(k == 7, "MISSING").otherwise(F.col("r_name")).alias("state_prov_nm"))
    clients = F.explode(F.sequence(F.lit(0), F.lit(24)))
    return loc.select(F.lit("core_util").alias("db_schema"), clients.alias("_c"), "*").withColumn(
        "clnt_obj_id", F.col("_c").cast("string")).drop("_c")


def changes_sql(col, out, source, missing=""):
    return f"""(select {E}, sum(case when v<>p then 1 else 0 end) {out} from (select *, lag(v) over (partition by {E} order by rec_eff_start_dt_mod, v) p from (
 select distinct {E}, rec_eff_start_dt_mod, {col} v from {source} where {PIT} and {col} is not null {missing})) group by {E})"""


NOT_MISSING = "and upper({}) not in ('UNKNOWN','MISSING','NULL')"


@query("b24_change_counts", f"""{BH}, {PLACES}, hp as (select * from hist left join places using (db_schema, clnt_obj_id, work_loc_cd))
select {E}, cast(coalesce(l,0) as bigint) work_location_changes_count, cast(coalesce(c,0) as bigint) num_city_chng, cast(coalesce(s,0) as bigint) num_state_chng,
 cast(coalesce(f,0) as bigint) assignment_frequency_12m
from base left join {changes_sql('work_loc_cd', 'l', 'hist')} using ({E}) left join {changes_sql('city_nm', 'c', 'hp', NOT_MISSING.format('city_nm'))} using ({E})
left join {changes_sql('state_prov_nm', 's', 'hp', NOT_MISSING.format('state_prov_nm'))} using ({E})
left join (select {E}, count(distinct work_asgmnt_nbr) f from hist where {PIT} and rec_eff_start_dt_mod >= vantage_date-365 group by {E}) using ({E})""")
def b24(spark, sf):
    f = hi.add_work_patterns_features(fx.base(spark, sf), fx.history(spark, sf), _places(spark, sf))
    return f.select(*ENTITY, "work_location_changes_count", "num_city_chng", "num_state_chng", "assignment_frequency_12m")


@query("b25_company_size", f"""with {fx.BASE} select {E}, case when n<100 then 'Small' when n<1000 then 'Medium' when n<10000 then 'Large' else 'Enterprise' end company_size_tier, 0 company_layoff_indicator
from (select {E}, count(*) over (partition by clnt_obj_id, vantage_date) n from base)""")
def b25(spark, sf):
    return pr.add_company_factors_features(fx.base(spark, sf)).select(*ENTITY, "company_size_tier", "company_layoff_indicator")


@query("b26_temporal", f"""with {fx.BASE}, t as (select *, cast(extract(month from ltst_hire_dt) as integer) m, cast(extract(year from ltst_hire_dt) as integer) y from base),
u as (select *, case when work_loc_cntry_cd='USA' then y + (case when m>=10 then 1 else 0 end) when work_loc_cntry_cd='CAN' then y + (case when m>=4 then 1 else 0 end) end fy from t),
v as (select *, case when work_loc_cntry_cd='USA' then make_date(fy,9,30) when work_loc_cntry_cd='CAN' then make_date(fy,3,31) end fd from u)
select {E}, m hire_month, cast((m+2)//3 as integer) hire_quarter, case when m in (12,1,2) then 'Winter' when m<=5 then 'Spring' when m<=8 then 'Summer' else 'Fall' end hire_date_seasonality,
 fy fiscal_year, fd fiscal_date, cast(fd-ltst_hire_dt as integer) fiscal_year_effect,
 case when work_loc_cntry_cd='USA' then case when m>=10 then 'Q1' when m<=3 then 'Q2' when m<=6 then 'Q3' else 'Q4' end
  when work_loc_cntry_cd='CAN' then case when m between 4 and 6 then 'Q1' when m between 7 and 9 then 'Q2' when m>=10 then 'Q3' else 'Q4' end end quarter_effect from v""")
def b26(spark, sf):
    return pr.add_temporal_features(fx.base(spark, sf)).select(
        *ENTITY, "hire_month", "hire_quarter", "hire_date_seasonality", "fiscal_year", "fiscal_date", "fiscal_year_effect", "quarter_effect")


def codes(values):
    return "(" + ",".join(f"'{v}'" for v in values) + ")"


def any_sql(cond):
    return f"max(case when {cond} then 1 else 0 end)"


RECENT = "d >= vantage_date-730"
B27_AGG = f"""pa as (select {E}, {any_sql(f"c='PRO' and {RECENT}")} promot_2yr_ind, {any_sql(f"c='DEM' and {RECENT}")} demot_2yr_ind, {any_sql(f"c='XFR' and {RECENT}")} transfer_2yr_ind,
 count(*) filter (where c='PRO' and {RECENT}) num_promot_2yr, count(*) filter (where c='DEM' and {RECENT}) num_demot_2yr, count(*) filter (where c='XFR' and {RECENT}) num_transfer_2yr,
 {any_sql(f"c='PRO' and {RECENT} and upper(r) in {codes(ev.PERFORMANCE)}")} promot_2yr_perf_ind, {any_sql(f"c='PRO' and {RECENT} and upper(r) in {codes(ev.TITLE_CHANGE)}")} promot_2yr_titlechng_ind,
 {any_sql(f"c='PRO' and {RECENT} and upper(r) in {codes(ev.MARKET_ADJUSTMENT)}")} promot_2yr_mktadjst_ind, {any_sql(f"c='DEM' and {RECENT} and upper(r) in {codes(ev.COMPANY_REORG)}")} demot_2yr_compreorg_ind,
 {any_sql(f"c='DEM' and {RECENT} and upper(r) in {codes(ev.PERFORMANCE_ISSUES)}")} demot_2yr_perfissue_ind,
 cast(vantage_date-max(d) filter (where c='PRO' and {RECENT}) as integer) days_since_promot, cast(vantage_date-max(d) filter (where c='XFR' and {RECENT}) as integer) days_since_transfer
 from ee group by {E}),
pv as (select {E}, avg(gap) promot_veloc from (select {E}, d - lag(d) over (partition by {E} order by d) gap from ee where c='PRO' and {RECENT}) group by {E})"""
B27_COLS = [c for c in ev.PROMOTION_FILLS]


def fill_sql(fills):
    return ", ".join(f"round(coalesce({c},{v}),6) {c}" if isinstance(v, float) else f"coalesce({c},{v}) {c}" for c, v in fills.items())


@query("b27_promotion_events", f"{BE}, {B27_AGG} select {E}, {fill_sql(ev.PROMOTION_FILLS)} from base left join pa using ({E}) left join pv using ({E})")
def b27(spark, sf):
    return tidy(ev.add_promotion_event_features(fx.base(spark, sf), fx.events(spark, sf)).select(*ENTITY, *B27_COLS))


@query("b28_event_counts_24_months", f"""{BE} select {E}, {any_sql("c='PRO' and d >= vantage_date - interval 24 month")} promot_2yr_ind, {any_sql("c='DEM' and d >= vantage_date - interval 24 month")} demot_2yr_ind,
 count(*) filter (where c='PRO' and d >= vantage_date - interval 24 month) num_promot_2yr, count(*) filter (where c='DEM' and d >= vantage_date - interval 24 month) num_demot_2yr from ee group by {E}""")
def b28(spark, sf):
    return ev.event_counts_24_months(fx.base(spark, sf), fx.events(spark, sf))


BES = BE.replace("event_eff_dt <= vantage_date", "event_eff_dt < vantage_date")


@query("b29_reason_indicators", f"""{BES} select {E}, {any_sql(f"c='PRO' and upper(r) in {codes(ev.PERFORMANCE)}")} promot_2yr_perf_ind, {any_sql(f"c='PRO' and upper(r) in {codes(ev.TITLE_CHANGE)}")} promot_2yr_titlechng_ind,
 {any_sql(f"c='PRO' and upper(r) in {codes(ev.MARKET_ADJUSTMENT)}")} promot_2yr_mktadjst_ind, {any_sql(f"c='DEM' and upper(r) in {codes(ev.COMPANY_REORG)} and {RECENT}")} demot_2yr_compreorg_ind,
 {any_sql(f"c='DEM' and upper(r) in {codes(ev.PERFORMANCE_ISSUES)} and {RECENT}")} demot_2yr_perfissue_ind, {any_sql(f"c='XFR' and {RECENT}")} transfer_2yr_ind,
 count(*) filter (where c='XFR' and {RECENT}) num_transfer_2yr, {any_sql(f"c='XFR' and upper(r) in {codes(ev.COMPANY_REORG)}")} transfer_2yr_reorg_ind,
 {any_sql(f"c='XFR' and upper(r) in {codes(ev.EMPLOYEE_REQUEST)}")} transfer_2yr_req_ind, {any_sql("c='XFR' and upper(r) like '%TRANSFER - SKILL-BASED%'")} transfer_2yr_skill_ind,
 {any_sql(f"c='XFR' and upper(r) in {codes(ev.RELOCATION)}")} transfer_2yr_reloc_ind, {any_sql(f"c='XFR' and upper(r) in {codes(ev.ASSIGNMENT)}")} transfer_2yr_asgnmt_ind,
 cast(vantage_date-max(d) filter (where c='XFR') as integer) days_since_transfer from ee group by {E}""")
def b29(spark, sf):
    return ev.reason_indicators(fx.base(spark, sf), fx.events(spark, sf))


@query("b30_promotion_time", f"""{BES}, p as (select *, d - lag(d) over (partition by {E} order by d) gap from ee where c='PRO'),
a as (select {E}, avg(gap) g, case when max(d)>min(d) then count(*)/cast(max(d)-min(d) as double) else 0 end rt, cast(vantage_date-max(d) as integer) ds from p group by {E})
select {E}, round(case when coalesce(rt,0)=1 and coalesce(g,0)=0 then null else coalesce(g,0) end,6) promot_veloc, round(coalesce(rt,0),6) promot_rt, coalesce(ds,0) days_since_promot
from (select distinct {E} from base) left join a using ({E})""")
def b30(spark, sf):
    return tidy(ev.promotion_time_features(fx.base(spark, sf), fx.events(spark, sf)))


JOB = "c in ('JTC','PJC','POS','JRC')"


def job_sql(window, number):
    return f"""select {E}, coalesce(a1,0) job_chng_2yr_ind, cast(coalesce(a2,0) as bigint) num_job_chng_2yr, coalesce(a3,0) job_chng_fulltopart_ind, coalesce(a4,0) job_chng_nexmptoexmp_ind
from base left join (select {E}, {any_sql(f"{JOB} and {window}")} a1, {number} filter (where {JOB} and {window}) a2,
 {any_sql(f"{JOB} and {window} and r in ('FTPT','FT2PT')")} a3, {any_sql(f"{JOB} and {window} and r in ('NEX','NXX')")} a4 from ee group by {E}) using ({E})"""


@query("b31_job_change_events", f"{BE} {job_sql(RECENT, 'count(*)')}")
def b31(spark, sf):
    return ev.add_job_change_event_features(fx.base(spark, sf), fx.events(spark, sf)).select(*ENTITY, *ev.JOB_FILLS)


@query("b31_job_change_dates", f"{BE} {job_sql('d >= vantage_date - interval 24 month', 'count(distinct d)')}")
def b31_dates(spark, sf):
    return ev.add_job_change_event_features(fx.base(spark, sf), fx.events(spark, sf), "months").select(*ENTITY, *ev.JOB_FILLS)


CPI = """reg as (select r_name State, 'Region ' || (r_regionkey%3) Region from region where r_name<>'ASIA'),
cpi as (select distinct 'Region ' || (r_regionkey%3) Region, r_regionkey%3*0.02 a, r_regionkey%3*0.03 b from region)"""


def _price_index(spark, sf):
    """Region of each state, and yearly price growth of each region."""
    r = read_table(spark, sf, "region").select("r_regionkey", "r_name")
    third = F.col("r_regionkey") % 3
    name = F.concat(F.lit("Region "), third.cast("string"))
    regions = r.where(F.col("r_name") != "ASIA").select(F.col("r_name").alias("State"), name.alias("Region"))
    return regions, r.select(name.alias("Region"), (third * 0.02).alias("1_Jan_23"), (third * 0.03).alias("1_Jan_24")).distinct()


@query("b32_salary_growth_to_cpi", f"""{BH}, {COMP}, {PLACES}, {CPI},
g as (select {E}, case when ago is null or ago=0 then 0 else (now_s-ago)/ago end sg from ca)
select {E}, round(case when coalesce(x,0)=0 or sg is null then 0 else sg/x end,6) salary_growth_rate12m_to_cpi_rate from (
 select {E}, sg, case when dataset_split in ('train','val') then a else b end x from base left join g using ({E})
 left join places using (db_schema, clnt_obj_id, work_loc_cd) left join reg on upper(State)=upper(state_prov_nm) left join cpi using (Region))""")
def b32(spark, sf):
    regions, cpi = _price_index(spark, sf)
    b = hi.attach(fx.base(spark, sf), hi.compensation_aggregates(fx.history(spark, sf)).select(*ENTITY, "salary_growth_rate_12m"))
    return tidy(ex.salary_growth_to_cpi(b, _places(spark, sf), regions, cpi).select(*ENTITY, "salary_growth_rate12m_to_cpi_rate"))


FLSA = """flsa as (select cast(n_nationkey as varchar) clnt_obj_id, c flsa_stus_cd, case c when 'E' then 'exempt' else 'non-exempt' end d
 from nation, (values ('E'),('N')) t(c) where n_nationkey%4>0)"""


def _flsa(spark, sf):
    n = read_table(spark, sf, "nation").where(F.col("n_nationkey") % 4 > 0)
    c = F.explode(F.array(F.lit("E"), F.lit("N")))
    return n.select(F.col("n_nationkey").cast("string").alias("clnt_obj_id"), c.alias("flsa_stus_cd")).withColumn(
        "flsa_stus_cd_normalized", F.when(F.col("flsa_stus_cd") == "E", "exempt").otherwise("non-exempt"))


@query("b33_normalized_flsa", f"with {fx.BASE}, {FLSA} select {E}, coalesce(d,'others') flsa_status_desc from base left join flsa using (clnt_obj_id, flsa_stus_cd)")
def b33(spark, sf):
    return ex.normalized_flsa(fx.base(spark, sf), _flsa(spark, sf)).select(*ENTITY, "flsa_status_desc")


HOMES = """who as (select distinct cast(c_nationkey as varchar) clnt_obj_id, cast(c_custkey as varchar) prsn_obj_id from orders join customer on o_custkey=c_custkey
 where o_orderkey%7<5 and o_orderkey%2=0),
geo as (select prsn_obj_id, max_by(t, struct_pack(a:=-o_orderkey)) t from (select cast(o_custkey as varchar) prsn_obj_id, o_orderkey, lpad(cast(o_orderkey%40 as varchar),11,'0') t from orders where o_orderkey%7<5 and o_orderkey%2=0) group by 1),
inc as (select lpad(cast(n_nationkey as varchar),11,'0') t, 30007.0+1000*n_nationkey inc from nation where n_nationkey>0)"""
HOME_JOIN = "left join who on base.clnt_obj_id=who.clnt_obj_id and base.prsn_obj_id=who.prsn_obj_id left join geo on who.prsn_obj_id=geo.prsn_obj_id left join inc using (t)"


@query("b34_neighborhood_salary_ratio", f"""with {fx.BASE}, {HOMES}
select {E}, round(case when inc is null or baseline_salary is null then 0 else baseline_salary/inc end,6) sal_nghb_ratio from base {HOME_JOIN}""")
def b34(spark, sf):
    f = ex.neighborhood_salary_ratio(fx.base(spark, sf), _monthly(spark, sf), *_homes(spark, sf), "199801")
    return tidy(f.select(*ENTITY, "sal_nghb_ratio"))


def _homes(spark, sf):
    """Home census block group of each person and month, and median income of each tract."""
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    geo = o.select(F.col("o_custkey").cast("string").alias("employee_guid"),
                   F.when((k % 7 < 5) & (k % 2 == 0), "199801").otherwise("other").alias("yyyymm"),
                   F.concat(F.lpad((k % 40).cast("string"), 11, "0"), F.lit("7")).alias("home_census_block_group"),
                   k.alias("home_congressional_district"))
    n = F.col("n_nationkey")
    income = read_table(spark, sf, "nation").where(n > 0).select(
        F.concat(F.lit("1400000US"), F.lpad(n.cast("string"), 11, "0")).alias("GEO_ID"), (30007.0 + 1000 * n).cast("string").alias("S1903_C03_001E"))
    return geo, income


@query("b35_normalize", f"""with {fx.BASE} select {E}, case when reg_temp_cd in ('T','R') then reg_temp_cd end reg_temp_cd, reg_temp_cd reg_temp_cd_raw,
 case when full_tm_part_tm_cd in ('F','P') then full_tm_part_tm_cd end full_tm_part_tm_cd, full_tm_part_tm_cd full_tm_part_tm_cd_raw,
 case when naics_cd<>'null' then naics_cd end naics_cd, naics_cd naics_cd_raw from base""")
def b35(spark, sf):
    return ex.normalize(fx.base(spark, sf)).select(*ENTITY, "reg_temp_cd", "reg_temp_cd_raw", "full_tm_part_tm_cd",
                                                   "full_tm_part_tm_cd_raw", "naics_cd", "naics_cd_raw")


# columns of the full build that are compared; the single operators above compare the rest
FULL = ["salary_growth_rate_12m", "company_size_tier", "quarter_effect", "job_family_turnover_rate", "team_turnover_rate",
        "manager_changes_count", "work_location_changes_count", "num_promot_2yr", "num_job_chng_2yr", "career_stage", "flsa_status_desc",
        "comp_chang_freq_per_year", "compensation_volatility", "avg_salary_last_quarter", "pay_grade_stagnation_months", "pay_freq_consistency_score", "tenure_in_current_role",
        "time_with_current_manager", "assignment_frequency_12m", "num_city_chng", "num_state_chng", "salary_growth_rate12m_to_cpi_rate", "sal_nghb_ratio", "peer_salary_ratio",
        "total_compensation_growth", "pay_frequency_preference", "company_tenure_percentile", "compensation_percentile_company", "compensation_percentile_industry",
        "is_manager_ind", "manager_tenure_days", "manager_span_control"]


@query("a10_feature_build", f"""with {fx.HIST}, {fx.BASE.replace('base as (', 'base0 as (', 1)},
base as (select * from base0 where work_loc_cntry_cd in ('USA','CAN') and mngr_pers_obj_id not in ('UNKNOWN','ONE','','0')),
{fx.TERM.replace('from base', 'from base0')}, {fx.EV}, ee as (select {E}, event_cd c, event_rsn_cd r, event_eff_dt d from base join ev using (person_composite_id) where event_eff_dt <= vantage_date),
{COMP}, {FREQ}, {FLSA}, {PLACES}, hp as (select * from hist left join places using (db_schema, clnt_obj_id, work_loc_cd)), {CPI}, {HOMES}, {SNAP},
home as (select {E}, case when inc is null or baseline_salary is null then 0 else baseline_salary/inc end home_ratio from base {HOME_JOIN}),
price as (select {E}, case when dataset_split in ('train','val') then a else b end x from base left join places using (db_schema, clnt_obj_id, work_loc_cd)
 left join reg on upper(State)=upper(state_prov_nm) left join cpi using (Region)),
own as (select prsn_obj_id mgr_sup_id, clnt_obj_id, db_schema, vantage_date, max(tenure_at_vantage_days) mt from base group by 1,2,3,4),
span as (select mgr_sup_id, clnt_obj_id, db_schema, vantage_date, count(distinct person_composite_id) ms from base group by 1,2,3,4),
rk as (select {E}, percent_rank() over (partition by clnt_obj_id, vantage_date order by baseline_salary) rc, percent_rank() over (partition by naics_cd, vantage_date order by baseline_salary) ri from base where baseline_salary is not null)
select {E}, round(coalesce(case when ago is null or ago=0 then 0 else (now_s-ago)/ago end,0),6) salary_growth_rate_12m,
 round(coalesce(case when ago is null or ago=0 then 0 else (now_s-ago)/ago end,0),6) total_compensation_growth, round(rc,6) compensation_percentile_company, round(ri,6) compensation_percentile_industry,
 round(case when lc-fc>365 then (nc-1)*365.0/(lc-fc) else nc-1 end,6) comp_chang_freq_per_year, round(coalesce(sd,0),4) compensation_volatility, round(lq,6) avg_salary_last_quarter,
 {MB} pay_grade_stagnation_months, pay_freq_consistency_score, case pay_rt_type_cd when 'H' then 1 when 'S' then 2 else 0 end pay_frequency_preference,
 coalesce(cr.tenure_in_current_role,0) tenure_in_current_role, cm.time_with_current_manager, cast(coalesce(af,0) as bigint) assignment_frequency_12m,
 cast(coalesce(cc,0) as bigint) num_city_chng, cast(coalesce(sc,0) as bigint) num_state_chng, round(home_ratio,6) sal_nghb_ratio,
 round(case when coalesce(x,0)=0 then 0 else coalesce(case when ago is null or ago=0 then 0 else (now_s-ago)/ago end,0)/x end,6) salary_growth_rate12m_to_cpi_rate,
 round(case when team_avg_comp>0 then baseline_salary/team_avg_comp else 1.0 end,6) peer_salary_ratio, round(tp*99+1,6) company_tenure_percentile,
 is_manager_ is_manager_ind, mt manager_tenure_days, ms manager_span_control,
 case when tn<100 then 'Small' when tn<1000 then 'Medium' when tn<10000 then 'Large' else 'Enterprise' end company_size_tier,
 case when work_loc_cntry_cd='USA' then 'Q' || cast((extract(month from ltst_hire_dt)+2)%12//3+1 as integer) else 'Q' || cast((extract(month from ltst_hire_dt)+8)%12//3+1 as integer) end quarter_effect,
 job_family_turnover_rate, team_turnover_rate, cast(coalesce(mc,0) as bigint) manager_changes_count, cast(coalesce(lch,0) as bigint) work_location_changes_count,
 cast(coalesce(np,0) as bigint) num_promot_2yr, cast(coalesce(nj,0) as bigint) num_job_chng_2yr,
 case when age<30 then 'Early' when age<45 then 'Mid' when age<60 then 'Late' else 'Senior' end career_stage, coalesce(fd,'others') flsa_status_desc
from (select *, {AGE} age, count(*) over (partition by clnt_obj_id, vantage_date) tn, percent_rank() over (partition by clnt_obj_id, vantage_date order by tenure_at_vantage_days) tp from base) base left join ca using ({E})
 left join pc using ({E}) left join rk using ({E}) left join home using ({E}) left join price using ({E}) left join {current_sql('job_cd', 'tenure_in_current_role')} cr using ({E})
 left join {current_sql('mngr_pers_obj_id', 'time_with_current_manager')} cm using ({E})
 left join (select {E}, count(distinct work_asgmnt_nbr) af from hist where {PIT} and rec_eff_start_dt_mod >= vantage_date-365 group by {E}) using ({E})
 left join {changes_sql('city_nm', 'cc', 'hp', NOT_MISSING.format('city_nm'))} using ({E}) left join {changes_sql('state_prov_nm', 'sc', 'hp', NOT_MISSING.format('state_prov_nm'))} using ({E})
 left join own using (mgr_sup_id, clnt_obj_id, db_schema, vantage_date) left join span using (mgr_sup_id, clnt_obj_id, db_schema, vantage_date)
 left join (select ooid clnt_obj_id, aoid prsn_obj_id, vantage_date, is_manager_ from snap) using (clnt_obj_id, prsn_obj_id, vantage_date)
 join {turnover_sql('job_cd', 'termination_date', 'job_family_turnover_rate')} r1 using (job_cd, vantage_date)
 join {turnover_sql('mngr_pers_obj_id', 'latest_termination_date', 'team_turnover_rate')} r2 using (mngr_pers_obj_id, vantage_date)
 left join (select {E}, count(distinct mngr_pers_obj_id) mc from hist where {PIT} and mngr_pers_obj_id not in ('UNKNOWN','ONE','','0') group by {E}) using ({E})
 left join {changes_sql('work_loc_cd', 'lch', 'hist')} using ({E})
 left join (select {E}, count(*) filter (where c='PRO' and {RECENT}) np, count(*) filter (where {JOB} and {RECENT}) nj from ee group by {E}) using ({E})
 left join (select clnt_obj_id, flsa_stus_cd, d fd from flsa) using (clnt_obj_id, flsa_stus_cd)""")
def a10(spark, sf):
    return tidy(_full(spark, sf).select(*ENTITY, *FULL).withColumn("compensation_volatility", F.round("compensation_volatility", 4)))


def _full(spark, sf):
    return pipeline.build_features(_sources(spark, sf))


def _sources(spark, sf):
    regions, cpi = _price_index(spark, sf)
    geo, income = _homes(spark, sf)
    return pipeline.Sources(base=fx.base(spark, sf), history=fx.history(spark, sf), leavers=fx.terminations(spark, sf), events=fx.events(spark, sf), places=_places(spark, sf),
                            snapshots=_snapshots(spark, sf), regions=regions, cpi=cpi, flsa=_flsa(spark, sf), people=_monthly(spark, sf), geocodes=geo, income=income, month="199801")


@query("a11_first_version_build")
def a11(spark, sf):
    src = pipeline.Sources(base=fx.base(spark, sf), history=fx.history(spark, sf), leavers=fx.terminations(spark, sf),
                           events=fx.events(spark, sf), places=_places(spark, sf), snapshots=_snapshots(spark, sf))
    f = pipeline.build_first_version(src)
    return tidy(f.select(*ENTITY, "age_at_vantage", "promot_2yr_ind", "transfer_2yr_reloc_ind", "promot_rt", "num_city_chng",
                         "is_manager_ind", "num_job_chng_2yr"))


@query("a9_csv_dimension", "select n_nationkey, n_name, n_regionkey from nation")
def a9(spark, sf):
    path = new_path(spark, "nation-csv")
    read_table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("a12_save_features", f"with {fx.BASE} select {E}, company_size_tier, clnt_obj_id from (select *, case when n<100 then 'Small' when n<1000 then 'Medium' when n<10000 then 'Large' else 'Enterprise' end company_size_tier from (select *, count(*) over (partition by clnt_obj_id, vantage_date) n from base))")
def a12(spark, sf):
    f = pr.add_company_factors_features(fx.base(spark, sf))
    path = new_path(spark, "features")
    save_features(f, [*ENTITY, "company_size_tier", "clnt_obj_id", "not_there"], path=path)
    return spark.read.parquet(path).select(*ENTITY, "company_size_tier", "clnt_obj_id")


@query("a12_catalog_tables", f"""{BH}, {COMP}, t as (select {E}, clnt_obj_id, count(*) over (partition by clnt_obj_id, vantage_date) n from base)
select {E}, clnt_obj_id, case when n<100 then 'Small' when n<1000 then 'Medium' when n<10000 then 'Large' else 'Enterprise' end company_size_tier,
 round(case when nc is null then null when ago is null or ago=0 then 0 else (now_s-ago)/ago end,6) salary_growth_rate_12m, nc is not null as has_history from t left join ca using ({E})""")
def a12_catalog(spark, sf):
    """Features and history through the session catalog: two tables bucketed by the entity, joined without a shuffle."""
    name = lambda kind: f"tenurelens_{kind}_{uuid.uuid4().hex}"
    size = save_bucketed(pr.add_company_factors_features(fx.base(spark, sf)).select(*ENTITY, "clnt_obj_id", "company_size_tier"), name("features"))
    pay = save_bucketed(hi.compensation_aggregates(fx.history(spark, sf)), name("history"))
    both = size.join(pay, ENTITY, "left")
    return tidy(both.select(*ENTITY, "clnt_obj_id", "company_size_tier", "salary_growth_rate_12m", F.col("comp_chang_freq_per_year").isNotNull().alias("has_history")))
