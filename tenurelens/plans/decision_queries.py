"""Registered queries: calibration, thresholds, risk bands, what-ifs, drivers, baselines, tuning."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenurelens.functions.scale import by_shuffle
from tenurelens.operators import aft
from tenurelens.operators import baselines as bl
from tenurelens.operators import calibration as ca
from tenurelens.operators import drivers as dr
from tenurelens.operators import risk as rk
from tenurelens.operators import tuning as tu
from tenurelens.operators import whatif as wi
from tenurelens.plans import fixtures as fx
from tenurelens.plans.model_queries import DIST, INPUTS, RISK, S, SC, cdf_sql, fit_features, ll_sql, risked, surv_sql
from tenurelens.plans.registry import query
from tenurelens.plans.survival_queries import AGE, km_sql, tidy
from tenurelens.schema import ENTITY
from tenurelens.sources.shared import materialize

HZ = "hz(h) as (values (30),(90),(180),(365))"
HR = f"{HZ}, hr as (select s.*, h, 1-{surv_sql('h')} p, cast(time<=h and event=1 as integer) y from scored s, hz)"


def rows(spark, sf, dataset=None):
    s = fx.scored(spark, sf)
    return ca.horizon_rows(s if dataset is None else s.where(F.col("dataset") == dataset), DIST, S)


# pool-adjacent-violators as max over starts of min over ends of block means
ISO = """pt as (select h, p x, sum(y) sy, cast(count(*) as double) w from hr where dataset='val' group by 1,2),
pc as (select *, row_number() over (partition by h order by x) i, sum(sy) over (partition by h order by x) cy, sum(w) over (partition by h order by x) cw from pt),
pj as (select a.h, a.i s, b.i e, (b.cy-a.cy+a.sy)/(b.cw-a.cw+a.w) m from pc a join pc b on a.h=b.h and b.i>=a.i),
pm as (select h, s, e, min(m) over (partition by h, s order by e desc) m from pj),
iso as (select pc.h, pc.x, pc.i, v from pc join (select h, e i, max(m) v from pm group by 1,2) q on q.h=pc.h and q.i=pc.i)"""
CAL = f"{ISO}, cal as (select hr.*, iso.v q from hr join iso on iso.h=hr.h and iso.x=hr.p where dataset='val')"
INTERP = f"""{ISO}, tp as (select distinct h, p x from hr),
lo as (select tp.h, tp.x, max(iso.x) lx, arg_max(iso.v, iso.x) lv from tp join iso on iso.h=tp.h and iso.x<=tp.x group by 1,2),
hi as (select tp.h, tp.x, min(iso.x) hx, arg_min(iso.v, iso.x) hv from tp join iso on iso.h=tp.h and iso.x>=tp.x group by 1,2),
ip as (select tp.h, tp.x, case when lx is null then hv when hx is null then lv when hx=lx then lv else lv+(tp.x-lx)*(hv-lv)/(hx-lx) end q from tp left join lo on lo.h=tp.h and lo.x=tp.x left join hi on hi.h=tp.h and hi.x=tp.x)"""


def pair_sql(name, score):
    return f"""{name}_n as (select h, time, event, {score} s, count(*) n from cal group by all),
{name} as (select a.h, sum(a.n*b.n*(case when b.s<a.s then 1.0 when b.s=a.s then 0.5 else 0 end))/sum(a.n*b.n) c from {name}_n a join {name}_n b on a.h=b.h and (b.time>a.time or (b.time=a.time and b.event=0)) where a.event=1 group by 1)"""


def ece_sql(name, score, src, key="h"):
    return f"""{name} as (select {key}, sum(case when b is not null then n*abs(mp-my) else 0 end)/sum(n) ece from (select {key}, case when {score}>0 then ceil({score}*10) end b, count(*) n, avg({score}) mp, avg(y) my from {src} group by 1,2) group by 1)"""


REPORT = f"""{HR}, {CAL}, {pair_sql('c0', 'p')}, {pair_sql('c1', 'q')}, {ece_sql('e0', 'p', 'cal')}, {ece_sql('e1', 'q', 'cal')},
rp as (select h, avg(y) ar, avg(p) mb, avg(q) ma, avg((p-y)*(p-y)) bb, avg((q-y)*(q-y)) ba from cal group by 1),
rep as (select rp.*, e0.ece eb, e1.ece ea, c0.c cb, c1.c ca, abs(mb-ar)/greatest(abs(ma-ar),0.001) ir from rp join e0 using (h) join e1 using (h) join c0 using (h) join c1 using (h))"""


@query("j1_fit_calibration", f"""{SC}, {REPORT} select h horizon, round(ar,6) actual_rate, round(mb,6) mean_before, round(ma,6) mean_after, round(bb,6) brier_before, round(ba,6) brier_after, round(eb,6) ece_before, round(ea,4) ece_after,
 round(cb,6) c_before, round(ca,6) c_after, round(mb-ar,6) error_before, round(ma-ar,5)+0 error_after, round(ir,4) improvement_ratio, ca>=0.98*cb keeps_discrimination from rep""")
def j1(spark, sf):
    val = rows(spark, sf, "val")
    r = ca.calibration_report(val, ca.fit_isotonic(val))
    r = r.withColumns({"ece_after": F.round("ece_after", 4), "error_after": F.round("error_after", 5) + F.lit(0.0), "improvement_ratio": F.round("improvement_ratio", 4)})
    return tidy(r)


@query("j2_predict_calibrated", f"{SC}, {HR}, {INTERP} select id, hr.h horizon, round(q,5) q from hr join ip on ip.h=hr.h and ip.x=hr.p")
def j2(spark, sf):
    cal = ca.fit_isotonic(rows(spark, sf, "val"))
    return cal.transform(rows(spark, sf)).select("id", "horizon", F.round("q", 5).alias("q"))


@query("j3_validate_calibration", f"""{SC}, {HR}, {INTERP}, v as (select hr.h, avg(y) ar, avg(p) rm, avg(q) cm from hr join ip on ip.h=hr.h and ip.x=hr.p where dataset='oot' group by 1)
select h horizon, round(ar,6) actual_rate, round(rm,6) raw_mean, round(cm,6) calibrated_mean, round(abs(rm-ar),6) raw_error, round(abs(cm-ar),6) calibrated_error, round(abs(rm-ar)/greatest(abs(cm-ar),0.001),4) improvement_factor from v""")
def j3(spark, sf):
    cal = ca.fit_isotonic(rows(spark, sf, "val"))
    v = ca.validate_calibration(rows(spark, sf, "oot"), cal)
    return tidy(v.withColumn("improvement_factor", F.round("improvement_factor", 4)))


@query("j4_ece_equal_width", f"{SC}, {HR}, {ece_sql('e', 'p', 'hr')} select h horizon, round(ece,6) ece from e")
def j4(spark, sf):
    return tidy(ca.ece_equal_width(rows(spark, sf)))


@query("j5_reliability_curve", f"""{SC}, {HR}, qe as (select h, """ + ", ".join(f"quantile_cont(p,{i / 10!r}) e{i}" for i in range(1, 10)) + """ from hr group by 1)
select hr.h horizon, """ + "+".join(f"(case when p>e{i} then 1 else 0 end)" for i in range(1, 10)) + """ bin, round(avg(y),6) fraction_true, round(avg(p),6) mean_predicted, count(*) n from hr join qe on qe.h=hr.h group by 1,2""")
def j5(spark, sf):
    return tidy(ca.reliability_curve(rows(spark, sf)))


@query("j6_calibration_summary", f"""{SC}, {REPORT} select count(*) horizons, round(avg(ir),4) average_improvement, round(avg(eb-ea),4) average_ece_reduction, bool_and(ca>=0.98*cb) discrimination_preserved,
 case when bool_and(ca>=0.98*cb) and avg(ir)>5 then 'strong' when bool_and(ca>=0.98*cb) and avg(ir)>2 then 'deploy' when bool_and(ca>=0.98*cb) then 'optional' else 'caution' end recommendation from rep""")
def j6(spark, sf):
    val = rows(spark, sf, "val")
    s = ca.calibration_recommendation(ca.calibration_report(val, ca.fit_isotonic(val)))
    return s.withColumns({c: F.round(c, 4) for c in ("average_improvement", "average_ece_reduction")})


TT = """sc as (select h, p, sum(y) pos, count(*) n from hr group by 1,2),
tt as (select h, p, sum(pos) over w tp, sum(n) over w - sum(pos) over w fp, sum(pos) over (partition by h) - sum(pos) over w fn,
 sum(n) over (partition by h) - sum(pos) over (partition by h) - (sum(n) over w - sum(pos) over w) tn from sc window w as (partition by h order by p desc))"""
PICK = {"youden": ("tp/cast(tp+fn as double)-fp/cast(fp+tn as double)", "p desc"), "f1": ("2.0*tp/(2*tp+fp+fn)", "p"), "cost": ("-(fp*5000+fn*75000)", "p")}


def pick_sql(method):
    v, o = PICK[method]
    return f"{method} as (select h, p threshold, {'-' if method == 'cost' else ''}({v}) v from tt qualify row_number() over (partition by h order by {v} desc, {o})=1)"


def _threshold_query(method):
    def run(spark, sf):
        return tidy(ca.best_thresholds(ca.threshold_table(rows(spark, sf)), method))
    return run


for _n, _m in (("j7_youden_threshold", "youden"), ("j8_max_f1_threshold", "f1"), ("j9_min_cost_threshold", "cost")):
    query(_n, f"{SC}, {HR}, {TT}, {pick_sql(_m)} select h horizon, round(threshold,6) threshold, round(cast(v as double),6) as value from {_m}")(_threshold_query(_m))


@query("j10_fixed_thresholds", f"""{SC}, {HR}, ft as (select h, p, case h when 30 then 0.1 when 90 then 0.15 when 180 then 0.2 when 365 then 0.3 else 0.15 end::double threshold from hr)
select h horizon, threshold, count(*) n_scored, count(*) filter (where p>=threshold) n_flagged from ft group by 1,2""")
def j10(spark, sf):
    c = ca.confusion(rows(spark, sf), ca.fixed_thresholds(spark))
    return c.select("horizon", "threshold", (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("n_scored"), (F.col("tp") + F.col("fp")).alias("n_flagged"))


def rate_cols(r=6):
    d = lambda a, b: f"round(case when {b}>0 then ({a})/cast({b} as double) else 0 end,{r})"
    n = "(tp+tn+fp+fn)"
    return {"sensitivity": d("tp", "(tp+fn)"), "specificity": d("tn", "(tn+fp)"), "precision": d("tp", "(tp+fp)"), "npv": d("tn", "(tn+fn)"), "accuracy": d("tp+tn", n),
            "f1": d("2*tp", "(2*tp+fp+fn)"), "actual_positive_rate": d("tp+fn", n), "predicted_positive_rate": d("tp+fp", n)}


FIXED = "fx as (select h, case h when 30 then 0.1 when 90 then 0.15 when 180 then 0.2 when 365 then 0.3 end th from hz)"
CONF = f"{FIXED}, cf as (select hr.h, th, count(*) filter (where p>=th and y=1) tp, count(*) filter (where p<th and y=0) tn, count(*) filter (where p>=th and y=0) fp, count(*) filter (where p<th and y=1) fn from hr join fx using (h) group by 1,2)"


@query("j11_confusion", f"{SC}, {HR}, {CONF} select h horizon, cast(th as double) threshold, tp, tn, fp, fn, {', '.join(f'{v} as {k}' for k, v in rate_cols().items())} from cf")
def j11(spark, sf):
    r = rows(spark, sf)
    return tidy(ca.confusion(r, ca.fixed_thresholds(spark)))


@query("j12_threshold_sweep", f"""{SC}, {HR}, {TT}, {pick_sql('youden')}, ths as (select h, threshold th from youden union select h, t from hz, (values (0.05),(0.1),(0.15),(0.2),(0.25),(0.3)) v(t)),
cf as (select hr.h, th, count(*) filter (where p>=th and y=1) tp, count(*) filter (where p<th and y=0) tn, count(*) filter (where p>=th and y=0) fp, count(*) filter (where p<th and y=1) fn from hr join ths on ths.h=hr.h group by 1,2)
select h horizon, round(th,6) threshold, {', '.join(f'{rate_cols()[k]} as {k}' for k in ('sensitivity', 'specificity', 'precision', 'f1'))}, {rate_cols()['predicted_positive_rate']} flagged_pct from cf""")
def j12(spark, sf):
    r = rows(spark, sf)
    return tidy(ca.threshold_sweep(r, ca.best_thresholds(ca.threshold_table(r))))


@query("j13_use_cases", f"""{SC}, {HR}, {CONF} select h horizon, cast(th as double) threshold, case when tp/cast(tp+fp as double)>0.5 then 'High-confidence interventions' when tp/cast(tp+fn as double)>0.7 then 'Broad retention programs' else 'Balanced approach' end use_case,
 {rate_cols()['predicted_positive_rate']} flagged, {rate_cols()['sensitivity']} capture_rate, round(1-tn/cast(tn+fp as double),6) false_alarm_rate, {rate_cols()['precision']} as precision from cf""")
def j13(spark, sf):
    r = rows(spark, sf)
    return tidy(ca.use_cases(ca.confusion(r, ca.fixed_thresholds(spark))))


BAND = f"{RISK}, cu as (select quantile_cont(risk,0.67) hi, quantile_cont(risk,0.33) me from risked), bd as (select r.*, case when risk>=hi then 'High' when risk>=me then 'Medium' else 'Low' end band from risked r, cu)"
BSTAT = "bs as (select band, count(*) n, avg(risk) m, min(risk) mn, max(risk) mx from bd group by 1)"


@query("k1_risk_bands", f"""{SC}, {BAND}, {BSTAT} select band, n, round(100*n/cast(sum(n) over () as double),6) percentage, round(m,6) mean_risk, round(mn,6) min_risk, round(mx,6) max_risk,
 case when 100.0*sum(case when band='High' then n else 0 end) over ()/sum(n) over ()>20 then 'URGENT' else 'MODERATE' end priority from bs""")
def k1(spark, sf):
    return tidy(rk.band_statistics(rk.categorize(risked(spark, sf))))


LINES = "ln(i) as (select i from range(20) t(i)), qq as (select quantile_cont(risk,0.6) h0, quantile_cont(risk,0.8) h1, quantile_cont(risk,0.25) m0, quantile_cont(risk,0.45) m1 from risked), hs as (select h0+(h1-h0)*i/19 hi from qq, ln), ms as (select m0+(m1-m0)*i/19 me from qq, ln)"
OPT = f"""{RISK}, {LINES}, gr as (select hi, me, case when risk>=hi then 2 when risk>=me then 1 else 0 end c, count(*) n, count(*) filter (where event=1) e, sum(time) filter (where event=1) s from risked, hs, ms where me<hi group by 1,2,3),
mm as (select hi, me, sum(n) n, sum(e) e, coalesce(sum(n) filter (where c=2),0) nh, coalesce(sum(n) filter (where c=1),0) nm, var_pop(s/cast(e as double)) filter (where e>10) v, avg(s/cast(e as double)) filter (where e>10) a, count(*) filter (where e>10) k from gr group by 1,2),
op as (select hi, me, case when e<50 or k<2 then 0 else v/(a*a) end sc from mm where nh>=0.05*n and nh<=0.4*n and nm>=0.1*n order by sc desc, hi, me limit 1)"""


@query("k2_optimal_cuts", f"{SC}, {OPT} select round(hi,6) high, round(me,6) medium, round(sc,6) score from op")
def k2(spark, sf):
    return tidy(rk.optimal_cuts(risked(spark, sf)))


@query("k3_validate_cuts", f"""{SC}, {BAND}, a as (select avg(event) filter (where band='High') h, avg(event) filter (where band='Medium') m, avg(event) filter (where band='Low') l, count(*) filter (where band='High') n1, count(*) filter (where band='Low') n0,
 var_samp(event) filter (where band='High') v1, var_samp(event) filter (where band='Low') v0 from bd)
select round(h,6) rate_high, round(m,6) rate_medium, round(l,6) rate_low, round(t,6) t_statistic, round(2*(1-{cdf_sql('abs(t)')}),6) p_value, round(h/greatest(l,0.01),6) discrimination_ratio
 from (select *, (h-l)/sqrt(((n1-1)*v1+(n0-1)*v0)/(n1+n0-2)*(1.0/n1+1.0/n0)) t from a)""")
def k3(spark, sf):
    return tidy(rk.validate_cuts(rk.categorize(risked(spark, sf))))


@query("k4_turnover_cost", f"{SC}, {BAND}, {BSTAT} select band, n, cast(floor(n*m*0.8) as bigint) expected_departures, round(n*m*0.8*75000,4) estimated_cost, round(m*0.8*75000,4) cost_per_employee from bs")
def k4(spark, sf):
    t = rk.turnover_cost(rk.band_statistics(rk.categorize(risked(spark, sf))))
    return t.withColumns({c: F.round(c, 4) for c in ("estimated_cost", "cost_per_employee")})


@query("k5_fixed_bands", f"""{SC}, {RISK} select count(*) population, round(avg(risk),6) mean_risk, round(stddev_pop(risk),6) std_risk, round(100*avg(cast(risk>=0.67 as integer)),6) high_pct,
 round(100*avg(cast(risk>=0.33 and risk<0.67 as integer)),6) medium_pct, round(100*avg(cast(risk<0.33 as integer)),6) low_pct from risked""")
def k5(spark, sf):
    return tidy(rk.band_shares(rk.fixed_bands(risked(spark, sf))))


# --- people with features for what-ifs and drivers, scored by a fixed linear model ---
FEATURES = ["baseline_salary", "salary_growth_rate_12m", "compensation_percentile_company", "peer_salary_ratio", "job_level", "career_stage",
            "time_since_last_promotion", "role_complexity_score", "tenure_in_current_role", "team_size"]
WF = f"""{fx.BASE}, wf as (select person_composite_id, vantage_date, dataset_split, cid, coalesce(baseline_salary,50007.0) baseline_salary, coalesce(baseline_salary,50007.0)/4 avg_salary_last_quarter,
 case when cid%11=0 then null else (cid%40)/100.0 end salary_growth_rate_12m, (cid%100)/100.0 compensation_percentile_company, (cid*3%100)/100.0 compensation_percentile_industry,
 0.5+(cid%20)/10.0 peer_salary_ratio, 0.4+(cid%30)/10.0 sal_nghb_ratio, team_avg_comp, team_size, cast(cid%500 as double) compensation_volatility, mngr_lvl_cd job_level,
 case cid%4 when 0 then 'Early' when 1 then 'Mid' when 2 then 'Late' else 'Senior' end career_stage, cast(cid%3000 as integer) time_since_last_promotion, cast(cid%2500 as integer) days_since_promot,
 cast(cid%2 as integer) promot_2yr_ind, cast(cid%5 as integer) num_promot_2yr, cast(cid%400 as double) promotion_velocity, cast(cid%60 as double) pay_grade_stagnation_months, cast(1+cid%3 as double) role_complexity_score,
 cast(cid%2000 as integer) tenure_in_current_role, cast(cid%2 as integer) job_chng_2yr_ind, cast(cid%7//6 as integer) demot_2yr_ind, cast(cid%11 as double) decision_making_authority_indicator from base)"""


def workforce(spark, sf):
    b, k = fx.base(spark, sf), F.col("cid")
    salary = F.coalesce("baseline_salary", F.lit(50007.0))
    stage = F.when(k % 4 == 0, "Early").when(k % 4 == 1, "Mid").when(k % 4 == 2, "Late").otherwise("Senior")
    i = lambda c: c.cast("int")
    return b.select(
        *ENTITY, "dataset_split", "cid", salary.alias("baseline_salary"), (salary / 4).alias("avg_salary_last_quarter"),
        F.when(k % 11 != 0, k % 40 / 100.0).alias("salary_growth_rate_12m"), (k % 100 / 100.0).alias("compensation_percentile_company"),
        (k * 3 % 100 / 100.0).alias("compensation_percentile_industry"), (0.5 + k % 20 / 10.0).alias("peer_salary_ratio"), (0.4 + k % 30 / 10.0).alias("sal_nghb_ratio"),
        "team_avg_comp", "team_size", (k % 500).cast("double").alias("compensation_volatility"), F.col("mngr_lvl_cd").alias("job_level"), stage.alias("career_stage"),
        i(k % 3000).alias("time_since_last_promotion"), i(k % 2500).alias("days_since_promot"), i(k % 2).alias("promot_2yr_ind"), i(k % 5).alias("num_promot_2yr"),
        (k % 400).cast("double").alias("promotion_velocity"), (k % 60).cast("double").alias("pay_grade_stagnation_months"), (1 + k % 3).cast("double").alias("role_complexity_score"),
        i(k % 2000).alias("tenure_in_current_role"), i(k % 2).alias("job_chng_2yr_ind"), i(F.floor(k % 7 / 6)).alias("demot_2yr_ind"),
        (k % 11).cast("double").alias("decision_making_authority_indicator"))


class LinearEta:
    """Fixed location model of the workforce fixture."""

    def __call__(self, get):
        level = F.coalesce(get("job_level").try_cast("double"), F.lit(0.0))
        senior = F.when(get("career_stage") == "Senior", 0.15).when(get("career_stage") == "Unknown", -0.05).otherwise(0.0)
        return (4.0 + 0.6 * get("baseline_salary") / 100000.0 + 0.8 * F.coalesce(get("salary_growth_rate_12m").cast("double"), F.lit(0.0))
                + 0.4 * get("compensation_percentile_company") + 0.2 * get("peer_salary_ratio") + 0.03 * level + senior
                - 0.0003 * get("time_since_last_promotion") + 0.05 * get("role_complexity_score") - 0.0001 * get("tenure_in_current_role") - 0.004 * get("team_size"))

    def eta(self):
        return self(F.col)


MODEL = LinearEta()


def eta_sql(**new):
    g = lambda c: f"({new.get(c, c)})"
    return f"""(4.0+0.6*{g('baseline_salary')}/100000.0+0.8*coalesce(cast({g('salary_growth_rate_12m')} as double),0)+0.4*{g('compensation_percentile_company')}+0.2*{g('peer_salary_ratio')}
 +0.03*coalesce(try_cast({g('job_level')} as double),0)+(case when {g('career_stage')}='Senior' then 0.15 when {g('career_stage')}='Unknown' then -0.05 else 0 end)-0.0003*{g('time_since_last_promotion')}
 +0.05*{g('role_complexity_score')}-0.0001*{g('tenure_in_current_role')}-0.004*{g('team_size')})"""


def stats(spark, sf):
    w = workforce(spark, sf).where(F.col("dataset_split") == "val").withColumn("eta", MODEL.eta())
    return aft.risk_statistics(w)


WS = f"ws as (select min(-{eta_sql()}) lo, max(-{eta_sql()}) hi from wf where dataset_split='val')"


def risk_sql(e):
    return f"least(greatest((-{e}-lo)/(hi-lo),0),1)"


SAL_B = {"baseline_salary": "baseline_salary*1.15", "salary_growth_rate_12m": "greatest(coalesce(salary_growth_rate_12m,0),0.15)",
         "compensation_percentile_company": "least(coalesce(compensation_percentile_company,0.5)+0.15,0.95)", "peer_salary_ratio": "peer_salary_ratio*1.15"}
SAL_C = {"baseline_salary": "baseline_salary*1.15", "avg_salary_last_quarter": "avg_salary_last_quarter*1.15", "salary_growth_rate_12m": "greatest(coalesce(salary_growth_rate_12m,0.15),0.15)",
         "compensation_percentile_company": "least(compensation_percentile_company+0.15*0.67,0.95)", "compensation_percentile_industry": "least(compensation_percentile_industry+0.15*0.67,0.95)",
         "peer_salary_ratio": "peer_salary_ratio*1.15", "sal_nghb_ratio": "sal_nghb_ratio*1.15", "team_avg_comp": "team_avg_comp+baseline_salary*0.15/team_size", "compensation_volatility": "compensation_volatility*0.7"}
LEVEL = "case when try_cast(job_level as integer) is null then job_level else cast(least(try_cast(job_level as integer)+1,10) as varchar) end"
PRO_B = {"job_level": LEVEL, "time_since_last_promotion": "0", "promotion_velocity": "greatest(promotion_velocity*1.5,30)"}
PRO_C = {"job_level": LEVEL, "career_stage": "case career_stage when 'Early' then 'Mid' when 'Mid' then 'Late' else 'Senior' end", "time_since_last_promotion": "0", "days_since_promot": "0", "promot_2yr_ind": "1",
         "num_promot_2yr": "least(num_promot_2yr+1,3)", "promotion_velocity": "promotion_velocity*1.5", "pay_grade_stagnation_months": "0", "role_complexity_score": "least(role_complexity_score*1.2,5)",
         "tenure_in_current_role": "0", "job_chng_2yr_ind": "1", "demot_2yr_ind": "0"}
ROLE = {"role_complexity_score": "least(role_complexity_score+1,5)", "decision_making_authority_indicator": "least(decision_making_authority_indicator+1,10)", "tenure_in_current_role": "0"}
E = "person_composite_id, vantage_date"


def changed_sql(changes, text=("job_level", "career_stage"), whole=()):
    cols = []
    for c, x in changes.items():
        places = 8 if c == "team_avg_comp" else 6
        cols.append(f"{x} {c}" if c in text else f"cast({x} as integer) {c}" if c in whole else f"round({x},{places}) {c}")
    return f"with {WF} select {E}, {', '.join(cols)} from wf"


def _changed(df, changes):
    return tidy(df.select(*ENTITY, *changes))


WHOLE = ("time_since_last_promotion", "days_since_promot", "promot_2yr_ind", "num_promot_2yr", "tenure_in_current_role", "job_chng_2yr_ind", "demot_2yr_ind", "pay_grade_stagnation_months")


@query("l1_salary_what_if", changed_sql(SAL_B))
def l1(spark, sf):
    return _changed(wi.raise_salary(workforce(spark, sf)), SAL_B)


@query("l1_salary_what_if_causal", changed_sql(SAL_C))
def l1_causal(spark, sf):
    d = wi.raise_salary(workforce(spark, sf), 0.15, "causal")
    return tidy(d.select(*ENTITY, *[c for c in SAL_C if c != "team_avg_comp"])).join(
        d.select(*ENTITY, F.round("team_avg_comp", 8).alias("team_avg_comp")), ENTITY)


@query("l2_promotion_what_if", changed_sql(PRO_B, whole=WHOLE))
def l2(spark, sf):
    return _changed(wi.promote(workforce(spark, sf)), PRO_B)


@query("l2_promotion_what_if_causal", changed_sql(PRO_C, whole=WHOLE))
def l2_causal(spark, sf):
    return _changed(wi.promote(workforce(spark, sf), 1.0, "causal"), PRO_C)


@query("l3_role_change_what_if", changed_sql(ROLE, whole=WHOLE))
def l3(spark, sf):
    return _changed(wi.change_role(workforce(spark, sf)), ROLE)


KINDS = {"salary_increase": SAL_B, "promotion": PRO_B, "role_change": ROLE}
HS = (30, 90, 180, 365)


def ba_sql(kind):
    e0, e1 = eta_sql(), eta_sql(**KINDS[kind])
    s = ", ".join(f"{surv_sql(h, e)} surv{i}_{h}" for h in HS for i, e in ((0, e0), (1, e1)))
    return f"ba as (select {E}, {risk_sql(e0)} risk0, {risk_sql(e1)} risk1, {s}, baseline_salary from wf, ws)"


def before_after(spark, sf, kind):
    return wi.before_after(workforce(spark, sf), MODEL, kind, DIST, S, stats(spark, sf))


IMPACT = "count(*) sample_size, round(avg(risk0),6) risk_before, round(avg(risk1),6) risk_after, round(avg(risk0-risk1),6) mean_risk_reduction, round(stddev_pop(risk0-risk1),6) risk_reduction_std, round(100*avg(cast(risk0-risk1>0 as integer)),6) percentage_improved, " + ", ".join(
    f"round(avg(surv1_{h}-surv0_{h}),6) survival_gain_{h}d" for h in HS)


@query("l4_intervention_impact", " union all ".join(f"(with {WF}, {WS}, {ba_sql(k)} select '{k}' intervention, {IMPACT} from ba)" for k in KINDS))
def l4(spark, sf):
    parts = [wi.impact(before_after(spark, sf, k)).select(F.lit(k).alias("intervention"), "*") for k in KINDS]
    return tidy(reduce(DataFrame.unionByName, parts))


ITE_KINDS = {"salary_increase": SAL_C, "promotion": PRO_C}


def ite_sql(kind):
    return f"(select {E}, 1-{surv_sql(365, eta_sql())} p0, (1-{surv_sql(365, eta_sql())})-(1-{surv_sql(365, eta_sql(**ITE_KINDS[kind]))}) ite from wf)"


ATE = " union all ".join(f"select '{k}' intervention, count(*) sample_size, avg(ite) ate, 100*avg(cast(ite>0 as integer)) rp, stddev_pop(ite)/sqrt(count(*)) se from {ite_sql(k)}" for k in ITE_KINDS)


@query("l5_average_effects", f"with {WF}, a as ({ATE}) select intervention, sample_size, round(ate,6) ate, round(rp,6) responders_pct, round(se,6) standard_error, round(ate/se,4) z, round(2*(1-{cdf_sql('abs(ate/se)')}),6) p_value, ate/se>1.96 significant from a")
def l5(spark, sf):
    e = wi.population_effects(workforce(spark, sf), MODEL, DIST, S)
    return tidy(e.withColumn("z", F.round("z", 4)))


@query("l5_effect_intervals")
def l5_intervals(spark, sf):
    return tidy(wi.effect_intervals(workforce(spark, sf), MODEL, DIST, S))


@query("l5_individual_effects", f"with {WF} select {E}, round(p0,6) p0, round(ite,6) ite, ite>0.05 recommended from {ite_sql('salary_increase')}")
def l5_individual(spark, sf):
    return tidy(wi.individual_effects(workforce(spark, sf), MODEL, "salary_increase", DIST, S))


@query("l6_bootstrap_impact")
def l6(spark, sf):
    return tidy(wi.bootstrap_impact(before_after(spark, sf, "salary_increase")))


@query("l7_paired_test", f"""with {WF}, {WS}, {ba_sql('salary_increase')}, g as (select count(*) n, avg(risk0-risk1) m, stddev_samp(risk0-risk1) s, stddev_pop(risk0) s0 from ba)
select n, round(m/(s/sqrt(n)),4) t_statistic, round(2*(1-{cdf_sql('abs(m/(s/sqrt(n)))')}),6) p_value, round(m/s0,6) effect_size, case when abs(m/s0)>0.8 then 'Large effect' when abs(m/s0)>0.5 then 'Medium effect' else 'Small effect' end interpretation from g""")
def l7(spark, sf):
    t = wi.paired_test(before_after(spark, sf, "salary_increase"))
    return tidy(t.withColumn("t_statistic", F.round("t_statistic", 4)))


UNIT = {"salary_increase": 11250.0, "promotion": 15000.0, "role_change": 5000.0}


@query("l8_return_on_investment", " union all ".join(f"""(with {WF}, {WS}, {ba_sql(k)}, g as (select count(*) n, count(*) filter (where risk0-risk1>0.1) r from ba)
select '{k}' intervention, {u} cost_per_employee, n*{u} total_cost, r retained, r*75000.0 benefit, round((r*75000.0-n*{u})/(n*{u})*100,6) roi_percentage, case when r>0 then round(greatest(n*{u}/(r*75000.0/12),1),6) else cast('infinity' as double) end payback_months from g)""" for k, u in UNIT.items()))
def l8(spark, sf):
    parts = [wi.return_on_investment(before_after(spark, sf, k), k).select(F.lit(k).alias("intervention"), "*") for k in UNIT]
    return tidy(reduce(DataFrame.unionByName, parts))


@query("l9_action_plans", f"""with {WF}, {WS}, {ba_sql('salary_increase')} select {E}, round(risk0,6) risk_score, {', '.join(f'round(surv0_{h},6) survival_{h}d' for h in HS)}, round(risk0-risk1,6) risk_reduction,
 round((risk0-risk1)/greatest(risk0,0.01)*100,6) relative_improvement, case when risk0-risk1>0.05 then 'Positive' else 'Minimal' end expected_outcome, round(baseline_salary*0.15,4) estimated_cost, round(risk0*0.7+(risk0-risk1)*30,6) priority_score from ba where risk0>=0.67""")
def l9(spark, sf):
    a = wi.action_plans(before_after(spark, sf, "salary_increase"))
    return tidy(a.withColumn("estimated_cost", F.round("estimated_cost", 4)))


@query("l10_priority_actions", f"""with {WF}, {WS}, wf0 as (select * from wf), a as ({ATE.replace('from wf)', f'from wf, ws where {risk_sql(eta_sql())}>=0.67)')})
select intervention, round(ate,6) ate, cast(floor(sample_size*ate) as bigint) expected_retention, cast(case intervention when 'salary_increase' then 10000 else 5000 end*sample_size as bigint) estimated_cost,
 case when ate>(case intervention when 'salary_increase' then 0.1 else 0.08 end) then 'Positive' else 'Neutral' end roi_estimate, case when ate>(case intervention when 'salary_increase' then 0.1 else 0.08 end) then 1 else 2 end priority from a where ate>0.03 and ate/se>1.96""")
def l10(spark, sf):
    st = stats(spark, sf)
    w = aft.risk_scores(workforce(spark, sf).withColumn("eta", MODEL.eta()), st)
    cohort = w.where(F.col("risk") >= 0.67).drop("risk", "eta")
    return tidy(wi.priority_actions(wi.population_effects(cohort, MODEL, DIST, S)))


@query("l10_population_summary", f"""with {WF}, {WS}, r as (select {risk_sql(eta_sql())} risk from wf, ws) select count(*) population, round(avg(risk),6) mean_risk, round(stddev_pop(risk),6) std_risk, round(100*avg(cast(risk>=0.67 as integer)),6) high_pct,
 round(100*avg(cast(risk>=0.33 and risk<0.67 as integer)),6) medium_pct, round(100*avg(cast(risk<0.33 as integer)),6) low_pct from r""")
def l10_population(spark, sf):
    w = aft.risk_scores(workforce(spark, sf).withColumn("eta", MODEL.eta()), stats(spark, sf))
    return tidy(rk.band_shares(rk.fixed_bands(w)))


BLANK = {f: "'Unknown'" if f in ("job_level", "career_stage") else "0" for f in FEATURES}
CONTRIB = f"ct as (" + " union all ".join(f"select {E}, '{f}' feature, {risk_sql(eta_sql())}-{risk_sql(eta_sql(**{f: BLANK[f]}))} contribution from wf, ws" for f in FEATURES) + ")"


def drivers(spark, sf):
    return dr.contributions(workforce(spark, sf), MODEL, FEATURES, stats(spark, sf))


@query("m1_contributions", f"with {WF}, {WS}, {CONTRIB} select {E}, feature, round(contribution,6) contribution from ct")
def m1(spark, sf):
    # outer: for a plain explode Spark infers a filter on the array's size and works out every driver once more for it
    d = drivers(spark, sf).select(*ENTITY, F.explode_outer("drivers").alias("d"))
    return tidy(d.select(*ENTITY, "d.feature", "d.contribution"))


SOURCE = {"compensation_percentile_company": "baseline_salary", "peer_salary_ratio": "baseline_salary", "tenure_in_current_role": "time_since_last_promotion"}


@query("m2_fold_to_source", f"""with {WF}, {WS}, {CONTRIB}, s as (select {E}, case feature when 'compensation_percentile_company' then 'baseline_salary' when 'peer_salary_ratio' then 'baseline_salary' when 'tenure_in_current_role' then 'time_since_last_promotion' else feature end source,
 contribution, row_number() over () rn from ct) select {E}, source feature, round(max_by(contribution, abs(contribution)),6) contribution from s group by {E}, source""")
def m2(spark, sf):
    d = dr.fold_to_source(drivers(spark, sf), SOURCE, FEATURES).select(*ENTITY, F.explode_outer("drivers").alias("d"))
    return tidy(d.select(*ENTITY, "d.feature", "d.contribution"))


def ranked_sql(n):
    # equal contributions are ranked by name; rounding keeps both engines on the same side of a tie
    return f"rf as (select *, row_number() over (partition by {E}, side order by -abs(contribution), feature) rank from (select *, case when contribution>0 then 'risk' else 'protective' end side from ct) qualify rank<={n})"


@query("m3_top_factors", f"with {WF}, {WS}, {CONTRIB}, {ranked_sql(3)} select {E}, side, cast(rank as integer) rank, feature, round(contribution,6) contribution from rf")
def m3(spark, sf):
    return tidy(dr.factors_long(dr.top_factors(drivers(spark, sf), 3)))


TOP5 = f"{ranked_sql(5)}, fl as (select {E}, bool_or(feature in ('baseline_salary','compensation_percentile_company','peer_salary_ratio','salary_growth_rate_12m')) s, bool_or(feature in ('time_since_last_promotion','promotion_velocity','pay_grade_stagnation_months','days_since_promot')) p, bool_or(feature in ('time_with_current_manager','team_turnover_rate','team_size','manager_span_control')) t from rf where side='risk' group by {E})"


@query("m4_recommendations", f"""with {WF}, {WS}, {CONTRIB}, {TOP5}, si as {ite_sql('salary_increase')}, pi as {ite_sql('promotion')},
rc as (select {E}, case when si.ite>0.05 then 1 else 2 end priority, '15% Salary Increase' intervention from fl join si using ({E}) where s and ite>0 union all select {E}, case when pi.ite>0.05 then 1 else 2 end, 'Promotion' from fl join pi using ({E}) where p and ite>0
 union all select {E}, 3, 'Team/Manager Discussion' from fl where t) select {E}, priority, intervention from rc""")
def m4(spark, sf):
    w = workforce(spark, sf)
    d = dr.top_factors(drivers(spark, sf), 5)
    for kind, name in (("salary_increase", "salary_ite"), ("promotion", "promotion_ite")):
        d = d.join(wi.individual_effects(w, MODEL, kind, DIST, S).select(*ENTITY, F.col("ite").alias(name)), ENTITY)
    r = dr.recommendations(d, "salary_ite", "promotion_ite").select(*ENTITY, F.explode("recommendations").alias("r"))
    return r.select(*ENTITY, "r.priority", "r.intervention")


@query("m5_common_factors", f"""with {WF}, {WS}, {CONTRIB}, {ranked_sql(3)}, hr as (select {E} from wf, ws where {risk_sql(eta_sql())}>=0.6)
select feature, count(*) n, round(100*count(*)/cast((select count(*) from hr) as double),6) frequency_pct from rf join hr using ({E}) where side='risk' group by 1 order by n desc, feature limit 5""")
def m5(spark, sf):
    return tidy(dr.common_factors(drivers(spark, sf), F.col("risk") >= 0.6))


# --- baselines: the survival fixture with an industry and a demographic stratum ---
BSRC = f"""{fx.SURV}, {fx.BASE}, sd as (select s.*, c_mktsegment industry, tenure_at_vantage_days, {AGE.replace('vantage_date', "date '1998-01-01'")} age from surv s join customer on c_custkey=o_custkey join base on cid=o_custkey and vantage_date=date '1998-01-01'),
sb as (select *, (case when age is null or age<=0 then 'nan' when age<=35 then '<35' when age<=50 then '35-50' else '50+' end) || '_' || (case when tenure_at_vantage_days<=0 then 'nan' when tenure_at_vantage_days/365.25<=2 then '<2yr' when tenure_at_vantage_days/365.25<=5 then '2-5yr' else '5yr+' end) demo_stratum, 'all' one from sd)"""


def baseline_rows(spark, sf):
    """Written once per session: every baseline reads the rows several times."""
    return materialize(spark, "baseline_rows", sf, lambda: build_baseline_rows(spark, sf))


def build_baseline_rows(spark, sf):
    s = fx.survival(spark, sf)
    c = fx.read_table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("industry"))
    b = fx.base(spark, sf).where(F.col("vantage_date") == F.lit("1998-01-01").cast("date")).select(
        "cid", "tenure_at_vantage_days", (F.months_between("vantage_date", "birth_dt") / 12).alias("age_at_vantage"))
    return bl.demographic_stratum(s.join(by_shuffle(c), s.o_custkey == c.c_custkey).join(by_shuffle(b), s.o_custkey == b.cid))


def _parts(spark, sf):
    d = baseline_rows(spark, sf)
    return d.where(F.col("dataset") == "train"), d.where(F.col("dataset") == "val")


def pred_sql(col, least):
    return f"""{km_sql('tk', 'sb', [col], where="dataset='train'")}, sz as (select {col}, max(n_risk) n from tk group by 1 having max(n_risk)>={least}),
ps as (select tk.{col}, coalesce(min(case when t<=365 then S end),1.0) pred from tk join sz using ({col}) group by 1), vp as (select v.*, coalesce(pred,0.5) prediction from sb v left join ps on ps.{col}=v.{col} where dataset='val')"""


def mint_sql():
    return f"""{km_sql('ck', "(select 'all' g1, time, 1-event ce from vp)", ['g1'], 'time', 'ce')}, mw as (select vp.*, 1/greatest((select coalesce(min(S),1.0) from ck where t<=least(vp.time,365)),0.01) w, cast(time<=365 and event=1 as integer) y from vp),
mb as (select sum(w*(1-prediction-y)*(1-prediction-y))/sum(w) b from mw)"""


def kmll_sql(col):
    return f"""st as (select {col}, 0 t, 1.0 S from sz union all select tk.{col}, t, S from tk join sz using ({col})), sn as (select *, lead(t) over (partition by {col} order by t) nt, lead(S) over (partition by {col} order by t) ns from st),
lk as (select v.id, v.event, max_by(sn.S, sn.t) S, max(sn.t) t0, max_by(coalesce(nt,-1), sn.t) nt, max_by(coalesce(ns,-1), sn.t) ns from vp v join sn on sn.{col}=v.{col} and sn.t<=v.time group by 1,2),
ll as (select sum(case when event=1 then ln(greatest((case when nt<0 then 1e-4 else greatest((greatest(S,1e-8)-ns)/(greatest(nt-t0,1)*greatest(S,1e-8)),1e-6) end)*greatest(S,1e-8),1e-8)) else ln(greatest(S,1e-8)) end) ll, count(*) n from lk)"""


CIX = """cn as (select time, event, prediction, count(*) n from vp group by all), cx as (select sum(a.n*b.n*(case when b.prediction>a.prediction then 1.0 when b.prediction=a.prediction then 0.5 else 0 end))/sum(a.n*b.n) c from cn a join cn b on (b.time>a.time or (b.time=a.time and b.event=0)) where a.event=1)"""


def baseline_sql(name, col, least, c="c"):
    return f"(with {BSRC}, {pred_sql(col, least)}, {mint_sql()}, {kmll_sql(col)}, {CIX} select '{name}' baseline, round({c},6) c_index, round(b,6) brier, round(ll,4) log_likelihood from mb, ll, cx)"


def _one(m):
    return tidy(m.withColumn("log_likelihood", F.round("log_likelihood", 4)))


@query("n1_population_km", baseline_sql("population", "one", 1, "0.5"))
def n1(spark, sf):
    return _one(bl.baseline_metrics(*_parts(spark, sf), {}, which=["population"]))


@query("n2_industry_km", baseline_sql("industry", "industry", 10))
def n2(spark, sf):
    return _one(bl.baseline_metrics(*_parts(spark, sf), {"industry": ("industry", 10)}, which=["industry"]))


@query("n3_demographic_km", baseline_sql("demographic", "demo_stratum", 100))
def n3(spark, sf):
    return _one(bl.baseline_metrics(*_parts(spark, sf), {"demographic": ("demo_stratum", 100)}, which=["demographic"]))


@query("n4_random_baseline")
def n4(spark, sf):
    return _one(bl.baseline_metrics(*_parts(spark, sf), {}, which=["random"]))


@query("n5_km_log_likelihood", f"with {BSRC}, {pred_sql('demo_stratum', 100)}, {kmll_sql('demo_stratum')} select round(ll,4) log_likelihood, n from ll")
def n5(spark, sf):
    out = bl.km_log_likelihood(*_parts(spark, sf), "demo_stratum", 100)
    return out.select(F.round("log_likelihood", 4).alias("log_likelihood"), "n")


@query("n6_min_time_brier", f"with {BSRC}, {pred_sql('industry', 10)}, {mint_sql()} select round(b,6) brier from mb")
def n6(spark, sf):
    return tidy(bl.min_time_brier(bl.km_predictions(*_parts(spark, sf), "industry", 10)))


COMPARED = {"c_index": 0.62, "brier": 0.2, "log_likelihood": -9000.0}


@query("n7_compare_to_model", f"""with m as ({baseline_sql('population', 'one', 1, '0.5').replace('round(b,6)', 'b').replace('round(ll,4)', 'll')} union all {baseline_sql('industry', 'industry', 10).replace('round(c,6)', 'c').replace('round(b,6)', 'b').replace('round(ll,4)', 'll')}
 union all {baseline_sql('demographic', 'demo_stratum', 100).replace('round(c,6)', 'c').replace('round(b,6)', 'b').replace('round(ll,4)', 'll')})
select baseline, round(0.62-c_index,6) c_index_gain, round(brier-0.2,6) brier_gain, round(-9000-log_likelihood,4) log_likelihood_gain,
 case when 0.62-max(c_index) over ()>=0.1 then 'RECOMMEND DEPLOYMENT' when 0.62-max(c_index) over ()>=0.05 then 'CONDITIONAL DEPLOYMENT' else 'NOT RECOMMENDED' end recommendation from m""")
def n7(spark, sf):
    m = bl.baseline_metrics(*_parts(spark, sf), {"industry": ("industry", 10), "demographic": ("demo_stratum", 100)}, which=["population", "industry", "demographic"])
    out = bl.compare_to_model(m, COMPARED)
    return tidy(out.withColumn("log_likelihood_gain", F.round("log_likelihood_gain", 4)))


# SQL can't fit; it knows where a fit must end: every candidate once, at a place where the gradient is zero, and with the scale it was given
O1_SCALES = (None, 0.8)


@query("o1_model_search", "select row_number() over ()::integer trial, dist, ridge::double ridge, scale, 0.0 gradient, true as scale_as_asked, true as fitted_scale_best, true as scored from (" + " union all ".join(
    f"select '{d}' dist, {r} ridge, {s or 'null'}::double scale" for d in ("logistic", "extreme") for r in (0, 100) for s in O1_SCALES) + ")")
def o1(spark, sf):
    d = fit_features(spark, sf)
    train, val = (d.where(F.col("dataset") == x) for x in ("train", "val"))
    t = tu.run_trials(train, val, INPUTS, tu.candidate_grid(("logistic", "extreme"), (0.0, 100.0), O1_SCALES))
    asked = F.col("scale").isNull() | (F.abs(F.col("scale") - F.col("sigma")) < 1e-12)
    free = F.max(F.when(F.col("scale").isNull(), F.col("loglik"))).over(W.partitionBy("dist", "ridge"))
    scored = F.col("c_index").between(0, 1) & F.col("calibration_slope").between(-1, 1) & (F.abs("score") < float("inf"))
    return t.select("trial", "dist", "ridge", "scale", (F.round("gradient", 5) + 0.0).alias("gradient"), asked.alias("scale_as_asked"), (F.col("loglik") <= free).alias("fitted_scale_best"), scored.alias("scored"))


# a trial history derived from the data: scores of the scale grid in grid order, group sizes as seconds
TRIALS = f"""gr as (select i+1 trial, 0.1+(6.0-0.1)*(i*37%100)/99 s from range(100) t(i)), tr as (select trial, -avg({ll_sql('logistic', 's')}) score, cast(count(*) as double) as seconds from scored, gr where dataset='val' group by trial)"""


def trials(spark, sf):
    val = fx.scored(spark, sf).where(F.col("dataset") == "val")
    grid = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("trial"), F.lit(0.1 + 5.9 * (i * 37 % 100) / 99).alias("s")) for i in range(100)]))
    d = val.select("time", "event", "eta", grid.alias("g")).select("time", "event", "eta", "g.*")
    return d.groupBy("trial").agg((-F.avg(aft.log_likelihood_term("logistic", F.col("s")))).alias("score"), F.count(F.lit(1)).cast("double").alias("seconds"))


@query("o2_trial_history", f"{SC}, {TRIALS}, b as (select *, min(score) over (order by trial) best from tr) select cast(trial as integer) trial, round(score,6) score, seconds, round(best,6) best_score, round(best-lag(best) over (order by trial),6) improvement from b")
def o2(spark, sf):
    return tidy(tu.trial_history(trials(spark, sf)))


@query("o2_convergence", f"""{SC}, {TRIALS}, b as (select *, min(score) over (order by trial) best from tr), i as (select *, best-lag(best) over (order by trial) im, row_number() over (order by trial desc) bk from b)
select round(min(score),6) final_score, round(arg_min(score,trial)-min(score),6) total_improvement, round(avg(im) filter (where bk<=10),6)+0 convergence_rate, round(stddev_pop(im) filter (where bk<=20),6) stability,
 round(sum(seconds)/3600,6) total_compute_hours, round(avg(seconds)/60,6) average_trial_minutes from i""")
def o2_convergence(spark, sf):
    return tidy(tu.convergence(trials(spark, sf)))
