"""Registered queries: AFT scoring, evaluation metrics and diagnostics on the scored fixture."""
from __future__ import annotations

from pyspark.sql import functions as F

from tenurelens.operators import aft
from tenurelens.operators import diagnostics as dg
from tenurelens.operators import metrics as mt
from tenurelens.plans import fixtures as fx
from tenurelens.plans.registry import query
from tenurelens.plans.survival_queries import erf_sql, km_sql, tidy

S, DIST = fx.SIGMA, "logistic"
H = [30, 90, 180, 365]
SC = f"with {fx.SCORED}"


def cdf_sql(z):
    return f"(0.5*(1.0+{erf_sql(f'({z})/1.4142135623730951')}))"


def logsf_sql(z):
    i = f"(1.0/(({z})*({z})))"
    return f"(case when {z}>4.0 then -({z})*({z})/2.0-ln(({z})*2.5066282746310002)+ln(1-{i}*(1.0-3.0*{i}*(1.0-5.0*{i}))) else ln(greatest(1.0-{cdf_sql(z)},1e-300)) end)"


def surv_sql(t, eta="eta", dist=DIST, sigma=S, clip=True):
    z = f"((ln({t})-{eta})/{sigma})"
    raw = {"logistic": f"(1.0/(1.0+exp({z})))", "extreme": f"exp(-exp({z}))", "normal": f"(1.0-{cdf_sql(z)})"}[dist]
    return f"least(greatest({raw},1e-6),1-1e-6)" if clip else raw


Z = f"((ln(time)-eta)/{S})"


def ll_sql(dist, sigma=S):
    z = f"((ln(time)-eta)/{sigma})"
    ls = f"ln({sigma})"
    return {"normal": f"case when event=1 then -{z}*{z}/2.0-0.9189385332046727-{ls} else {logsf_sql(z)} end",
            "logistic": f"case when event=1 then {z}-2*ln(1+exp({z}))-{ls} else -ln(1+exp({z})) end",
            "extreme": f"case when event=1 then {z}-exp({z})-{ls} else -exp({z}) end"}[dist]


@query("g1_log_likelihood", f"{SC} " + " union all ".join(
    f"select dataset, '{d}' dist, round(sum({ll_sql(d)}),4) loglik, round(-avg({ll_sql(d)}),6) objective from scored group by dataset" for d in aft.DISTRIBUTIONS))
def g1(spark, sf):
    out = aft.log_likelihood(fx.scored(spark, sf), S, ["dataset"])
    return out.select("dataset", "dist", F.round("loglik", 4).alias("loglik"), F.round("objective", 6).alias("objective"))


GRID = "grid as (select 0.1+(6.0-0.1)*i/99 s from range(100) t(i))"


@query("g2_scale_grid_search", f"""{SC}, {GRID}, cells as (""" + " union all ".join(
    f"select '{d}' dist, s sigma, sum({ll_sql(d, 's')}) loglik from scored, grid where dataset='val' group by s" for d in aft.DISTRIBUTIONS) +
    ") select dist, round(sigma,6) sigma, round(loglik,4) loglik from cells order by loglik desc limit 1")
def g2(spark, sf):
    val = fx.scored(spark, sf).where(F.col("dataset") == "val")
    b = aft.best_cell(aft.grid_likelihood(val))
    return b.select("dist", F.round("sigma", 6).alias("sigma"), F.round("loglik", 4).alias("loglik"))


def fit_features(spark, sf):
    s = fx.survival(spark, sf)
    return s.select("id", "dataset", "time", "event", F.log("o_totalprice").alias("log_price"),
                    (F.col("o_orderstatus") == "F").cast("double").alias("is_f"), (F.col("o_orderstatus") == "P").cast("double").alias("is_p"),
                    F.substring("stratum", 1, 1).cast("double").alias("priority"))


INPUTS = ["log_price", "is_f", "is_p", "priority"]


@query("g3_fit_aft")
def g3(spark, sf):
    train = fit_features(spark, sf).where(F.col("dataset") == "train")
    rows = []
    for m in aft.fit_candidates(train, INPUTS, [aft.Candidate(d) for d in aft.DISTRIBUTIONS]):
        rows += [(m.dist, n, round(float(v), 4)) for n, v in [("intercept", m.intercept), ("sigma", m.sigma), *zip(m.features, m.coefficients)]]
    return spark.createDataFrame(rows, "dist string, parameter string, value double")


@query("g4_survival_curves", f"""{SC} select dataset, t, round(avg({surv_sql('t')}),6) mean_surv, round(min({surv_sql('t')}),6) min_surv, round(max({surv_sql('t')}),6) max_surv
from scored, range(1,366) r(t) group by 1,2""")
def g4(spark, sf):
    c = aft.survival_curves(fx.scored(spark, sf), DIST, S, keep=("id", "dataset"))
    return tidy(c.groupBy("dataset", "t").agg(F.avg("surv").alias("mean_surv"), F.min("surv").alias("min_surv"), F.max("surv").alias("max_surv")))


@query("g5_survival_at_horizons", f"{SC} select id, " + ", ".join(f"round({surv_sql(h, dist=d)},6) {d}_{h}d" for d in aft.DISTRIBUTIONS for h in H) + " from scored")
def g5(spark, sf):
    s = fx.scored(spark, sf)
    return tidy(s.select("id", *[aft.survival(d, aft.zscore(F.lit(h), "eta", S)).alias(f"{d}_{h}d") for d in aft.DISTRIBUTIONS for h in H]))


RISK = "r as (select min(-eta) lo, max(-eta) hi from scored where dataset='val'), risked as (select s.*, least(greatest((-eta-lo)/(hi-lo),0),1) risk from scored s, r)"


def risked(spark, sf):
    s = fx.scored(spark, sf)
    return aft.risk_scores(s, aft.risk_statistics(s.where(F.col("dataset") == "val")))


@query("g6_risk_scores", f"{SC}, {RISK} select id, round(risk,6) risk from risked")
def g6(spark, sf):
    return tidy(risked(spark, sf).select("id", "risk"))


@query("g7_scale_estimates", f"""{SC}, r as (select dataset, ln(time)-eta r from scored where event=1), m as (select dataset, median(r) m from r group by 1),
d as (select dataset, median(abs(r-m)) mad from r join m using (dataset) group by 1)
select dataset, count(*) n, round(greatest(sqrt(sum(r*r)/count(*)),0.1),6) sigma_normal, round(greatest(any_value(mad)/0.6744897501960817,0.1),6) sigma_robust,
 round(greatest(stddev_pop(r)*sqrt(3)/pi(),0.1),6) sigma_logistic, round(greatest(stddev_pop(r)*sqrt(6)/pi(),0.1),6) sigma_extreme from r join d using (dataset) group by dataset""")
def g7(spark, sf):
    return tidy(aft.residual_scales(fx.scored(spark, sf), ["dataset"]))


@query("g7_mle_scale")
def g7_mle(spark, sf):
    val = fx.scored(spark, sf).where(F.col("dataset") == "val")
    return tidy(aft.mle_scale(val, "logistic").unionByName(aft.mle_scale(val, "extreme")))


PHI = f"(exp(-{Z}*{Z}/2.0-0.9189385332046727)/({S}*time))"


@query("g8_hazards", f"""{SC} select id, round(exp({Z})/({S}*time*(1+exp({Z}))),6) hz_logistic, round(exp({Z})/({S}*time),6) hz_extreme,
 round({PHI}/({surv_sql('time', dist='normal', clip=False)}+1e-8),6) hz_normal from scored""")
def g8(spark, sf):
    s = fx.scored(spark, sf)
    return tidy(s.select("id", *[aft.hazard(d, S).alias(f"hz_{d}") for d in aft.DISTRIBUTIONS]))


PAIRS = """cnt as (select dataset, time, event, eta, count(*) n from scored group by all),
cix as (select a.dataset, sum(a.n*b.n*(case when b.eta>a.eta then 1.0 when b.eta=a.eta then 0.5 else 0 end))/sum(a.n*b.n) c, sum(a.n*b.n) pairs
 from cnt a join cnt b on a.dataset=b.dataset and (b.time>a.time or (b.time=a.time and b.event=0)) where a.event=1 group by a.dataset)"""


@query("g9_dataset_metrics", f"""{SC}, {PAIRS} select dataset, round(any_value(c),6) c_index, count(*) sample_size, round(avg(event),6) event_rate, round(avg(eta),6) mean_log, round(stddev_pop(eta),6) std_log,
 round(avg(exp(eta)),6) mean_time, round(stddev_pop(exp(eta)),6) std_time, round(max(exp(eta))-min(exp(eta)),6) range_time, round(stddev_pop(exp(eta))/avg(exp(eta)),6) coefficient_of_variation
from scored join cix using (dataset) group by dataset""")
def g9(spark, sf):
    s = fx.scored(spark, sf)
    c = mt.concordance(s.withColumn("risk", -F.col("eta")), "risk").select("dataset", "c_index")
    return tidy(aft.prediction_statistics(s).drop("unique_predictions").join(c, "dataset"))


@query("g10_feature_importance")
def g10(spark, sf):
    train = fit_features(spark, sf).where(F.col("dataset") == "train")
    lineage = spark.createDataFrame([("log_price", "o_totalprice", "log_transform"), ("is_f", "o_orderstatus", "categorical_encoding"),
                                     ("is_p", "o_orderstatus", "categorical_encoding")], "feature string, source string, step string")
    return tidy(aft.feature_importance(aft.fit_aft(train, INPUTS, "extreme"), train, lineage))


@query("g11_curve_quality", f"""{SC}, x as (select dataset, {surv_sql(365)} l, {surv_sql(30)} f from scored)
select dataset, round(var_pop(l),6) curve_variance, round(avg(l),6) mean_final_survival, round(max(l)-min(l),6) survival_range, round(avg(f),6) mean_initial_survival,
 round(avg(f)-avg(l),6) survival_decline, round(stddev_pop(l)/avg(l),6) coefficient_of_variation from x group by dataset""")
def g11(spark, sf):
    return tidy(aft.curve_quality(fx.scored(spark, sf), DIST, S))


@query("g11_monotonicity", f"{SC} select 0 violations, count(*)*365 points from scored")
def g11_mono(spark, sf):
    return aft.monotonicity_violations(fx.scored(spark, sf), DIST, S)


GC = km_sql("g", "(select dataset, time, 1-event ce from scored)", ["dataset"], "time", "ce") + ", gs as (select *, coalesce(lag(S_left) over (partition by dataset order by t),1.0) S_shift from g)"


def rows_sql(horizons=H, used="h", left="S_left", dist=DIST, src="scored"):
    """CTEs g (censoring curve) and ``er`` (rows x horizons with weights and p)."""
    hz = ",".join(f"({h})" for h in horizons)
    return f"""{GC}, hz(h) as (values {hz}), ends as (select dataset, max(t) tmax from g group by 1),
hp as (select dataset, h, {used} u from ends, hz), gh as (select hp.dataset, h, u, coalesce(min(case when t<=u then S end),1.0) Gh from hp join g using (dataset) group by 1,2,3),
er as (select s.*, h, u, greatest({left},1e-12) GT, greatest(Gh,1e-12) Gh, time<=u and event=1 is_case, time>u is_control, 1-{surv_sql('u', dist=dist)} p
 from {src} s join gs on gs.dataset=s.dataset and gs.t=s.time join gh on gh.dataset=s.dataset)"""


ADJ = "case when h>=tmax then tmax-1 else h end"
GRAF = "avg(case when is_case then (1-p)*(1-p)/GT when is_control then p*p/Gh else 0 end)"


@query("i1_censoring_curve", f"{SC}, {GC} select dataset, t, round(S,6) G_right, round(S_left,6) G_left, round(S_shift,6) G_left_shifted from gs")
def i1(spark, sf):
    return tidy(mt.censoring_curve(fx.scored(spark, sf)))


@query("i2_step_lookup", f"""{SC}, {GC}, p(point) as (values (1),(45),(200),(365),(500))
select dataset, point, round(coalesce(min(case when t<=point then S end),1.0),6) G, round(coalesce(min(case when t<point then S end),1.0),6) G_before from g, p group by 1,2""")
def i2(spark, sf):
    c, pts = mt.censoring_curve(fx.scored(spark, sf)), [1, 45, 200, 365, 500]
    b = mt.step_lookup(c, ["dataset"], pts, left=True).withColumnRenamed("G", "G_before")
    return tidy(mt.step_lookup(c, ["dataset"], pts).join(b, ["dataset", "point"]))


@query("i3_ipcw_weights", f"""{SC}, {GC}, w as (select s.id, s.dataset, 1/greatest(S,0.01) w from scored s join g on g.dataset=s.dataset and g.t=s.time)
select id, round(w*count(*) over (partition by dataset)/sum(w) over (partition by dataset),6) ipcw from w""")
def i3(spark, sf):
    return tidy(mt.ipcw_weights(fx.scored(spark, sf)).select("id", "ipcw"))


def cut(x, n):
    return f"least(1/greatest({x},1e-8),{n})"


NORMED = f"sum(case when is_case then {cut('GT', 100)}*(1-p)*(1-p) when is_control then {cut('Gh', 100)}*p*p else 0 end)/sum(case when is_case then {cut('GT', 100)} when is_control then {cut('Gh', 100)} else 0 end)"


@query("i4_brier", f"""{SC}, {rows_sql()} select dataset, h horizon, round({GRAF},6) graf, round({NORMED},6) normalised, round(avg((cast(is_case as integer)-p)*(cast(is_case as integer)-p)),6) plain from er group by 1,2""")
def i4(spark, sf):
    rows = mt.evaluation_rows(fx.scored(spark, sf), DIST, S)
    out = None
    for v in ("graf", "normalised", "plain"):
        b = mt.brier(rows, variant=v).withColumnRenamed("brier", v)
        out = b if out is None else out.join(b, ["dataset", "horizon"])
    return tidy(out)


@query("i4_brier_shifted_lookup", f"{SC}, {rows_sql(left='S_shift')} select dataset, h horizon, round({GRAF},6) brier from er group by 1,2")
def i4_shifted(spark, sf):
    return tidy(mt.brier(mt.evaluation_rows(fx.scored(spark, sf), DIST, S, variant="shifted")))


@query("i4_brier_details", f"""{SC}, {rows_sql(dist='extreme')} select dataset, h horizon, round({GRAF},6) brier, count(*) filter (where is_case) n_events, count(*) filter (where is_control) n_at_risk,
 round(avg(p),6) event_probs_mean, round(stddev_pop(p),6) event_probs_std, round(coalesce(count(*) filter (where is_case)/nullif(cast(count(*) filter (where is_case or is_control) as double),0),0),6) actual_event_rate,
 round(abs(coalesce(count(*) filter (where is_case)/nullif(cast(count(*) filter (where is_case or is_control) as double),0),0)-avg(p)),6) calibration_gap from er group by 1,2""")
def i4_details(spark, sf):
    return tidy(mt.brier_details(mt.evaluation_rows(fx.scored(spark, sf), "extreme", S)))


def ibs_sql(horizons, value=GRAF, zero=True, x="h"):
    first = ("coalesce(lag(x) over w,0)", "coalesce(lag(b) over w,0.0)") if zero else ("lag(x) over w", "lag(b) over w")
    den = "max(x)" if zero else "(max(x)-min(x))"
    return f"""{rows_sql(horizons)}, bs as (select dataset, {x} x, {value} b from er group by dataset, h),
tr as (select *, (x-{first[0]})*(b+{first[1]})/2.0 a from bs window w as (partition by dataset order by x)), ibs as (select dataset, sum(a)/{den} ibs from tr group by 1)"""


DAYS180 = list(range(1, 181))
PICKED = DAYS180
POINTS = [1 + 363 * i / 29 for i in range(30)]
XMAP = "case h " + " ".join(f"when {int(x)} then {x!r}" for x in POINTS) + " end"


@query("i5_integrated_brier", f"{SC}, {ibs_sql(PICKED)} select dataset, round(ibs,6) ibs from ibs")
def i5(spark, sf):
    return tidy(mt.integrated_brier(fx.scored(spark, sf), DIST, S, 180))


# the default grid goes on from day 365 in half years, up to the 90th percentile of the event times
DEFAULT_GRID = ibs_sql([30]).replace("hz(h) as (values (30))", """hz(h) as (select unnest([30,60,90,180,270,360])
 union select unnest(range(365, cast(ceil(quantile_cont(time,0.9)) as integer), 182)) from scored where event=1)""")


@query("i5_integrated_brier_default_grid", f"{SC}, {DEFAULT_GRID} select dataset, round(ibs,6) ibs from ibs")
def i5_default(spark, sf):
    return tidy(mt.integrated_brier(fx.scored(spark, sf), DIST, S))


@query("i5_integrated_brier_span", f"{SC}, {ibs_sql([int(x) for x in POINTS], NORMED, False, XMAP)} select dataset, round(ibs,6) ibs from ibs")
def i5_span(spark, sf):
    return tidy(mt.integrated_brier(fx.scored(spark, sf), DIST, S, variant="normalised"))


AUC = """ag as (select dataset, h, p, sum(case when is_case then 1/GT else 0 end) wc, sum(case when is_control then 1/Gh else 0 end) wu from er where is_case or is_control group by 1,2,3),
ac as (select *, sum(wu) over (partition by dataset, h order by p) cum from ag), auc as (select dataset, h, sum(wc*(cum-0.5*wu))/(sum(wc)*sum(wu)) auc from ac group by 1,2)"""


@query("i6_time_dependent_auc", f"{SC}, {rows_sql(used=ADJ)}, {AUC} select dataset, h horizon, round(auc,6) auc from auc")
def i6(spark, sf):
    return tidy(mt.auc(mt.evaluation_rows(fx.scored(spark, sf), DIST, S, adjust=True)))


@query("i7_gini", f"{SC}, {rows_sql([364], ADJ)}, {AUC} select dataset, h horizon, round(auc,6) auc, round(least(greatest(2*auc-1,0),1),6) gini from auc")
def i7(spark, sf):
    return tidy(mt.gini(fx.scored(spark, sf), DIST, S))


@query("i7_lorenz_gini", f"""{SC}, g as (select dataset, 1.0/(exp(eta)+1.0) r, cast(count(*) as double) n, cast(sum(event) as double) e from scored group by 1,2),
c as (select *, sum(n) over w cn, sum(e) over w ce, sum(n) over (partition by dataset) tn, sum(e) over (partition by dataset) te, first_value(e/n) over w fr from g window w as (partition by dataset order by r desc)),
a as (select dataset, sum(n*(ce-0.5*e))/(max(tn)*max(te))-max(fr)/(2*max(tn)*max(te)) auc, sum(least(greatest(floor(tn/10)+1-(cn-n),0),n)*e/n)/max(te) cap from c group by 1)
select dataset, round(auc,6) auc_lorenz, round(cap,6) top_decile_capture, round(least(greatest(2*auc-1,0),1),6) gini from a""")
def i7_lorenz(spark, sf):
    return tidy(mt.lorenz(fx.scored(spark, sf).withColumn("r", 1.0 / (F.exp("eta") + 1.0)), "r"))


@query("i8_concordance", f"{SC}, {PAIRS} select dataset, round(c,6) c_index, cast(pairs as double) comparable_pairs from cix")
def i8(spark, sf):
    return tidy(mt.concordance(fx.scored(spark, sf).withColumn("risk", -F.col("eta")), "risk"))


def edges_sql(src, value="p", n=10, by="dataset, h"):
    return f"qe as (select {by}, " + ", ".join(f"quantile_cont({value},{i / n!r}) e{i}" for i in range(1, n)) + f" from {src} group by {by})"


BIN = "+".join(f"(case when p>=e{i} then 1 else 0 end)" for i in range(1, 10))


def ece_sql(src, w):
    return f"""{edges_sql(src)}, qb as (select x.dataset, x.h, {BIN} bin, sum({w}) w, sum(({w})*p) wp, sum(({w})*cast(is_case as integer)) wo, count(*) n from {src} x join qe on qe.dataset=x.dataset and qe.h=x.h group by 1,2,3),
ece as (select dataset, h, sum(abs(wp-wo))/sum(w) ece, sum(n) n from qb group by 1,2)"""


W_ALL = "case when is_case then 1/GT when is_control then 1/Gh else 0 end"
W_CUT = f"case when is_case then {cut('GT', 50)} when is_control then {cut('Gh', 50)} else 0 end"
FEWER = "case when (select count(*) from scored s where s.dataset=ends.dataset and s.time>h)<1000 then h-1 else h end"


@query("i9_ece_ipcw", f"{SC}, {rows_sql()}, {ece_sql('er', W_ALL)} select dataset, h horizon, round(ece,6) ece from ece")
def i9(spark, sf):
    return tidy(mt.ece_ipcw(mt.evaluation_rows(fx.scored(spark, sf), DIST, S)))


@query("i9_ece_ipcw_valid", f"{SC}, {rows_sql(used=FEWER)}, ev as (select * from er where is_case or is_control), {ece_sql('ev', W_CUT)} select dataset, h horizon, case when n>=100 then round(ece,6) end ece from ece")
def i9_valid(spark, sf):
    return tidy(mt.ece_ipcw(mt.evaluation_rows(fx.scored(spark, sf), DIST, S, min_controls=1000), variant="valid"))


EVALUABLE = """wb as (select dataset, h, least(floor(p*10),9) bin, count(*) n, avg(p) mp, avg(cast(is_case as integer)) mo from er where event=1 or time>h group by 1,2,3),
we as (select dataset, h, case when sum(n)>=100 then sum(case when n>10 then n*abs(mp-mo) else 0 end)/sum(n) end ece from wb group by 1,2)"""


@query("i10_ece_evaluable", f"{SC}, {rows_sql()}, {EVALUABLE} select dataset, h horizon, round(ece,6) ece from we")
def i10(spark, sf):
    return tidy(mt.ece_evaluable(mt.evaluation_rows(fx.scored(spark, sf), DIST, S)))


CURVE = """kw as (select s.id, 1/greatest(g.S,0.01) w0 from scored s join g on g.dataset=s.dataset and g.t=s.time),
kn as (select id, w0*count(*) over (partition by dataset)/sum(w0) over (partition by dataset) w from kw join scored using (id)),
cc as (select dataset, h, cast(least(floor(p*10),9) as integer) bin, sum(w*p)/sum(w) predicted, sum(w*cast(is_case as integer))/sum(w) observed, sum(w) weight from er join kn using (id) group by 1,2,3)"""


@query("i11_calibration_curve", f"{SC}, {rows_sql()}, {CURVE} select dataset, h horizon, bin, round(predicted,6) predicted, round(observed,6) observed, round(weight,6) weight from cc")
def i11(spark, sf):
    return tidy(mt.calibration_curve(fx.scored(spark, sf), DIST, S))


@query("i11_ece_weighted", f"{SC}, {rows_sql()}, {CURVE} select dataset, h horizon, round(sum(weight*abs(predicted-observed))/sum(weight),6) ece from cc group by 1,2")
def i11_ece(spark, sf):
    return tidy(mt.ece_weighted(mt.calibration_curve(fx.scored(spark, sf), DIST, S)))


SUMMARY = """cs as (select dataset, avg(ece) a, stddev_pop(ece) s, case when avg(ece)<=0.05 and stddev_pop(ece)<=0.02 then 'Excellent' when avg(ece)<=0.1 and stddev_pop(ece)<=0.05 then 'Good' when avg(ece)<=0.15 then 'Fair' else 'Poor' end q from we group by 1)"""


@query("i12_calibration_summary", f"{SC}, {rows_sql()}, {EVALUABLE}, {SUMMARY} select dataset, round(a,6) average_ece, round(s,6) ece_std, q calibration_quality from cs")
def i12(spark, sf):
    return tidy(mt.calibration_summary(mt.ece_evaluable(mt.evaluation_rows(fx.scored(spark, sf), DIST, S))))


def label(x, limits, op, last="'Poor'"):
    return "case " + " ".join(f"when {x}{op}{v} then '{n}'" for v, n in limits) + f" else {last} end"


def grade(x):
    return f"(case {x} when 'Excellent' then 4 when 'Good' then 3 when 'Fair' then 2 else 1 end)"


CURVE_COLS = ["curve_variance", "mean_final_survival", "survival_range", "mean_initial_survival", "survival_decline", "coefficient_of_variation"]
# gini looks at day 364, hence a second set of rows (er2)
PERF = f"""{rows_sql()}, {EVALUABLE}, {SUMMARY}, bs as (select dataset, h x, {GRAF} b from er group by dataset, h),
p3(h, x) as (values {','.join(f'({int(x)},{x!r})' for x in POINTS)}), g3 as (select dataset, h, x, coalesce(min(case when t<=h then S end),1.0) Gh from g, p3 group by 1,2,3),
er3 as (select s.dataset, g3.x, greatest(S_left,1e-12) GT, greatest(Gh,1e-12) Gh, time<=h and event=1 is_case, time>h is_control, 1-{surv_sql('h')} p from scored s join gs on gs.dataset=s.dataset and gs.t=s.time join g3 on g3.dataset=s.dataset),
b3 as (select dataset, x, {NORMED} b from er3 group by 1,2), t3 as (select *, (x-lag(x) over w)*(b+lag(b) over w)/2.0 a from b3 window w as (partition by dataset order by x)),
ib3 as (select dataset, sum(a)/(max(x)-min(x)) ibs from t3 group by 1), ib as (select dataset, ibs, mb from ib3 join (select dataset, avg(b) mb from bs group by 1) using (dataset)), {PAIRS},
cq as (select dataset, var_pop(l) curve_variance, avg(l) mean_final_survival, max(l)-min(l) survival_range, avg(f) mean_initial_survival, avg(f)-avg(l) survival_decline, stddev_pop(l)/avg(l) coefficient_of_variation
 from (select dataset, {surv_sql(365)} l, {surv_sql(30)} f from scored) group by 1),
er2 as (select s.*, 364 h, greatest(S_left,1e-12) GT, greatest(gg.S,1e-12) Gh, time<=364 and event=1 is_case, time>364 is_control, 1-{surv_sql(364)} p from scored s join gs on gs.dataset=s.dataset and gs.t=s.time
 join (select dataset, min(S) S from g where t<=364 group by 1) gg on gg.dataset=s.dataset),
{AUC.replace(' er ', ' er2 ')},
hg as (select dataset, h, p, sum(case when is_case then 1/GT else 0 end) wc, sum(case when is_control then 1/Gh else 0 end) wu from er where is_case or is_control group by 1,2,3),
hc as (select *, sum(wu) over (partition by dataset, h order by p) cum from hg), hd as (select dataset, h, sum(wc*(cum-0.5*wu))/nullif(sum(wc)*sum(wu),0) a from hc group by dataset, h), hm as (select dataset, avg(a) mean_auc, {', '.join(f'max(a) filter (where h={h}) auc_{h}d' for h in H)} from hd group by 1),
pf as (select dataset, mean_auc, {', '.join(f'auc_{h}d' for h in H)}, {', '.join(CURVE_COLS)}, c c_index, mb mean_brier, ibs integrated_brier, a average_ece, q calibration_quality, least(greatest(2*auc-1,0),1) gini from cix join ib using (dataset) join cs using (dataset) join auc using (dataset) join hm using (dataset) join cq using (dataset)),
pl as (select *, {label('c_index', [(0.75, 'Excellent'), (0.65, 'Good'), (0.55, 'Fair')], '>=')} cl, {label('gini', [(0.6, 'Excellent'), (0.4, 'Good'), (0.2, 'Fair')], '>=')} gl,
 {label('average_ece', [(0.05, 'Excellent'), (0.1, 'Good'), (0.15, 'Fair')], '<=')} el from pf),
po as (select *, 0.4*{grade('cl')}+0.3*{grade('gl')}+0.3*{grade('el')} sc from pl)"""


@query("i13_performance", f"""{SC}, {PERF} select dataset, round(c_index,6) c_index, round(mean_auc,6) mean_auc, {', '.join(f'round(auc_{h}d,6) auc_{h}d' for h in H)}, {', '.join(f'round({c},6) {c}' for c in CURVE_COLS)}, round(mean_brier,6) mean_brier, round(integrated_brier,6) integrated_brier, round(average_ece,6) average_ece, calibration_quality,
 round(gini,6) gini, cl c_index_label, gl gini_label, el ece_label, round(sc,6) overall_score, {label('sc', [(3.5, 'Excellent'), (2.5, 'Good'), (1.5, 'Fair')], '>=')} overall from po""")
def i13(spark, sf):
    return tidy(mt.performance(fx.scored(spark, sf), DIST, S))


@query("i14_stability", f"""{SC}, {PERF}, ml as (select dataset, metric, v from pf, lateral (values ('c_index',c_index),('gini',gini),('average_ece',average_ece)) t(metric,v)),
st as (select metric, max(v) filter (where dataset='val') early, max(v) filter (where dataset='oot') late from ml group by 1),
sd as (select *, case when metric='average_ece' then late-early else early-late end degradation, abs(early-late)/((abs(early)+abs(late))/4) effect_size from st)
select metric, round(early,6) early, round(late,6) late, round(degradation,6) degradation, round(effect_size,6) effect_size,
 case when effect_size>0.8 then 'Large' when effect_size>0.5 then 'Medium' when effect_size>0.2 then 'Small' else 'Negligible' end effect_label,
 case when avg(cast(degradation>0.05 as integer)) over ()>=0.67 then 'Severe' when avg(cast(degradation>0.05 as integer)) over ()>=0.33 then 'Moderate' else 'Stable' end severity from sd""")
def i14(spark, sf):
    return tidy(mt.stability(mt.performance(fx.scored(spark, sf), DIST, S)))


ALL = fx.SCORED.replace("scored as (select *,", "scored as (select * replace ('all' as dataset),")
# the pair count without censored people of the same day, scores are event probabilities at the chosen day
PAIRS_STRICT = PAIRS.replace("(b.time>a.time or (b.time=a.time and b.event=0))", "b.time>a.time")


@query("i15_validate_scores", f"""with {ALL}, {rows_sql([90])}, {AUC}, {ece_sql('er', W_ALL)}, {PAIRS_STRICT},
bs as (select dataset, x, avg(case when time<=x and event=1 then (1-px)*(1-px)/GT when time>x then px*px/Gx else 0 end) b from (
  select er.*, x, 1-{surv_sql('x')} px, (select coalesce(min(S),1.0) from g where t<=x) Gx from er, range(1,91) r(x)) group by 1,2),
tr as (select *, (x-coalesce(lag(x) over w,0))*(b+coalesce(lag(b) over w,0.0))/2.0 a from bs window w as (partition by dataset order by x))
select 90 t_star, (select count(*) from er) n, (select count(*) from er where is_case) n_cases, (select count(*) from er where is_control) n_controls, round(auc,6) auc, round(2*auc-1,6) gini,
 (select round(ece,6) from ece) ece, (select round({GRAF},6) from er) brier, (select round(c,6) from cix) c_index, (select round(sum(a)/max(x),6) from tr) ibs from auc""")
def i15(spark, sf):
    return tidy(mt.validate_scores(fx.scored(spark, sf), DIST, S))


RESID = f"""rs as (select *, -ln(greatest({surv_sql('time', clip=False)},1e-8)) cs from scored),
rd as (select *, event-cs mart, sign(event-cs)*sqrt(greatest(2*(event*ln(greatest(cast(event as double),1e-8))-(event-cs)),0)) dev, case when event=1 then {Z} end std from rs)"""


@query("i16_residuals", f"{SC}, {RESID} select id, round(cs,6) cox_snell, round(mart,6) martingale, round(dev,6) deviance, round(std,6) standardised from rd")
def i16(spark, sf):
    return tidy(dg.residuals(fx.scored(spark, sf), DIST, S).select("id", "cox_snell", "martingale", "deviance", "standardised"))


def ks_sql(name, value, cdf):
    return f"""{name} as (select dataset, max(greatest(cum/tn-f, f-(cum-c)/tn)) ks, any_value(tn) n from (select *, cast(sum(c) over (partition by dataset order by v) as double) cum, cast(sum(c) over (partition by dataset) as double) tn, {cdf} f
 from (select dataset, {value} v, count(*) c from rd where event=1 group by 1,2)) group by 1)"""


def ks_p_sql(ks, n):
    lam = f"(cast({n} as double)*{ks}*{ks})"
    return "least(greatest(" + "+".join(f"({2.0 * (-1) ** (k - 1)})*exp({-2.0 * k * k}*{lam})" for k in range(1, 21)) + ",0.0),1.0)"


@query("i17_residual_tests", f"""{SC}, {RESID}, {ks_sql('k1', 'cs', '1-exp(-v)')}, {ks_sql('k2', 'std', '1-1/(1+exp(v))')}, q as (select dataset, quantile_cont(abs(dev),0.95) c from rd group by 1),
m as (select dataset, avg(mart) mm, count(*) n, avg(cast(abs(dev)>c as integer)) o, any_value(c) c from rd join q using (dataset) group by 1),
pv as (select k1.dataset, {ks_p_sql('k1.ks', 'k1.n')} p1, {ks_p_sql('k2.ks', 'k2.n')} p2 from k1 join k2 using (dataset)),
ad as (select pv.*, 0.25*(cast(p1>0.05 and k1.n>20 as integer)+cast(abs(mm)<0.1 as integer)+cast(p2>0.05 and k1.n>20 as integer)+cast(o<0.1 as integer)) sc from pv join k1 using (dataset) join m using (dataset))
select dataset, round(p1,6) cox_snell_p, round(p2,6) distribution_p, cast(sc as double) adequacy_score, case when sc>=0.75 then 'ADEQUATE' when sc>=0.5 then 'MARGINAL' else 'INADEQUATE' end adequacy, round(k1.ks,6) cox_snell_ks, cast(k1.n as bigint) n_events, round(k2.ks,6) distribution_stat, round(mm,6) martingale_mean, m.n n_rows, round(c,6) deviance_p95, round(o,6) outlier_rate from k1 join k2 using (dataset) join m using (dataset) join ad using (dataset)""")
def i17(spark, sf):
    return tidy(dg.residual_tests(fx.scored(spark, sf), DIST, S))


@query("i17_jarque_bera", f"""{SC}, r as (select dataset, {Z} z from scored where event=1), m as (select dataset, avg(z) a from r group by 1),
c as (select dataset, count(*) n, avg((z-a)**2) m2, avg((z-a)**3) m3, avg((z-a)**4) m4 from r join m using (dataset) group by 1)
select dataset, n, round(m3/m2**1.5,6) skewness, round(m4/(m2*m2)-3,6) kurtosis, round(n/6.0*((m3/m2**1.5)**2+(m4/(m2*m2)-3)**2/4),4) jarque_bera,
 round(exp(-n/12.0*((m3/m2**1.5)**2+(m4/(m2*m2)-3)**2/4)),6) p_value from c""")
def i17_jb(spark, sf):
    ev = dg.residuals(fx.scored(spark, sf), "normal", S).where(F.col("event") == 1)
    j = dg.jarque_bera(ev, "standardised").withColumn("jarque_bera", F.round("jarque_bera", 4))
    return tidy(j)


@query("i18_aft_assumptions", f"""{SC}, m as (select dataset, quantile_cont(eta,0.5) md from scored group by 1),
a as (select dataset, corr(eta,ln(time)) c, count(*) filter (where event=1) n, var_pop(case when event=1 and eta>=md then ln(time)-eta end)/var_pop(case when event=1 and eta<md then ln(time)-eta end) vr from scored join m using (dataset) group by 1)
select dataset, round(c,6) correlation, n n_events, round(vr,6) variance_ratio, case when abs(c)>0.3 then 'PASS' else 'WEAK' end log_linearity, case when vr between 0.5 and 2 then 'PASS' else 'FAIL' end proportional from a""")
def i18(spark, sf):
    return tidy(dg.aft_assumptions(fx.scored(spark, sf)))


@query("i19_directional_checks", f"""{SC}, {RISK}, c as (select dataset, corr(exp(eta),event) a, corr(risk,event) b, corr(exp(eta),risk) d from risked group by 1)
select dataset, round(a,6) time_event, round(b,6) risk_event, round(d,6) time_risk, case when a<-0.1 and b>0.1 and d<-0.1 then 'PASS' else 'FAIL' end directional from c""")
def i19(spark, sf):
    return tidy(dg.directional_checks(risked(spark, sf)))


def rate_sql(n):
    e = "+".join(f"(case when risk>e{i} then 1 else 0 end)" for i in range(1, n))
    return f"""{edges_sql('risked', 'risk', n, 'dataset')}, rt as (select dataset, 1+{e} bin, count(*) n, sum(event) events, avg(event) event_rate, avg(time) mean_time from risked join qe using (dataset) group by 1,2)"""


@query("i19_risk_ranking", f"""{SC}, {RISK}, {rate_sql(5)}, l as (select *, lag(event_rate) over (partition by dataset order by bin) p from rt),
k as (select dataset, count(*) filter (where event_rate<p)=0 m, cast(max_by(events,bin) as double)/sum(events) t from l group by 1)
select dataset, m monotonic, round(t,6) top_capture, case when m and t>0.3 then 'GOOD' else 'POOR' end ranking from k""")
def i19_ranking(spark, sf):
    return tidy(dg.ranking_quality(dg.risk_quantile_rates(risked(spark, sf))))


@query("i19_model_health")
def i19_health(spark, sf):
    r = risked(spark, sf)
    return tidy(dg.model_health(aft.prediction_statistics(r), dg.directional_checks(r), dg.ranking_quality(dg.risk_quantile_rates(r))))


@query("i20_decile_rates", f"{SC}, {RISK}, {rate_sql(10)} select dataset, bin, n, cast(events as bigint) events, round(event_rate,6) event_rate, round(mean_time,6) mean_time from rt")
def i20(spark, sf):
    return tidy(dg.risk_quantile_rates(risked(spark, sf), 10))


@query("i20_capture_curve", f"""{SC}, {RISK}, g as (select dataset, risk, cast(count(*) as double) n, cast(sum(event) as double) e from risked group by 1,2),
c as (select *, sum(n) over w cn, sum(n) over (partition by dataset) tn, sum(e) over (partition by dataset) te from g window w as (partition by dataset order by risk desc)), sh as (select i/20.0 share from range(1,21) r(i))
select dataset, cast(share as double) share, round(sum(least(greatest(share*tn-(cn-n),0),n)*e/n)/max(te),6) captured from c, sh group by 1,2""")
def i20_capture(spark, sf):
    return tidy(dg.capture_curve(risked(spark, sf)))


@query("i20_tail_separation", f"""{SC}, {RISK}, q as (select dataset, quantile_cont(risk,0.1) lo, quantile_cont(risk,0.9) hi from risked group by 1),
t as (select dataset, avg(event) filter (where risk>=hi) a, avg(event) filter (where risk<=lo) b from risked join q using (dataset) group by 1) select dataset, round(a,6) top_rate, round(b,6) bottom_rate, round(a-b,6) separation from t""")
def i20_tail(spark, sf):
    return tidy(dg.tail_separation(risked(spark, sf)))


@query("i21_bootstrap_brier")
def i21(spark, sf):
    return tidy(mt.bootstrap_brier(fx.scored(spark, sf), DIST, S))


@query("i22_compare_models", f"""with {fx.SCORED.replace("scored as (", "scored0 as (")}, scored as (select * replace ('good' as dataset) from scored0 union all select * replace ('flat' as dataset, 5.0 as eta) from scored0),
{ibs_sql(H)}, mb as (select dataset, avg(b) mb, count(*) nb from bs group by 1) select dataset model, round(ibs,6) ibs, round(mb,6) mean_brier, nb n_valid_timepoints, 1.2 scale_parameter from ibs join mb using (dataset)""")
def i22(spark, sf):
    s = fx.scored(spark, sf)
    both = s.withColumn("model", F.lit("good")).unionByName(s.withColumn("eta", F.lit(5.0)).withColumn("model", F.lit("flat")))
    return tidy(mt.compare_models(both, {"good": (DIST, S), "flat": (DIST, S)}))


@query("i23_input_contract", f"{SC} select dataset, count(*) filter (where time<=0) bad_time, count(*) filter (where event not in (0,1)) bad_event from scored group by 1")
def i23(spark, sf):
    return mt.input_contract(fx.scored(spark, sf))


@query("i24_calibration_slope", f"{SC} select dataset, round(corr(ln(time),eta) filter (where event=1),6) calibration_slope from scored group by 1")
def i24(spark, sf):
    return tidy(aft.calibration_slope(fx.scored(spark, sf)))
