"""Model diagnostics: residuals and their tests, AFT assumptions, risk ranking."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenurelens.functions.columns import correlation, ladder, ratio
from tenurelens.functions.scale import exact_quantiles, pin_small, running_totals
from tenurelens.operators.aft import raw_survival, zscore

BY = ["dataset"]


def residuals(df: DataFrame, dist: str, sigma: float) -> DataFrame:
    """Cox-Snell, martingale, deviance and standardised residuals (the last for events only)."""
    z = zscore("time", "eta", sigma)
    cs = -F.log(F.greatest(raw_survival(dist, z), F.lit(1e-8)))
    e = F.col("event").cast("double")
    part = 2.0 * (e * F.log(F.greatest(e, F.lit(1e-8))) - (e - cs))
    return df.withColumns({"cox_snell": cs, "martingale": e - cs,
                           "deviance": F.signum(e - cs) * F.sqrt(F.greatest(part, F.lit(0.0))),
                           "standardised": F.when(F.col("event") == 1, z)})


def ks_statistic(df: DataFrame, value: str, cdf, by=BY) -> DataFrame:
    """Largest gap between the empirical and a given distribution function."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    cum, n, f = running_totals(c, by, value, ["c"]), F.col("all_c"), cdf(F.col(value))
    gap = F.greatest(F.col("cum_c") / n - f, f - (F.col("cum_c") - F.col("c")) / n)
    return cum.groupBy(*by).agg(F.max(gap).alias("ks"), F.max("all_c").alias("n"))


def ks_p_value(ks, n):
    """Asymptotic Kolmogorov tail probability."""
    lam = F.col(n).cast("double") * F.col(ks) * F.col(ks)
    series = sum((2.0 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * lam) for k in range(1, 21)), F.lit(0.0))
    return F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0))


def standard_cdf(dist: str):
    return lambda x: 1.0 - raw_survival(dist, x)


def jarque_bera(df: DataFrame, value: str, by=BY) -> DataFrame:
    """Skewness, excess kurtosis, statistic and p value (chi-square with two degrees of freedom)."""
    m = df.groupBy(*by).agg(F.count(value).alias("n"), F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis"))
    jb = F.col("n") / 6.0 * (F.pow("skewness", 2) + F.pow("kurtosis", 2) / 4.0)
    return m.withColumn("jarque_bera", jb).withColumn("p_value", F.exp(-F.col("jarque_bera") / 2.0))


def residual_tests(df: DataFrame, dist: str, sigma: float, by=BY) -> DataFrame:
    """The four adequacy tests per group and the resulting score and status."""
    by = list(by)
    r = residuals(df, dist, sigma)
    ev = r.where(F.col("event") == 1)
    cs = ks_statistic(ev, "cox_snell", lambda x: 1.0 - F.exp(-x), by).withColumnRenamed("ks", "cox_snell_ks")
    cs = cs.withColumn("cox_snell_p", ks_p_value("cox_snell_ks", "n")).withColumnRenamed("n", "n_events")
    if dist == "normal":
        st = jarque_bera(ev, "standardised", by).select(*by, F.col("jarque_bera").alias("distribution_stat"), F.col("p_value").alias("distribution_p"))
    else:
        st = ks_statistic(ev, "standardised", standard_cdf(dist), by).withColumn("distribution_p", ks_p_value("ks", "n"))
        st = st.select(*by, F.col("ks").alias("distribution_stat"), "distribution_p")
    mart = r.groupBy(*by).agg(F.avg("martingale").alias("martingale_mean"), F.count(F.lit(1)).alias("n_rows"))
    cut = pin_small(exact_quantiles(r.withColumn("_d", F.abs("deviance")), by, "_d", {"deviance_p95": 0.95}))
    out = r.join(cut, by).groupBy(*by).agg(F.max("deviance_p95").alias("deviance_p95"),
                                           F.avg((F.abs("deviance") > F.col("deviance_p95")).cast("double")).alias("outlier_rate"))
    m = cs.join(st, by).join(mart, by).join(out, by)
    ok = [(F.col("cox_snell_p") > 0.05) & (F.col("n_events") > 20), F.abs("martingale_mean") < 0.1,
          (F.col("distribution_p") > 0.05) & (F.col("n_events") > 20), F.col("outlier_rate") < 0.1]
    m = m.withColumn("adequacy_score", sum((F.when(c, 0.25).otherwise(0.0) for c in ok), F.lit(0.0)))
    return m.withColumn("adequacy", ladder("adequacy_score", [(0.75, "ADEQUATE"), (0.5, "MARGINAL")], "INADEQUATE", ">="))


def aft_assumptions(df: DataFrame, by=BY) -> DataFrame:
    """Correlation of eta and ln T; variance ratio of event residuals above and below the median eta."""
    by = list(by)
    med = pin_small(exact_quantiles(df, by, "eta", {"_med": 0.5}))
    res = F.when(F.col("event") == 1, F.log("time") - F.col("eta"))
    high = F.col("eta") >= F.col("_med")
    g = df.join(med, by).groupBy(*by).agg(
        correlation("eta", F.log("time")).alias("correlation"), F.count(res).alias("n_events"),
        ratio(F.var_pop(F.when(high, res)), F.var_pop(F.when(~high, res))).alias("variance_ratio"))
    ok = F.col("variance_ratio").between(0.5, 2.0)
    return g.withColumns({
        "log_linearity": F.when(F.abs("correlation") > 0.3, "PASS").otherwise("WEAK"),
        "proportional": F.when(F.col("n_events") <= 50, None).when(F.col("variance_ratio").isNull(), "INDETERMINATE").when(ok, "PASS").otherwise("FAIL")})


def directional_checks(df: DataFrame, risk="risk", by=BY) -> DataFrame:
    """Signs of the correlations of predicted time, risk and event."""
    t = F.exp("eta")
    g = df.groupBy(*by).agg(correlation(t, "event").alias("time_event"), correlation(risk, "event").alias("risk_event"), correlation(t, risk).alias("time_risk"))
    ok = (F.col("time_event") < -0.1) & (F.col("risk_event") > 0.1) & (F.col("time_risk") < -0.1)
    return g.withColumn("directional", F.when(ok, "PASS").otherwise("FAIL"))


def risk_quantile_rates(df: DataFrame, n_bins=5, risk="risk", by=BY) -> DataFrame:
    """Event rate, mean time and size per risk quantile group (right-closed edges), 1 = lowest risk."""
    by = list(by)
    inner = {f"_e{i}": i / n_bins for i in range(1, n_bins)}
    edges = pin_small(exact_quantiles(df, by, risk, inner))
    b = df.join(edges, by).withColumn("bin", 1 + sum((F.when(F.col(risk) > F.col(e), 1).otherwise(0) for e in inner), F.lit(0)))
    return b.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("events"), F.avg("event").alias("event_rate"), F.avg("time").alias("mean_time"))


def ranking_quality(rates: DataFrame, by=BY) -> DataFrame:
    """Are the rates rising from group to group, and how many events sit in the top one?"""
    w = W.partitionBy(*by).orderBy("bin")
    d = rates.withColumn("_p", F.lag("event_rate").over(w))
    g = d.groupBy(*by).agg((F.count_if(F.col("event_rate") < F.col("_p")) == 0).alias("monotonic"),
                           ratio(F.max_by("events", "bin"), F.sum("events"), 0.0).alias("top_capture"))
    return g.withColumn("ranking", F.when(F.col("monotonic") & (F.col("top_capture") > 0.3), "GOOD").otherwise("POOR"))


def model_health(stats: DataFrame, directional: DataFrame, ranking: DataFrame, by=BY) -> DataFrame:
    """Share of three indicators that hold: spread of predictions, signs, ranking."""
    j = stats.join(directional, list(by)).join(ranking, list(by))
    ok = [F.col("coefficient_of_variation").between(0.1, 2.0), F.col("directional") == "PASS", F.col("ranking") == "GOOD"]
    j = j.withColumn("health_score", sum((F.when(c, 1.0).otherwise(0.0) for c in ok), F.lit(0.0)) / 3.0)
    label = ladder("health_score", [(0.8, "EXCELLENT"), (0.6, "GOOD"), (0.4, "FAIR")], "POOR", ">=")
    return j.select(*by, "coefficient_of_variation", "directional", "ranking", "health_score", label.alias("health"))


def capture_curve(df: DataFrame, risk="risk", by=BY, points=20) -> DataFrame:
    """Cumulative share of events by descending risk at even population shares."""
    by = list(by)
    d = df.groupBy(*by, risk).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("event").cast("double").alias("e"))
    d = running_totals(d, by, risk, ["n", "e"], descending=True)
    x = d.withColumn("share", F.explode(F.array(*[F.lit(i / points) for i in range(1, points + 1)])))
    start = F.col("cum_n") - F.col("n")
    inside = F.least(F.greatest(F.col("share") * F.col("all_n") - start, F.lit(0.0)), F.col("n")) * F.col("e") / F.col("n")
    return x.groupBy(*by, "share").agg(F.try_divide(F.sum(inside), F.max("all_e")).alias("captured"))


def tail_separation(df: DataFrame, risk="risk", by=BY) -> DataFrame:
    """Event rates of the top and bottom tenth by risk and their difference."""
    by = list(by)
    cut = pin_small(exact_quantiles(df, by, risk, {"_p10": 0.1, "_p90": 0.9}))
    g = df.join(cut, by).groupBy(*by).agg(F.avg(F.when(F.col(risk) >= F.col("_p90"), F.col("event"))).alias("top_rate"),
                                          F.avg(F.when(F.col(risk) <= F.col("_p10"), F.col("event"))).alias("bottom_rate"))
    return g.withColumn("separation", F.col("top_rate") - F.col("bottom_rate"))
