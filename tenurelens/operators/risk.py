"""Risk bands: percentile and outcome-driven cut points, band statistics, cost."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenurelens.functions.columns import ladder, normal_cdf, ratio
from tenurelens.functions.scale import exact_quantiles, pin_small

# fixed values: percentiles of the bands, replacement cost, share of risk that turns into a departure
HIGH_P, MEDIUM_P, TURNOVER_COST, DEPARTURE_SHARE = 0.67, 0.33, 75000, 0.8
FIXED_CUTS = [(0.67, "High"), (0.33, "Medium")]


def percentile_cuts(df: DataFrame, risk="risk", by=()) -> DataFrame:
    return exact_quantiles(df, by, risk, {"high": HIGH_P, "medium": MEDIUM_P})


def banded(df: DataFrame, high: float, medium: float, risk="risk") -> DataFrame:
    return df.withColumn("band", F.when(F.col(risk) >= high, "High").when(F.col(risk) >= medium, "Medium").otherwise("Low"))


def band_statistics(b: DataFrame, risk="risk") -> DataFrame:
    """Size, share, mean, range per band and the intervention priority of the whole."""
    g = b.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg(risk).alias("mean_risk"), F.min(risk).alias("min_risk"), F.max(risk).alias("max_risk"))
    whole = W.partitionBy(F.lit(0))  # at most three rows
    j = g.withColumns({"_all": F.sum("n").over(whole), "_high": F.sum(F.when(F.col("band") == "High", F.col("n")).otherwise(0)).over(whole)})
    return j.select("band", "n", (F.col("n") / F.col("_all") * 100).alias("percentage"), "mean_risk", "min_risk", "max_risk",
                    F.when(F.col("_high") / F.col("_all") * 100 > 20, "URGENT").otherwise("MODERATE").alias("priority"))


def categorize(df: DataFrame, risk="risk", high=None, medium=None) -> DataFrame:
    """Add ``band`` by the 67th and 33rd percentile, or by given cut points."""
    if high is None or medium is None:
        q = percentile_cuts(df, risk).first()
        high = q["high"] if high is None else high
        medium = q["medium"] if medium is None else medium
    return banded(df, high, medium, risk)


def optimal_cuts(df: DataFrame, risk="risk", steps=20, min_events=10) -> DataFrame:
    """Cut points that spread the mean event time of the bands most.

    Candidates run from the 60th to the 80th and from the 25th to the 45th
    percentile.  Rows are counted once into the cells between all candidates; the
    grid is then evaluated on those few cells.
    """
    q = exact_quantiles(df, [], risk, {"h0": 0.60, "h1": 0.80, "m0": 0.25, "m1": 0.45, "high": HIGH_P, "medium": MEDIUM_P}).first()
    line = lambda a, b: [a + (b - a) * i / (steps - 1) for i in range(steps)]
    highs, mediums = line(q["h0"], q["h1"]), line(q["m0"], q["m1"])
    cuts = sorted(set(highs + mediums))
    cell = sum((F.when(F.col(risk) >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    t = F.when(F.col("event") == 1, F.col("time"))
    cells = pin_small(df.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.count(t).alias("e"), F.coalesce(F.sum(t), F.lit(0)).cast("double").alias("s")))
    # a threshold at cuts[i] keeps the cells above i
    side = lambda values, v, i: F.explode(F.array(*[F.struct(F.lit(x).alias(v), F.lit(cuts.index(x) + 1).alias(i)) for x in values]))
    x = cells.withColumn("g", side(highs, "high", "hi")).select("n", "e", "s", "cell", "g.*")
    x = x.withColumn("g", side(mediums, "medium", "mi")).select("n", "e", "s", "cell", "high", "hi", "g.*").where("medium < high")
    part = {"h": F.col("cell") >= F.col("hi"), "m": (F.col("cell") >= F.col("mi")) & (F.col("cell") < F.col("hi")), "l": F.col("cell") < F.col("mi")}
    total = lambda c, w: F.coalesce(F.sum(F.when(part[w], F.col(c))), F.lit(0))
    y = x.groupBy("high", "medium").agg(F.sum("n").alias("_rows"), F.sum("e").alias("_events"), *[total(c, w).alias(f"{c}_{w}") for c in ("n", "e", "s") for w in part])
    means = F.array(*[F.when(F.col(f"e_{w}") > min_events, F.col(f"s_{w}") / F.col(f"e_{w}")) for w in ("l", "m", "h")])
    valid = F.filter(means, lambda v: v.isNotNull())
    size = F.size("_v")
    y = y.withColumn("_v", valid)
    y = y.withColumn("_mean", F.when(size > 0, F.aggregate("_v", F.lit(0.0), lambda a, v: a + v) / F.greatest(size, F.lit(1))))
    y = y.withColumn("_var", F.when(size > 0, F.aggregate("_v", F.lit(0.0), lambda a, v: a + (v - F.col("_mean")) * (v - F.col("_mean"))) / F.greatest(size, F.lit(1))))
    score = F.when((F.col("_events") < 50) | (size < 2), 0.0).otherwise(F.col("_var") / (F.col("_mean") * F.col("_mean")))
    ok = (F.col("n_h") >= 0.05 * F.col("_rows")) & (F.col("n_h") <= 0.4 * F.col("_rows")) & (F.col("n_m") >= 0.1 * F.col("_rows"))
    best = y.withColumn("score", score).where(ok).agg(F.max(F.struct("score", (-F.col("high")).alias("a"), (-F.col("medium")).alias("b"))).alias("w"))
    return best.select(F.coalesce(-F.col("w.a"), F.lit(q["high"])).alias("high"), F.coalesce(-F.col("w.b"), F.lit(q["medium"])).alias("medium"),
                       F.coalesce("w.score", F.lit(-1.0)).alias("score"))


def validate_cuts(b: DataFrame) -> DataFrame:
    """Event rate per band, pooled t of High against Low, ratio of the two rates."""
    pick = lambda w: F.when(F.col("band") == w, F.col("event"))
    g = b.agg(*[F.coalesce(F.avg(pick(w)), F.lit(0.0)).alias(f"rate_{w.lower()}") for w in ("High", "Medium", "Low")],
              F.count(pick("High")).alias("_n1"), F.count(pick("Low")).alias("_n0"),
              F.var_samp(pick("High")).alias("_v1"), F.var_samp(pick("Low")).alias("_v0"))
    n1, n0 = F.col("_n1"), F.col("_n0")
    pooled = ((n1 - 1) * F.col("_v1") + (n0 - 1) * F.col("_v0")) / (n1 + n0 - 2)
    t = F.when((n1 > 10) & (n0 > 10), F.try_divide(F.col("rate_high") - F.col("rate_low"), F.sqrt(pooled * (1.0 / n1 + 1.0 / n0))))
    out = g.withColumn("t_statistic", t)
    # bands above ten people each; the normal tail stands in for Student's
    return out.select("rate_high", "rate_medium", "rate_low", "t_statistic",
                      F.coalesce(2.0 * (1.0 - normal_cdf(F.abs("t_statistic"))), F.lit(1.0)).alias("p_value"),
                      (F.col("rate_high") / F.greatest("rate_low", F.lit(0.01))).alias("discrimination_ratio"))


def turnover_cost(stats: DataFrame) -> DataFrame:
    """Expected departures and cost per band."""
    gone = F.col("n") * F.col("mean_risk") * DEPARTURE_SHARE
    return stats.select("band", "n", F.floor(gone).alias("expected_departures"), (gone * TURNOVER_COST).alias("estimated_cost"),
                        (gone * TURNOVER_COST / F.greatest("n", F.lit(1))).alias("cost_per_employee"))


def fixed_bands(df: DataFrame, risk="risk") -> DataFrame:
    """Band by the fixed cuts .67 and .33."""
    return df.withColumn("band", ladder(risk, FIXED_CUTS, "Low", ">="))


def band_shares(b: DataFrame, risk="risk") -> DataFrame:
    """Mean and deviation of risk and the share of each fixed band, in percent."""
    share = lambda w: (F.avg(F.when(F.col("band") == w, 100.0).otherwise(0.0))).alias(f"{w.lower()}_pct")
    return b.agg(F.count(F.lit(1)).alias("population"), F.avg(risk).alias("mean_risk"), F.stddev_pop(risk).alias("std_risk"), share("High"), share("Medium"), share("Low"))
