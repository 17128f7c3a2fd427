"""Baselines from Kaplan-Meier curves and chance, and the comparison with a fitted model."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenurelens.functions.bootstrap import hash_uniform
from tenurelens.functions.columns import ladder, one_row
from tenurelens.functions.scale import pin_small
from tenurelens.operators.metrics import concordance
from tenurelens.operators.survival import km_curve
from tenurelens.schema import MAX_DAY

UNSEEN = 0.5


def demographic_stratum(df: DataFrame, age="age_at_vantage", tenure_days="tenure_at_vantage_days") -> DataFrame:
    """Age (35, 50) x tenure (2, 5 years) stratum; values outside (0, inf) are 'nan'."""
    band = lambda c, steps, last: F.when(c.isNull() | (c <= 0), "nan").otherwise(ladder(c, steps, last, "<="))
    a = band(F.col(age), [(35, "<35"), (50, "35-50")], "50+")
    t = band(F.col(tenure_days) / 365.25, [(2, "<2yr"), (5, "2-5yr")], "5yr+")
    return df.withColumn("demo_stratum", F.concat_ws("_", a, t))


def stratum_curves(train: DataFrame, stratum: str, min_rows: int) -> DataFrame:
    """Curves of strata with enough rows."""
    c = km_curve(train, [stratum])
    size = W.partitionBy(stratum)
    return c.withColumn("_n", F.max("n_risk").over(size)).where(F.col("_n") >= min_rows).drop("_n")


def day_grid(curves: DataFrame, stratum: str, last_day=MAX_DAY) -> DataFrame:
    """Curve values for every day 0..last: S, and S and day of the next step (null after the last)."""
    w = W.partitionBy(stratum).orderBy("t")
    zero = curves.select(stratum).distinct().select(stratum, F.lit(0).alias("t"), F.lit(1.0).alias("S"))
    steps = zero.unionByName(curves.select(stratum, F.col("t").cast("int").alias("t"), "S"))
    steps = steps.withColumns({"next_t": F.lead("t").over(w), "next_S": F.lead("S").over(w)})
    end = F.coalesce(F.col("next_t") - 1, F.greatest(F.col("t"), F.lit(last_day)))
    return steps.withColumn("day", F.explode(F.sequence(F.col("t"), end))).select(stratum, "day", "t", "S", "next_t", "next_S")


def km_predictions(train: DataFrame, test: DataFrame, stratum: str, min_rows=10, horizon=365) -> DataFrame:
    """S(horizon) of each row's stratum; .5 for strata without a curve."""
    c = stratum_curves(train, stratum, min_rows)
    s = pin_small(c.groupBy(stratum).agg(F.coalesce(F.min(F.when(F.col("t") <= horizon, F.col("S"))), F.lit(1.0)).alias("prediction")))
    return test.join(s, stratum, "left").withColumn("prediction", F.coalesce("prediction", F.lit(UNSEEN)))


def population_predictions(train: DataFrame, test: DataFrame, horizon=365) -> DataFrame:
    s = km_curve(train).agg(F.min(F.when(F.col("t") <= horizon, F.col("S"))).alias("s")).first()["s"]
    return test.withColumn("prediction", F.lit(1.0 if s is None else float(s)))


def random_predictions(test: DataFrame, key="id", seed=42) -> DataFrame:
    """Uniform in .1 .. .9 by a hash of the key: the same on every run."""
    return test.withColumn("prediction", 0.1 + 0.8 * hash_uniform(key, seed=seed))


def km_log_likelihood(train: DataFrame, test: DataFrame, stratum: str, min_rows=10) -> DataFrame:
    """Discrete log-likelihood of test rows under their stratum's curve.

    Events use the hazard to the next step (at least 1e-6; 1e-4 after the last),
    censored rows the survival; rows of strata without a curve are left out.
    """
    grid = pin_small(day_grid(stratum_curves(train, stratum, min_rows), stratum))
    last = pin_small(grid.groupBy(stratum).agg(F.max("day").alias("_last")))
    # a day after the grid's last one has that one's values
    j = test.join(last, stratum).withColumn("day", F.least(F.col("time").cast("int"), F.col("_last"))).join(grid, [stratum, "day"])
    s = F.greatest("S", F.lit(1e-8))
    step = F.greatest((F.col("next_t") - F.col("t")).cast("double"), F.lit(1.0))
    haz = F.when(F.col("next_t").isNull(), 1e-4).otherwise(F.greatest((s - F.col("next_S")) / (step * s), F.lit(1e-6)))
    term = F.when(F.col("event") == 1, F.log(F.greatest(haz * s, F.lit(1e-8)))).otherwise(F.log(s))
    return j.agg(F.sum(term).alias("log_likelihood"), F.count(F.lit(1)).alias("n"))


def min_time_brier(scored: DataFrame, horizon=365, prediction="prediction") -> DataFrame:
    """Brier score with weights 1 / max(G(min(T, h)), .01); censored rows count as no event."""
    c = km_curve(scored.select("time", (1 - F.col("event")).alias("_c"), F.lit("all").alias("_g")), ["_g"], "time", "_c")
    days = day_grid(c, "_g", max(MAX_DAY, int(horizon))).select(F.col("day").alias("_day"), (1.0 / F.greatest("S", F.lit(0.01))).alias("_w"))
    j = scored.withColumn("_day", F.least(F.col("time"), F.lit(horizon))).join(pin_small(days), "_day")
    y = ((F.col("time") <= horizon) & (F.col("event") == 1)).cast("double")
    err = F.pow(1.0 - F.col(prediction) - y, 2)
    return j.agg((F.sum(F.col("_w") * err) / F.sum("_w")).alias("brier"))


def baseline_metrics(train: DataFrame, test: DataFrame, strata: dict, key="id", horizon=365, which=None) -> DataFrame:
    """One row per baseline: concordance, Brier, log-likelihood.

    ``strata`` maps name to (column, minimum rows); ``which`` names the baselines to build (all by default).
    """
    which = ["population", *strata, "random"] if which is None else which

    def row(name, pred, ll):
        b = min_time_brier(pred, horizon)
        c = concordance(pred.select("time", "event", (-F.col("prediction")).alias("_risk"), F.lit("all").alias("_g")), "_risk", ["_g"]).select("c_index")
        return one_row(c, b, ll).select(F.lit(name).alias("baseline"), "c_index", "brier", "log_likelihood")

    one = lambda d: d.withColumn("_all", F.lit("all"))
    rows = []
    if "population" in which:
        rows.append(row("population", population_predictions(train, test, horizon), km_log_likelihood(one(train), one(test), "_all", 1)))
    for name, (col, least) in strata.items():
        if name not in which:
            continue
        rows.append(row(name, km_predictions(train, test, col, least, horizon), km_log_likelihood(train, test, col, least)))
    if "random" in which:
        rnd = random_predictions(test, key)
        y = ((F.col("time") <= horizon) & (F.col("event") == 1)).cast("double")
        r = rnd.agg(F.lit(0.5).alias("c_index"), F.avg(F.pow(F.col("prediction") - y, 2)).alias("brier"), F.sum(F.log(F.col("prediction") + 1e-8)).alias("log_likelihood"))
        rows.append(r.select(F.lit("random").alias("baseline"), "c_index", "brier", "log_likelihood"))
    return reduce(DataFrame.unionByName, rows)


def compare_to_model(baselines: DataFrame, model: dict) -> DataFrame:
    """Gain of a model over each baseline and the label by its gain over the best concordance."""
    best = F.max("c_index").over(W.partitionBy(F.lit(0)))
    gain = F.lit(model["c_index"]) - best
    return baselines.select("baseline", (F.lit(model["c_index"]) - F.col("c_index")).alias("c_index_gain"), (F.col("brier") - model["brier"]).alias("brier_gain"),
                            (F.lit(model["log_likelihood"]) - F.col("log_likelihood")).alias("log_likelihood_gain"),
                            ladder(gain, [(0.10, "RECOMMEND DEPLOYMENT"), (0.05, "CONDITIONAL DEPLOYMENT")], "NOT RECOMMENDED", ">=").alias("recommendation"))
