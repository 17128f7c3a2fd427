"""Probability calibration per horizon, classification thresholds and confusion tables."""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenurelens.functions.columns import ratio
from tenurelens.functions.scale import pin_small, running_totals, value_bucket
from tenurelens.operators.aft import event_probability
from tenurelens.operators.metrics import concordance, quantile_bins
from tenurelens.schema import HORIZONS

H = ["horizon"]
# fixed values: costs of a needless intervention and of a missed leaver, and set thresholds per horizon
COST_FALSE_ALARM, COST_MISSED = 5000, 75000
FIXED_THRESHOLDS = {30: 0.10, 90: 0.15, 180: 0.20, 365: 0.30}
SWEEP = [0.05, 0.10, 0.15, 0.20, 0.25, 0.30]


def horizon_rows(df: DataFrame, dist: str, sigma: float, horizons=HORIZONS) -> DataFrame:
    """One row per person and horizon with predicted probability ``p`` and outcome ``y``."""
    d = df.withColumn("horizon", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
    y = ((F.col("time") <= F.col("horizon")) & (F.col("event") == 1)).cast("int")
    return d.withColumns({"p": event_probability(dist, sigma, F.col("horizon").cast("double")), "y": y})


class IsotonicCalibrator:
    """One monotone map per horizon: linear between knots, constant beyond them. ``knots`` has places and values by horizon."""

    def __init__(self, knots: dict, digits: int | None):
        self.knots, self.digits = knots, digits

    def transform(self, rows: DataFrame, output="q") -> DataFrame:
        knots = self.knots

        @F.arrow_udf("double")
        def mapped(horizon: pa.Array, p: pa.Array) -> pa.Array:
            h, x = horizon.to_numpy(zero_copy_only=False), p.to_numpy(zero_copy_only=False).astype(float)
            out = np.full(len(x), np.nan)
            for k, (at, value) in knots.items():
                mine = (h == k) & ~np.isnan(x)
                out[mine] = np.interp(x[mine], at, value)
            return pa.array(out, mask=np.isnan(out))

        return rows.withColumn(output, mapped(F.col("horizon"), _rounded(self.digits)))


def _rounded(digits: int | None):
    return F.col("p") if digits is None else F.round("p", digits)


#: Value ranges that are merged into one at each level of the tree, and its levels (a range is about 0.02 % of a probability wide).
MERGED, LEVELS = 64, 3
_BLOCKS = "horizon int, range long, low double, high double, total double, weight double"


def pooled(low, high, total, weight) -> list[tuple]:
    """Blocks in order, with neighbours whose means don't rise made one: the only such pooling, in whatever order it is done."""
    out: list[list] = []
    for l, h, t, w in zip(low, high, total, weight):
        out.append([l, h, t, w])
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, h, t, w = out.pop()
            out[-1][1], out[-1][2], out[-1][3] = h, out[-1][2] + t, out[-1][3] + w
    return [tuple(x) for x in out]


def isotonic_blocks(rows: DataFrame, digits: int | None = None) -> DataFrame:
    """Blocks (horizon, low, high, total, weight) of the isotonic fit of ``y`` on ``p``, merged in a tree over ranges of p.

    Equal probabilities are one point first. A range pools its own points; each level pools the blocks of neighbouring ranges,
    so a task sees blocks, of which there are far fewer than points, and the driver only the last ones.
    """
    x = _rounded(digits)
    points = rows.where(x.isNotNull()).groupBy(F.col("horizon").cast("int").alias("horizon"), x.alias("low")).agg(
        F.sum(F.col("y").cast("double")).alias("total"), F.count(F.lit(1)).cast("double").alias("weight"))
    blocks = points.select("horizon", value_bucket(F.col("low")).alias("range"), "low", F.col("low").alias("high"), "total", "weight")

    def merge(key, table):
        t = table.combine_chunks().sort_by("low")
        found = pooled(*(t.column(c).to_pylist() for c in ("low", "high", "total", "weight")))
        cols = list(zip(*found))
        return pa.table([pa.array([key[0].as_py()] * len(found), pa.int32()), pa.array([key[1].as_py()] * len(found), pa.int64()), *(pa.array(c, pa.float64()) for c in cols)],
                        names=["horizon", "range", "low", "high", "total", "weight"])

    for level in range(LEVELS + 1):
        up = blocks if level == 0 else blocks.withColumn("range", F.floor(F.col("range") / MERGED).cast("long"))
        blocks = up.groupBy("horizon", "range").applyInArrow(merge, _BLOCKS)
    return blocks.drop("range")


def fit_isotonic(rows: DataFrame, horizons=HORIZONS, digits: int | None = None) -> IsotonicCalibrator:
    """Fit ``y`` on ``p`` per horizon. With ``digits``, probabilities are rounded to so many places first."""
    found: dict = {}
    for r in isotonic_blocks(rows.where(F.col("horizon").isin([int(h) for h in horizons])), digits).toLocalIterator():
        found.setdefault(r.horizon, []).append((r.low, r.high, r.total / r.weight))
    knots = {}
    for h, blocks in found.items():
        blocks.sort()
        at = [(x, v) for low, high, v in blocks for x in ((low,) if low == high else (low, high))]
        knots[h] = tuple(np.array(c) for c in zip(*at))
    return IsotonicCalibrator(knots, digits)


def ece_equal_width(rows: DataFrame, score="p", key=H, n_bins=10) -> DataFrame:
    """Calibration error over bins (lo, hi]; a probability of exactly 0 is in no bin."""
    d = rows.withColumn("_b", F.when(F.col(score) > 0, F.ceil(F.col(score) * n_bins)))
    bins = d.groupBy(*key, "_b").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mp"), F.avg("y").alias("my"))
    gap = F.when(F.col("_b").isNotNull(), F.col("n") * F.abs(F.col("mp") - F.col("my"))).otherwise(0.0)
    return bins.groupBy(*key).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def reliability_curve(rows: DataFrame, score="p", key=H, n_bins=10) -> DataFrame:
    """Observed and mean predicted rate per quantile bin."""
    b = quantile_bins(rows, key, score, n_bins, side="left")
    return b.groupBy(*key, "bin").agg(F.avg("y").alias("fraction_true"), F.avg(score).alias("mean_predicted"), F.count(F.lit(1)).alias("n"))


def calibration_report(rows: DataFrame, cal: IsotonicCalibrator) -> DataFrame:
    """Before and after per horizon: mean, error, ECE, Brier, concordance kept, improvement."""
    d = cal.transform(rows)
    m = d.groupBy(*H).agg(
        F.avg("y").alias("actual_rate"), F.avg("p").alias("mean_before"), F.avg("q").alias("mean_after"),
        F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier_before"), F.avg(F.pow(F.col("q") - F.col("y"), 2)).alias("brier_after"))
    parts = [m, ece_equal_width(d, "p").withColumnRenamed("ece", "ece_before"), ece_equal_width(d, "q").withColumnRenamed("ece", "ece_after"),
             concordance(d, "p", H).select("horizon", F.col("c_index").alias("c_before")), concordance(d, "q", H).select("horizon", F.col("c_index").alias("c_after"))]
    m = reduce(lambda a, b: a.join(b, H), parts)
    before, after = F.col("mean_before") - F.col("actual_rate"), F.col("mean_after") - F.col("actual_rate")
    return m.withColumns({"error_before": before, "error_after": after,
                          "improvement_ratio": F.abs(before) / F.greatest(F.abs(after), F.lit(0.001)),
                          "keeps_discrimination": F.col("c_after") >= 0.98 * F.col("c_before")})


def validate_calibration(rows: DataFrame, cal: IsotonicCalibrator) -> DataFrame:
    """Raw and calibrated mean against the observed rate on held-out rows."""
    m = cal.transform(rows).groupBy(*H).agg(F.avg("y").alias("actual_rate"), F.avg("p").alias("raw_mean"), F.avg("q").alias("calibrated_mean"))
    raw, fixed = F.abs(F.col("raw_mean") - F.col("actual_rate")), F.abs(F.col("calibrated_mean") - F.col("actual_rate"))
    return m.withColumns({"raw_error": raw, "calibrated_error": fixed, "improvement_factor": raw / F.greatest(fixed, F.lit(0.001))})


def calibration_recommendation(report: DataFrame) -> DataFrame:
    s = report.agg(F.count(F.lit(1)).alias("horizons"), F.avg("improvement_ratio").alias("average_improvement"),
                   F.avg(F.col("ece_before") - F.col("ece_after")).alias("average_ece_reduction"), F.every("keeps_discrimination").alias("discrimination_preserved"))
    keep, gain = F.col("discrimination_preserved"), F.col("average_improvement")
    return s.withColumn("recommendation", F.when(keep & (gain > 5), "strong").when(keep & (gain > 2), "deploy").when(keep, "optional").otherwise("caution"))


def threshold_table(rows: DataFrame, score="p", key=H) -> DataFrame:
    """Confusion counts at every distinct score used as threshold (flagged if score >= threshold)."""
    c = rows.groupBy(*key, score).agg(F.sum("y").cast("long").alias("pos"), F.count(F.lit(1)).alias("n"))
    cum = running_totals(c, key, score, ["pos", "n"], descending=True)
    tp = F.col("cum_pos")
    return cum.select(*key, F.col(score).alias("threshold"), tp.alias("tp"), (F.col("cum_n") - tp).alias("fp"), (F.col("all_pos") - tp).alias("fn"),
                    (F.col("all_n") - F.col("all_pos") - F.col("cum_n") + tp).alias("tn"))


def _rates():
    tp, fp, fn, tn = [F.col(c) for c in ("tp", "fp", "fn", "tn")]
    r = lambda a, b: ratio(a, b, 0.0)
    return {"sensitivity": r(tp, tp + fn), "specificity": r(tn, tn + fp), "precision": r(tp, tp + fp), "npv": r(tn, tn + fn),
            "accuracy": r(tp + tn, tp + tn + fp + fn), "f1": r(2 * tp, 2 * tp + fp + fn),
            "actual_positive_rate": r(tp + fn, tp + tn + fp + fn), "predicted_positive_rate": r(tp + fp, tp + tn + fp + fn)}


def best_thresholds(table: DataFrame, method="youden", key=H) -> DataFrame:
    """Threshold per group: ``youden`` (highest of equals), ``f1`` and ``cost`` (lowest of equals)."""
    r = _rates()
    if method == "youden":
        value, order = r["sensitivity"] - (1.0 - r["specificity"]), F.col("threshold")
    elif method == "f1":
        value, order = r["f1"], -F.col("threshold")
    elif method == "cost":
        value, order = -(F.col("fp") * COST_FALSE_ALARM + F.col("fn") * COST_MISSED).cast("double"), -F.col("threshold")
    else:
        raise ValueError(f"unknown method {method}")
    best = table.withColumns({"_v": value, "_o": order}).groupBy(*key).agg(F.max(F.struct("_v", "_o", "threshold")).alias("b"))
    sign = -1 if method == "cost" else 1
    return best.select(*key, "b.threshold", (sign * F.col("b._v")).alias("value"))


def fixed_thresholds(spark: SparkSession, horizons=HORIZONS, default=0.15) -> DataFrame:
    """Set threshold of each horizon; no data is read. Horizons without one of their own have ``default``."""
    given = [(int(h), float(FIXED_THRESHOLDS.get(h, default))) for h in horizons]
    return spark.createDataFrame(given, "horizon int, threshold double")


def confusion(rows: DataFrame, thresholds: DataFrame, score="p", key=H) -> DataFrame:
    """Counts and rates per group and threshold.

    A row finds its place among its group's thresholds; what is counted is places, so several thresholds
    don't multiply the rows. The counts per place then add up to those of each threshold.
    """
    lists = pin_small(thresholds.groupBy(*key).agg(F.sort_array(F.collect_set("threshold")).alias("_t")))
    d = rows.where(F.col(score).isNotNull()).join(lists, list(key))
    place = F.size(F.filter("_t", lambda t: t <= F.col(score))).alias("_place")
    places = d.groupBy(*key, "_t", place).agg(F.count_if(F.col("y") == 1).alias("_yes"), F.count_if(F.col("y") != 1).alias("_no"))
    hit = F.col("_place") > F.col("_i")
    of = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0))
    g = places.select(*key, F.posexplode("_t").alias("_i", "threshold"), "_place", "_yes", "_no").groupBy(*key, "threshold").agg(
        of(hit, "_yes").alias("tp"), of(~hit, "_no").alias("tn"), of(hit, "_no").alias("fp"), of(~hit, "_yes").alias("fn"))
    return g.withColumns(_rates())


def threshold_sweep(rows: DataFrame, best: DataFrame, score="p") -> DataFrame:
    """Rates at the standard thresholds and at the chosen one."""
    grid = best.select("horizon", F.explode(F.array_distinct(F.array(*[F.lit(t) for t in SWEEP], F.col("threshold")))).alias("threshold"))
    c = confusion(rows, grid, score)
    return c.select("horizon", "threshold", "sensitivity", "specificity", "precision", "f1", F.col("predicted_positive_rate").alias("flagged_pct"))


def use_cases(conf: DataFrame) -> DataFrame:
    label = F.when(F.col("precision") > 0.5, "High-confidence interventions").when(F.col("sensitivity") > 0.7, "Broad retention programs").otherwise("Balanced approach")
    return conf.select("horizon", "threshold", label.alias("use_case"), F.col("predicted_positive_rate").alias("flagged"),
                       F.col("sensitivity").alias("capture_rate"), (1.0 - F.col("specificity")).alias("false_alarm_rate"), "precision")
