"""Censoring-aware evaluation: IPCW weights, Brier, AUC, Gini, concordance, calibration error.

Rows carry ``time``, ``event``, ``eta`` and a group column such as ``dataset``;
all groups and horizons are evaluated together.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenurelens.functions.arrays import grouped_arrays
from tenurelens.functions.bootstrap import percentile_interval, replicate_means
from tenurelens.functions.columns import ladder, one_row, ratio, stack
from tenurelens.functions.scale import exact_quantiles, pin_small, running_totals, value_before
from tenurelens.operators.aft import curve_quality, event_probability, survival_of
from tenurelens.operators.survival import km_curve, whole_days
from tenurelens.schema import HORIZONS

BY = ["dataset"]
TINY = 1e-12


def censoring_curve(df: DataFrame, by=BY) -> DataFrame:
    """Kaplan-Meier of censoring: (group, t, G_right, G_left, G_left_shifted).

    ``G_left_shifted`` is the left limit of the time before, 1 at the first.
    """
    c = km_curve(df.select(*by, "time", (1 - F.col("event")).alias("_c")), by, "time", "_c")
    if whole_days(c, "t"):
        c = c.withColumn("_prev", F.lag("S_left").over(W.partitionBy(*by).orderBy("t")))
    else:
        c = value_before(c, by, "t", "S_left", "_prev")
    return c.select(*by, "t", F.col("S").alias("G_right"), F.col("S_left").alias("G_left"), F.coalesce("_prev", F.lit(1.0)).alias("G_left_shifted"))


def step_lookup(curve: DataFrame, by, points, left=False) -> DataFrame:
    """Value of the censoring step function at days (group, point, G); 1 before the first day."""
    grid = curve.withColumn("point", F.explode(F.array(*[F.lit(int(p)) for p in points])))
    at = F.col("t") < F.col("point") if left else F.col("t") <= F.col("point")
    return grid.groupBy(*by, "point").agg(F.coalesce(F.min(F.when(at, F.col("G_right"))), F.lit(1.0)).alias("G"))


def with_censoring_weights(df: DataFrame, horizons, by=BY, adjust=False, min_controls=None, variant="exact", curve=None) -> DataFrame:
    """One row per person and horizon with G(T-), G(h), case and control marks.

    ``adjust`` moves a horizon at or beyond the last day to the day before it;
    ``min_controls`` moves a horizon with fewer people beyond it one day down.
    """
    curve = pin_small(censoring_curve(df, by)) if curve is None else curve
    g_left = "G_left" if variant == "exact" else "G_left_shifted"
    ends = curve.groupBy(*by).agg(F.max("t").alias("_end"))
    plan = ends.withColumn("horizon", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
    if min_controls is not None:
        # controls per horizon come from the day counts, at most one row per day
        by_day = df.groupBy(*by, "time").agg(F.count(F.lit(1)).alias("_n"))
        beyond = by_day.withColumn("horizon", F.explode(F.array(*[F.lit(int(h)) for h in horizons]))).groupBy(*by, "horizon").agg(
            F.sum(F.when(F.col("time") > F.col("horizon"), F.col("_n")).otherwise(0)).alias("_beyond"))
        plan = plan.join(beyond, [*by, "horizon"], "left")
        used = F.when(F.coalesce("_beyond", F.lit(0)) < min_controls, F.col("horizon") - 1).otherwise(F.col("horizon"))
    elif adjust:
        used = F.when(F.col("horizon") >= F.col("_end"), F.col("_end") - 1).otherwise(F.col("horizon"))
    else:
        used = F.col("horizon")
    plan = plan.withColumn("used_horizon", used.cast("int"))
    # G never rises, so the last value up to a day is the smallest one
    g_h = F.coalesce(F.min(F.when(F.col("t") <= F.col("used_horizon"), F.col("G_right"))), F.lit(1.0))
    plan = pin_small(plan).join(curve.select(*by, "t", "G_right"), by).groupBy(*by, "horizon", "used_horizon").agg(g_h.alias("G_h"))
    plan = plan.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("horizon", "used_horizon", "G_h"))).alias("_plan"))
    # one lookup table per (group, day): G(T-) and the horizons of the group
    days = curve.select(*by, F.col("t").alias("time"), F.col(g_left).alias("G_left")).join(pin_small(plan), by)
    rows = df.join(pin_small(days), [*by, "time"])
    rows = rows.withColumn("_h", F.explode("_plan")).drop("_plan").select("*", "_h.*").drop("_h")
    return rows.withColumns({"is_case": (F.col("time") <= F.col("used_horizon")) & (F.col("event") == 1),
                             "is_control": F.col("time") > F.col("used_horizon")})


def evaluation_rows(df: DataFrame, dist: str, sigma: float, horizons=HORIZONS, by=BY, **how) -> DataFrame:
    """``with_censoring_weights`` plus the predicted event probability ``p``."""
    rows = with_censoring_weights(df, horizons, by, **how)
    return rows.withColumn("p", event_probability(dist, sigma, F.col("used_horizon").cast("double")))


def _weights(limit=None, floor=TINY):
    cut = (lambda w: F.least(w, F.lit(float(limit)))) if limit else (lambda w: w)
    case = cut(1.0 / F.greatest("G_left", F.lit(floor)))
    control = cut(1.0 / F.greatest("G_h", F.lit(floor)))
    return F.when(F.col("is_case"), case).when(F.col("is_control"), control).otherwise(0.0)


def brier(rows: DataFrame, by=BY, variant="graf") -> DataFrame:
    """Brier score per group and horizon.

    ``graf`` divides by all rows, ``normalised`` by the weights (cut at 100; null
    with fewer than 10 cases and 10 controls), ``plain`` uses no weights at all.
    """
    key = [*by, "horizon"]
    err = F.when(F.col("is_case"), F.pow(1.0 - F.col("p"), 2)).otherwise(F.pow("p", 2))
    if variant == "plain":
        return rows.groupBy(*key).agg(F.avg(F.pow(F.col("is_case").cast("double") - F.col("p"), 2)).alias("brier"))
    if variant == "graf":
        return rows.groupBy(*key).agg(F.avg(_weights() * err).alias("brier"))
    w = _weights(100, 1e-8)
    few = (F.count_if("is_case") < 10) & (F.count_if("is_control") < 10)
    return rows.groupBy(*key).agg(F.when(~few, F.try_divide(F.sum(w * err), F.sum(w))).alias("brier"))


def brier_details(rows: DataFrame, by=BY) -> DataFrame:
    """Counts, predicted and observed rate and their gap next to the score."""
    c, k = F.count_if("is_case"), F.count_if("is_control")
    rate = F.coalesce(F.try_divide(c.cast("double"), (c + k).cast("double")), F.lit(0.0))
    err = F.when(F.col("is_case"), F.pow(1.0 - F.col("p"), 2)).otherwise(F.pow("p", 2))
    return rows.groupBy(*by, "horizon").agg(
        F.avg(_weights() * err).alias("brier"), c.alias("n_events"), k.alias("n_at_risk"), F.avg("p").alias("event_probs_mean"),
        F.stddev_pop("p").alias("event_probs_std"), rate.alias("actual_event_rate"), F.abs(rate - F.avg("p")).alias("calibration_gap"))


def grid_brier(df: DataFrame, dist: str, sigma: float, times, by=BY, variant="graf") -> DataFrame:
    """``brier`` at many days (group, horizon, brier), with all days of a person worked out in one array.

    G at a day is the same for all of a group, so its weight is applied to the sums; G(T-) comes with the row.
    """
    times = [int(t) for t in times]
    n, days, norm = len(times), np.array(times, dtype=float), variant == "normalised"
    curve = pin_small(censoring_curve(df, by))
    rows = df.select(*by, "time", "event", "eta").join(curve.select(*by, F.col("t").alias("time"), "G_left"), [*by, "time"])

    def parts(c):
        with np.errstate(all="ignore"):
            p = 1.0 - survival_of(dist, (np.log(days) - c["eta"][:, None]) / sigma)
        time, weight = c["time"][:, None], 1.0 / np.maximum(c["G_left"], 1e-8 if norm else TINY)
        weight = (np.minimum(weight, 100.0) if norm else weight)[:, None]
        case, control = (time <= days) & (c["event"] == 1)[:, None], time > days
        sums = [case * weight * (1 - p) ** 2, control * p ** 2] + ([case * weight, case, control] if norm else [np.ones_like(p)])
        return np.concatenate(sums, axis=1)

    sums = grouped_arrays(rows, by, n * (5 if norm else 3), parts)
    at = lambda k: F.sum(F.when(F.floor(F.col("i") / n) == k, F.col("v")))
    horizon = F.element_at(F.array(*map(F.lit, times)), F.col("i") % n + 1).alias("horizon")
    per = sums.groupBy(*by, horizon).agg(*[at(k).alias(f"_{k}") for k in range(5 if norm else 3)])
    g = step_lookup(curve, by, times).select(*by, F.col("point").alias("horizon"), F.greatest("G", F.lit(1e-8 if norm else TINY)).alias("_g"))
    per = per.join(g, [*by, "horizon"])
    if norm:
        w = F.least(1.0 / F.col("_g"), F.lit(100.0))
        score = F.when((F.col("_3") >= 10) | (F.col("_4") >= 10), F.try_divide(F.col("_0") + w * F.col("_1"), F.col("_2") + w * F.col("_4")))
    else:
        score = F.try_divide(F.col("_0") + F.col("_1") / F.col("_g"), F.col("_2"))
    return per.select(*by, "horizon", score.alias("brier"))


def default_times(last_event_p90: float):
    """Days of the default integration grid."""
    out = [30, 60, 90, 90, 180, 270, 360]
    t = 365
    while t < last_event_p90:
        out.append(t)
        t += 182
    return sorted(set(out))


def trapezoid(points: DataFrame, by, x="horizon", y="brier", from_zero=True, span=False) -> DataFrame:
    """Area under y over x per group, divided by the last x (or by the span of x)."""
    w = W.partitionBy(*by).orderBy(x)
    px, py = F.lag(x).over(w), F.lag(y).over(w)
    if from_zero:
        px, py = F.coalesce(px, F.lit(0)), F.coalesce(py, F.lit(0.0))
    d = points.where(F.col(y).isNotNull()).withColumn("_a", (F.col(x) - px) * (F.col(y) + py) / 2.0)
    width = F.max(x) - F.min(x) if span else F.max(x)
    return d.groupBy(*by).agg(F.try_divide(F.sum("_a"), width.cast("double")).alias("ibs"))


def integrated_brier(df: DataFrame, dist: str, sigma: float, t_star=None, grid=None, by=BY, variant="graf") -> DataFrame:
    """Integrated Brier score.

    ``graf`` integrates from 0 over every day to ``t_star``, over ``grid``, or over the default grid, which ends at
    the 90th percentile of the event times; ``normalised`` uses 30 days from 1 to 364 and divides by the span.
    """
    if variant == "normalised":
        points = [1 + 363 * i / 29 for i in range(30)]
        b = grid_brier(df, dist, sigma, points, by, "normalised")
        exact = F.create_map(*[F.lit(v) for x in points for v in (int(x), float(x))])
        b = b.withColumn("x", F.try_element_at(exact, F.col("horizon")))
        return trapezoid(b, by, x="x", from_zero=False, span=True)
    if t_star is None and grid is None:
        last = exact_quantiles(df.where(F.col("event") == 1), [], "time", {"last": 0.9}).first()
        grid = default_times(last["last"] if last and last["last"] is not None else 0)
    return trapezoid(grid_brier(df, dist, sigma, grid or range(1, int(t_star) + 1), by), by)


def auc(rows: DataFrame, by=BY, score="p") -> DataFrame:
    """IPCW AUC per group and horizon: weighted share of (case, control) pairs ranked right, ties half."""
    key = [*by, "horizon"]
    w = _weights()
    d = rows.where(F.col("is_case") | F.col("is_control")).groupBy(*key, score).agg(
        F.sum(F.when(F.col("is_case"), w).otherwise(0.0)).alias("wc"), F.sum(F.when(F.col("is_control"), w).otherwise(0.0)).alias("wu"))
    cum = running_totals(d, key, score, ["wu"])
    good = F.sum(F.col("wc") * (F.col("cum_wu") - 0.5 * F.col("wu")))
    return cum.groupBy(*key).agg(F.try_divide(good, F.sum("wc") * F.sum("wu")).alias("auc"))


def gini(df: DataFrame, dist: str, sigma: float, horizon=364, by=BY) -> DataFrame:
    """2 AUC - 1 at one horizon, within 0..1."""
    a = auc(evaluation_rows(df, dist, sigma, [horizon], by, adjust=True), by)
    return a.select(*by, "horizon", "auc", F.least(F.greatest(2 * F.col("auc") - 1, F.lit(0.0)), F.lit(1.0)).alias("gini"))


def lorenz(df: DataFrame, score: str, by=BY) -> DataFrame:
    """Events captured by descending risk: area, Gini, share held by the top tenth.

    People with equal scores share their group's event rate, so the order of ties
    does not matter.
    """
    by = list(by)
    d = df.groupBy(*by, score).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("event").cast("double").alias("e"))
    d = running_totals(d, by, score, ["n", "e"], descending=True)
    # the curve starts at the first person, hence the cut of the first half step
    whole = F.max("all_n") * F.max("all_e")
    first_rate = F.max_by(F.col("e") / F.col("n"), score)
    area = F.sum(F.col("n") * (F.col("cum_e") - 0.5 * F.col("e"))) / whole - first_rate / (2 * whole)
    k = F.floor(F.col("all_n") / 10) + 1
    start = F.col("cum_n") - F.col("n")
    inside = F.least(F.greatest(k - start, F.lit(0.0)), F.col("n")) * F.col("e") / F.col("n")
    out = d.groupBy(*by).agg(area.alias("auc_lorenz"), (F.sum(inside) / F.max("all_e")).alias("top_decile_capture"))
    return out.withColumn("gini", F.least(F.greatest(2 * F.col("auc_lorenz") - 1, F.lit(0.0)), F.lit(1.0)))


def concordance(df: DataFrame, score: str, by=BY, tied_times=True) -> DataFrame:
    """Harrell's c, exact, without pairing rows.

    Two different days first differ in one binary digit.  For each digit the
    people who share the higher digits are split by it: those with a 0 leave
    before those with a 1, and a running count along the score tells how many
    pairs are ranked right.  Every pair is counted at exactly one digit.  People
    censored on the day of an event count as leaving later (``tied_times``).
    ``score`` is high for high risk.  The number of digits comes from the largest day.
    """
    by = list(by)
    cells = df.groupBy(*by, "time", score).agg(F.sum("event").alias("e"), F.count(F.lit(1)).alias("n"))
    t = F.col("time").cast("long")
    levels = []
    for b in range(int(df.agg(F.max(t)).first()[0] or 0).bit_length()):
        one = F.shiftright(t, b).bitwiseAND(1) == 1
        levels.append(F.struct(F.lit(b).alias("lv"), F.shiftright(t, b + 1).alias("pre"),
                               F.when(one, 0).otherwise(F.col("e")).cast("long").alias("early"), F.when(one, F.col("n")).otherwise(0).cast("long").alias("late")))
    if tied_times:
        levels.append(F.struct(F.lit(-1).alias("lv"), t.alias("pre"), F.col("e").cast("long").alias("early"), (F.col("n") - F.col("e")).cast("long").alias("late")))
    x = cells.select(*by, score, F.explode(F.array(*levels)).alias("_l")).select(*by, score, "_l.*")
    key = [*by, "lv", "pre"]
    x = x.where((F.col("early") > 0) | (F.col("late") > 0)).groupBy(*key, score).agg(F.sum("early").alias("early"), F.sum("late").alias("late"))
    cum = running_totals(x, key, score, ["late"])
    ok = F.sum(F.col("early") * (F.col("cum_late") - 0.5 * F.col("late")))
    per = cum.groupBy(*key).agg(ok.alias("_ok"), (F.sum("early").cast("double") * F.sum("late")).alias("_all"))
    return per.groupBy(*by).agg(F.try_divide(F.sum("_ok"), F.sum("_all")).alias("c_index"), F.sum("_all").alias("comparable_pairs"))


def ipcw_weights(df: DataFrame, by=BY, floor=0.01) -> DataFrame:
    """Row weights 1 / max(G(T), floor), rescaled to the number of rows per group."""
    curve = pin_small(censoring_curve(df, by)).select(*by, F.col("t").alias("time"), (1.0 / F.greatest("G_right", F.lit(floor))).alias("_w"))
    j = df.join(curve, [*by, "time"])
    # totals come from day counts, not from people
    days = df.groupBy(*by, "time").agg(F.count(F.lit(1)).alias("_n"))
    tot = pin_small(days.join(curve, [*by, "time"]).groupBy(*by).agg((F.sum("_n") / F.sum(F.col("_n") * F.col("_w"))).alias("_k")))
    return j.join(tot, by).withColumn("ipcw", F.col("_w") * F.col("_k")).drop("_w", "_k")


def quantile_bins(rows: DataFrame, key, value="p", n_bins=10, side="right") -> DataFrame:
    """Add ``bin`` 0..n-1 by inner quantile edges of ``value`` per group."""
    inner = {f"_e{i}": i / n_bins for i in range(1, n_bins)}
    edges = pin_small(exact_quantiles(rows, key, value, inner))
    j = rows.join(edges, list(key))
    over = lambda e: F.col(value) >= F.col(e) if side == "right" else F.col(value) > F.col(e)
    return j.withColumn("bin", sum((F.when(over(e), 1).otherwise(0) for e in inner), F.lit(0))).drop(*inner)


def _ece(bins: DataFrame, key) -> DataFrame:
    """Share-weighted gap of bins with (w, wp, wo)."""
    gap = F.abs(F.try_divide(F.col("wp") - F.col("wo"), F.col("w"))) * F.col("w")
    return bins.groupBy(*key).agg(F.try_divide(F.sum(gap), F.sum("w")).alias("ece"))


def ece_ipcw(rows: DataFrame, by=BY, n_bins=10, variant="all") -> DataFrame:
    """Calibration error over quantile bins with IPCW weights.

    ``all`` bins every row; ``valid`` bins rows with a weight (cut at 50) and is
    null below 100 such rows.
    """
    key = [*by, "horizon"]
    if variant == "all":
        b = quantile_bins(rows.withColumn("_w", _weights()), key, n_bins=n_bins)
    else:
        b = quantile_bins(rows.withColumn("_w", _weights(50, 1e-8)).where(F.col("_w") > 0), key, n_bins=n_bins)
    w = F.col("_w")
    bins = b.groupBy(*key, "bin").agg(F.sum(w).alias("w"), F.sum(w * F.col("p")).alias("wp"),
                                      F.sum(w * F.col("is_case").cast("double")).alias("wo"), F.count(F.lit(1)).alias("n"))
    out = _ece(bins, key)
    if variant == "all":
        return out
    n = bins.groupBy(*key).agg(F.sum("n").alias("_n"))
    return out.join(n, key).select(*key, F.when(F.col("_n") >= 100, F.col("ece")).alias("ece"))


def width_bin(p, n_bins=10) -> Column:
    return F.least(F.floor(F.col(p) * n_bins), F.lit(n_bins - 1)).cast("int")


def ece_evaluable(rows: DataFrame, by=BY, n_bins=10) -> DataFrame:
    """Equal-width bins over rows whose outcome is known; bins above 10 rows; null below 100 rows."""
    key = [*by, "horizon"]
    d = rows.where((F.col("event") == 1) | (F.col("time") > F.col("horizon"))).withColumn("bin", width_bin("p", n_bins))
    bins = d.groupBy(*key, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mp"), F.avg(F.col("is_case").cast("double")).alias("mo"))
    gap = F.when(F.col("n") > 10, F.col("n") * F.abs(F.col("mp") - F.col("mo"))).otherwise(0.0)
    return bins.groupBy(*key).agg(F.when(F.sum("n") >= 100, F.sum(gap) / F.sum("n")).alias("ece"))


def calibration_curve(df: DataFrame, dist: str, sigma: float, horizons=HORIZONS, by=BY, n_bins=10) -> DataFrame:
    """Equal-width bins weighted by ``ipcw_weights``: predicted, observed, weight."""
    rows = evaluation_rows(ipcw_weights(df, by), dist, sigma, horizons, by).withColumn("bin", width_bin("p", n_bins))
    w = F.col("ipcw")
    return rows.groupBy(*by, "horizon", "bin").agg(
        (F.sum(w * F.col("p")) / F.sum(w)).alias("predicted"), (F.sum(w * F.col("is_case").cast("double")) / F.sum(w)).alias("observed"), F.sum(w).alias("weight"))


def ece_weighted(curve: DataFrame, by=BY) -> DataFrame:
    b = curve.select(*by, "horizon", F.col("weight").alias("w"), (F.col("weight") * F.col("predicted")).alias("wp"), (F.col("weight") * F.col("observed")).alias("wo"))
    return _ece(b, [*by, "horizon"])


def calibration_summary(ece: DataFrame, by=BY) -> DataFrame:
    """Mean error over horizons and its quality label."""
    m = ece.groupBy(*by).agg(F.avg("ece").alias("average_ece"), F.coalesce(F.stddev_pop("ece"), F.lit(0.0)).alias("_sd"))
    a, s = F.col("average_ece"), F.col("_sd")
    label = F.when(a.isNull(), "none").when((a <= 0.05) & (s <= 0.02), "Excellent").when((a <= 0.10) & (s <= 0.05), "Good").when(
        a <= 0.15, "Fair").otherwise("Poor")
    return m.select(*by, "average_ece", s.alias("ece_std"), label.alias("calibration_quality"))


# fixed values: limits of the quality labels and weights of the overall grade
C_INDEX_LABELS = [(0.75, "Excellent"), (0.65, "Good"), (0.55, "Fair")]
GINI_LABELS = [(0.6, "Excellent"), (0.4, "Good"), (0.2, "Fair")]
ECE_LABELS = [(0.05, "Excellent"), (0.10, "Good"), (0.15, "Fair")]
OVERALL_WEIGHTS = {"c_index": 0.4, "gini": 0.3, "average_ece": 0.3}


def performance(df: DataFrame, dist: str, sigma: float, horizons=HORIZONS, by=BY) -> DataFrame:
    """Concordance, AUC at each horizon and their mean, Brier over the horizons and integrated over 30 days of the year, calibration, Gini
    and the curves' quality per dataset, with labels and an overall grade."""
    risk = df.withColumn("_risk", -F.col("eta"))
    rows = evaluation_rows(df, dist, sigma, horizons, by)
    ece, score = ece_evaluable(rows, by), pin_small(brier(rows, by))
    parts = [concordance(risk, "_risk", by).select(*by, "c_index"), auc(rows, by).groupBy(*by).agg(F.avg("auc").alias("mean_auc"), *[F.max(F.when(F.col("horizon") == h, F.col("auc"))).alias(f"auc_{h}d") for h in horizons]),
             score.groupBy(*by).agg(F.avg("brier").alias("mean_brier")), integrated_brier(df, dist, sigma, by=by, variant="normalised").withColumnRenamed("ibs", "integrated_brier"),
             curve_quality(df, dist, sigma, by),
             calibration_summary(ece, by).drop("ece_std"), gini(df, dist, sigma, 364, by).select(*by, "gini")]
    m = reduce(lambda a, b: a.join(b, by), parts)
    lab = {"c_index": ladder("c_index", C_INDEX_LABELS, "Poor", ">="), "gini": ladder("gini", GINI_LABELS, "Poor", ">="),
           "average_ece": ladder("average_ece", ECE_LABELS, "Poor", "<=")}
    grade = {"Excellent": 4, "Good": 3, "Fair": 2, "Poor": 1}
    points = lambda c: reduce(lambda acc, kv: F.when(c == kv[0], float(kv[1])).otherwise(acc), grade.items(), F.lit(None))
    have = {k: F.col(k).isNotNull() for k in lab}
    top = sum((F.when(have[k], points(lab[k]) * w).otherwise(0.0) for k, w in OVERALL_WEIGHTS.items()), F.lit(0.0))
    bottom = sum((F.when(have[k], w).otherwise(0.0) for k, w in OVERALL_WEIGHTS.items()), F.lit(0.0))
    m = m.withColumn("overall_score", F.try_divide(top, bottom))
    return m.withColumns({"c_index_label": lab["c_index"], "gini_label": lab["gini"], "ece_label": lab["average_ece"],
                          "overall": ladder("overall_score", [(3.5, "Excellent"), (2.5, "Good"), (1.5, "Fair")], "Poor", ">=")})


def stability(perf: DataFrame, early="val", late="oot") -> DataFrame:
    """Change from validation to out-of-time per metric, rough effect size and severity over all metrics."""
    m = stack(perf, ["c_index", "gini", "average_ece"], ["dataset"], "metric", "v")
    p = m.groupBy("metric").agg(F.max(F.when(F.col("dataset") == early, F.col("v"))).alias("early"), F.max(F.when(F.col("dataset") == late, F.col("v"))).alias("late"))
    p = p.where(F.col("early").isNotNull() & F.col("late").isNotNull())
    worse = F.when(F.col("metric") == "average_ece", F.col("late") - F.col("early")).otherwise(F.col("early") - F.col("late"))
    effect = ratio(F.abs(F.col("early") - F.col("late")), (F.abs("early") + F.abs("late")) / 4, 0.0)
    p = p.withColumns({"degradation": worse, "effect_size": effect})
    share = F.avg(F.when(F.col("degradation") > 0.05, 1.0).otherwise(0.0)).over(W.partitionBy(F.lit(0)))
    return p.withColumns({
        "effect_label": ladder("effect_size", [(0.8, "Large"), (0.5, "Medium"), (0.2, "Small")], "Negligible", ">"),
        "severity": ladder(share, [(0.67, "Severe"), (0.33, "Moderate")], "Stable", ">=")})


def pick_horizon(df: DataFrame, candidates=(90, 180, 270, 300), need=1000, default=180) -> int:
    """First horizon with enough cases and survivors."""
    row = df.agg(*[x for t in candidates for x in (
        F.count_if((F.col("time") <= t) & (F.col("event") == 1)).alias(f"c{t}"), F.count_if(F.col("time") > t).alias(f"s{t}"))]).first()
    return next((t for t in candidates if row[f"c{t}"] >= need and row[f"s{t}"] >= need), default)


def validate_scores(df: DataFrame, dist: str, sigma: float, t_star=None) -> DataFrame:
    """AUC, Gini, ECE, Brier, c-index and integrated Brier at one horizon; empty below 100 cases or controls."""
    one = df.withColumn("dataset", F.lit("all"))
    t = t_star or pick_horizon(df)
    rows = evaluation_rows(one, dist, sigma, [t])
    n = rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_case").alias("n_cases"), F.count_if("is_control").alias("n_controls"))
    risk = one.withColumn("_risk", event_probability(dist, sigma, t))
    out = one_row(n.drop("dataset"), auc(rows).select("auc"), ece_ipcw(rows).select("ece"), brier(rows).select("brier"),
                  concordance(risk, "_risk", tied_times=False).select("c_index"), integrated_brier(one, dist, sigma, t).select("ibs"))
    return out.where((F.col("n_cases") >= 100) & (F.col("n_controls") >= 100)).select(
        F.lit(t).alias("t_star"), "n", "n_cases", "n_controls", "auc", (2 * F.col("auc") - 1).alias("gini"), "ece", "brier", "c_index", "ibs")


def bootstrap_brier(df: DataFrame, dist: str, sigma: float, horizons=HORIZONS, replicates=200, by=BY, cells=256) -> DataFrame:
    """Percentile interval of the Brier score by Poisson bootstrap.

    Rows are first summed into cells of contributions of almost equal size (``cells`` for
    each factor e, without an upper end), so a replicate touches cells, not people, and
    the spread inside a cell is a fraction of a percent.
    """
    rows = evaluation_rows(df, dist, sigma, horizons, by)
    err = F.when(F.col("is_case"), F.pow(1.0 - F.col("p"), 2)).otherwise(F.pow("p", 2))
    size = F.floor(F.log1p(_weights() * err * 1e6) * cells).cast("long")
    d = rows.withColumn("_c", _weights() * err).groupBy(*by, "horizon", size.alias("cell")).agg(F.sum("_c").alias("total"), F.count(F.lit(1)).alias("n"))
    reps = replicate_means(d, [*by, "horizon"], "total", "n", replicates, cell_key=[*by, "horizon", "cell"])
    return percentile_interval(reps, [*by, "horizon"])


def compare_models(df: DataFrame, dist_sigma: dict, horizons=HORIZONS) -> DataFrame:
    """Integrated and mean Brier per model; rows of ``df`` carry ``model`` and ``eta``."""
    parts = []
    for name, (dist, sigma) in dist_sigma.items():
        b = brier(evaluation_rows(df.where(F.col("model") == name), dist, sigma, horizons, ["model"]), ["model"])
        parts.append(b.withColumn("scale_parameter", F.lit(float(sigma))))
    b = reduce(DataFrame.unionByName, parts)
    ibs = trapezoid(b, ["model"])
    mean = b.groupBy("model").agg(F.avg("brier").alias("mean_brier"), F.count("brier").alias("n_valid_timepoints"), F.max("scale_parameter").alias("scale_parameter"))
    return ibs.join(mean, "model").orderBy("ibs")


def input_contract(df: DataFrame, by=BY) -> DataFrame:
    """Rows that break T > 0 and finite, or event in {0, 1}."""
    t = F.col("time").cast("double")
    return df.groupBy(*by).agg(
        F.count_if(t.isNull() | F.isnan(t) | (t <= 0) | (F.abs(t) == float("inf"))).alias("bad_time"),
        F.count_if(F.col("event").isNull() | ~F.col("event").isin(0, 1)).alias("bad_event"))


def require_valid(df: DataFrame) -> DataFrame:
    """The same rows; the job fails on the first row that breaks the contract."""
    bad = F.col("time").isNull() | (F.col("time") <= 0) | F.col("event").isNull() | ~F.col("event").isin(0, 1)
    return df.withColumn("time", F.when(bad, F.raise_error(F.lit("time must be > 0 and event 0 or 1"))).otherwise(F.col("time")))
