"""Descriptive survival: Kaplan-Meier curves, retention, log-rank, segments."""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenurelens.functions.columns import erf, ladder, one_row, ratio, stack
from tenurelens.functions.scale import pin_small, running_totals
from tenurelens.schema import HORIZONS


def _part(by):
    return W.partitionBy(*(list(by) or [F.lit(0)]))


def whole_days(df: DataFrame, time: str) -> bool:
    return df.schema[time].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")


def km_counts(df: DataFrame, by=(), time="time", event="event") -> DataFrame:
    """Per stratum and time: events ``d``, leavers ``n``, people at risk ``n_risk``.

    Whole days are at most as many as the calendar has and are added up in one window a stratum; times that aren't whole
    numbers can be as many as people and are added up in ranges of values.
    """
    c = df.groupBy(*by, F.col(time).alias("t")).agg(F.sum(event).alias("d"), F.count(F.lit(1)).alias("n"))
    if not whole_days(df, time):
        return running_totals(c, by, "t", ["n"], descending=True).withColumnRenamed("cum_n", "n_risk").drop("all_n")
    later = _part(by).orderBy("t").rowsBetween(W.currentRow, W.unboundedFollowing)
    return c.withColumn("n_risk", F.sum("n").over(later))


def km_curve(df: DataFrame, by=(), time="time", event="event") -> DataFrame:
    """Kaplan-Meier estimate S(t) and its left limit, one row per stratum and time.

    The product runs as a sum of logarithms, with the times at which nobody is left counted apart: over days in one window,
    over other times in ranges of values whose sums are added up first.
    """
    c = km_counts(df, by, time, event)
    ends = F.when(F.col("d") == F.col("n_risk"), 1).otherwise(0)
    step = F.when(F.col("d") < F.col("n_risk"), F.log(1.0 - F.col("d") / F.col("n_risk"))).otherwise(0.0)
    if not whole_days(df, time):
        sums = running_totals(c.withColumns({"_step": step, "_ends": ends}), by, "t", ["_step", "_ends"])
        s = lambda gone, log_s: F.when(gone > 0, 0.0).otherwise(F.exp(log_s))
        return sums.withColumns({"S": s(F.col("cum__ends"), F.col("cum__step")), "S_left": s(F.col("cum__ends") - F.col("_ends"), F.col("cum__step") - F.col("_step"))}).drop(
            "_step", "_ends", "cum__step", "cum__ends", "all__step", "all__ends")
    upto = _part(by).orderBy("t").rowsBetween(W.unboundedPreceding, W.currentRow)
    c = c.withColumn("S", F.when(F.sum(ends).over(upto) > 0, 0.0).otherwise(F.exp(F.sum(step).over(upto))))
    return c.withColumn("S_left", F.coalesce(F.lag("S").over(_part(by).orderBy("t")), F.lit(1.0)))


def retention(curve: DataFrame, by=(), horizons=HORIZONS) -> DataFrame:
    """S at each horizon (1 before the first day) and the median, one row per stratum."""
    at = [F.coalesce(F.min(F.when(F.col("t") <= h, F.col("S"))), F.lit(1.0)).alias(f"retention_{h}d") for h in horizons]
    return curve.groupBy(*by).agg(*at, F.min(F.when(F.col("S") <= 0.5, F.col("t"))).alias("median_days"))


def retention_long(curve: DataFrame, by=(), horizons=HORIZONS) -> DataFrame:
    """One row per stratum and horizon."""
    wide = retention(curve, by, horizons)
    return stack(wide, [f"retention_{h}d" for h in horizons], by, "horizon", "retention").withColumn(
        "horizon", F.regexp_extract("horizon", r"(\d+)", 1).cast("int"))


def median_survival(curve: DataFrame, by=()) -> DataFrame:
    """First day with S <= 0.5, infinity where the curve stays above."""
    m = F.min(F.when(F.col("S") <= 0.5, F.col("t"))).cast("double")
    return curve.groupBy(*by).agg(F.coalesce(m, F.lit(float("inf"))).alias("median_days"))


def population_baseline(df: DataFrame, by=(), time="time", event="event", horizons=HORIZONS) -> DataFrame:
    """Size, event and censoring rate, retention and median per group."""
    by = list(by)
    curve = km_curve(df, by, time, event)
    head = F.max("n_risk").alias("population"), F.sum("d").alias("events")
    at = [F.coalesce(F.min(F.when(F.col("t") <= h, F.col("S"))), F.lit(1.0)).alias(f"retention_{h}d") for h in horizons]
    out = curve.groupBy(*by).agg(*head, *at, F.min(F.when(F.col("S") <= 0.5, F.col("t"))).alias("median_days"))
    return (out.withColumn("event_rate", ratio("events", "population"))
               .withColumn("censoring_rate", 1.0 - F.col("event_rate")))


def chi2_sf1(x):
    """Upper tail of chi-square with one degree of freedom: erfc(sqrt(x/2))."""
    return 1.0 - erf(F.sqrt(x / 2.0))


def log_rank(df: DataFrame, group: str, first, second, by=(), time="time", event="event") -> DataFrame:
    """Two-group log-rank statistic and p value, per stratum of ``by``."""
    by = list(by)
    is1 = F.col(group) == F.lit(first)
    d = df.where(F.col(group).isin(first, second))
    c = d.groupBy(*by, F.col(time).alias("t")).agg(
        F.sum(event).alias("d"), F.count(F.lit(1)).alias("n"),
        F.sum(F.when(is1, F.col(event)).otherwise(0)).alias("d1"), F.sum(F.when(is1, 1).otherwise(0)).alias("n1"))
    later = _part(by).orderBy("t").rowsBetween(W.currentRow, W.unboundedFollowing)
    c = c.withColumn("r", F.sum("n").over(later).cast("double")).withColumn("r1", F.sum("n1").over(later).cast("double"))
    dd, r, r1 = F.col("d"), F.col("r"), F.col("r1")
    var = F.when(r > 1, dd * (r1 / r) * (1.0 - r1 / r) * (r - dd) / F.greatest(r - 1.0, F.lit(1.0))).otherwise(0.0)
    out = c.groupBy(*by).agg(F.sum("d1").alias("observed"), F.sum(dd * r1 / r).alias("expected"), F.sum(var).alias("variance"))
    out = out.withColumn("statistic", ratio(F.pow(F.col("observed") - F.col("expected"), 2), "variance"))
    return out.withColumn("p_value", chi2_sf1(F.col("statistic")))


def temporal_trends(df: DataFrame, cohort: str, earlier, later, time="time", event="event", min_rows=1000,
                    horizons=HORIZONS) -> DataFrame:
    """Retention of two cohorts side by side, differences and log-rank; empty below ``min_rows``."""
    base = population_baseline(df.where(F.col(cohort).isin(earlier, later)), [cohort], time, event, horizons)
    pick = lambda c, who: F.max(F.when(F.col(cohort) == F.lit(who), F.col(c)))
    cols = ["population", "event_rate", "median_days"] + [f"retention_{h}d" for h in horizons]
    wide = base.agg(*[pick(c, w).alias(f"{c}_{tag}") for c in cols for w, tag in ((earlier, "earlier"), (later, "later"))])
    for h in horizons:
        wide = wide.withColumn(f"change_{h}d", F.col(f"retention_{h}d_later") - F.col(f"retention_{h}d_earlier"))
    test = log_rank(df, cohort, earlier, later, (), time, event).select("statistic", "p_value")
    return one_row(wide, test).where(F.col("population_later") >= min_rows).withColumn("significant", F.col("p_value") < 0.05)


def ranked_strata(df: DataFrame, stratum: str, by=(), time="time", event="event", min_rows=1000, top_n=None,
                  horizons=HORIZONS) -> DataFrame:
    """Baseline per stratum of sufficient size, the ``top_n`` largest, ranked by last-horizon retention."""
    by = list(by)
    out = population_baseline(df, by + [stratum], time, event, horizons).where(F.col("population") >= min_rows)
    if top_n is not None:
        size = _part(by).orderBy(F.desc("population"), F.asc(stratum))
        out = out.withColumn("_rn", F.row_number().over(size)).where(F.col("_rn") <= top_n).drop("_rn")
    best = _part(by).orderBy(F.desc(f"retention_{horizons[-1]}d"), F.asc(stratum))
    return out.withColumn("rank", F.rank().over(best))


def strata_spread(ranked: DataFrame, stratum: str, by=(), horizon=HORIZONS[-1]) -> DataFrame:
    """Best, worst, range, mean and population deviation over strata."""
    s = F.col(f"retention_{horizon}d")
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("strata"),
        F.max_by(stratum, F.struct(s, stratum)).alias("best"), F.min_by(stratum, F.struct(s, stratum)).alias("worst"),
        (F.max(s) - F.min(s)).alias("range"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"))


# fixed values: limits (right-closed, from 0) and labels of the demographic groups
AGE_BANDS = [(25, "<25"), (35, "25-35"), (45, "35-45"), (55, "45-55"), (65, "55-65")]
TENURE_BANDS = [(0.5, "<6mo"), (1, "6mo-1yr"), (2, "1-2yr"), (3, "2-3yr"), (5, "3-5yr")]
SALARY_BANDS = [(40000, "<40K"), (60000, "40-60K"), (80000, "60-80K"), (120000, "80-120K"), (200000, "120-200K")]


def demographic_groups(df: DataFrame, age="age_at_vantage", tenure_days="tenure_at_vantage_days",
                       salary="baseline_salary") -> DataFrame:
    """Add age, tenure and salary bands; missing and negative values have no band."""
    def band(c, limits, last):
        return F.when(c.isNull() | (c < 0), None).otherwise(ladder(c, limits, last, "<="))

    return df.select("*", band(F.col(age), AGE_BANDS, "65+").alias("age_group"),
                     band(F.col(tenure_days) / 365.25, TENURE_BANDS, "5yr+").alias("tenure_group"),
                     band(F.col(salary), SALARY_BANDS, "200K+").alias("salary_group"))


def segment_patterns(df: DataFrame, segments, time="time", event="event", min_rows=500) -> DataFrame:
    """Baseline per (segment type, value), all segment columns in one pass, ranked within type."""
    long = stack(df, segments, [time, event], "segment_type", "segment").where(F.col("segment").isNotNull())
    return ranked_strata(long, "segment", ["segment_type"], time, event, min_rows)


def context_insights(segments: DataFrame, covered: DataFrame, trend: DataFrame) -> DataFrame:
    """Numeric findings: segment gap per type, share covered, cohort shift, each with a flag."""
    s = F.col("retention_365d")
    gaps = segments.groupBy("segment_type").agg((F.max(s) - F.min(s)).alias("impact")).select(
        F.concat(F.lit("gap:"), "segment_type").alias("factor"), "impact", F.when(F.col("impact") > 0.2, 1).otherwise(0).alias("flag"))
    cov = covered.select(F.lit("coverage").alias("factor"), F.col("coverage").alias("impact"),
                         F.when(F.col("coverage") < 0.5, 1).otherwise(0).alias("flag"))
    shift = trend.select(F.lit("shift").alias("factor"), F.abs("change_365d").alias("impact"),
                         F.when(F.col("significant"), 1).otherwise(0).alias("flag"))
    return gaps.unionByName(cov).unionByName(shift)


def coverage(ranked: DataFrame, total: DataFrame) -> DataFrame:
    """Share of all people who are in a reported stratum."""
    both = one_row(ranked.agg(F.coalesce(F.sum("population"), F.lit(0)).alias("inside")), total.agg(F.count(F.lit(1)).alias("total")))
    return both.select(ratio("inside", "total").alias("coverage"))


def day_density(df: DataFrame, time="time", event="event", width=30, upper=365) -> DataFrame:
    """Histogram of days and of log days by censoring status, as densities."""
    lin = df.select(event, F.lit("days").alias("scale"), F.floor(F.col(time) / width).cast("int").alias("bin"),
                    F.lit(float(width)).alias("w"))
    step = 0.25
    log = df.select(event, F.lit("log_days").alias("scale"), F.floor(F.log(time) / step).cast("int").alias("bin"),
                    F.lit(step).alias("w"))
    d = lin.unionByName(log).groupBy(event, "scale", "bin", "w").agg(F.count(F.lit(1)).alias("n"))
    total = W.partitionBy(event, "scale")
    return d.select(event, "scale", "bin", "n", (F.col("n") / F.sum("n").over(total) / F.col("w")).alias("density"))


def kernel_density(df: DataFrame, time="time", event="event", points=200, bins=2048) -> DataFrame:
    """Gaussian density of days and of log days by censoring status: ``scale``, ``x``, ``density``, with ``n`` and ``bandwidth``.

    The bandwidth is n^(-1/5) standard deviations.  People are counted into ``bins`` equal bins between the least and largest
    value; the kernel is then summed over bins, so the work after one pass doesn't depend on people.  ``points`` places reach three
    bandwidths beyond the values, days not below 0.  A group of fewer than two different times has no density.
    """
    d = df.where(F.col(time) > 0).select(F.col(event).alias("event"), F.col(time).cast("double").alias("days"), F.log(F.col(time).cast("double")).alias("log_days"))
    scales = ["days", "log_days"]
    stats = pin_small(d.groupBy("event").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}_{k}") for c in scales for k, f in (("sd", F.stddev_samp), ("low", F.min), ("high", F.max))]))
    placed = d.join(stats, "event")
    parts = []
    for c in scales:
        low, high = F.col(f"{c}_low"), F.col(f"{c}_high")
        step = (high - low) / bins
        at = F.least(F.floor((F.col(c) - low) / step), F.lit(bins - 1))
        counted = placed.where(high > low).groupBy("event", "n", f"{c}_sd", low, high, at.alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("k"))
        middle = low + (F.col("bin") + 0.5) * step
        g = counted.groupBy("event", "n", F.col(f"{c}_sd").alias("sd"), low.alias("low"), high.alias("high")).agg(F.collect_list(F.struct(middle.alias("m"), F.col("k").alias("k"))).alias("bins"))
        parts.append(g.withColumn("scale", F.lit(c)))
    h = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    both = reduce(DataFrame.unionByName, parts).withColumn("bandwidth", h)
    start = F.when(F.col("scale") == "days", F.greatest(F.col("low") - 3 * F.col("bandwidth"), F.lit(0.0))).otherwise(F.col("low") - 3 * F.col("bandwidth"))
    place = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    spread = both.select("*", start.alias("start"), (F.col("high") + 3 * F.col("bandwidth")).alias("stop"), place)
    x = F.col("start") + (F.col("stop") - F.col("start")) * F.col("point") / (points - 1)
    spread = spread.withColumn("x", x)
    kernel = F.aggregate("bins", F.lit(0.0), lambda s, b: s + b["k"] * F.exp(-0.5 * F.pow((F.col("x") - b["m"]) / F.col("bandwidth"), 2)))
    return spread.select("event", "scale", "point", "x", (kernel / (F.col("n") * F.col("bandwidth") * math.sqrt(2 * math.pi))).alias("density"), "n", "bandwidth")
