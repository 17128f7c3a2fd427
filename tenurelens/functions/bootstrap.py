"""Poisson bootstrap over grouped counts: resampling without moving rows."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_uniform(*cols, seed: int = 42):
    """Uniform number in [0, 1) that depends only on the given columns and the seed."""
    h = F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols], F.lit(seed))
    return F.pmod(h, F.lit(2 ** 40)).cast("double") / float(2 ** 40)


def hash_normal(*cols, seed: int = 42):
    """Standard normal number from two hash uniforms (Box-Muller)."""
    u = F.greatest(hash_uniform(*cols, seed=seed), F.lit(1e-12))
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * math.pi * hash_uniform(*cols, seed=seed + 1))


def poisson_one(*cols, seed: int = 42):
    """Poisson(1) draw per row by inverting the distribution function (up to 11)."""
    u = hash_uniform(*cols, seed=seed)
    out, cum, p = None, 0.0, math.exp(-1.0)
    for k in range(12):
        cum += p
        out = F.when(u < cum, F.lit(k)) if out is None else out.when(u < cum, F.lit(k))
        p /= k + 1
    return out.otherwise(F.lit(12))


def replicate_means(cells: DataFrame, by, total: str, size: str, replicates: int, seed: int = 42,
                    cell_key=()) -> DataFrame:
    """Bootstrap means per group: weighted sum of ``total`` over weighted ``size``.

    ``cells`` holds pre-aggregated sums.  A cell of n people draws Poisson(n)
    weight, the sum of its members' Poisson(1) weights: drawn one by one up to 30
    people, as a normal number with mean and variance n above.  Draws depend only
    on the cell key and the replicate, so lost work is redone with the same numbers.
    """
    by = list(by)
    key = list(cell_key)
    rep = cells.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    n = F.col(size).cast("double")
    few = F.aggregate(F.sequence(F.lit(1), F.least(F.col(size), F.lit(30)).cast("int")), F.lit(0),
                      lambda acc, i: acc + poisson_one(*key, "replicate", i, seed=seed))
    many = F.greatest(F.round(n + F.sqrt(n) * hash_normal(*key, "replicate", seed=seed)), F.lit(0.0))
    w = F.when(n <= 30, few.cast("double")).otherwise(many)
    rep = rep.withColumn("_w", w)
    mean = F.try_divide(F.sum(F.col("_w") * F.col(total) / n), F.sum("_w"))
    return rep.groupBy(*by, "replicate").agg(mean.alias("mean"))


def percentile_interval(reps: DataFrame, by, value="mean", level=0.95) -> DataFrame:
    """Percentile interval over replicates (a bounded number of rows per group)."""
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    return reps.groupBy(*by).agg(F.avg(value).alias("estimate"), F.percentile(value, F.lit(lo)).alias("lower"),
                                 F.percentile(value, F.lit(hi)).alias("upper"),
                                 F.count(F.lit(1)).alias("replicates"))
