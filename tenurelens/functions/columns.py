"""Column expressions: guarded arithmetic, distributions, bands and unpivoting."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a, b, default=None) -> Column:
    """a / b as double; ``default`` where b is 0 or either side is null."""
    r = F.try_divide(col(a).cast("double"), col(b).cast("double"))
    return r if default is None else F.coalesce(r, F.lit(default))


def clamp(c, low, high, known=None) -> Column:
    """Value cut to [low, high]; null stays null (least and greatest skip nulls).

    ``known`` is a cheaper column that is null exactly where the value is.
    """
    c = col(c)
    given = c if known is None else col(known)
    return F.when(given.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def cap(c, high) -> Column:
    """Value cut from above; null stays null."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(c, F.lit(high)))


def one_row(*frames: DataFrame) -> DataFrame:
    """Columns of several one-row tables side by side, without a join."""
    both = frames[0]
    for f in frames[1:]:
        both = both.unionByName(f, allowMissingColumns=True)
    return both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns])


def r6(c) -> Column:
    """Round for reports; adding 0.0 turns a negative zero into zero."""
    return F.round(col(c), 6) + F.lit(0.0)


def flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def ladder(c, steps, otherwise, op="<") -> Column:
    """First band whose limit the value meets: ``steps`` is [(limit, label), ...]."""
    c = col(c)
    test = {"<": c.__lt__, "<=": c.__le__, ">=": c.__ge__, ">": c.__gt__}[op]
    out = None
    for limit, label in steps:
        out = F.when(test(limit), F.lit(label)) if out is None else out.when(test(limit), F.lit(label))
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def same_text(c, values) -> Column:
    """Case-insensitive membership in a list of codes."""
    return F.upper(col(c)).isin([v.upper() for v in values])


def erf(x: Column) -> Column:
    """Error function, Abramowitz and Stegun 7.1.26 (absolute error below 1.5e-7)."""
    # fixed values: published polynomial coefficients
    p, a = 0.3275911, [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]
    t = 1.0 / (1.0 + p * F.abs(x))
    poly = t * (a[0] + t * (a[1] + t * (a[2] + t * (a[3] + t * a[4]))))
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def normal_cdf(z: Column) -> Column:
    return 0.5 * (1.0 + erf(z / math.sqrt(2.0)))


def log_normal_sf(z: Column) -> Column:
    """ln(1 - Phi(z)); the asymptotic series takes over where the difference vanishes."""
    inv = 1.0 / (z * z)
    tail = -z * z / 2.0 - F.log(z * math.sqrt(2.0 * math.pi)) + F.log1p(-inv * (1.0 - 3.0 * inv * (1.0 - 5.0 * inv)))
    return F.when(z > 4.0, tail).otherwise(F.log(F.greatest(1.0 - normal_cdf(z), F.lit(1e-300))))


def stack(df: DataFrame, columns, keep=(), name="column_name", value="value", cast=None) -> DataFrame:
    """Long form of ``columns``: one row per input row and column."""
    pick = [F.struct(F.lit(c).alias(name), (F.col(c).cast(cast) if cast else F.col(c)).alias(value)) for c in columns]
    return (df.select(*keep, F.explode(F.array(*pick)).alias("_kv"))
              .select(*keep, F.col(f"_kv.{name}").alias(name), F.col(f"_kv.{value}").alias(value)))


def unpivot_stats(row: DataFrame, columns, stats, keep=(), name="column_name") -> DataFrame:
    """Turn one wide row with ``{column}__{stat}`` cells into one row per column."""
    pick = [F.struct(F.lit(c).alias(name), *[F.col(f"`{c}__{s}`").alias(s) for s in stats]) for c in columns]
    return row.select(*keep, F.explode(F.array(*pick)).alias("_s")).select(*keep, "_s.*")


def correlation(a, b) -> Column:
    """Aggregate: Pearson correlation over rows where both are present, null where one is constant."""
    a, b = col(a).cast("double"), col(b).cast("double")
    sd = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
    return F.try_divide(F.covar_pop(a, b), sd)
