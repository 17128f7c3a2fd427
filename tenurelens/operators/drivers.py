"""Per-row risk drivers without moving rows: contributions live in an array next to each row."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenurelens.functions.columns import clamp

# fixed values: features that trigger a recommendation
SALARY_FACTORS = ["baseline_salary", "compensation_percentile_company", "peer_salary_ratio", "salary_growth_rate_12m"]
PROMOTION_FACTORS = ["time_since_last_promotion", "promotion_velocity", "pay_grade_stagnation_months", "days_since_promot"]
TEAM_FACTORS = ["time_with_current_manager", "team_turnover_rate", "team_size", "manager_span_control"]


def contributions(df: DataFrame, eta, features, risk_stats: dict) -> DataFrame:
    """Add array ``drivers`` of (feature, contribution): risk minus risk with the feature blanked.

    A number is blanked to 0 and a text to 'Unknown'.  ``eta(get)`` builds the
    location from a function that maps a feature name to its column.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    span = risk_stats["max"] - risk_stats["min"]
    used = [f for f in features if f in kinds]
    risk = lambda e: clamp((-e - risk_stats["min"]) / span, 0.0, 1.0)

    def blanked(feature):
        """Columns in which the named feature is blank."""
        def get(name):
            if name != feature:
                return F.col(name)
            return F.lit("Unknown") if isinstance(kinds[name], T.StringType) else F.lit(0).cast(kinds[name])
        return get

    # a column per feature: the terms they share are worked out once, in generated code
    names = {f: f"_eta_{i}" for i, f in enumerate(used)}
    d = df.select("*", eta(F.col).alias("_eta"), *[eta(blanked(f)).alias(c) for f, c in names.items()]).withColumn("risk", risk(F.col("_eta")))
    change = [F.struct(F.lit(f).alias("feature"), (F.col("risk") - risk(F.col(c))).alias("contribution")) for f, c in names.items()]
    return d.withColumn("drivers", F.array(*change)).drop("_eta", *names.values())


def fold_to_source(df: DataFrame, lineage: dict, features) -> DataFrame:
    """Keep, per source feature, the driver of largest absolute contribution (first one of equals).

    ``features`` are those given to ``contributions``, in the same order.
    """
    groups = {}
    for i, f in enumerate(features):
        groups.setdefault(lineage.get(f, f), []).append(i)

    def strongest(members):
        c = [F.col("drivers")[i]["contribution"] for i in members]
        ranked = [F.struct(F.abs(x).alias("size"), F.lit(-i).alias("order"), x.alias("contribution")) for i, x in zip(members, c)]
        return (F.greatest(*ranked) if len(ranked) > 1 else ranked[0])["contribution"]

    kept = [F.struct(F.lit(name).alias("feature"), strongest(m).alias("contribution")) for name, m in groups.items()]
    return df.withColumn("drivers", F.array(*kept))


def _strongest(cond, n) -> Column:
    keyed = F.transform(F.filter("drivers", cond), lambda d: F.struct((-F.abs(d["contribution"])).alias("k"), d["feature"].alias("feature"), d["contribution"].alias("contribution")))
    return F.slice(F.transform(F.array_sort(keyed), lambda d: F.struct(d["feature"].alias("feature"), d["contribution"].alias("contribution"))), 1, n)


def top_factors(df: DataFrame, n=5) -> DataFrame:
    """The n strongest risk factors (contribution > 0) and protective factors (<= 0)."""
    return df.withColumns({"risk_factors": _strongest(lambda d: d["contribution"] > 0, n), "protective_factors": _strongest(lambda d: d["contribution"] <= 0, n)})


def factors_long(df: DataFrame, keys=("person_composite_id", "vantage_date")) -> DataFrame:
    """One row per person, side and rank."""
    side = lambda name: df.select(*keys, F.lit(name).alias("side"), F.posexplode(name + "_factors").alias("rank", "d"))
    both = side("risk").unionByName(side("protective"))
    return both.select(*keys, "side", (F.col("rank") + 1).alias("rank"), "d.feature", "d.contribution")


def recommendations(df: DataFrame, salary_ite=None, promotion_ite=None) -> DataFrame:
    """Up to three recommendations by the kinds of risk factors, best priority first.

    With the individual effects at hand an intervention is proposed only where it
    helps, with priority 1 above .05; without them a review is proposed.
    """
    has = lambda names: F.exists("risk_factors", lambda d: d["feature"].isin(names))
    rec = lambda p, text: F.struct(F.lit(p).alias("priority"), F.lit(text).alias("intervention"))

    def rule(names, ite, order, active, passive):
        if ite is None:
            return F.when(has(names), F.struct(F.lit(2).alias("priority"), F.lit(order).alias("order"), F.lit(passive).alias("intervention")))
        p = F.when(F.col(ite) > 0.05, 1).otherwise(2)
        return F.when(has(names) & (F.col(ite) > 0), F.struct(p.alias("priority"), F.lit(order).alias("order"), F.lit(active).alias("intervention")))

    team = F.when(has(TEAM_FACTORS), F.struct(F.lit(3).alias("priority"), F.lit(3).alias("order"), F.lit("Team/Manager Discussion").alias("intervention")))
    all_ = F.array(rule(SALARY_FACTORS, salary_ite, 1, "15% Salary Increase", "Review Compensation"),
                   rule(PROMOTION_FACTORS, promotion_ite, 2, "Promotion", "Career Development Review"), team)
    best = F.slice(F.array_sort(F.filter(all_, lambda r: r.isNotNull())), 1, 3)
    return df.withColumn("recommendations", F.transform(best, lambda r: F.struct(r["priority"].alias("priority"), r["intervention"].alias("intervention"))))


def common_factors(df: DataFrame, cohort: Column, n=3, k=5) -> DataFrame:
    """The k most frequent top-n risk factors of a cohort, over all of its people."""
    d = top_factors(df.where(cohort), n)
    size = max(d.count(), 1)
    f = d.select(F.explode("risk_factors").alias("d")).groupBy(F.col("d.feature").alias("feature")).agg(F.count(F.lit(1)).alias("n"))
    return f.orderBy(F.desc("n"), "feature").limit(k).select("feature", "n", (F.col("n") / F.lit(size) * 100).alias("frequency_pct"))
