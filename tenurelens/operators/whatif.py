"""What-if interventions: change features, score again, measure the effect."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurelens.functions.bootstrap import percentile_interval, replicate_means
from tenurelens.functions.columns import cap, clamp, normal_cdf, ratio, stack
from tenurelens.operators.aft import event_probability, survival, zscore
from tenurelens.schema import HORIZONS

# fixed values: default size and cost of each intervention, replacement cost
MAGNITUDE = {"promotion": 1.0, "salary_increase": 0.15, "role_change": 1.0}
COST = {"promotion": 15000.0, "role_change": 5000.0}
REPLACEMENT = 75000.0
NEXT_STAGE = {"Early": "Mid", "Mid": "Late", "Late": "Senior"}


def _change(df: DataFrame, changes: dict) -> DataFrame:
    """Apply all changes to the columns that exist, each computed from the original values."""
    return df.withColumns({c: f for c, f in changes.items() if c in df.columns})


def raise_salary(df: DataFrame, pct=0.15, rules="business") -> DataFrame:
    """Salary increase; percentiles are on 0..1 and stop at .95.

    ``business`` is the short rule set, ``causal`` also moves quarterly pay, ratios,
    the team average (by the raise of the old salary) and volatility.
    """
    c, up = F.col, 1.0 + pct
    if rules == "business":
        return _change(df, {
            "baseline_salary": c("baseline_salary") * up,
            "salary_growth_rate_12m": F.greatest(F.coalesce("salary_growth_rate_12m", F.lit(0.0)), F.lit(pct)) if "salary_growth_rate_12m" in df.columns else None,
            "compensation_percentile_company": cap(F.coalesce("compensation_percentile_company", F.lit(0.5)) + pct, 0.95),
            "peer_salary_ratio": c("peer_salary_ratio") * up})
    rank = lambda n: cap(c(n) + pct * 0.67, 0.95)
    team = c("team_avg_comp") + c("baseline_salary") * pct / F.coalesce(c("team_size"), F.lit(10)) if {"baseline_salary", "team_size"} <= set(df.columns) else c("team_avg_comp")
    changes = {n: c(n) * up for n in ("baseline_salary", "avg_salary_last_quarter", "salary_growth_rate12m_to_cpi_rate", "peer_salary_ratio", "sal_nghb_ratio")}
    changes |= {"salary_growth_rate_12m": F.greatest(F.coalesce("salary_growth_rate_12m", F.lit(pct)), F.lit(pct)),
                "compensation_percentile_company": rank("compensation_percentile_company"),
                "compensation_percentile_industry": rank("compensation_percentile_industry"),
                "team_avg_comp": team, "compensation_volatility": c("compensation_volatility") * 0.7}
    return _change(df, changes)


def promote(df: DataFrame, step=1.0, rules="business") -> DataFrame:
    """Promotion: level up to 10, timers to 0; ``causal`` also sets stage, flags and counts.

    Levels that are not numbers stay as they are.
    """
    c = F.col

    def level(n, text):
        v = c(n).try_cast("int") if text else c(n)
        return F.coalesce(cap(v + int(step), 10).cast("string"), c(n)) if text else cap(v + step, 10.0)

    kind = dict(df.dtypes)
    levels = {n: level(n, kind[n] == "string") for n in ("job_level", "mngr_lvl_cd") if n in kind}
    if rules == "business":
        return _change(df, {**levels, "time_since_last_promotion": F.lit(0),
                            "promotion_velocity": F.greatest(F.coalesce("promotion_velocity", F.lit(0.0)) * 1.5, F.lit(30.0))})
    stage = c("career_stage")
    for old, new in NEXT_STAGE.items():
        stage = F.when(c("career_stage") == old, new).otherwise(stage)
    zero = ["time_since_last_promotion", "days_since_promot", "pay_grade_stagnation_months", "tenure_in_current_role", "demot_2yr_ind"]
    one = ["promot_2yr_ind", "promot_2yr_titlechng_ind", "promot_2yr_perf_ind", "promot_2yr_mktadjst_ind", "job_chng_2yr_ind"]
    levels.pop("mngr_lvl_cd", None)
    return _change(df, {**levels, "career_stage": stage, **{n: F.lit(0) for n in zero}, **{n: F.lit(1) for n in one},
                        "num_promot_2yr": cap(c("num_promot_2yr") + 1, 3), "promotion_velocity": c("promotion_velocity") * 1.5,
                        "role_complexity_score": cap(c("role_complexity_score") * 1.2, 5.0)})


def change_role(df: DataFrame, step=1.0) -> DataFrame:
    return _change(df, {"role_complexity_score": cap(F.col("role_complexity_score") + step, 5.0),
                        "decision_making_authority_indicator": cap(F.col("decision_making_authority_indicator") + step, 10.0),
                        "tenure_in_current_role": F.lit(0)})


def apply(df: DataFrame, kind: str, magnitude=None, rules="business") -> DataFrame:
    m = MAGNITUDE[kind] if magnitude is None else magnitude
    if kind == "salary_increase":
        return raise_salary(df, m, rules)
    return promote(df, m, rules) if kind == "promotion" else change_role(df, m)


def before_after(df: DataFrame, model, kind: str, dist: str, sigma: float, risk_stats: dict, horizons=HORIZONS, magnitude=None,
                 rules="business", keep=("person_composite_id", "vantage_date")) -> DataFrame:
    """Score every row before and after in one projection.

    ``model`` offers ``eta()``, a column over the features.  Output: risk and survival
    at each horizon, before (0) and after (1), and the baseline salary.
    """
    salary = [F.col("baseline_salary").alias("_salary")] if "baseline_salary" in df.columns else [F.lit(None).cast("double").alias("_salary")]
    d = df.select("*", model.eta().alias("_eta0"), *salary)
    d = apply(d, kind, magnitude, rules).withColumn("_eta1", model.eta())
    span = risk_stats["max"] - risk_stats["min"]
    risk = lambda e: clamp((-F.col(e) - risk_stats["min"]) / span, 0.0, 1.0, known=e)
    cols = [risk("_eta0").alias("risk0"), risk("_eta1").alias("risk1")]
    cols += [survival(dist, zscore(F.lit(h), f"_eta{i}", sigma)).alias(f"surv{i}_{h}") for h in horizons for i in (0, 1)]
    return d.select(*[k for k in keep if k in d.columns], *cols, F.col("_salary").alias("baseline_salary"))


def impact(ba: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Mean risk before and after, its change, share improved and survival gain per horizon."""
    cut = F.col("risk0") - F.col("risk1")
    return ba.agg(F.count(F.lit(1)).alias("sample_size"), F.avg("risk0").alias("risk_before"), F.avg("risk1").alias("risk_after"),
                  F.avg(cut).alias("mean_risk_reduction"), F.stddev_pop(cut).alias("risk_reduction_std"),
                  (F.avg((cut > 0).cast("double")) * 100).alias("percentage_improved"),
                  *[F.avg(F.col(f"surv1_{h}") - F.col(f"surv0_{h}")).alias(f"survival_gain_{h}d") for h in horizons])


def paired_test(ba: DataFrame) -> DataFrame:
    """t of the paired differences, effect size over the deviation before, label."""
    d = F.col("risk0") - F.col("risk1")
    g = ba.agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("_m"), F.stddev_samp(d).alias("_s"), F.stddev_pop("risk0").alias("_s0"))
    t, e = ratio(F.col("_m"), F.col("_s") / F.sqrt("n")), ratio("_m", "_s0", 0.0)
    label = F.when(F.abs("effect_size") > 0.8, "Large effect").when(F.abs("effect_size") > 0.5, "Medium effect").otherwise("Small effect")
    return g.select("n", t.alias("t_statistic"), e.alias("effect_size")).withColumn("interpretation", label).withColumn(
        "p_value", 2.0 * (1.0 - normal_cdf(F.abs("t_statistic"))))


def return_on_investment(ba: DataFrame, kind: str, magnitude=None) -> DataFrame:
    """Cost, people kept (risk down by more than .1), benefit, ROI and payback."""
    unit = 75000.0 * (MAGNITUDE[kind] if magnitude is None else magnitude) if kind == "salary_increase" else COST[kind]
    g = ba.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("risk0") - F.col("risk1") > 0.1).alias("retained"))
    cost, gain = F.col("n") * unit, F.col("retained") * REPLACEMENT
    pay = F.when(gain > 0, F.greatest(cost / F.greatest(gain / 12, F.lit(1e-9)), F.lit(1.0))).otherwise(F.lit(float("inf")))
    return g.select(F.lit(unit).alias("cost_per_employee"), cost.alias("total_cost"), "retained", gain.alias("benefit"),
                    ((gain - cost) / F.greatest(cost, F.lit(1.0)) * 100).alias("roi_percentage"), pay.alias("payback_months"))


def action_plans(ba: DataFrame, threshold=0.67, magnitude=0.15, horizons=HORIZONS) -> DataFrame:
    """Plan per high-risk row: survival, expected change, cost, priority; highest priority first."""
    d = F.col("risk0") - F.col("risk1")
    out = ba.where(F.col("risk0") >= threshold)
    keys = [c for c in ("person_composite_id", "vantage_date") if c in ba.columns]
    return out.select(*keys, F.col("risk0").alias("risk_score"), *[F.col(f"surv0_{h}").alias(f"survival_{h}d") for h in horizons],
                      d.alias("risk_reduction"), (d / F.greatest("risk0", F.lit(0.01)) * 100).alias("relative_improvement"),
                      F.when(d > 0.05, "Positive").otherwise("Minimal").alias("expected_outcome"),
                      (F.coalesce("baseline_salary", F.lit(75000.0)) * magnitude).alias("estimated_cost"),
                      (F.col("risk0") * 0.7 + d * 100 * 0.3).alias("priority_score")).orderBy(F.desc("priority_score"), *keys)


def individual_effects(df: DataFrame, model, kind: str, dist: str, sigma: float, horizon=365, magnitude=None,
                       keep=("person_composite_id", "vantage_date")) -> DataFrame:
    """Effect per row: event probability at the horizon before minus after."""
    d = apply(df.withColumn("_eta0", model.eta()), kind, magnitude, "causal").withColumn("_eta1", model.eta())
    p = lambda e: event_probability(dist, sigma, horizon, e)
    return d.select(*keep, p("_eta0").alias("p0"), (p("_eta0") - p("_eta1")).alias("ite"), (p("_eta0") - p("_eta1") > 0.05).alias("recommended"))


def average_effect(ite: DataFrame, by=()) -> DataFrame:
    """Mean effect, its standard error (deviation over root n), z and p, share of responders."""
    g = ite.groupBy(*by).agg(F.count(F.lit(1)).alias("sample_size"), F.avg("ite").alias("ate"), F.stddev_pop("ite").alias("_s"),
                             (F.avg((F.col("ite") > 0).cast("double")) * 100).alias("responders_pct"))
    se = F.col("_s") / F.sqrt("sample_size")
    g = g.withColumns({"standard_error": se, "z": ratio("ate", se, 0.0)})
    return g.withColumn("p_value", 2.0 * (1.0 - normal_cdf(F.abs("z")))).withColumn("significant", F.col("p_value") < 0.05).drop("_s")


def bootstrap_effect(values: DataFrame, column: str, replicates=500, cells=512, seed=42) -> DataFrame:
    """Percentile interval of a mean effect in -1..1; rows are summed into cells of equal size first."""
    cell = F.floor((F.col(column) + 1.0) * (cells / 2)).cast("int")
    d = values.groupBy(cell.alias("cell")).agg(F.sum(column).alias("total"), F.count(F.lit(1)).alias("n"))
    return percentile_interval(replicate_means(d, [], "total", "n", replicates, seed, ["cell"]), [])


def effect_intervals(df: DataFrame, model, dist: str, sigma: float, horizon=365, replicates=500) -> DataFrame:
    """Percentile interval of the average effect of each intervention, one row each."""
    parts = [bootstrap_effect(individual_effects(df, model, k, dist, sigma, horizon), "ite", replicates).withColumn("intervention", F.lit(k)) for k in PRIORITY]
    return reduce(DataFrame.unionByName, parts)


def bootstrap_impact(ba: DataFrame, horizons=HORIZONS, replicates=500) -> DataFrame:
    """Intervals of the risk reduction and of the survival gain at each horizon."""
    long = stack(ba.select((F.col("risk0") - F.col("risk1")).alias("risk_reduction"), *[(F.col(f"surv1_{h}") - F.col(f"surv0_{h}")).alias(f"survival_gain_{h}d") for h in horizons]),
                 ["risk_reduction"] + [f"survival_gain_{h}d" for h in horizons], name="metric")
    d = long.groupBy("metric", F.floor((F.col("value") + 1.0) * 256).cast("int").alias("cell")).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
    return percentile_interval(replicate_means(d, ["metric"], "total", "n", replicates, 42, ["metric", "cell"]), ["metric"])


# fixed values: yearly cost per person of each intervention and the effect that counts as strong
PRIORITY = {"salary_increase": (10000, 0.10), "promotion": (5000, 0.08)}


def priority_actions(effects: DataFrame) -> DataFrame:
    """Interventions with a significant effect above .03: people kept, cost, return, priority."""
    cost, strong = F.lit(0), F.lit(0.0)
    for kind, (c, s) in PRIORITY.items():
        cost = F.when(F.col("intervention") == kind, c).otherwise(cost)
        strong = F.when(F.col("intervention") == kind, s).otherwise(strong)
    d = effects.where(F.col("significant") & (F.col("ate") > 0.03)).withColumns({"_c": cost, "_s": strong})
    good = F.col("ate") > F.col("_s")
    return d.select("intervention", "ate", F.floor(F.col("sample_size") * F.col("ate")).alias("expected_retention"),
                    (F.col("_c") * F.col("sample_size")).alias("estimated_cost"), F.when(good, "Positive").otherwise("Neutral").alias("roi_estimate"),
                    F.when(good, 1).otherwise(2).alias("priority"))


def population_effects(df: DataFrame, model, dist: str, sigma: float, horizon=365) -> DataFrame:
    """Average effect of the two interventions, one row each."""
    parts = [average_effect(individual_effects(df, model, k, dist, sigma, horizon)).withColumn("intervention", F.lit(k)) for k in PRIORITY]
    return reduce(DataFrame.unionByName, parts)
