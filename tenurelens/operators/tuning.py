"""Model search over distributions, penalties and scales, and analysis of the trial history."""
from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenurelens.functions.scale import summed_arrays
from tenurelens.operators.aft import DISTRIBUTIONS, Candidate, fit_candidates, log_density_of, log_survival_of
from tenurelens.operators.metrics import concordance


def candidate_grid(dists=DISTRIBUTIONS, ridges=(0.0, 100.0), scales=(None,)) -> list[Candidate]:
    """Every combination; a scale of None is fitted with the coefficients."""
    return [Candidate(d, float(r), s) for d, r, s in product(dists, ridges, scales)]


def run_trials(train: DataFrame, val: DataFrame, features, candidates: list[Candidate] | None = None) -> DataFrame:
    """Fit all candidates on train in the same passes; report -mean log-likelihood, concordance and slope on validation.

    One further pass over the validation rows gives every candidate's likelihood and slope, and one table of
    (trial, day, score) every candidate's concordance.  ``loglik`` is the penalised one on train, ``scale`` is the one asked for (null: fitted), ``gradient`` the largest
    component of the penalised likelihood's gradient a row at the end.
    """
    candidates = candidates or candidate_grid()
    models = fit_candidates(train, features, candidates)
    score, slope = validation(val, models)
    etas = F.explode(F.array(*[F.struct(F.lit(i).alias("trial"), (-m.eta()).alias("risk")) for i, m in enumerate(models, 1)]))
    long = val.select("time", "event", etas.alias("_c")).select("time", "event", "_c.trial", "_c.risk")
    c_index = {r["trial"]: r["c_index"] for r in concordance(long, "risk", ["trial"]).collect()}
    rows = [(i, m.dist, c.ridge, c.sigma, m.sigma, m.loglik, float(s), c_index.get(i), float(b), m.steps, m.gradient)
            for i, (c, m, s, b) in enumerate(zip(candidates, models, score, slope), 1)]
    return train.sparkSession.createDataFrame(rows, "trial int, dist string, ridge double, scale double, sigma double, loglik double, score double, c_index double, calibration_slope double, steps int, gradient double")


def validation(val: DataFrame, models) -> tuple[np.ndarray, np.ndarray]:
    """-mean log-likelihood (terms that aren't finite left out) and slope of all models, from one pass."""
    features = models[0].features
    data = val.select(*[F.col(c).cast("double").alias(c) for c in features], F.log(F.col("time").cast("double")).alias("_y"), (F.col("event") == 1).cast("double").alias("_e"))

    def sums(c):
        x = np.column_stack([np.ones(len(c["_y"])), *[c[f] for f in features]])
        event, out = c["_e"] == 1, []
        with np.errstate(all="ignore"):
            for m in models:
                eta = x @ np.array([m.intercept, *m.coefficients])
                z = (c["_y"] - eta) / m.sigma
                term = np.where(event, log_density_of(m.dist, z) - np.log(m.sigma), log_survival_of(m.dist, z))
                ok, both = np.isfinite(term), event & np.isfinite(eta)
                y, p = c["_y"][both], eta[both]
                out += [np.where(ok, term, 0).sum(), ok.sum(), len(p), y.sum(), p.sum(), y @ y, p @ p, y @ p]
        return np.array(out, dtype=float)

    got = summed_arrays(data, sums).reshape(-1, 8)
    l, n, k, y, p, yy, pp, yp = got.T
    with np.errstate(all="ignore"):
        r = (yp / k - y / k * p / k) / np.sqrt((yy / k - (y / k) ** 2) * (pp / k - (p / k) ** 2))
    return -l / n, np.where(k < 10, 1.0, np.where(np.isfinite(r), r, 0.0))


def trial_history(trials: DataFrame) -> DataFrame:
    """Best score so far and its change per trial (trials are few: one small window)."""
    w = W.partitionBy(F.lit(0)).orderBy("trial")
    best = F.min("score").over(w.rowsBetween(W.unboundedPreceding, 0))
    return trials.withColumn("best_score", best).withColumn("improvement", F.col("best_score") - F.lag("best_score").over(w))


def convergence(trials: DataFrame) -> DataFrame:
    """Final score, total gain, mean of the last 10 and deviation of the last 20 changes; time used where ``seconds`` are given."""
    h = trial_history(trials)
    back = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("trial")))
    h = h.withColumn("_back", back)
    n = F.count("improvement")
    tail = lambda k: F.when((F.col("_back") <= k), F.col("improvement"))
    return h.agg(F.min("score").alias("final_score"), (F.min_by("score", "trial") - F.min("score")).alias("total_improvement"),
                 F.when(n >= 10, F.avg(tail(10))).otherwise(0.0).alias("convergence_rate"),
                 F.when(n >= 20, F.stddev_pop(tail(20))).otherwise(0.0).alias("stability"),
                 *([(F.sum("seconds") / 3600).alias("total_compute_hours"), (F.avg("seconds") / 60).alias("average_trial_minutes")] if "seconds" in trials.columns else []))
