"""Accelerated-failure-time model: likelihood, grid search, fit, survival curves, risk scores.

z = (ln t - eta) / sigma with normal, logistic or minimum-Gumbel (``extreme``) errors.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenurelens.functions import arrays
from tenurelens.functions.columns import clamp, correlation, log_normal_sf, normal_cdf, ratio
from tenurelens.functions.scale import exact_quantiles, summed_arrays
from tenurelens.schema import HORIZONS, MAX_DAY

DISTRIBUTIONS = ["normal", "logistic", "extreme"]
CLIP = 1e-6
# fixed value: Phi^-1(0.75), the deviation of a normal variable covered by its median
MAD_SCALE = 0.6744897501960817


def zscore(t, eta="eta", sigma=1.0) -> Column:
    t = F.col(t) if isinstance(t, str) else t
    eta = F.col(eta) if isinstance(eta, str) else eta
    sigma = sigma if isinstance(sigma, Column) else F.lit(float(sigma))
    return (F.log(t.cast("double")) - eta) / sigma


def raw_survival(dist: str, z: Column) -> Column:
    if dist == "normal":
        return 1.0 - normal_cdf(z)
    if dist == "logistic":
        return 1.0 / (1.0 + F.exp(z))
    if dist == "extreme":
        return F.exp(-F.exp(z))
    raise ValueError(f"unknown distribution {dist}")


def survival(dist: str, z: Column) -> Column:
    """S clipped away from 0 and 1."""
    return clamp(raw_survival(dist, z), CLIP, 1.0 - CLIP, known=z)


def event_probability(dist: str, sigma: float, horizon, eta="eta") -> Column:
    h = horizon if isinstance(horizon, Column) else F.lit(float(horizon))
    return 1.0 - survival(dist, zscore(h, eta, sigma))


def log_survival(dist: str, z: Column) -> Column:
    if dist == "normal":
        return log_normal_sf(z)
    return -F.log1p(F.exp(z)) if dist == "logistic" else -F.exp(z)


def log_density(dist: str, z: Column) -> Column:
    """ln f(z) of the standard error distribution."""
    if dist == "normal":
        return -z * z / 2.0 - 0.5 * math.log(2.0 * math.pi)
    return z - 2.0 * F.log1p(F.exp(z)) if dist == "logistic" else z - F.exp(z)


def log_survival_of(dist: str, z: np.ndarray) -> np.ndarray:
    """As ``log_survival``, on arrays."""
    if dist == "normal":
        return arrays.log_normal_sf(z)
    return -np.log1p(np.exp(z)) if dist == "logistic" else -np.exp(z)


def log_density_of(dist: str, z: np.ndarray) -> np.ndarray:
    """As ``log_density``, on arrays."""
    if dist == "normal":
        return -z * z / 2.0 - 0.5 * math.log(2.0 * math.pi)
    return z - 2.0 * np.log1p(np.exp(z)) if dist == "logistic" else z - np.exp(z)


def survival_of(dist: str, z: np.ndarray) -> np.ndarray:
    """As ``survival``, on arrays."""
    raw = 1.0 - arrays.normal_cdf(z) if dist == "normal" else 1.0 / (1.0 + np.exp(z)) if dist == "logistic" else np.exp(-np.exp(z))
    return np.clip(raw, CLIP, 1.0 - CLIP)


def log_likelihood_term(dist: str, sigma, time="time", event="event", eta="eta") -> Column:
    """Contribution of one row; terms that are not finite become null and drop out of sums."""
    sigma = sigma if isinstance(sigma, Column) else F.lit(float(sigma))
    z = zscore(time, eta, sigma)
    term = F.when(F.col(event) == 1, log_density(dist, z) - F.log(sigma)).otherwise(log_survival(dist, z))
    return F.when(F.abs(term) < float("inf"), term)


def log_likelihood(df: DataFrame, sigma: float, by=(), dists=DISTRIBUTIONS) -> DataFrame:
    """Sum and negative mean of the log-likelihood per distribution."""
    ll = {d: log_likelihood_term(d, sigma) for d in dists}
    row = df.groupBy(*by).agg(*[F.sum(c).alias(f"s_{d}") for d, c in ll.items()], *[F.avg(c).alias(f"m_{d}") for d, c in ll.items()])
    cells = [F.struct(F.lit(d).alias("dist"), F.col(f"s_{d}").alias("loglik"), (-F.col(f"m_{d}")).alias("objective")) for d in dists]
    return row.select(*by, F.explode(F.array(*cells)).alias("c")).select(*by, "c.*")


def scale_grid(low=0.1, high=6.0, n=100):
    return [low + (high - low) * i / (n - 1) for i in range(n)]


def grid_likelihood(df: DataFrame, sigmas=None, dists=DISTRIBUTIONS, by=()) -> DataFrame:
    """Log-likelihood of every (distribution, sigma) cell for given eta; all cells of a row are worked out in one array."""
    sigmas, dists = [float(s) for s in sigmas or scale_grid()], list(dists)
    scale = np.array(sigmas)

    def cells(c):
        with np.errstate(all="ignore"):
            z = (np.log(c["time"]) - c["eta"])[:, None] / scale
            event = (c["event"] == 1)[:, None]
            terms = [np.where(event, log_density_of(d, z) - np.log(scale), log_survival_of(d, z)) for d in dists]
        out = np.concatenate(terms, axis=1)
        return np.where(np.isfinite(out), out, 0.0)

    sums = arrays.grouped_arrays(df.select(*by, "time", "event", "eta"), by, len(dists) * len(sigmas), cells)
    return sums.select(*by, F.element_at(F.array(*map(F.lit, dists)), F.floor(F.col("i") / len(sigmas)).cast("int") + 1).alias("dist"),
                       F.element_at(F.array(*map(F.lit, sigmas)), F.col("i") % len(sigmas) + 1).alias("sigma"), F.col("v").alias("loglik"))


def best_cell(cells: DataFrame, by=()) -> DataFrame:
    """Cell of maximum likelihood per group."""
    best = cells.groupBy(*by).agg(F.max(F.struct("loglik", "dist", "sigma")).alias("b"))
    return best.select(*by, "b.dist", "b.sigma", "b.loglik")


@dataclass
class AftModel:
    """Location model for log time: intercept, one coefficient per feature, scale, distribution."""
    features: list
    coefficients: list
    intercept: float
    sigma: float
    dist: str
    loglik: float = float("nan")
    steps: int = 0
    #: Largest component of the gradient a row, at the end of the fit.
    gradient: float = float("nan")

    def eta(self) -> Column:
        out = F.lit(float(self.intercept))
        for name, b in zip(self.features, self.coefficients):
            out = out + F.col(name) * float(b)
        return out

    def transform(self, df: DataFrame, output="eta") -> DataFrame:
        return df.withColumn(output, self.eta())


@dataclass
class Candidate:
    """What a fit is asked for: distribution, penalty on the squared scaled coefficients, and the scale (None: fitted)."""
    dist: str = "logistic"
    ridge: float = 0.0
    sigma: float | None = None


def terms_of(dist: str, z: np.ndarray, event: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood term in z, its first and its second derivative."""
    if dist == "normal":
        haz = np.exp(log_density_of("normal", z) - log_survival_of("normal", z))
        return np.where(event, log_density_of(dist, z), log_survival_of(dist, z)), np.where(event, -z, -haz), np.where(event, -1.0, -haz * (haz - z))
    if dist == "logistic":
        p, soft = 1.0 / (1.0 + np.exp(-z)), np.logaddexp(0.0, z)
        return np.where(event, z - 2.0 * soft, -soft), np.where(event, 1.0 - 2.0 * p, -p), np.where(event, -2.0, -1.0) * p * (1.0 - p)
    e = np.exp(z)
    return np.where(event, z, 0.0) - e, np.where(event, 1.0, 0.0) - e, -e


class _Search:
    """Newton steps of one candidate; ``place`` is where it wants the sums next."""

    def __init__(self, candidate: Candidate, start: np.ndarray, damping: float):
        self.of, self.damping, self.theta, self.steps = candidate, damping, start.copy(), 0
        self.free = np.arange(len(start) - (candidate.sigma is not None))
        if candidate.sigma is not None:
            self.theta[-1] = math.log(candidate.sigma)
        self.ll, self.move, self.size, self.place = -math.inf, None, 1.0, self.theta

    def judged(self, got: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Penalised likelihood, gradient and Hessian at ``place``; the powers of sigma are applied to the sums."""
        k, par = len(self.theta) - 1, self.place
        (l, e, za, zm), g, m, h = got[:4], got[4:4 + k], got[4 + k:4 + 2 * k], got[4 + 2 * k:].reshape(k, k)
        sigma, beta = math.exp(par[k]), np.array([0.0, *par[1:k], 0.0])
        grad, hess = np.append(-g / sigma, -za - e) - 2 * self.of.ridge * beta, np.empty((k + 1, k + 1))
        hess[:k, :k], hess[k, k] = h / sigma ** 2, zm
        hess[:k, k] = hess[k, :k] = m / sigma
        hess[range(1, k), range(1, k)] -= 2 * self.of.ridge
        return l - e * par[k] - self.of.ridge * float(beta @ beta), grad, hess

    def take(self, got: np.ndarray, tol: float, max_steps: int) -> bool:
        """Takes in the sums at ``place``; whether the search goes on."""
        ll, grad, hess = self.judged(got)
        first = self.move is None
        if not first and not (math.isfinite(ll) and ll >= self.ll - 1e-9 * abs(self.ll)):
            self.size /= 2  # not better: a shorter step
            if self.size <= 1e-6:
                return False
        else:
            done = not first and abs(ll - self.ll) < tol * (abs(self.ll) + 1.0)
            self.theta, self.ll, self.size, self.gradient = self.place, ll, 1.0, grad[self.free]
            if done or self.steps >= max_steps:
                return False
            self.steps += 1
            g, h, i = grad[self.free], hess[np.ix_(self.free, self.free)], self.free
            try:
                move = np.linalg.solve(h - self.damping * max(1.0, abs(np.trace(h))) * np.eye(len(i)), -g)
            except np.linalg.LinAlgError:
                move = g / max(1.0, np.abs(h).max())
            if g @ move < 0:  # not uphill: follow the gradient instead
                move = g / max(1.0, np.abs(np.diag(h)).max())
            self.move = np.zeros(len(self.theta))
            self.move[i] = move
        self.place = self.theta + self.size * self.move
        return True


def fit_candidates(df: DataFrame, features, candidates: list[Candidate], time="time", event="event", max_steps=40, tol=1e-8, damping=1e-9) -> list[AftModel]:
    """Maximum likelihood of many candidates by Newton steps, all in the same passes over the rows.

    A pass adds up, for every candidate still under way, the likelihood, gradient and Gram matrix at the place it asks for,
    be it a step or a shortened one.  So the number of passes is that of the slowest candidate.  The plan doesn't grow with features
    or candidates; the driver holds one number per candidate and pair of coefficients.  Features are centred and scaled by
    their own moments so that the systems are well conditioned.
    """
    features = list(features)
    raw = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.log(F.col(time).cast("double")).alias("_y"),
                    (F.col(event) == 1).cast("double").alias("_e")).na.drop()
    m = raw.agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("y"), F.stddev_pop("_y").alias("s"), *[F.avg(c).alias(f"m_{c}") for c in features],
                *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
    if m["y"] is None:
        raise ValueError("no complete rows to fit")
    mean, sd = np.array([m[f"m_{c}"] for c in features]), np.array([m[f"s_{c}"] or 1.0 for c in features])
    k = len(features) + 1
    start = np.zeros(k + 1)
    start[0], start[k] = m["y"], math.log(m["s"] or 1.0)
    searches = [_Search(c, start, damping) for c in candidates]
    data = raw.persist()
    try:
        open_ = searches
        while open_:
            asked = [(s.of.dist, s.place) for s in open_]

            def blocks(c):
                # for each candidate: plain sums, those with each input, and the inputs' Gram matrix
                x = np.column_stack([np.ones(len(c["_y"])), *[(c[f] - a) / b for f, a, b in zip(features, mean, sd)]])
                event, out = c["_e"] == 1, []
                with np.errstate(all="ignore"):
                    for dist, par in asked:
                        z = (c["_y"] - x @ par[:k]) / math.exp(par[k])
                        l, a, b = terms_of(dist, z, event)
                        zb = a + z * b
                        out += [np.array([l.sum(), c["_e"].sum(), z @ a, z @ zb]), a @ x, zb @ x, (x.T @ (b[:, None] * x)).ravel()]
                return np.concatenate(out)

            got = np.split(summed_arrays(data, blocks), len(asked))
            open_ = [s for s, g in zip(open_, got) if s.take(g, tol, max_steps)]
        models = []
        for s in searches:
            coef = s.theta[1:k] / sd
            models.append(AftModel(features, coef.tolist(), float(s.theta[0] - (coef * mean).sum()), float(math.exp(s.theta[k])), s.of.dist, float(s.ll), s.steps,
                                   float(np.abs(s.gradient).max() / m["n"])))
        return models
    finally:
        data.unpersist()


def fit_aft(df: DataFrame, features, dist="logistic", time="time", event="event", max_steps=40, tol=1e-8, ridge=0.0, damping=1e-9) -> AftModel:
    """Maximum likelihood of one distribution; ``ridge`` times the sum of squared scaled coefficients is taken from the likelihood,
    ``damping`` only steadies the steps."""
    return fit_candidates(df, features, [Candidate(dist, ridge)], time, event, max_steps, tol, damping)[0]


def survival_curves(df: DataFrame, dist: str, sigma: float, times=None, keep=("id",)) -> DataFrame:
    """Long table (keys, t, surv) for the wanted days, all of 1..365 by default."""
    days = F.sequence(F.lit(1), F.lit(MAX_DAY)) if times is None else F.array(*[F.lit(int(t)) for t in times])
    long = df.select(*keep, "eta", F.explode(days).alias("t"))
    return long.select(*keep, "t", survival(dist, zscore("t", "eta", sigma)).alias("surv"))


def survival_at_horizons(df: DataFrame, dist: str, sigma: float, horizons=HORIZONS) -> DataFrame:
    """Wide columns ``surv_<h>d``."""
    return df.withColumns({f"surv_{h}d": survival(dist, zscore(F.lit(h), "eta", sigma)) for h in horizons})


def risk_statistics(df: DataFrame) -> dict:
    """Range of -eta on the reference (validation) rows."""
    r = df.agg(F.min(-F.col("eta")).alias("min"), F.max(-F.col("eta")).alias("max"), F.avg(-F.col("eta")).alias("mean"),
               F.stddev_pop("eta").alias("std")).first()
    return r.asDict()


def risk_scores(df: DataFrame, stats: dict, output="risk") -> DataFrame:
    """-eta scaled by the reference range and cut to 0..1 (0 where the range is empty)."""
    span = stats["max"] - stats["min"]
    raw = (-F.col("eta") - stats["min"]) / span if span else F.lit(0.0)
    return df.withColumn(output, clamp(raw, 0.0, 1.0, known="eta"))


def residual_scales(df: DataFrame, by=()) -> DataFrame:
    """Scale estimates from event residuals: normal RMS, MAD, logistic and Gumbel moments.

    Floors and fall-backs: at least 0.1; fewer than 10 events use the robust form,
    fewer than 5 give 1.
    """
    by = list(by)
    r = df.where(F.col("event") == 1).select(*by, (F.log("time") - F.col("eta")).alias("r"))
    med = exact_quantiles(r, by, "r", {"_med": 0.5})
    if by:
        dev = r.join(med, by)
    else:
        dev = r.withColumn("_med", F.lit(med.first()["_med"]))
    mad = exact_quantiles(dev.withColumn("_d", F.abs(F.col("r") - F.col("_med"))), by, "_d", {"mad": 0.5})
    m = r.groupBy(*by).agg(F.count("r").alias("n"), F.sum(F.col("r") * F.col("r")).alias("_ss"), F.stddev_pop("r").alias("_sd"))
    m = m.join(mad, by) if by else m.withColumn("mad", F.lit(mad.first()["mad"]))
    n = F.col("n")
    robust = F.when(n < 5, 1.0).otherwise(F.greatest(F.col("mad") / MAD_SCALE, F.lit(0.1)))
    rms = F.sqrt(F.col("_ss") / n) * F.when((n < 30) & (n > 1), F.sqrt(n / (n - 1))).otherwise(1.0)
    moment = lambda c: F.when(n < 5, 1.0).otherwise(F.greatest(F.col("_sd") * c, F.lit(0.1)))
    return m.select(*by, "n", F.when(n < 10, robust).otherwise(F.greatest(rms, F.lit(0.1))).alias("sigma_normal"),
                    robust.alias("sigma_robust"), moment(math.sqrt(3) / math.pi).alias("sigma_logistic"),
                    moment(math.sqrt(6) / math.pi).alias("sigma_extreme"))


def mle_scale(df: DataFrame, dist: str, by=(), low=0.1, high=5.0, n=50, rounds=3) -> DataFrame:
    """Scale of maximum likelihood over events, by repeated grids around the best cell."""
    ev = df.where(F.col("event") == 1)
    sigmas, step = scale_grid(low, high, n), (high - low) / (n - 1)
    for _ in range(rounds - 1):
        b = best_cell(grid_likelihood(ev, sigmas, [dist])).first()
        lo, hi = max(low, b["sigma"] - step), min(high, b["sigma"] + step)
        sigmas, step = scale_grid(lo, hi, n), (hi - lo) / (n - 1)
    return best_cell(grid_likelihood(ev, sigmas, [dist]))


def hazard(dist: str, sigma: float, t="time", eta="eta") -> Column:
    """Hazard of the survival time at day ``t``."""
    z, day = zscore(t, eta, sigma), F.col(t) if isinstance(t, str) else t
    if dist == "normal":
        pdf = F.exp(log_density("normal", z)) / (sigma * day)
        return pdf / (raw_survival("normal", z) + 1e-8)
    e = F.exp(z)
    return e / (sigma * day * (1.0 + e)) if dist == "logistic" else e / (sigma * day)


def prediction_statistics(df: DataFrame, by=("dataset",)) -> DataFrame:
    """Size, event rate and moments of eta and of predicted time."""
    pt = F.exp("eta")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sample_size"), F.avg("event").alias("event_rate"), F.avg("eta").alias("mean_log"),
        F.stddev_pop("eta").alias("std_log"), F.avg(pt).alias("mean_time"), F.stddev_pop(pt).alias("std_time"),
        (F.max(pt) - F.min(pt)).alias("range_time"), F.count_distinct("eta").alias("unique_predictions"),
        ratio(F.stddev_pop(pt), F.avg(pt)).alias("coefficient_of_variation"))


def feature_importance(model: AftModel, df: DataFrame, lineage: DataFrame) -> DataFrame:
    """|coefficient| x deviation of each input, with its source column and transformation."""
    row = df.agg(*[(F.stddev_pop(c) * abs(float(b))).alias(c) for c, b in zip(model.features, model.coefficients)])
    from tenurelens.functions.columns import stack
    imp = stack(row, model.features, name="feature", value="importance", cast="double")
    return imp.join(lineage, "feature", "left").select(
        "feature", F.coalesce("source", "feature").alias("original_feature"), F.coalesce("step", F.lit("direct")).alias("transformation"), "importance")


def curve_quality(df: DataFrame, dist: str, sigma: float, by=("dataset",)) -> DataFrame:
    """Spread of S(365), decline from S(30), coefficient of variation."""
    s = survival_at_horizons(df, dist, sigma, [30, 365])
    last, first = F.col("surv_365d"), F.col("surv_30d")
    return s.groupBy(*by).agg(
        F.var_pop(last).alias("curve_variance"), F.avg(last).alias("mean_final_survival"), (F.max(last) - F.min(last)).alias("survival_range"),
        F.avg(first).alias("mean_initial_survival"), (F.avg(first) - F.avg(last)).alias("survival_decline"),
        ratio(F.stddev_pop(last), F.avg(last), float("inf")).alias("coefficient_of_variation"))


def monotonicity_violations(df: DataFrame, dist: str, sigma: float, last_day=MAX_DAY) -> DataFrame:
    """Days on which a survival curve rises; each person's whole curve is one array in its row."""
    days = np.log(np.arange(1, last_day + 1))

    def counts(c):
        with np.errstate(all="ignore"):
            curve = survival_of(dist, (days - c["eta"][:, None]) / sigma)
        return np.column_stack(((np.diff(curve, axis=1) > 0).sum(axis=1), np.full(len(curve), last_day)))

    sums = arrays.grouped_arrays(df.select("eta"), [], 2, counts)
    at = lambda i: F.coalesce(F.sum(F.when(F.col("i") == i, F.col("v"))), F.lit(0)).cast("long")
    return sums.agg(at(0).alias("violations"), at(1).alias("points"))


def calibration_slope(df: DataFrame, by=("dataset",)) -> DataFrame:
    """Correlation of ln T and eta on events; 1 below ten events, 0 where undefined."""
    ev = F.when(F.col("event") == 1, F.log("time"))
    c = correlation(ev, "eta")
    return df.groupBy(*by).agg(F.when(F.count(ev) < 10, 1.0).otherwise(F.coalesce(c, F.lit(0.0))).alias("calibration_slope"))
