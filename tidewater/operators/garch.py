"""GARCH(1,1) with Student-t or normal shocks: likelihood, fits by many starts, posterior draws and predictive quantiles.

A fit is a task: one (series, refit) of the walk-forward grid with its history. Inside
it numpy runs all starts, chains or draws together; Spark runs the refits apart.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.config import Study, level_key
from tidewater.functions.special import bisect, normal_cdf, t_cdf, t_ppf
from tidewater.operators.forecasts import refit_ids

# Starts for the shares of the shock and of persistence, and for the degrees of freedom. Sums of 0.995 or more are left out.
STARTS_ALPHA = (0.05, 0.10, 0.20)
STARTS_BETA = (0.75, 0.85, 0.90)
STARTS_NU = (5.0, 8.0, 15.0)
BARRIER = 1e10
# Bounds of convergence diagnostics.
MAX_R_HAT, MIN_ESS = 1.01, 400
#: Draws that a predictive mixture keeps, evenly from all.
DRAWS = 2000


def variances(theta: np.ndarray, r: np.ndarray, h0: float, block: int = 32) -> np.ndarray:
    """(m, n + 1) conditional variances for m parameter rows (mu, omega, alpha, beta, ...); the last is the forecast after r.

    Inside blocks the recursion is a running sum scaled by powers of beta, for all blocks at once; only the values
    between blocks are taken one after the other. A missing return makes what follows it missing.
    """
    mu, omega, alpha, beta = (c[:, None] for c in theta.T[:4])
    m, n = len(theta), len(r)
    blocks = -(-n // block)
    shock = np.zeros((m, blocks * block))
    shock[:, :n] = omega + alpha * (r - mu) ** 2
    power = np.maximum(beta, 1e-8) ** np.arange(1, block + 1)  # below that a power's inverse is no number, and its effect none
    inside = np.cumsum(shock.reshape(m, blocks, block) / power[:, None, :], axis=2) * power[:, None, :]
    start = np.empty((m, blocks))
    h = np.full(m, float(h0))
    for b in range(blocks):
        start[:, b] = h
        h = power[:, -1] * h + inside[:, b, -1]
    inside += power[:, None, :] * start[:, :, None]
    return np.concatenate([np.full((m, 1), float(h0)), inside.reshape(m, -1)[:, :n]], axis=1)


def log_likelihood(theta: np.ndarray, r: np.ndarray, h0: float, student: bool = True) -> np.ndarray:
    """Of each parameter row; minus infinity where it is not admissible."""
    mu, omega, alpha, beta, nu = theta.T
    ok = (omega > 0) & (alpha >= 0) & (beta >= 0) & (alpha + beta < 1) & ((nu > 4) | (not student))
    out = np.full(len(theta), -np.inf)
    if not ok.any():
        return out
    own = theta[ok]
    h = variances(own, r, h0)[:, :-1]
    square = (r[None, :] - own[:, :1]) ** 2 / h
    if student:
        v = own[:, 4:5]
        constant = np.array([math.lgamma((x + 1) / 2) - math.lgamma(x / 2) - 0.5 * math.log(math.pi * (x - 2)) for x in v[:, 0]])
        out[ok] = len(r) * constant - 0.5 * np.log(h).sum(1) - ((v + 1) / 2 * np.log1p(square / (v - 2))).sum(1)
    else:
        out[ok] = -0.5 * (math.log(2 * math.pi) * len(r) + np.log(h).sum(1) + square.sum(1))
    return out


def start_grid(variance: float, mean: float, student: bool) -> np.ndarray:
    rows = [
        (mean, variance * (1 - a - b), a, b, v) for a in STARTS_ALPHA for b in STARTS_BETA if a + b < 0.995 for v in (STARTS_NU if student else (np.inf,))
    ]
    return np.array(rows)


def start_table(framed: DataFrame, study: Study) -> DataFrame:
    """(series, mu, omega, alpha, beta, nu): start_grid of each series at its training mean and variance."""
    from tidewater.operators.derive import split

    moments = split(framed, study).where("part = 'train'").groupBy("series").agg(F.avg("log_return").alias("mu"), F.var_samp("log_return").alias("variance"))
    shares = F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta"), F.lit(v).alias("nu")) for a in STARTS_ALPHA for b in STARTS_BETA if a + b < 0.995 for v in STARTS_NU])
    return moments.select("series", "mu", "variance", F.inline(shares)).select("series", "mu", (F.col("variance") * (1 - F.col("alpha") - F.col("beta"))).alias("omega"), "alpha", "beta", "nu")


def _open(theta: np.ndarray) -> np.ndarray:
    """Parameters on the whole line: mu, log omega, shares against what is left, log(nu - 4)."""
    mu, omega, alpha, beta, nu = theta.T
    rest = 1 - alpha - beta
    return np.stack([mu, np.log(omega), np.log(alpha / rest), np.log(beta / rest), np.log(np.where(np.isfinite(nu), nu, 5.0) - 4)], 1)


def _closed(u: np.ndarray, student: bool) -> np.ndarray:
    e = np.exp(np.clip(u[:, 2:4], -30, 30))
    rest = 1 + e.sum(1)
    nu = 4 + np.exp(np.clip(u[:, 4], -20, 6)) if student else np.full(len(u), np.inf)
    return np.stack([u[:, 0], np.exp(np.clip(u[:, 1], -60, 30)), e[:, 0] / rest, e[:, 1] / rest, nu], 1)


def minimise(f: Callable[[np.ndarray], np.ndarray], x: np.ndarray, rounds: int = 60, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quasi-Newton descents from all rows of x together: (x, value, converged). f takes many rows at once."""
    m, d = x.shape
    eye, steps = np.eye(d) * 1e-5, 0.5 ** np.arange(0, 14, 2)

    def gradient(x):
        both = np.concatenate([x[:, None, :] + eye, x[:, None, :] - eye], 1).reshape(-1, d)
        v = f(both).reshape(m, 2, d)
        return (v[:, 0] - v[:, 1]) / 2e-5

    value, g, inverse, done = f(x), gradient(x), np.tile(np.eye(d) * 1e-2, (m, 1, 1)), np.zeros(m, bool)
    for _ in range(rounds):
        p = -np.einsum("mij,mj->mi", inverse, g)
        uphill = np.einsum("mi,mi->m", p, g) >= 0
        p[uphill] = -g[uphill] * 1e-2
        tried = x[:, None, :] + steps[None, :, None] * np.clip(p, -2, 2)[:, None, :]
        v = f(tried.reshape(-1, d)).reshape(m, -1)
        best = v.argmin(1)
        better = v[np.arange(m), best] < value
        s = np.where(better[:, None], tried[np.arange(m), best] - x, 0.0)
        gain = np.where(better, value - v[np.arange(m), best], 0.0)
        x, value = x + s, np.where(better, v[np.arange(m), best], value)
        fresh = gradient(x)
        y, g = fresh - g, fresh
        sy = np.einsum("mi,mi->m", s, y)
        use = sy > 1e-12
        if use.any():
            rho = 1 / sy[use]
            a = np.eye(d) - rho[:, None, None] * np.einsum("mi,mj->mij", s[use], y[use])
            inverse[use] = np.einsum("mij,mjk,mlk->mil", a, inverse[use], a) + rho[:, None, None] * np.einsum("mi,mj->mij", s[use], s[use])
        inverse[~better] = np.eye(d) * 1e-3
        done = (gain < tolerance) & (np.abs(g).max(1) < 1e-2 * np.maximum(1, np.abs(value)))
        if done.all():
            break
    return x, value, done


def fit(r: np.ndarray, scale: float, student: bool) -> dict:
    """Best of all starts among those that converged, else best of all. Without variance, or with under 50 returns, an error."""
    r = r[np.isfinite(r)] * scale
    if len(r) < 50 or not r.var() > 0:
        raise ValueError(f"{len(r)} returns without variance, or too few")
    h0 = r.var(ddof=1)
    objective = lambda u: np.minimum(BARRIER, np.nan_to_num(-log_likelihood(_closed(u, student), r, h0, student), nan=BARRIER, posinf=BARRIER))
    starts = _open(start_grid(h0, r.mean(), student))
    x, value, done = minimise(objective, starts, 12)
    kept = np.argsort(value)[:4]
    x, value, done = minimise(objective, x[kept], 60)
    usable = done & (value < BARRIER)
    best = np.flatnonzero(usable)[value[usable].argmin()] if usable.any() else value.argmin()
    mu, omega, alpha, beta, nu = _closed(x[best : best + 1], student)[0]
    return {
        "converged": bool(usable[best]), "loglik": float(-value[best] + len(r) * math.log(scale)), "n_obs": len(r),
        "mu": mu / scale, "omega": omega / scale**2, "alpha": alpha, "beta": beta, "nu": nu if student else None,
    }


def log_prior(theta: np.ndarray) -> np.ndarray:
    """mu normal(0, 1); omega half-normal(1); alpha beta(2, 10); delta = beta / (1 - alpha) beta(3, 1) with its Jacobian; nu - 4 exponential of mean 10."""
    mu, omega, alpha, beta, nu = theta.T
    delta = beta / (1 - alpha)
    constant = -0.5 * math.log(2 * math.pi) + 0.5 * math.log(2 / math.pi) + math.log(110) + math.log(3) - math.log(10)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = constant - mu**2 / 2 - omega**2 / 2 + np.log(alpha) + 9 * np.log1p(-alpha) + 2 * np.log(delta) - np.log1p(-alpha) - (nu - 4) / 10
    ok = (omega > 0) & (alpha > 0) & (alpha < 1) & (delta > 0) & (delta < 1) & (nu > 4)
    return np.where(ok, value, -np.inf)


def sample(r: np.ndarray, scale: float, seed: int, chains: int = 32, draws: int = 2500) -> tuple[np.ndarray, dict]:
    """Posterior draws (n, 5) on the return scale from an affine-invariant ensemble, with split R-hat and effective sizes."""
    r = r[np.isfinite(r)] * scale
    h0, rng = r.var(ddof=1), np.random.default_rng(seed)

    def density(u):
        theta = _closed(u, True)
        jacobian = u[:, 1] + np.log(theta[:, 2]) + np.log(theta[:, 3]) + np.log1p(-theta[:, 2] - theta[:, 3]) + u[:, 4]
        return np.nan_to_num(log_likelihood(theta, r, h0) + log_prior(theta) + jacobian, nan=-np.inf)

    mode = fit(r, 1.0, True)
    start = _open(np.array([[mode["mu"], mode["omega"], max(1e-3, mode["alpha"]), max(1e-3, mode["beta"]), max(4.05, mode["nu"])]]))
    x = start + rng.standard_normal((chains, 5)) * np.array([0.02 * math.sqrt(h0), 0.2, 0.2, 0.2, 0.2])
    value, kept, half = density(x), np.empty((draws, chains, 5)), chains // 2
    for t in range(-draws // 2, draws):
        for own, other in ((slice(0, half), slice(half, None)), (slice(half, None), slice(0, half))):
            z = (rng.random(half) + 1) ** 2 / 2
            partner = x[other][rng.integers(0, half, half)]
            move = partner + z[:, None] * (x[own] - partner)
            v = density(move)
            ok = np.log(rng.random(half)) < 4 * np.log(z) + v - value[own]
            x[own] = np.where(ok[:, None], move, x[own])
            value[own] = np.where(ok, v, value[own])
        if t >= 0:
            kept[t] = x
    facts = diagnose(kept)
    theta = _closed(kept.reshape(-1, 5), True)
    return np.stack([theta[:, 0] / scale, theta[:, 1] / scale**2, theta[:, 2], theta[:, 3], theta[:, 4]], 1), facts


def diagnose(kept: np.ndarray) -> dict:
    """Split R-hat and effective sample size of draws (n, chains, parameters), the worst over parameters."""
    n = len(kept) // 2
    parts = np.concatenate([kept[:n], kept[n : 2 * n]], 1)
    within, between = parts.var(0, ddof=1).mean(0), n * parts.mean(0).var(0, ddof=1)
    pooled = (n - 1) / n * within + between / n
    centred = parts - parts.mean(0)
    total = np.ones(parts.shape[2])
    for lag in range(1, n - 1):
        rho = 1 - (within - (centred[lag:] * centred[:-lag]).mean((0, 1))) / pooled
        if np.all(rho < 0.05):
            break
        total += 2 * np.maximum(rho, 0)
    return {"max_r_hat": float(np.sqrt(pooled / within).max()), "min_ess": float((parts.shape[0] * parts.shape[1] / total).min())}


class Mixture:
    """Equal-weight mixture of standardised t distributions with means (draws,), variances h (draws, dates) and degrees of freedom nu (draws,).

    Each draw's distribution function is tabulated once, on points that are even in asinh, with its density for the slopes
    between them; so quantiles over many dates cost look-ups.
    """

    POINTS, REACH = 1201, 12.0

    def __init__(self, mean: np.ndarray, h: np.ndarray, nu: np.ndarray):
        self.mean, self.nu = mean, nu
        self.scale = np.sqrt(h * ((nu - 2) / nu)[:, None])
        self.u = np.linspace(-self.REACH, self.REACH, self.POINTS)
        z = np.sinh(self.u)
        log_c = np.array([math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(math.pi * v) for v in nu])
        self.cdf_at = t_cdf(z[None, :], nu[:, None])
        # slope in u: density times cosh
        self.slope_at = np.exp(log_c[:, None] - (nu[:, None] + 1) / 2 * np.log1p(z * z / nu[:, None])) * np.cosh(self.u)

    def cdf(self, x: np.ndarray) -> np.ndarray:
        """At x (dates,)."""
        u = np.clip(np.arcsinh((x[None, :] - self.mean[:, None]) / self.scale), -self.REACH, self.REACH)
        step = self.u[1] - self.u[0]
        i = np.minimum(((u + self.REACH) / step).astype(np.int64), self.POINTS - 2)
        t = (u - self.u[i]) / step
        take = lambda table, k: np.take_along_axis(table, k, 1)
        low, high = take(self.cdf_at, i), take(self.cdf_at, i + 1)
        value = low * (1 + 2 * t) * (1 - t) ** 2 + high * t * t * (3 - 2 * t) + step * (take(self.slope_at, i) * t * (1 - t) ** 2 - take(self.slope_at, i + 1) * t * t * (1 - t))
        return np.clip(value, 0, 1).mean(0)

    def quantile(self, p: float) -> np.ndarray:
        """Between the least and the greatest of the components' quantiles."""
        z = t_ppf(np.full(len(self.nu), p), self.nu)
        each = self.mean[:, None] + self.scale * z[:, None]
        return bisect(lambda x: self.cdf(x) - p, each.min(0), each.max(0), 50)


def _path_schema(study: Study) -> str:
    bounds = ", ".join(f"{s}_{level_key(x)} double" for x in study.levels for s in ("lo", "hi"))
    return f"series string, date date, model string, refit_id int, converged boolean, alpha double, beta double, nu double, variance double, mean double, {bounds}, var_99 double, pit double, log_return double"


def refit_tasks(framed: DataFrame, study: Study) -> DataFrame:
    """One row for each (series, refit): the history before the refit date and the block after it, as arrays in date order.

    A history is the prefix of its series; a series' bars are bounded, and a refit needs them all at once.
    """
    blocks = refit_ids(framed, study).groupBy("series", "refit_id").agg(
        F.min("date").alias("refit_date"), F.array_sort(F.collect_list(F.struct("date", "log_return"))).alias("block")
    )
    history = framed.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("date", "log_return"))).alias("all"))
    past = F.filter("all", lambda x: x["date"] < F.col("refit_date"))
    return blocks.join(history, "series").select(
        "series", "refit_id", F.transform(past, lambda x: x["log_return"]).alias("past"), F.transform("block", lambda x: x["date"]).alias("dates"), F.transform("block", lambda x: x["log_return"]).alias("returns")
    )


def _forecast(study: Study, models: tuple[str, ...]):
    def nan(values):
        return np.array([np.nan if v is None else v for v in values], float)

    def run(batches):
        for batch in batches:
            for task in batch.itertuples(index=False):
                past, block = nan(task.past), nan(task.returns)
                for model in models:
                    yield _block(study, model, task, past[np.isfinite(past)], block)

    return run


def _block(study: Study, model: str, task, past: np.ndarray, block: np.ndarray) -> pd.DataFrame:
    out = pd.DataFrame({"series": task.series, "date": task.dates, "model": model, "refit_id": task.refit_id, "log_return": block})
    numbers = ["alpha", "beta", "nu", "variance", "mean", *(f"{s}_{level_key(x)}" for x in study.levels for s in ("lo", "hi")), "var_99", "pit"]
    out[numbers], out["converged"] = np.nan, False
    names = [f.split()[0] for f in _path_schema(study).split(", ")]
    student = model != "garch_normal"
    try:
        if model == "garch_posterior":
            theta, facts = sample(past, study.fit_scale, task.refit_id)
            theta = theta[:: max(1, len(theta) // DRAWS)]
            ok = facts["max_r_hat"] <= MAX_R_HAT and facts["min_ess"] >= MIN_ESS
        else:
            found = fit(past, study.fit_scale, student)
            theta, ok = np.array([[found["mu"], found["omega"], found["alpha"], found["beta"], found["nu"] or np.inf]]), found["converged"]
    except ValueError:
        return out[names]
    out["alpha"], out["beta"], out["nu"] = theta[:, 2].mean(), theta[:, 3].mean(), theta[:, 4].mean() if student else np.nan
    out["converged"] = ok
    if not ok:
        return out[names]
    # a missing return in the block makes what follows it unknown
    h = variances(theta, np.concatenate([past, block]), past.var(ddof=1))[:, len(past) : len(past) + len(block)]
    mean, nu = theta[:, 0], theta[:, 4]
    known = np.isfinite(h).all(0)
    quantiles, mixture = {}, Mixture(mean, np.where(known, h, 1.0), nu) if student else None
    for p in sorted({q for x in study.levels for q in ((1 - x) / 2, (1 + x) / 2)} | {1 - study.var_level}):
        if len(theta) > 1:
            q = mixture.quantile(p)
        else:
            z = t_ppf(np.array([p]), nu)[0] * math.sqrt((nu[0] - 2) / nu[0]) if student else bisect(lambda x: normal_cdf(x) - p, [-40.0], [40.0])[0]
            q = mean[0] + z * np.sqrt(h[0])
        quantiles[p] = np.where(known, q, np.nan)
    for x in study.levels:
        out[f"lo_{level_key(x)}"], out[f"hi_{level_key(x)}"] = quantiles[(1 - x) / 2], quantiles[(1 + x) / 2]
    out["var_99"] = quantiles[1 - study.var_level]
    out["variance"], out["mean"] = h.mean(0), np.where(known, mean.mean(), np.nan)
    if student:
        pit = mixture.cdf(np.nan_to_num(block))
    else:
        pit = normal_cdf((block - mean[0]) / np.sqrt(np.where(known, h[0], 1.0)))
    out["pit"] = np.where(known & np.isfinite(block), pit, np.nan)
    return out[names]


def garch_forecasts(framed: DataFrame, study: Study, models: tuple[str, ...] = ("garch_t", "garch_normal")) -> DataFrame:
    """Forecast rows of the fitted models, refit by refit. A refit that fails leaves its own block null and no other.

    Null stands for what is missing; the refits of all series are dealt over the cluster.
    """
    # a number of partitions of its own: small tables would else be put together into one task
    parts = framed.sparkSession.sparkContext.defaultParallelism * 4
    tasks = refit_tasks(framed, study).repartition(parts, "series", "refit_id")
    rows = tasks.mapInPandas(_forecast(study, models), _path_schema(study))
    plain = [F.when(~F.isnan(c), F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in rows.dtypes]
    return rows.select(*plain)


def admissible(omega: Column, alpha: Column, beta: Column, nu: Column) -> Column:
    """Whether parameters give a positive variance that reverts and shocks with four moments; a null or NaN nu stands for normal shocks."""
    known = (omega > 0) & ~F.isnan(omega) & (alpha >= 0) & (beta >= 0) & (alpha + beta < 1)
    return F.coalesce(known & (nu.isNull() | F.isnan(nu) | (nu > 4)), F.lit(False))


def garch_likelihood(framed: DataFrame, mu: float, omega: float, alpha: float, beta: float, study: Study, nu: float | None = None) -> DataFrame:
    """(series, n, loglik): log-likelihood of the training returns at fixed parameters, in the JVM; minus infinity where they are not admissible.

    Shocks are normal, or of a t distribution with nu degrees of freedom and variance one.
    """
    from tidewater.operators.derive import split
    from tidewater.operators.forecasts import garch_variance

    rows = garch_variance(split(framed, study).where((F.col("part") == "train") & F.col("log_return").isNotNull()).drop("part"), mu, omega, alpha, beta, study)
    square = F.pow(F.col("log_return") - mu, 2) / F.col("variance")
    if nu is None:
        each = -0.5 * (math.log(2 * math.pi) + F.log("variance") + square)
    elif nu > 4:
        level = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
        each = level - 0.5 * F.log("variance") - (nu + 1) / 2 * F.log1p(square / (nu - 2))
    else:
        each = F.lit(-math.inf)
    ok = admissible(*[F.lit(x) for x in (omega, alpha, beta)], F.lit(nu).cast("double"))
    return rows.groupBy("series").agg(F.count("*").alias("n"), F.sum(each).alias("loglik")).withColumn("loglik", F.when(ok, F.col("loglik")).otherwise(-math.inf))
