"""Diagnostics of chains against a plain version, and edge cases."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions.expressions import normal_quantile
from tidewater.operators import convergence

SCHEMA = "parameter string, chain long, draw long, value double"


def _scores(x):
    flat = x.ravel()
    ranks = np.array([(flat < v).sum() + ((flat == v).sum() + 1) / 2 for v in flat])
    return np.array([NormalDist().inv_cdf((r - 0.375) / (flat.size + 0.25)) for r in ranks]).reshape(x.shape)


def _r_hat(x):
    n = x.shape[1]
    return np.sqrt(x.mean(1).var(ddof=1) / x.var(1, ddof=1).mean() + (n - 1) / n)


def _ess(x):
    n = x.shape[1]
    if np.ptp(x) == 0:
        return float(x.size)
    c = x - x.mean(1, keepdims=True)
    cov = [np.mean([(row[: n - k] * row[k:]).sum() / n for row in c]) for k in range(n)]
    within = x.var(1, ddof=1).mean()
    rho = [1.0] + [1 - (within - v) / (within * (n - 1) / n + x.mean(1).var(ddof=1)) for v in cov[1:]]
    total, least, k, last = -1.0, np.inf, 0, (n - 3) // 2
    while k < last and rho[2 * k] + rho[2 * k + 1] > 0:
        least = min(least, rho[2 * k] + rho[2 * k + 1])
        total, k = total + 2 * least, k + 1
    if rho[2 * k] > 0 or rho[2 * k] + rho[2 * k + 1] >= 0:
        total += rho[2 * k]
    return x.size / max(total, 1 / np.log10(x.size))


def _plain(chains):
    half = chains.shape[1] // 2
    split = np.concatenate([chains[:, :half], chains[:, -half:]])
    tails = [_ess((split <= np.quantile(chains, q)).astype(float)) for q in (0.05, 0.95)]
    return max(_r_hat(_scores(split)), _r_hat(_scores(np.round(abs(split - np.median(split)), 12)))), _ess(_scores(split)), min(tails)


def _chains(seed, chains, n, memory, apart=0.0, digits=9):
    rng = np.random.default_rng(seed)
    out = rng.normal(size=(chains, n))
    for t in range(1, n):
        out[:, t] += memory * out[:, t - 1]
    return np.round(out + apart * np.arange(chains)[:, None], digits)


def _rows(name, chains):
    return [(name, c, t, float(v)) for c, row in enumerate(chains) for t, v in enumerate(row)]


@pytest.mark.parametrize("lags", [2, 32])
def test_diagnostics_equal_a_plain_version(spark, lags):
    cases = {
        "mixed": _chains(1, 4, 120, 0.0), "slow": _chains(2, 4, 121, 0.95), "apart": _chains(3, 3, 60, 0.3, 2.0), "against": _chains(4, 2, 80, -0.8),
        "ties": _chains(5, 4, 50, 0.5, digits=0), "short": _chains(6, 2, 8, 0.0),
    }
    table = spark.createDataFrame([r for name, x in cases.items() for r in _rows(name, x)], SCHEMA).repartition(3)
    got = {r["parameter"]: (r["r_hat"], r["ess_bulk"], r["ess_tail"]) for r in convergence.convergence(table, ["parameter"], lags).collect()}
    assert got.keys() == cases.keys()
    for name, chains in cases.items():
        assert got[name] == pytest.approx(_plain(chains), rel=1e-8), name


def test_draws_without_statistics(spark):
    rows = [*_rows("constant", np.ones((2, 10))), *_rows("holed", _chains(1, 2, 10, 0.0)), *_rows("few", _chains(2, 2, 6, 0.0))]
    rows = [(p, c, t, None if (p, c, t) == ("holed", 1, 3) else v) for p, c, t, v in rows]
    out = {r["parameter"]: r for r in convergence.convergence(spark.createDataFrame(rows, SCHEMA), ["parameter"]).collect()}
    assert (out["constant"]["r_hat"], out["constant"]["ess_bulk"], out["constant"]["ess_tail"]) == (None, 20.0, 20.0)
    for name in ("holed", "few"):
        assert (out[name]["r_hat"], out[name]["ess_bulk"], out[name]["ess_tail"]) == (None, None, None)
    assert convergence.convergence(spark.createDataFrame([], SCHEMA), ["parameter"]).count() == 0


def test_unlike_or_repeated_draws_are_refused(spark):
    rows = _rows("a", _chains(1, 2, 10, 0.0))
    for bad in (rows[:-1], [*rows[:-1], rows[-2]]):
        with pytest.raises(Exception, match="chains differ in length or repeat a draw"):
            convergence.convergence(spark.createDataFrame(bad, SCHEMA), ["parameter"]).count()


def test_a_fit_fails_by_any_parameter_or_by_a_divergence(spark):
    rows = [("good", "mu", 1.001, 900.0), ("good", "delta", 1.009, 400.0), ("slow", "mu", 1.02, 900.0), ("thin", "mu", 1.0, 399.0), ("split", "mu", 1.0, 900.0), ("split", "delta", None, None), ("cut", "mu", 1.0, 900.0)]
    table = spark.createDataFrame(rows, "series string, parameter string, r_hat double, ess_tail double")
    out = {r["series"]: r for r in convergence.verdicts(table, ["series"], spark.createDataFrame([("cut", 1)], "series string, n_divergences long")).collect()}
    assert {k for k, r in out.items() if r["converged"]} == {"good"}
    assert (out["good"]["worst_r_hat"], out["good"]["worst_ess_tail"], out["cut"]["n_divergences"]) == (1.009, 400.0, 1)


def test_delta_is_one_of_the_parameters(spark):
    draws = spark.createDataFrame([("s", 0, 0, 0.0, 0.1, 0.2, 0.4, 6.0)], "series string, chain int, draw int, mu double, omega double, alpha double, beta double, nu double")
    out = {r["parameter"]: r["value"] for r in convergence.long_draws(draws).collect()}
    assert out == {"mu": 0.0, "omega": 0.1, "alpha": 0.2, "beta": 0.4, "nu": 6.0, "delta": 0.5}


def test_normal_quantile(spark):
    p = [1e-9, 0.001, 0.07, 0.3, 0.5, 0.925, 0.999999]
    got = [r["q"] for r in spark.createDataFrame([(x,) for x in p], "p double").select(normal_quantile(F.col("p")).alias("q")).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(x) for x in p], rel=1e-13, abs=1e-15)
