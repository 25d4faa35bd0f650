"""Scans, distributions, regressions and resampled differences, against plain versions."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import replace
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.config import ORDERS, REGIME_PAIRS
from tidewater.functions import distributions, kolmogorov, special
from tidewater.operators import diagnostics, guards, predictive, recurrence, resampling

DAY = dt.date(2020, 1, 1)


def _days(n):
    return [DAY + dt.timedelta(days=i) for i in range(n)]


@pytest.mark.parametrize("block", [2, 3, 64])
def test_affine_scan_equals_a_loop(spark, block):
    rng = np.random.default_rng(block)
    rows, want = [], {}
    for key, n in (("a", 1), ("b", 2), ("c", 70), ("d", 29)):
        h, decay = 1.5, rng.choice([0.0, 0.3, 0.99], n)
        for t in range(n):
            b = float(rng.normal())
            rows.append((key, t, float(decay[t]), b, 1.5, f"row {t}"))
            want[key, t] = (h, f"row {t}")
            h = decay[t] * h + b
    table = spark.createDataFrame(rows, "series string, at long, a double, b double, seed double, other string").repartition(3)
    got = {(r["series"], r["at"]): (r["h"], r["other"]) for r in recurrence.affine_scan(table, "a", "b", "seed", "at", block=block).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == pytest.approx(want[k][0], rel=1e-12) and got[k][1] == want[k][1] for k in want)


def test_a_missing_shock_makes_later_values_null(spark):
    table = spark.createDataFrame([("s", t, 0.5, None if t == 2 else 1.0, 1.0) for t in range(6)], "series string, at long, a double, b double, seed double")
    got = [r["h"] for r in recurrence.affine_scan(table, "a", "b", "seed", "at", block=2).orderBy("at").collect()]
    assert got[:3] == [1.0, 1.5, 1.75] and got[3:] == [None] * 3


def test_t_distribution_of_real_degrees(spark):
    rows = [(float(x), nu) for x in (-40.0, -3.0, -0.2, 0.0, 0.7, 2.5, 11.0) for nu in (1.0, 2.3, 4.5, 8.0, 33.3, 700.0, 5000.0)]
    table = spark.createDataFrame(rows, "x double, nu double")
    out = table.select("x", "nu", F.expr(distributions.t_cdf("x", "nu")).alias("p"), F.expr(f"transform(array(0.005D, 0.5D, 0.9D), q -> {distributions.t_quantile('q', 'nu')})").alias("q")).toPandas()
    assert np.abs(out.p - special.t_cdf(out.x, out.nu)).max() < 5e-9
    for i, p in enumerate((0.005, 0.5, 0.9)):
        got = np.array([q[i] for q in out.q])
        # an error of the distribution function counts more in tails, where the density is low
        want = special.t_ppf(p, out.nu)
        assert (np.abs(got - want) / (1 + np.abs(want))).max() < 1e-6
    assert spark.range(1).select(F.expr(distributions.t_quantile("0D", "5D")), F.expr(distributions.t_cdf("CAST(NULL AS DOUBLE)", "5D"))).first() == (None, None)


def _paths(spark, draws):
    """One day for each row of draws."""
    return spark.createDataFrame([("s", DAY, 0, i, *x) for i, x in enumerate(draws)], "series string, date date, refit_id int, draw int, variance double, mu double, nu double, log_return double")


def test_mixture_of_equal_draws_is_the_plug_in(spark):
    draws = [(1.7, 0.02, 6.5, 0.4)] * 5
    mixed = predictive.mixture_predictive(_paths(spark, draws), ORDERS).first()
    single = predictive.t_predictive(_paths(spark, draws[:1]), ORDERS).first()
    for name in (*predictive.probabilities(ORDERS), "pit"):
        assert mixed[name] == pytest.approx(single[name], abs=1e-9)
    assert mixed["variance"] == pytest.approx(1.7)


def test_mixture_quantiles_solve_the_mean_of_distributions(spark):
    rng = np.random.default_rng(1)
    draws = [(float(v), float(m), float(nu), 0.3) for v, m, nu in zip(rng.uniform(0.2, 5, 30), rng.normal(0, 0.3, 30), rng.uniform(2.5, 30, 30))]
    row = predictive.mixture_predictive(_paths(spark, draws), ORDERS).first()
    v, m, nu, _ = map(np.array, zip(*draws))
    scale = np.sqrt(v * (nu - 2) / nu)
    for name, p in predictive.probabilities(ORDERS).items():
        assert special.t_cdf((row[name] - m) / scale, nu).mean() == pytest.approx(p, abs=1e-9)
    assert row["pit"] == pytest.approx(special.t_cdf((0.3 - m) / scale, nu).mean(), abs=1e-9)
    wider = predictive.t_predictive(_paths(spark, [(float(v.mean()), float(m.mean()), float(nu.mean()), 0.3)]), ORDERS).first()
    assert row["lo_99"] < wider["lo_99"]


def test_a_day_that_lacks_a_draw_has_no_quantiles(spark):
    row = predictive.mixture_predictive(_paths(spark, [(1.0, 0.0, 5.0, 0.1), (None, 0.0, 5.0, 0.1)]), ORDERS).first()
    assert row["lo_95"] is None and row["pit"] is None and row["n_draws"] == 2


def test_draws_that_are_not_admissible_are_refused(spark):
    framed = spark.createDataFrame([("s", d, 0.1) for d in _days(5)], "series string, date date, log_return double")
    draws = spark.createDataFrame([("s", 0, 0.0, 0.1, 0.6, 0.5, 8.0)], "series string, draw int, mu double, omega double, alpha double, beta double, nu double")
    with pytest.raises(Exception, match="finite variance"):
        predictive.per_draw_variances(framed, draws, replace(ORDERS, train_end="2020-01-03", oos_start="2020-01-04")).count()


def _least_squares(y, x):
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rss = float(((y - x @ beta) ** 2).sum())
    return beta, rss, np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * rss / (len(y) - x.shape[1]))


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(12)
    noise = rng.normal(0, 0.01, 400)
    h, shocks = 1e-5, []
    for z in rng.normal(size=400):
        shocks.append(np.sqrt(h) * z)
        h = 1e-6 + 0.3 * shocks[-1] ** 2 + 0.6 * h
    values = {"noise": noise, "garch": np.array(shocks), "walk": np.cumsum(rng.normal(0, 0.01, 400))}
    rows = [(k, d, float(x)) for k, v in values.items() for d, x in zip(_days(400), v)] + [("noise", DAY - dt.timedelta(days=1), None)]
    return values, spark.createDataFrame(rows, "series string, date date, value double").repartition(3)


def test_arch_tests_equal_least_squares(series):
    values, table = series
    for r in diagnostics.arch_lm_lags(table, (1, 5, 22)).collect():
        s, k = (values[r["series"]] - values[r["series"]].mean()) ** 2, r["lags"]
        y, x = s[k:], np.column_stack([np.ones(len(s) - k), *(s[k - j : len(s) - j] for j in range(1, k + 1))])
        _, rss, _ = _least_squares(y, x)
        total = ((y - y.mean()) ** 2).sum()
        assert r["n"] == len(y) and r["lm"] == pytest.approx(len(y) * (1 - rss / total), rel=1e-6)
        free = len(y) - k - 1
        assert r["f"] == pytest.approx((total - rss) / k / (rss / free), rel=1e-6)
        assert r["lm_p"] == pytest.approx(special.chi2_sf(r["lm"], k), abs=1e-9)
        assert r["f_p"] == pytest.approx(float(special.beta_inc(free / 2, k / 2, free / (free + k * r["f"]))), abs=1e-9)
        if k == 5:
            assert (r["lm_p"] < 0.01) == (r["series"] == "garch") or r["series"] == "walk"


@pytest.mark.parametrize("max_lag", [None, 3, 0])
def test_unit_root_equals_least_squares(series, max_lag):
    values, table = series
    out = {r["series"]: r for r in diagnostics.unit_root(table, max_lag).collect()}
    for name, v in values.items():
        most = int(np.ceil(12 * (len(v) / 100) ** 0.25)) if max_lag is None else max_lag
        d = np.diff(v)

        def fit(lags, skip):
            x = np.column_stack([v[skip:-1], np.ones(len(d) - skip), *(d[skip - j : len(d) - j] for j in range(1, lags + 1))])
            return len(d) - skip, x.shape[1], _least_squares(d[skip:], x)

        best = min(range(most + 1), key=lambda q: (lambda n, k, f: n * np.log(f[1] / n) + 2 * k)(*fit(q, most)))
        n, _, (beta, _, error) = fit(best, best)
        assert (out[name]["lags"], out[name]["n"]) == (best, n)
        assert out[name]["statistic"] == pytest.approx(beta[0] / error[0], rel=1e-6)
    assert out["noise"]["stationary"] and not out["walk"]["stationary"]


def test_symmetry_is_the_exact_binomial(spark):
    rows = [(0, 0), (0, 1), (3, 3), (2, 9), (156, 81), (20, 2), (40_000, 40_600), (0, 1500)]
    out = spark.createDataFrame(rows, "b long, a long").select("b", "a", F.expr(diagnostics.symmetry_p("b", "a")).alias("p")).collect()
    for r in out:
        assert r["p"] is None if not r["b"] + r["a"] else r["p"] == pytest.approx(special.binomial_test(r["b"], r["b"] + r["a"]), rel=1e-7, abs=1e-300)


def test_regime_differences_draw_both_sides_apart(spark):
    rng = np.random.default_rng(2)
    days = _days(240)
    regimes = [("calm", "normal", "stressed")[i % 3] for i in range(240)]
    hits = {m: (rng.random(240) < p).astype(float) for m, p in (("x", 0.1), ("y", 0.3))}
    table = spark.createDataFrame([(m, d, g, float(v)) for m, h in hits.items() for d, g, v in zip(days, regimes, h)], "model string, date date, regime string, value double")
    study = replace(ORDERS, replicates=60)
    out = resampling.independent_differences(table, ["model"], REGIME_PAIRS, "regime", study).collect()
    assert [(r["regime_a"], r["regime_b"]) for r in sorted(out, key=lambda r: (r["model"], REGIME_PAIRS.index((r["regime_a"], r["regime_b"]))))] == list(REGIME_PAIRS) * 2
    draws = {}
    for seed in range(study.seed, study.seed + 6):
        rows = resampling.indices(spark.createDataFrame([(80, seed)], "n long, seed int"), study).orderBy("rep", "t").select("idx").toPandas().idx.to_numpy()
        draws[seed] = rows.reshape(60, 80)
    for r in out:
        k = REGIME_PAIRS.index((r["regime_a"], r["regime_b"]))
        a, b = (np.array([v for v, g in zip(hits[r["model"]], regimes) if g == r[f"regime_{s}"]]) for s in "ab")
        means = a[draws[study.seed + 2 * k]].mean(1) - b[draws[study.seed + 2 * k + 1]].mean(1)
        assert (r["n_a"], r["n_b"]) == (80, 80) and r["difference"] == pytest.approx(a.mean() - b.mean())
        assert [r["lower"], r["upper"]] == pytest.approx(np.percentile(means, [2.5, 97.5]).tolist())
        assert r["separates"] == (r["lower"] > 0 or r["upper"] < 0)


def test_look_ups_that_miss_a_date_are_refused(spark):
    rows = spark.createDataFrame([("s", d) for d in _days(3)], "series string, date date")
    table = rows.withColumn("regime", F.lit(None).cast("string"))
    assert guards.looked_up(rows, table, ["series", "date"], "a regime").count() == 3
    with pytest.raises(Exception, match="without a regime"):
        guards.looked_up(rows, table.where(F.col("date") > F.lit(DAY)), ["series", "date"], "a regime").count()


def _distance_tail(n, d):
    """The matrix of the distance's distribution in fractions, its power in steps."""
    d = Fraction(d)
    k = int(n * d) + 1
    m, h = 2 * k - 1, k - n * d
    rows = [[Fraction(0) if i - j + 1 < 0 else Fraction(1, math.factorial(i - j + 1)) for j in range(m)] for i in range(m)]
    for i in range(m):
        rows[i][0] -= h ** (i + 1) / math.factorial(i + 1)
        rows[m - 1][i] -= h ** (m - i) / math.factorial(m - i)
    rows[m - 1][0] += max(Fraction(0), 2 * h - 1) ** m / math.factorial(m)
    matrix, u = np.array([[float(x) for x in row] for row in rows]), np.eye(m)[k - 1]
    for i in range(1, n + 1):
        u = matrix @ u * (i / n)
    return 1 - u[k - 1]


def test_the_distance_of_uniform_values_has_its_exact_tail(spark):
    cases = [(1, 0.3), (1, 0.7), (2, 0.4), (5, 0.2), (10, 0.05), (10, 0.274), (10, 0.5), (50, 0.1), (200, 0.06), (200, 0.14), (200, 0.15), (300, 0.9)]
    edges = [(0, 0.2, None), (5, None, None), (None, 0.2, None), (5, 0.0, 1.0), (5, 1.0, 0.0)]
    table = spark.createDataFrame([*cases, *[e[:2] for e in edges]], "n long, d double")
    got = {(r["n"], r["d"]): r["p"] for r in table.withColumn("p", F.expr(kolmogorov.ks_tail("n", "d"))).collect()}
    assert got[10, 0.274] == pytest.approx(1 - 0.6284796154565, abs=1e-12)  # the published example
    assert {c: got[c] for c in cases} == pytest.approx({c: _distance_tail(*c) for c in cases}, abs=1e-12)
    assert all(got[n, d] == p for n, d, p in edges)


def test_large_samples_take_the_limit_at_a_corrected_distance(spark, monkeypatch):
    table = spark.createDataFrame([(1500, 0.02), (1500, 0.03), (1500, 0.05)], "n long, d double")
    exact = [r["p"] for r in table.select(F.expr(kolmogorov.ks_tail("n", "d")).alias("p")).collect()]
    monkeypatch.setattr(kolmogorov, "EXACT_TO", 100)
    limit = [r["p"] for r in table.select(F.expr(kolmogorov.ks_tail("n", "d")).alias("p")).collect()]
    assert limit == pytest.approx(exact, abs=1500**-1.5)
