"""Fits by rounds over DataFrames against the fit in numpy."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.config import ORDERS
from tidewater.operators import garch, likelihood

STUDY = replace(ORDERS, train_end="2020-12-31", oos_start="2021-01-01")


@pytest.fixture(scope="module")
def simulated(spark):
    rng = np.random.default_rng(7)
    values = {}
    for name, theta in (("a", (0.05, 0.1, 0.15, 0.75)), ("b", (0.0, 0.05, 0.1, 0.85))):
        h, out = 1.0, []
        for z in rng.standard_t(7, 320) * np.sqrt(5 / 7):
            out.append(theta[0] + np.sqrt(h) * z)
            h = theta[1] + theta[2] * (out[-1] - theta[0]) ** 2 + theta[3] * h
        values[name] = np.array(out)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(320)]
    rows = [(k, d, float(x)) for k, v in values.items() for d, x in zip(days, v)]
    return values, spark.createDataFrame(rows, "series string, date date, log_return double")


@pytest.mark.parametrize("student", [True, False])
def test_likelihood_and_score_equal_differences(simulated, student):
    values, framed = simulated
    starts = likelihood.numbered_starts(framed, STUDY, student).where(F.col("start") < 3)
    found = starts.join(likelihood.evaluated(likelihood.training_returns(framed, STUDY), starts, student), ["series", "start"]).collect()
    assert len(found) == 6
    for r in found:
        theta = np.array([[r[n] if r[n] is not None else np.inf for n in likelihood.NAMES]])
        own = values[r["series"]]
        value = lambda t: garch.log_likelihood(t, own, own.var(ddof=1), student)[0]  # noqa: E731, B023
        assert r["loglik"] == pytest.approx(value(theta), rel=1e-10)
        for i in range(5 if student else 4):
            step = np.zeros((1, 5))
            step[0, i] = 1e-5
            assert r["score"][i] == pytest.approx((value(theta + step) - value(theta - step)) / 2e-5, rel=1e-4, abs=1e-3)


def test_rounds_reach_the_fit_of_all_starts(simulated):
    """From two starts of each series at once; no round loses likelihood, and the best is that of the descent in numpy."""
    values, framed = simulated
    returns = likelihood.training_returns(framed, STUDY)
    starts = likelihood.numbered_starts(framed, STUDY, True).where(F.col("start").isin(1, 14))
    state = likelihood.fit_rounds(returns, starts, 12, True)
    before = {(r["series"], r["start"]): r["loglik"] for r in likelihood.evaluated(returns, starts, True).collect()}
    assert all(r["loglik"] >= before[r["series"], r["start"]] for r in state.collect())
    best = {r["series"]: r for r in likelihood.best_fits(state, True).collect()}
    for name, v in values.items():
        want = garch.fit(v, 1.0, True)
        assert best[name]["n_starts"] == 2 and best[name]["n_converged"] >= 1
        assert best[name]["loglik"] == pytest.approx(want["loglik"], abs=2e-3)
        assert best[name]["alpha"] + best[name]["beta"] == pytest.approx(want["alpha"] + want["beta"], abs=0.02)
