"""Operators on series whose answers are known."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.config import ORDERS, Study, level_key
from tidewater.functions import special
from tidewater.functions.expressions import normal_cdf
from tidewater.operators import derive, diagnostics, forecasts, garch, recurrence, resampling, scoring
from tidewater.sources import bars

STUDY = replace(ORDERS, train_end="2020-04-30", oos_start="2020-05-01", refit_every=10, calm_max=15.0, stressed_min=25.0)
BARS = "series string, date date, open double, high double, low double, close double, volume long"


def _bars(n=160, seed=3, series="A"):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    spread = 0.004 + 0.01 * rng.random(n)
    days = pd.bdate_range("2020-01-01", periods=n).date
    return [(series, d, float(c), float(c * (1 + s)), float(c * (1 - s)), float(c), 1) for d, c, s in zip(days, close, spread)]


@pytest.fixture(scope="module")
def prices(spark):
    return spark.createDataFrame(_bars() + _bars(seed=4, series="B"), BARS)


@pytest.fixture(scope="module")
def driver(spark):
    days = pd.bdate_range("2020-01-01", periods=160).date
    return spark.createDataFrame([(d, 10.0 + 25 * i / 159) for i, d in enumerate(days)], "date date, close double")


@pytest.fixture(scope="module")
def framed(prices, driver):
    return derive.frame(prices, driver, STUDY).cache()


def test_returns_and_ranges(spark):
    rows = [("A", dt.date(2020, 1, i + 1), 1.0, math.e if i != 2 else 1.0, 1.0, c, 1) for i, c in enumerate([1.0, math.e, -1.0, 1.0, math.e])]
    table = spark.createDataFrame(rows, BARS)
    r = [x["log_return"] for x in derive.returns(table).orderBy("date").collect()]
    assert r[1] == pytest.approx(1) and r[4] == pytest.approx(1) and r[0] is r[2] is r[3] is None
    p = [x["parkinson_var"] for x in derive.ranges(table).orderBy("date").collect()]
    assert p[0] == pytest.approx(1 / (4 * math.log(2))) and p[2] is None


def test_both_cut_points_are_normal(spark):
    levels = spark.createDataFrame([(14.99,), (15.0,), (25.0,), (25.01,), (None,)], "v double")
    got = [r[0] for r in levels.select(derive.label(F.col("v"), 15.0, 25.0)).collect()]
    assert got == ["calm", "normal", "normal", "stressed", None]


@pytest.mark.parametrize("n, block", [(7, 3), (50, 7), (900, 200)])
def test_recurrence_equals_a_loop(spark, n, block):
    rng = np.random.default_rng(n)
    b = [None if rng.random() < 0.1 else float(x) for x in rng.random(n)]
    rows = spark.createDataFrame([("A", i, x, 2.5) for i, x in enumerate(b)] + [("B", 0, 1.0, 9.0)], "series string, date int, b double, seed double")
    out = recurrence.linear_recurrence(rows, 0.7, "b", "seed", block=block).orderBy("series", "date").collect()
    h = 2.5
    for r, x in zip(out, b):
        assert r["h"] == pytest.approx(h, rel=1e-12)
        h = h if x is None else 0.7 * h + x
    assert out[-1]["h"] == 9.0


def test_forecasts_do_not_look_ahead(prices, driver, spark):
    cut = dt.date(2020, 6, 15)
    shaken = prices.withColumns({c: F.when(F.col("date") >= F.lit(cut), F.col(c) * (1 + F.pmod(F.hash("date"), F.lit(7)))).otherwise(F.col(c)) for c in ("high", "close")})
    a, b = (forecasts.baselines(derive.frame(x, driver, STUDY), STUDY).select("series", "date", "model", "variance", "var_99", "lo_95") for x in (prices, shaken))
    upto = F.col("date") <= F.lit(cut)
    assert a.where(upto).exceptAll(b.where(upto)).count() == 0
    assert a.where(~upto).exceptAll(b.where(~upto)).count() > 0  # the same change does move what comes later


def test_bounds_are_ordered(framed):
    rows = forecasts.baselines(framed, STUDY).where("variance is not null")
    assert rows.count() > 0
    assert rows.where("not (lo_99 < var_99 and var_99 < lo_95 and lo_95 < lo_90 and lo_90 < hi_90 and hi_90 < hi_95 and hi_95 < hi_99)").count() == 0


def test_refits_have_equal_blocks_and_past_windows(framed):
    blocks = [r["n_days"] for r in forecasts.refit_schedule(framed, STUDY).where("series = 'A'").orderBy("refit_id").collect()]
    assert set(blocks[:-1]) == {10} and blocks[-1] <= 10
    assert forecasts.estimation_windows(framed, STUDY).where("train_end >= refit_date").count() == 0


def test_missing_returns(spark, driver):
    rows = _bars()
    rows[100] = (*rows[100][:5], -1.0, 1)
    f = derive.frame(spark.createDataFrame(rows, BARS), driver, STUDY)
    smooth = {r["date"]: r["variance"] for r in forecasts.ewma(f, STUDY).collect()}
    assert smooth[rows[101][1]] == smooth[rows[102][1]] is not None
    filtered = {r["date"]: r["variance"] for r in forecasts.garch_variance(f, 0.0, 1e-5, 0.1, 0.8, STUDY).collect()}
    assert filtered[rows[100][1]] is not None and filtered[rows[101][1]] is None


def test_kupiec_and_independence(spark):
    def of(hits):
        rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(i), "m", float(h)) for i, h in enumerate(hits)]
        return scoring.var_tests(spark.createDataFrame(rows, "series string, date date, model string, exceedance double"), Study(var_level=0.9)).first()

    r = of([0, 0, 1, 1, 0, 1, 0, 0])
    want = -2 * (3 * math.log(0.1) + 5 * math.log(0.9) - 3 * math.log(3 / 8) - 5 * math.log(5 / 8))
    assert r["lr_uc"] == pytest.approx(want)
    # transitions: 00 twice, 01 twice, 10 twice, 11 once
    free = 2 * math.log(0.5) + 2 * math.log(0.5) + 2 * math.log(2 / 3) + math.log(1 / 3)
    assert r["lr_ind"] == pytest.approx(-2 * (4 * math.log(4 / 7) + 3 * math.log(3 / 7) - free))
    assert r["p_cc"] == pytest.approx(math.exp(-r["lr_cc"] / 2))
    none = of([0] * 500)
    assert none["lr_uc"] == pytest.approx(-1000 * math.log(0.9)) and none["lr_ind"] == 0


def test_swapping_a_pair_turns_the_sign(framed):
    s = scoring.score(forecasts.baselines(framed, STUDY), STUDY)
    out = scoring.comparison(scoring.paired(s, [("yesterday", "ewma"), ("ewma", "yesterday")], ("qlike",)), "qlike")
    by = {(r["series"], r["model_a"]): r["statistic"] for r in out.collect()}
    assert by["A", "ewma"] == pytest.approx(-by["A", "yesterday"])


def test_proxy_moves_losses_and_nothing_else(framed):
    f = forecasts.baselines(framed, STUDY)
    other = framed.withColumn("proxy_var", F.col("parkinson_var") * (1 + F.pmod(F.hash("date"), F.lit(5))))
    a, b = scoring.score(f, STUDY), scoring.score(f, STUDY, other)
    assert scoring.coverage(a, STUDY).exceptAll(scoring.coverage(b, STUDY)).count() == 0
    assert a.select("date", "qlike").exceptAll(b.select("date", "qlike")).count() > 0


def test_regimes_add_up(framed):
    s = scoring.score(forecasts.baselines(framed, STUDY), STUDY)
    whole = {(r["series"], r["model"]): r["breaches"] for r in scoring.var_tests(s, STUDY).collect()}
    parts = scoring.var_tests(s, STUDY, ("series", "model", "regime"), independence=False).groupBy("series", "model").agg(F.sum("breaches").alias("b"))
    assert {(r["series"], r["model"]): r["b"] for r in parts.collect()} == whole


def test_blocks_widen_the_interval_of_dependent_values(spark):
    rng, x, rows = np.random.default_rng(1), 0.0, []
    for i in range(600):
        x = 0.9 * x + rng.normal()
        rows.append(("A", dt.date(2015, 1, 1) + dt.timedelta(i), float(x)))
    values = spark.createDataFrame(rows, "series string, date date, value double")
    width = {}
    for block in (1, 20):
        r = resampling.mean_interval(values, ["series"], replace(STUDY, block=block, replicates=300)).first()
        assert r["lower"] < r["point"] < r["upper"]
        width[block] = r["upper"] - r["lower"]
    assert width[20] > 2 * width[1]


def test_indices_go_on_by_one_inside_a_block(spark):
    out = resampling.indices(spark.createDataFrame([(200,)], "n long"), replace(STUDY, replicates=20)).orderBy("rep", "t").toPandas()
    step = out.groupby("rep").idx.diff().dropna() % 200
    assert 0.9 < (step == 1).mean() < 0.985 and out.idx.between(0, 199).all()


def test_diagnostics_fire_and_stay_silent(spark):
    rng = np.random.default_rng(7)
    noise, r, h = rng.normal(0, 0.01, 1500), [], 2e-5
    for z in rng.normal(size=1500):
        r.append(z * math.sqrt(h))
        h = 1e-6 + 0.2 * r[-1] ** 2 + 0.75 * h
    for values, fires in ((noise, False), (np.array(r), True)):
        rows = [("A", dt.date(2014, 1, 1) + dt.timedelta(i), float(v)) for i, v in enumerate(values)]
        table = spark.createDataFrame(rows, "series string, date date, value double")
        assert (special.chi2_sf(diagnostics.arch_lm_1(table).first()["statistic"], 1) < 0.001) == fires
        squares = diagnostics.ljung_box(table.withColumn("value", F.pow("value", 2))).where("lags = 10").first()["statistic"]
        assert (special.chi2_sf(squares, 10) < 0.001) == fires


def test_distribution_functions(spark):
    x = np.linspace(-9, 9, 61)
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(normal_cdf(F.col("x"))).collect()]
    assert np.allclose(got, [0.5 * math.erfc(-v / math.sqrt(2)) for v in x], rtol=1e-9, atol=1e-16)
    assert np.allclose(special.t_cdf(special.t_ppf(np.array([0.005, 0.05, 0.5, 0.99]), 5.0), 5.0), [0.005, 0.05, 0.5, 0.99], atol=1e-10)
    assert special.t_ppf(np.array([0.975]), 10.0)[0] == pytest.approx(2.2281388519649385, rel=1e-8)
    assert special.t_cdf(np.array([1.3]), 1e6)[0] == pytest.approx(0.5 * math.erfc(-1.3 / math.sqrt(2)), abs=1e-5)
    assert special.chi2_sf(3.0, 2) == pytest.approx(math.exp(-1.5)) and special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert special.binomial_test(2, 10) == pytest.approx(0.109375)


def test_tails_in_the_jvm_equal_the_plain_ones(spark):
    from tidewater.functions import expressions as e

    rows = [(t, n) for t in (-4.0, -1.3, 0.0, 0.2, 2.5) for n in (1, 2, 3, 4, 5, 10, 31, 700, 20_000)]
    got = spark.createDataFrame(rows, "t double, n long").select("t", "n", e.t_two_sided(F.col("t"), F.col("n")).alias("p")).collect()
    assert all(r["p"] == pytest.approx(2 * float(special.t_cdf(np.array([-abs(r["t"])]), float(r["n"]))[0]), abs=1e-8) for r in got)
    x = spark.createDataFrame([(v,) for v in (0.0, 0.3, 4.0, 25.0, 90.0)], "x double")
    for df in (1, 2, 3, 5, 10, 22):
        assert all(r["p"] == pytest.approx(special.chi2_sf(r["x"], df), abs=1e-9) for r in x.select("x", e.chi2_sf(F.col("x"), df).alias("p")).collect())
    # a published example: skewness and size of a sample with its two-sided p-value
    values = [1, 2, 3, 4, 5, 6, 7, 8000]
    skew = float(np.mean((np.array(values) - np.mean(values)) ** 3) / np.std(values) ** 3)
    p = spark.createDataFrame([(skew, 8), (skew, 7)], "s double, n long").select(e.skew_test_p(F.col("s"), F.col("n"))).collect()
    assert p[0][0] == pytest.approx(0.00039, abs=1e-4) and p[1][0] is None


def test_fit_recovers_parameters():
    rng, h, r = np.random.default_rng(12), 4e-5, []
    nu = 7.0
    for z in rng.standard_t(nu, 5000) * math.sqrt((nu - 2) / nu):
        r.append(5e-4 + z * math.sqrt(h))
        h = 2e-6 + 0.09 * (r[-1] - 5e-4) ** 2 + 0.88 * h
    found = garch.fit(np.array(r), 100.0, True)
    assert found["converged"] and found["alpha"] == pytest.approx(0.09, abs=0.03) and found["beta"] == pytest.approx(0.88, abs=0.04) and found["nu"] == pytest.approx(7, abs=2)
    with pytest.raises(ValueError):
        garch.fit(np.zeros(100), 100.0, True)


def test_likelihood_scales():
    rng = np.random.default_rng(1)
    r = rng.normal(0, 0.01, 300)
    theta = np.array([[1e-4, 1e-6, 0.1, 0.85, 6.0]])
    big = theta * [100, 1e4, 1, 1, 1]
    for student in (True, False):
        a, b = garch.log_likelihood(theta, r, r.var(), student)[0], garch.log_likelihood(big, 100 * r, 1e4 * r.var(), student)[0]
        assert a == pytest.approx(b + len(r) * math.log(100))


def test_likelihood_of_rows_equals_that_of_an_array(framed):
    theta = (1e-4, 1e-6, 0.1, 0.85)
    one = framed.where("series = 'A'")
    r = np.array([x[0] for x in derive.split(one, STUDY).where("part = 'train' and log_return is not null").orderBy("date").select("log_return").collect()])
    for nu in (7.0, None):
        want = garch.log_likelihood(np.array([[*theta, nu or 9.0]]), r, r.var(ddof=1), nu is not None)[0]
        assert garch.garch_likelihood(one, *theta, STUDY, nu=nu).first()["loglik"] == pytest.approx(want, rel=1e-9)
    assert garch.garch_likelihood(one, *theta, STUDY, nu=3.0).first()["loglik"] == -math.inf
    assert garch.garch_likelihood(one, 0.0, 1e-6, 0.2, 0.85, STUDY).first()["loglik"] == -math.inf


def test_mixture_of_equal_draws_is_the_plain_distribution():
    mean, h, nu = np.full(5, 0.001), np.full((5, 3), 1e-4), np.full(5, 8.0)
    want = 0.001 + math.sqrt(1e-4 * 6 / 8) * special.t_ppf(np.array([0.01]), 8.0)[0]
    mixture = garch.Mixture(mean, h, nu)
    assert np.allclose(mixture.quantile(0.01), want, rtol=1e-8)
    assert np.allclose(mixture.cdf(np.full(3, want)), 0.01, rtol=1e-8)


def test_a_failed_refit_blanks_its_own_block(framed):
    study = replace(STUDY, train_end="2020-02-28", oos_start="2020-03-02")  # the first refits have too few returns
    out = garch.garch_forecasts(framed.where("series = 'A'"), study, ("garch_normal",)).toPandas().sort_values("date")
    blank = out.groupby("refit_id").variance.apply(lambda v: v.isna().all())
    assert blank.iloc[0] and not blank.iloc[-1] and out.groupby("refit_id").variance.apply(lambda v: v.isna().any() == v.isna().all()).all()


def test_posterior_draws_are_admissible():
    rng = np.random.default_rng(5)
    draws, facts = garch.sample(rng.normal(0, 0.01, 300), 100.0, 1, chains=16, draws=60)
    assert len(draws) == 960 and (draws[:, 2] + draws[:, 3] < 1).all() and (draws[:, 4] > 4).all() and facts["max_r_hat"] > 0.9


def test_dispersed_draws_have_wider_tails():
    nu, mean = np.full(60, 8.0), np.zeros(60)
    h = 1e-4 * np.exp(np.random.default_rng(1).normal(0, 0.8, (60, 1)))
    spread, plain = garch.Mixture(mean, h, nu), garch.Mixture(mean[:1], np.array([[h.mean()]]), nu[:1])
    assert spread.quantile(0.005)[0] < plain.quantile(0.005)[0] and spread.quantile(0.05)[0] > plain.quantile(0.05)[0]


def test_studies_must_agree_to_be_merged(framed):
    rows = forecasts.baselines(framed, STUDY)
    with pytest.raises(ValueError):
        forecasts.merge_tracks([(STUDY, rows), (replace(STUDY, refit_every=63), rows)])
    assert forecasts.merge_tracks([(STUDY, rows), (replace(STUDY, seed=1), rows)], ("seed",)).count() == 2 * rows.count()
    with pytest.raises(ValueError):
        Study(train_end="2020-01-02", oos_start="2020-01-02")
    assert level_key(0.9) == "90" and level_key(0.975) == "975"


def test_tickers_without_letters_are_refused():
    assert bars.file_name("^V-I.X_") == "VIX.csv"
    with pytest.raises(ValueError):
        bars.file_name("^_")


def test_files_and_their_manifest(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / bars.file_name("^VIX")).write_text("Date,Open,High,Low,Close,Adj Close,Volume\n2020-01-02,1,2,0.5,1.5,1.5,10\n2020-01-03,x,2,0.5,1.5,,10\n")
    rows = bars.read_csv(spark, str(folder)).orderBy("date").collect()
    assert rows[0]["series"] == "VIX" and rows[0]["close"] == 1.5 and rows[1]["open"] is None
    found = bars.manifest(spark, str(folder))
    recorded = spark.createDataFrame(found.collect(), found.schema)
    assert recorded.first()["n_rows"] == 2 and bars.read_verified(spark, str(folder), recorded).count() == 2
    (folder / "new.csv").write_text("Date,Open,High,Low,Close,Adj Close,Volume\n")
    assert {r["file"]: r["ok"] for r in bars.verify(bars.manifest(spark, str(folder)), recorded).collect()} == {"VIX.csv": True, "new.csv": False}
    with pytest.raises(ValueError):
        bars.read_verified(spark, str(folder), recorded)
    with pytest.raises(ValueError):
        bars.canonical(spark.createDataFrame([(1,)], "Close int"))


def test_stream_equals_the_batch_filter(spark, tmp_path):
    from tidewater.streaming.monitor import ewma_stream

    rng = np.random.default_rng(2)
    prices = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 40)))
    rows = [(s, dt.datetime(2020, 1, 1) + dt.timedelta(hours=i), float(p)) for s in "AB" for i, p in enumerate(prices)]
    src = str(tmp_path / "in")
    schema = "series string, ts timestamp, price double"
    for part in (rows[0:20] + rows[40:60], rows[20:40] + rows[60:80]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = ewma_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), 1e-4)
    query = stream.writeStream.format("memory").queryName("ewma_out").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("ewma_out").where("series = 'A'").orderBy("ts").collect()
    h = 1e-4
    assert len(got) == 40
    for i, r in enumerate(got):
        assert r["variance"] == pytest.approx(h)
        if i:
            h = 0.94 * h + 0.06 * math.log(prices[i] / prices[i - 1]) ** 2
        if i == 0:
            assert r["log_return"] is None


@pytest.mark.parametrize("n", [1, 31, 32, 33, 200])
def test_variances_equal_a_loop(n):
    rng = np.random.default_rng(n)
    r = rng.normal(0, 1, n)
    theta = np.array([[0.1, 0.2, 0.1, 0.8], [0.0, 0.5, 0.3, 1e-12], [0.0, 0.01, 0.05, 0.949]])
    out = garch.variances(theta, r, 1.5)
    for row, (mu, omega, alpha, beta) in zip(out, theta):
        h = 1.5
        for t in range(n):
            assert row[t] == pytest.approx(h, rel=1e-7)
            h = omega + alpha * (r[t] - mu) ** 2 + beta * h
        assert row[n] == pytest.approx(h, rel=1e-7)
    if n > 40:
        r[35] = np.nan
        assert np.isfinite(garch.variances(theta, r, 1.5)[:, :36]).all() and np.isnan(garch.variances(theta, r, 1.5)[:, 36:]).all()


@pytest.mark.parametrize("kind", ["negative", "infinite", "inverted", "pit", "repeated"])
def test_tables_that_scores_are_not_defined_for_are_refused(spark, kind):
    from tidewater.operators import guards

    good = {"series": "s", "date": "2020-01-01", "model": "m", "variance": 1.0, "pit": 0.5, "log_return": 0.1, "proxy_var": 1.0, "lo_90": -1.0, "hi_90": 1.0, "lo_95": -2.0, "hi_95": 2.0, "lo_99": -3.0, "hi_99": 3.0, "var_99": -2.5}
    unknown = good | {"date": "2020-01-02"} | {k: None for k, v in good.items() if isinstance(v, float)}
    bad = good | {"date": "2020-01-03"} | {"negative": {"variance": -1.0}, "infinite": {"log_return": float("inf")}, "inverted": {"hi_95": -2.5}, "pit": {"pit": 1.5}, "repeated": {"date": "2020-01-01"}}[kind]
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in good.items())
    table = lambda *rows: spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    assert guards.checked_scores(table(good, unknown), ORDERS).count() == 2
    with pytest.raises(Exception, match="only|finite|below|outside|repeated"):
        guards.checked_scores(table(good, unknown, bad), ORDERS).count()


def test_unknown_models_and_small_regimes_are_refused(spark):
    from tidewater.operators import guards

    rows = spark.createDataFrame([("s", m, r, 1.0) for m in ("a", "b") for r in ("calm", "normal", "stressed") for _ in range(3)], "series string, model string, regime string, qlike double")
    assert guards.refuse_unknown_models(rows, ["a", "b"]).count() == 18
    with pytest.raises(Exception, match="lacks"):
        guards.refuse_unknown_models(rows, ["a", "c"]).count()
    assert guards.refuse_small_regimes(rows, "qlike", replace(STUDY, min_regime=3)).count() == 18
    with pytest.raises(Exception, match="fewer than 4"):
        guards.refuse_small_regimes(rows, "qlike", replace(STUDY, min_regime=4)).count()
    with pytest.raises(Exception, match="without"):
        guards.refuse_uncovered(rows.withColumn("proxy_var", F.lit(None).cast("double")), "proxy_var").count()
