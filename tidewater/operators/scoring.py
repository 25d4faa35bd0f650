"""Scores of a forecast table and tests on them. Every statistic is one aggregate over (series, model) groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.config import REGIMES, Study, level_key
from tidewater.functions import kolmogorov
from tidewater.functions.expressions import chi2_sf_1, chi2_sf_2, qlike, skew_test_p, t_two_sided, xlogy


def score(table: DataFrame, study: Study, proxy: DataFrame | None = None) -> DataFrame:
    """The table with qlike, mse, inside_*, width_* and exceedance; null where there is no forecast.

    proxy (series, date, proxy_var) replaces the table's own; dates it lacks score null.
    """
    if proxy is not None:
        table = table.drop("proxy_var").join(proxy.select("series", "date", "proxy_var"), ["series", "date"], "left")
    r = F.col("log_return")
    out = {"qlike": qlike(F.col("proxy_var"), F.col("variance")), "mse": F.pow(F.col("proxy_var") - F.col("variance"), 2)}
    for level in study.levels:
        k = level_key(level)
        out[f"inside_{k}"] = ((r >= F.col(f"lo_{k}")) & (r <= F.col(f"hi_{k}"))).cast("double")
        out[f"width_{k}"] = F.col(f"hi_{k}") - F.col(f"lo_{k}")
    out["exceedance"] = (r < F.col("var_99")).cast("double")
    return table.withColumns(out)


def common_dates(table: DataFrame, models: list[str], columns: tuple[str, ...] = ("variance", "pit", "var_99")) -> DataFrame:
    """(series, date) on which all models have all columns; one shuffle however many models there are."""
    complete = table.where(F.col("model").isin(models)).dropna(subset=list(columns))
    return complete.groupBy("series", "date").agg(F.count_distinct("model").alias("n")).where(F.col("n") == len(models)).select("series", "date")


def by_sample(scored: DataFrame, models: list[str]) -> DataFrame:
    """Rows with `sample`: `own` for each model's own days, and again `common` for the days that all models have."""
    common = scored.join(common_dates(scored, models), ["series", "date"], "left_semi")
    return scored.withColumn("sample", F.lit("own")).unionByName(common.withColumn("sample", F.lit("common")))


def stacked_levels(scored: DataFrame, study: Study) -> DataFrame:
    """A row for each level: nominal, inside, width, lo, hi."""
    levels = [F.struct(F.lit(x).alias("nominal"), *[F.col(f"{c}_{level_key(x)}").alias(c) for c in ("inside", "width", "lo", "hi")]) for x in study.levels]
    return scored.select("*", F.explode(F.array(*levels)).alias("l")).select("*", "l.*").drop("l")


def stacked_losses(scored: DataFrame) -> DataFrame:
    """A row for each loss: loss, value."""
    losses = F.array(*[F.struct(F.lit(x).alias("loss"), F.col(x).alias("value")) for x in ("qlike", "mse")])
    return scored.select("*", F.explode(losses).alias("l")).select("*", "l.*").drop("l")


def ranking(scored: DataFrame) -> DataFrame:
    """(series, loss, ranked): models from the least mean loss on, joined by commas; equal means by name, models without a loss left out."""
    means = stacked_losses(scored).groupBy("series", "loss", "model").agg(F.avg("value").alias("mean")).where(F.col("mean").isNotNull())
    ordered = F.array_sort(F.collect_list(F.struct("mean", "model")))
    return means.groupBy("series", "loss").agg(F.array_join(F.transform(ordered, lambda x: x["model"]), ",").alias("ranked"))


def coverage(scored: DataFrame, study: Study, by: tuple[str, ...] = ("series", "model")) -> DataFrame:
    """n, n_below, n_above, empirical coverage and mean width for each level."""
    r = F.col("log_return")
    return stacked_levels(scored.where(F.col("variance").isNotNull()), study).groupBy(*by, "nominal").agg(
        F.count("inside").alias("n"), F.count_if(r < F.col("lo")).alias("n_below"), F.count_if(r > F.col("hi")).alias("n_above"), F.avg("inside").alias("empirical"), F.avg("width").alias("mean_width")
    )


def _kupiec(n: Column, x: Column, p: float) -> Column:
    rate = x / n
    alone = xlogy(x, F.lit(p)) + xlogy(n - x, F.lit(1 - p))
    fitted = xlogy(x, rate) + xlogy(n - x, 1 - rate)
    return F.greatest(F.lit(0.0), -2 * (alone - fitted))


def var_tests(scored: DataFrame, study: Study, by: tuple[str, ...] = ("series", "model"), independence: bool = True) -> DataFrame:
    """Breaches of the value at risk: likelihood ratios of their rate, of their independence, and of both, with p-values.

    Independence is left out where by has more than series and model: days of a regime are not next to each other.
    """
    rows = scored.where(F.col("exceedance").isNotNull())
    w = Window.partitionBy(*by).orderBy("date")
    hit, last = F.col("exceedance"), F.col("last")
    rows = rows.withColumn("last", F.lag("exceedance").over(w))
    both = lambda a, b: F.count_if((last == a) & (hit == b)).cast("double")
    out = rows.groupBy(*by).agg(
        F.count("*").cast("double").alias("n"), F.sum("exceedance").alias("x"), both(0, 0).alias("n00"), both(0, 1).alias("n01"), both(1, 0).alias("n10"), both(1, 1).alias("n11")
    )
    p = 1 - study.var_level
    out = out.withColumn("lr_uc", _kupiec(F.col("n"), F.col("x"), round(p, 10)))
    n00, n01, n10, n11 = (F.col(c) for c in ("n00", "n01", "n10", "n11"))
    pi = F.try_divide(n01 + n11, n00 + n01 + n10 + n11)
    pi0, pi1 = F.coalesce(F.try_divide(n01, n00 + n01), F.lit(0.0)), F.coalesce(F.try_divide(n11, n10 + n11), F.lit(0.0))
    null = xlogy(n00 + n10, 1 - pi) + xlogy(n01 + n11, pi)
    free = xlogy(n00, 1 - pi0) + xlogy(n01, pi0) + xlogy(n10, 1 - pi1) + xlogy(n11, pi1)
    out = out.withColumn("lr_ind", F.greatest(F.lit(0.0), -2 * (null - free))).withColumn("lr_cc", F.col("lr_uc") + F.col("lr_ind"))
    tests = [F.col("lr_uc"), chi2_sf_1(F.col("lr_uc")).alias("p_uc")]
    if independence:
        tests += [F.col("lr_ind"), chi2_sf_1(F.col("lr_ind")).alias("p_ind"), F.col("lr_cc"), chi2_sf_2(F.col("lr_cc")).alias("p_cc")]
    return out.select(*by, F.col("n").cast("long").alias("n"), F.col("x").cast("long").alias("breaches"), (F.col("x") / F.col("n")).alias("rate"), *tests)


def pit_uniformity(scored: DataFrame, by: tuple[str, ...] = ("series", "model")) -> DataFrame:
    """Largest distance between the distribution of pit and the uniform one, its asymptotic and its exact p-value, and the mean of pit.

    p_value_is_approximate is always true: either p-value takes the forecast distributions for known ones, but their parameters are estimates.
    """
    rows = scored.where(F.col("pit").isNotNull())
    n = F.count("*").over(Window.partitionBy(*by))
    i = F.row_number().over(Window.partitionBy(*by).orderBy("pit", "date"))
    gap = F.greatest(i / n - F.col("pit"), F.col("pit") - (i - 1) / n)
    out = rows.withColumn("gap", gap).groupBy(*by).agg(F.count("*").alias("n"), F.max("gap").alias("ks"), F.avg("pit").alias("mean_pit"))
    x = F.col("ks") * (F.sqrt(F.col("n").cast("double")) + 0.12 + 0.11 / F.sqrt(F.col("n").cast("double")))
    terms = sum((2.0 if k % 2 else -2.0) * F.exp(-2.0 * k * k * x * x) for k in range(1, 21))
    p = F.when(x < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), terms)))
    return out.withColumns({"p_value": p, "p_exact": F.expr(kolmogorov.ks_tail("n", "ks")), "p_value_is_approximate": F.lit(True)})


def paired(scored: DataFrame, pairs: list[tuple[str, str]], needed: tuple[str, ...], columns: tuple[str, ...] | None = None) -> DataFrame:
    """(series, date, model_a, model_b, <column>_a, <column>_b, regime) on the dates on which both models of a pair have all that is needed."""
    columns = columns or needed
    spark = scored.sparkSession
    table = F.broadcast(spark.createDataFrame(pairs, "model_a string, model_b string"))
    a = scored.dropna(subset=list(needed)).select("series", "date", "regime", F.col("model").alias("model_a"), *[F.col(c).alias(f"{c}_a") for c in columns]).join(table, "model_a")
    b = scored.dropna(subset=list(needed)).select("series", "date", F.col("model").alias("model_b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return a.join(b, ["series", "date", "model_b"])


def comparison(pairs: DataFrame, column: str) -> DataFrame:
    """Equal predictive accuracy: mean difference of a loss over its long-run deviation, with Bartlett weights.

    The number of lags is floor(4 (n/100)^(2/9)); lagged products are averaged over the pairs that exist. If the weighted sum
    is not positive the plain variance stands in, with lag 0. A difference without variance has a null statistic.
    The statistic carries the small-sample factor sqrt((n-1)/n); its two-sided p-value is of the t distribution with n - 1
    degrees of freedom. One number comes to the driver: the largest n, which says how many lagged columns are needed.
    """
    by = ["series", "model_a", "model_b"]
    most = pairs.where(F.col(f"{column}_a").isNotNull()).groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    max_lag = math.floor(4 * (most / 100) ** (2 / 9)) + 1  # one more, whatever rounding does
    d = pairs.withColumn("d", F.col(f"{column}_a") - F.col(f"{column}_b"))
    all_rows, ordered = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("date")
    d = d.withColumn("c", F.col("d") - F.avg("d").over(all_rows)).withColumns({f"l{j}": F.lag("c", j).over(ordered) for j in range(1, max_lag + 1)})
    out = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg("d").alias("mean_diff"), F.avg(F.col("c") * F.col("c")).alias("g0"), *[F.avg(F.col("c") * F.col(f"l{j}")).alias(f"g{j}") for j in range(1, max_lag + 1)])
    n = F.col("n").cast("double")
    lag = F.floor(4 * F.pow(n / 100, F.lit(2 / 9))).cast("int")
    total = F.col("g0")
    for j in range(1, max_lag + 1):
        total = total + F.when(F.lit(j) <= lag, 2 * (1 - j / (lag + 1.0)) * F.coalesce(F.col(f"g{j}"), F.lit(0.0))).otherwise(0.0)
    out = out.withColumn("lrv", total).withColumn("lag", F.when(F.col("lrv") > 0, lag).otherwise(0)).withColumn("lrv", F.when(F.col("lrv") > 0, F.col("lrv")).otherwise(F.col("g0")))
    statistic = F.when(F.col("g0") > 0, F.try_divide(F.col("mean_diff"), F.sqrt(F.col("lrv") / n)) * F.sqrt((n - 1) / n))
    return out.select(*by, "n", "mean_diff", F.col("g0").alias("diff_variance"), "lag", statistic.alias("statistic")).withColumn("p_value", F.when(F.col("n") > 1, t_two_sided(F.col("statistic"), F.col("n") - 1)))


def regime_summary(scored: DataFrame, column: str) -> DataFrame:
    """n, mean, deviation and standard error for every (series, model, regime), empty regimes too."""
    spark = scored.sparkSession
    regimes = spark.createDataFrame([(r, i) for i, r in enumerate(REGIMES)], "regime string, regime_order int")
    groups = scored.select("series", "model").distinct().crossJoin(F.broadcast(regimes))  # three rows for each group
    found = scored.where(F.col(column).isNotNull()).groupBy("series", "model", "regime").agg(F.count("*").alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"))
    out = groups.join(found, ["series", "model", "regime"], "left")
    return out.select("series", "model", "regime", "regime_order", F.coalesce("n", F.lit(0)).alias("n"), "mean", "std", (F.col("std") / F.sqrt(F.col("n").cast("double"))).alias("se"))


def tail_asymmetry(scored: DataFrame, study: Study) -> DataFrame:
    """Breaches below and above each interval, what each side should have, and the skew of standardised residuals with its p-value."""
    rows = scored.where(F.col("variance").isNotNull()).withColumn("residual", (F.col("log_return") - F.col("mean")) / F.sqrt("variance"))
    r = F.col("log_return")
    out = stacked_levels(rows, study).groupBy("series", "model", "nominal").agg(
        F.count("*").alias("n"), F.count_if(r < F.col("lo")).alias("n_below"), F.count_if(r > F.col("hi")).alias("n_above"), F.skewness("residual").alias("residual_skew")
    )
    return out.withColumns({"expected_per_tail": (1 - F.col("nominal")) / 2 * F.col("n"), "skew_p": skew_test_p(F.col("residual_skew"), F.col("n"))})


def width_ratios(pairs: DataFrame, study: Study) -> DataFrame:
    """Mean of the daily ratios of interval widths, and both coverages, for all days and for each regime."""
    either = pairs.select("*", F.explode(F.array(F.lit("all"), F.col("regime"))).alias("group")).where(F.col("group").isNotNull())
    levels = [F.struct(F.lit(x).alias("nominal"), *[F.col(f"{c}_{level_key(x)}_{s}").alias(f"{c}_{s}") for c in ("inside", "width") for s in ("a", "b")]) for x in study.levels]
    rows = either.select("series", "model_a", "model_b", "group", F.explode(F.array(*levels)).alias("l")).select("*", "l.*")
    return rows.groupBy("series", "model_a", "model_b", "group", "nominal").agg(
        F.count("*").alias("n"), F.avg(F.col("width_a") / F.col("width_b")).alias("width_ratio"), F.avg("inside_a").alias("coverage_a"), F.avg("inside_b").alias("coverage_b")
    )
