"""Returns, range variance, regimes, the joined frame and what is measured on its training dates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.config import Study


def by_date(*more: str):
    return Window.partitionBy("series", *more).orderBy("date")


def log_return(price: Column, w) -> Column:
    """Difference of log prices; a price that is not positive makes two of them null."""
    logged = F.when(price > 0, F.log(F.when(price > 0, price)))
    return logged - F.lag(logged).over(w)


def range_variance(high: Column, low: Column) -> Column:
    """log(high/low)**2 / (4 log 2); null unless high > low > 0."""
    ratio = F.when((low > 0) & (high > low), high / F.when(low > 0, low))
    return F.pow(F.log(ratio), 2) / (4 * math.log(2))


def label(level: Column, calm_max: float | Column, stressed_min: float | Column) -> Column:
    """calm below the first cut-point, stressed above the second, else normal; null stays null."""
    return F.when(level.isNull(), None).when(level < calm_max, "calm").when(level > stressed_min, "stressed").otherwise("normal")


def returns(bars: DataFrame) -> DataFrame:
    return bars.select("series", "date", log_return(F.col("close"), by_date()).alias("log_return"))


def ranges(bars: DataFrame) -> DataFrame:
    return bars.select("series", "date", range_variance(F.col("high"), F.col("low")).alias("parkinson_var"))


def frame(bars: DataFrame, driver: DataFrame, study: Study) -> DataFrame:
    """(series, date, log_return, parkinson_var, driver_lagged, regime) on the dates that both have.

    Dates of one side only are dropped, never filled. Lags are taken over the whole joined history; cut to dates
    afterwards, so that the first row kept has its lag.
    """
    joined = bars.join(driver.select("date", F.col("close").alias("driver")), "date")
    lagged = joined.withColumn("driver_lagged", F.lag("driver").over(by_date())).withColumn("log_return", log_return(F.col("close"), by_date()))
    return lagged.select(
        "series", "date", "log_return", range_variance(F.col("high"), F.col("low")).alias("parkinson_var"), "driver_lagged", label(F.col("driver_lagged"), study.calm_max, study.stressed_min).alias("regime")
    )


def trimmed(framed: DataFrame, first: str, last: str) -> DataFrame:
    """The frame from one date to another, both kept. Lags were taken before, so the first row kept has its own."""
    return framed.where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def mismatches(bars: DataFrame, driver: DataFrame) -> DataFrame:
    """(date, side): dates that only one of the two has."""
    left, right = bars.select("date").distinct(), driver.select("date").distinct()
    return left.join(right, "date", "left_anti").withColumn("side", F.lit("bars_only")).unionByName(right.join(left, "date", "left_anti").withColumn("side", F.lit("driver_only")))


def quality(framed: DataFrame, bars: DataFrame, driver: DataFrame) -> DataFrame:
    """(kind, date): calendar mismatches, days without a range, days with a return of exactly zero."""
    parts = [
        mismatches(bars, driver).select(F.col("side").alias("kind"), "date"),
        framed.where(F.col("parkinson_var").isNull()).select(F.lit("no_range").alias("kind"), "date"),
        framed.where(F.col("log_return") == 0).select(F.lit("zero_return").alias("kind"), "date"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def split(framed: DataFrame, study: Study) -> DataFrame:
    """The frame with `part`: train or oos; rows in neither are dropped."""
    part = F.when(F.col("date") <= F.lit(study.train_end).cast("date"), "train").when(F.col("date") >= F.lit(study.oos_start).cast("date"), "oos")
    return framed.withColumn("part", part).where(F.col("part").isNotNull())


def proxy_scale(framed: DataFrame, study: Study) -> DataFrame:
    """(series, c): mean squared return over mean range variance, on training rows with both."""
    rows = split(framed, study).where((F.col("part") == "train") & F.col("log_return").isNotNull() & F.col("parkinson_var").isNotNull())
    return rows.groupBy("series").agg((F.avg(F.col("log_return") * F.col("log_return")) / F.avg("parkinson_var")).alias("c"))


def trailing_mean(framed: DataFrame, n: int) -> DataFrame:
    """The frame with `trail_mean`: mean range variance of the n rows before, null unless all n are there."""
    w = by_date().rowsBetween(-n, -1)
    return framed.withColumn("trail_mean", F.when(F.count("parkinson_var").over(w) == n, F.avg("parkinson_var").over(w)))


def terciles(framed: DataFrame, study: Study) -> DataFrame:
    """(series, low, high): exact terciles of the trailing mean over training rows."""
    rows = split(trailing_mean(framed, study.trailing), study).where(F.col("part") == "train")
    q = F.percentile("trail_mean", F.array(F.lit(1 / 3), F.lit(2 / 3)))
    return rows.groupBy("series").agg(q.alias("q")).select("series", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def trailing_regimes(framed: DataFrame, study: Study) -> DataFrame:
    """The frame with `trailing_regime`, cut at the training terciles."""
    cut = terciles(framed, study)  # a row for each series
    rows = trailing_mean(framed, study.trailing).join(cut, "series")
    return rows.withColumn("trailing_regime", label(F.col("trail_mean"), F.col("low"), F.col("high"))).drop("low", "high")


def describe(framed: DataFrame) -> DataFrame:
    """Moments of the returns: sample deviation, skew and excess kurtosis adjusted for the sample size."""
    n = F.col("n").cast("double")
    rows = framed.where(F.col("log_return").isNotNull()).groupBy("series").agg(
        F.count("*").alias("n"), F.avg("log_return").alias("mean"), F.stddev_samp("log_return").alias("std"), F.skewness("log_return").alias("g1"), F.kurtosis("log_return").alias("g2"),
        F.min("log_return").alias("min"), F.max("log_return").alias("max"), F.count_if(F.col("log_return") == 0).alias("n_zero"),
    )
    skew = F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)
    return rows.select("series", "n", "mean", "std", skew.alias("skew"), kurt.alias("kurtosis"), "min", "max", (F.sqrt(F.lit(252.0)) * F.col("std")).alias("annual_vol"), "n_zero")


def regime_counts(framed: DataFrame) -> DataFrame:
    return framed.groupBy("series", "regime").agg(F.count("*").alias("n"))
