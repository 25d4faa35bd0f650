"""Walk-forward forecasts of the models without fitted parameters, and the forecast table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.config import NORMAL_Z, Study, level_key
from tidewater.functions.expressions import normal_cdf
from tidewater.operators.derive import by_date, proxy_scale, split
from tidewater.operators.recurrence import linear_recurrence


def seed_variance(framed: DataFrame, study: Study) -> DataFrame:
    """(series, h0): sample variance of the training returns."""
    rows = split(framed, study).where(F.col("part") == "train")
    return rows.groupBy("series").agg(F.var_samp("log_return").alias("h0"))


def yesterday(framed: DataFrame, study: Study) -> DataFrame:
    """The scaled range variance of the day before; null where it is."""
    scale = proxy_scale(framed, study)  # a row for each series
    return framed.join(scale, "series").withColumn("variance", F.lag(F.col("c") * F.col("parkinson_var")).over(by_date())).drop("c")


def ewma(framed: DataFrame, study: Study) -> DataFrame:
    """Exponentially weighted variance from the training variance on; a missing return leaves it as it was. Null on a series' first day."""
    seeded = framed.join(seed_variance(framed, study), "series")
    b = (1 - study.ewma_lambda) * F.col("log_return") * F.col("log_return")
    rows = linear_recurrence(seeded.withColumn("b", b), study.ewma_lambda, "b", "h0", name="variance")
    return rows.withColumn("variance", F.when(F.row_number().over(by_date()) > 1, F.col("variance"))).drop("b", "h0")


def garch_variance(framed: DataFrame, mu: float, omega: float, alpha: float, beta: float, study: Study) -> DataFrame:
    """Conditional variance at fixed parameters, from the training variance on. A null return makes all later values null."""
    seeded = framed.join(seed_variance(framed, study), "series")
    shock = omega + alpha * F.pow(F.col("log_return") - mu, 2)
    # leading rows have no return yet: the recursion begins at the first one
    started = seeded.withColumn("b", shock).withColumn("_seen", F.count("log_return").over(by_date().rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_seen") > 0)
    rows = linear_recurrence(started, beta, "b", "h0", name="variance")
    missing = F.max(F.col("log_return").isNull().cast("int")).over(by_date().rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("variance", F.when(F.coalesce(missing, F.lit(0)) == 0, F.col("variance"))).drop("b", "h0", "_seen")


def refit_ids(framed: DataFrame, study: Study) -> DataFrame:
    """Out-of-sample rows with refit_id: every refit_every-th row begins a new one, from 0."""
    rows = split(framed, study).where(F.col("part") == "oos").drop("part")
    return rows.withColumn("refit_id", F.floor((F.row_number().over(by_date()) - 1) / study.refit_every).cast("int"))


def refit_schedule(framed: DataFrame, study: Study) -> DataFrame:
    """(series, refit_id, refit_date, last_date, n_days)"""
    return refit_ids(framed, study).groupBy("series", "refit_id").agg(F.min("date").alias("refit_date"), F.max("date").alias("last_date"), F.count("*").alias("n_days"))


def estimation_windows(framed: DataFrame, study: Study) -> DataFrame:
    """(series, refit_id, train_start, train_end, n_obs): all rows strictly before the refit date.

    Counts are read off the row number of the refit date, so no refit meets the history row by row.
    """
    w = by_date()
    numbered = framed.select("series", F.col("date").alias("refit_date"), (F.row_number().over(w) - 1).cast("long").alias("n_obs"), F.lag("date").over(w).alias("train_end"), F.first("date").over(w).alias("train_start"))
    return refit_schedule(framed, study).join(numbered, ["series", "refit_date"]).select("series", "refit_id", "refit_date", "train_start", "train_end", "n_obs")


def with_normal_intervals(rows: DataFrame, study: Study, mean: Column | float = 0.0) -> DataFrame:
    """Interval bounds, value at risk and pit of a normal predictive with column variance; all null where that is."""
    sd, m = F.sqrt("variance"), F.lit(mean) if isinstance(mean, float) else mean
    out = {"mean": F.when(F.col("variance").isNotNull(), m)}
    for level in study.levels:
        z = NORMAL_Z[round(0.5 + level / 2, 6)]
        out[f"lo_{level_key(level)}"], out[f"hi_{level_key(level)}"] = m - z * sd, m + z * sd
    out["var_99"] = m - NORMAL_Z[study.var_level] * sd
    out["pit"] = normal_cdf((F.col("log_return") - m) / sd)
    return rows.withColumns(out)


def baselines(framed: DataFrame, study: Study) -> DataFrame:
    """The forecast table of the models yesterday and ewma on out-of-sample dates, one row for each (series, date, model)."""
    scale = proxy_scale(framed, study)
    refits = refit_ids(framed, study).select("series", "date", "refit_id")
    parts = [f(framed, study).select("series", "date", F.lit(name).alias("model"), "variance", "log_return", "parkinson_var", "regime") for name, f in (("yesterday", yesterday), ("ewma", ewma))]
    rows = parts[0].unionByName(parts[1]).join(refits, ["series", "date"]).join(scale, "series")
    usable = F.when(F.col("variance") > 0, F.col("variance"))
    rows = rows.withColumn("proxy_var", F.col("c") * F.col("parkinson_var")).withColumn("variance", usable).drop("c", "parkinson_var")
    return with_normal_intervals(rows, study)


def merge_tracks(tracks: list[tuple[Study, DataFrame]], ignore: tuple[str, ...] = ()) -> DataFrame:
    """Forecast tables of several runs in one; they must share their settings but for those ignored."""
    first, out = tracks[0]
    for study, table in tracks[1:]:
        if found := first.differences(study, ignore):
            raise ValueError(f"runs differ in {found}")
        out = out.unionByName(table)
    return out
