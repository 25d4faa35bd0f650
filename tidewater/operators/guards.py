"""Refusal of input that a statistic is not defined for. Checks are columns, so they run where the rows are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.config import REGIMES, Study, level_key


def refuse(rows: DataFrame, bad: Column, message: str) -> DataFrame:
    """rows; the job fails with message if `bad` is true for any of them. Null is not bad."""
    # the check stands in a filter, so that no later choice of columns takes it away
    return rows.where(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))


def refuse_unpositive(rows: DataFrame, columns: tuple[str, ...] = ("proxy_var", "variance")) -> DataFrame:
    """Variances must be above zero where they are known."""
    return refuse(rows, reduce(lambda a, b: a | b, (F.col(c) <= 0 for c in columns)), "the loss is defined for positive variances only")


def refuse_infinite(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Numbers must be finite where they are known."""
    return refuse(rows, reduce(lambda a, b: a | b, (F.isnan(c) | (F.abs(c) == float("inf")) for c in columns)), f"not finite: one of {', '.join(columns)}")


def refuse_inverted(rows: DataFrame, study: Study) -> DataFrame:
    """No upper bound of an interval may lie below its lower bound."""
    return refuse(rows, reduce(lambda a, b: a | b, (F.col(f"hi_{level_key(x)}") < F.col(f"lo_{level_key(x)}") for x in study.levels)), "an upper bound lies below its lower bound")


def refuse_pit_outside(rows: DataFrame) -> DataFrame:
    """Values of a distribution function lie between 0 and 1."""
    return refuse(rows, (F.col("pit") < 0) | (F.col("pit") > 1) | F.isnan("pit"), "pit outside of [0, 1]")


def refuse_repeats(rows: DataFrame, by: tuple[str, ...] = ("series", "date", "model")) -> DataFrame:
    """One row for each key."""
    counted = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    return refuse(counted, F.col("_n") > 1, f"repeated rows of {', '.join(by)}").drop("_n")


def refuse_uncovered(rows: DataFrame, column: str) -> DataFrame:
    """A looked-up column must be there for every row."""
    return refuse(rows, F.col(column).isNull(), f"dates without {column}")


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], what: str) -> DataFrame:
    """rows with the columns of table, which must have a row for each of their keys; its values may be null."""
    met = rows.join(table.withColumn("_met", F.lit(True)), on, "left")
    return refuse(met, F.col("_met").isNull(), f"dates without {what}").drop("_met")


def refuse_unknown_models(rows: DataFrame, models: list[str]) -> DataFrame:
    """Every named model must have rows in every series; no row is looked at by the driver."""
    found = rows.groupBy("series").agg(F.collect_set(F.when(F.col("model").isin(models), F.col("model"))).alias("_found"))
    checked = refuse(found, F.size("_found") < len(set(models)), f"a series lacks one of the models {', '.join(models)}").select("series")
    return rows.join(checked, "series", "left_semi")


def refuse_small_regimes(rows: DataFrame, column: str, study: Study) -> DataFrame:
    """Every regime of every model must have study.min_regime days with the column."""
    counts = [F.count_if((F.col("regime") == r) & F.col(column).isNotNull()) for r in REGIMES]
    found = rows.groupBy("series", "model").agg(F.least(*counts).alias("_least"))
    checked = refuse(found, F.col("_least") < study.min_regime, f"a regime has fewer than {study.min_regime} days with {column}").select("series", "model")
    return rows.join(checked, ["series", "model"], "left_semi")


def checked_scores(table: DataFrame, study: Study) -> DataFrame:
    """A forecast table that scores are defined for: one row for each key, finite numbers, ordered bounds, pit in [0, 1]."""
    numbers = ("variance", "pit", "log_return", "proxy_var", *(f"{s}_{level_key(x)}" for x in study.levels for s in ("lo", "hi")), "var_99")
    out = refuse_infinite(refuse_repeats(table), numbers)
    return refuse_pit_outside(refuse_inverted(refuse_unpositive(out), study))
