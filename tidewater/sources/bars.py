"""Bars: (series, date, open, high, low, close, volume)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accepted spellings of bar columns.
ALIASES = {"adj close": "adj_close", "adjclose": "adj_close", "datetime": "date", "timestamp": "date", "vol": "volume"}
REQUIRED = ("date", "open", "high", "low", "close", "volume")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(df: DataFrame, series, when, value: str, key: str) -> DataFrame:
    return df.groupBy(series.alias("series"), when.alias("date")).agg(
        F.min_by(value, key).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, key).alias("close"), F.count("*").alias("volume")
    )


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices as bars of a day; the first and last order by key open and close it."""
    return _bars(table(spark, sf_dir, "orders"), F.lit("ORD"), F.to_date("o_orderdate"), "o_totalprice", "o_orderkey")


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as bars of an hour, one series for each event type."""
    return _bars(table(spark, sf_dir, "events"), F.col("event_type"), F.date_trunc("hour", "ts"), "value", "event_id")


def lineitem_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regime driver: mean quantity shipped a day."""
    return table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.avg("l_quantity").alias("close"))


def canonical(df: DataFrame) -> DataFrame:
    """Bars from a table with other spellings of the columns: names in lower case with underscores, dates at midnight,
    adj_close from close where it is missing. Missing columns are an error."""
    names = {c: ALIASES.get(c.strip().lower().replace("_", " "), c.strip().lower().replace(" ", "_")) for c in df.columns}
    named = df.withColumnsRenamed(names)
    if missing := [c for c in REQUIRED if c not in named.columns]:
        raise ValueError(f"bars lack {missing}; they have {named.columns}")
    if "adj_close" not in named.columns:
        named = named.withColumn("adj_close", F.col("close"))
    kept = [c for c in ("series",) if c in named.columns]
    numbers = [F.expr(f"try_cast({c} AS DOUBLE)").alias(c) for c in ("open", "high", "low", "close", "adj_close", "volume")]
    return named.select(*kept, F.to_date("date").alias("date"), *numbers)


def file_name(ticker: str) -> str:
    """File of a ticker: its letters and digits. A ticker without any is an error."""
    stem = re.sub(r"[\W_]+", "", ticker)
    if not stem:
        raise ValueError(f"no letter or digit in {ticker!r}")
    return f"{stem}.csv"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars from CSV files with a header; series is the file's name."""
    schema = "date STRING, open STRING, high STRING, low STRING, close STRING, adj_close STRING, volume STRING"
    raw = spark.read.schema(schema).csv(path, header=True).withColumn("series", F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+)\.csv$", 1))
    return canonical(raw)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, n_rows, first_date, last_date) of the CSV files in a folder."""
    name = F.element_at(F.split(F.regexp_replace("path", r"/+$", ""), "/"), -1)
    hashes = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select(name.alias("file"), F.sha2("content", 256).alias("sha256"))
    rows = spark.read.option("pathGlobFilter", "*.csv").schema("date STRING").csv(path, header=True, enforceSchema=True).select(F.col("_metadata.file_name").alias("file"), F.to_date("date").alias("d"))
    facts = rows.groupBy("file").agg(F.count("*").alias("n_rows"), F.min("d").alias("first_date"), F.max("d").alias("last_date"))
    return hashes.join(facts, "file", "left").select("file", "sha256", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "first_date", "last_date")


def verify(found: DataFrame, recorded: DataFrame) -> DataFrame:
    """(file, ok) over files in either manifest; a file that only one has is not ok."""
    both = found.select("file", F.col("sha256").alias("a")).join(recorded.select("file", F.col("sha256").alias("b")), "file", "full_outer")
    return both.select("file", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("ok"))


def read_verified(spark: SparkSession, path: str, recorded: DataFrame) -> DataFrame:
    """read_csv of a folder whose files are all as recorded; else an error and no rows."""
    bad = [r["file"] for r in verify(manifest(spark, path), recorded).where(~F.col("ok")).limit(20).collect()]
    if bad:
        raise ValueError(f"files differ from the manifest: {sorted(bad)}")
    return read_csv(spark, path)


def write_table(df: DataFrame, path: str, replace: bool = False, by: tuple[str, ...] = ()) -> None:
    """Write Parquet; what exists is kept unless replace is set, which replaces only the partitions that df has."""
    writer = df.write.mode("overwrite" if replace else "errorifexists").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*by) if by else writer).parquet(path)
