"""Runs of a study on disk: saved in an order that makes a run visible only when it is whole, found by a pattern, and merged.

A run is a folder: its tables, then its settings, then a manifest with the rows of each table. What has no manifest is no
run. Nothing but names and settings, a line for each run, comes to the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.config import Study

#: Formats that tables of a run are written in, by the file name's end that other tools expect.
FORMATS = ("parquet", "csv")
_LABEL = r"/([^/]+)/manifest/[^/]*$"


def _text(spark: SparkSession, path: str, line: str) -> None:
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(path)


def save_run(folder: str, label: str, study: Study, tables: dict[str, DataFrame], partition_by: tuple[str, ...] = (), fmt: str = "parquet") -> None:
    """Write tables, then settings, then the manifest of a run. A run that is there already is not written over."""
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt}: one of {', '.join(FORMATS)}")
    if not tables:
        raise ValueError("a run has one table at least")
    spark = next(iter(tables.values())).sparkSession
    if label in {r["run"] for r in find_runs(spark, folder).select("run").collect()}:
        raise ValueError(f"run {label} is there already")
    rows = {}
    for name, table in tables.items():
        path = f"{folder}/{label}/{name}"
        writer = table.write.mode("overwrite").option("header", "true")  # parts of a run that was cut off go
        (writer.partitionBy(*partition_by) if partition_by else writer).format(fmt).save(path)
        rows[name] = spark.read.schema(table.schema).option("header", "true").format(fmt).load(path).count()
    _text(spark, f"{folder}/{label}/config", study.to_json())
    schemas = {name: json.loads(table.schema.json()) for name, table in tables.items()}
    _text(spark, f"{folder}/{label}/manifest", json.dumps({"format": fmt, "rows": rows, "schemas": schemas}, sort_keys=True))


def _glob(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def find_runs(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(run, manifest, config) of every whole run whose name matches pattern; run is the name of its folder."""
    at = f"{folder}/{pattern}"
    if not _glob(spark, f"{at}/manifest/_SUCCESS"):
        return spark.createDataFrame([], "run string, manifest string, config string")
    label = lambda kind: F.regexp_extract("_metadata.file_path", _LABEL.replace("manifest", kind), 1).alias("run")
    manifests = spark.read.text(f"{at}/manifest").select(label("manifest"), F.col("value").alias("manifest"))
    configs = spark.read.text(f"{at}/config").select(label("config"), F.col("value").alias("config"))
    return manifests.join(configs, "run")


def load_run(spark: SparkSession, folder: str, label: str, table: str) -> DataFrame:
    """One table of a run with a column `run`; refused if the run is not whole or the table has not the rows that its manifest says."""
    found = find_runs(spark, folder, label).first()
    if found is None:
        raise ValueError(f"no whole run {label}")
    manifest = json.loads(found["manifest"])
    if table not in manifest["rows"]:
        raise ValueError(f"run {label} has no table {table}")
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(manifest["schemas"][table])
    out = spark.read.schema(schema).option("header", "true").format(manifest["format"]).load(f"{folder}/{label}/{table}")
    if (n := out.count()) != manifest["rows"][table]:
        raise ValueError(f"run {label}: {table} has {n} rows, its manifest says {manifest['rows'][table]}")
    return out.select(F.lit(label).alias("run"), *schema.names)


def merge_runs(spark: SparkSession, folder: str, table: str = "forecasts", pattern: str = "*", ignore: tuple[str, ...] = (), keys: tuple[str, ...] = ("series", "date", "model")) -> DataFrame:
    """The tables of all whole runs that match, one below the other, with a column `run`.

    Runs whose settings differ in more than those ignored are refused, and so are keys that two runs have. Every table has the columns of the first;
    what a run lacks is null.
    """
    from tidewater.operators.guards import refuse_repeats

    runs = find_runs(spark, folder, pattern).orderBy("run").collect()
    if not runs:
        raise ValueError(f"no whole run matches {pattern}")
    first = Study.from_json(runs[0]["config"])
    out = None
    for r in runs:
        if found := first.differences(Study.from_json(r["config"]), ignore):
            raise ValueError(f"runs {runs[0]['run']} and {r['run']} differ in {found}")
        own = load_run(spark, folder, r["run"], table)
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return refuse_repeats(out, keys)


def dates_of_all_runs(merged: DataFrame, needed: tuple[str, ...] = ("variance",)) -> DataFrame:
    """(series, date) that every run has with all needed columns, however many runs there are; one shuffle."""
    runs = merged.select("run").distinct().agg(F.count("*").alias("runs"))
    met = merged.dropna(subset=list(needed)).groupBy("series", "date").agg(F.count_distinct("run").alias("n"))
    return met.join(F.broadcast(runs), F.col("n") == F.col("runs")).select("series", "date")  # one row of one number
