"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources.store import shared_folder


#: Paths that open scratch blocks have written, the innermost block last.
_SCRATCH: list[list[str]] = []


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block of steps whose materialized tables are deleted when it ends, but for those given to what it yields.

    Only tables that no later plan reads may be left in it; what the block returns is built on kept ones.
    """
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.written_at)
        return df

    _SCRATCH.append([])
    try:
        yield keep
    finally:
        paths = _SCRATCH.pop()
        if _SCRATCH:
            _SCRATCH[-1].extend(p for p in paths if p in kept)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in (p for p in paths if p not in kept):
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


#: Rows of two numbers (keys of texts, crowded buckets) up to which they are broadcast.
BROADCAST_ROWS = 500_000


def met_by(keys: DataFrame) -> DataFrame:
    """Written keys, marked for a broadcast if they are few, so that the texts they are joined to stay where they are; else for a hash join of shuffled sides."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys.hint("shuffle_hash")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def apart(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, text): all columns but text as one struct, so that an operator's own columns meet none of them."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return docs.select(others.alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def together(columns: list[str], text: Column) -> list[Column]:
    """Undo apart: the columns in their order, text as given."""
    return [text.alias("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in columns]


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of doc_id as text; null counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
