"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import decontam, langid, linededup, packing, simhash
from tidewater.llm.common import materialize, read_table

#: Probability of the decoded language below which a text counts as in no language.
LEAST_SCORE = 0.5


def _has_words(text):
    return F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]"))


def _as_documents(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, n_chars as the text now has them."""
    return docs.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; null texts, texts without letters and those that fit no language go."""
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    told = langid.identify(docs, model)
    return told.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LEAST_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand elsewhere before; those of which nothing is left go."""
    freed = linededup.dedup_lines(docs)
    return _as_documents(freed.where((F.col("lines_removed") == 0) | _has_words(F.col("text"))), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; those of which nothing is left go."""
    freed = decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    return _as_documents(freed.where((F.col("words_removed") == 0) | _has_words(F.col("text"))), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language id", language),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: SQL can express none of: the language model, bounded-radius components, tokenizing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each reads what the one before wrote."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{i}")
    return docs
