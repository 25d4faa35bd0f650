"""Queries of the corpus operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import decontam, filteraudit, importance, jaccardjoin, langid, licenses, linededup, lm, packing, secrets, sharding, simhash, topk


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_linededup": linededup.op1_linededup,
        "op2_langid": langid.op2_langid,
        "op3_decontam": decontam.op3_decontam,
        "op4_topk": topk.op4_topk,
        "op5_licenses": licenses.op5_licenses,
        "op6_simhash": simhash.op6_simhash,
        "op7_lm": lm.op7_lm,
        "op8_packing": packing.op8_packing,
        "op9_secrets": secrets.op9_secrets,
        "op10_sharding": sharding.op10_sharding,
        "op11_jaccard": jaccardjoin.op11_jaccard,
        "op12_importance": importance.op12_importance,
        "op13_filters": filteraudit.op13_filters,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_decontam": decontam.OP3_SQL, "op4_topk": topk.OP4_SQL, "op13_filters": filteraudit.OP13_SQL}
