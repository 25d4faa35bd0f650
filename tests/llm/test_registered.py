"""The registered queries and pipeline stages themselves: columns and types of the contracts, SQL, and edge tables."""

from __future__ import annotations

import os
import zlib
from collections import defaultdict

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F
from test_contracts import CLASH, ITEM, TEXTS

from tidewater.llm import queries as registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "op1_linededup": "doc_id bigint",
    "op2_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op3_decontam": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op4_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op5_licenses": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op6_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op7_lm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op8_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op9_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op11_jaccard": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op12_importance": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
    "op13_filters": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
    "op10_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
}
NOT_BY_DOCUMENT = ("op4_topk", "op8_packing", "op13_filters")
VECTORS = [(0, [0.5, -0.25]), (1, [1.0, 1.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (50, [0.1, 0.2]), (51, [0.1, 0.2]), (100, [float("inf"), 0.0])]


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    """A folder with the edge rows of test_contracts, with columns of clashing names."""
    path = str(tmp_path_factory.mktemp("edges"))
    rows = [(i, t, ["en", "de", None][n % 3], "src0", None if t is None else len(t)) for n, (i, t) in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in CLASH})
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([("a", ITEM), ("b", None), ("c", "..."), (None, "the cat")], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def nothing(spark, edges, tmp_path_factory):
    """The same tables without rows."""
    path = str(tmp_path_factory.mktemp("nothing"))
    for name in ("documents", "benchmark", "embeddings", "labels"):
        spark.read.parquet(f"{edges}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    out = registry.queries()[name](spark, SF)
    types = {f.name: f.dataType.simpleString() for f in out.schema.fields}
    assert all(types.get(c.split()[0]) == c.split()[1] for c in COLUMNS[name].split(", "))
    rows = out.collect()
    if name not in NOT_BY_DOCUMENT:
        assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    scores = [r["score"] for r in rows if name in ("op2_langid", "op5_licenses")]
    assert all(0 <= x <= 1 for x in scores)


@pytest.mark.parametrize("name", COLUMNS)
def test_edge_tables(spark, edges, nothing, name):
    out = registry.queries()[name](spark, edges).collect()
    if name not in NOT_BY_DOCUMENT:
        assert len(out) == len(TEXTS)
    elif name == "op4_topk":
        assert {(r["query_id"], r["rank"], r["vec_id"]) for r in out} == {(0, 1, 1), (0, 2, 50), (0, 3, 51), (50, 1, 1), (50, 2, 51), (50, 3, 0)}
    assert registry.queries()[name](spark, nothing).count() == 0


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    got = registry.queries()[name](spark, SF)
    want = con.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.toPandas()[list(want.columns)].astype(str).values)) == sorted(map(tuple, want.astype(str).values))


def test_shards_are_near_equal_and_hold_equal_texts_together(spark):
    rows = registry.queries()["op10_sharding"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    slots, sizes, shards = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in rows:
        text = texts[r["doc_id"]]
        raw = (text or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        shards[text].add(r["shard"])
    assert set(slots) <= set(range(16)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    largest, mean = max(len((t or "").encode()) + 1 for t in texts.values()), sum(sizes.values()) / 16
    assert max(sizes.values()) <= mean + 2 * largest


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_edge_tables(spark, edges, nothing, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    docs = spark.read.parquet(f"{edges}/documents.parquet")
    out = run(spark, docs, edges)
    rows = out.collect()
    if stage != "packing":
        assert out.columns == docs.columns and {f.dataType for f in out.schema.fields} == {f.dataType for f in docs.schema.fields}
        kept = {r["doc_id"] for r in rows}
        assert kept <= {i for i, _ in TEXTS} and {1, 2, 13} <= kept
        assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None)
    assert run(spark, docs.limit(0), nothing).count() == 0


def test_pipeline_has_every_document_that_no_stage_drops(spark):
    got = {r["doc_id"] for r in registry.queries()["pipeline"](spark, SF).select("doc_id").distinct().collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, SF)
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert after <= before, name
    assert got == after
