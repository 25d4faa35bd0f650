"""Sharding by sampled splitters, with DataFrame operations only.

A size-weighted sample of keys is drawn, its quantiles cut the key space into
many small ranges, rows are counted exactly per range, and consecutive ranges
are put together into shards of near equal bytes. A key that alone would fill
a range is subdivided by a second key, so that no range grows with a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import materialize, read_table

#: Ranges cut for each shard, and sampled keys for each range; both bound what the driver sees.
RANGES_PER_SHARD = 128
SAMPLES_PER_RANGE = 16
#: Parts in which rows that are equal in text and doc_id can be dealt out.
ROW_PARTS = 1024
#: Bits of the key by which a row finds the few splitters near it.
CELL_BITS = 13


def _sample(keys: DataFrame, size: int, seed: int) -> list[tuple[int, int, float]]:
    """About `size` keys (k, s), drawn with chances in proportion to w, with the weight each stands for."""
    total = keys.agg(F.sum("w").alias("t")).first()["t"]
    if not total:
        return []
    step = total / size
    u = (F.xxhash64("k", "s", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    # rows of weight above the step are always drawn; such rows are at most `size`
    drawn = keys.where(u * step < F.col("w")).select("k", "s", F.greatest("w", F.lit(step)).alias("w"))
    pooled = drawn.groupBy("k", "s").agg(F.sum("w").alias("w"))
    return sorted((r["k"], r["s"], r["w"]) for r in pooled.collect())


def _splitters(sample: list[tuple[int, int, float]], n: int) -> list[tuple[int, int]]:
    """Quantile boundaries: keys (k, s), increasing, that cut the sample into n ranges of near equal weight."""
    total, cuts, seen, at = sum(w for _, _, w in sample), [], 0.0, 1
    for k, s, w in sample:
        if at < n and seen >= at * total / n:
            cuts.append((k, s))
            at = int(seen * n / total) + 1
        seen += w
    return cuts


def ranges_of(keys: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    """keys with column `range`: how many splitters are not above the row's (k, s).

    Rows look their key's leading bits up in a table of 2**CELL_BITS cells, which is broadcast and holds
    the splitters of each cell; all splitters together are bounded by the sampling parameters.
    """
    spark, shift, cells = keys.sparkSession, 64 - CELL_BITS, 1 << CELL_BITS
    inside: dict[int, list[tuple[int, int]]] = {}
    for k, s in splitters:
        inside.setdefault((k >> shift) + cells // 2, []).append((k, s))
    rows, before = [], 0
    for c in range(cells):
        own = inside.get(c, [])
        rows.append((c, before, own))
        before += len(own)
    table = spark.createDataFrame(rows, "cell int, before int, cuts array<struct<k: long, s: long>>")
    cell = (F.shiftright("k", shift) + cells // 2).cast("int")
    below = F.size(F.filter("cuts", lambda x: (x["k"] < F.col("k")) | ((x["k"] == F.col("k")) & (x["s"] <= F.col("s")))))
    placed = keys.withColumn("cell", cell).join(F.broadcast(table), "cell")
    return placed.withColumn("range", F.col("before") + below).drop("cell", "before", "cuts")


def shard_by_splitters(docs: DataFrame, shards: int = 16, seed: int = 11, per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """Every row of docs in one of `shards` shards of near equal bytes.

    Returns (doc_id, size, text_crc32, shard, slot, range). size is the text's UTF-8 bytes plus 1 (null text: 1),
    slots count from 0 in each shard without gaps. Equal texts have one key and stay together unless they fill
    more than a range, 1/per_shard of a shard; then they are subdivided by doc_id and by their places in the
    table. Null texts are equal to each other.
    Null or repeated doc_ids are rows like others; an empty table gives no rows. Columns of docs other than
    doc_id and text play no part.
    """
    text = F.col("text")
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("k"),
        # a part of the row's place, too, so that rows equal in text and doc_id can be dealt out
        F.xxhash64("doc_id", F.pmod(F.monotonically_increasing_id(), F.lit(ROW_PARTS))).alias("id_key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = materialize(narrow, "shard-rows")
    stats = rows.agg(F.count("*").alias("n"), F.sum("size").alias("b")).first()
    n, total = stats["n"], stats["b"] or 0
    mean = total / max(1, n)
    # weights hold both bytes and rows, so that no range is overfull of either
    weight = F.col("size") / mean + 1.0 if n else F.lit(1.0)
    wanted = shards * per_shard
    weighed = rows.withColumn("w", weight)
    sample = _sample(weighed.select("k", F.col("id_key").alias("s"), "w"), wanted * SAMPLES_PER_RANGE, seed)
    by_key: dict[int, float] = {}
    for k, _, w in sample:
        by_key[k] = by_key.get(k, 0.0) + w
    mass = sum(by_key.values())
    # a key of more than half a range is subdivided by doc_id; there are at most 2 * wanted of them
    hot = sorted(k for k, w in by_key.items() if w > 0.5 * mass / wanted and w > 2.0)
    is_hot = F.col("k").isin(hot) if hot else F.lit(False)
    keyed = rows.withColumn("s", F.when(is_hot, F.col("id_key")).otherwise(F.lit(-(1 << 63))))
    held = set(hot)
    folded: dict[tuple[int, int], float] = {}
    for k, s, w in sample:
        at = (k, s if k in held else -(1 << 63))
        folded[at] = folded.get(at, 0.0) + w
    placed = ranges_of(keyed, _splitters(sorted((k, s, w) for (k, s), w in folded.items()), wanted))
    # exact counts for each range: at most `wanted` rows
    counts = sorted((r["range"], r["rows"], r["bytes"]) for r in placed.groupBy("range").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).collect())
    plan, seen, taken = [], 0, [0] * shards
    for r, count, size in counts:
        shard = min(shards - 1, int((seen + size / 2) * shards / max(1, total)))
        plan.append((r, shard, taken[shard]))
        taken[shard] += count
        seen += size
    table = docs.sparkSession.createDataFrame(plan, "range int, shard int, first long")
    w = Window.partitionBy("range").orderBy("k", "s", "doc_id", "text_crc32")
    numbered = placed.withColumn("at", F.row_number().over(w))
    return numbered.join(F.broadcast(table), "range").select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("at") - 1).alias("slot"), "range")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law `bytes`; groups of equal texts."""
    out = shard_by_splitters(read_table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
