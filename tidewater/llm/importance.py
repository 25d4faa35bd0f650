"""Importance resampling towards a target distribution of hashed n-grams.

Words of a slice of texts become ids, and the array of all positions is sorted by
the ids that follow (a suffix array, deep enough for the longest n-gram). Between
neighbours the common prefix tells where an n-gram repeats: each run of positions
with a common prefix of n ids is one n-gram, which is hashed once, from the hashes of its
words; its bucket is scattered back to all its positions. Buckets are counted over all documents and over the target,
each document is weighed by the gains of its buckets, and the highest weights with a
Gumbel term are drawn, which is sampling without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import materialize, read_table
from tidewater.llm.words import Words, slices, words_of

# Buckets, the longest n-gram, the least words of a document that may be drawn, the share drawn in percent, the seed.
BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Drawn rows, about, that are put in order by one task.
RANGE_ROWS = 1_000_000
LEAST_RANGES = 8


def _ids(w: Words) -> tuple[np.ndarray, list[bytes]]:
    """A number for each different word of a slice, and the words by number; words of a slice are told apart by a 64-bit hash."""
    _, at, ids = np.unique(w.hashes, return_index=True, return_inverse=True)
    raw = w.blob.tobytes()
    return ids.astype(np.int64), [raw[a:b] for a, b in zip(w.starts[at].tolist(), w.ends[at].tolist())]


@lru_cache(maxsize=None)
def _zeros_behind(bit: int) -> tuple[int, ...]:
    """What crc32 makes of each bit of a checksum, without the final turn, when 2^bit zero bytes follow."""
    if bit == 0:
        out = []
        for i in range(32):
            c = 1 << i
            for _ in range(8):
                c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
            out.append(c)
        return tuple(out)
    half = _zeros_behind(bit - 1)
    return tuple(_sum(half, c) for c in half)


def _sum(columns: tuple[int, ...], c: int) -> int:
    out = 0
    for i in range(32):
        if c >> i & 1:
            out ^= columns[i]
    return out


@lru_cache(maxsize=256)
def _shift(length: int) -> np.ndarray:
    """(4, 256): what each byte of a checksum becomes when `length` bytes follow."""
    columns = tuple(1 << i for i in range(32))
    for bit in range(length.bit_length()):
        if length >> bit & 1:
            columns = tuple(_sum(_zeros_behind(bit), c) for c in columns)
    out = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for i in range(8):
            out[k] ^= np.where(np.arange(256) >> i & 1, np.uint32(columns[8 * k + i]), np.uint32(0))
    return out


def crc_joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of texts put together, from the crc32 of both parts and the bytes of the second: the checksum is linear."""
    out = second.copy()
    for n in np.unique(length).tolist():
        at = np.flatnonzero(length == n)
        table, c = _shift(n), first[at]
        out[at] ^= table[0][c & 255] ^ table[1][c >> 8 & 255] ^ table[2][c >> 16 & 255] ^ table[3][c >> 24]
    return out


def suffix_array(ids: np.ndarray, text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by the next `depth` ids in their text, and the common prefix of each with the one before, up to depth.

    text: the number of each position's text. Behind the end of a text stands a number below all ids.
    """
    n = len(ids)
    following = np.full((depth, n), -1, np.int64)
    for k in range(min(depth, n)):
        following[k, : n - k] = np.where(text[k:] == text[: n - k], ids[k:], -1)
    # one key at a time: the rank by the first k ids, then by the next
    width = int(ids.max(initial=0)) + 2
    rank = following[0]
    for k in range(1, depth):
        rank = np.unique(rank * width + following[k] + 1, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    common = np.zeros(n, np.int64)
    alike = np.ones(max(0, n - 1), bool)
    for k in range(depth):
        own = following[k][order]
        alike &= (own[1:] == own[:-1]) & (own[1:] >= 0)
        common[1:] += alike
    return order, common


def buckets_of(texts: list[bytes], depth: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, words): the text's number and the bucket of every n-gram of 1 to depth words, and the words of each text."""
    w = words_of(texts)
    per_text = np.diff(w.first)
    text = np.repeat(np.arange(len(texts)), per_text)
    ids, known = _ids(w)
    alone = np.array([zlib.crc32(x) for x in known], np.uint32)
    behind = np.array([zlib.crc32(b" " + x) for x in known], np.uint32)
    length = np.array([len(x) + 1 for x in known], np.int64)
    order, common = suffix_array(ids, text, depth)
    last = w.first[1:][text]  # one past the end of each position's text
    owners, found = [], []
    for n in range(1, depth + 1):
        at = np.flatnonzero(order + n <= last[order])  # positions with n words left
        if not len(at):
            continue
        opens = common[at] < n  # the first of each run; what is skipped has no n words, so it is in no run
        places = order[at]
        heads = places[opens]
        crc = alone[ids[heads]]
        for k in range(1, n):
            word = ids[heads + k]
            crc = crc_joined(crc, behind[word], length[word])
        owners.append(text[places])
        found.append((crc.astype(np.int64) % buckets)[np.cumsum(opens) - 1])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *owners]), np.concatenate([empty, *found]), per_text


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, texts in slices(batch):
            total += np.bincount(buckets_of(texts)[1], minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features in each bucket over all rows of texts (text); BUCKETS numbers come to the driver, whatever the rows."""
    rows = texts.select("text").mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the target's share over the source's), both smoothed by one for each bucket, in doubles."""
    size, goal = int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (size + BUCKETS) / ((s + 1) * (goal + BUCKETS)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def _weigh(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in slices(batch):
                owner, bucket, words = buckets_of(texts)
                weight = np.zeros(len(texts), np.int64)
                np.add.at(weight, owner, gain[bucket])
                features = np.bincount(owner, minlength=len(texts)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(words.astype(np.int64)), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row; gain: BUCKETS numbers."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_weigh(gain), "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 times a Gumbel number) that depends on seed and doc_id only; a null doc_id counts as empty."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """scored (doc_id, n_words, score, ...), written before, with `rank`: 1, 2, ... by falling score, then doc_id (null first), for the
    percent of the rows with least_words words or more that come first, null for all others. Rows equal in both have
    ranks in the order of n_words and weight.

    The highest scores are cut into ranges at estimated quantiles and the rows of each range are counted, so its first
    rank is known; only ranges that hold drawn rows are sorted. A range has about range_rows rows.
    """
    eligible = F.col("n_words") >= least_words
    n = scored.where(eligible).count()
    drawn = percent * n // 100
    if not drawn:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    m = max(LEAST_RANGES, -(-drawn // range_rows))
    at = [1 - percent / 100 * (i + 1) / m for i in range(m)]
    cuts = scored.where(eligible).agg(F.percentile_approx("score", at, max(10_000, 100 * m * 100 // percent))).first()[0]
    cuts = sorted(set(cuts), reverse=True)
    # range i has the scores from cuts[i] to below cuts[i - 1]; the last one all below
    number = F.lit(len(cuts)) - F.size(F.filter(F.lit(cuts), lambda c: F.col("score") >= c)) if m <= 64 else _range_number(cuts)
    ranged = scored.withColumn("range", F.when(eligible, number))
    counts = {r["range"]: r["n"] for r in ranged.where(eligible).groupBy("range").agg(F.count("*").alias("n")).collect()}
    before, firsts = 0, {}
    for i in range(len(cuts) + 1):
        if before < drawn and counts.get(i):
            firsts[i] = before
        before += counts.get(i, 0)
    inside = F.coalesce(F.col("range") <= max(firsts), F.lit(False))
    offset = F.try_element_at(F.map_from_arrays(F.lit(list(firsts)).cast("array<int>"), F.lit(list(firsts.values())).cast("array<long>")), F.col("range"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(F.desc("score"), "doc_id", "n_words", "weight")) + offset
    top = ranged.where(inside).withColumn("rank", own.cast("long")).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = ranged.where(~inside).withColumn("rank", F.lit(None).cast("long"))
    return top.unionByName(rest).drop("range")


def _range_number(cuts: list[int]) -> Column:
    """How many cuts are above the score, by halving: cuts are sorted downwards."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col("score") >= F.lit(cuts[mid]), tree(low, mid)).otherwise(tree(mid + 1, high))

    return tree(0, len(cuts))


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs; target has a column text.

    Null texts have no words, no features and weight 0; such rows and rows of under 20 words are never drawn. Rows that agree in
    doc_id and text have ranks of their own. Null doc_ids are kept. Without target every gain is that of an empty one.
    Columns other than doc_id and text play no part; an empty table gives no rows.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    weighed = weigh(docs, gain)
    scored = materialize(weighed.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + gumbel(F.col("doc_id"))).alias("score")), "importance-scores")
    return draw(scored).select("doc_id", "n_features", "weight", "score", "rank")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the benchmark's n-grams."""
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
