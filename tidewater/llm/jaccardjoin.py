"""Similarity join on word shingles by grouped prefixes.

Two sets with Jaccard similarity t or more share a shingle among the first
n - ceil(t n) + 1 of each in any one order of all shingles; here rarer ones come first, so
few sets meet. Documents with the same prefix and size form one group; groups
that share a prefix shingle are filtered by size and by the places of that
shingle, then expanded to members and verified on their whole sets.

Links are needed as classes only, so the pairs of a crowd of copies are never all
made: first every group is held against one pivot for each of its shingles. Where that leaves several
classes at a shingle, its members are compared in place by their signatures: first each one's
nearest in other classes, then all that are still apart. A signature has a bit for the parity of the
shingles that fall on it, so two differ in no more bits than the sets in shingles, and what it rejects is no
link. What it lets pass is verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import materialize, met_by, read_table, scratch
from tidewater.llm.components import connected_components
from tidewater.llm.words import SOLID, slices, words_of

SHINGLE, PERCENT = 5, 80
#: Counters that shingles are spread over for their order, in blocks of so many; a fixed number, whatever the input.
COUNTERS, BLOCK = 1 << 20, 1 << 12
#: Rows that share a shingle from which it counts as hot: its groups meet its pivot by a broadcast of such shingles.
HOT_ROWS = 50_000
#: Prefix rows for each counter of the first, coarse count of shingles.
CELL_ROWS = 4096
#: Links of one set that are verified by one task; rows of a shingle that are compared in place by one.
LINKS_A_TASK, SPLIT_ROWS = 10_000, 4096
#: Members of a shingle up to which its pairs are made as they are.
FEW_MEMBERS = 16
#: Of each member's candidates in other classes, so many of the nearest are verified before all are.
NEAREST = 4
#: Bits of a signature for each shingle of a set, at least; a power of two in all, so that longer ones can be folded.
SIGNATURE_BITS, LEAST_BITS = 4, 64

_FACTORS = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(64)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles_of(texts: list[bytes], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every different shingle of every text, by text and hash.

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer words than a shingle is one shingle, which
    equals none of full length; one without words has none.
    """
    w = words_of(texts, SOLID)
    per_text = np.diff(w.first)
    n = np.where(per_text >= shingle, per_text - shingle + 1, np.minimum(per_text, 1))
    text = np.repeat(np.arange(len(texts)), n)
    at = w.first[:-1][text] + np.arange(len(text)) - (np.cumsum(n) - n)[text]
    left = np.minimum(per_text, shingle)[text]
    h = left.astype(np.uint64)
    for k in range(shingle):
        inside = k < left
        h[inside] += _mixed(w.hashes[at[inside] + k]) * _FACTORS[k]
    h = _mixed(h)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    return text[fresh], h[fresh]


# ---- the order of shingles


def _counted(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, texts in slices(batch):
                h = shingles_of(texts, shingle)[1]
                total += np.bincount((h % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        if total.any():
            blocks = total.reshape(-1, BLOCK)
            kind = np.uint16 if total.max() < 1 << 16 else np.int64
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array([b.astype(kind).tobytes() for b in blocks], pa.binary())], names=["block", "counts"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, raw in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
            total.setdefault(block, np.zeros(BLOCK, np.int64))
            total[block] += np.frombuffer(raw, np.uint16 if len(raw) == 2 * BLOCK else np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "counts"])


def levels(docs: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """How frequent the shingles of each counter are, as a power of two above what an even spread gives: COUNTERS bytes.

    All shingles of all documents are counted. Any fixed numbers give right results; these keep passages that many
    documents share behind the others. COUNTERS numbers come to the driver and go to the tasks, whatever the input.
    """
    parts = docs.select("text").mapInArrow(_counted(shingle), "block int, counts binary")
    tasks = min(COUNTERS // BLOCK, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = parts.repartition(tasks, "block").mapInArrow(_summed, "block int, counts binary").collect()
    total = np.zeros((COUNTERS // BLOCK, BLOCK), np.int64)
    for r in rows:
        total[r["block"]] = np.frombuffer(r["counts"], np.int64)
    total = total.ravel()
    over = np.maximum(total - total.sum() // COUNTERS, 1)
    return np.frexp(over.astype(np.float64))[1].astype(np.uint8)


# ---- prefixes and groups


def signatures_of(text: np.ndarray, h: np.ndarray, n: np.ndarray) -> list[bytes]:
    """For each text's set, of n shingles h, the parity of its shingles in each of a power of two of bits."""
    bits = 1 << np.ceil(np.log2(np.maximum(n * SIGNATURE_BITS, LEAST_BITS))).astype(np.int64)
    ends = np.cumsum(bits)
    at = (ends - bits)[text] + ((h >> np.uint64(20)) % bits[text].astype(np.uint64)).astype(np.int64)
    odd = np.packbits((np.bincount(at, minlength=int(ends[-1]) if len(ends) else 0) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [odd[a // 8 : b // 8] for a, b in zip((ends - bits).tolist(), ends.tolist())]


def folded(signature: np.ndarray, words: int) -> np.ndarray:
    """Signatures (rows of 64-bit words) as they would be with `words` words."""
    while signature.shape[-1] > words:
        half = signature.shape[-1] // 2
        signature = signature[..., :half] ^ signature[..., half:]
    return signature


def _prefixes(level: np.ndarray, shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in slices(batch):
                text, h = shingles_of(texts, shingle)
                n = np.bincount(text, minlength=len(texts))
                ends = np.cumsum(n)
                raw = h.tobytes()
                node = [int.from_bytes(xxhash.xxh64_digest(raw[8 * (e - k) : 8 * e], 7), "big", signed=True) for e, k in zip(ends.tolist(), n.tolist())]
                order = np.lexsort((h, level[(h % np.uint64(COUNTERS)).astype(np.int64)], text))
                length = np.where(n > 0, n - (n * percent + 99) // 100 + 1, 0)
                first = np.repeat(length, n)
                taken = np.arange(len(h)) - np.repeat(ends - n, n) < first
                prefix = h[order][taken].view(np.int64)
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                raw = prefix.tobytes()
                of = [int.from_bytes(xxhash.xxh64_digest(raw[8 * a : 8 * b], k), "big", signed=True) for a, b, k in zip(offsets[:-1].tolist(), offsets[1:].tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("k"), pa.array(n.astype(np.int64)), pa.array(node, pa.int64()), pa.array(of, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(prefix)), pa.array(signatures_of(text, h, n), pa.binary())],
                    names=["doc_id", "k", "n", "node", "of", "prefix", "signature"],
                )

    return run


def prefix_rows(docs: DataFrame, level: np.ndarray, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, k, n, node, of, prefix, signature): k hashes the text, n is the size of its set, node stands for the set, of for its prefix and size (the group)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("k"), "text")
    return rows.mapInArrow(_prefixes(level, shingle, percent), "doc_id long, k long, n long, node long, of long, prefix array<long>, signature binary")


def _fits(a: str, b: str, percent: int) -> Column:
    """Whether two groups that meet at a shingle, at places `at` of their orders, can hold a pair: sizes, and what may be common from there on."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    sizes = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    rest = F.least(n - F.col(f"{a}.at"), m - F.col(f"{b}.at"))
    return sizes & ((100 + percent) * rest >= percent * (n + m))


def hot_shingles(entries: DataFrame, hot_rows: int) -> DataFrame | None:
    """(shingle, pivot) of shingles with over hot_rows entries (of, n, shingle, at), by exact counts; None if there is none.

    Counters that many shingles share come first, so that little is shuffled; only shingles of full ones are counted one by one.
    """
    n = entries.count()
    if n <= hot_rows:
        return None
    cell = F.pmod(F.xxhash64("shingle"), F.lit(1 + n // CELL_ROWS)).alias("cell")
    full = materialize(entries.groupBy(cell).count().where(F.col("count") > hot_rows).select("cell"), "jaccard-cells")
    if full.isEmpty():
        return None
    exact = entries.select("*", cell).join(met_by(full), "cell", "left_semi").groupBy("shingle").agg(F.count("*").alias("rows"), F.min(F.struct("of", "n", "at")).alias("pivot"))
    hot = materialize(exact.where(F.col("rows") > hot_rows).select("shingle", "pivot"), "jaccard-hot")
    return None if hot.isEmpty() else hot


def pivoted(entries: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """entries (of, n, shingle, at) of shingles that several groups have, with `pivot`: the shingle's smallest group as struct<of, n, at>."""
    hot = hot_shingles(entries, hot_rows)
    rest = entries if hot is None else entries.join(met_by(hot.select("shingle")), "shingle", "left_anti")
    # size and place go through the shuffle of all prefixes as one number
    rest = rest.select("shingle", "of", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("at").cast("long")).alias("both"))
    by = Window.partitionBy("shingle")
    size, place = (lambda c: F.shiftright(c, 32).cast("int")), (lambda c: c.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    met = rest.select("*", F.min(F.struct("of", "both")).over(by).alias("least"), F.count("*").over(by).alias("rows")).where(F.col("rows") > 1)
    pivot = F.struct(F.col("least.of").alias("of"), size(F.col("least.both")).alias("n"), place(F.col("least.both")).alias("at"))
    out = met.select("of", size(F.col("both")).alias("n"), place(F.col("both")).alias("at"), "shingle", pivot.alias("pivot"))
    return out if hot is None else out.unionByName(entries.join(met_by(hot), "shingle").select(*out.columns))


# ---- verification


def _set_rows(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in slices(batch):
                text, h = shingles_of(texts, shingle)
                ends = np.cumsum(np.bincount(text, minlength=len(texts)))
                raw = h.tobytes()
                own = [raw[8 * a : 8 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
                yield pa.RecordBatch.from_arrays([piece.column("node"), pa.array(own, pa.binary())], names=["node", "own"])

    return run


def sets_of(docs: DataFrame, speakers: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """(node, own): the whole set of each node in pairs (a, b), as sorted hashes; speakers has one text's (node, doc_id, k) for each node.

    Rows of docs that agree in doc_id and text give equal rows.
    """
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    spoken = materialize(speakers.join(ends, "node", "left_semi").select("node", "doc_id", "k"), "jaccard-spoken")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("k", F.xxhash64("text"))
    same = texts["doc_id"].eqNullSafe(F.col("o.doc_id")) & texts["k"].eqNullSafe(F.col("o.k"))
    read = texts.join(met_by(spoken).alias("o"), same).select("node", "text").mapInArrow(_set_rows(shingle), "node long, own binary")
    return materialize(read, "jaccard-sets")


def _similar(first: bytes, second: bytes, percent: int) -> bool:
    x, y = np.frombuffer(first, np.uint64), np.frombuffer(second, np.uint64)
    small, large = (x, y) if len(x) < len(y) else (y, x)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum()) if len(large) else 0
    return 100 * both >= percent * (len(x) + len(y) - both)


def _may_be_similar(first: bytes, second: bytes, percent: int) -> bool:
    """The same of signatures, behind the sizes of their sets."""
    n, m = int.from_bytes(first[:8], "big"), int.from_bytes(second[:8], "big")
    x, y = np.frombuffer(first[8:], np.uint64), np.frombuffer(second[8:], np.uint64)
    words = min(len(x), len(y))
    odd = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())
    return (100 + percent) * odd <= (100 - percent) * (n + m)


def _held_against(test, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = None, b""
        for batch in batches:
            a, b = [], []
            for x, part, y, own in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b", "own"))):
                if y is None:
                    key, first = (x, part), own
                    continue
                if (x, part) != key:
                    raise ValueError(f"what {x} is held against is missing")
                if test(first, own, percent):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _oriented(pairs: DataFrame, links_a_task: int) -> DataFrame:
    """(a, b, part): the pairs, with the end that has more of them first, and the part of its pairs, of links_a_task about."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    many = materialize(ends.groupBy("node").agg(F.count("*").alias("links")), "jaccard-degrees")
    both = pairs.join(many.select(F.col("node").alias("a"), F.col("links").alias("of_a")), "a").join(many.select(F.col("node").alias("b"), F.col("links").alias("of_b")), "b")
    turned = F.struct("of_b", "b") > F.struct("of_a", "a")
    parts = F.ceil(F.greatest("of_a", "of_b") / links_a_task)
    put = both.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"), parts.alias("parts"))
    return materialize(put.select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part")), "jaccard-pairs")


def _held(put: DataFrame, values: DataFrame, test, percent: int) -> DataFrame:
    """The pairs (a, b, part) of put whose values (node, own) pass the test.

    The first end's value goes once to each part of its pairs, the other end's along with each pair. Parts are
    sorted, so a task holds one first value and one other at a time.
    """
    second = put.join(values.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "own")
    first = put.select("a", "part").distinct().join(values.withColumnRenamed("node", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "own")
    n = int(put.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = first.unionByName(second).repartition(n, "a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    return materialize(dealt.mapInArrow(_held_against(test, percent), "a long, b long").distinct(), "jaccard-links")


def verify(pairs: DataFrame, docs: DataFrame, speakers: DataFrame, shingle: int, percent: int, links_a_task: int = LINKS_A_TASK) -> DataFrame:
    """The pairs (a, b) of nodes, different and written, whose sets have the similarity; speakers as in sets_of."""
    return _held(_oriented(pairs, links_a_task), sets_of(docs, speakers, pairs, shingle), _similar, percent)


def signatures_for(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n, signature) of the nodes (node, distinct and written), one row for each, from the rows of prefix_rows."""
    found = rows.where(F.col("n") > 0).select("node", "n", "signature").join(met_by(nodes), "node", "left_semi")
    return materialize(found.groupBy("node").agg(F.first("n").alias("n"), F.first("signature").alias("signature")), "jaccard-signatures")


def screened(pairs: DataFrame, rows: DataFrame, percent: int, links_a_task: int = LINKS_A_TASK) -> DataFrame:
    """The pairs (a, b) that the signatures of their sets do not rule out; rows are those of prefix_rows."""
    ends = materialize(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "jaccard-ends")
    size = F.unhex(F.lpad(F.hex("n"), 16, "0"))
    return _held(_oriented(pairs, links_a_task), signatures_for(rows, ends).select("node", F.concat(size, "signature").alias("own")), _may_be_similar, percent)


# ---- comparing in place


def _bucket_pairs(b: pa.RecordBatch, percent: int, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one shingle (node, n, at, label, signature) in different classes that sizes, places and signatures let pass;
    with `most`, only those among the so many nearest of either."""
    n, at, label = (b.column(c).to_numpy().astype(np.int64) for c in ("n", "at", "label"))
    raw = b.column("signature").to_pylist()
    width = np.array([len(x) // 8 for x in raw])
    found = []
    for w in np.unique(width).tolist():
        near = np.flatnonzero((width == w) | (width == 2 * w))
        sig = np.stack([folded(np.frombuffer(raw[i], np.uint64), w) for i in near.tolist()])
        rows = np.flatnonzero(width[near] == w)
        step = max(1, (1 << 20) // len(near))
        for i in range(0, len(rows), step):
            x = near[rows[i : i + step]][:, None]
            y = near[None, :]
            ok = (label[x] != label[y]) & ((width[y] > w) | (x < y)) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
            ok &= (100 + percent) * np.minimum(n[x] - at[x], n[y] - at[y]) >= percent * (n[x] + n[y])
            p, q = np.nonzero(ok)
            p = rows[i + p]
            few = max(1, (1 << 20) // w)
            for j in range(0, len(p), few):
                u, v = p[j : j + few], q[j : j + few]
                odd = np.bitwise_count(sig[u] ^ sig[v]).sum(1, dtype=np.int64)
                u, v = near[u], near[v]
                pass_ = (100 + percent) * odd <= (100 - percent) * (n[u] + n[v])
                found.append(np.stack([u[pass_], v[pass_], odd[pass_]]))
            if most and sum(x.shape[1] for x in found) > (1 << 20):
                found = [_nearest(np.hstack(found), most)]
    out = np.hstack(found) if found else np.zeros((3, 0), np.int64)
    out = _nearest(out, most) if most else out
    return out[0], out[1]


def _nearest(pairs: np.ndarray, most: int) -> np.ndarray:
    """Of pairs (a, b, distance) those that are among the `most` nearest of either end."""
    keep = np.zeros(pairs.shape[1], bool)
    for end in pairs[:2]:
        order = np.lexsort((pairs[2], end))
        rank = np.arange(len(order)) - np.searchsorted(end[order], end[order])
        keep[order[rank < most]] = True
    return pairs[:, keep]


def _compared(percent: int, most: int | None):
    def pairs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        x, y = _bucket_pairs(b, percent, most)
        node = b.column("node").to_numpy()
        x, y = node[x], node[y]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            shingle, sub = batch.column("shingle").to_numpy(), batch.column("sub").to_numpy()
            cuts = np.flatnonzero((shingle[1:] != shingle[:-1]) | (sub[1:] != sub[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if held and key != (shingle[a], sub[a]):
                    yield pairs(held)
                    held = []
                held.append(batch.slice(a, b - a))
                key = (shingle[a], sub[a])
        if held:
            yield pairs(held)

    return run


def spans_of(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members (of, n, node) with their class, and (of, low, high, size) of each group's classes."""
    named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    spans = named.groupBy("of").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"))
    return named, materialize(spans, "jaccard-spans")


def undone(met: DataFrame, spans: DataFrame) -> DataFrame:
    """(shingle, size) of shingles whose members are in several classes; two members have been held against each other by their pivot."""
    at_shingle = met.join(spans, "of").groupBy("shingle").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("size").alias("size"))
    return materialize(at_shingle.where((F.col("low") != F.col("high")) & (F.col("size") > 2)).select("shingle", "size"), "jaccard-undone")


def few_pairs(met: DataFrame, named: DataFrame, spans: DataFrame, few: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of members in different classes whose groups share a shingle in few and pass sizes and places.

    A shingle in few has a bounded number of members, so its pairs of groups are made as they are; the pairs of all shingles are then told apart.
    """
    entry = "struct<of: bigint, n: bigint, at: int, low: bigint, high: bigint>"
    rows = met.join(met_by(few.select("shingle")), "shingle").join(spans, "of").select("shingle", F.struct("of", F.col("n").cast("long").alias("n"), "at", "low", "high").cast(entry).alias("x"))
    fits = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND {100 + percent} * least(x.n - x.at, y.n - y.at) >= {percent} * (x.n + y.n) AND NOT (x.low = y.high AND y.low = x.high)"
    pairs = f"flatten(transform(e, (x, i) -> transform(filter(slice(e, i + 1, size(e)), y -> {fits}), y -> named_struct('of_a', x.of, 'of_b', y.of))))"
    groups = rows.groupBy("shingle").agg(F.collect_list("x").alias("e")).selectExpr(f"inline({pairs})").distinct()
    side = lambda name: named.select(F.col("of").alias(f"of_{name}"), F.col("node").alias(name), F.col("label").alias(f"label_{name}"))
    both = groups.join(side("a"), "of_a").join(side("b"), "of_b").where((F.col("label_a") != F.col("label_b")) & ((F.col("of_a") != F.col("of_b")) | (F.col("a") < F.col("b"))))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def crowd_pairs(met: DataFrame, named: DataFrame, crowds: DataFrame, rows: DataFrame, percent: int, most: int | None = None, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(a, b): pairs of members in different classes that share a shingle in crowds and pass sizes, places and signatures; with `most`, each
    member's so many nearest at a shingle and the like.

    Members are compared in place, so only what passes is made. Those of a shingle with over split_rows are dealt into chunks, and
    each pair of chunks is compared by itself.
    """
    parts = crowds.select("shingle", F.ceil(F.col("size") / split_rows).cast("int").alias("parts"))
    left = materialize(met.join(met_by(parts), "shingle").select("shingle", "parts", "of", "at"), "jaccard-open")
    inside = materialize(left.select("of").distinct().join(named, "of").select("of", "node", "label"), "jaccard-inside")
    signed = inside.join(signatures_for(rows, inside.select("node")), "node")
    own = left.join(signed, "of").withColumn("mine", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    dealt = own.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    sub = F.least("mine", "other").cast("long") * F.col("parts") + F.greatest("mine", "other")
    dealt = dealt.select("shingle", sub.alias("sub"), "node", "n", "at", "label", "signature")
    k = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(k, "shingle", "sub").sortWithinPartitions("shingle", "sub").mapInArrow(_compared(percent, most), "a long, b long").distinct()


# ---- the join


def similar_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs; sets link if 100 * intersection >= percent * union.

    Null texts and texts without words have the empty set, link with nothing and are their own component. A text of under
    `shingle` words is one shingle as a whole. component_id is the smallest doc_id reached over links; null doc_ids are never it, unless there
    is no other. Rows that agree in doc_id and text stand in one component; an empty table gives no rows. Other columns play no part.
    """
    with scratch(docs.sparkSession) as keep:
        rows = keep(materialize(prefix_rows(docs, levels(docs, shingle), shingle, percent), "jaccard-rows"))
        full = rows.where(F.col("n") > 0)
        members = materialize(full.groupBy("node").agg(F.first("of").alias("of"), F.first("n").alias("n"), F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "k")).alias("one")), "jaccard-members")
        speakers = members.select("node", "one.doc_id", "one.k")
        members = members.drop("one")
        heads = members.groupBy("of").agg(F.min("node").alias("head"), F.count("*").alias("size"))
        groups = full.groupBy("of").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
        entries = materialize(groups, "jaccard-groups").select("of", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("at", "shingle"))
        met = materialize(pivoted(entries, hot_rows), "jaccard-met")

        # the smallest member speaks for its group
        speaks = materialize(heads, "jaccard-heads")
        head = lambda name: speaks.select(F.col("of").alias(f"of_{name}"), F.col("head").alias(name))
        spokes = met.alias("x").where((F.col("x.of") != F.col("x.pivot.of")) & _fits("x", "x.pivot", percent))
        spokes = spokes.select(F.col("x.pivot.of").alias("of_a"), F.col("x.of").alias("of_b")).distinct().join(head("a"), "of_a").join(head("b"), "of_b").select("a", "b")
        within = members.join(speaks.where(F.col("size") > 1), "of").where(F.col("node") != F.col("head")).select(F.col("head").alias("a"), F.col("node").alias("b"))
        tried = materialize(spokes.unionByName(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "jaccard-stars")
        links = verify(screened(tried, rows, percent), docs, speakers, shingle, percent)

        # what the pivots did not bring into one class: shingles with few members, then crowds, first the nearest of other classes, then all
        places = met.select("of", "n", "shingle", "at")
        crowded = None
        for step in ("few", "nearest", "all"):
            named, spans = spans_of(members, materialize(connected_components(links), "jaccard-classes"))
            open_ = undone(places if crowded is None else crowded, spans)
            if step == "few":
                found = few_pairs(places, named, spans, materialize(open_.where(F.col("size") <= FEW_MEMBERS), "jaccard-few"), percent)
                # what follows looks at crowds alone
                crowded = materialize(places.join(met_by(materialize(open_.where(F.col("size") > FEW_MEMBERS).select("shingle"), "jaccard-crowds")), "shingle", "left_semi"), "jaccard-crowded")
            else:
                found = crowd_pairs(crowded, named, open_, rows, percent, NEAREST if step == "nearest" else None)
            more = materialize(found.join(tried, ["a", "b"], "left_anti"), "jaccard-more")
            if not more.isEmpty():
                good = screened(more, rows, percent) if step == "few" else more
                links = links.unionByName(verify(good, docs, speakers, shingle, percent))
                tried = tried.unionByName(more)
            if crowded.isEmpty():
                break

        labels = materialize(connected_components(links), "jaccard-labels")
        known = members.select("node", "low").join(labels, "node", "left").select("node", "low", F.coalesce("label", "node").alias("label"))
        lowest = known.groupBy("label").agg(F.min("low").alias("component_id"))
        # written out, so that the last join deals both sides anew and can split a set that many rows share
        of_node = keep(materialize(known.join(lowest, "label").select("node", "component_id"), "jaccard-components"))
    linked = full.select("doc_id", "n", "node").join(of_node, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(rows.where(F.col("n") == 0).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of whole documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    return similar_components(read_table(spark, sf_dir, "documents"))
