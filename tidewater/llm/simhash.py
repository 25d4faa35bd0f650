"""SimHash near-duplicates by the generalised pigeonhole principle.

Bits are grouped into partitions, correlated ones together. If the radii t_i of
the partitions fulfil sum(t_i + 1) = radius + 1, two fingerprints within the radius
are within t_i in some partition i; radii are allotted by dynamic programming on
candidate counts that a sample predicts. Fingerprints meet in buckets of a
partition's value and of values with more bits set, and are then verified whole.
A bucket yields a spanning forest of its links, so groups of copies stay linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import common
from tidewater.llm.common import apart, materialize, met_by, read_table, scratch, together
from tidewater.llm.components import connected_components
from tidewater.llm.jaccardjoin import verify
from tidewater.llm.words import LOWER_TABLE, slices

#: Fingerprints, about, from which bit groups and candidate counts are estimated.
SAMPLE = 10_000
#: Relative costs of a bucket row and of a compared pair; rows of a bucket from which it is split.
ROW_COST, PAIR_COST, SPLIT_ROWS = 1.0, 0.002, 16_384
#: Plans are made for so many fingerprints at least, so that small inputs run by the plan of large ones.
PLAN_FOR = 1_000_000
#: Bucket rows for each counter of the first, coarse count of buckets.
CELL_ROWS = 4096
#: Values a fingerprint may take in one partition.
MAX_PROBES = 200
#: Where a link failed, so many of the nearest candidates in other classes are tried for each fingerprint of a bucket before all are.
REFILL = 4


# ---- fingerprints


def _spread(h: np.ndarray, n: int) -> np.ndarray:
    """The n-th further hash of each hash."""
    x = h + np.uint64((n * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def fingerprints_of(texts: list[bytes], shingle: int, words: int = 1) -> np.ndarray:
    """(texts, words) unsigned fingerprints: a bit is 1 if set in over half of the shingles' hashes.

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer words than a shingle is one shingle; without words it is 0.
    """
    digest, digests, count = xxhash.xxh64_digest, [], []
    for t in texts:
        w = t.translate(LOWER_TABLE).split()
        if len(w) < shingle:
            rows = [digest(b" ".join(w), 42)] if w else []
        else:
            rows = [digest(b" ".join(s), 42) for s in zip(*(w[i:] for i in range(shingle)))]
        digests.append(b"".join(rows))
        count.append(len(rows))
    n = np.array(count, np.int64)
    h = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64)
    out = np.zeros((len(texts), words), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        starts = (np.cumsum(n) - n)[full]
        for k in range(words):
            own = h if k == 0 else _spread(h, k)
            ones = _bit_counts(own, starts)
            out[full, k] = np.packbits(2 * ones > n[full][:, None], axis=1).view(">u8").ravel()
    return out


def _bit_counts(h: np.ndarray, starts: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    """How often each of 64 bits is set in each run of hashes that begins at starts."""
    ones = np.zeros((len(starts), 64), np.int64)
    for i in range(0, len(h), block):
        part = h[i : i + block]
        first = np.searchsorted(starts, i, "right") - 1
        last = np.searchsorted(starts, i + len(part), "left")
        at = np.maximum(starts[first:last] - i, 0)
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones[first:last] += np.add.reduceat(bits, at, axis=0, dtype=np.int32)
    return ones


def nodes_of(f: np.ndarray) -> np.ndarray:
    """What stands for fingerprints in links: one word itself, or a hash of several."""
    node = f[:, 0].copy()
    for i in range(1, f.shape[1]):
        node = _spread(node ^ f[:, i], i)
    return node.view(np.int64)


def _fingerprint(shingle: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in slices(batch):
                f = fingerprints_of(texts, shingle, words)
                own = piece.drop_columns("text")
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(nodes_of(f)), *(pa.array(f[:, i].view(np.int64)) for i in range(words))], names=[*own.schema.names, "node", *(f"f{i}" for i in range(words))])

    return run


def fingerprint(docs: DataFrame, shingle: int = 4, words: int = 1) -> DataFrame:
    """(doc_id, k, node, f0, f1, ...): k hashes the text; f0.. are fingerprints of 64 bits each, as signed longs; node stands for all of them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("k"), "text")
    return rows.mapInArrow(_fingerprint(shingle, words), "doc_id long, k long, node long, " + ", ".join(f"f{i} long" for i in range(words)))


# ---- partitions and radii


def bit_groups(sample: np.ndarray, m: int) -> list[np.ndarray]:
    """64 bits in m groups of near equal size, each grown around a bit by the strongest correlations with it."""
    bits = np.unpackbits(sample.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float64)
    centred = bits - bits.mean(0) if len(bits) else bits
    dev = np.sqrt((centred**2).sum(0) / max(1, len(bits))) + 1e-9
    corr = np.abs(centred.T @ centred / max(1, len(bits)) / np.outer(dev, dev))
    left, groups = list(range(64)), []
    for i in range(m):
        size = (64 * (i + 1)) // m - (64 * i) // m
        # around the bit with the strongest ties to those left
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            b = max(left, key=lambda b: (corr[b, group].mean(), -b))
            group.append(b)
            left.remove(b)
        groups.append(np.array(sorted(group)))
    return groups


def values_in(f: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The bits of one group as a number."""
    out = np.zeros(len(f), np.int64)
    for j, b in enumerate(bits.tolist()):
        out |= ((f >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << j
    return out


def raised(values: np.ndarray, width: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, value): each value with exactly `level` of its zero bits set. Two values at distance d meet where both
    are raised to their union, after d raises in all."""
    rows, out, low = np.arange(len(values)), values, np.full(len(values), -1)
    for _ in range(level):
        r, v, n = [], [], []
        for b in range(width):
            ok = (low < b) & ((out >> b) & 1 == 0)
            r.append(rows[ok])
            v.append(out[ok] | (1 << b))
            n.append(np.full(ok.sum(), b))
        rows, out, low = np.concatenate(r), np.concatenate(v), np.concatenate(n)
    return rows, out


def allot(sample: np.ndarray, n: int, radius: int) -> list[tuple[np.ndarray, int]]:
    """Groups of bits with their radii, of least predicted cost for n distinct fingerprints: (bits, t)."""
    best, chosen = None, []
    for m in range(2, radius + 2):
        options = []
        for bits in bit_groups(sample, m):
            v, own = values_in(sample, bits), [0.0]
            width, seen, freq = len(bits), {}, np.zeros(0)
            for t in range(radius + 1):
                rows_each = sum(comb(width, a) for a in range(t + 1)) if t > 1 else 1 + t * width / 2
                if rows_each > MAX_PROBES:
                    break
                _, x = raised(v, width, t)
                value, count = np.unique(x, return_counts=True)
                for a, c in zip(value[count > 1].tolist(), count[count > 1].tolist()):
                    seen[a] = seen.get(a, 0) + c
                freq = np.array(list(seen.values()), float)
                large = max(n, PLAN_FOR) / max(1, len(v))
                # smoothed: values seen once stand for a uniform rest
                pairs = ((freq * large) ** 2).sum() + (len(v) * rows_each * large) ** 2 / 2.0**width
                copies = sum(c * large // SPLIT_ROWS * c * large for c in seen.values())
                own.append(ROW_COST * (len(x) * large + copies) + PAIR_COST * pairs / 2 + (own[-1] if t else 0.0))
            options.append((bits, own))
        # by[e]: least cost of giving e = sum(t + 1) to the groups so far
        by = {0: (0.0, [])}
        for bits, own in options:
            by = {
                e: min(((by[e - u][0] + own[u], by[e - u][1] + [u]) for u in range(min(e, len(own) - 1) + 1) if e - u in by), default=None)
                for e in range(radius + 2)
            }
            by = {e: x for e, x in by.items() if x}
        if radius + 1 in by and (best is None or by[radius + 1][0] < best):
            best, given = by[radius + 1]
            chosen = [(bits, u - 1) for (bits, _), u in zip(options, given) if u]
    return chosen


# ---- buckets and links


def _bucket_rows(plan: list[tuple[np.ndarray, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                f = batch.column("f0").to_numpy().view(np.uint64)
                for i, (bits, t) in enumerate(plan):
                    v = values_in(f, bits)
                    for level in range(t + 1):
                        rows, value = raised(v, len(bits), level)
                        own = batch.take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([pa.array((i << 40) + value), pa.array(np.full(len(rows), level, np.int8)), *own.columns], names=["bucket", "level", *batch.schema.names])

    return run


def _bucketed(prints: DataFrame, plan: list[tuple[np.ndarray, int]]) -> DataFrame:
    """(bucket, level, f0, ...): every fingerprint, with all its columns of longs, in each of its buckets."""
    return prints.mapInArrow(_bucket_rows(plan), "bucket long, level byte, " + ", ".join(f"{x} long" for x in prints.columns))


def crowded(prints: DataFrame, plan: list[tuple[np.ndarray, int]], n: int) -> DataFrame | None:
    """(bucket, parts) of the buckets with over SPLIT_ROWS rows, by exact counts; None if there is none.

    Counters that many buckets share come first: a counter of no more than SPLIT_ROWS rows has no such bucket, and only the
    buckets of the others are counted one by one.
    """
    if n <= SPLIT_ROWS:  # a fingerprint stands in a bucket once
        return None
    rows = _bucketed(prints.select("f0"), plan)
    cells = 1 + n * sum(comb(len(bits), a) for bits, t in plan for a in range(t + 1)) // CELL_ROWS
    cell = F.pmod(F.xxhash64("bucket"), F.lit(cells)).alias("cell")
    full = materialize(rows.groupBy(cell).count().where(F.col("count") > SPLIT_ROWS).select("cell"), "simhash-cells")
    if full.isEmpty():
        return None
    exact = rows.select("bucket", cell).join(full, "cell", "left_semi").groupBy("bucket").count().where(F.col("count") > SPLIT_ROWS)
    hot = materialize(exact.select("bucket", F.ceil(F.col("count") / SPLIT_ROWS).cast("int").alias("parts")), "simhash-crowded")
    return None if hot.isEmpty() else hot


def in_chunks(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """rows with `sub`: those of crowded buckets once for every pair of chunks that theirs is in, all others with 0."""
    if hot is None:
        return rows.withColumn("sub", F.lit(0))
    known = F.broadcast(hot) if hot.count() <= common.BROADCAST_ROWS else hot
    chunk = F.pmod(F.xxhash64("f0"), F.col("parts")).cast("int")
    met = rows.join(known, "bucket", "left").withColumn("mine", F.coalesce(chunk, F.lit(0)))
    dealt = met.select("*", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("other"))
    sub = F.least("mine", "other").cast("long") * F.coalesce("parts", F.lit(1)) + F.greatest("mine", "other")
    return dealt.withColumn("sub", sub).drop("parts", "mine", "other")


class _Forest:
    """Union-find over the rows of a batch; keeps the edges that joined something."""

    def __init__(self, n: int):
        self.root, self.edges = np.arange(n), []

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    def add(self, a: np.ndarray, b: np.ndarray, far: np.ndarray | None = None) -> None:
        """Pairs a, b; with their distances `far`, the nearest first, so that the edges kept are near ones."""
        if far is not None:
            order = np.argsort(far, kind="stable")
            a, b = a[order], b[order]
        a, b = a[self.root[a] != self.root[b]], b[self.root[a] != self.root[b]]
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = self.find(x), self.find(y)
            if p != q:
                self.root[max(p, q)] = min(p, q)
                self.edges.append((x, y))

    def settle(self) -> None:
        while (shorter := self.root[self.root]).tolist() != self.root.tolist():
            self.root = shorter


def _near(f: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, wide: int) -> np.ndarray:
    ok = np.bitwise_count(f[a, 0] ^ f[b, 0]) <= radius
    if f.shape[1] > 1:
        at = np.flatnonzero(ok)
        ok[at] = np.bitwise_count(f[a[at]] ^ f[b[at]]).sum(1) <= wide
    return ok


def _block_pairs(f: np.ndarray, a0: int, a1: int, b0: int, b1: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.nonzero(np.bitwise_count(f[a0:a1, None, 0] ^ f[None, b0:b1, 0]) <= radius)
    return i + a0, j + b0


def _candidates(f: np.ndarray, first: np.ndarray, size: np.ndarray, level: np.ndarray, tops: list[int], radius: int, wide: int, open_, small: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one bucket within the bounds, in parts; first, size and tops (largest raise) of the buckets. open_ says which pairs are still of use."""
    ends = np.repeat(first + size, size)
    short = np.repeat(size <= small, size)
    found = []
    for d in range(1, min(small, int(size.max(initial=1)))):
        a = np.flatnonzero(short & (np.arange(len(f)) + d < ends))
        if not len(a):
            break
        a = a[open_(a, a + d)]
        a = a[_near(f, a, a + d, radius, wide)]
        found.append(np.stack([a, a + d]))
    if found:
        yield tuple(np.hstack(found))
    for s, n, top in zip(first[size > small].tolist(), size[size > small].tolist(), (t for t, k in zip(tops, size.tolist()) if k > small)):
        own = level[s : s + n]
        cut = [s + int(np.searchsorted(own, x)) for x in range(top + 2)]
        # two rows meet here for the first time if their raises together are within the group's radius
        for x in range(top + 1):
            for y in range(x, top + 1 - x):
                for i in range(cut[x], cut[x + 1], block):
                    for j in range(max(cut[y], i if x == y else 0), cut[y + 1], block):
                        a, b = _block_pairs(f, i, min(i + block, cut[x + 1]), j, min(j + block, cut[y + 1]), radius)
                        ok = open_(a, b) & (a != b)
                        a, b = a[ok], b[ok]
                        if len(a) and f.shape[1] > 1:
                            ok = np.bitwise_count(f[a] ^ f[b]).sum(1) <= wide
                            a, b = a[ok], b[ok]
                        yield a, b


def _nearest(f: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs a, b those that are among the `most` nearest of either end."""
    far = np.bitwise_count(f[a] ^ f[b]).sum(1)
    keep = np.zeros(len(a), bool)
    for end in (a, b):
        order = np.lexsort((far, end))
        sorted_end = end[order]
        start = np.searchsorted(sorted_end, sorted_end)
        keep[order[np.arange(len(order)) - start < most]] = True
    return a[keep], b[keep]


def _new_pairs(f: np.ndarray, a: np.ndarray, b: np.ndarray, group: np.ndarray, masks: np.ndarray, raises: list[int], earlier: list[int]) -> np.ndarray:
    """Which of the pairs a, b meet in no earlier group of bits and in no earlier word; earlier: the radii of the words before."""
    apart = f[a] ^ f[b]
    fresh = np.ones(len(a), bool)
    for k, radius in enumerate(earlier):
        fresh &= np.bitwise_count(apart[:, k - len(earlier)]) > radius
    for i in range(int(group.max(initial=0))):
        fresh &= (group <= i) | (np.bitwise_count(apart[:, 0] & masks[i]) > raises[i])
    return fresh


def _link(batch: pa.RecordBatch, words: int, radius: int, wide: int, plan: list[tuple[np.ndarray, int]], turn: int = 0, most: int | None = None, small: int = 24, block: int = 1024) -> Iterator[pa.RecordBatch]:
    """Links of the whole buckets in a batch sorted by bucket, sub and level; plan: the groups of bits and their radii.

    Without labels these are the edges of a spanning forest of each bucket, nearest candidates first; with labels, each row's `most` nearest
    candidates of other labels, or all of them, each where its ends meet first.
    """
    f = np.stack([batch.column(f"f{i}").to_numpy().view(np.uint64) for i in range(words)], axis=1)
    bucket, sub = batch.column("bucket").to_numpy(), batch.column("sub").to_numpy()
    fresh = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (sub[1:] != sub[:-1])])
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(bucket)))
    raises = [t for _, t in plan]
    bounds = (f, first, size, batch.column("level").to_numpy(), [raises[int(b >> 40)] for b in bucket[first]], radius, wide)
    node = nodes_of(np.roll(f, turn, axis=1))

    def edges(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    if "label" in batch.schema.names:
        label = batch.column("label").to_numpy()
        candidates = _candidates(*bounds, lambda x, y: label[x] != label[y], small, block)
        if most is None:
            masks = np.array([sum(1 << int(b) for b in bits) for bits, _ in plan], np.uint64)
            for a, b in candidates:
                ok = _new_pairs(f, a, b, bucket[a] >> 40, masks, raises, radii(wide, words)[:turn])
                yield from edges(a[ok], b[ok])
            return
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for x, y in candidates:
            a, b = np.append(a, x), np.append(b, y)
            if len(a) > 4 * most * len(f):
                a, b = _nearest(f, a, b, most)
        yield from edges(*_nearest(f, a, b, most))
    else:
        forest = _Forest(len(bucket))
        for a, b in _candidates(*bounds, lambda x, y: forest.root[x] != forest.root[y], small, block):
            forest.add(a, b, np.bitwise_count(f[a] ^ f[b]).sum(1))
            forest.settle()
        yield from edges(*np.array(forest.edges, np.int64).reshape(-1, 2).T)


def _links(words: int, radius: int, wide: int, plan: list[tuple[np.ndarray, int]], turn: int, most: int | None):
    def whole(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held:
            yield from _link(pa.Table.from_batches(held).combine_chunks().to_batches()[0], words, radius, wide, plan, turn, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, sub = batch.column("bucket").to_numpy(), batch.column("sub").to_numpy()
            same = (bucket == bucket[-1]) & (sub == sub[-1])
            # rows of the last bucket wait for the next batch
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut or key is not None and (bucket[0], sub[0]) != key:
                yield from whole(held + ([batch.slice(0, cut)] if cut else []))
                held = []
            held.append(batch.slice(cut))
            key = (bucket[-1], sub[-1])
        yield from whole(held)

    return run


def linked(prints: DataFrame, radius: int, words: int = 1, wide: int = 0, turn: int = 0, most: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints (f0, ...) of prints, of a spanning forest of each bucket.

    All pairs within `radius` bits in one word, f0 or the turn-th, and within `wide` bits in all words if there are several, are connected by
    the links; nothing else is. If prints have a column label, links are candidates of other labels instead: each fingerprint's `most`
    nearest in each bucket, or with None all such pairs, of which none is left out. a and b are the fingerprints' nodes.
    """
    spark = prints.sparkSession
    names = [f"f{i}" for i in range(words)]
    prints = prints.select(*[F.col(names[(i + turn) % words]).alias(x) for i, x in enumerate(names)], *[c for c in prints.columns if c == "label"])
    n = prints.count()
    mask = (1 << 40) - 1
    chance = int(mask * min(1.0, SAMPLE / max(1, n))) + 1
    sample = prints.where(F.xxhash64("f0").bitwiseAND(F.lit(mask)) < chance).select("f0").toArrow().column("f0").to_numpy().view(np.uint64)
    plan = allot(sample, n, radius)
    rows = in_chunks(_bucketed(prints, plan), crowded(prints, plan, n))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, "bucket", "sub").sortWithinPartitions("bucket", "sub", "level")
    return ordered.mapInArrow(_links(words, radius, wide, plan, turn, most), "a long, b long").distinct()


def near_components(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """(doc_id, f0, component_id) for every row of docs.

    Null texts have no words, so their fingerprint is 0, and they link like others. component_id is the smallest
    doc_id that is reached over links of at most `radius` bits; null doc_ids are never it, unless there is no other.
    Rows equal in all columns stand in one component; an empty table gives no rows. Other columns play no part.
    """
    rows = materialize(fingerprint(docs, shingle).select("doc_id", "f0"), "simhash-rows")
    prints = materialize(rows.groupBy("f0").agg(F.min("doc_id").alias("low")), "simhash-prints")
    labels = materialize(connected_components(linked(prints, radius)), "simhash-labels")
    named = labels.join(prints, labels["node"] == prints["f0"]).select("node", "label", "low")
    lowest = named.groupBy("label").agg(F.min("low").alias("component_id"))
    chosen = named.join(lowest, "label").select(F.col("node").alias("f0"), "component_id")
    # written out, so that the last join deals both sides anew and can split a fingerprint that many rows share
    per_print = materialize(prints.join(chosen, "f0", "left").select("f0", F.coalesce("component_id", "low").alias("component_id")), "simhash-components")
    return rows.join(per_print, "f0").select("doc_id", "f0", "component_id")


def radii(wide: int, words: int) -> list[int]:
    """Of two fingerprints within wide bits one word at least is within its radius: sum(t + 1) = wide + 1."""
    return [(wide + words - i) // words - 1 for i in range(words)]


def _links_of_all_words(prints: DataFrame, words: int, wide: int, most: int | None = None) -> DataFrame:
    links = None
    for turn, radius in enumerate(radii(wide, words)):
        more = linked(prints, radius, words, wide, turn, most)
        links = more if links is None else links.unionByName(more)
    return materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-links")


def near_links(prints: DataFrame, rows: DataFrame, docs: DataFrame, shingle: int, words: int, wide: int, percent: int) -> DataFrame:
    """(a, b): links between fingerprints (node, f0, ...) of prints whose texts have the similarity in word shingles.

    They connect all that links of all candidates connect. First the forests of all buckets are verified. Where a link of a forest fails,
    what it connected may be connected otherwise: of all fingerprints that candidates connect but verified links don't, the nearest
    candidates in other classes are verified, and after them every candidate whose ends are in different classes still.
    rows: (doc_id, k, node) of docs.
    """
    tried = _links_of_all_words(prints, words, wide)
    speakers = materialize(rows.groupBy("node").agg(F.min(F.struct("doc_id", "k")).alias("one")).select("node", "one.doc_id", "one.k"), "near-speakers")
    good = verify(tried, docs, speakers, shingle, percent)
    around = materialize(connected_components(tried).select("node", F.col("label").alias("around")), "near-around")
    for most in (REFILL, None):
        inside = connected_components(good).select("node", F.col("label").alias("inside"))
        both = materialize(around.join(inside, "node", "left").select("node", "around", F.coalesce("inside", "node").alias("label")), "near-classes")
        split = materialize(both.groupBy("around").agg(F.min("label").alias("low"), F.max("label").alias("high")).where(F.col("low") != F.col("high")).select("around"), "near-split")
        if split.isEmpty():
            break
        left = materialize(prints.join(both.join(split, "around", "left_semi").select("node", "label"), "node"), "near-left")
        more = materialize(_links_of_all_words(left.drop("node"), words, wide, most).join(tried, ["a", "b"], "left_anti"), "near-more")
        if more.isEmpty():
            continue
        tried = tried.unionByName(more)
        good = good.unionByName(verify(more, docs, speakers, shingle, percent))
    return good


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, words: int = 4, wide: int = 46, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near-duplicates, all columns as they are.

    Fingerprints have `words` words of 64 bits. Candidates differ in at most `wide` bits of all; all words are probed, with
    radii of which a pair within `wide` bits meets one at least. The nearest candidates that connect a bucket, and where these fail
    others, link if the texts have at least `percent` of their word shingles in common. Equal
    fingerprints link. Of each connected group the row of the smallest (doc_id, hash of the text) stays; null doc_ids come
    first. Null texts and texts without words are a group of their own. Rows that agree in doc_id and text leave one
    row. Columns of any name are kept. An empty table gives no rows.
    """
    names = [f"f{i}" for i in range(words)]
    with scratch(docs.sparkSession) as keep:
        rows = materialize(fingerprint(docs, shingle, words), "near-rows")
        prints = materialize(rows.select("node", *names).distinct(), "near-prints")
        labels = connected_components(near_links(prints, rows, docs, shingle, words, wide, percent))
        grouped = rows.join(labels, "node", "left").select("doc_id", "k", F.coalesce("label", "node").alias("label"))
        grouped = materialize(grouped, "near-groups")
        # written out for the same reason as above: a group may hold a third of all rows
        first = materialize(grouped.groupBy("label").agg(F.min(F.struct("doc_id", "k")).alias("first"), F.count("*").alias("n")).where(F.col("n") > 1), "near-first")
        gone = keep(materialize(grouped.join(first, "label").where(~F.struct("doc_id", "k").eqNullSafe(F.col("first"))).select("doc_id", "k").distinct(), "near-gone"))
        repeats = not grouped.groupBy("doc_id", "k").count().where(F.col("count") > 1).isEmpty()
    rest = apart(docs).withColumn("k", F.xxhash64("text")).alias("rest")
    same = F.col("rest.doc_id").eqNullSafe(F.col("gone.doc_id")) & F.col("rest.k").eqNullSafe(F.col("gone.k"))
    kept = rest.join(met_by(gone).alias("gone"), same, "left_anti")
    if repeats:
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.select(*together(docs.columns, F.col("text")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose fingerprints differ in at most 4 bits."""
    out = near_components(read_table(spark, sf_dir, "documents"), 4, 4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
