"""Benchmark decontamination with an FM-index for each shard of training text.

The words of a shard are mapped to the benchmark's vocabulary; runs of such words
form the indexed text, since no phrase reaches across another word. Over it stand
a suffix array, its Burrows-Wheeler transform in a wavelet matrix, and sampled
suffix positions. Phrases are found by backward search, all at once, located by
walking to the next sampled position, and merged into spans for removal.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import apart, materialize, read_table, together
from tidewater.llm.words import leading, slices, words_of

#: Words of a phrase; an item of fewer words is one phrase.
WINDOW = 10
#: Words and bytes after which a shard is indexed; a task may index several.
SHARD_SYMBOLS, SHARD_BYTES = 1 << 20, 32 << 20
#: Every SAMPLE-th position of a run keeps its suffix position.
SAMPLE = 8
#: Bytes of benchmark text whose phrases are broadcast at once; more items go in further passes.
BLOCK_BYTES = 16 << 20

_FOUND = "_n_words long, _firsts array<int>, _lasts array<int>, _items array<string>"
_FOUND_NAMES = [f.split()[0] for f in _FOUND.split(", ")]


class Phrases(NamedTuple):
    """Phrases of one block of items: the vocabulary by hash, phrases by length, items of each phrase."""

    hashes: np.ndarray  # of the vocabulary, sorted; a word's symbol is its place plus 1
    heads: np.ndarray
    sizes: np.ndarray
    by_length: list[tuple[np.ndarray, np.ndarray]]  # symbols (n, length), numbers of the phrases
    item_first: np.ndarray
    item_ids: list[str]
    shortest: int


def phrases_of(items: list[tuple[str, str | None]], window: int = WINDOW) -> Phrases | None:
    """Phrases of (item_id, text) pairs; None if no item has a word."""
    w = words_of([(t or "").encode() for _, t in items] or [b""])
    if not len(w.hashes):
        return None
    hashes, at, symbols = np.unique(w.hashes, return_index=True, return_inverse=True)
    heads, sizes = leading(w.blob, w.starts, w.ends)[at], (w.ends - w.starts)[at]
    symbols = symbols.astype(np.int64) + 1
    owners: dict[tuple[int, ...], set[str]] = {}
    for i, (item, _) in enumerate(items):
        own = symbols[w.first[i] : w.first[i + 1]].tolist()
        for j in range(max(1, len(own) - window + 1) if own else 0):
            owners.setdefault(tuple(own[j : j + window]), set()).add(item)
    ordered = sorted(owners, key=lambda p: (len(p), p))
    item_ids, item_first = [], [0]
    for p in ordered:
        item_ids += sorted(owners[p])
        item_first.append(len(item_ids))
    lengths = np.array([len(p) for p in ordered])
    by_length = [(np.array([ordered[i] for i in np.flatnonzero(lengths == n)], np.int64), np.flatnonzero(lengths == n)) for n in np.unique(lengths)]
    return Phrases(hashes, heads, sizes, by_length, np.array(item_first), item_ids, int(lengths.min()))


class FMIndex:
    """Over a text of symbols 1..sigma in which 0 ends a run; patterns hold no 0."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE):
        n = len(text)
        order = _suffixes(text)
        before = text[order - 1]  # of the first suffix: the last symbol, which is 0
        self.bits = max(1, int(sigma).bit_length())
        self.levels, self.zeros = [], []
        current = before
        for b in range(self.bits - 1, -1, -1):
            bit = (current >> b) & 1
            ones = np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32)
            self.levels.append(ones)
            self.zeros.append(n - int(ones[-1]))
            current = np.concatenate([current[bit == 0], current[bit == 1]])
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        self.before = before
        # positions kept: every sample-th of a run, its first one too, so that no walk leaves the run
        ends = np.flatnonzero(text == 0)
        runs = np.concatenate([[0], ends + 1])
        inside = np.arange(n) - runs[np.searchsorted(ends, np.arange(n))]
        self.kept = (inside % sample == 0)[order]
        self.place = np.where(self.kept, order, -1)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol stands among the first i of the transform."""
        low = np.zeros_like(i)
        for level, (ones, zeros) in enumerate(zip(self.levels, self.zeros)):
            bit = (symbol >> (self.bits - 1 - level)) & 1
            i1, low1 = ones[i], ones[low]
            i, low = np.where(bit == 1, zeros + i1, i - i1), np.where(bit == 1, zeros + low1, low - low1)
        return i - low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For patterns (m, length): the first and the end of their rows."""
        m = len(patterns)
        lo, hi = np.zeros(m, np.int64), np.full(m, len(self.before), np.int64)
        alive = np.arange(m)
        for c in patterns.T[::-1]:
            s = c[alive]
            lo[alive] = self.less[s] + self.rank(s, lo[alive])
            hi[alive] = self.less[s] + self.rank(s, hi[alive])
            alive = alive[hi[alive] > lo[alive]]
            if not len(alive):
                break
        dead = np.ones(m, bool)
        dead[alive] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix array."""
        out, steps, left = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(left):
            done = self.kept[rows[left]]
            out[left[done]] = self.place[rows[left[done]]] + steps[left[done]]
            left = left[~done]
            s = self.before[rows[left]]
            rows[left] = self.less[s] + self.rank(s, rows[left])
            steps[left] += 1
        return out


def _suffixes(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; each 0 is smaller than those after it, so sorting ends with the longest run."""
    n = len(text)
    zeros = text == 0
    k = int(zeros.sum())
    rank = np.empty(n, np.int64)
    rank[zeros] = np.arange(k)
    rank[~zeros] = text[~zeros] + k
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        ordered = rank[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        tail = np.zeros(n, np.int64)
        tail[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + tail
        order = np.argsort(key, kind="stable")
        rank = key
        step *= 2


class _Shard:
    """Documents of a task until they are indexed."""

    def __init__(self, phrases: Phrases | None, cut: bool):
        self.phrases, self.cut = phrases, cut
        self.clear()

    def clear(self) -> None:
        self.rows, self.n_words, self.texts, self.bounds, self.size = [], [], [], [], 0
        self.symbols, self.run_doc, self.run_word, self.run_len, self.n = [], [], [], [], 0

    def add(self, piece: pa.RecordBatch, texts: list[bytes]) -> None:
        w, base, p = words_of(texts), len(self.n_words), self.phrases
        self.rows.append(piece)
        self.n_words += np.diff(w.first).tolist()
        if self.cut:
            self.texts += texts
            for i in range(len(texts)):
                s = slice(w.first[i], w.first[i + 1])
                self.bounds.append(np.stack([w.starts[s], w.ends[s]]).astype(np.int32) - np.int32(w.text_starts[i]))
            self.size += sum(map(len, texts))
        if p is None or not len(w.hashes):
            return
        at = np.minimum(np.searchsorted(p.hashes, w.hashes), len(p.hashes) - 1)
        known = np.flatnonzero((p.hashes[at] == w.hashes) & (p.sizes[at] == w.ends - w.starts))
        known = known[p.heads[at[known]] == leading(w.blob, w.starts[known], w.ends[known])]
        if not len(known):
            return
        doc = np.searchsorted(w.first, known, "right") - 1
        opens = np.concatenate([[True], (np.diff(known) > 1) | (np.diff(doc) > 0)])
        first = np.flatnonzero(opens)
        length = np.diff(np.append(first, len(known)))
        for f, n in zip(first[length >= p.shortest].tolist(), length[length >= p.shortest].tolist()):
            self.symbols.append(at[known[f : f + n]] + 1)
            self.run_doc.append(base + int(doc[f]))
            self.run_word.append(int(known[f] - w.first[doc[f]]))
            self.run_len.append(n)
            self.n += n + 1

    def hits(self) -> tuple[np.ndarray, ...]:
        """(doc, first word, length, phrase) of every occurrence."""
        p = self.phrases
        if p is None or not self.symbols:
            return tuple(np.empty(0, np.int64) for _ in range(4))
        starts = np.concatenate([[0], np.cumsum(np.array(self.run_len) + 1)])[:-1]
        text = np.zeros(self.n, np.int64)
        for s, symbols in zip(starts.tolist(), self.symbols):
            text[s : s + len(symbols)] = symbols
        index = FMIndex(text, len(p.hashes))
        rows, lengths, numbers = [], [], []
        for patterns, number in p.by_length:
            lo, hi = index.search(patterns)
            count = hi - lo
            rows.append(np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()))
            lengths.append(np.full(len(rows[-1]), patterns.shape[1]))
            numbers.append(np.repeat(number, count))
        at = index.locate(np.concatenate(rows))
        run = np.searchsorted(starts, at, "right") - 1
        return np.array(self.run_doc)[run], np.array(self.run_word)[run] + at - starts[run], np.concatenate(lengths), np.concatenate(numbers)

    def flush(self) -> Iterator[pa.RecordBatch]:
        doc, first, length, phrase = self.hits()
        spans: dict[int, tuple[list[int], list[int]]] = {}
        order = np.lexsort((first, doc))
        for d, f, n in zip(doc[order].tolist(), first[order].tolist(), length[order].tolist()):
            firsts, lasts = spans.setdefault(d, ([], []))
            if lasts and f <= lasts[-1] + 1:
                lasts[-1] = max(lasts[-1], f + n - 1)
            else:
                firsts.append(f)
                lasts.append(f + n - 1)
        items: dict[int, set[str]] = {}
        if len(doc):
            for d, x in np.unique(np.stack([doc, phrase]), axis=1).T.tolist():
                items.setdefault(d, set()).update(self.phrases.item_ids[self.phrases.item_first[x] : self.phrases.item_first[x + 1]])
        base = 0
        for piece in self.rows:
            at = range(base, base + piece.num_rows)
            base += piece.num_rows
            texts = [_without(self.texts[i], *self.bounds[i], *spans[i]) if self.cut and i in spans else None for i in at]
            own = piece.drop_columns("text")
            yield pa.RecordBatch.from_arrays(
                [*own.columns, pa.array([self.n_words[i] for i in at], pa.int64())]
                + [pa.array([spans.get(i, ([], []))[k] for i in at], pa.list_(pa.int32())) for k in (0, 1)]
                + [pa.array([sorted(items.get(i, ())) for i in at], pa.list_(pa.string()))]
                + ([pa.array([t if t is not None else old for t, old in zip(texts, piece.column("text").to_pylist())], pa.string())] if self.cut else []),
                names=[*own.schema.names, *_FOUND_NAMES, *(["_text"] if self.cut else [])],
            )
        self.clear()


def _without(text: bytes, starts: np.ndarray, ends: np.ndarray, firsts: list[int], lasts: list[int]) -> str:
    """The text without the words of the spans and what stands between them; starts, ends: of its words."""
    out, at = [], 0
    for f, last in zip(firsts, lasts):
        out.append(text[at : starts[f]])
        at = int(ends[last])
    return b"".join([*out, text[at:]]).decode()


def _cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of text, _s (spans) and further columns: these with _text, which is text without its spans."""
    for batch in batches:
        for piece, texts in slices(batch):
            w, spans, out = words_of(texts), piece.column("_s").to_pylist(), piece.column("text").to_pylist()
            for i, own in enumerate(spans):
                if own:
                    at = slice(w.first[i], w.first[i + 1])
                    out[i] = _without(texts[i], w.starts[at] - w.text_starts[i], w.ends[at] - w.text_starts[i], [x["f"] for x in own], [x["l"] for x in own])
            rest = piece.drop_columns(["text", "_s"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(out, pa.string())], names=[*rest.schema.names, "_text"])


def _scan(shared, cut: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(shared.value, cut)
        for batch in batches:
            for piece, texts in slices(batch):
                shard.add(piece, texts)
                if shard.n >= SHARD_SYMBOLS or shard.size >= SHARD_BYTES:
                    yield from shard.flush()
        yield from shard.flush()

    return run


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str | None]]]:
    """Items in blocks of about block_bytes each, by a hash of their ids; the driver collects one when it is asked for."""
    named = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    n = max(1, -(-total // block_bytes))
    for i in range(n):
        yield [(r["item_id"], r["text"]) for r in named.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).collect()]


def _passed(docs: DataFrame, items: list[tuple[str, str | None]], cut: bool, window: int) -> DataFrame:
    """One pass over docs: its columns without text, then what was found."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(phrases_of(items, window))
    return docs.mapInArrow(_scan(shared, cut), ", ".join([*fields, _FOUND, *(["_text string"] if cut else [])]))


def _merged(spans):
    """Sorted spans (f, l) with those that overlap or touch put together."""
    none = F.array().cast("array<struct<f: int, l: int>>")
    last = lambda a: F.element_at(a, -1)
    joined = lambda a, x: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["f"].alias("f"), F.greatest(last(a)["l"], x["l"]).alias("l"))))
    return F.aggregate(F.array_sort(spans), none, lambda a, x: F.when((F.size(a) > 0) & (x["f"] <= F.try_element_at(a, F.lit(-1))["l"] + 1), joined(a, x)).otherwise(F.concat(a, F.array(x))))


def _over_blocks(rows: DataFrame, blocks: Iterable[list[tuple[str, str | None]]], window: int, *carried: str) -> DataFrame:
    """(row, carried, _n_words, _s, _items) for each of rows (row, text, carried): spans _s of all blocks on the unchanged texts, merged."""
    passes = [_passed(rows.select("row", "text", *carried), b, False, window) for b in blocks]
    every = passes[0]
    for more in passes[1:]:
        every = every.unionAll(more)
    spans = F.arrays_zip(F.col("_firsts").alias("f"), F.col("_lasts").alias("l"))
    return every.select("row", *carried, "_n_words", spans.alias("s"), "_items").groupBy("row").agg(
        *[F.max(c).alias(c) for c in carried], F.max("_n_words").alias("_n_words"), _merged(F.flatten(F.collect_list("s"))).alias("_s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items")
    )


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Where phrases of the benchmark stand in documents: (doc_id, n_words, firsts, lasts, items), one row for each of docs.

    Words firsts[i]..lasts[i] are spans for removal, merged where they touch; items are the ids of the items whose
    phrases occur. Null texts have no words; null and repeated doc_ids are rows like others; items without id or words
    match nothing; further columns play no part; an empty table gives no rows. A benchmark of more than block_bytes
    takes several passes, whose spans are merged for each row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = item_blocks(benchmark, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        found = _passed(rows, first, False, window)
        return found.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_firsts").alias("firsts"), F.col("_lasts").alias("lasts"), F.col("_items").alias("items"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "decontam-rows")
    met = _over_blocks(rows, chain((first, second), blocks), window, "doc_id").withColumnsRenamed({"_n_words": "n_words", "_s": "s", "_items": "items"})
    return met.select("doc_id", "n_words", F.transform("s", lambda x: x["f"]).alias("firsts"), F.transform("s", lambda x: x["l"]).alias("lasts"), "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the words of all spans cut out of text, and words_removed; other columns are carried along.

    Texts without spans stay byte for byte, null ones null. A benchmark of more than block_bytes takes several passes
    over the unchanged texts, whose spans are merged for each row before they are cut, so blocks change no result.
    """
    columns = [c for c in docs.columns if c != "words_removed"]
    rows = apart(docs.select(*columns)).drop("doc_id")
    blocks = item_blocks(benchmark, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        found = _passed(rows, first, True, window)
        out = found.select("doc", F.col("_text").alias("text"), _length("_firsts", "_lasts").alias("removed"))
        return out.select(*together(columns, F.col("text")), F.col("removed").alias("words_removed"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "decontam-rows")
    spans = _over_blocks(rows, chain((first, second), blocks), window).where(F.size("_s") > 0).select("row", "_s")
    met = rows.join(spans, "row", "left").select("doc", "_s", "text")
    removed = F.coalesce(F.aggregate("_s", F.lit(0).cast("long"), lambda a, x: a + x["l"] - x["f"] + 1), F.lit(0).cast("long"))
    met = met.withColumn("removed", removed)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in met.schema.fields if f.name not in ("text", "_s")]
    out = met.mapInArrow(_cut_spans, ", ".join([*fields, "_text string"]))
    return out.select(*together(columns, F.col("_text")), F.col("removed").alias("words_removed"))


def _length(firsts: str, lasts: str):
    return F.aggregate(F.zip_with(firsts, lasts, lambda f, x: x - f + 1), F.lit(0).cast("long"), lambda a, x: a + x)


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10-word windows of benchmark in whole documents."""
    found = find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", _length("firsts", "lasts").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("firsts") > 0).alias("contaminated")
    )


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents), i AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[p:p + 9], ' ') AS k FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS p FROM i WHERE len(w) > 0)),
tok AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM d)),
near AS (SELECT doc_id, p, list(word) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS n FROM tok),
occ AS (SELECT n.doc_id, n.p, win.l, win.item_id FROM (SELECT doc_id, p, s.l, array_to_string(n[1:s.l], ' ') AS k FROM near, (SELECT DISTINCT l FROM win) s WHERE len(n) >= s.l) n JOIN win ON n.l = win.l AND n.k = win.k),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + l - 1)) AS q FROM occ) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""
