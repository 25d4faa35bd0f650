"""Harmonic packing of tokenized documents into sequences of fixed capacity.

Piece lengths fall into reciprocal-capacity classes: a piece of class i is at
most capacity // i long, and every bin of class i takes exactly i pieces. So bins
fill by counting alone: workers number their own pieces of a class, and each
worker's numbers are shifted by the counts of those before it. A document is cut
so that its pieces come close under the sizes of their classes. What is left of
each class, fewer than i pieces, shares the last sequences.
"""

from __future__ import annotations

import bisect
import os
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import materialize, read_table
from tidewater.llm.words import LOWER, SOLID, slices

#: Share of a slot that may stay empty before a piece is cut instead.
SLACK = 1 / 32
#: Workers' shares of a class at least, and pieces for one more; counts of class times share are sent to the driver.
SHARES, SHARE_PIECES = 64, 4_000_000
#: Words with their ids that a Python worker keeps.
CACHE_WORDS = 1_000_000

_IS_MARK = np.isin(np.arange(256), np.frombuffer(b".,;:!?|", np.uint8))
_IS_PLAIN = np.array([chr(b).isalnum() and b < 128 for b in range(256)])

#: A word of letters only is one piece to the tokenizer, and its last token alone has the mark of a word's end.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")

_PIECES = "doc_id long, start long, length int, slots int, doc_tokens long, ids binary"


class _Numbers(dict):
    """Numbers of words; an unknown word gets the next one and waits in `fresh`."""

    def __init__(self, *known):
        super().__init__(*known)
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.fresh.append(word)
        self[word] = n = len(self)
        return n


class WordTokens:
    """Token ids of texts, word by word: pre-tokenization splits at white space, so a word's ids don't depend on its neighbours."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()
        self.flat, self.first, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def shrink(self, n: int) -> None:
        """Keep the n words learnt first, which are the frequent ones."""
        self.number = _Numbers(zip(islice(self.number, n), range(n)))
        self.first, self.size = self.first[:n], self.size[:n].copy()
        kept = self.flat[np.repeat(self.first - (np.cumsum(self.size) - self.size), self.size) + np.arange(int(self.size.sum()))]
        self.first, self.flat = np.cumsum(self.size) - self.size, kept

    def learn(self) -> None:
        """Tokenize the fresh words."""
        words, self.number.fresh = self.number.fresh, []
        plain, other = [], []
        for i, w in enumerate(words):
            (plain if _LETTERS.fullmatch(w) else other).append(i)
        size, blocks, order = np.zeros(len(words), np.int64), [], []
        for k in range(0, len(plain), 4096):
            part = plain[k : k + 4096]
            ids = np.array(self.tokenizer.encode(b" ".join([words[i] for i in part]).decode(), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(part):
                size[part] = np.diff(ends, prepend=0)
                blocks.append(ids)
                order += part
            else:
                other += part
        rows = [e.ids for e in self.tokenizer.encode_batch_fast([words[i].decode("utf-8", "replace") for i in other], add_special_tokens=False)]
        size[other] = list(map(len, rows))
        blocks.append(np.fromiter(chain.from_iterable(rows), np.uint32))
        order += other
        first = np.empty(len(words), np.int64)
        first[order] = len(self.flat) + np.cumsum(size[order]) - size[order]
        self.first, self.size = np.concatenate([self.first, first]), np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, *blocks])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """ids of each text. The tokenizer lower-cases too, but finds its special tokens before that, so texts that
        could hold one are left as they are. Words are split at ASCII white space only."""
        joined = b"\n".join(texts) + b"\n"
        if b"<|" in joined:
            blob, marks = np.frombuffer(joined, np.uint8), np.empty(0, np.int64)
        else:
            blob = LOWER[np.frombuffer(joined, np.uint8)]
            marks = _lone_marks(blob)
        solid = SOLID[blob]
        starts = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
        words = (np.insert(blob, marks, 32) if len(marks) else blob).tobytes().split()
        text_starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        counts = np.searchsorted(starts, text_starts) + np.searchsorted(marks, text_starts)
        if len(self.number) > CACHE_WORDS:
            self.shrink(CACHE_WORDS // 3)
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if self.number.fresh:
            self.learn()
        size = self.size[at]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.first[at] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[counts]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _lone_marks(blob: np.ndarray) -> np.ndarray:
    """Places of single marks behind a letter or digit and before white space: tokens of their own either way, and words repeat more without them."""
    at = np.flatnonzero(_IS_MARK[blob[:-1]])
    at = at[(at > 1) & ~SOLID[blob[at + 1]]]
    before, lead = blob[at - 1], blob[at - 2]
    return at[_IS_PLAIN[before] | ((lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))]


_LOADED: dict[str, WordTokens] = {}


def cuts(tokens: int, capacity: int, slack: float = SLACK) -> list[tuple[int, int, int]]:
    """(start, length, slots) of a document's pieces; `slots` pieces of that class fill a sequence."""
    out = [(s, capacity, 1) for s in range(0, tokens - capacity + 1, capacity)]
    at, left = len(out) * capacity, tokens - len(out) * capacity
    while left:
        slots = capacity // left
        room = capacity // slots
        if room - left <= slack * room:
            out.append((at, left, slots))
            break
        part = capacity // (slots + 1)
        # the slot below is filled whole; its class may allow more pieces when small sizes coincide
        out.append((at, part, capacity // part))
        at, left = at + part, left - part
    return out


def _tokenize(path: str, capacity: int, end_id: int, slack: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _LOADED.get(path) or _LOADED.setdefault(path, WordTokens(path))
        for batch in batches:
            for piece, texts in slices(batch):
                rows = []
                for doc_id, ids in zip(piece.column("doc_id").to_pylist(), tokens.encode(texts)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    rows += [(doc_id, s, n, k, len(ids), ids[s : s + n].tobytes()) for s, n, k in cuts(len(ids), capacity, slack)]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "start", "length", "slots", "doc_tokens", "ids"])

    return run


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, slack: float = SLACK) -> DataFrame:
    """Pieces of documents: (doc_id, start, length, slots, doc_tokens, ids); ids are little-endian unsigned 32-bit numbers.

    Each document's ids are its text's (null: none) and then end_id. Null or repeated doc_ids are rows like others.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenize(tokenizer_path, capacity, end_id, slack), _PIECES)


def _leftovers(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for each length by best fit, longest first."""
    free: list[tuple[int, int]] = []  # (room, bin), sorted
    out, bins = [(0, 0)] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bisect.bisect_left(free, (lengths[i], -1))
        if at == len(free):
            room, b = capacity, bins
            bins += 1
        else:
            room, b = free.pop(at)
        out[i] = (b, capacity - room)
        bisect.insort(free, (room - lengths[i], b))
    return out


def pack_harmonic(pieces: DataFrame, capacity: int = 4096, shares: int = SHARES) -> DataFrame:
    """pieces (doc_id, start, length, slots, and any other columns) with sequence_id and offset.

    Every bin of a class takes `slots` pieces in the order of their numbers. The leftovers are fewer than `slots`
    pieces of each class, bounded by the capacity alone (under capacity * ln(capacity) in all), and are fitted on the driver.
    No pieces: no rows.
    """
    spark = pieces.sparkSession
    pieces = materialize(pieces, "pack-pieces")
    shares = max(shares, pieces.count() // SHARE_PIECES)
    share = F.pmod(F.xxhash64("doc_id", "start"), F.lit(shares)).cast("int")
    shared = pieces.withColumn("share", share)
    counts = sorted((r["slots"], r["share"], r["n"]) for r in shared.groupBy("slots", "share").agg(F.count("*").alias("n")).collect())
    in_class: dict[int, int] = {}
    before = []
    for slots, s, n in counts:
        before.append([slots, s, in_class.get(slots, 0)])
        in_class[slots] = in_class.get(slots, 0) + n
    first_bin, bins = {}, 0
    for slots, n in sorted(in_class.items()):
        first_bin[slots] = bins
        bins += n // slots
    plan = [(slots, s, b, first_bin[slots], in_class[slots] // slots * slots) for slots, s, b in before]
    table = F.broadcast(spark.createDataFrame(plan, "slots int, share int, before long, first_bin long, full long"))
    w = Window.partitionBy("slots", "share").orderBy("doc_id", "start", "length")
    # leftovers are read again below: the numbers must not change between the two
    numbered = materialize(shared.withColumn("own", F.row_number().over(w) - 1).join(table, ["slots", "share"]).withColumn("number", F.col("before") + F.col("own")).drop("own", "before", "share"), "pack-numbered")
    kept = [c for c in pieces.columns if c != "slots"]
    whole = numbered.where(F.col("number") < F.col("full")).withColumn("sequence_id", F.col("first_bin") + F.floor(F.col("number") / F.col("slots")).cast("long"))
    order = Window.partitionBy("sequence_id").orderBy("number")
    offset = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    packed = whole.withColumn("offset", offset).select(*kept, "sequence_id", "offset")
    rest = numbered.where(F.col("number") >= F.col("full")).select("slots", "number", "length").collect()
    rest.sort(key=lambda r: (r["slots"], r["number"]))
    fitted = [(r["slots"], r["number"], bins + b, o) for r, (b, o) in zip(rest, _leftovers([r["length"] for r in rest], capacity))]
    places = spark.createDataFrame(fitted, "slots int, number long, sequence_id long, offset long")
    last = numbered.where(F.col("number") >= F.col("full")).join(F.broadcast(places), ["slots", "number"]).select(*kept, "sequence_id", "offset")
    return packed.unionByName(last)


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences from packed pieces with their ids: (sequence_id, length, ids, doc_ids)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", "length", joined.alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Pieces of docs with their places, digested: crc32 of ids instead of the ids."""
    pieces = tokenized_pieces(docs, tokenizer_path or default_tokenizer())
    digest = pieces.select("doc_id", "start", "length", "slots", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack_harmonic(digest).select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack_documents(read_table(spark, sf_dir, "documents"))
