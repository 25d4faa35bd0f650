"""Language-model scores from a log-bilinear model, trained by noise-contrastive estimation in numpy.

A token is one of the frequent words or falls into a class by its last bytes; the numbers of both grow with the root of
the training tokens. The model predicts that symbol from the one before it, as a softmax over bilinear scores; inside a
class a token has its smoothed share of the class. So every text has a normalised probability, with exact counts of all
training tokens. Training reads the exact counts of neighbouring symbols over all training texts, in blocks of rows, and
takes noise by its expectation. Each block is solved by itself, so how rows are dealt to tasks changes nothing.
Frequent tokens' counts are broadcast, the others' are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import crc_of_id, materialize, read_table
from tidewater.llm.words import SOLID, Words, slices, words_of

#: Frequent words for the root of the number of training tokens, the least and the most of them (the model is broadcast);
#: other tokens' classes, one for so many words.
WORDS_PER_ROOT, LEAST_WORDS, MOST_WORDS, WORDS_PER_CLASS = 0.5, 64, 1 << 18, 4
#: Size of the vectors, noise tokens for a true one, weight of the vectors' prior.
DIM, NOISE, PRIOR = 12, 16.0, 2.0
#: Rounds over contexts and targets, Newton steps in each, length of a step at most.
ROUNDS, STEPS, LONGEST = 3, 2, 3.0
#: Rows of a block of pair counts; parts in which a block's counts are summed first; pairs a task holds.
BLOCK, PARTS, HELD = 64, 8, 4_000_000
#: A token with at least 1/HEAD of all training tokens has its count broadcast; there are at most HEAD of them.
HEAD = 500_000
#: The end of a text as a token.
END = np.uint64(0x9D39247E33776D41)


def held_out(doc_id: Column) -> Column:
    return crc_of_id(doc_id) % 5 == 1


def suffixes_of(w: Words) -> np.ndarray:
    """The last two bytes of each word."""
    before = np.where(w.ends - w.starts > 1, w.blob[np.maximum(w.ends - 2, 0)], 0)
    return w.blob[w.ends - 1].astype(np.int32) << 8 | before


class Stream(NamedTuple):
    """Tokens of several texts, each followed by its end: hashes, last bytes, the text's number, and the place in it."""

    hashes: np.ndarray
    suffixes: np.ndarray
    text: np.ndarray
    place: np.ndarray


def stream_of(texts: list[bytes]) -> Stream:
    w = words_of(texts, SOLID)
    n = np.diff(w.first) + 1
    starts = np.cumsum(n) - n
    total = int(n.sum())
    is_end = np.zeros(total, bool)
    is_end[starts + n - 1] = True
    hashes, suffixes = np.full(total, END, np.uint64), np.zeros(total, np.int32)
    hashes[~is_end], suffixes[~is_end] = w.hashes, suffixes_of(w)
    text = np.repeat(np.arange(len(texts)), n)
    return Stream(hashes, suffixes, text, np.arange(total) - starts[text])


# ---- counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's tokens, merged every few slices."""

    def merged(parts):
        h, c, n = (np.concatenate(p) for p in zip(*parts))
        unique, at, back = np.unique(h, return_index=True, return_inverse=True)
        return unique, c[at], np.bincount(back, n, len(unique)).astype(np.int64)

    def batch_of(h, c, n):
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c), pa.array(n)], names=["h", "suffix", "n"])

    parts, size = [], 0
    for batch in batches:
        for _, texts in slices(batch):
            s = stream_of(texts)
            h, at, n = np.unique(s.hashes, return_index=True, return_counts=True)
            parts.append((h, s.suffixes[at], n))
            size += len(h)
            if size > 2_000_000:
                parts = [merged(parts)]
                size = len(parts[0][0])
                if size > 1_000_000:
                    yield batch_of(*parts.pop())
                    size = 0
    if parts:
        yield batch_of(*merged(parts))


def token_counts(texts: DataFrame) -> DataFrame:
    """(h, suffix, n): how often each token stands in the texts, ends included; h is its 64-bit hash, suffix its last bytes."""
    rows = texts.select("text").mapInArrow(_count, "h long, suffix int, n long")
    return rows.groupBy("h").agg(F.max("suffix").alias("suffix"), F.sum("n").alias("n"))


# ---- the model


class Model(NamedTuple):
    """frequent: hashes of the frequent words, sorted, END among them; a word's symbol is its place, a class's symbol comes
    after. class_of: the class of each suffix. After the symbols there is one context more, which stands before a text."""

    frequent: np.ndarray
    class_of: np.ndarray
    share: np.ndarray  # of each symbol among training tokens
    seen: np.ndarray  # how often each context has a successor in training
    context: np.ndarray  # (symbols + 1, DIM)
    target: np.ndarray  # (symbols, DIM)
    bias: np.ndarray  # of each symbol
    norm: np.ndarray  # natural logarithm of the sum over all symbols, for each context

    def symbols(self, s: Stream) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.frequent, s.hashes), len(self.frequent) - 1)
        return np.where(self.frequent[at] == s.hashes, at, len(self.frequent) + self.class_of[s.suffixes])

    def contexts(self, s: Stream, symbols: np.ndarray) -> np.ndarray:
        """The symbol before each position."""
        return np.where(s.place > 0, np.roll(symbols, 1), len(self.share))

    def log_probs(self, s: Stream, symbols: np.ndarray) -> np.ndarray:
        """Natural log-probability of every symbol, normalised over all symbols."""
        c = self.contexts(s, symbols)
        return np.einsum("ij,ij->i", self.context[c], self.target[symbols]) + self.bias[symbols] - self.norm[c]


def fresh_model(frequent: np.ndarray, class_of: np.ndarray, share: np.ndarray) -> Model:
    """A model that ignores context and gives each symbol its share; targets have small random vectors."""
    n = len(share)
    target = np.random.default_rng(3).standard_normal((n, DIM)) * 0.5
    return Model(frequent, class_of, share, np.zeros(n + 1), np.zeros((n + 1, DIM)), target, np.log(share), np.zeros(n + 1))


def normalised(model: Model, first: int, last: int) -> np.ndarray:
    """Natural logarithm of the sum over all symbols for the contexts from first up to last."""
    scores = (model.context[first:last] @ model.target.T + model.bias).astype(np.float64)
    top = scores.max(1)
    return top + np.log(np.exp(scores - top[:, None]).sum(1))


def fitted(counts: np.ndarray, x: np.ndarray, prior: np.ndarray, features: np.ndarray, noise: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Rows x that maximise the noise-contrastive objective by Newton's method, features of the other side held.

    counts, noise, offset: (rows, others): true pairs, expected noise pairs, and what is added to a pair's score
    less the logarithm of its noise.
    """
    squares = (features[:, :, None] * features[:, None, :]).reshape(len(features), -1).astype(np.float32)
    f32 = features.astype(np.float32)
    both = counts + noise
    for _ in range(STEPS):
        true = 1 / (1 + np.exp(-(x.astype(np.float32) @ f32.T + offset)))
        slope = (counts - both * true) @ f32 - PRIOR * (x - prior)
        curve = ((both * true * (1 - true)) @ squares).reshape(len(x), x.shape[1], x.shape[1]) + PRIOR * np.eye(x.shape[1])
        step = np.linalg.solve(curve.astype(np.float64), slope[:, :, None].astype(np.float64))[:, :, 0]
        length = np.sqrt((step**2).sum(1, keepdims=True))
        x = x + step * np.minimum(1, LONGEST / np.maximum(length, 1e-9))
    return x


# ---- counts of neighbours


_PAIRS = "block int, part int, at binary, n binary"


def _packed(block: int, part: int, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([at.astype(np.uint32).tobytes()], pa.binary()), pa.array([n.astype(np.uint32 if n.max(initial=0) < 1 << 32 else np.uint64).tobytes()], pa.binary())],
        names=["block", "part", "at", "n"],
    )


def _unpacked(at: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(at, np.uint32), np.frombuffer(n, np.uint32 if len(n) == len(at) else np.uint64).astype(np.int64)


def _blocks(rows: np.ndarray, others: np.ndarray, n: np.ndarray, width: int, part: int) -> Iterator[pa.RecordBatch]:
    """Packed rows of pair counts; rows are sorted."""
    cuts = np.flatnonzero(np.diff(rows // BLOCK, prepend=-1))
    for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)]):
        yield _packed(int(rows[i]) // BLOCK, part, rows[i:j] % BLOCK * width + others[i:j], n[i:j])


def _pairs(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        width, part = len(model.share), TaskContext.get().partitionId() % PARTS
        keys, n, new, held = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def merged():
            fresh, times = np.unique(np.concatenate(new), return_counts=True) if new else (keys[:0], n[:0])
            if not len(keys):
                return fresh, times
            every, back = np.unique(np.concatenate([keys, fresh]), return_inverse=True)
            return every, np.bincount(back, np.concatenate([n, times]), len(every)).astype(np.int64)

        for batch in batches:
            for _, texts in slices(batch):
                s = stream_of(texts)
                symbols = model.symbols(s)
                new.append(model.contexts(s, symbols) * width + symbols)
                held += len(symbols)
                if held > HELD:
                    keys, n = merged()
                    new, held = [], 0
                    if len(keys) > HELD:
                        yield from _blocks(keys // width, keys % width, n, width, part)
                        keys, n = keys[:0], n[:0]
        keys, n = merged()
        yield from _blocks(keys // width, keys % width, n, width, part)

    return run


def _merge(width: int):
    """Sums of the packed rows of each block, which come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def done():
            at = np.flatnonzero(total)
            return _packed(*key, at, total[at])

        for batch in batches:
            for block, part, at, n in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "at", "n"))):
                if (block, part) != key:
                    if key is not None:
                        yield done()
                    key, total = (block, part), np.zeros(BLOCK * width, np.int64)
                at, n = _unpacked(at, n)
                total[at] += n
        if key is not None:
            yield done()

    return run


def _turn(width: int, new_width: int):
    """Blocks of contexts as blocks of targets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, at, n in zip(*(batch.column(c).to_pylist() for c in ("block", "at", "n"))):
                at, n = _unpacked(at, n)
                rows, others = at % width, block * BLOCK + at // width
                order = np.argsort(rows, kind="stable")
                yield from _blocks(rows[order].astype(np.int64), others[order].astype(np.int64), n[order], new_width, block % PARTS)

    return run


def _summed(rows: DataFrame, width: int, label: str) -> DataFrame:
    """One packed row for each block: first each part of it, then the parts."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = rows.repartition(parts, "block", "part").sortWithinPartitions("block", "part").mapInArrow(_merge(width), _PAIRS)
    whole = some.withColumn("part", F.lit(0)).repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_merge(width), _PAIRS)
    return materialize(whole, label)


def _fit(shared, of_contexts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        chance = NOISE * m.share
        for batch in batches:
            for block, at, n in zip(*(batch.column(c).to_pylist() for c in ("block", "at", "n"))):
                at, n = _unpacked(at, n)
                here = np.arange(block * BLOCK, min((block + 1) * BLOCK, len(m.context) if of_contexts else len(m.target)))
                width = len(m.target) if of_contexts else len(m.context)
                counts = np.zeros(BLOCK * width, np.float32)
                counts[at] = n
                counts = counts.reshape(BLOCK, width)[: len(here)]
                if of_contexts:
                    noise, offset = np.outer(m.seen[here], chance), (m.bias - np.log(chance))[None, :]
                    x = fitted(counts, m.context[here], np.zeros((1, DIM)), m.target, noise.astype(np.float32), offset.astype(np.float32))
                else:
                    noise, offset = np.outer(chance[here], m.seen), -np.log(chance[here])[:, None]
                    own = np.hstack([m.target[here], m.bias[here, None]])
                    prior = np.hstack([np.zeros((len(here), DIM)), np.log(m.share[here, None])])
                    x = fitted(counts, own, prior, np.hstack([m.context, np.ones((width, 1))]), noise.astype(np.float32), offset.astype(np.float32))
                yield pa.RecordBatch.from_arrays([pa.array(here.astype(np.int32)), pa.array(list(x.astype(np.float64)), pa.list_(pa.float64()))], names=["i", "x"])

    return run


def _norms(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("id").to_pylist():
                z = normalised(shared.value, block * BLOCK, (block + 1) * BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(z), dtype=np.int32) + block * BLOCK), pa.array(z)], names=["i", "z"])

    return run


def train(texts: DataFrame, model: Model) -> Model:
    """The model fitted to all neighbours in texts: contexts with targets held, then targets with contexts held, in rounds.

    The driver gets what the model has: DIM numbers for each symbol.
    """
    spark, width = texts.sparkSession, len(model.share)
    send = spark.sparkContext.broadcast
    by_context = _summed(texts.select("text").mapInArrow(_pairs(send(model)), _PAIRS), width, "lm-contexts")
    by_target = _summed(by_context.mapInArrow(_turn(width, width + 1), _PAIRS), width + 1, "lm-targets")
    seen = np.zeros(width + 1)
    for r in by_context.mapInArrow(_seen(width), "i int, n long").collect():
        seen[r["i"]] = r["n"]
    model = model._replace(seen=seen)
    for _ in range(ROUNDS):
        for of_contexts, table in ((True, by_context), (False, by_target)):
            got = table.mapInArrow(_fit(send(model), of_contexts), "i int, x array<double>").toArrow()
            if not got.num_rows:
                continue
            i, x = got.column("i").to_numpy(), np.array(got.column("x").to_pylist())
            if of_contexts:
                model = model._replace(context=_put(model.context, i, x))
            else:
                model = model._replace(target=_put(model.target, i, x[:, :DIM]), bias=_put(model.bias, i, x[:, DIM]))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = spark.range(0, -(-(width + 1) // BLOCK), 1, parts).mapInArrow(_norms(send(model)), "i int, z double").toArrow()
    return model._replace(norm=_put(model.norm, got.column("i").to_numpy(), got.column("z").to_numpy()))


def _put(old: np.ndarray, i: np.ndarray, x: np.ndarray) -> np.ndarray:
    new = old.copy()
    new[i] = x
    return new


def _seen(width: int):
    """How often each context has a successor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, at, n in zip(*(batch.column(c).to_pylist() for c in ("block", "at", "n"))):
                at, n = _unpacked(at, n)
                total = np.bincount(at // width, n, BLOCK).astype(np.int64)
                i = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array((i + block * BLOCK).astype(np.int32)), pa.array(total[i])], names=["i", "n"])

    return run


# ---- scores


class Known(NamedTuple):
    """model, the frequent tokens' hashes (sorted) and counts, and log10 of each class's smoothed total."""

    model: Model
    hashes: np.ndarray
    counts: np.ndarray
    class_norm: np.ndarray


_SCORED = "uid long, h long, times long, in_class boolean, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Known = shared.value
        m, log10 = known.model, np.log(10.0)
        uid = TaskContext.get().partitionId() << 33
        log_count = np.log10(known.counts + 0.5)
        for batch in batches:
            for piece, texts in slices(batch):
                s, n = stream_of(texts), len(texts)
                symbols = m.symbols(s)
                at = np.minimum(np.searchsorted(known.hashes, s.hashes), max(0, len(known.hashes) - 1))
                head = known.hashes[at] == s.hashes if len(known.hashes) else np.zeros(len(at), bool)
                base = np.bincount(s.text[head], log_count[at[head]], n).astype(float)  # integers if nothing is there
                own = m.log_probs(s, symbols) / log10
                in_class = symbols >= len(m.frequent)
                own[in_class] -= known.class_norm[symbols[in_class] - len(m.frequent)]
                both = head & in_class
                own[both] += log_count[at[both]]
                score, tokens = np.bincount(s.text, own, n), np.bincount(s.text, minlength=n)
                mine = uid + np.arange(n)
                uid += n
                rest = ~head
                order = np.lexsort((s.hashes[rest], s.text[rest]))
                text, h = s.text[rest][order], s.hashes[rest][order]
                first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.empty(0, np.int64)
                k = len(first)
                times = np.diff(np.append(first, len(h)))
                # a row for each text, whose key meets no token, and one for each of its other tokens
                zeros = pa.array(np.zeros(k))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([mine, mine[text[first]]])),
                        pa.array(np.concatenate([(mine.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64), h[first].view(np.int64)])),
                        pa.array(np.concatenate([np.zeros(n, np.int64), times])),
                        # a symbol of its own has its probability already, however rare it is; others share their class by their counts
                        pa.array(np.concatenate([np.zeros(n, bool), in_class[rest][order][first]])),
                        pa.concat_arrays([piece.column("doc_id"), pa.nulls(k, pa.int64())]),
                        pa.concat_arrays([piece.column("held_out"), pa.nulls(k, pa.bool_())]),
                        pa.array(np.concatenate([tokens, np.zeros(k, np.int64)])),
                        pa.array(np.concatenate([np.bincount(s.text[head], minlength=n), np.zeros(k, np.int64)])),
                        pa.concat_arrays([pa.array(base), zeros]),
                        pa.concat_arrays([pa.array(score), zeros]),
                    ],
                    names=[f.split()[0] for f in _SCORED.split(", ")],
                )

    return run


def score_texts(docs: DataFrame, training: DataFrame, held: Column | None = None) -> DataFrame:
    """Scores of all docs (doc_id, text) by what is learned from training (text).

    Returns (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of docs. Null texts
    are empty and have one token, their end. Without training texts every token has count 0. held is the column for
    held_out. Null or repeated doc_ids are rows like others; further columns play no part; empty tables give no rows.
    Token counts cover all training texts; so does the model's training, each position of them once.
    """
    spark = docs.sparkSession
    counts = materialize(token_counts(training), "lm-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"], total["v"]
    words = int(min(max(WORDS_PER_ROOT * n**0.5, LEAST_WORDS), MOST_WORDS))
    classes = words // WORDS_PER_CLASS
    is_end = F.col("h") == int(END.astype(np.int64))
    ends = counts.where(is_end).select("n").first()
    top = counts.where(~is_end).orderBy(F.desc("n"), "h").limit(words).select("h", "suffix", "n").toArrow()
    frequent, at = np.unique(np.append(top.column("h").to_numpy(), END.astype(np.int64)).view(np.uint64), return_index=True)
    own = np.append(top.column("n").to_numpy(), ends["n"] if ends else 0)[at]
    # classes: suffixes by hash; what the frequent words have of them is taken off
    class_of = (np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % classes
    mass, kinds = np.zeros(classes), np.zeros(classes)
    for table, sign in ((counts.where(~is_end).groupBy("suffix").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow(), 1), (top.append_column("v", pa.array(np.ones(top.num_rows))), -1)):
        c = class_of[table.column("suffix").to_numpy()]
        np.add.at(mass, c, sign * table.column("n").to_numpy().astype(float))
        np.add.at(kinds, c, sign * table.column("v").to_numpy().astype(float))
    share = np.concatenate([own, mass]) + 0.5
    model = train(training, fresh_model(frequent, class_of, share / share.sum()))
    least = max(1, -(-n // HEAD))
    head = counts.where(F.col("n") >= least).select("h", "n").toArrow()
    hashes = head.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    known = Known(model, hashes[order], head.column("n").to_numpy()[order], np.log10(mass + 0.5 * (kinds + 1)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.lit(False) if held is None else held).alias("held_out"), "text")
    scored = rows.mapInArrow(_score(spark.sparkContext.broadcast(known)), _SCORED)
    joined = scored.join(counts.where(F.col("n") < least).select("h", F.col("n").alias("c")), "h", "left")
    part = F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))
    out = joined.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0))).alias("n_known"),
        F.sum(F.col("base") + part).alias("base"),
        F.sum(F.col("score") + F.when(F.col("in_class"), part).otherwise(0.0)).alias("score"),
    )
    norm = float(np.log10(n + 0.5 * (v + 1)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(norm)).alias("base_score"), "score")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned from those that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"))
    return score_texts(docs, docs.where(~held), held)
