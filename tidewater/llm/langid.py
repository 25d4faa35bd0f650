"""Language identification by error-correcting output codes.

Every language has a codeword; for each bit a binary n-gram classifier tells the
languages with a 1 from those with a 0. A text gets the language whose codeword
loses least against the classifiers' margins, each bit weighted by how reliable
its classifier is for that language; a close second makes the text ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import crc_of_id, read_table
from tidewater.llm.words import slices

#: Byte n-grams of these lengths, hashed into so many buckets.
GRAMS, BUCKETS = (2, 3, 4), 1 << 15
#: Labelled rows, about, that weigh the bits; drawn by a hash of doc_id.
WEIGH_ROWS = 4000
#: N-grams of evidence that a text has at most, as neighbours depend on each other.
EVIDENCE = 60.0
#: Decoded probability below which a text is ambiguous.
AMBIGUOUS = 0.6
UNKNOWN = "und"



def code_matrix(languages: int) -> np.ndarray:
    """Codewords (languages, bits) of +1 and -1: all distinct splits for up to five languages, else random ones far apart."""
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= 5:
        n = (1 << (languages - 1)) - 1
        return np.array([[1.0 if lang == 0 or not (b + 1) >> (lang - 1) & 1 else -1.0 for b in range(n)] for lang in range(languages)])
    rng, best, most = np.random.default_rng(5), None, -1
    bits = max(15, 4 * int(np.ceil(np.log2(languages))))
    for _ in range(200):
        code = np.where(rng.random((languages, bits)) < 0.5, -1.0, 1.0)
        distance = (bits - code @ code.T) / 2 + np.eye(languages) * bits
        split = np.abs(code.sum(0)).max() < languages
        if split and distance.min() > most:
            best, most = code, distance.min()
    return best


class _Grams:
    """Hashed n-grams of texts: bytes of the lower-cased text, where what is no letter is a space."""

    _letters = np.array([b if b >= 0x80 or 0x61 <= b <= 0x7A else 32 for b in range(256)], np.uint8)

    def __init__(self, texts: list[bytes]):
        lowered = [t.decode("utf-8", "replace").lower().encode() for t in texts]
        self.blob = self._letters[np.frombuffer(b" " + b"  ".join(lowered) + b" ", np.uint8)]
        self.ends = np.cumsum([len(t) + 2 for t in lowered])

    def blocks(self, size: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(buckets (k, grams), place of each gram) for parts of the joined texts; grams over a text's end are few and stay."""
        b = self.blob.astype(np.uint32)
        n = len(b) - max(GRAMS) + 1
        for i in range(0, max(0, n), size):
            at = np.arange(i, min(n, i + size))
            code, rows = np.zeros(len(at), np.uint32), []
            for k in range(max(GRAMS)):
                code = (code << np.uint32(8)) | b[at + k] if k < 4 else code
                if k + 1 in GRAMS:
                    rows.append(((code + np.uint32(k * 0x51ED27)) * np.uint32(2654435761)) >> np.uint32(32 - 15))
            yield np.stack(rows), at

    def means(self, weights: np.ndarray) -> np.ndarray:
        """(texts, bits): the mean of the weights of each text's n-grams, and how many there are in the last column."""
        total = np.zeros((len(self.ends), weights.shape[1]))
        for buckets, at in self.blocks():
            # a text's last grams reach into the spaces behind it, no further than the next one's first letters
            text = np.searchsorted(self.ends, at, "right")
            starts = np.flatnonzero(np.diff(text, prepend=-1))
            own = weights[buckets[0]]
            for row in buckets[1:]:
                own = own + weights[row]
            total[text[starts]] += np.add.reduceat(own, starts, axis=0, dtype=np.float64)
        n = np.diff(self.ends, prepend=0).astype(np.float64)
        return np.hstack([total / (len(GRAMS) * n)[:, None], n[:, None]])


def _has_letter(t: bytes) -> bool:
    """Whether any character is of category L; numbers and signs of other kinds are no letters."""
    return any(map(str.isalpha, t.decode("utf-8", "ignore")))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of a task's texts for each language."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for piece, texts in slices(batch):
            langs = piece.column("lang").to_pylist()
            for lang in set(langs):
                own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for buckets, _ in _Grams([t for t, x in zip(texts, langs) if x == lang]).blocks():
                    own += np.bincount(buckets.ravel(), minlength=BUCKETS)
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "bucket", "n"])


def _weigh(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, code, weights = shared.value
        hit, seen = np.zeros_like(code), np.zeros(len(languages))
        for batch in batches:
            for piece, texts in slices(batch):
                own = np.array([languages.index(x) for x in piece.column("lang").to_pylist()])
                margins = _Grams(texts).means(weights)[:, :-1]
                np.add.at(hit, own, np.sign(margins) == code[own])
                np.add.at(seen, own, 1)
        at = np.indices(code.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[0].ravel().astype(np.int32)), pa.array(at[1].ravel().astype(np.int32)), pa.array(hit.ravel()), pa.array(np.repeat(seen, code.shape[1]))], names=["lang", "bit", "hit", "seen"]
        )

    return run


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for piece, texts in slices(batch):
                pred, score = model.decode(texts)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array(pred), pa.array(score), pa.array([p != UNKNOWN and s < AMBIGUOUS for p, s in zip(pred, score)])],
                    names=[*piece.schema.names, "lang_pred", "lang_score", "lang_ambiguous"],
                )

    return run


class LanguageModel:
    """Languages, their codewords, the bit classifiers' n-gram weights, and the weight of each bit for each language."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.trust = languages, code, weights, trust

    def decode(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        means = _Grams(texts).means(self.weights)
        margins = means[:, :-1] * np.minimum(means[:, -1:], EVIDENCE)
        loss = np.einsum("tlb,lb->tl", np.logaddexp(0.0, -margins[:, None, :] * self.code[None]), self.trust)
        loss -= loss.min(1, keepdims=True)
        p = np.exp(-loss)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        seen = [_has_letter(t) for t in texts]
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best, seen)], [float(min(1.0, p[i, b])) if s else 0.0 for i, (b, s) in enumerate(zip(best, seen))]


def train(labelled: DataFrame, weigh_rows: int = WEIGH_ROWS) -> LanguageModel:
    """A model from (doc_id, text, lang), null texts, null langs and UNKNOWN ones left out.

    n-grams are counted over all labelled rows; only the bits' weights use a sample, of about weigh_rows rows.
    The driver gets BUCKETS counts for each language. Without labelled rows every text is UNKNOWN.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN)).select("doc_id", "text", "lang")
    counts = rows.select("text", "lang").mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counts.column("lang").to_pylist()))
    if not languages:
        return LanguageModel([], np.ones((0, 1)), np.zeros((BUCKETS, 1), np.float32), np.ones((0, 1)))
    table = np.zeros((len(languages), BUCKETS))
    number = {x: i for i, x in enumerate(languages)}
    at = np.array([number[x] for x in counts.column("lang").to_pylist()])
    table[at, counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    share = (table + 0.5) / (table + 0.5).sum(1, keepdims=True)
    code = code_matrix(len(languages))
    if len(languages) == 1:
        return LanguageModel(languages, code, np.zeros((BUCKETS, 1), np.float32), np.ones_like(code))
    weights = np.stack([np.log(share[b > 0].mean(0)) - np.log(share[b < 0].mean(0)) for b in code.T], axis=1).astype(np.float32)
    n = rows.count()
    mask = (1 << 30) - 1
    drawn = rows.where(F.xxhash64("doc_id").bitwiseAND(F.lit(mask)) < F.lit(int(mask * min(1.0, weigh_rows / max(1, n))) + 1))
    told = drawn.select("text", "lang").mapInArrow(_weigh(spark.sparkContext.broadcast((languages, code, weights))), "lang int, bit int, hit double, seen double")
    hit, seen = np.zeros_like(code), np.zeros_like(code)
    for r in told.groupBy("lang", "bit").agg(F.sum("hit").alias("hit"), F.sum("seen").alias("seen")).collect():
        hit[r["lang"], r["bit"]], seen[r["lang"], r["bit"]] = r["hit"], r["seen"]
    trust = (hit + 1) / (seen + 2)
    return LanguageModel(languages, code, weights, trust / trust.sum(1, keepdims=True))


def held_out(doc_id: Column) -> Column:
    return crc_of_id(doc_id) % 4 == 2


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred, lang_score (0 to 1) and lang_ambiguous; columns of these names are replaced.

    Only text is looked at. A null text, and one without any letter, is UNKNOWN with score 0. Rows are handled one
    by one, so null, repeated or equal rows and further columns change nothing; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.drop("lang_pred", "lang_score", "lang_ambiguous")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_predict(spark.sparkContext.broadcast(model)), f"{fields}, lang_pred string, lang_score double, lang_ambiguous boolean")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of documents, learned from those that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    out = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))
