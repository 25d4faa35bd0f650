"""Line dedup over content-defined chunks of lines and sentences, with DataFrame operations only.

A text is cut into lines and sentences; what is long without a sentence end is cut further between words. A rolling
hash over the hashes of neighbouring units chooses the boundaries of chunks, so a passage is chunked alike wherever it
stands. Chunks that stand in more than one place keep the first, and runs of repeated chunks that are long enough go
from the other places, after their bytes were compared by grouping.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import apart, materialize, read_table, together

#: Code points that a run of repeated chunks has at least; shorter ones are set phrases.
MIN_CHARS = 80
#: Code points from which a sentence ends a chunk whatever the rolling hash says; the end of a line always does.
OWN_CHUNK = 64
#: One in so many ends of shorter sentences is a boundary.
SPREAD = 3
#: Code points from which a unit is cut between words, at one in WORD_SPREAD places.
ENDLESS, WORD_SPREAD = 300, 8

_UNIT = r"[^\n.!?]*+[\n.!?]++\s*+|[^\n.!?]++"
#: From here on, code points of scripts that write without spaces are words of their own. One range; unions are slow.
_ALONE = r"\x{0E00}-\x{3FFFF}"
_WORD = rf"[^\s{_ALONE}]++\s*+|[{_ALONE}]\s*+|\s++"
#: Stands before the words that begin a piece while pieces are made; a unit that has it itself is not cut.
_MARK = "\x01"
_WHITE = " \t\n\r\x0b\x0c"
_MASK = (1 << 40) - 1


def _once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """df with a column that is computed once for each row: a generator keeps the optimizer from copying it into the
    functions that run for every element of an array."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _bind(value: Column, use) -> Column:
    """use(value) with value computed once, also inside of functions that run for every element."""
    return F.get(F.transform(F.array(value), use), 0)


def _trimmed(unit: Column) -> Column:
    """unit without white space at its end. Trimming of other characters than spaces is slow, so it is done where it is
    needed only."""
    bare = F.rtrim(unit)
    return F.when(reduce(lambda a, b: a | b, (F.endswith(bare, F.lit(c)) for c in _WHITE[1:])), F.rtrim(unit, F.lit(_WHITE))).otherwise(bare)


def _hash(unit: Column) -> Column:
    return F.xxhash64(_trimmed(unit))


def _chosen(h: Column, i: Column, spread: int) -> Column:
    """Whether the rolling hash over the hashes i - 1 and i, counted from 0, is one in `spread`."""
    return F.pmod(F.xxhash64(F.get(h, i - 1), F.get(h, i)).bitwiseAND(F.lit(_MASK)), F.lit(spread)) == 0


def _pieces(unit: Column) -> Column:
    """A long unit cut before words chosen by rolling hash; not before one of the three words before it, so that a
    drone of few words stays whole."""

    def cut(w: Column) -> Column:
        def marked(h: Column) -> Column:
            fresh = lambda i: reduce(lambda a, b: a & b, (~F.get(h, i).eqNullSafe(F.get(h, F.greatest(i - d, F.lit(0)))) for d in (1, 2, 3)))
            return F.transform(w, lambda x, i: F.when((i > 0) & _chosen(h, i, WORD_SPREAD) & fresh(i), F.concat(F.lit(_MARK), x)).otherwise(x))

        return F.split(F.array_join(_bind(F.transform(w, _hash), marked), ""), _MARK)

    words = F.regexp_extract_all(unit, F.lit(_WORD), F.lit(0))
    return F.when((F.char_length(unit) >= ENDLESS) & ~F.contains(unit, F.lit(_MARK)), _bind(words, cut)).otherwise(F.array(unit))


def with_units(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `units`, array<string> in the text's order; joined, they are the text. A null text has null units."""
    coarse = _once(docs, F.regexp_extract_all(text, F.lit(_UNIT), F.lit(0)), "_coarse")
    some = F.exists("_coarse", lambda u: (F.octet_length(u) >= ENDLESS) & (F.char_length(u) >= ENDLESS))
    return _once(coarse, F.when(some, F.flatten(F.transform("_coarse", _pieces))).otherwise(F.col("_coarse")), "units").drop("_coarse")


def _placed(cut: DataFrame) -> DataFrame:
    """cut with `chunks`, array<struct<s, n, h, chars>>: n units from the s-th on, s from 0."""
    seen = _once(_once(cut, F.transform("units", _hash), "_h"), F.transform("units", F.char_length), "_n")
    ends = lambda i: (F.get("_n", i) >= OWN_CHUNK) | F.endswith(F.rtrim(F.get("units", i)), F.lit("\n"))
    begins = lambda i: (i == 0) | ends(i - 1) | _chosen(F.col("_h"), i, SPREAD)
    starts = _once(seen, F.when(F.size("_n") > 0, F.filter(F.sequence(F.lit(0), F.size("_n") - 1), begins)).otherwise(F.array().cast("array<int>")), "_starts")

    def over(name: str, s: Column, n: Column, merge) -> Column:
        """merge over n elements from the s-th on, by their numbers: a slice would copy the whole array each time."""
        first = F.get(name, s)
        return F.when(n == 1, first).otherwise(F.aggregate(F.sequence(s + 1, s + F.greatest(n - 1, F.lit(1))), first, lambda a, i: merge(a, F.get(name, i))))

    def chunk(s: Column, i: Column) -> Column:
        n = F.coalesce(F.get("_starts", i + 1), F.size("_n")) - s
        return F.struct(s.alias("s"), n.alias("n"), over("_h", s, n, F.xxhash64).alias("h"), over("_n", s, n, lambda a, x: a + x).alias("chars"))

    return _once(starts, F.transform("_starts", chunk), "chunks").drop("_h", "_n", "_starts")


def _units_of(c: Column) -> Column:
    """The units of a chunk or mark; not by a slice, which would copy the whole array each time."""
    return F.transform(F.sequence(c["s"], c["s"] + c["n"] - 1), lambda i: F.get("units", i))


def with_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `chunks`, array<struct<body, s, n, h, chars>> in the text's order. h is of the units without white space at their ends."""
    whole = lambda c: F.struct(F.array_join(_units_of(c), "").alias("body"), c["s"].alias("s"), c["n"].alias("n"), c["h"].alias("h"), c["chars"].alias("chars"))
    placed = _placed(with_units(docs, text)).withColumnRenamed("chunks", "_placed")
    return _once(placed, F.transform("_placed", whole), "chunks").drop("units", "_placed")


def _marks(places: DataFrame) -> DataFrame:
    """(h, doc_id, k, s, n, goes): places in runs of MIN_CHARS code points or more whose every chunk has an earlier
    place, and the first places of their chunks.

    A run is counted within its document; nothing of other documents is gathered there.
    """
    first = materialize(places.groupBy("h").agg(F.min(F.struct("doc_id", "k", "s", "n")).alias("first")), "lines-first")
    later = places.join(first, "h").where(~F.struct("doc_id", "k", "s", "n").eqNullSafe(F.col("first"))).drop("first")
    in_doc = Window.partitionBy("doc_id", "k").orderBy("s")
    # the units before a chunk that are not in such chunks are as many all along a run
    run = later.withColumn("run", F.col("s") - F.coalesce(F.sum("n").over(in_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sized = run.withColumn("size", F.sum("chars").over(Window.partitionBy("doc_id", "k", "run")))
    going = materialize(sized.where(F.col("size") >= MIN_CHARS).select("h", "doc_id", "k", "s", "n"), "lines-going")
    kept = first.join(going.select("h").distinct(), "h", "left_semi").select("h", "first.*")
    return going.withColumn("goes", F.lit(True)).unionByName(kept.withColumn("goes", F.lit(False)))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text freed of repeated passages; further columns lines_repeated and lines_removed (units: lines, sentences or pieces).

    A chunk of units with equal bytes, apart from white space at the ends of units, in several places of the table, in
    one document or many, is kept in its first place by (doc_id, hash of the text, place in it). The others go where
    they stand in a run of such chunks of MIN_CHARS code points or more. So every unit stays somewhere. The rest of a
    text stays byte for byte. lines_repeated counts the units of chunks that go or are the first place of one that goes.
    A null text stays null, an empty one empty; a text that repeats as a whole becomes empty. Rows that agree in doc_id
    and text are one document and keep or lose the same units. Null doc_ids come first. Other columns are carried along;
    columns named lines_repeated or lines_removed are replaced. An empty table gives no rows.
    """
    columns = [c for c in docs.columns if c not in ("lines_repeated", "lines_removed")]
    keyed = apart(docs.select(*columns)).withColumn("k", F.xxhash64("text"))
    # one pass over the texts leaves hashes only
    narrow = _placed(with_units(keyed.where(F.col("text") != "").select("doc_id", "k", "text")).drop("text"))
    hashes = materialize(narrow.select("doc_id", "k", "chunks"), "lines-hashes")
    if not hashes.groupBy("doc_id", "k").count().where(F.col("count") > 1).isEmpty():
        hashes = hashes.dropDuplicates(["doc_id", "k"])
    often = hashes.select(F.explode("chunks.h").alias("h")).groupBy("h").count().where(F.col("count") > 1).select("h")
    places = hashes.select("doc_id", "k", F.inline("chunks")).join(often.hint("shuffle_hash"), "h", "left_semi")
    places = materialize(places, "lines-places")
    refused = None
    while True:
        usable = places if refused is None else places.join(refused, "h", "left_anti")
        marks = _marks(usable).groupBy("doc_id", "k").agg(F.collect_list(F.struct("s", "n", "h", "goes")).alias("marks")).alias("m").hint("shuffle_hash")
        same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("d.k").eqNullSafe(F.col("m.k"))
        marked = materialize(keyed.alias("d").join(marks, same, "left").select("doc", "text", "marks"), "lines-marked")
        # the comparison of bytes: chunks of one hash must fall into one group
        rows = with_units(marked.where(F.col("marks").isNotNull()).select("text", "marks"))
        bodies = rows.select(F.explode(F.transform("marks", lambda m: F.struct(m["h"].alias("h"), F.transform(_units_of(m), _trimmed).alias("body")))).alias("c")).select("c.h", "c.body")
        unequal = bodies.groupBy("h", "body").agg(F.lit(1).alias("one")).groupBy("h").count().where(F.col("count") > 1).select("h")
        unequal = materialize(unequal, "lines-unequal")
        if unequal.isEmpty():
            break
        refused = unequal if refused is None else refused.unionByName(unequal)
    covered = lambda marks: F.flatten(F.transform(marks, lambda m: F.sequence(m["s"], m["s"] + m["n"] - 1)))
    counted = _once(marked, covered(F.filter("marks", lambda m: m["goes"])), "gone")
    met = F.coalesce(F.aggregate("marks", F.lit(0), lambda a, m: a + m["n"]), F.lit(0))
    counts = [met.alias("lines_repeated"), F.coalesce(F.size("gone"), F.lit(0)).alias("lines_removed")]
    # one pass: only texts that lose something are cut again
    touched = with_units(counted.withColumn("_changing", F.when(F.size("gone") > 0, F.col("text"))), "_changing")
    body = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("units") - 1), F.col("gone")), lambda i: F.get("units", i)), "")
    left = F.when(F.col("_changing").isNotNull(), body).otherwise(F.col("text"))
    return _once(touched, left, "left").select(*together(columns, F.col("left")), *counts)


def op1_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents without the passages that stand elsewhere before."""
    out = dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "lines_repeated", "lines_removed", F.length("text").cast("long").alias("n_chars"), "text")
