"""Filter interaction audit by a permutation trie.

Every order of the filters is a path in a trie whose nodes are survivor frames.
What survives depends only on the set of filters applied, so orders share nodes:
the trie is walked depth first, a node is visited once, and while its frame is
persisted the rows that each remaining filter removes there are counted. Of n
filters there are 2^n nodes and n * 2^(n-1) edges for n! orders.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import materialize, read_table

# The filters in the order of their letters, and their thresholds.
FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_UPPER_PERCENT = 2
_WORD = r"[^\x20\x09-\x0D]+"
_SIGNS = r"[#$%&*|]"


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic) of every row of docs, written to the shared folder; bit i of fails is set if filter i fails.

    Null texts are empty, and a null source is the part of the empty string. A row is a copy if a smaller doc_id has the
    same text anywhere in the table; null doc_ids are neither copies nor originals. Texts are the same if their SHA-256
    is. Of repeated labels of one doc_id a 1 wins; rows without label are neither good nor toxic. Columns other than
    doc_id, text and source play no part.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)).alias("words"))
    distinct = F.size(F.array_distinct("words"))
    short = F.size("words") < LEAST_WORDS
    dull = 100 * distinct < LEAST_DISTINCT_PERCENT * F.size("words")
    loud = 100 * F.regexp_count("text", F.lit("[A-Z]")) > MOST_UPPER_PERCENT * F.length("text")
    signs = F.col("text").rlike(_SIGNS)
    bits = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate((short, dull, loud, signs))), F.lit(0))
    told = own.select("doc_id", "part", bits.alias("fails"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("byte")).alias("good"), F.max((F.col("toxic") == 1).cast("byte")).alias("toxic"))
    rows = materialize(told.join(marks, "doc_id", "left").select("doc_id", "part", "fails", "digest", "good", "toxic"), "audit-rows")
    # written out, so that the join deals both sides anew and can split a text that many rows share
    firsts = materialize(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where(F.col("n") > 1).select("digest", "first"), "audit-firsts")
    copy = F.when(F.col("doc_id") > F.col("first"), F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0))
    zero = F.lit(0).cast("byte")
    joined = rows.join(firsts, "digest", "left").select("part", (F.col("fails") + copy).alias("fails"), F.coalesce("good", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic"))
    return materialize(joined, "audit-verdicts")


def _fails(i: int) -> str:
    return f"(fails & {1 << i}) <> 0"


def trie_edges(rows: DataFrame, n: int) -> DataFrame:
    """(part, state, filter, before, removed, good, toxic): for every set of applied filters (bits of state) that leaves
    rows of a part, and every filter not in it, the survivors and what the filter removes of them.

    Depth first, with a survivor frame persisted as long as the walk is in its branch, so at most n frames are held.
    """
    seen: dict[int, DataFrame] = {}

    def visit(state: int, frame: DataFrame) -> None:
        frame = frame.persist(StorageLevel.MEMORY_AND_DISK)
        left = [i for i in range(n) if not state >> i & 1]
        # as one expression of text: thousands of column objects cost more than the counts
        removed = [f"{i} AS filter, count_if({_fails(i)}) AS removed, count_if({_fails(i)} AND good = 1) AS good, count_if({_fails(i)} AND toxic = 1) AS toxic" for i in left]
        told = frame.groupBy("part").agg(F.count("*").alias("before"), F.expr(f"array({', '.join(f'struct({x})' for x in removed)})").alias("edges"))
        seen[state] = materialize(told.select("part", F.lit(state).alias("state"), "before", F.inline("edges")), f"audit-state-{state}")
        for i in left:
            further = state | 1 << i
            if further not in seen and further != (1 << n) - 1:
                visit(further, frame.where(f"NOT {_fails(i)}"))
        frame.unpersist()

    visit(0, rows)
    frames = list(seen.values())
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def audit(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from the rows (part, fails, good, toxic) of verdicts.

    Returns (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley). Parts of
    which nothing is left have rows of zeros. An empty table gives no rows.
    """
    n = len(filters)
    every = (1 << n) - 1
    zero = F.lit(0).cast("long")
    edges = trie_edges(rows, n).select("part", (F.col("state") * n + F.col("filter")).alias("edge"), F.struct("before", "removed", "good", "toxic").alias("found"))
    # at most n * 2^(n-1) edges a part
    by_part = edges.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("edge", "found"))).alias("edges"))

    def at(edge: Column, field: str) -> Column:
        return F.coalesce(F.try_element_at("edges", edge).getField(field), zero)

    def removed(state: int, i: int) -> Column:
        return at(F.lit(state * n + i), "removed")

    def shapley(i: int) -> Column:
        states = [s for s in range(every + 1) if not s >> i & 1]
        weights = [factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) for s in states]
        return sum((removed(s, i) * w for s, w in zip(states, weights)), zero)

    of_filter = F.array(*[F.struct(removed(0, i).alias("fails"), removed(every ^ 1 << i, i).alias("alone"), shapley(i).alias("shapley")) for i in range(n)])
    steps = []
    for order in permutations(range(n)):
        state = 0
        for step, i in enumerate(order):
            steps.append(("".join(filters[x] for x in order), step + 1, state, i))
            state |= 1 << i
    lines = F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","k":{k},"s":{s},"f":{f}}}' for o, k, s, f in steps) + "]"), "array<struct<o: string, k: int, s: int, f: int>>")
    spread = by_part.select("part", "edges", of_filter.alias("of_filter")).select("part", "edges", "of_filter", F.inline(lines))
    edge = F.col("s") * n + F.col("f")
    own = F.element_at("of_filter", F.col("f") + 1)
    return spread.select(
        "part", F.col("o").alias("filter_order"), F.col("k").alias("step"), (at(edge, "before") - at(edge, "removed")).alias("kept"), at(edge, "removed").alias("removed"),
        (own["fails"] - at(edge, "removed")).alias("redundant"), own["alone"].alias("unique_fails"), at(edge, "good").alias("good_lost"), at(edge, "toxic").alias("toxic_lost"), own["shapley"].alias("shapley"),
    )


def op13_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of five filters over whole documents, by source."""
    return audit(verdicts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))


OP13_SQL = r"""
WITH own AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
        doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS copied
    FROM documents),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
told AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * list_unique(ws) < 50 * len(ws) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN copied THEN 16 ELSE 0 END AS fails
    FROM own LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM told GROUP BY part, fails),
letters(x, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps AS (SELECT filter_order, CAST(k AS INT) AS step, bits[k] AS bit, CAST(list_sum(bits[1:k]) AS INT) - bits[k] AS before FROM orders, range(1, 6) AS r(k)),
counted AS (
    SELECT part, filter_order, step, bit,
        sum(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN fails & before <> 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""
