"""Connected components of a graph of long node ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import materialize

#: Rounds grow with the logarithm of the longest path; this many are never needed.
MAX_ROUNDS = 60


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1))).alias("h")).first()
    return r["n"], r["h"] or 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): for every node that stands in an edge (a, b), the smallest node it can reach.

    Loops and repeated edges are allowed. Each round rewrites the edges towards smaller neighbours with partial
    minima and equi-joins, and is written to the shared folder; no component is ever gathered in one place.
    """
    edges = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "cc-0")
    mark = _mark(edges)
    for n in range(1, MAX_ROUNDS):
        # large star: a node's greater neighbours hang on its smallest neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node's smaller neighbours hang on the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        turned = small.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(turned.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), f"cc-{n}")
        last, mark = mark, _mark(edges)
        if mark == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots.select("node", F.col("node").alias("label")))
