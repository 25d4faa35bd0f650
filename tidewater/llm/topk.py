"""Exact top-k search by multi-resolution segment statistics.

For two vectors cut into the same segments, the squared distance is at least
``sum(len * ((mean_q - mean_x)**2 + (dev_q - dev_x)**2))``; with the norms on
both sides this is the same statement as the upper bound
``q.x <= sum(len * (mean_q * mean_x + dev_q * dev_x))`` on the inner product.
Bounds are taken coarse to fine; candidates whose bound falls below the query's
k-th best score so far are dropped, and the rest are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import materialize, read_table

#: Bytes of query vectors sent to executors at once; more queries go in further blocks.
QUERY_BLOCK_BYTES = 32 << 20
#: Candidates bounded together.
ROWS = 2048
#: Share of pairs alive from which a level is computed for all pairs by one matrix product.
DENSE = 0.02

_PAIRS = "block int, q int, query_id long, vec_id long, score long"


def quantize(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, z): each component as floor(scale * x). Vectors that are null, or hold null or
    non-finite components, and rows without vec_id take no part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    z = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & fine).select("vec_id", z.alias("z"))


class _Queries:
    """Queries of one dimension: values, and their segment statistics at each level."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, z: np.ndarray, k: int):
        self.ids, self.at, self.z, self.k = ids, at, z, k
        self.f = z.astype(np.float64)
        self.cuts = _cuts(z.shape[1])
        self.stats = [_stats(self.f, c) for c in self.cuts]
        self.kth = np.full(len(ids), -np.inf)
        self.best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))  # query, score, vec_id

    def offer(self, ids: np.ndarray, z: np.ndarray) -> None:
        f = z.astype(np.float64)
        alive = self.ids[:, None] != ids[None, :]
        pairs = None
        for cut, mine in zip(self.cuts, self.stats):
            theirs = _stats(f, cut)
            slack = 1.0 + 1e-9 * np.sqrt((mine**2).sum(1).max(initial=0) * (theirs**2).sum(1).max(initial=0))
            least = self.kth - slack
            if pairs is None:
                alive &= mine @ theirs.T >= least[:, None]
                if np.count_nonzero(alive) < DENSE * alive.size:
                    pairs = np.nonzero(alive)
            else:
                q, x = pairs
                ok = np.einsum("ij,ij->i", mine[q], theirs[x]) >= least[q]
                pairs = q[ok], x[ok]
        top = float(np.abs(self.f).max(initial=0)) * float(np.abs(f).max(initial=0)) * max(1, z.shape[1])
        if pairs is None and top < 2.0**52:  # sums of integers this small are exact in doubles
            exact = self.f @ f.T
            alive &= exact >= self.kth[:, None]
            q, x = np.nonzero(alive)
            score = exact[q, x].astype(np.int64)
        else:
            q, x = np.nonzero(alive) if pairs is None else pairs
            score = np.empty(len(q), np.int64)
            for i in range(0, len(q), 1 << 16):
                s = slice(i, i + (1 << 16))
                score[s] = np.einsum("ij,ij->i", self.z[q[s]], z[x[s]])
        q, score, v = (np.concatenate(p) for p in zip(self.best, (q, score, ids[x])))
        order = np.lexsort((v, -score, q))
        q, score, v = q[order], score[order], v[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.best = q[keep], score[keep], v[keep]
        last = rank[keep] == self.k - 1
        self.kth[self.best[0][last]] = self.best[1][last]


def _cuts(dim: int) -> list[np.ndarray]:
    """Starts of 2, 8, 32, ... segments, each of two components at least."""
    counts = [c for c in (2, 8, 32, 128, 512) if 2 * c <= dim]
    return [np.linspace(0, dim, c, endpoint=False).astype(np.int64) for c in counts]


def _stats(f: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Means and deviations of the segments, scaled so that a dot product is the bound."""
    lengths = np.diff(np.append(starts, f.shape[1]))
    mean = np.add.reduceat(f, starts, axis=1) / lengths
    square = np.add.reduceat((f - np.repeat(mean, lengths, axis=1)) ** 2, starts, axis=1)
    return np.hstack([mean * np.sqrt(lengths), np.sqrt(square)])


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) for each dimension in the batch."""
    ids, z = batch.column("vec_id").to_numpy(), batch.column("z")
    flat, ends = z.flatten().to_numpy(), np.cumsum(z.value_lengths().to_numpy())
    sizes = np.diff(ends, prepend=0)
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield ids[at], flat[(ends[at] - dim)[:, None] + np.arange(dim)]


def _search(shared, block: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, _Queries] = {}
        for dim, (ids, at, z) in shared.value.items():
            state[dim] = _Queries(ids, at, z, k)
        for batch in batches:
            for ids, z in _vectors(batch):
                if own := state.get(z.shape[1]):
                    for i in range(0, len(ids), ROWS):
                        own.offer(ids[i : i + ROWS], z[i : i + ROWS])
        for own in state.values():
            q, score, v = own.best
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(q), block, np.int32)), pa.array(own.at[q].astype(np.int32)), pa.array(own.ids[q]), pa.array(v), pa.array(score)],
                names=["block", "q", "query_id", "vec_id", "score"],
            )

    return run


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, block_bytes: int = QUERY_BLOCK_BYTES) -> DataFrame:
    """The k candidates of highest integer inner product for every query.

    Both tables have vec_id (long, no nulls) and z (array of long). Every query meets every candidate
    of its dimension, but for those with its own vec_id. Queries go to the executors in blocks of at
    most about block_bytes; each task keeps k rows a query, and one window merges them.
    Returns (query_id, rank, vec_id, score); ties go to the smaller vec_id. A query row that
    stands twice in the table is answered twice. Fewer than k candidates: all of them. No queries: no rows.
    """
    spark = candidates.sparkSession
    queries = materialize(queries.select("vec_id", "z"), "topk-queries")
    total = queries.agg(F.coalesce(F.sum(F.size("z") * 8 + 8), F.lit(0)).alias("b")).first()["b"]
    blocks = max(1, -(-total // block_bytes))
    found = []
    for b in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("vec_id", "z"), F.lit(blocks)) == b).toArrow()
        value, at = {}, 0
        for batch in mine.to_batches():
            for ids, z in _vectors(batch):
                old = value.get(z.shape[1])
                new = (ids, np.arange(at, at + len(ids)), z)
                value[z.shape[1]] = new if old is None else tuple(np.concatenate(p) for p in zip(old, new))
                at += len(ids)
        # each block is searched and written before the driver takes up the next one
        shared = spark.sparkContext.broadcast(value)
        found.append(materialize(candidates.select("vec_id", "z").mapInArrow(_search(shared, b, k), _PAIRS), "topk-found"))
        shared.destroy()
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionAll(more)
    w = Window.partitionBy("block", "q").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: vec_id divisible by 50, against every other row of embeddings; 5 each."""
    rows = quantize(read_table(spark, sf_dir, "embeddings"))
    return exact_top_k(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS z
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum([q.z[i] * c.z[i] FOR i IN generate_series(1, len(q.z))]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
