"""First-order linear recurrences h[t] = a * h[t-1] + b[t-1] as windows and one short fold over blocks.

Within a block the recurrence is a running sum of b scaled by powers of a; blocks are
bounded, so the powers stay finite however long a series is. What a block hands on
is folded over the blocks of a series: one number for every BLOCK rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 200


def linear_recurrence(rows: DataFrame, a: float, b: str, seed: str, keys: tuple[str, ...] = ("series",), order: str = "date", name: str = "h", block: int = BLOCK) -> DataFrame:
    """rows with column `name`: seed at the first row of a key, then a * previous + b of the row before.

    A null b leaves the value as it was for the next row. `seed` is a column that is constant for a key.
    """
    if not 0 < a < 1:
        raise ValueError(f"the decay must lie between 0 and 1: {a}")
    w = Window.partitionBy(*keys).orderBy(order)
    numbered = rows.withColumn("_block", F.floor((F.row_number().over(w) - 1) / block))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    upto, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    counted = numbered.withColumn("_j", F.count(b).over(upto))
    scaled = F.col(b) * F.pow(F.lit(a), -F.col("_j"))
    # value before row t, had the block begun with 0: a**m * sum(b * a**-j) over the rows before it
    state = counted.withColumn("_m", F.count(b).over(before)).withColumn("_own", F.pow(F.lit(a), F.col("_m")) * F.coalesce(F.sum(scaled).over(before), F.lit(0.0)))
    ends = counted.withColumn("_scaled", scaled).groupBy(*keys, "_block").agg(F.max("_j").alias("m"), F.sum("_scaled").alias("s"), F.max(seed).alias("seed"))
    step = F.struct("_block", F.pow(F.lit(a), F.col("m")).alias("decay"), (F.pow(F.lit(a), F.col("m")) * F.coalesce("s", F.lit(0.0))).alias("add"))
    chain = ends.groupBy(*keys).agg(F.array_sort(F.collect_list(step)).alias("steps"), F.max("seed").alias("seed"))
    none = F.array().cast("array<double>")
    starts = F.aggregate(
        "steps", F.struct(none.alias("out"), F.col("seed").cast("double").alias("h")), lambda acc, x: F.struct(F.array_append(acc["out"], acc["h"]).alias("out"), (x["decay"] * acc["h"] + x["add"]).alias("h"))
    )["out"]
    carried = chain.select(*keys, F.posexplode(starts).alias("_at", "_start")).withColumn("_block", F.col("_at").cast("long")).drop("_at")
    joined = state.join(carried, [*keys, "_block"])
    return joined.withColumn(name, F.pow(F.lit(a), F.col("_m")) * F.col("_start") + F.col("_own")).drop("_block", "_j", "_m", "_own", "_start")


#: Rows of a block of affine maps, and blocks of a block of blocks.
SCAN_BLOCK = 64


def affine_scan(rows: DataFrame, a: str, b: str, seed: str, at: str, keys: tuple[str, ...] = ("series",), name: str = "h", block: int = SCAN_BLOCK, many: bool = False) -> DataFrame:
    """rows with column `name`: seed at position 0 of a key, then a * previous + b, both of the row before.

    Unlike linear_recurrence, a is a column, too, so every key may decay in its own way, or every row. `at` numbers the rows of a key
    from 0; `seed` is constant for a key. Maps of rows are composed within blocks, those of blocks within blocks of blocks, and
    these are folded from the seed on, so no row of the plan holds more than `block` rows or a key's n / block^2 numbers. A
    null a or b makes all later values null. With many, b and seed are arrays of one length, as is the result: several recurrences
    that decay alike.
    """
    kind = "array<double>" if many else "double"
    plus = (lambda f, v, w: f"zip_with({v}, {w}, (u, z) -> {f} * u + z)") if many else (lambda f, v, w: f"{f} * {v} + {w}")
    own = rows.withColumn("_blk", F.floor(F.col(at) / block))
    packed = own.groupBy(*keys, "_blk").agg(
        F.array_sort(F.collect_list(F.struct(F.col(at).alias("_at"), F.col(a).cast("double").alias("_a"), F.col(b).cast(kind).alias("_b"), F.struct(*rows.columns).alias("_row")))).alias("_rows"),
        F.max(F.col(seed).cast(kind)).alias("_seed"),
    )
    # of the seed, so that both may become null: what a fold begins with says what it can hold
    none = f"named_struct('a', 1D + 0 * {'_seed[0]' if many else '_seed'}, 'b', {'transform(_seed, u -> 0 * u)' if many else '0 * _seed'})"
    composed = lambda now: f"named_struct('a', x._a * {now}.a, 'b', {plus('x._a', f'{now}.b', 'x._b')})"
    packed = packed.withColumn("_map", F.expr(f"aggregate(_rows, {none}, (s, x) -> {composed('s')})"))
    # maps from the beginning of a block of blocks to the beginning of each of its blocks
    upper = packed.select(*keys, "_blk", "_map", "_seed").groupBy(*keys, F.floor(F.col("_blk") / block).alias("_top")).agg(
        F.expr("array_sort(collect_list(struct(_blk, _map.a AS _a, _map.b AS _b)))").alias("_blocks"), F.max("_seed").alias("_seed")
    )
    before = f"aggregate(_blocks, named_struct('out', cast(array() AS array<struct<a: double, b: {kind}>>), 'now', {none}), (s, x) -> named_struct('out', array_append(s.out, s.now), 'now', {composed('s.now')}))"
    upper = upper.withColumn("_scan", F.expr(before))
    starts = upper.groupBy(*keys).agg(F.expr("array_sort(collect_list(struct(_top, _scan.now.a AS _a, _scan.now.b AS _b)))").alias("_tops"), F.max("_seed").alias("_seed"))
    fold = lambda items, first: f"aggregate({items}, named_struct('out', cast(array() AS array<{kind}>), 'h', {first}), (s, x) -> named_struct('out', array_append(s.out, s.h), 'h', {plus('x._a', 's.h', 'x._b')})).out"
    starts = starts.selectExpr(*keys, f"posexplode({fold('_tops', '_seed')}) AS (_p, _start)").selectExpr(*keys, "CAST(_p AS BIGINT) AS _top", "_start")
    of_blocks = upper.join(starts, [*keys, "_top"]).withColumn("_before", F.col("_scan.out")).selectExpr(*keys, "_start", "inline(arrays_zip(_blocks, _before))")
    of_blocks = of_blocks.selectExpr(*keys, "_blocks._blk AS _blk", f"{plus('_before.a', '_start', '_before.b')} AS _begin")
    zipped = packed.join(of_blocks, [*keys, "_blk"]).withColumn("_h", F.expr(fold("_rows", "_begin"))).select(F.expr("inline(arrays_zip(_rows, _h))"))
    return zipped.select("_rows._row.*", F.col("_h").alias(name))
