"""Stationary block bootstrap as tables of (rep, t, idx), joined to values.

Draws come from md5 of (stream, seed, replicate, position), so they are the same on every
engine and partitioning. The recursion, go on by one or begin a block anew, is the
distance to the last beginning: a window, not a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.config import Study


def uniform(stream: str, seed: int | Column, *parts: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an md5."""
    text = F.concat_ws(":", F.lit(stream), seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def indices(sizes: DataFrame, study: Study) -> DataFrame:
    """(n, seed, rep, t, idx) for each distinct n and seed in sizes: replicates of a sample of n positions from 0. Without a column seed it is the study's."""
    seeded = sizes if "seed" in sizes.columns else sizes.withColumn("seed", F.lit(study.seed))
    rows = seeded.select("n", "seed").where(F.col("n") > 0).distinct().select("n", "seed", F.explode(F.sequence(F.lit(0), F.lit(study.replicates - 1))).alias("rep"))
    rows = rows.select("n", "seed", "rep", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("t"))
    begins = (F.col("t") == 0) | (uniform("b", F.col("seed"), F.col("rep"), F.col("t")) < 1.0 / study.block)
    start = F.floor(uniform("s", F.col("seed"), F.col("rep"), F.col("t")) * F.col("n")).cast("int")
    w = Window.partitionBy("n", "seed", "rep").orderBy("t")
    last = F.last(F.when(begins, F.struct(F.col("t").alias("at"), start.alias("start"))), ignorenulls=True).over(w)
    return rows.withColumn("last", last).select("n", "seed", "rep", "t", F.pmod(F.col("last.start") + F.col("t") - F.col("last.at"), F.col("n")).cast("int").alias("idx"))


def numbered(values: DataFrame, by: list[str]) -> DataFrame:
    """values (by..., date, value) without nulls, with position t from 0 and group size n."""
    rows = values.where(F.col("value").isNotNull())
    w = Window.partitionBy(*by)
    return rows.withColumn("t", F.row_number().over(w.orderBy("date")) - 1).withColumn("n", F.count("*").over(w))


def replicate_means(values: DataFrame, by: list[str], study: Study) -> DataFrame:
    """(by..., n, rep, mean): the mean of each replicate. Groups of one size and seed share their draws; a column seed of values, constant for a group, replaces the study's."""
    seeded = values if "seed" in values.columns else values.withColumn("seed", F.lit(study.seed))
    rows = numbered(seeded, by).select(*by, "n", "seed", F.col("t").alias("idx"), "value")
    draws = indices(rows, study).groupBy("n", "seed", "rep", "idx").agg(F.count("*").alias("times"))
    return rows.join(draws, ["n", "seed", "idx"]).groupBy(*by, "n", "rep").agg((F.sum(F.col("value") * F.col("times")) / F.max("n")).alias("mean"))


def mean_interval(values: DataFrame, by: list[str], study: Study, confidence: float = 0.95) -> DataFrame:
    """(by..., n, point, lower, upper, excludes_zero): the sample mean with a percentile interval."""
    tail = (1 - confidence) / 2
    points = values.where(F.col("value").isNotNull()).groupBy(*by).agg(F.avg("value").alias("point"))
    q = F.percentile("mean", F.array(F.lit(tail), F.lit(1 - tail)))
    ranges = replicate_means(values, by, study).groupBy(*by, "n").agg(q.alias("q")).select(*by, "n", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))
    return points.join(ranges, by).withColumn("excludes_zero", (F.col("lower") > 0) | (F.col("upper") < 0)).select(*by, "n", "point", "lower", "upper", "excludes_zero")


def independent_differences(values: DataFrame, by: list[str], pairs: tuple[tuple[str, str], ...], column: str, study: Study, confidence: float = 0.95) -> DataFrame:
    """(by..., <column>_a, <column>_b, n_a, n_b, rate_a, rate_b, difference, lower, upper, separates) for pairs of groups of `column`, which have no day
    in common: both are resampled apart.

    Pair k draws with the study's seed + 2k for its first group and + 2k + 1 for its second. All pairs are one table with the pair in the key.
    Pairs of which a group has no values have no row.
    """
    tail = (1 - confidence) / 2
    sides = [F.struct(F.lit(k).alias("pair"), F.lit(side).alias("side"), F.lit(name).alias("group"), F.lit(study.seed + 2 * k + side).alias("seed")) for k, pair in enumerate(pairs) for side, name in enumerate(pair)]
    rows = values.where(F.col("value").isNotNull()).select(*by, "date", "value", column, F.explode(F.array(*sides)).alias("s")).where(F.col(column) == F.col("s.group"))
    rows = rows.select(*by, "date", "value", "s.pair", "s.side", "s.seed")
    own = [*by, "pair", "side"]
    signed = F.when(F.col("side") == 0, F.col("mean")).otherwise(-F.col("mean"))
    both = replicate_means(rows, own, study).groupBy(*by, "pair", "rep").agg(F.sum(signed).alias("d"), F.count("*").alias("sides")).where(F.col("sides") == 2)
    ranges = both.groupBy(*by, "pair").agg(F.percentile("d", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    of = lambda side, f: f(F.when(F.col("side") == side, F.col("value")))
    points = rows.groupBy(*by, "pair").agg(of(0, F.count).alias("n_a"), of(1, F.count).alias("n_b"), of(0, F.avg).alias("rate_a"), of(1, F.avg).alias("rate_b"))
    names = [F.element_at(F.array(*[F.lit(p[side]) for p in pairs]), F.col("pair") + 1).alias(f"{column}_{x}") for side, x in enumerate("ab")]
    out = points.join(ranges, [*by, "pair"]).select(*by, *names, "n_a", "n_b", "rate_a", "rate_b", (F.col("rate_a") - F.col("rate_b")).alias("difference"), F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))
    return out.withColumn("separates", (F.col("lower") > 0) | (F.col("upper") < 0))
