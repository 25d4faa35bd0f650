"""Convergence of chains of draws: rank-normalised split R-hat, effective sizes of the middle and of the tails, and a verdict.

Draws are a long table (by..., chain, draw, value). Every chain is cut into halves. Autocovariances are summed by blocks of lags, one job a block,
and only for parameters whose sum of neighbouring autocorrelations is still positive, so chains that mix well cost one block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.expressions import normal_quantile
from tidewater.operators.guards import refuse
from tidewater.sources.store import written

# The limits of the verdict.
MAX_R_HAT, MIN_ESS_TAIL, MAX_DIVERGENCES = 1.01, 400.0, 0
#: Lags a job; even, as lags are taken in pairs.
LAGS = 32
TAILS = (0.05, 0.95)


def long_draws(draws: DataFrame, parameters: tuple[str, ...] = ("mu", "omega", "alpha", "beta", "nu")) -> DataFrame:
    """(series, parameter, chain, draw, value) of a table with a column for each parameter. delta, which is sampled and makes beta (1 - alpha) delta, is one of them."""
    names = [F.struct(F.lit(x).alias("parameter"), F.col(x).cast("double").alias("value")) for x in parameters]
    delta = F.struct(F.lit("delta").alias("parameter"), (F.col("beta") / (1 - F.col("alpha"))).alias("value"))
    return draws.select("series", "chain", "draw", F.explode(F.array(*names, delta)).alias("p")).select("series", "p.parameter", "chain", "draw", "p.value")


def halves(draws: DataFrame, by: list[str]) -> DataFrame:
    """(by..., kind, piece, t, n, x): first and last halves of all chains, the middle draw of an odd number left out, in four forms.

    `bulk` and `folded` are normal scores of average ranks, of the values and of their distances from the median; `low` and `high` say
    whether a value is at most the 5 or the 95 per cent quantile. Chains of unequal length, and a repeated draw of a chain, are refused.
    """
    key = Window.partitionBy(*by)
    chain = Window.partitionBy(*by, "chain")
    rows = draws.select(*by, "chain", "draw", F.col("value").cast("double").alias("value")).withColumn("size", F.count("*").over(chain))
    rows = rows.withColumn("at", F.row_number().over(chain.orderBy("draw")) - 1).withColumn("repeated", F.lag("draw").over(chain.orderBy("draw")) == F.col("draw"))
    rows = rows.withColumn("other", F.max("size").over(key) != F.min("size").over(key))
    rows = refuse(rows, F.col("other") | F.col("repeated"), "chains differ in length or repeat a draw")
    finite = F.count(F.when(~F.isnan("value") & (F.abs("value") < float("inf")), 1)).over(key) == F.count("*").over(key)
    whole = rows.withColumn("finite", finite).where("finite")
    cuts = whole.groupBy(*by).agg(F.percentile("value", F.array(*[F.lit(q) for q in (TAILS[0], 0.5, TAILS[1])])).alias("cut"))
    half = F.floor(F.col("size") / 2).cast("int")
    second = F.col("at") >= F.col("size") - half
    pieces = whole.withColumn("n", half).where((F.col("at") < half) | second).withColumn("side", F.when(second, 1).otherwise(0))
    pieces = pieces.withColumn("t", F.col("at") - F.col("side") * (F.col("size") - half)).withColumn("piece", F.struct("chain", "side"))
    # distances are compared in the width of the draws, so that the last digit of the median doesn't make ties unlike
    width = F.coalesce(F.nullif(F.col("cut")[2] - F.col("cut")[0], F.lit(0.0)), F.lit(1.0))
    marks = F.array(
        F.struct(F.lit("bulk").alias("kind"), F.col("value").alias("x")),
        F.struct(F.lit("folded").alias("kind"), F.round(F.abs(F.col("value") - F.col("cut")[1]) / width, 12).alias("x")),
        *[F.struct(F.lit(k).alias("kind"), (F.col("value") <= F.col("cut")[i]).cast("double").alias("x")) for k, i in (("low", 0), ("high", 2))],
    )
    # the median of the halves, not of what was cut out in the middle
    middle = pieces.groupBy(*by).agg(F.percentile("value", F.lit(0.5)).alias("middle"))
    joined = pieces.join(cuts, by).join(middle, by).withColumn("cut", F.array(F.col("cut")[0], F.col("middle"), F.col("cut")[2]))
    forms = joined.select(*by, "piece", "t", "n", F.explode(marks).alias("m")).select(*by, "piece", "t", "n", "m.kind", "m.x")
    of = Window.partitionBy(*by, "kind")
    ties = F.count("*").over(Window.partitionBy(*by, "kind", "x"))
    score = normal_quantile((F.rank().over(of.orderBy("x")) + (ties - 1) / 2 - 0.375) / (F.count("*").over(of) + 0.25))
    ranked = forms.where(F.col("kind").isin("bulk", "folded")).withColumn("x", score)
    return ranked.unionByName(forms.where(F.col("kind").isin("low", "high"))).select(*by, "kind", "piece", "t", "n", "x")


def spreads(pieces: DataFrame, by: list[str]) -> DataFrame:
    """(by..., kind, n, draws, within, between): mean variance of the pieces, and variance of their means."""
    each = pieces.groupBy(*by, "kind", "piece").agg(F.count("*").alias("n"), F.var_samp("x").alias("v"), F.avg("x").alias("mean"))
    return each.groupBy(*by, "kind").agg(F.max("n").alias("n"), F.sum("n").alias("draws"), F.avg("v").alias("within"), F.var_samp("mean").alias("between"))


def _pairs_of_lags(pieces: DataFrame, moments: DataFrame, by: list[str], first: int, lags: int) -> DataFrame:
    """(by..., kind, k, even, total) for the pairs (2k, 2k + 1) of lags in first .. first + lags - 1: correlation at the even lag, and of both."""
    own = [*by, "kind"]
    centred = pieces.withColumn("c", F.col("x") - F.avg("x").over(Window.partitionBy(*own, "piece")))
    ahead = Window.partitionBy(*own, "piece").orderBy("t").rowsBetween(first, first + lags - 1)
    products = centred.withColumn("next", F.collect_list("c").over(ahead)).select(*own, "piece", "n", F.posexplode(F.transform("next", lambda y: F.col("c") * y)).alias("lag", "y"))
    sums = products.groupBy(*own, "piece", "lag").agg((F.sum("y") / F.max("n")).alias("cov")).groupBy(*own, "lag").agg(F.avg("cov").alias("cov"))
    over = F.col("within") * (F.col("n") - 1) / F.col("n") + F.col("between")
    rho = sums.withColumn("lag", F.col("lag") + first).join(moments, own).withColumn("rho", F.when(F.col("lag") == 0, 1.0).otherwise(1 - (F.col("within") - F.col("cov")) / over))
    return rho.groupBy(*own, F.floor(F.col("lag") / 2).alias("k")).agg(F.max(F.when(F.col("lag") % 2 == 0, F.col("rho"))).alias("even"), F.sum("rho").alias("total"), F.count("*").alias("both")).where("both = 2").drop("both")


def effective_sizes(pieces: DataFrame, moments: DataFrame, by: list[str], lags: int = LAGS) -> DataFrame:
    """(by..., kind, ess): draws over the correlation time, by the first positive and then falling sums of pairs of lags.

    A kind that never varies counts all its draws; below four draws a piece there is no size.
    """
    own = [*by, "kind"]
    moments = moments.where((F.col("kind") != "folded") & (F.col("n") >= 4)).withColumn("last", F.floor((F.col("n") - 3) / 2))
    moving = written(moments.where((F.col("within") > 0) | (F.col("between") > 0)), "moments")
    longest = moving.agg(F.max("last")).first()[0]
    rounds, going, first = [], moving.select(*own), 0
    while longest is not None and first <= 2 * longest + 1:
        pairs = written(_pairs_of_lags(pieces.join(going, own, "left_semi"), moving, by, first, lags), "lag-pairs")
        rounds.append(pairs)
        going, first = going.join(pairs.where("total <= 0"), own, "left_anti"), first + lags
        if going.isEmpty():
            break
    constant = moments.join(moving, own, "left_anti").select(*own, F.col("draws").cast("double").alias("ess"))
    if not rounds:
        return constant
    pairs = reduce(DataFrame.unionByName, rounds).join(moving.select(*own, "draws", "last"), own).where(F.col("k") <= F.col("last"))
    stop = F.coalesce(F.min(F.when(F.col("total") <= 0, F.col("k"))).over(Window.partitionBy(*own)), F.col("last"))
    falling = F.min("total").over(Window.partitionBy(*own).orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    end = F.when((F.col("even") > 0) | (F.col("total") >= 0), F.col("even")).otherwise(0.0)
    tau = pairs.withColumn("stop", stop).withColumn("falling", falling).where(F.col("k") <= F.col("stop")).withColumn("part", F.when(F.col("k") < F.col("stop"), 2 * F.col("falling")).otherwise(end))
    sizes = tau.groupBy(*own).agg((F.sum("part") - 1).alias("tau"), F.max("draws").alias("draws"))
    return sizes.select(*own, (F.col("draws") / F.greatest(F.col("tau"), 1 / F.log10(F.col("draws").cast("double")))).alias("ess")).unionByName(constant)


def convergence(draws: DataFrame, by: list[str], lags: int = LAGS) -> DataFrame:
    """(by..., n_chains, n_draws, r_hat, ess_bulk, ess_tail) for each parameter of a long table of draws.

    R-hat is the larger of those of values and of distances from the median, null where nothing varies within the pieces. A parameter with a
    null or infinite draw has its row, with null statistics.
    """
    draws = written(draws.select(*by, "chain", "draw", "value"), "draws")
    counts = draws.groupBy(*by).agg(F.count_distinct("chain").alias("n_chains"), F.count("*").alias("n_draws"))
    pieces = written(halves(draws, by), "pieces")
    moments = spreads(pieces, by)
    r_hat = moments.where(F.col("kind").isin("bulk", "folded") & (F.col("n") >= 4)).groupBy(*by).agg(F.max(F.sqrt(F.col("between") / F.nullif(F.col("within"), F.lit(0.0)) + (F.col("n") - 1) / F.col("n"))).alias("r_hat"))
    ess = effective_sizes(pieces, moments, by, lags).groupBy(*by).agg(F.max(F.when(F.col("kind") == "bulk", F.col("ess"))).alias("ess_bulk"), F.min(F.when(F.col("kind") != "bulk", F.col("ess"))).alias("ess_tail"))
    return counts.join(r_hat, by, "left").join(ess, by, "left").select(*by, "n_chains", "n_draws", "r_hat", "ess_bulk", "ess_tail")


def verdicts(diagnostics: DataFrame, by: list[str], divergences: DataFrame | None = None) -> DataFrame:
    """(by..., worst_r_hat, worst_ess_tail, n_divergences, converged): all parameters of a fit at once. A missing statistic is a failure.

    divergences has (by..., n_divergences); a fit without a row has none.
    """
    fails = F.coalesce(F.col("r_hat") > MAX_R_HAT, F.lit(True)) | F.coalesce(F.col("ess_tail") < MIN_ESS_TAIL, F.lit(True))
    out = diagnostics.groupBy(*by).agg(F.max("r_hat").alias("worst_r_hat"), F.min("ess_tail").alias("worst_ess_tail"), F.max(fails).alias("fails"))
    out = out.join(divergences, by, "left").withColumn("n_divergences", F.coalesce("n_divergences", F.lit(0))) if divergences is not None else out.withColumn("n_divergences", F.lit(0))
    return out.select(*by, "worst_r_hat", "worst_ess_tail", F.col("n_divergences").cast("long").alias("n_divergences"), (~F.col("fails") & (F.col("n_divergences") <= MAX_DIVERGENCES)).alias("converged"))
