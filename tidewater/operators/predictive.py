"""Predictive distributions over parameter draws: variances for each draw, Student-t quantiles, and mixtures of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.config import Study, level_key
from tidewater.functions import distributions
from tidewater.operators.derive import by_date, split
from tidewater.operators.forecasts import refit_ids, seed_variance
from tidewater.operators.guards import refuse
from tidewater.operators.recurrence import affine_scan
from tidewater.operators.resampling import uniform

#: Parameters of a draw.
PARAMETERS = ("mu", "omega", "alpha", "beta", "nu")


def draws_around(spread_from: DataFrame, theta: tuple[float, ...], spread: tuple[float, ...], n: int, seed: int) -> DataFrame:
    """(series, draw, mu, omega, alpha, beta, nu): n draws for each series of spread_from, evenly spread by md5 streams around theta."""
    rows = spread_from.select("series").distinct().select("series", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    return rows.select("series", "draw", *[(F.lit(t) + s * (2 * uniform(name, seed, F.col("draw")) - 1)).alias(name) for name, t, s in zip(PARAMETERS, theta, spread)])


def draw_means(draws: DataFrame) -> DataFrame:
    """(series, draw, ...): one draw, -1, of the mean of each parameter."""
    return draws.groupBy("series").agg(*[F.avg(c).alias(c) for c in PARAMETERS]).withColumn("draw", F.lit(-1))


def per_draw_variances(framed: DataFrame, draws: DataFrame, study: Study) -> DataFrame:
    """Out-of-sample rows (series, date, draw, variance, parameters, log_return, refit_id) with the conditional variance at each draw's parameters.

    The filter begins with the training variance at the first return; a null return makes what follows null, other
    than before the first. Draws must be admissible: a positive variance that reverts, nu above 2.
    """
    checked = refuse(draws, ~((F.col("omega") > 0) & (F.col("alpha") >= 0) & (F.col("beta") >= 0) & (F.col("alpha") + F.col("beta") < 1) & (F.col("nu") > 2)), "a draw has no finite variance")
    seen = F.count("log_return").over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    rows = framed.select("series", "date", "log_return").withColumn("seen", seen).where(F.col("seen") > 0).drop("seen")
    rows = rows.withColumn("at", F.row_number().over(by_date()) - 1).join(seed_variance(framed, study), "series")
    each = rows.join(checked, "series").withColumn("shock", F.col("omega") + F.col("alpha") * F.pow(F.col("log_return") - F.col("mu"), 2))
    paths = affine_scan(each, "beta", "shock", "h0", "at", ("series", "draw"), "variance")
    served = refit_ids(framed, study).select("series", "date", "refit_id")
    return paths.join(served, ["series", "date"]).select("series", "date", "refit_id", "draw", "variance", *PARAMETERS, "log_return")


def probabilities(study: Study) -> dict[str, float]:
    """Column names of predictive quantiles with their probabilities."""
    sides = {f"{s}_{level_key(x)}": round(0.5 + sign * x / 2, 10) for x in study.levels for s, sign in (("lo", -1), ("hi", 1))}
    return sides | {"var_99": round(1 - study.var_level, 10)}


def t_quantiles(nus: DataFrame, by: list[str], study: Study) -> DataFrame:
    """(by..., nu, q_<name>): quantiles of Student's t for each distinct nu, so that they are found once and not for each day."""
    names = probabilities(study)
    # one copy of the quantile's expression, whatever the number of levels
    found = F.expr(f"transform(array({', '.join(f'{p}D' for p in names.values())}), p -> {distributions.t_quantile('p', 'nu')})")
    return nus.select(*by, "nu").distinct().select(*by, "nu", found.alias("q")).select(*by, "nu", *[F.col("q")[i].alias(f"q_{name}") for i, name in enumerate(names)])


def t_predictive(paths: DataFrame, study: Study) -> DataFrame:
    """paths of per_draw_variances with interval bounds, value at risk and pit of a t distribution with that mean, variance and nu."""
    scaled = paths.join(t_quantiles(paths, ["series", "draw"], study).drop("nu"), ["series", "draw"]).withColumn("scale", F.expr(distributions.t_scale("variance", "nu")))
    bounds = {name: F.col("mu") + F.col("scale") * F.col(f"q_{name}") for name in probabilities(study)}
    out = scaled.withColumns(bounds).withColumn("pit", F.expr(distributions.t_cdf("(log_return - mu) / scale", "nu")))
    return out.drop("scale", *[f"q_{name}" for name in probabilities(study)])


def mixture_predictive(paths: DataFrame, study: Study) -> DataFrame:
    """(series, date, refit_id, n_draws, mean, variance, bounds, var_99, pit): the equally weighted mixture of all draws of a day.

    variance is that of the mixture: the mean of the draws' variances and the spread of their means. A day with a null
    variance for any draw has null quantiles.
    """
    scaled = paths.join(t_quantiles(paths, ["series", "draw"], study).drop("nu"), ["series", "draw"]).withColumn("scale", F.expr(distributions.t_scale("variance", "nu")))
    names = probabilities(study)
    own = {name: F.col("mu") + F.col("scale") * F.col(f"q_{name}") for name in names}
    days = scaled.withColumns(own).groupBy("series", "date", "refit_id").agg(
        F.count("*").alias("n_draws"), F.count("scale").alias("n_known"), F.avg("mu").alias("mean"), (F.avg("variance") + F.var_pop("mu")).alias("variance"), F.first("log_return").alias("log_return"),
        F.collect_list(F.struct(F.col("mu").alias("mean"), "scale", "nu")).alias("parts"), *[f(name).alias(f"{s}_{name}") for name in names for s, f in (("low", F.min), ("high", F.max))],
    )
    whole = F.col("n_known") == F.col("n_draws")
    asked = ", ".join(f"named_struct('p', {p}D, 'low', low_{name}, 'high', high_{name})" for name, p in names.items())
    days = days.withColumn("found", F.when(whole, F.expr(f"transform(array({asked}), q -> {distributions.mixture_quantile('q.p', 'parts', 'q.low', 'q.high')})")))
    quantiles = [F.col("found")[i].alias(name) for i, name in enumerate(names)]
    pit = F.when(whole & F.col("log_return").isNotNull(), F.expr(distributions.mixture_cdf("log_return", "parts")))
    return days.select("series", "date", "refit_id", "n_draws", "mean", F.when(whole, F.col("variance")).alias("variance"), *quantiles, pit.alias("pit"), "log_return")
