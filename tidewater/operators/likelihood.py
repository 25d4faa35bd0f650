"""Maximum likelihood of GARCH(1,1) as rounds over DataFrames: a table of starts, and one aggregate a round for the likelihood and score of all.

The derivatives of the variance by each parameter are recurrences that decay like the variance itself, so they are found by
the same scans, over all series and starts at once. A round moves every start by a damped step along its score, scaled by the sum of the
score's outer products; steps that lose likelihood are taken back and damped more.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.config import Study
from tidewater.functions.distributions import log_gamma
from tidewater.operators.derive import by_date, split
from tidewater.operators.diagnostics import swept
from tidewater.operators.garch import start_table
from tidewater.operators.recurrence import affine_scan
from tidewater.sources.store import written

NAMES = ("mu", "omega", "alpha", "beta", "nu")
#: Damping at the start, and what it is multiplied by after a step that gained and one that lost.
DAMPING, LESS, MORE = 1e-2, 0.2, 8.0
#: Part of the way to the edge of the admissible parameters that a step may go.
TO_EDGE = 0.9
#: Gain of log-likelihood in the last round that took a step below which a start has converged, and the score's length in its own scale.
TOLERANCE, SCORE_TOLERANCE = 1e-6, 1e-4


def training_returns(framed: DataFrame, study: Study) -> DataFrame:
    """(series, at, r, h0): training returns numbered from 0 in order of dates, with their variance."""
    rows = split(framed, study).where("part = 'train' AND log_return IS NOT NULL").select("series", "date", F.col("log_return").alias("r"))
    h0 = F.var_samp("r").over(Window.partitionBy("series"))
    return rows.select("series", (F.row_number().over(by_date()) - 1).cast("long").alias("at"), "r", h0.alias("h0"))


def evaluated(returns: DataFrame, params: DataFrame, student: bool) -> DataFrame:
    """(series, start, loglik, score, outer): log-likelihood of the returns at each row of params (series, start, mu, omega, alpha, beta, nu), its
    derivatives, and the sum of their outer products over days, as a flat array. nu is not looked at for normal shocks.
    """
    k = 5 if student else 4
    each = returns.join(params.select("series", "start", *NAMES), "series").withColumn("e", F.col("r") - F.col("mu"))
    each = each.withColumn("b", F.expr("array(omega + alpha * e * e, -2 * alpha * e, 1D, e * e)")).withColumn("s", F.expr("array(h0, 0D, 0D, 0D)"))
    paths = affine_scan(each, "beta", "b", "s", "at", ("series", "start"), "d", many=True)
    paths = paths.select("series", "start", "at", "e", "beta", "nu", "d", F.col("d")[0].alias("h"), F.lit(0.0).alias("zero"))
    paths = affine_scan(paths, "beta", "h", "zero", "at", ("series", "start"), "h_beta")
    if student:
        level = f"({log_gamma('(n_ + 1) / 2')} - {log_gamma('n_ / 2')} - 0.5D * ln(pi() * (n_ - 2)))"
        paths = paths.withColumn("q", F.expr("e * e / ((nu - 2) * h)"))
        loglik = f"{level.replace('n_', 'nu')} - 0.5 * ln(h) - (nu + 1) / 2 * ln(1 + q)"
        by_h, by_mu = "(-0.5 + (nu + 1) / 2 * q / (1 + q)) / h", "(nu + 1) * e / ((nu - 2) * h) / (1 + q)"
        slope = f"({level.replace('n_', '(nu + 1e-4)')} - {level.replace('n_', '(nu - 1e-4)')}) / 2e-4"
        by_nu = f", {slope} - 0.5 * ln(1 + q) + (nu + 1) / 2 * q / (1 + q) / (nu - 2)"
    else:
        loglik, by_h, by_mu, by_nu = f"-0.5 * ({math.log(2 * math.pi)!r}D + ln(h) + e * e / h)", "-0.5 * (1 - e * e / h) / h", "e / h", ""
    days = paths.withColumn("l", F.expr(loglik)).withColumn("by_h", F.expr(by_h)).withColumn("g", F.expr(f"array({by_mu} + by_h * d[1], by_h * d[2], by_h * d[3], by_h * h_beta{by_nu})"))
    sums = [F.sum(F.col("g")[i]).alias(f"g{i}") for i in range(k)] + [F.sum(F.col("g")[i] * F.col("g")[j]).alias(f"o{i}{j}") for i in range(k) for j in range(i, k)]
    out = days.groupBy("series", "start").agg(F.sum("l").alias("loglik"), *sums)
    outer = F.array(*[F.col(f"o{min(i, j)}{max(i, j)}") for i in range(k) for j in range(k)])
    return out.select("series", "start", "loglik", F.array(*[F.col(f"g{i}") for i in range(k)]).alias("score"), outer.alias("outer"))


def _step(state: DataFrame, student: bool) -> DataFrame:
    """state with the next parameters to try, next_<name>, inside of what is admissible."""
    k = 5 if student else 4
    p = k + 1
    # the score's outer products with a damped diagonal, bordered by the score: a sweep solves for the step
    entry = f"CASE WHEN c DIV {p} = {k} AND c % {p} = {k} THEN 0D WHEN c DIV {p} = {k} THEN score[c % {p}] WHEN c % {p} = {k} THEN score[c DIV {p}] ELSE outer[(c DIV {p}) * {k} + c % {p}] * IF(c DIV {p} = c % {p}, 1 + damping, 1D) END"
    bordered = state.withColumn("m", F.expr(f"transform(sequence(0, {p * p - 1}), c -> {entry})"))
    moved = bordered.withColumn("s", F.expr(swept(p, f"sequence(0, {k - 1})"))).withColumn("move", F.expr(f"transform(sequence(0, {k - 1}), i -> s[i * {p} + {k}])"))
    slack = [("omega", "move[1]"), ("alpha", "move[2]"), ("beta", "move[3]"), ("(1 - alpha - beta)", "-(move[2] + move[3])")] + ([("(nu - 4)", "move[4]")] if student else [])
    far = ", ".join(f"IF({d} < 0, {TO_EDGE} * {x} / -({d}), 1D)" for x, d in slack)
    moved = moved.withColumn("far", F.expr(f"least(1D, {far})"))
    tried = [F.when(F.isnan(F.col("move")[i]), F.col(n)).otherwise(F.col(n) + F.col("far") * F.col("move")[i]).alias(f"next_{n}") if i < k else F.col(n).alias(f"next_{n}") for i, n in enumerate(NAMES)]
    return moved.select(*state.columns, *tried)


def fit_rounds(returns: DataFrame, starts: DataFrame, rounds: int, student: bool) -> DataFrame:
    """(series, start, parameters, loglik, gain, score, outer, damping) after so many rounds from starts (series, start, parameters).

    A round is one plan over all starts of all series; its state, a row for each start, is written between rounds. A start whose
    likelihood is no number keeps its parameters and a null loglik.
    """
    returns = written(returns, "returns")
    first = evaluated(returns, starts, student)
    state = written(starts.join(first, ["series", "start"]).withColumns({"gain": F.lit(None).cast("double"), "damping": F.lit(DAMPING)}), "fit-0")
    for i in range(1, rounds + 1):
        tried = written(_step(state, student), "tried")
        at_next = evaluated(returns, tried.select("series", "start", *[F.col(f"next_{n}").alias(n) for n in NAMES]), student)
        new = at_next.select("series", "start", *[F.col(c).alias(f"new_{c}") for c in ("loglik", "score", "outer")])
        both = tried.join(new, ["series", "start"])
        better = F.coalesce((F.col("new_loglik") > F.col("loglik")) & ~F.isnan("new_loglik"), F.lit(False))
        kept = [F.when(better, F.col(f"next_{n}")).otherwise(F.col(n)).alias(n) for n in NAMES]
        sums = [F.when(better, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("loglik", "score", "outer")]
        gain = F.when(better, F.col("new_loglik") - F.col("loglik")).otherwise(F.col("gain")).alias("gain")
        damping = F.when(better, F.greatest(F.col("damping") * LESS, F.lit(1e-9))).otherwise(F.least(F.col("damping") * MORE, F.lit(1e9))).alias("damping")
        state = written(both.select("series", "start", *kept, *sums, gain, damping), f"fit-{i}")
    return state


def best_fits(state: DataFrame, student: bool) -> DataFrame:
    """(series, n_starts, n_converged, start, parameters, loglik): of each series the start of the highest likelihood among those that converged, or
    among all if none did; of equal ones the first.

    A start has converged if the score, measured by the inverse of its outer products, is short.
    """
    k = 5 if student else 4
    p = k + 1
    entry = f"CASE WHEN c DIV {p} = {k} AND c % {p} = {k} THEN 0D WHEN c DIV {p} = {k} THEN score[c % {p}] WHEN c % {p} = {k} THEN score[c DIV {p}] ELSE outer[(c DIV {p}) * {k} + c % {p}] END"
    length = state.withColumn("m", F.expr(f"transform(sequence(0, {p * p - 1}), c -> {entry})")).withColumn("length", F.expr(f"-({swept(p, f'sequence(0, {k - 1})')})[{p * p - 1}]"))
    marked = length.withColumn("converged", F.coalesce((F.col("length") < SCORE_TOLERANCE) | (F.col("gain") < TOLERANCE), F.lit(False)))
    order = F.struct(F.col("converged").cast("int"), F.col("loglik"), -F.col("start"))
    best = marked.groupBy("series").agg(F.count("*").alias("n_starts"), F.count_if("converged").alias("n_converged"), F.max_by(F.struct("start", *NAMES, "loglik"), order).alias("x"))
    return best.select("series", "n_starts", "n_converged", "x.*")


def numbered_starts(framed: DataFrame, study: Study, student: bool) -> DataFrame:
    """(series, start, parameters): the grid of starts, numbered; those of normal shocks have no nu."""
    table = start_table(framed, study)
    if not student:
        table = table.withColumn("nu", F.lit(None).cast("double")).distinct()
    order = Window.partitionBy("series").orderBy("alpha", "beta", "nu")
    return table.select("series", (F.row_number().over(order) - 1).alias("start"), *NAMES)
