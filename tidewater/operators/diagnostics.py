"""Diagnostics of a series: autocorrelations and regressions from sums of lagged products, exact tails."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import expressions
from tidewater.functions.distributions import beta_inc, let, log_gamma


def acf(values: DataFrame, lags: int) -> DataFrame:
    """(series, lag, acf, band): autocorrelations of `value` with their 95% band around zero.

    The band widens with the squares of the correlations at smaller lags.
    """
    w, ordered = Window.partitionBy("series"), Window.partitionBy("series").orderBy("date")
    rows = values.where(F.col("value").isNotNull()).withColumn("c", F.col("value") - F.avg("value").over(w))
    rows = rows.withColumns({f"l{j}": F.lag("c", j).over(ordered) for j in range(1, lags + 1)})
    sums = rows.groupBy("series").agg(F.count("*").alias("n"), F.sum(F.col("c") * F.col("c")).alias("s0"), *[F.sum(F.col("c") * F.col(f"l{j}")).alias(f"s{j}") for j in range(1, lags + 1)])
    each = F.array(*[F.struct(F.lit(j).alias("lag"), (F.col(f"s{j}") / F.col("s0")).alias("acf")) for j in range(1, lags + 1)])
    long = sums.select("series", "n", F.explode(each).alias("x")).select("series", "n", "x.*")
    before = F.coalesce(F.sum(F.col("acf") * F.col("acf")).over(Window.partitionBy("series").orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return long.withColumn("band", 1.959963984540054 * F.sqrt((1 + 2 * before) / F.col("n")))


def ljung_box(values: DataFrame, lags: tuple[int, ...] = (5, 10, 22)) -> DataFrame:
    """(series, lags, statistic, p_value): n (n + 2) sum(acf^2 / (n - lag)) up to each number of lags, chi-squared with as many degrees of freedom."""
    parts = acf(values, max(lags)).withColumn("q", F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag")))
    ends = F.explode(F.array(*[F.lit(k) for k in lags])).alias("lags")
    out = parts.select("series", "n", "lag", "q", ends).where(F.col("lag") <= F.col("lags")).groupBy("series", "lags").agg((F.max("n") * (F.max("n") + 2) * F.sum("q")).alias("statistic"))
    return out.withColumn("p_value", F.coalesce(*[F.when(F.col("lags") == k, expressions.chi2_sf(F.col("statistic"), k)) for k in lags]))


def arch_lm_1(values: DataFrame) -> DataFrame:
    """(series, n, statistic, p_value): n R^2 of squared demeaned values on their first lag, chi-squared with one degree of freedom."""
    w, ordered = Window.partitionBy("series"), Window.partitionBy("series").orderBy("date")
    rows = values.where(F.col("value").isNotNull()).withColumn("s", F.pow(F.col("value") - F.avg("value").over(w), 2))
    rows = rows.withColumn("p", F.lag("s").over(ordered)).where(F.col("p").isNotNull())
    out = rows.groupBy("series").agg(F.count("*").alias("n"), (F.count("*") * F.pow(F.corr("s", "p"), 2)).alias("statistic"))
    return out.withColumn("p_value", expressions.chi2_sf(F.col("statistic"), 1))


def histogram(values: DataFrame, bins: int, low: float, high: float) -> DataFrame:
    """(series, model, bin, n) of `value` in equal bins of [low, high], empty ones too; the last one is closed."""
    at = F.least(F.floor((F.col("value") - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    every = values.select("series", "model").distinct().select("series", "model", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    found = values.where(F.col("value").isNotNull()).groupBy("series", "model", at.alias("bin")).agg(F.count("*").alias("n"))
    return every.join(found, ["series", "model", "bin"], "left").fillna(0, ["n"])



# Limits and sample-size terms of the 1, 5 and 10 per cent points of the unit-root statistic with a constant.
_UNIT_ROOT = ((-3.43035, -6.5393, -16.786, -79.433), (-2.86154, -2.8903, -4.234, -40.040), (-2.56677, -1.5384, -2.809, 0.0))


def gram(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by..., n, m): the sums of products of all pairs of columns over the rows of a group, as one flat array in row order; nulls count as 0.

    Products are summed on the map side, so what is shuffled are len(columns)^2 numbers for each group and task.
    """
    p = len(columns)
    v = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    pairs = rows.select(*by, v.alias("_v")).select(*by, "_v", F.expr(f"inline(transform(sequence(0, {p * p - 1}), c -> named_struct('_c', c, '_x', _v[c DIV {p}] * _v[c % {p}])))"))
    sums = pairs.groupBy(*by, "_c").agg(F.sum("_x").alias("_s"), F.count("*").alias("n"))
    return sums.groupBy(*by).agg(F.max("n").alias("n"), F.expr("transform(array_sort(collect_list(struct(_c, _s))), x -> x._s)").alias("m"))


def swept(p: int, pivots: str, m: str = "m") -> str:
    """SQL of the p x p matrix m after a sweep of each pivot in the array `pivots`.

    With regressors as pivots and the response in the last row, the last entry is the residual sum of squares, the last column has the
    coefficients, and the diagonal that of the inverse.
    """
    i, j = f"(c DIV {p})", f"(c % {p})"
    rest = f"v - s[{i} * {p} + k] * s[k * {p} + {j}] / s[k * {p} + k]"
    entry = f"CASE WHEN {i} = k AND {j} = k THEN 1 / v WHEN {i} = k THEN v / s[k * {p} + k] WHEN {j} = k THEN -v / s[k * {p} + k] ELSE {rest} END"
    return f"aggregate({pivots}, {m}, (s, k) -> transform(s, (v, c) -> {entry}))"


def arch_lm_lags(values: DataFrame, lags: tuple[int, ...] = (5, 10, 22)) -> DataFrame:
    """(series, lags, n, lm, lm_p, f, f_p): regression of squared demeaned values on a constant and their own first lags.

    lm is n R^2, chi-squared with as many degrees of freedom as lags; f compares with no lags at all. Each number of lags has its own sample. Series
    of fewer than 2 lags + 3 values have no row for it.
    """
    w, ordered = Window.partitionBy("series"), Window.partitionBy("series").orderBy("date")
    rows = values.where(F.col("value").isNotNull()).withColumn("s", F.pow(F.col("value") - F.avg("value").over(w), 2))
    rows = rows.withColumns({f"l{j}": F.lag("s", j).over(ordered) for j in range(1, max(lags) + 1)}).withColumn("one", F.lit(1.0))
    out = None
    for k in lags:
        found = gram(rows.where(F.col(f"l{k}").isNotNull()), ["one", *(f"l{j}" for j in range(1, k + 1)), "s"], ["series"]).where(F.col("n") > k + 2)
        p = k + 2
        found = found.withColumn("total", F.expr(f"{swept(p, 'array(0)')}[{p * p - 1}]")).withColumn("rss", F.expr(f"{swept(p, f'sequence(0, {k})')}[{p * p - 1}]"))
        free = F.col("n") - k - 1
        lm, f = F.col("n") * (1 - F.col("rss") / F.col("total")), (F.col("total") - F.col("rss")) / k / (F.col("rss") / free)
        f_p = F.expr(beta_inc("free / 2", f"{k / 2}D", f"free / (free + {k} * f)", f"{k} * f / (free + {k} * f)"))
        part = found.select("series", F.lit(k).alias("lags"), "n", lm.alias("lm"), f.alias("f"), free.cast("double").alias("free")).withColumns({"lm_p": expressions.chi2_sf(F.col("lm"), k), "f_p": f_p}).drop("free")
        out = part if out is None else out.unionByName(part)
    return out


def unit_root(values: DataFrame, max_lag: int | None = None) -> DataFrame:
    """(series, lags, n, statistic, critical_01, critical_05, critical_10, stationary): augmented unit-root test with a constant.

    The number of lagged differences is the one of least Akaike criterion on the sample that the most lags leave, and the statistic is
    taken on the sample that it leaves itself. The most lags are ceil(12 (n/100)^(1/4)), less than half of the sample; one number, that of
    the longest series, comes to the driver, as it says how many columns are needed. stationary: below the 5 per cent point.
    """
    w = Window.partitionBy("series").orderBy("date")
    rows = values.where(F.col("value").isNotNull()).select("series", "date", F.col("value").cast("double").alias("value"))
    rows = rows.withColumn("last", F.lag("value").over(w)).withColumn("d", F.col("value") - F.col("last")).withColumn("n_values", F.count("*").over(Window.partitionBy("series")))
    allowed = F.least(F.ceil(12 * F.pow(F.col("n_values") / 100, F.lit(0.25))), F.floor(F.col("n_values") / 2) - 3).cast("int") if max_lag is None else F.lit(max_lag)
    rows = rows.withColumn("allowed", F.greatest(allowed, F.lit(0))).where(F.col("d").isNotNull()).withColumn("i", F.row_number().over(w) - 1)
    most = rows.agg(F.max("allowed")).first()[0] or 0
    rows = rows.withColumns({f"d{j}": F.lag("d", j).over(w) for j in range(1, most + 1)}).withColumn("one", F.lit(1.0))
    names = ["last", "one", *(f"d{j}" for j in range(1, most + 1)), "d"]
    p = len(names)
    first = gram(rows.where(F.col("i") >= F.col("allowed")), names, ["series", "allowed"])
    rss = f"transform(sequence(0, allowed), q -> named_struct('aic', n * ln({swept(p, 'sequence(0, q + 1)')}[{p * p - 1}] / n) + 2 * (q + 2), 'lags', q))"
    chosen = first.select("series", F.expr(f"array_min({rss}).lags").alias("lags"))
    own = gram(rows.join(chosen, "series").where(F.col("i") >= F.col("lags")), names, ["series", "lags"])
    own = own.withColumn("s", F.expr(swept(p, "sequence(0, lags + 1)")))
    error = F.sqrt(F.col("s")[0] * F.col("s")[p * p - 1] / (F.col("n") - F.col("lags") - 2))
    size = F.col("n").cast("double")
    points = {f"critical_{name}": sum((c / F.pow(size, F.lit(k)) for k, c in enumerate(row)), F.lit(0.0)) for name, row in zip(("01", "05", "10"), _UNIT_ROOT)}
    out = own.select("series", "lags", "n", (F.col("s")[p - 1] / error).alias("statistic"), *[c.alias(name) for name, c in points.items()])
    return out.withColumn("stationary", F.col("statistic") < F.col("critical_05"))


def symmetry_p(below: str, above: str) -> str:
    """SQL of the exact two-sided p-value that breaches fall on either side alike; null without breaches.

    Outcomes no likelier than the one seen are those at least as far from half: both tails from the smaller count on. A tail is summed
    from its likeliest term down, over 40 deviations at most, beyond which doubles are zero.
    """
    first = f"exp({log_gamma('v.n + 1')} - {log_gamma('v.k + 1')} - {log_gamma('v.n - v.k + 1')} - v.n * ln(2D))"
    steps = "sequence(0, CAST(least(v.k, ceil(20 * sqrt(v.n))) AS INT))"
    tail = f"aggregate({steps}, named_struct('term', {first}, 'total', 0D), (s, j) -> named_struct('term', s.term * (v.k - j) / (v.n - v.k + j + 1), 'total', s.total + s.term), s -> s.total)"
    body = let(f"CASE WHEN v.n = 0 THEN NULL WHEN 2 * v.k = v.n THEN 1D ELSE least(1D, 2 * {tail}) END", n="v.b + v.a", k="least(v.b, v.a)")
    return let(body, b=f"CAST({below} AS DOUBLE)", a=f"CAST({above} AS DOUBLE)")


def quantile_pairs(values: DataFrame) -> DataFrame:
    """(series, i, value, p): values in order with their plotting positions (i - 0.5) / n, for quantile plots."""
    w = Window.partitionBy("series")
    rows = values.where(F.col("value").isNotNull())
    i = F.row_number().over(w.orderBy("value", "date"))
    return rows.select("series", i.alias("i"), "value", ((i - 0.5) / F.count("*").over(w)).alias("p"))
