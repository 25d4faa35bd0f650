"""Scalar expressions in the SQL that Spark and other engines share."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of a rational approximation of the normal distribution function to double precision.
_NUMERATOR = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_DENOMINATOR = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_cdf_sql(x: str) -> str:
    """The normal distribution function of an SQL expression, as SQL."""

    def horner(coefficients: tuple[float, ...]) -> str:
        out = f"CAST({coefficients[0]!r} AS DOUBLE)"
        for c in coefficients[1:]:
            out = f"({out} * abs({x}) + CAST({c!r} AS DOUBLE))"
        return out

    a = f"abs({x})"
    near = f"exp(-({x}) * ({x}) / 2) * {horner(_NUMERATOR)} / {horner(_DENOMINATOR)}"
    far = f"exp(-({x}) * ({x}) / 2) / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65))))) / 2.506628274631"
    upper = f"CASE WHEN {a} > 37 THEN CAST(0 AS DOUBLE) WHEN {a} < 7.07106781186547 THEN {near} ELSE {far} END"
    return f"CASE WHEN {x} > 0 THEN 1 - ({upper}) ELSE {upper} END"


# Coefficients of rational approximations of the normal quantile to double precision, the constant term first, for the middle and for tails.
_MIDDLE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
_TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)


def normal_quantile(p: Column) -> Column:
    """Quantile of the normal distribution, in the JVM, for p between 1e-11 and 1 - 1e-11; null outside of (0, 1)."""

    def ratio(coefficients: tuple[tuple[float, ...], tuple[float, ...]], x: Column) -> Column:
        over, under = (reduce(lambda a, c: a * x + c, c[-2::-1], F.lit(c[-1])) for c in coefficients)
        return over / under

    q = p - 0.5
    depth = F.sqrt(-F.log(F.least(p, 1 - p)))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, q * ratio(_MIDDLE, 0.180625 - q * q)).otherwise(F.signum(q) * ratio(_TAIL, depth - 1.6)))


def normal_cdf(x: Column) -> Column:
    """The normal distribution function, in the JVM."""
    a, square = F.abs(x), -x * x / 2

    def horner(coefficients: tuple[float, ...]) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * a + c
        return out

    fraction = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = a + F.lit(k) / fraction
    upper = F.when(a > 37, 0.0).when(a < 7.07106781186547, F.exp(square) * horner(_NUMERATOR) / horner(_DENOMINATOR)).otherwise(F.exp(square) / fraction / 2.506628274631)
    return F.when(x > 0, 1 - upper).otherwise(upper)


def chi2_sf_1(x: Column) -> Column:
    """Upper tail of the chi-squared distribution with one degree of freedom."""
    return 2.0 * normal_cdf(-F.sqrt(x))


def chi2_sf_2(x: Column) -> Column:
    """Upper tail of the chi-squared distribution with two degrees of freedom."""
    return F.exp(-x / 2)


def chi2_sf(x: Column, df: int) -> Column:
    """Upper tail of the chi-squared distribution: a finite sum for a whole number of degrees of freedom."""
    half, odd = x / 2, df % 2
    total = chi2_sf_1(x) if odd else F.exp(-half)
    at = 0.5 if odd else 1.0
    term = F.exp(-half) * F.pow(half, F.lit(at)) / math.gamma(at + 1)
    while at < df / 2:
        total, at = total + term, at + 1
        term = term * half / at
    return total


def t_two_sided(t: Column, df: Column, most: int = 10_000) -> Column:
    """Probability of a t-distributed value of at least |t|, for whole df from 1: a finite sum of powers of a cosine.

    Above `most` degrees of freedom the normal distribution at a corrected t takes over, which is the same to 8 digits.
    """
    terms = F.least(df, F.lit(most))
    angle = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    cosine, odd = F.cos(angle), F.pmod(terms, F.lit(2)) == 1
    # the j-th term is the one before times cos^2 (2j - 1) / 2j, for odd df times cos^2 2j / (2j + 1)
    shift = F.when(odd, 1.0).otherwise(0.0)
    ratio = lambda j: cosine * cosine * (2 * j - 1 + shift) / (2 * j + shift)
    more = F.floor((terms - 2 - F.when(odd, 1).otherwise(0)) / 2).cast("int")
    steps = F.when(more > 0, F.sequence(F.lit(1), more)).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    total = F.aggregate(steps, start, lambda a, j: F.struct((a["term"] * ratio(j)).alias("term"), (a["total"] + a["term"] * ratio(j)).alias("total")))["total"]
    inside = F.when(df == 1, 2 * angle / math.pi).when(odd, 2 / math.pi * (angle + F.sin(angle) * cosine * total)).otherwise(F.sin(angle) * total)
    far = 2 * normal_cdf(-F.abs(t) * (1 - 1 / (4 * df)) / F.sqrt(1 + t * t / (2 * df)))
    return F.when(df > most, far).otherwise(F.greatest(F.lit(0.0), 1 - inside))


def skew_test_p(skew: Column, n: Column) -> Column:
    """Two-sided p-value that values with this skewness are from a normal distribution; null below 8 values."""
    n = n.cast("double")
    y = skew * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    fourth = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w = F.sqrt(2 * (fourth - 1)) - 1
    z = F.asinh(y / F.sqrt(2 / (w - 1))) / F.sqrt(0.5 * F.log(w))
    return F.when(n >= 8, 2 * normal_cdf(-F.abs(z)))


def chi2_sf_sql(x: str, df: str) -> str:
    """chi2_sf for an engine with lgamma and list functions."""
    term = f"exp(-({x}) / 2 + (j + ({df}) % 2 / 2.0) * ln(({x}) / 2) - lgamma(j + ({df}) % 2 / 2.0 + 1))"
    return f"(CASE WHEN ({df}) % 2 = 1 THEN 2 * ({normal_cdf_sql(f'(-sqrt({x}))')}) ELSE 0 END + coalesce(list_sum(list_transform(range(0, (({df}) // 2)::BIGINT), lambda j: {term})), 0))"


def t_two_sided_sql(t: str, df: str) -> str:
    """t_two_sided for an engine with lgamma and list functions."""
    df = f"(({df})::BIGINT)"
    angle = f"atan(abs({t}) / sqrt({df}))"
    even = f"sin({angle}) * list_sum(list_transform(range(0, {df} // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1.0)) / sqrt(pi()) * power(cos({angle}), 2 * j)))"
    odd = f"2 / pi() * ({angle} + sin({angle}) * coalesce(list_sum(list_transform(range(0, ({df} - 1) // 2), lambda j: exp(lgamma(j + 1.0) - lgamma(j + 1.5)) * sqrt(pi()) / 2 * power(cos({angle}), 2 * j + 1))), 0))"
    return f"greatest(0, 1 - CASE WHEN {df} % 2 = 1 THEN {odd} ELSE {even} END)"


def skew_test_sql(skew: str, n: str) -> str:
    """skew_test_p as SQL."""
    n = f"({n})::DOUBLE"
    y = f"(({skew}) * sqrt(({n} + 1) * ({n} + 3) / (6 * ({n} - 2))))"
    w = f"(sqrt(2 * (3 * ({n} * {n} + 27 * {n} - 70) * ({n} + 1) * ({n} + 3) / (({n} - 2) * ({n} + 5) * ({n} + 7) * ({n} + 9)) - 1)) - 1)"
    z = f"(-abs(asinh({y} / sqrt(2 / ({w} - 1))) / sqrt(0.5 * ln({w}))))"
    return f"CASE WHEN {n} >= 8 THEN 2 * ({normal_cdf_sql(z)}) END"


def xlogy(x: Column, y: Column) -> Column:
    """x * log(y), 0 where x is 0."""
    return F.when(x == 0, 0.0).otherwise(x * F.log(F.when(x == 0, F.lit(1.0)).otherwise(y)))


def qlike(realised: Column, forecast: Column) -> Column:
    """realised / forecast - log(realised / forecast) - 1; null unless both are positive."""
    ratio = F.when((realised > 0) & (forecast > 0), realised / F.when(forecast > 0, forecast))
    return ratio - F.log(ratio) - 1


def annualised(variance: Column, periods: int = 252) -> Column:
    return F.sqrt(periods * variance)
