"""Distribution of the largest distance between n uniform values' distribution and the uniform one, as SQL text for the JVM."""

from __future__ import annotations

import math

from tidewater.functions.distributions import let, log_gamma

#: Terms 1/q! of a row that are kept: what is left out is below 1/22!, less than doubles tell apart.
BAND = 21
#: n times the squared distance from which crossings of both bounds have a probability below 1e-13, so that one side's counts twice.
ONE_SIDED_FROM = 4
#: Sizes above this take the limit distribution at a corrected distance; its error is about n^-1.5, so below 4e-6 there.
EXACT_TO = 4096


def _inside(n: str, d: str) -> str:
    """Probability of a distance below d, from the n-th power of a matrix of about 2 n d rows applied to a unit vector, row by row.

    Row i of the matrix is 1 / (i - j + 1)!, less corrections in its first column and last row. Each product is divided by e, which
    keeps the vector in range; what that leaves of n! / n^n is one factor at the end.
    """
    c = f"array({', '.join(f'{1 / math.factorial(q)!r}D' for q in range(BAND + 1))})"
    row = "aggregate(sequence(if(i = w.m - 1, 1, 0), least(i + 1, w.band)), 0D, (t, q) -> t + w.c[q] * u[i + 1 - q])"
    first = "if(i < w.band, w.h[i + 1] * u[0], 0D)"
    last = "if(i = w.m - 1, aggregate(sequence(1, least(w.m, w.band)), 0D, (t, q) -> t + w.h[q] * u[w.m - q]) - if(w.m <= w.band, w.corner * u[0], 0D), 0D)"
    step = f"transform(sequence(0, w.m - 1), i -> {math.exp(-1)!r}D * ({row} - {first} - {last}))"
    start = "transform(sequence(0, w.m - 1), i -> if(i = w.k - 1, 1D, 0D))"
    left = "exp(aggregate(sequence(1, w.n), 0D, (t, i) -> t + ln(i / w.n) + 1D))"
    fold = f"aggregate(sequence(1, w.n), {start}, (u, s) -> {step}, u -> u[w.k - 1] * {left})"
    powers = f"transform(sequence(0, {BAND}), q -> pow(v.rest, q) * v.c[q])"
    corner = f"if(2 * v.k - 1 <= {BAND}, pow(greatest(0D, 2 * v.rest - 1), 2 * v.k - 1) * element_at(v.c, least(2 * v.k, {BAND + 1})), 0D)"
    held = f"element_at(transform(array(named_struct('n', v.n, 'k', v.k, 'm', 2 * v.k - 1, 'band', {BAND}, 'c', v.c, 'h', {powers}, 'corner', {corner})), w -> {fold}), 1)"
    k = f"(CAST(floor(({n}) * ({d})) AS INT) + 1)"
    return let(held, n=f"CAST({n} AS INT)", k=k, rest=f"({k} - ({n}) * ({d}))", c=c)


def _one_sided(n: str, d: str) -> str:
    """Probability that the distribution of n values exceeds the uniform one by d somewhere: a finite sum."""
    choose = f"({log_gamma('s.n + 1')} - {log_gamma('j + 1')} - {log_gamma('s.n - j + 1')})"
    term = f"if(1 - s.d - j / s.n > 0, exp({choose} + (j - 1) * ln(s.d + j / s.n) + (s.n - j) * ln(1 - s.d - j / s.n)), 0D)"
    total = f"s.d * aggregate(sequence(0, CAST(floor(s.n * (1 - s.d)) AS INT)), 0D, (t, j) -> t + {term})"
    return f"element_at(transform(array(named_struct('n', CAST({n} AS DOUBLE), 'd', CAST({d} AS DOUBLE))), s -> {total}), 1)"


def _limit(n: str, d: str) -> str:
    """Upper tail of the limit distribution at the distance corrected for n."""
    terms = "aggregate(sequence(1, 20), 0D, (t, j) -> t + if(j % 2 = 1, 2D, -2D) * exp(-2 * j * j * v.x * v.x))"
    z = f"(({d}) * sqrt({n}))"
    return let(f"if(v.x < 0.2D, 1D, {terms})", x=f"({z} + 1 / (6 * sqrt({n})) + ({z} - 1) / (4 * ({n})))")


def ks_tail(n: str, d: str) -> str:
    """Probability of a distance of at least d for n values; exact for up to EXACT_TO values. Null where either is null or n is below 1."""
    far = f"2 * {_one_sided(n, d)}"
    body = f"CASE WHEN ({n}) > {EXACT_TO} THEN {_limit(n, d)} WHEN ({n}) * ({d}) * ({d}) > {ONE_SIDED_FROM} THEN {far} ELSE 1 - {_inside(n, d)} END"
    return f"CASE WHEN isnull({n}) OR isnull({d}) OR ({n}) < 1 THEN NULL WHEN ({d}) <= 0 THEN 1D WHEN ({d}) >= 1 THEN 0D ELSE least(1D, greatest(0D, {body})) END"


def ks_tail_sql(n: str, d: str) -> str:
    """ks_tail for an engine with lgamma and lists, from the whole matrix at every size."""
    k, rest = "(v.k)", "(v.k - v.n * v.d)"
    over = lambda x: f"exp(-lgamma({x} + 1.0))"
    m = f"(2 * {k} - 1)"
    entry = f"CASE WHEN i - j + 1 < 0 THEN 0 WHEN i - j + 1 = 0 THEN 1 ELSE {over('(i - j + 1)')} END"
    first = f"CASE WHEN j = 0 THEN power({rest}, i + 1) * {over('(i + 1)')} ELSE 0 END"
    last = f"CASE WHEN i = {m} - 1 THEN power({rest}, {m} - j) * {over(f'({m} - j)')} ELSE 0 END"
    corner = f"CASE WHEN i = {m} - 1 AND j = 0 THEN power(greatest(0, 2 * {rest} - 1), {m}) * {over(m)} ELSE 0 END"
    matrix = f"list_transform(range({m}), lambda i: list_transform(range({m}), lambda j: (({entry}) - ({first}) - ({last}) + ({corner}))::DOUBLE))"
    start = f"list_transform(range({m}), lambda i: (CASE WHEN i = {k} - 1 THEN 1 ELSE 0 END)::DOUBLE)"
    fold = f"list_reduce(list_prepend({start}, list_transform(range(v.n::BIGINT), lambda i: []::DOUBLE[])), lambda u, e: list_transform(v.h, lambda r: list_inner_product(r, u) / exp(1.0)))"
    held = f"list_transform([struct_pack(n := v.n, d := v.d, k := v.k, h := {matrix})], lambda v: 1 - ({fold})[{k}] * exp(lgamma(v.n + 1.0) + v.n - v.n * ln(v.n)))[1]"
    return f"greatest(0, list_transform([struct_pack(n := ({n})::DOUBLE, d := ({d})::DOUBLE, k := floor(({n}) * ({d}))::BIGINT + 1)], lambda v: {held})[1])"
