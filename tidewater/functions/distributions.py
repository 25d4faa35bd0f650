"""Student-t distribution with a real number of degrees, its quantiles and those of mixtures, as SQL text for the JVM.

The distribution function is an incomplete beta function, from a continued fraction of fixed depth that is written out from the
innermost term outwards, so that each term is used once. Quantiles are found by a fixed number of steps in a bracket. Everything is text, as
thousands of column objects would cost more than the query; each function takes and gives SQL of numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from tidewater.functions.expressions import normal_cdf_sql

# Coefficients of an approximation of the gamma function to double precision.
_GAMMA = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
_GAMMA_SHIFT = 7.5
#: Pairs of terms of the continued fraction: good to ten digits for 3,000 degrees of freedom and less.
DEPTH = 16
#: Degrees of freedom from which the normal distribution at a corrected value takes over.
NORMAL_FROM = 3000
#: Halvings of a quantile's bracket; secant steps in a mixture's, which is narrow from the start.
HALVINGS, SECANTS = 60, 12


def let(body: str, **values: str) -> str:
    """body with v.name for each of the values, computed once."""
    return f"element_at(transform(array(named_struct({', '.join(f'{k!r}, {x}' for k, x in values.items())})), v -> {body}), 1)"


def log_gamma(x: str) -> str:
    """Logarithm of the gamma function for x of at least one half."""
    total = " + ".join([f"{_GAMMA[0]!r}D", *(f"{c!r}D / (({x}) + {i})" for i, c in enumerate(_GAMMA[1:]))])
    t = f"(({x}) + {_GAMMA_SHIFT - 1}D)"
    return f"({0.5 * math.log(2 * math.pi)!r}D + (({x}) - 0.5D) * ln({t}) - {t} + ln({total}))"


def beta_inc(a: str, b: str, x: str, rest: str) -> str:
    """Regularised incomplete beta function; rest is 1 - x, given apart so that neither end loses digits. a and b are at least one half."""
    fraction = "1D"
    for m in range(DEPTH, -1, -1):
        odd = f"-(v.p + {m}) * (v.p + v.q + {m}) * v.y / ((v.p + {2 * m}) * (v.p + {2 * m + 1}))"
        even = f"{m + 1} * (v.q - {m + 1}) * v.y / ((v.p + {2 * m + 1}) * (v.p + {2 * m + 2}))"
        fraction = f"(1D + {odd} / (1D + {even} / {fraction}))"
    value = f"(v.front / v.p / {fraction})"
    front = f"exp({log_gamma('v.a + v.b')} - {log_gamma('v.a')} - {log_gamma('v.b')} + v.a * ln(v.x) + v.b * ln(v.rest))"
    swap = "v.x > (v.a + 1) / (v.a + v.b + 2)"
    inner = let(f"if(v.swap, 1D - {value}, {value})", p=f"if({swap}, v.b, v.a)", q=f"if({swap}, v.a, v.b)", y=f"if({swap}, v.rest, v.x)", front=front, swap=swap)
    return let(f"CASE WHEN v.x <= 0 THEN 0D WHEN v.rest <= 0 THEN 1D ELSE {inner} END", a=a, b=b, x=x, rest=rest)


def t_cdf(x: str, nu: str) -> str:
    """Distribution function of Student's t for nu of at least 1; null where either is."""
    tail = beta_inc("v.nu / 2", "0.5D", "v.nu / (v.nu + v.x * v.x)", "v.x * v.x / (v.nu + v.x * v.x)")
    far = normal_cdf_sql("(v.x * (1 - 1 / (4 * v.nu)) / sqrt(1 + v.x * v.x / (2 * v.nu)))")
    return let(f"CASE WHEN v.nu > {NORMAL_FROM} THEN {far} ELSE {let('if(v.x > 0, 1D - v.tail / 2, v.tail / 2)', x='v.x', tail=tail)} END", x=f"CAST({x} AS DOUBLE)", nu=f"CAST({nu} AS DOUBLE)")


def halved(first: str, last: str, below: Callable[[str], str], steps: int, **values: str) -> str:
    """The point between first and last up to which below holds, after a fixed number of halvings. below gets SQL of a point and may use b.name for each of the values."""
    step = f"transform(array((a.low + a.high) / 2), m -> if({below('m')}, named_struct('low', m, 'high', a.high), named_struct('low', a.low, 'high', m)))[0]"
    fold = f"aggregate(sequence(1, {steps}), named_struct('low', CAST({first} AS DOUBLE), 'high', CAST({last} AS DOUBLE)), (a, i) -> {step}, a -> (a.low + a.high) / 2)"
    return f"element_at(transform(array(named_struct({', '.join(f'{k!r}, {x}' for k, x in values.items())})), b -> {fold}), 1)"


def crossed(first: str, last: str, f: Callable[[str], str], steps: int, **values: str) -> str:
    """The zero of an increasing f between first and last, after a fixed number of secant steps that keep it bracketed: where one end stays,
    its value is halved. f gets SQL of a point and may use b.name for each of the values.
    """
    ends = ("lo", "hi", "f_lo", "f_hi", "side", "at")
    low = "named_struct('lo', m.x, 'hi', a.hi, 'f_lo', m.f, 'f_hi', if(a.side < 0, a.f_hi / 2, a.f_hi), 'side', -1D, 'at', m.x)"
    high = "named_struct('lo', a.lo, 'hi', m.x, 'f_lo', if(a.side > 0, a.f_lo / 2, a.f_lo), 'f_hi', m.f, 'side', 1D, 'at', m.x)"
    point = "if(a.f_hi > a.f_lo, a.hi - a.f_hi * (a.hi - a.lo) / (a.f_hi - a.f_lo), (a.lo + a.hi) / 2)"
    step = f"transform(transform(array({point}), x -> named_struct('x', x, 'f', {f('x')})), m -> if(m.f < 0, {low}, {high}))[0]"
    # both ends by one copy of f, as plans are slow with many
    begin = f"named_struct({', '.join(f'{n!r}, {v}' for n, v in zip(ends, ('b.first', 'b.last', 'e[0]', 'e[1]', '0D', 'b.first')))})"
    start = f"transform(array(transform(array(b.first, b.last), x -> {f('x')})), e -> {begin})[0]"
    fold = f"aggregate(sequence(1, {steps}), {start}, (a, i) -> {step}, a -> a.at)"
    held = {"first": f"CAST({first} AS DOUBLE)", "last": f"CAST({last} AS DOUBLE)"} | values
    return f"element_at(transform(array(named_struct({', '.join(f'{k!r}, {x}' for k, x in held.items())})), b -> {fold}), 1)"


def t_quantile(p: str, nu: str) -> str:
    """Quantile of Student's t for 0 < p < 1 and nu of at least 1; null elsewhere.

    The upper end of the bracket is the quantile for one degree of freedom, which no other exceeds.
    """
    upper = halved("0", "tan(pi() * (b.p - 0.5D)) + 1", lambda x: f"{t_cdf(x, 'b.nu')} < b.p", HALVINGS, p=f"greatest({p}, 1 - ({p}))", nu=f"CAST({nu} AS DOUBLE)")
    return f"CASE WHEN ({p}) > 0 AND ({p}) < 1 THEN if(({p}) = 0.5, 0D, sign(({p}) - 0.5) * {upper}) END"


def t_scale(variance: str, nu: str) -> str:
    """Scale of a t distribution that has this variance; nu is above 2."""
    return f"sqrt(({variance}) * (({nu}) - 2) / ({nu}))"


def mixture_cdf(x: str, components: str) -> str:
    """Mean of the distribution functions of components, an array of struct<mean, scale, nu>."""
    return f"(aggregate({components}, 0D, (s, c) -> s + {t_cdf(f'(({x}) - c.mean) / c.scale', 'c.nu')}) / size({components}))"


def mixture_quantile(p: str, components: str, low: str, high: str) -> str:
    """Quantile of an equally weighted mixture of t distributions, whose least and greatest component quantiles are low and high.

    At low all components are at most p and at high at least p, so the root is between them. Where the two agree the mixture is any of its
    components, and their quantile is its own.
    """
    root = crossed(low, high, lambda x: f"({mixture_cdf(x, 'b.parts')} - b.p)", SECANTS, p=p, parts=components)
    return f"if(({high}) - ({low}) <= 1e-12 * greatest(1D, abs({high})), (({low}) + ({high})) / 2, {root})"


# ---- the same for an engine with lgamma and list functions, by another way: the density is summed over an angle


def t_cdf_sql(x: str, nu: str, points: int = 200) -> str:
    """Distribution function of t as SQL: half, and Boole's rule over atan(|x| / sqrt(nu)) of cos^(nu - 1); points is a multiple of four."""
    angle = f"atan(abs({x}) / sqrt({nu}))"
    weight = f"(CASE WHEN i = 0 OR i = {points} THEN 7 WHEN i % 2 = 1 THEN 32 WHEN i % 4 = 2 THEN 12 ELSE 14 END)"
    total = f"list_sum(list_transform(range(0, {points + 1}), lambda i: {weight} * power(cos({angle} * i / {points}), ({nu}) - 1)))"
    half = f"exp(lgamma((({nu}) + 1) / 2) - lgamma(({nu}) / 2)) / sqrt(pi()) * {angle} * 2 / {45 * points} * {total}"
    return f"(0.5 + sign({x}) * {half})"


def crossed_sql(first: str, last: str, f: Callable[[str], str], steps: int) -> str:
    """The steps of crossed as a list reduction over structs of a bracket."""
    ends = lambda *v: "struct_pack(" + ", ".join(f"{n} := ({x})::DOUBLE" for n, x in zip(("lo", "hi", "f_lo", "f_hi", "side", "pos"), v)) + ")"
    point = "CASE WHEN s.f_hi > s.f_lo THEN s.hi - s.f_hi * (s.hi - s.lo) / (s.f_hi - s.f_lo) ELSE (s.lo + s.hi) / 2 END"
    low = ends("m.x", "s.hi", "m.f", "CASE WHEN s.side < 0 THEN s.f_hi / 2 ELSE s.f_hi END", "-1", "m.x")
    high = ends("s.lo", "m.x", "CASE WHEN s.side > 0 THEN s.f_lo / 2 ELSE s.f_lo END", "m.f", "1", "m.x")
    step = f"list_transform(list_transform([{point}], lambda x: struct_pack(x := x, f := {f('x')})), lambda m: CASE WHEN m.f < 0 THEN {low} ELSE {high} END)[1]"
    return f"list_reduce(list_prepend({ends(first, last, f(first), f(last), '0', first)}, list_transform(range({steps}), lambda j: {ends(*'000000')})), lambda s, e: {step}).pos"
