"""Gamma and normal distribution functions as native column expressions.

Spark has none of them built in. All are closed forms or fixed-length folds, so
no Python worker takes part. Arguments are SQL text (a column name, say): the
formulas are long, and as text they reach Spark in one call.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, functions as F

SHIFT = 8
NEWTON_STEPS = 8
MIN_SPREAD = 1e-12

# Coefficients of algorithm AS 241 (PPND16, Wichura 1988), lowest
# power first.
CENTRAL_NUM = [
    3.3871328727963666080e0,
    1.3314166789178437745e2,
    1.9715909503065514427e3,
    1.3731693765509461125e4,
    4.5921953931549871457e4,
    6.7265770927008700853e4,
    3.3430575583588128105e4,
    2.5090809287301226727e3,
]
CENTRAL_DEN = [
    1.0,
    4.2313330701600911252e1,
    6.8718700749205790830e2,
    5.3941960214247511077e3,
    2.1213794301586595867e4,
    3.9307895800092710610e4,
    2.8729085735721942674e4,
    5.2264952788528545610e3,
]
MIDDLE_NUM = [
    1.42343711074968357734e0,
    4.63033784615654529590e0,
    5.76949722146069140550e0,
    3.64784832476320460504e0,
    1.27045825245236838258e0,
    2.41780725177450611770e-1,
    2.27238449892691845833e-2,
    7.74545014278341407640e-4,
]
MIDDLE_DEN = [
    1.0,
    2.05319162663775882187e0,
    1.67638483018380384940e0,
    6.89767334985100004550e-1,
    1.48103976427480074590e-1,
    1.51986665636164571966e-2,
    5.47593808499534494600e-4,
    1.05075007164441684324e-9,
]
TAIL_NUM = [
    6.65790464350110377720e0,
    5.46378491116411436990e0,
    1.78482653991729133580e0,
    2.96560571828504891230e-1,
    2.65321895265761230930e-2,
    1.24266094738807843860e-3,
    2.71155556874348757815e-5,
    2.01033439929228813265e-7,
]
TAIL_DEN = [
    1.0,
    5.99832206555887937690e-1,
    1.36929880922735805310e-1,
    1.48753612908506148525e-2,
    7.86869131145613259100e-4,
    1.84631831751005468180e-5,
    1.42151175831644588870e-7,
    2.04426310338993978564e-15,
]


# Coefficients of Stirling's series and of those of ψ and ψ'.
STIRLING = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360]
DIGAMMA = [1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132]
TRIGAMMA = [1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66]


def _number(value: float) -> str:
    return f"{float(value)!r}D"


def _polynomial(x: str, coefficients: list[float]) -> str:
    highest, *rest = reversed(coefficients)
    return reduce(lambda acc, c: f"({acc} * {x} + {_number(c)})", rest, _number(highest))


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``value`` evaluated once, under ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _sum(terms) -> str:
    return "(" + " + ".join(terms) + ")"


def log_gamma_sql(z: str) -> str:
    rising = " * ".join(f"(lg_z + {_number(k)})" for k in range(SHIFT))
    body = _let(
        "lg_y",
        f"lg_z + {_number(SHIFT)}",
        f"(lg_y - 0.5D) * ln(lg_y) - lg_y + {_number(0.5 * math.log(2 * math.pi))}"
        f" + {_polynomial('(1.0D / (lg_y * lg_y))', STIRLING)} / lg_y - ln({rising})",
    )
    return _let("lg_z", z, body)


def log_gamma(z: str) -> Column:
    """ln Γ(z), z > 0: Stirling's series eight steps to the right, shifted back."""
    return F.expr(log_gamma_sql(z))


def digamma_sql(z: str) -> str:
    shifted = _sum(f"1.0D / ({z} + {_number(k)})" for k in range(SHIFT))
    body = _let(
        "dg_i",
        "1.0D / (dg_y * dg_y)",
        f"ln(dg_y) - 0.5D / dg_y - dg_i * {_polynomial('dg_i', DIGAMMA)} - {shifted}",
    )
    return _let("dg_y", f"{z} + {_number(SHIFT)}", body)


def digamma(z: str) -> Column:
    """ψ(z), z > 0."""
    return F.expr(digamma_sql(z))


def trigamma_sql(z: str) -> str:
    shifted = _sum(
        f"1.0D / (({z} + {_number(k)}) * ({z} + {_number(k)}))" for k in range(SHIFT)
    )
    series = f"tg_i * tg_i * tg_i * {_polynomial('(tg_i * tg_i)', TRIGAMMA)}"
    body = f"tg_i + 0.5D * tg_i * tg_i + {series} + {shifted}"
    return _let("tg_i", f"1.0D / ({z} + {_number(SHIFT)})", body)


def trigamma(z: str) -> Column:
    """ψ'(z), z > 0."""
    return F.expr(trigamma_sql(z))


def gamma_shape(spread: str) -> Column:
    """Maximum-likelihood shape from ``spread = ln(mean x) - mean(ln x)``.

    Newton from the closed-form start of Minka (2002). No spread means no
    finite shape: null.
    """
    start = "(3.0D - s + sqrt((s - 3.0D) * (s - 3.0D) + 24.0D * s)) / (12.0D * s)"
    step = f"a - (ln(a) - {digamma_sql('a')} - s) / (1.0D / a - {trigamma_sql('a')})"
    newton = f"aggregate(sequence(1, {NEWTON_STEPS}), {start}, (a, i) -> {step})"
    body = f"CASE WHEN s > {_number(MIN_SPREAD)} THEN {newton} END"
    return F.expr(_let("s", spread, body))


def gamma_cdf(x: str, shape: str, scale: str) -> Column:
    """P(X <= x) for a gamma variable.

    Sums the series x^(a+k) e^-x / Γ(a+k+1) as the first term times a nested
    product, from the inside out, so that the fold carries one number. Its length
    grows with x to stay exact for large shapes; far above the mean the answer is 1.
    """
    first = f"exp(v.a * ln(v.y) - v.y - {log_gamma_sql('v.a + 1.0D')})"
    length = "CAST(ceil(greatest(v.y - v.a, 0.0D) + 8.0D * sqrt(v.y) + 30.0D) AS INT)"
    nested = f"aggregate(sequence({length}, 1, -1), 1.0D, (acc, k) -> 1.0D + acc * v.y / (v.a + k))"
    body = f"""CASE WHEN v.y IS NULL OR v.a IS NULL THEN NULL
        WHEN v.y <= 0 THEN 0.0D
        WHEN v.y > v.a + 20.0D * sqrt(v.a) + 200.0D THEN 1.0D
        ELSE least({first} * {nested}, 1.0D) END"""
    return F.expr(_let("v", f"named_struct('y', try_divide({x}, {scale}), 'a', {shape})", body))


def norm_ppf(p: str) -> Column:
    """Quantile of the standard normal; 0 and 1 give -inf and +inf, null stays null."""

    def rational(x: str, value: str, numerator: list[float], denominator: list[float]) -> str:
        return _let(x, value, f"{_polynomial(x, numerator)} / {_polynomial(x, denominator)}")

    central = rational("c", "0.180625D - (p - 0.5D) * (p - 0.5D)", CENTRAL_NUM, CENTRAL_DEN)
    middle = rational("m", "r - 1.6D", MIDDLE_NUM, MIDDLE_DEN)
    tail = rational("e", "r - 5.0D", TAIL_NUM, TAIL_DEN)
    outer = _let(
        "r",
        "sqrt(-ln(least(p, 1.0D - p)))",
        f"CASE WHEN r <= 5.0D THEN {middle} ELSE {tail} END",
    )
    body = f"""CASE WHEN p < 0 OR p > 1 OR isnan(p) THEN NULL
        WHEN p = 0 THEN double('-infinity') WHEN p = 1 THEN double('infinity')
        WHEN abs(p - 0.5D) <= 0.425D THEN (p - 0.5D) * {central}
        ELSE sign(p - 0.5D) * {outer} END"""
    return F.expr(_let("p", p, body))
