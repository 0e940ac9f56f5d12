"""Column expressions for guarded arithmetic, transforms and Student-t tails."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: Column | str) -> Column:
    """True for a value that is neither NULL, NaN nor infinite."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den`` in double precision, NULL where the denominator is zero."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def valid_or_null(c: Column | str, valid: Column) -> Column:
    """The value where ``valid`` holds, NULL elsewhere."""
    return F.when(valid, col(c))


def log2_ratio(num: Column | str, den: Column | str) -> Column:
    """log2(num / den); NULL where either side is not positive."""
    q = ratio(num, den)
    return F.when(q > 0, F.log2(q))


def asin_sqrt(c: Column | str) -> Column:
    """Arcsine square root of a share; NULL outside [0, 1]."""
    c = col(c)
    return F.when((c >= 0) & (c <= 1), F.asin(F.sqrt(c)))


def round_half_even(c: Column | str, digits: int = 0) -> Column:
    return F.bround(col(c), digits)


def round_half_up(c: Column | str, digits: int) -> Column:
    """As ``round`` of a double, by plain arithmetic unless the value is large or close to a tie.

    Away from ties the whole number next to ``c * 10^digits`` is certain, and its quotient by the power of ten
    is the double next to the decimal. ``c`` is read several times: give a column, not a costly expression.
    """
    c, scale = col(c), float(10**digits)
    scaled = c * scale
    certain = (F.abs(scaled) < float(2**40)) & (F.abs(scaled - F.rint(scaled)) < 0.499)
    return F.when(certain, F.rint(scaled) / scale + F.lit(0.0)).otherwise(F.round(c, digits))


def significant_interval(low: Column | str, high: Column | str) -> Column:
    """True where the interval lies wholly on one side of zero."""
    return (col(low) > 0) | (col(high) < 0)


#: Nodes of the Gauss-Legendre rule behind every Student-t value; the exponent it integrates to.
T_NODES, T_REACH = 64, 45.0


@lru_cache(1)
def _nodes() -> list[tuple[float, float]]:
    """Places and weights of the rule on [0, 1]."""
    x, w = np.polynomial.legendre.leggauss(T_NODES)
    return [((float(a) + 1) / 2, float(b) / 2) for a, b in zip(x, w)]


def _t_integral(c0: Column, d: Column) -> Column:
    """Integral of exp(-2 c0 s - s^2) g(c0 + s) over s >= 0, g(c) = c / sqrt(1 - exp(-2 c^2 / d)).

    With c^2 = d/2 ln(1 + u^2/d) the density of u turns into exp(-c^2) times the smooth g, so one
    rule on the stretch where the exponential is not yet negligible serves every t and d.
    """
    reach = T_REACH / (F.sqrt(c0 * c0 + T_REACH) + c0)

    def add(total: Column, node: Column) -> Column:
        s = node["x"] * reach
        c = c0 + s
        return total + node["w"] * F.exp(-(2 * c0 + s) * s) * c / F.sqrt(-F.expm1(-2 * c * c / d))

    nodes = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in _nodes()])
    return reach * F.aggregate(nodes, F.lit(0.0), add)


def _t_tail(t: Column, d: Column) -> tuple[Column, Column]:
    """(natural log of the two-sided tail, integral at 0) for t >= 0."""
    c2 = d / 2 * F.log1p(t * t / d)
    whole = _t_integral(F.lit(0.0), d)
    return F.ln(_t_integral(F.sqrt(c2), d) / whole) - c2, whole


def t_two_sided_log10_p(t: Column | str, df: Column | str) -> Column:
    """Decimal log of the two-sided tail of Student's t, for any df of 1 or more and any t.

    The tail itself is integrated, never one minus the body, with the same work for every row.
    """
    t, d = F.abs(col(t)).cast("double"), col(df).cast("double")
    tail, _ = _t_tail(t, d)
    return F.when((d >= 1) & t.isNotNull() & ~F.isnan(t), tail / math.log(10))


def t_two_sided_p(t: Column | str, df: Column | str) -> Column:
    """Two-sided tail of Student's t: relative error below 1e-9 wherever the result is above 1e-300."""
    t, d = F.abs(col(t)).cast("double"), col(df).cast("double")
    tail, _ = _t_tail(t, d)
    return F.when((d >= 1) & t.isNotNull() & ~F.isnan(t), F.exp(tail))


def t_quantile(prob: float, df: Column | str) -> Column:
    """Student-t quantile: Newton steps on the log of the tail, from the normal quantile.

    The log of the tail is concave in t, so the steps close in from any start; their number is
    fixed and suffices for every df of 1 or more and tails down to 1e-4.
    """
    d = col(df).cast("double")
    two_sided = 2 * min(prob, 1 - prob)
    start = -NormalDist().inv_cdf(two_sided / 2)

    def step(q: Column, _: Column) -> Column:
        tail, whole = _t_tail(q, d)
        # density over tail: minus the slope of the log tail, half of it on either side
        slope = F.exp(F.ln(F.sqrt(d) / (2 * whole)) - (d + 1) / 2 * F.log1p(q * q / d) - tail)
        return F.greatest(q + (tail - math.log(two_sided)) / slope, q / 2)

    found = F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.lit(start), step)
    return F.when(d >= 1, found if prob > 0.5 else -found)


def p_label(p: Column | str, digits: int = 2) -> Column:
    """Text of a p-value: ``<0.001`` or a fixed number of digits."""
    p = col(p)
    return F.when(p < 0.001, F.lit("<0.001")).otherwise(F.format_string(f"%.{digits}f", p))
