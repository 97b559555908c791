"""Exact arithmetic helpers, all plain Column expressions.

Counts are integers, so averages, percentages and rates are ratios of integers. ``ratio`` rounds
such a ratio half away from zero in integer arithmetic: the result has no floating-point ties, and
it costs about a tenth of rounding through a wide decimal.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WIDE = "decimal(38,0)"


def _column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def int_div(num: Column, den: Column) -> Column:
    """Integer quotient; NULL when the divisor is 0 (ANSI mode would raise)."""
    return F.call_function("div", num, F.nullif(den, F.lit(0)))


def ratio_scaled(num, den, digits: int) -> Column:
    """``num / den * 10**digits`` rounded half away from zero, as bigint; NULL unless ``den > 0``.

    Half a unit is added towards the sign of ``num`` and the quotient truncated. Arguments are
    Columns or, cheaper to build, SQL expression texts. They are used more than once: on a hot path
    pass plain column names, so that generated methods stay within the size the JVM compiles.
    """
    unit = 2 * 10**digits
    if isinstance(num, str) and isinstance(den, str):
        half = f"if(({num}) < 0, -({den}), {den})"
        return F.expr(f"if(({den}) > 0, (({num}) * {unit}L + {half}) div (({den}) * 2L), NULL)")
    num, den = (x if isinstance(x, Column) else F.expr(x) for x in (num, den))
    half = F.when(num < 0, -den).otherwise(den)
    quotient = F.call_function("div", num * F.lit(unit).cast("bigint") + half, den * F.lit(2).cast("bigint"))
    return F.when(den > 0, quotient)


def ratio(num, den, digits: int) -> Column:
    """``num / den`` rounded to ``digits``, as double; NULL for a zero divisor or NULL input."""
    return unscale(ratio_scaled(num, den, digits), digits)


def ratio_wide(num, den, digits: int) -> Column:
    """``ratio`` in 38 digits, for numerators that may outgrow 64 bits; the scaled result must fit them."""
    num, den = _column(num).cast(WIDE), _column(den).cast(WIDE)
    half = F.when(num < 0, -den).otherwise(den)
    quotient = F.call_function("div", (num * F.lit(2 * 10**digits)).cast(WIDE) + half, (den * F.lit(2)).cast(WIDE))
    return unscale(F.when(den > 0, quotient), digits)


def unscale(units, digits: int) -> Column:
    """Integer count of ``10**-digits`` units to double."""
    if isinstance(units, str):
        return F.expr(f"CAST({units} AS DOUBLE) / {10**digits}D")
    return units.cast("double") / F.lit(float(10**digits))


def half_up_scaled(x, digits: int) -> Column:
    """Round an irrational double (a root, a logarithm, a model value) to integer units.

    A double that stands for a decimal may lie just below its tie; round those with ``ratio_wide``.
    """
    x = _column(x)
    size = F.floor(F.abs(x) * F.lit(float(10**digits)) + F.lit(0.5)).cast("bigint")
    return F.when(x < 0, -size).otherwise(size)


def scaled(x, digits: int) -> Column:
    """Inverse of ``unscale`` for a double that already has at most ``digits`` decimals."""
    return half_up_scaled(x, digits)


def half_up(x, digits: int) -> Column:
    return unscale(half_up_scaled(x, digits), digits)


def reround(x, have: int, want: int) -> Column:
    """Round a double that has ``have`` decimals to ``want`` decimals, exactly."""
    return ratio(scaled(x, have), F.lit(10**have), want)


def clip_low(x, low=0) -> Column:
    """Lower clamp that keeps NULL as NULL (``greatest`` alone would skip it)."""
    x = _column(x)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low).cast("bigint") if isinstance(low, int) else F.lit(low)))


def clip_low_double(x, low: float = 0.0) -> Column:
    x = _column(x)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(float(low))))


def exact_sum(x, digits: int) -> Column:
    """Sum of doubles with at most ``digits`` decimals that does not depend on row order."""
    return F.sum(_column(x).cast(f"decimal(28,{digits})")).cast("double")


def exact_avg(x, digits: int) -> Column:
    """Mean of doubles with at most ``digits`` decimals that does not depend on row order."""
    x = _column(x)
    return exact_sum(x, digits) / F.nullif(F.count(x), F.lit(0)).cast("double")


def ladder(x, steps, default, op: str = ">") -> Column:
    """First-match ladder over ``((threshold, value), ...)`` with ``>``, ``>=`` or ``<``.

    A NULL input matches no step and takes the default.
    """
    x = _column(x)
    test = {">": x.__gt__, ">=": x.__ge__, "<": x.__lt__}[op]
    out = None
    for threshold, value in steps:
        cond = test(F.lit(threshold))
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out.otherwise(F.lit(default))


# Counts are split as high * 2**HALF_BITS + low, so that sums of squares fit 64-bit integers for
# 100,000 rows of counts up to 2**46 and need no wide decimal.
HALF_BITS = 23


def high(x: str) -> str:
    return f"shiftright({x}, {HALF_BITS})"


def low(x: str) -> str:
    return f"({x} & {2**HALF_BITS - 1}L)"


def spread_terms(n: str, total: str, high_sum: str, high_sq: str, cross: str, low_sq: str) -> Column:
    """``n * sum(x**2) - sum(x)**2`` as double: n**2 times the population variance.

    The three centred products are exact integers; they are small when the values lie close
    together, so joining them as doubles loses nothing to cancellation.
    """
    low_sum = f"({total} - {high_sum} * {2**HALF_BITS}L)"
    return F.expr(
        f"CAST({n} * {high_sq} - {high_sum} * {high_sum} AS DOUBLE) * {float(2**(2 * HALF_BITS))}D"
        f" + CAST({n} * {cross} - {high_sum} * {low_sum} AS DOUBLE) * {float(2**(HALF_BITS + 1))}D"
        f" + CAST({n} * {low_sq} - {low_sum} * {low_sum} AS DOUBLE)"
    )


def square(x) -> Column:
    """Exact square of a bigint."""
    x = _column(x).cast("decimal(19,0)")
    return x * x


def normal_cdf(x) -> Column:
    """Normal distribution function by the published five-term polynomial (error below 1e-7)."""
    x = _column(x)
    # Coefficients of Abramowitz & Stegun 26.2.17.
    p, b = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    k = F.lit(1.0) / (F.lit(1.0) + F.lit(p) * F.abs(x))
    poly = F.lit(b[4])
    for coefficient in (b[3], b[2], b[1], b[0]):
        poly = F.lit(coefficient) + k * poly
    tail = F.exp(-(x * x) / F.lit(2.0)) * F.lit(0.3989422804014327) * k * poly
    return F.when(x >= 0, F.lit(1.0) - tail).otherwise(tail)
