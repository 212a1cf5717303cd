"""Statistics as aggregate expressions, usable in ``agg`` and over windows alike.

Each function takes ``over``, which turns an aggregate into the column to use:
the identity in a reduction, ``lambda a: a.over(w)`` over a window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.missing import divided

Over = Callable[[Column], Column]


def plain(a: Column) -> Column:
    return a


def variance(x: Column, ddof: int, over: Over) -> Column:
    if ddof == 1:
        return over(F.var_samp(x))
    if ddof == 0:
        return over(F.var_pop(x))
    n = over(F.count(x))
    return F.when(n > ddof, over(F.var_pop(x)) * n / F.nullif(n - ddof, F.lit(0)))


def deviation(x: Column, ddof: int, over: Over) -> Column:
    if ddof == 1:
        return over(F.stddev_samp(x))
    if ddof == 0:
        return over(F.stddev_pop(x))
    return F.sqrt(variance(x, ddof, over))


def skewness(x: Column, over: Over) -> Column:
    """Bias-corrected; 0 for constant values; from three observations on."""
    n = over(F.count(x)).cast("double")
    g1 = F.when(over(F.var_pop(x)) == 0, F.lit(0.0)).otherwise(over(F.skewness(x)))
    return F.when(n >= 3, g1 * divided(F.sqrt(n * (n - 1)), n - 2))


def kurtosis(x: Column, over: Over, constant: float) -> Column:
    """Bias-corrected excess; ``constant`` where all values are equal; from four observations on."""
    n = over(F.count(x)).cast("double")
    g2 = over(F.kurtosis(x))
    corrected = divided(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.when(n >= 4, F.when(over(F.var_pop(x)) == 0, F.lit(constant)).otherwise(corrected))


def standard_error(x: Column, counted: Column, ddof: int, over: Over) -> Column:
    """Deviation over the root of counted observations less ddof, as rolling windows have it."""
    n = over(F.count(counted)).cast("double")
    return F.when(n > ddof, divided(deviation(x, 1, over) if ddof == 1 else deviation(x, ddof, over), F.sqrt(n - ddof)))


def quantile(x: Column, q: float, interpolation: str, over: Over) -> Column:
    """Exact quantile with any of the five interpolations."""
    if not 0 <= q <= 1:
        raise ValueError("q must be between 0 and 1")
    if interpolation == "linear":
        return over(F.percentile(x, F.lit(q)))
    held = F.array_sort(over(F.collect_list(x)))
    place = F.lit(q) * (F.size(held) - 1)
    low, high = F.floor(place).cast("int"), F.ceil(place).cast("int")
    at = lambda i: F.get(held, i)
    if interpolation == "lower":
        return at(low)
    if interpolation == "higher":
        return at(high)
    if interpolation == "midpoint":
        return (at(low) + at(high)) / 2
    if interpolation == "nearest":
        return at(F.rint(place).cast("int"))  # half to even
    raise ValueError(f"unknown interpolation {interpolation!r}")


def covariance(x: Column, y: Column, ddof: int, over: Over) -> Column:
    """Over rows where both are known."""
    if ddof == 1:
        return over(F.covar_samp(x, y))
    if ddof == 0:
        return over(F.covar_pop(x, y))
    n = over(F.count(F.when(y.isNotNull(), x)))
    return F.when(n > ddof, over(F.covar_pop(x, y)) * n / F.nullif(n - ddof, F.lit(0)))


def correlation(x: Column, y: Column, over: Over) -> Column:
    """Pearson over rows where both are known; missing without variance (the built-in one raises)."""
    both_x, both_y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.sqrt(over(F.var_pop(both_x)) * over(F.var_pop(both_y)))
    return F.when(over(F.count(both_x)) >= 2, divided(over(F.covar_pop(both_x, both_y)), spread))
