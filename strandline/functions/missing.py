"""Missing values and division with IEEE results.

NULL is the one marker for a missing value; NaN becomes NULL on entry.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def known(c: Column | str) -> Column:
    """The value as a double; NaN and NULL are missing."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(x), x)


def finite(c: Column | str) -> Column:
    """The value as a double; NaN, NULL and the infinities are missing."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != INF), x)


def gated(n: Column, least: int, value: Column) -> Column:
    """The value where at least ``least`` observations stand behind it."""
    return F.when(n >= least, value)


def divided(a: Column, b: Column) -> Column:
    """a / b, missing where b is 0."""
    return F.try_divide(a, b)


def change(new: Column, old: Column) -> Column:
    """(new - old) / old as IEEE has it, NaN as missing.

    The sign of a zero denominator is not looked at.
    """
    none = F.lit(None).cast("double")
    return (
        F.when(new.isNull() | old.isNull(), none)
        .when(F.abs(old) == INF, F.when(F.abs(new) != INF, F.lit(-1.0)))
        .when(old == 0, F.when(new == 0, none).when(new > 0, F.lit(INF)).otherwise(F.lit(-INF)))
        .otherwise(F.try_divide(new - old, old))
    )
