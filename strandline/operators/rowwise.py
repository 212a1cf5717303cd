"""Operators along a row, without any shuffle.

``row(df, columns)`` takes columns and gives plain expressions over them;
``row_of(array)`` takes an array column, the layout for wide matrices: its
reductions are expressions over the array, results of the row's own shape come
from numpy, a batch of rows at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.missing import change, divided, known
from strandline.operators.udf import cell_batches, row_batches

#: More columns than this are handled as an array.
WIDE = 24


def _none() -> Column:
    return F.lit(None).cast("double")


@dataclass(frozen=True)
class Row:
    """The values of a row, missing ones as NULL."""

    values: Column

    # ---------------------------------------------------------- reductions
    def _seen(self) -> Column:
        return F.filter(self.values, lambda v: v.isNotNull())

    def _gate(self, value: Column, skipna: bool) -> Column:
        return value if skipna else F.when(F.forall(self.values, lambda v: v.isNotNull()), value)

    def count(self) -> Column:
        return F.size(self._seen()).cast("double")

    def sum(self, skipna: bool = True) -> Column:
        return self._gate(F.aggregate(self._seen(), F.lit(0.0), lambda a, v: a + v), skipna)

    def prod(self, skipna: bool = True) -> Column:
        return self._gate(F.aggregate(self._seen(), F.lit(1.0), lambda a, v: a * v), skipna)

    def mean(self, skipna: bool = True) -> Column:
        return self._gate(divided(self.sum(), self.count()), skipna)

    def var(self, ddof: int = 1, skipna: bool = True) -> Column:
        """Around the mean, in two passes over the row."""
        start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s"))

        def step(a: Column, v: Column) -> Column:
            n = a["n"] + 1
            m = a["m"] + (v - a["m"]) / n
            return F.struct(n.alias("n"), m.alias("m"), (a["s"] + (v - a["m"]) * (v - m)).alias("s"))

        moments = F.aggregate(self._seen(), start, step, lambda a: F.when(a["n"] > ddof, a["s"] / F.nullif(a["n"] - ddof, F.lit(0.0))))
        return self._gate(moments, skipna)

    def std(self, ddof: int = 1, skipna: bool = True) -> Column:
        return F.sqrt(self.var(ddof, skipna))

    def sem(self, ddof: int = 1, skipna: bool = True) -> Column:
        return divided(self.std(ddof, skipna), F.sqrt(self.count()))

    def min(self, skipna: bool = True) -> Column:
        return self._gate(F.array_min(self.values), skipna)

    def max(self, skipna: bool = True) -> Column:
        return self._gate(F.array_max(self.values), skipna)

    def quantile(self, q: float = 0.5, skipna: bool = True) -> Column:
        held = F.array_sort(self._seen())
        place = F.lit(q) * (F.size(held) - 1)
        low, high = F.get(held, F.floor(place).cast("int")), F.get(held, F.ceil(place).cast("int"))
        return self._gate(F.when(F.size(held) > 0, low + (high - low) * (place - F.floor(place))), skipna)

    def median(self, skipna: bool = True) -> Column:
        return self.quantile(0.5, skipna)

    def all(self, skipna: bool = True) -> Column:
        return F.forall(self.values, lambda v: v.isNull() | (v != 0))

    def any(self, skipna: bool = True) -> Column:
        return F.exists(self.values, lambda v: F.coalesce(v != 0, F.lit(not skipna)))

    def _central(self, power: int) -> Column:
        m = divided(self.sum(), self.count())
        return F.aggregate(F.transform(self._seen(), lambda v: F.pow(v - m, F.lit(float(power)))), F.lit(0.0), lambda a, v: a + v)

    def skew(self, skipna: bool = True) -> Column:
        n, m2, m3 = self.count(), self._central(2), self._central(3)
        value = F.when(m2 == 0, 0.0).otherwise(divided(n * F.sqrt(n - 1) * m3, (n - 2) * F.pow(m2, F.lit(1.5))))
        return self._gate(F.when(n >= 3, value), skipna)

    def kurt(self, skipna: bool = True) -> Column:
        n, m2, m4 = self.count(), self._central(2), self._central(4)
        value = divided(n * (n + 1) * (n - 1) * m4, (n - 2) * (n - 3) * m2 * m2) - divided(3 * (n - 1) * (n - 1), (n - 2) * (n - 3))
        return self._gate(F.when(n >= 4, F.when(m2 == 0, 0.0).otherwise(value)), skipna)

    # ---------------------------------------------------------- same shape
    def _back(self, i: Column, periods: int) -> Column:
        return F.when(i - periods >= 0, F.get(self.values, (i - periods).cast("int")))

    def shift(self, periods: int = 1, fill_value: float | None = None) -> Column:
        inside = lambda i: (i - periods >= 0) & (i - periods < F.size(self.values))
        return F.transform(self.values, lambda _, i: F.when(inside(i), self._back(i, periods)).otherwise(F.lit(fill_value).cast("double")))

    def diff(self, periods: int = 1) -> Column:
        return F.transform(self.values, lambda v, i: v - self._back(i, periods))

    @staticmethod
    def _framed(frame: Row, statistic: str, least: int, q: float) -> Column:
        """One window's statistic, as rolling windows have it."""
        value = getattr(frame, statistic)(**({"q": q} if statistic == "quantile" else {}))
        if statistic == "sum" and least == 0:
            return value
        return F.when(frame.count() >= max(least, 1), value)


class Matrix(Row):
    """An array column: results of the row's own shape are made batch by batch in numpy and pandas."""

    def _made(self, operate) -> Column:
        return row_batches(operate)(self.values)

    def _running(self, kind: str, skipna: bool) -> Column:
        return self._made(lambda d: getattr(d, kind)(axis=1, skipna=skipna))

    def cumsum(self, skipna: bool = True) -> Column:
        return self._running("cumsum", skipna)

    def cumprod(self, skipna: bool = True) -> Column:
        return self._running("cumprod", skipna)

    def cummin(self, skipna: bool = True) -> Column:
        return self._running("cummin", skipna)

    def cummax(self, skipna: bool = True) -> Column:
        return self._running("cummax", skipna)

    def ffill(self) -> Column:
        return self._made(lambda d: d.ffill(axis=1))

    def bfill(self) -> Column:
        return self._made(lambda d: d.bfill(axis=1))

    def pct_change(self, periods: int = 1, fill_method: str | None = "pad") -> Column:
        if fill_method not in (None, "pad", "ffill", "bfill", "backfill"):
            raise ValueError(f"unknown fill method {fill_method!r}")
        return self._made(lambda d: _changes(d if fill_method is None else d.ffill(axis=1) if fill_method in ("pad", "ffill") else d.bfill(axis=1), periods))

    def rank(self, method: str = "average", na_option: str = "keep", ascending: bool = True, pct: bool = False) -> Column:
        return self._made(lambda d: d.rank(axis=1, method=method, na_option=na_option, ascending=ascending, pct=pct))

    def rolling(self, window: int, statistic: str, min_periods: int | None = None, center: bool = False, ddof: int = 1, q: float = 0.5) -> Column:
        least = window if min_periods is None else min_periods
        options = {"ddof": ddof} if statistic in ("std", "var", "sem") else {"q": q} if statistic == "quantile" else {}

        def operate(d):
            clean = d if statistic == "count" else d.replace([float("inf"), -float("inf")], float("nan"))
            return getattr(clean.T.rolling(window, min_periods=least, center=center), statistic)(**options).T

        return self._made(operate)


def _changes(frame: pd.DataFrame, periods: int) -> pd.DataFrame:
    """Relative changes along the rows, with the same rules as the column function ``change``."""
    new, old = frame.to_numpy(), frame.shift(periods, axis=1).to_numpy()
    with np.errstate(all="ignore"):
        out = (new - old) / old
    out = np.where(np.isinf(old), np.where(np.isfinite(new), -1.0, np.nan), out)
    return pd.DataFrame(np.where((old == 0) & ~np.isnan(new), np.where(new == 0, np.nan, np.copysign(np.inf, new)), out))


#: Statistics that look at the mean first: as expressions too large to compile, and the engine then interprets them.
_CENTRAL = ("var", "std", "sem", "skew", "kurt")


def _central_values(cells: list[np.ndarray], statistic: str, least: int, ddof: int = 1, windows: bool = True) -> np.ndarray:
    """A statistic along each row of many, NaN where there is none; sem and kurt as rolling windows or reductions have them."""
    with np.errstate(all="ignore"):
        seen = [~np.isnan(c) for c in cells]
        n = sum(s.astype(np.float64) for s in seen)
        if statistic in ("var", "std", "sem"):
            # Value by value, as databases do it: the same last bits decide ties of rounding.
            so_far, mean, s2 = (np.zeros(len(n)) for _ in range(3))
            for s, c in zip(seen, cells, strict=True):
                so_far = so_far + s
                new = mean + (c - mean) / so_far
                s2 = np.where(s, s2 + (c - new) * (c - mean), s2)
                mean = np.where(s, new, mean)
            out = s2 / np.where(n > ddof, n - ddof, np.nan)
            out = out if statistic == "var" else np.sqrt(out)
            out = out / np.sqrt(n - ddof if windows else n) if statistic == "sem" else out
        else:
            mean = sum(np.where(s, c, 0.0) for s, c in zip(seen, cells, strict=True)) / n
            off = [np.where(s, c - mean, 0.0) for s, c in zip(seen, cells, strict=True)]
            m2 = sum(d * d for d in off)
            low, high = (pick.reduce([np.where(s, c, none) for s, c in zip(seen, cells, strict=True)]) for pick, none in ((np.minimum, np.inf), (np.maximum, -np.inf)))
            flat = (m2 == 0) | ((low == high) & np.isfinite(low))
            if statistic == "skew":
                least = max(least, 3)
                out = np.where(flat, 0.0, n * np.sqrt(n - 1) * sum(d * d * d for d in off) / ((n - 2) * (m2 * np.sqrt(m2))))
            else:
                least = max(least, 4)
                rest = (n - 2) * (n - 3)
                out = np.where(flat, -3.0 if windows else 0.0, n * (n + 1) * (n - 1) * sum(d * d * d * d for d in off) / (rest * m2 * m2) - 3 * (n - 1) * (n - 1) / rest)
        return np.where(n >= max(least, 1), out, np.nan)


def _total(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _least(cells: list[Column]) -> Column:
    return cells[0] if len(cells) == 1 else F.least(*cells)


def _greatest(cells: list[Column]) -> Column:
    return cells[0] if len(cells) == 1 else F.greatest(*cells)


class Cells(Row):
    """Named columns: every result is an expression of its own, without arrays or lambdas inside."""

    def __init__(self, cells: list[Column]):
        super().__init__(F.array(*cells))
        object.__setattr__(self, "cells", list(cells))

    # ---------------------------------------------------------- reductions
    def _gate(self, value: Column, skipna: bool) -> Column:
        return value if skipna else F.when(self._whole(self.cells), value)

    @staticmethod
    def _whole(cells: list[Column]) -> Column:
        out = F.lit(True)
        for c in cells:
            out = out & c.isNotNull()
        return out

    def _held(self) -> Column:
        return F.sort_array(F.array_compact(self.values))

    def count(self) -> Column:
        return _total([F.when(c.isNotNull(), 1.0).otherwise(0.0) for c in self.cells])

    def sum(self, skipna: bool = True) -> Column:
        return self._gate(_total([F.coalesce(c, F.lit(0.0)) for c in self.cells]), skipna)

    def prod(self, skipna: bool = True) -> Column:
        out = F.lit(1.0)
        for c in self.cells:
            out = out * F.coalesce(c, F.lit(1.0))
        return self._gate(out, skipna)

    def _around_mean(self, statistic: str, ddof: int, skipna: bool) -> Column:
        made = cell_batches(lambda cells: _central_values(cells, statistic, 1, ddof, windows=False), False)(*self.cells)
        return self._gate(made, skipna)

    def var(self, ddof: int = 1, skipna: bool = True) -> Column:
        return self._around_mean("var", ddof, skipna)

    def std(self, ddof: int = 1, skipna: bool = True) -> Column:
        return self._around_mean("std", ddof, skipna)

    def sem(self, ddof: int = 1, skipna: bool = True) -> Column:
        return self._around_mean("sem", ddof, skipna)

    def skew(self, skipna: bool = True) -> Column:
        return self._around_mean("skew", 1, skipna)

    def kurt(self, skipna: bool = True) -> Column:
        return self._around_mean("kurt", 1, skipna)

    def min(self, skipna: bool = True) -> Column:
        return self._gate(_least(self.cells), skipna)

    def max(self, skipna: bool = True) -> Column:
        return self._gate(_greatest(self.cells), skipna)

    def quantile(self, q: float = 0.5, skipna: bool = True) -> Column:
        held = self._held()
        place = F.lit(q) * (F.size(held) - 1)
        low, high = F.get(held, F.floor(place).cast("int")), F.get(held, F.ceil(place).cast("int"))
        return self._gate(F.when(F.size(held) > 0, low + (high - low) * (place - F.floor(place))), skipna)

    def all(self, skipna: bool = True) -> Column:
        out = F.lit(True)
        for c in self.cells:
            out = out & F.coalesce(c != 0, F.lit(True))
        return out

    def any(self, skipna: bool = True) -> Column:
        out = F.lit(False)
        for c in self.cells:
            out = out | F.coalesce(c != 0, F.lit(not skipna))
        return out

    # ---------------------------------------------------------- same shape
    def _upto(self, make, skipna: bool) -> Column:
        out = []
        for i, c in enumerate(self.cells):
            sofar = self.cells[: i + 1]
            out.append(F.when(c.isNotNull() if skipna else self._whole(sofar), make(sofar)))
        return F.array(*out)

    def cumsum(self, skipna: bool = True) -> Column:
        return self._upto(lambda cells: Cells(cells).sum(), skipna)

    def cumprod(self, skipna: bool = True) -> Column:
        return self._upto(lambda cells: Cells(cells).prod(), skipna)

    def cummin(self, skipna: bool = True) -> Column:
        return self._upto(_least, skipna)

    def cummax(self, skipna: bool = True) -> Column:
        return self._upto(_greatest, skipna)

    def _at(self, i: int) -> Column | None:
        return self.cells[i] if 0 <= i < len(self.cells) else None

    def shift(self, periods: int = 1, fill_value: float | None = None) -> Column:
        return F.array(*[F.lit(fill_value).cast("double") if self._at(i - periods) is None else self._at(i - periods) for i in range(len(self.cells))])

    def diff(self, periods: int = 1) -> Column:
        return F.array(*[_none() if self._at(i - periods) is None else c - self._at(i - periods) for i, c in enumerate(self.cells)])

    def _forward(self) -> list[Column]:
        return [F.coalesce(*self.cells[i::-1]) for i in range(len(self.cells))]

    def _backward(self) -> list[Column]:
        return [F.coalesce(*self.cells[i:]) for i in range(len(self.cells))]

    def ffill(self) -> Column:
        return F.array(*self._forward())

    def bfill(self) -> Column:
        return F.array(*self._backward())

    def pct_change(self, periods: int = 1, fill_method: str | None = "pad") -> Column:
        if fill_method not in (None, "pad", "ffill", "bfill", "backfill"):
            raise ValueError(f"unknown fill method {fill_method!r}")
        full = self if fill_method is None else Cells(self._forward() if fill_method in ("pad", "ffill") else self._backward())
        return F.array(*[_none() if full._at(i - periods) is None else change(c, full._at(i - periods)) for i, c in enumerate(full.cells)])

    def rank(self, method: str = "average", na_option: str = "keep", ascending: bool = True, pct: bool = False) -> Column:
        cells, kept, top = self.cells, na_option == "keep", na_option == "top"
        k, seen = len(cells), self.count()
        gaps = F.lit(float(k)) - seen
        one = lambda condition: F.when(condition, 1.0).otherwise(0.0)
        first = lambda i: ~self._equal_before(i)  # noqa: E731, the first of its value in the row
        distinct = _total([one(c.isNotNull() & first(i)) for i, c in enumerate(cells)]) if method == "dense" else None
        any_gap, out = one(gaps > 0), []
        for i, c in enumerate(cells):
            others = [(j, d) for j, d in enumerate(cells) if j != i]
            less = [one(d < c if ascending else d > c) for _, d in others]
            same = [one(d == c) for _, d in others]
            earlier = [one(d == c) for j, d in others if j < i]
            gaps_before = [one(cells[j].isNull()) for j in range(i)]
            sum_of = lambda terms: _total(terms) if terms else F.lit(0.0)
            ahead, none_ahead = (gaps, F.lit(0.0)) if top else (F.lit(0.0), seen)
            if method == "dense":
                found = (any_gap if top else F.lit(0.0)) + sum_of([one((d < c if ascending else d > c) & first(j)) for j, d in others]) + 1
                none = (F.lit(0.0) if top else distinct) + 1
            else:
                found = ahead + sum_of(less) + {"average": sum_of(same) / 2 + 1, "min": F.lit(1.0), "max": sum_of(same) + 1, "first": sum_of(earlier) + 1}[method]
                none = none_ahead + {"average": (gaps + 1) / 2, "min": F.lit(1.0), "max": gaps, "first": sum_of(gaps_before) + 1}[method]
            value = F.when(c.isNotNull(), found).otherwise(_none() if kept else none)
            if pct:
                total = (distinct if kept else distinct + any_gap) if method == "dense" else (seen if kept else F.lit(float(k)))
                value = divided(value, total)
            out.append(value)
        return F.array(*out)

    def _equal_before(self, i: int) -> Column:
        out = F.lit(False)
        for d in self.cells[:i]:
            out = out | F.coalesce(d == self.cells[i], F.lit(False))
        return out

    def rolling(self, window: int, statistic: str, min_periods: int | None = None, center: bool = False, ddof: int = 1, q: float = 0.5) -> Column:
        """A rolling statistic along the row; infinities count as missing, as in all windows."""
        least = window if min_periods is None else min_periods
        shift, k, out = (window - 1) // 2 if center else 0, len(self.cells), []
        spans = [(max(i + 1 - window + shift, 0), min(i + shift, k - 1)) for i in range(k)]
        if statistic in _CENTRAL:

            def operate(cells: list[np.ndarray]) -> list[np.ndarray]:
                held = [np.where(np.isinf(c), np.nan, c) for c in cells]
                return [_central_values(held[low : high + 1], statistic, least, ddof) if high >= low else np.full(len(held[0]), np.nan) for low, high in spans]

            return cell_batches(operate, True)(*self.cells)
        clean = [F.when(F.abs(c) != float("inf"), c) for c in self.cells]
        for low, high in spans:
            if statistic == "count":
                out.append(Cells(self.cells[low : high + 1]).count() if high - low + 1 >= least else _none())
                continue
            out.append(self._framed(Cells(clean[low : high + 1]), statistic, least, q) if high >= low else _none())
        return F.array(*out)


def row(columns: Sequence[str]) -> Row:
    """The values of named columns; from WIDE columns on as an array."""
    cells = [known(c) for c in columns]
    return Cells(cells) if len(cells) <= WIDE else Matrix(F.array(*cells))


def row_of(array: str) -> Row:
    return Matrix(F.transform(F.col(array).cast("array<double>"), lambda v: F.when(~F.isnan(v), v)))


def spread(df: DataFrame, columns: Sequence[str], values: Column) -> DataFrame:
    """Replace columns by the elements of a same-shape result."""
    made = df.select("*", values.alias("_row_values"))
    wanted = {c: i for i, c in enumerate(columns)}
    return made.select(*[F.get("_row_values", F.lit(wanted[c])).alias(c) if c in wanted else F.col(c) for c in df.columns])
