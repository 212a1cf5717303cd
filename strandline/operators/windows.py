"""Rolling and expanding statistics.

All statistics of one call share one window specification, so a plan has one
exchange, one sort and one Window node however many columns and statistics are
asked for.
"""

from __future__ import annotations

from collections.abc import Iterable
from copy import copy
from dataclasses import replace

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.frame import OrderedFrame
from strandline.functions import stats
from strandline.functions.missing import finite, gated, known
from strandline.plans import scale

STATISTICS = ("sum", "mean", "std", "var", "min", "max", "count", "skew", "kurt", "median", "quantile", "sem")


class _Windowed:
    """Statistics over a frame of rows; subclasses give the frame and the gates."""

    frame: OrderedFrame
    min_periods: int

    def _spec(self) -> WindowSpec:
        raise NotImplementedError

    def statistic(self, name: str, column: str, ddof: int = 1, q: float = 0.5, interpolation: str = "linear") -> Column:
        """One statistic of one column as an expression."""
        w = self._spec()
        over = lambda a: a.over(w)
        x, least = finite(column), self.min_periods
        n = over(F.count(x))
        if name == "sum":
            total = over(F.sum(x))
            return gated(n, least, total) if least else F.coalesce(total, F.lit(0.0))
        if name == "mean":
            return gated(n, least, over(F.avg(x)))
        if name in ("std", "var"):
            value = (stats.deviation if name == "std" else stats.variance)(x, ddof, over)
            return gated(n, max(least, ddof + 1), value)
        if name in ("min", "max"):
            return gated(n, least, over(F.min(x) if name == "min" else F.max(x)))
        if name == "count":
            return gated(over(F.count(F.lit(1))), least, over(F.count(known(column))).cast("double"))
        if name == "skew":
            return gated(n, max(least, 3), stats.skewness(x, over))
        if name == "kurt":
            return gated(n, max(least, 4), stats.kurtosis(x, over, constant=-3.0))
        if name == "median":
            return gated(n, least, stats.quantile(x, 0.5, "linear", over))
        if name == "quantile":
            return gated(n, max(least, 1), stats.quantile(x, q, interpolation, over))
        if name == "sem":
            return gated(n, max(least, ddof + 1), stats.standard_error(x, known(column), ddof, over))
        raise ValueError(f"unknown statistic {name!r}")

    def _one(self, name: str, **options) -> DataFrame:
        return self.frame.mapped(lambda c: self.statistic(name, c, **options))

    def agg(self, names: Iterable[str]) -> DataFrame:
        """Several statistics at once: columns ``<column>_<statistic>`` beside all others."""
        f, names = self.frame, list(names)
        if not scale.unpartitioned(f):
            made = [self.statistic(s, c).alias(f"{c}_{s}") for c in f.columns for s in names]
            return f.df.select(*[F.col(c) for c in f.df.columns if c not in f.columns], *made)
        # Without partitions each statistic gets a copy of the column, and all of them one pass.
        copies = {f"{c}_{s}": (c, s) for c in f.columns for s in names}
        df = f.df.select(*[F.col(c) for c in f.df.columns if c not in f.columns], *[F.col(c).alias(n) for n, (c, _) in copies.items()])
        return self._over_ranges(replace(f, df=df, columns=tuple(copies)), lambda n: copies[n][1], {})

    def sum(self) -> DataFrame:
        return self._one("sum")

    def mean(self) -> DataFrame:
        return self._one("mean")

    def std(self, ddof: int = 1) -> DataFrame:
        return self._one("std", ddof=ddof)

    def var(self, ddof: int = 1) -> DataFrame:
        return self._one("var", ddof=ddof)

    def min(self) -> DataFrame:
        return self._one("min")

    def max(self) -> DataFrame:
        return self._one("max")

    def count(self) -> DataFrame:
        return self._one("count")

    def skew(self) -> DataFrame:
        return self._one("skew")

    def kurt(self) -> DataFrame:
        return self._one("kurt")

    def median(self) -> DataFrame:
        return self._one("median")

    def quantile(self, q: float, interpolation: str = "linear") -> DataFrame:
        return self._one("quantile", q=q, interpolation=interpolation)

    def sem(self, ddof: int = 1) -> DataFrame:
        return self._one("sem", ddof=ddof)


class Rolling(_Windowed):
    """A window of a fixed number of rows.

    ``closed`` says which ends belong to a trailing window, ``step`` keeps
    every so-manieth row of a partition.
    """

    def __init__(self, frame: OrderedFrame, window: int, min_periods: int | None, center: bool, closed: str | None, step: int):
        if window < 0 or (min_periods is not None and not 0 <= min_periods <= window) or step < 1:
            raise ValueError("window, min_periods and step do not fit")
        self.frame, self.window, self.step = frame, window, step
        self.min_periods = window if min_periods is None else min_periods
        if closed not in (None, "right", "left", "both", "neither"):
            raise ValueError(f"unknown closed {closed!r}")
        shift = (window - 1) // 2 if center else 0
        low = 1 - window + shift - (closed in ("left", "both"))
        high = shift - (closed in ("left", "neither"))
        if low > high:
            raise ValueError("the window is empty")
        self.low, self.high = low, high

    def _spec(self) -> WindowSpec:
        return self.frame.window().rowsBetween(self.low, self.high)

    def _over_ranges(self, frame: OrderedFrame, name_of, options: dict) -> DataFrame:
        def operate(f: OrderedFrame) -> DataFrame:
            inner = copy(self)
            inner.frame = f
            return f.mapped(lambda c: inner.statistic(name_of(c), c, **options))

        return scale.near(scale.deal(frame), max(-self.low, 0), max(self.high, 0), operate, self.step)

    def _one(self, name: str, **options) -> DataFrame:
        if scale.unpartitioned(self.frame):
            return self._over_ranges(self.frame, lambda _: name, options)
        if self.step == 1:
            return super()._one(name, **options)
        f, place = self.frame, "_strandline_place"
        made = {c: self.statistic(name, c, **options).alias(c) for c in f.columns}
        out = f.df.select(*[made.get(c, F.col(c)) for c in f.df.columns], F.row_number().over(f.window()).alias(place))
        return out.where((F.col(place) - 1) % self.step == 0).drop(place)

    def corr(self) -> DataFrame:
        return self._pairs("corr", 1)

    def cov(self, ddof: int = 1) -> DataFrame:
        return self._pairs("cov", ddof)

    def _pairs(self, kind: str, ddof: int) -> DataFrame:
        from strandline.operators.pairwise import rolling_pairs

        return rolling_pairs(self.frame, (self.low, self.high), self.min_periods, kind, ddof)


class Expanding(_Windowed):
    """All rows from the partition's first on."""

    def __init__(self, frame: OrderedFrame, min_periods: int = 1):
        if min_periods < 0:
            raise ValueError("min_periods must not be negative")
        self.frame, self.min_periods = frame, min_periods

    def _spec(self) -> WindowSpec:
        return self.frame.window().rowsBetween(W.unboundedPreceding, 0)

    def _over_ranges(self, frame: OrderedFrame, name_of, options: dict) -> DataFrame:
        names = {name_of(c) for c in frame.columns}
        if names & {"median", "quantile"}:
            # Quantiles of all rows so far cannot be merged from parts: one task holds them.
            inner = copy(self)
            inner.frame = frame
            return frame.mapped(lambda c: inner.statistic(name_of(c), c, **options))
        if unknown := names - set(STATISTICS):
            raise ValueError(f"unknown statistic {sorted(unknown)}")
        return scale.expanding(frame, name_of, self.min_periods, options.get("ddof", 1))

    def _one(self, name: str, **options) -> DataFrame:
        if scale.unpartitioned(self.frame):
            return self._over_ranges(self.frame, lambda _: name, options)
        return super()._one(name, **options)
