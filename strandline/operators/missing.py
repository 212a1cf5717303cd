"""Finding, filling and dropping missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.frame import NUMERIC, OrderedFrame
from strandline.functions.missing import known
from strandline.plans import scale

METHODS = ("isna", "isnull", "notna", "notnull", "fillna", "ffill", "bfill", "dropna")
_FORWARD, _BACKWARD = ("ffill", "pad"), ("bfill", "backfill")


def _is_missing(frame: OrderedFrame, c: str) -> Column:
    floats = frame.df.schema[c].dataType.typeName() in ("double", "float")
    return F.col(c).isNull() | F.isnan(c) if floats else F.col(c).isNull()


def isna(frame: OrderedFrame) -> DataFrame:
    return frame.mapped(lambda c: _is_missing(frame, c))


def notna(frame: OrderedFrame) -> DataFrame:
    return frame.mapped(lambda c: ~_is_missing(frame, c))


isnull, notnull = isna, notna


def filled(frame: OrderedFrame, c: str, method: str, limit: int | None = None) -> Column:
    """The column with gaps filled from before or behind, at most ``limit`` rows of a gap."""
    numeric = isinstance(frame.df.schema[c].dataType, NUMERIC)
    x = known(c) if numeric else F.col(c)
    if method in _FORWARD:
        near = frame.sofar()
    elif method in _BACKWARD:
        near = frame.onwards()
    else:
        raise ValueError(f"unknown fill method {method!r}")
    if limit is None:
        return F.last(x, ignorenulls=True).over(near)
    if limit < 1:
        raise ValueError("limit must be positive")
    if method in _FORWARD:
        return F.last(x, ignorenulls=True).over(frame.window().rowsBetween(-limit, 0))
    return F.first(x, ignorenulls=True).over(frame.window().rowsBetween(0, limit))


def _filled_frame(frame: OrderedFrame, method: str, limit: int | None) -> DataFrame:
    if not scale.unpartitioned(frame):
        return frame.mapped(lambda c: filled(frame, c, method, limit))
    if method not in _FORWARD + _BACKWARD:
        raise ValueError(f"unknown fill method {method!r}")
    if limit is None:
        return scale.filled(frame, method)
    if limit < 1:
        raise ValueError("limit must be positive")
    forward = method in _FORWARD
    return scale.near(scale.deal(frame), limit * forward, limit * (not forward), lambda f: f.mapped(lambda c: filled(f, c, method, limit)))


def ffill(frame: OrderedFrame, limit: int | None = None) -> DataFrame:
    return _filled_frame(frame, "ffill", limit)


def bfill(frame: OrderedFrame, limit: int | None = None) -> DataFrame:
    return _filled_frame(frame, "bfill", limit)


def fillna(frame: OrderedFrame, value=None, method: str | None = None, limit: int | None = None) -> DataFrame:
    """Fill with a value, a value for each column (dict), or from neighbours.

    With a value, ``limit`` is the number of gaps that are filled, first ones first.
    """
    if (value is None) == (method is None):
        raise ValueError("either value or method is needed")
    if method is not None:
        return _filled_frame(frame, method, limit)
    dealt, df, nth = None, frame.df, {}
    if limit is not None and scale.unpartitioned(frame):
        dealt = scale.deal(frame)
        df, nth = scale.gaps_before(dealt, lambda c: _is_missing(frame, c))

    def made(c: str) -> Column:
        if isinstance(value, dict) and c not in value:
            return F.col(c)
        v = value[c] if isinstance(value, dict) else value
        numeric = isinstance(frame.df.schema[c].dataType, NUMERIC)
        gap = _is_missing(frame, c)
        if limit is not None:
            gap = gap & ((nth[c] if dealt else F.sum(gap.cast("int")).over(frame.sofar())) <= limit)
        return F.when(gap, F.lit(float(v) if numeric else v)).otherwise(F.col(c).cast("double") if numeric else F.col(c))

    return dealt.result(df, {c: made(c) for c in frame.columns}) if dealt else frame.mapped(made)


def dropna(frame: OrderedFrame, axis: int | str = 0, how: str = "any", thresh: int | None = None) -> DataFrame:
    """Drop rows, or columns (axis 1), with missing values.

    Columns to drop are only known after one pass over the data: axis 1 runs a
    job of one aggregation before it returns.
    """
    if how not in ("any", "all"):
        raise ValueError(f"unknown how {how!r}")
    if axis in (0, "index"):
        count = sum((_is_missing(frame, c).cast("int") for c in frame.columns), F.lit(0))
        if thresh is not None:
            return frame.df.where(F.lit(len(frame.columns)) - count >= thresh)
        return frame.df.where(count == 0 if how == "any" else count < len(frame.columns))
    if axis not in (1, "columns"):
        raise ValueError(f"unknown axis {axis!r}")
    found = frame.df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.when(~_is_missing(frame, c), 1)).alias(c) for c in frame.columns]).first()
    total = found["_rows"]
    keep = lambda n: n >= thresh if thresh is not None else (n == total if how == "any" else n > 0 or total == 0)
    gone = {c for c in frame.columns if not keep(found[c])}
    return frame.df.select(*[c for c in frame.df.columns if c not in gone])
