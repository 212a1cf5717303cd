"""Cumulative sum, product, minimum and maximum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.frame import OrderedFrame
from strandline.functions.missing import known
from strandline.plans import scale

METHODS = ("cumsum", "cumprod", "cummin", "cummax")
_AGGREGATES = {"cumsum": F.sum, "cumprod": F.product, "cummin": F.min, "cummax": F.max}


def running(frame: OrderedFrame, kind: str, column: str, skipna: bool = True) -> Column:
    """Missing rows stay missing; without skipna everything after the first missing row does."""
    w, x = frame.sofar(), known(column)
    value = _AGGREGATES[kind](x).over(w)
    if skipna:
        return F.when(x.isNotNull(), value)
    return F.when(F.count(x).over(w) == F.count(F.lit(1)).over(w), value)


def _cumulated(frame: OrderedFrame, kind: str, skipna: bool) -> DataFrame:
    if scale.unpartitioned(frame):
        return scale.running(frame, kind, skipna=skipna)
    return frame.mapped(lambda c: running(frame, kind, c, skipna))


def cumsum(frame: OrderedFrame, skipna: bool = True) -> DataFrame:
    return _cumulated(frame, "cumsum", skipna)


def cumprod(frame: OrderedFrame, skipna: bool = True) -> DataFrame:
    return _cumulated(frame, "cumprod", skipna)


def cummin(frame: OrderedFrame, skipna: bool = True) -> DataFrame:
    return _cumulated(frame, "cummin", skipna)


def cummax(frame: OrderedFrame, skipna: bool = True) -> DataFrame:
    return _cumulated(frame, "cummax", skipna)
