"""Differences, shifts and relative changes between rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.frame import OrderedFrame
from strandline.functions.missing import change, known
from strandline.operators.missing import filled
from strandline.plans import scale

METHODS = ("diff", "shift", "pct_change")


def _lagged(frame: OrderedFrame, periods: int, operate) -> DataFrame:
    """Run an operator that looks ``periods`` rows back (ahead, if negative)."""
    if scale.unpartitioned(frame):
        return scale.near(scale.deal(frame), max(periods, 0), max(-periods, 0), operate)
    return operate(frame)


def diff(frame: OrderedFrame, periods: int = 1) -> DataFrame:
    """The value less the one ``periods`` rows before (behind, if negative)."""
    return _lagged(frame, periods, lambda f: f.mapped(lambda c: known(c) - F.lag(known(c), periods).over(f.window())))


def shift(frame: OrderedFrame, periods: int = 1, fill_value=None) -> DataFrame:
    """Values move ``periods`` rows down; types stay, strings move too."""
    return _lagged(frame, periods, lambda f: f.mapped(lambda c: F.lag(F.col(c), periods, fill_value).over(f.window())))


def pct_change(frame: OrderedFrame, periods: int = 1, fill_method: str | None = "pad", limit: int | None = None) -> DataFrame:
    """Relative change over ``periods`` rows, after filling gaps with ``fill_method``.

    Two steps, since a lag of a window result needs the result first; both
    windows have the same partitioning and order, so rows are sorted once.
    """
    if fill_method is None:
        return _lagged(frame, periods, lambda f: f.mapped(lambda c: change(known(c), F.lag(known(c), periods).over(f.window()))))
    wanted = set(frame.columns)

    def changed(f: OrderedFrame) -> DataFrame:
        made = lambda c: change(F.col(f"_filled_{c}"), F.lag(F.col(f"_filled_{c}"), periods).over(f.window()))
        return f.df.select(*[made(c).alias(c) if c in wanted else F.col(c) for c in f.df.columns if not c.startswith("_filled_")])

    if scale.unpartitioned(frame):
        back, ahead = max(periods, 0), max(-periods, 0)
        if limit is None:
            return scale.near(scale.with_filled(scale.deal(frame), fill_method, "_filled_"), back, ahead, changed)
        forward = fill_method in ("ffill", "pad")
        return scale.near(scale.deal(frame), back + limit * forward, ahead + limit * (not forward), lambda f: changed(_with_filled(f, fill_method, limit)))
    return changed(_with_filled(frame, fill_method, limit))


def _with_filled(frame: OrderedFrame, method: str, limit: int | None) -> OrderedFrame:
    return replace(frame, df=frame.df.select("*", *[filled(frame, c, method, limit).alias(f"_filled_{c}") for c in frame.columns]))
