"""Element-wise functions with IEEE results (missing instead of NaN)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.frame import OrderedFrame
from strandline.functions.missing import INF, known

METHODS = ("transform",)


def _log(f):
    return lambda x: F.when(x > 0, f(x)).when(x == 0, F.lit(-INF))


FUNCTIONS = {
    "abs": F.abs,
    "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)),
    "exp": F.exp,
    "log": _log(F.log),
    "log10": _log(F.log10),
    "log2": _log(F.log2),
    "sin": lambda x: F.when(F.abs(x) != INF, F.sin(x)),
    "cos": lambda x: F.when(F.abs(x) != INF, F.cos(x)),
    "tan": lambda x: F.when(F.abs(x) != INF, F.tan(x)),
    # The built-in ones give integers, which hold neither large values nor infinities.
    "ceil": lambda x: F.when(F.abs(x) < 2.0**52, F.ceil(x).cast("double")).otherwise(x),
    "floor": lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x),
}


def element(name: str, c: Column | str) -> Column:
    if name not in FUNCTIONS:
        raise ValueError(f"unknown function {name!r}")
    return FUNCTIONS[name](known(c))


def transform(frame: OrderedFrame, func) -> DataFrame:
    """A named function, a cumulative function's name, or a Column function, of each value column."""
    if callable(func):
        return frame.mapped(lambda c: func(F.col(c)))
    if func in ("cumsum", "cumprod", "cummin", "cummax", "diff", "shift", "pct_change", "rank"):
        return getattr(frame, func)()
    return frame.mapped(lambda c: element(func, c))
