"""Reductions of columns to one value, and ``agg``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.frame import OrderedFrame
from strandline.functions import stats
from strandline.functions.missing import divided, known
from strandline.plans import order_statistics

METHODS = ("sum", "mean", "std", "var", "min", "max", "median", "prod", "quantile", "all", "any", "skew", "kurt", "sem", "agg", "aggregate", "apply")
FUNCTIONS = ("sum", "mean", "std", "var", "min", "max", "median", "prod")


def reduction(name: str, c: str, skipna: bool = True, ddof: int = 1, min_count: int = 0) -> Column:
    """One statistic of one column as an aggregate expression."""
    x = known(c)
    n = F.count(x)
    if name == "sum":
        value = F.coalesce(F.sum(x), F.lit(0.0))
        value = F.when(n >= min_count, value) if min_count else value
    elif name == "prod":
        value = F.coalesce(F.product(x), F.lit(1.0))
        value = F.when(n >= min_count, value) if min_count else value
    elif name == "mean":
        value = F.avg(x)
    elif name == "std":
        value = stats.deviation(x, ddof, stats.plain)
    elif name == "var":
        value = stats.variance(x, ddof, stats.plain)
    elif name == "min":
        value = F.min(x)
    elif name == "max":
        value = F.max(x)
    elif name == "median":
        value = F.median(x)
    elif name == "skew":
        value = stats.skewness(x, stats.plain)
    elif name == "kurt":
        value = stats.kurtosis(x, stats.plain, constant=0.0)
    elif name == "sem":
        value = divided(stats.deviation(x, ddof, stats.plain), F.sqrt(n.cast("double")))
    elif name in ("all", "any"):
        # Without skipna a missing value counts as true.
        truth = x != 0 if skipna else F.coalesce(x != 0, F.lit(True))
        if name == "all":
            return F.coalesce(F.bool_and(truth), F.lit(True))
        return F.coalesce(F.bool_or(truth), F.lit(False))
    else:
        raise ValueError(f"unknown function {name!r}")
    return value if skipna else F.when(n == F.count(F.lit(1)), value)


def _reduced(frame: OrderedFrame, make) -> DataFrame:
    """One row (one for each partition), all columns in one pass."""
    made = [make(c).alias(c) for c in frame.columns]
    return frame.df.groupBy(*frame.partition_by).agg(*made) if frame.partition_by else frame.df.agg(*made)


def sum(frame: OrderedFrame, skipna: bool = True, min_count: int = 0) -> DataFrame:  # noqa: A001
    return _reduced(frame, lambda c: reduction("sum", c, skipna, min_count=min_count))


def prod(frame: OrderedFrame, skipna: bool = True, min_count: int = 0) -> DataFrame:
    return _reduced(frame, lambda c: reduction("prod", c, skipna, min_count=min_count))


def mean(frame: OrderedFrame, skipna: bool = True) -> DataFrame:
    return _reduced(frame, lambda c: reduction("mean", c, skipna))


def std(frame: OrderedFrame, skipna: bool = True, ddof: int = 1) -> DataFrame:
    return _reduced(frame, lambda c: reduction("std", c, skipna, ddof))


def var(frame: OrderedFrame, skipna: bool = True, ddof: int = 1) -> DataFrame:
    return _reduced(frame, lambda c: reduction("var", c, skipna, ddof))


def min(frame: OrderedFrame, skipna: bool = True) -> DataFrame:  # noqa: A001
    return _reduced(frame, lambda c: reduction("min", c, skipna))


def max(frame: OrderedFrame, skipna: bool = True) -> DataFrame:  # noqa: A001
    return _reduced(frame, lambda c: reduction("max", c, skipna))


def _one_row(frame: OrderedFrame, values: dict) -> DataFrame:
    return frame.df.sparkSession.createDataFrame([tuple(values[c] for c in frame.columns)], ", ".join(f"`{c}` double" for c in frame.columns))


def median(frame: OrderedFrame, skipna: bool = True) -> DataFrame:
    """The middle value; of whole columns in a few passes that gather no column."""
    if not frame.partition_by:
        found = order_statistics.quantiles(frame.df, {c: known(c) for c in frame.columns}, [0.5], "linear")
        if not skipna:
            gaps = frame.df.agg(*[F.count(F.when(known(c).isNull(), 1)).alias(c) for c in frame.columns]).first()
            found = {c: [None] if gaps[c] else v for c, v in found.items()}
        return _one_row(frame, {c: v[0] for c, v in found.items()})
    return _reduced(frame, lambda c: reduction("median", c, skipna))


def skew(frame: OrderedFrame, skipna: bool = True) -> DataFrame:
    return _reduced(frame, lambda c: reduction("skew", c, skipna))


def kurt(frame: OrderedFrame, skipna: bool = True) -> DataFrame:
    return _reduced(frame, lambda c: reduction("kurt", c, skipna))


def sem(frame: OrderedFrame, skipna: bool = True, ddof: int = 1) -> DataFrame:
    return _reduced(frame, lambda c: reduction("sem", c, skipna, ddof))


def all(frame: OrderedFrame, skipna: bool = True) -> DataFrame:  # noqa: A001
    return _reduced(frame, lambda c: reduction("all", c, skipna))


def any(frame: OrderedFrame, skipna: bool = True) -> DataFrame:  # noqa: A001
    return _reduced(frame, lambda c: reduction("any", c, skipna))


def quantile(frame: OrderedFrame, q: float | Sequence[float] = 0.5, interpolation: str = "linear") -> DataFrame:
    """Exact quantiles: one row for a number, a row with ``q`` for each of a list.

    Without partitions they come from a few passes that gather no column.
    """
    if not frame.partition_by:
        qs = list(q) if isinstance(q, (list, tuple)) else [q]
        found = order_statistics.quantiles(frame.df, {c: known(c) for c in frame.columns}, qs, interpolation)
        if not isinstance(q, (list, tuple)):
            return _one_row(frame, {c: v[0] for c, v in found.items()})
        rows = [(float(v), *[found[c][i] for c in frame.columns]) for i, v in enumerate(qs)]
        return frame.df.sparkSession.createDataFrame(rows, ", ".join(f"`{c}` double" for c in ("q", *frame.columns)))
    if not isinstance(q, (list, tuple)):
        return _reduced(frame, lambda c: stats.quantile(known(c), q, interpolation, stats.plain))
    if interpolation == "linear":
        made = [F.percentile(known(c), F.array(*[F.lit(float(v)) for v in q])).alias(c) for c in frame.columns]
    else:
        made = [F.array(*[stats.quantile(known(c), v, interpolation, stats.plain) for v in q]).alias(c) for c in frame.columns]
    one = frame.df.groupBy(*frame.partition_by).agg(*made) if frame.partition_by else frame.df.agg(*made)
    rows = F.array(*[F.struct(F.lit(float(v)).alias("q"), *[F.get(F.col(c), F.lit(i)).alias(c) for c in frame.columns]) for i, v in enumerate(q)])
    return one.select(*frame.partition_by, F.inline(rows))


def agg(frame: OrderedFrame, func, **named) -> DataFrame:
    """Aggregate by a name, a list of names, or a dict of column to name or names.

    A name gives one row; a list a row for each function, its name in
    ``function``; a dict of single names one row, of lists as a list.  Unknown
    columns and functions raise.  Keyword arguments take (column, name) or any
    aggregate expression and give one row.
    """
    if named:
        made = [(v if isinstance(v, Column) else reduction(_function(v[1]), v[0])).alias(k) for k, v in named.items()]
        return frame.df.groupBy(*frame.partition_by).agg(*made) if frame.partition_by else frame.df.agg(*made)
    if isinstance(func, str):
        return _reduced(frame, lambda c: reduction(_function(func), c))
    if isinstance(func, dict):
        lost = [c for c in func if c not in frame.df.columns]
        if lost:
            raise ValueError(f"no columns {lost}")
        if builtins_all(isinstance(f, str) for f in func.values()):
            return _reduced(frame.select(*func), lambda c: reduction(_function(func[c]), c))
        per = {c: [f] if isinstance(f, str) else list(f) for c, f in func.items()}
    else:
        per = {c: list(func) for c in frame.columns}
    names = list(dict.fromkeys(f for fs in per.values() for f in fs))
    made = [reduction(_function(f), c).alias(f"_{c}_{f}") for c, fs in per.items() for f in fs]
    one = frame.df.groupBy(*frame.partition_by).agg(*made) if frame.partition_by else frame.df.agg(*made)
    cell = lambda c, f: (F.col(f"_{c}_{f}") if f in per[c] else F.lit(None)).cast("double").alias(c)
    return one.select(*frame.partition_by, F.inline(F.array(*[F.struct(F.lit(f).alias("function"), *[cell(c, f) for c in per]) for f in names])))


aggregate = agg
builtins_all = __builtins__["all"] if isinstance(__builtins__, dict) else __builtins__.all


def _function(name) -> str:
    if name not in FUNCTIONS + ("skew", "kurt", "sem", "all", "any"):
        raise ValueError(f"unknown function {name!r}")
    return name


def apply(frame: OrderedFrame, func, axis: int = 0) -> DataFrame:
    """Apply a Python function of a float array to each column (axis 0) or row (axis 1).

    Axis 0 is a grouped-aggregate pandas UDF: the function sees a whole column
    of a partition, in no particular order.  Axis 1 runs batch by batch.
    """
    from strandline.operators.udf import column_function, row_function

    if axis == 0:
        call = column_function(func)
        return _reduced(frame, call)
    return frame.df.select("*", row_function(func)(frame.columns).alias("result"))
