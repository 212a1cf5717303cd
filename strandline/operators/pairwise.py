"""Correlation and covariance: of whole frames, and pair by pair over rolling windows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.frame import OrderedFrame
from strandline.functions import stats
from strandline.functions.missing import finite, gated, known
from strandline.plans import scale

METHODS = ("corr", "cov")
#: Up to so many columns, each pair is an expression of its own; beyond, a row
#: becomes a row for each pair, so plans do not grow with the number of pairs.
WIDE = 12


def _pair(kind: str, x: Column, y: Column, same: bool, ddof: int, over) -> Column:
    if kind == "cov":
        return stats.covariance(x, y, ddof, over)
    if same:
        return F.when((over(F.count(x)) >= 2) & (over(F.var_pop(x)) > 0), F.lit(1.0))
    return stats.correlation(x, y, over)


def _long(values: dict[tuple[str, str], Column], columns: tuple[str, ...]) -> Column:
    """The full symmetric matrix as an array of (col_i, col_j, value)."""
    at = lambda i, j: values[i, j] if (i, j) in values else values[j, i]
    return F.array(*[F.struct(F.lit(i).alias("col_i"), F.lit(j).alias("col_j"), at(i, j).alias("value")) for i in columns for j in columns])


def _in_pairs(df: DataFrame, keys: list[str], columns: tuple[str, ...], value) -> DataFrame:
    """A row for each row and pair i <= j of columns: keys, col_i, col_j, x, y."""
    last = F.lit(len(columns) - 1)
    cells = df.select(*keys, F.array(*[value(c) for c in columns]).alias("_cells"))
    pairs = cells.select("*", F.explode(F.sequence(F.lit(0), last)).alias("_i")).select("*", F.explode(F.sequence(F.col("_i"), last)).alias("_j"))
    names = F.array(*[F.lit(c) for c in columns])
    at = lambda a, i: F.get(a, F.col(i))
    return pairs.select(*keys, at(names, "_i").alias("col_i"), at(names, "_j").alias("col_j"), at(F.col("_cells"), "_i").alias("x"), at(F.col("_cells"), "_j").alias("y"))


def _mirrored(df: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs i < j also the other way round."""
    both = F.when(F.col("col_i") == F.col("col_j"), F.array(F.struct("col_i", "col_j"))).otherwise(F.array(F.struct("col_i", "col_j"), F.struct(F.col("col_j").alias("col_i"), F.col("col_i").alias("col_j"))))
    return df.select(*keys, F.explode(both).alias("_p"), "value").select(*keys, "_p.*", "value")


def _either(kind: str, ddof: int, over) -> Column:
    same = F.col("col_i") == F.col("col_j")
    x, y = F.col("x"), F.col("y")
    return F.when(same, _pair(kind, x, y, True, ddof, over)).otherwise(_pair(kind, x, y, False, ddof, over))


def rolling_pairs(frame: OrderedFrame, rows: tuple[int, int], min_periods: int, kind: str, ddof: int = 1) -> DataFrame:
    """Long result: partition and order keys, col_i, col_j, value.

    Only pairs i <= j are computed; the other half is mirrored.
    """
    columns, low, high = frame.columns, *rows
    keys = list(dict.fromkeys([*frame.partition_by, *frame.order_by]))
    least = max(min_periods, 1)
    if len(columns) > WIDE:
        long = _in_pairs(frame.df, keys, columns, finite)
        inner = replace(frame, df=long, partition_by=(*frame.partition_by, "col_i", "col_j"))
        over = lambda a: a.over(inner.window().rowsBetween(low, high))
        n = over(F.count(F.when(F.col("y").isNotNull(), F.col("x"))))
        return _mirrored(long.select(*keys, "col_i", "col_j", gated(n, least, _either(kind, ddof, over)).alias("value")), keys)
    pairs = [(i, j) for k, i in enumerate(columns) for j in columns[k:]]
    values = {p: F.col(f"_pair_{k}") for k, p in enumerate(pairs)}

    def operate(f: OrderedFrame) -> DataFrame:
        over = lambda a: a.over(f.window().rowsBetween(low, high))
        made = []
        for i, j in pairs:
            x, y = finite(i), finite(j)
            n = over(F.count(F.when(y.isNotNull(), x)))
            made.append(gated(n, least, _pair(kind, x, y, i == j, ddof, over)).alias(f"_pair_{len(made)}"))
        return f.df.select("*", *made)

    if scale.unpartitioned(frame):
        wide = scale.near(scale.deal(frame), max(-low, 0), max(high, 0), operate, extra=tuple(f"_pair_{k}" for k in range(len(pairs))))
    else:
        wide = operate(frame)
    return wide.select(*keys, F.inline(_long(values, columns)))


def _matrix(frame: OrderedFrame, kind: str, min_periods: int, ddof: int) -> DataFrame:
    columns, least, parts = frame.columns, max(min_periods, 1), list(frame.partition_by)
    if len(columns) > WIDE:
        long = _in_pairs(frame.df, parts, columns, known)
        n = F.count(F.when(F.col("y").isNotNull(), F.col("x")))
        same, x, y = F.col("same"), F.col("x"), F.col("y")
        cell = F.when(same, _pair(kind, x, y, True, ddof, stats.plain)).otherwise(_pair(kind, x, y, False, ddof, stats.plain))
        found = long.withColumn("same", F.col("col_i") == F.col("col_j")).groupBy(*parts, "col_i", "col_j", "same").agg(gated(n, least, cell).alias("value"))
        return _mirrored(found, parts)
    aggregates, names = [], {}
    for k, i in enumerate(columns):
        for j in columns[k:]:
            x, y = known(i), known(j)
            n = F.count(F.when(y.isNotNull(), x))
            cell = gated(n, least, _pair(kind, x, y, i == j, ddof, stats.plain))
            names[i, j] = f"_pair_{len(aggregates)}"
            aggregates.append(cell.alias(names[i, j]))
    one = frame.df.agg(*aggregates) if not parts else frame.df.groupBy(*parts).agg(*aggregates)
    return one.select(*parts, F.inline(_long({p: F.col(n) for p, n in names.items()}, columns)))


def cov(frame: OrderedFrame, min_periods: int = 1, ddof: int = 1) -> DataFrame:
    """Covariance matrix in long form, over rows where both columns are known."""
    return _matrix(frame, "cov", min_periods, ddof)


def corr(frame: OrderedFrame, method: str = "pearson", min_periods: int = 1) -> DataFrame:
    """Correlation matrix in long form: ``pearson``, or ``spearman`` (of average ranks).

    Spearman ranks each column as a whole, so columns with missing values
    differ from ranking pair by pair.
    """
    if method == "pearson":
        return _matrix(frame, "corr", min_periods, 1)
    if method != "spearman":
        raise ValueError(f"unknown method {method!r}")
    from strandline.operators.rank import rank

    return _matrix(replace(frame, df=rank(frame)), "corr", min_periods, 1)
