"""Ordered operators on frames without partitions, in parallel.

A window without PARTITION BY sends every row to one task.  Here rows are
dealt into ranges of the order instead, and the operator runs within ranges;
windows borrow the rows next to their range, running results are joined with
what the ranges before amount to.  Only a row of numbers for each range passes
the driver, which folds them in order.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.frame import NUMERIC, OrderedFrame
from strandline.functions.missing import finite, known
from strandline.plans.tables import discard, written

RANGE, PLACE, _TARGET, _HALO = "_strandline_range", "_strandline_place", "_strandline_target", "_strandline_halo"
#: monotonically_increasing_id: the partition's number above, the row's below.
_ROW_BITS = 33


def in_ranges(df: DataFrame, order: list[Column], ranges: int | None = None) -> DataFrame:
    """Rows with their range and their place in the order, as a table.

    A range holds all rows between two values of the order.  Places grow with
    the order and count up by one within a range.
    """
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    placed = dealt.sortWithinPartitions(*order).withColumn(PLACE, F.monotonically_increasing_id())
    return written(placed.withColumn(RANGE, F.shiftright(PLACE, _ROW_BITS).cast("int")), "ranges")


# -------------------------------------------------- running sums of any table

_FIRST = {"sum": F.sum, "min": F.min, "max": F.max, "product": F.product, "count": F.count}
_JOIN = {
    "sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b),
    "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "product": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a * b),
    "min": lambda a, b: F.least(a, b),
    "max": lambda a, b: F.greatest(a, b),
}


def running_over_ranges(df: DataFrame, order: list[Column], wanted: dict[str, tuple[str, str]], ranges: int | None = None) -> DataFrame:
    """Running aggregates over the whole order: name -> (sum, min, max, product or count; column)."""
    dealt = in_ranges(df, order, ranges)
    totals = dealt.groupBy(RANGE).agg(*[_FIRST[kind](c).alias(f"_t{i}") for i, (kind, c) in enumerate(wanted.values())])
    fold = {"sum": lambda a, b: a + b, "count": lambda a, b: a + b, "product": lambda a, b: a * b, "min": min, "max": max}
    rows, held = [], [None] * len(wanted)
    for r in sorted(totals.collect(), key=lambda r: r[0]):  # one row for each range
        rows.append((r[0], *held))
        held = [new if old is None else old if new is None else fold[kind](old, new) for old, new, (kind, _) in zip(held, r[1:], wanted.values(), strict=True)]
    schema = T.StructType([totals.schema[0], *[T.StructField(f"_b{i}", totals.schema[f"_t{i}"].dataType) for i in range(len(wanted))]])
    carried = df.sparkSession.createDataFrame(rows, schema)
    local = W.partitionBy(RANGE).orderBy(PLACE).rowsBetween(W.unboundedPreceding, 0)
    inner = dealt.select("*", *[_FIRST[kind](c).over(local).alias(f"_l{i}") for i, (kind, c) in enumerate(wanted.values())])
    joined = inner.join(F.broadcast(carried), RANGE)
    return joined.select(*df.columns, *[_JOIN[kind](F.col(f"_b{i}"), F.col(f"_l{i}")).alias(name) for i, (name, (kind, _)) in enumerate(wanted.items())])


# ------------------------------------------------------------- dealt frames


@dataclass(frozen=True)
class Dealt:
    """A frame over its ranges: ``inner`` is partitioned by range and ordered by place."""

    outer: OrderedFrame
    inner: OrderedFrame

    @property
    def spark(self):
        return self.inner.df.sparkSession

    def summary(self, *aggregates: Column) -> list:
        """One row for each range, in order."""
        return sorted(self.inner.df.groupBy(RANGE).agg(*aggregates).collect(), key=lambda r: r[0])

    def carried(self, rows: list[tuple], schema: str) -> DataFrame:
        """The rows of the ranges with one small row for each range beside them."""
        small = self.spark.createDataFrame(rows, f"{RANGE} int, {schema}")
        return self.inner.df.join(F.broadcast(small), RANGE)

    def result(self, df: DataFrame, made: dict[str, Column]) -> DataFrame:
        return df.select(*[made[c].alias(c) if c in made else F.col(c) for c in self.outer.df.columns])


def unpartitioned(frame: OrderedFrame) -> bool:
    return bool(frame.order_by) and not frame.partition_by


def deal(frame: OrderedFrame, ranges: int | None = None) -> Dealt:
    return Dealt(frame, replace(frame, df=in_ranges(frame.df, frame.order, ranges), order_by=(PLACE,), partition_by=(RANGE,)))


# --------------------------------------------------------- bounded windows


def near(dealt: Dealt, before: int, behind: int, operate: Callable[[OrderedFrame], DataFrame], step: int = 1, extra: tuple[str, ...] = ()) -> DataFrame:
    """Run an operator that looks at ``before`` rows before and ``behind`` rows behind each row.

    Every range gets copies of these rows of its neighbours, from as many
    ranges as it takes; ``step`` keeps every so-manieth row of the whole order,
    ``extra`` columns that the operator adds.
    """
    sizes = [(r[0], r[1]) for r in dealt.summary(F.count(F.lit(1)))]
    begins, total = [], 0
    for _, n in sizes:
        begins.append(total)
        total += n
    rows = []
    for k, (own, n) in enumerate(sizes):
        # Ranges that borrow this one's last rows, and those that borrow its first.
        later, earlier, reach = [], [], begins[k] + n
        for j in range(k + 1, len(sizes)):
            if begins[j] - before >= reach:
                break
            later.append((sizes[j][0], begins[j]))
        for j in range(k - 1, -1, -1):
            if begins[j] + sizes[j][1] + behind <= begins[k]:
                break
            earlier.append((sizes[j][0], begins[j] + sizes[j][1]))
        rows.append((own, begins[k], n, later, earlier))
    pair = "array<struct<to:int,at:bigint>>"
    df = dealt.carried(rows, f"_begin long, _n long, _later {pair}, _earlier {pair}")
    nth = F.col("_begin") + F.col(PLACE).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    df = df.withColumn("_nth", nth)
    columns = [*dealt.inner.df.columns, "_nth"]
    own = df.select(*columns, F.col(RANGE).alias(_TARGET), F.lit(False).alias(_HALO))
    edge = (F.col("_nth") >= F.col("_begin") + F.col("_n") - before) | (F.col("_nth") < F.col("_begin") + behind)
    wanted = F.concat(F.filter("_later", lambda r: F.col("_nth") >= r["at"] - before), F.filter("_earlier", lambda r: F.col("_nth") < r["at"] + behind))
    lent = df.where(edge).select(*columns, F.explode(F.transform(wanted, lambda r: r["to"])).alias(_TARGET), F.lit(True).alias(_HALO))
    inner = replace(dealt.inner, df=own.unionByName(lent), partition_by=(_TARGET,))
    out = operate(inner).where(~F.col(_HALO))
    return (out.where(F.col("_nth") % step == 0) if step > 1 else out).select(*dealt.outer.df.columns, *extra)


def rolling(frame: OrderedFrame, window: int, statistic: str, min_periods: int | None = None, ranges: int | None = None) -> DataFrame:
    """A trailing rolling statistic of a frame without partitions."""
    return near(deal(frame, ranges), window - 1, 0, lambda f: f.rolling(window, min_periods)._one(statistic))


# -------------------------------------------------------- running results


def running(frame: OrderedFrame, kind: str, ranges: int | None = None, skipna: bool = True) -> DataFrame:
    """cumsum, cumprod, cummin or cummax of a frame without partitions."""
    name = {"cumsum": "sum", "cumprod": "product", "cummin": "min", "cummax": "max"}[kind]
    fold = {"sum": lambda a, b: a + b, "product": lambda a, b: a * b, "min": min, "max": max}[name]
    dealt = deal(frame, ranges)
    inner, n = dealt.inner, len(frame.columns)
    sums = dealt.summary(F.count(F.lit(1)), *[a for c in frame.columns for a in (_FIRST[name](known(c)), F.count(known(c)))])
    rows, held, whole = [], [None] * n, [True] * n
    for r in sums:
        rows.append((r[0], *held, *whole))
        for i in range(n):
            value, seen = r[2 + 2 * i], r[3 + 2 * i]
            held[i] = value if held[i] is None else held[i] if value is None else fold(held[i], value)
            whole[i] = whole[i] and seen == r[1]
    df = dealt.carried(rows, ", ".join([f"_before{i} double" for i in range(n)] + [f"_whole{i} boolean" for i in range(n)]))
    w, made = inner.sofar(), {}
    for i, c in enumerate(frame.columns):
        x = known(c)
        value = _JOIN[name](F.col(f"_before{i}"), _FIRST[name](x).over(w))
        made[c] = F.when(x.isNotNull(), value) if skipna else F.when(F.col(f"_whole{i}") & (F.count(x).over(w) == F.count(F.lit(1)).over(w)), value)
    return dealt.result(df, made)


def with_filled(dealt: Dealt, method: str, prefix: str) -> Dealt:
    """The dealt frame with columns ``prefix`` + name beside it: gaps filled from all rows before (or behind)."""
    frame, inner, n = dealt.outer, dealt.inner, len(dealt.outer.columns)
    forward = method in ("ffill", "pad")
    kinds = [frame.df.schema[c].dataType for c in frame.columns]
    value = lambda c, kind: known(c) if isinstance(kind, NUMERIC) else F.col(c)
    pick = F.max_by if forward else F.min_by
    ends = dealt.summary(*[pick(value(c, k), F.when(value(c, k).isNotNull(), F.col(PLACE))) for c, k in zip(frame.columns, kinds, strict=True)])
    rows, held = [], [None] * n
    for r in ends if forward else reversed(ends):
        rows.append((r[0], *held))
        held = [new if new is not None else old for new, old in zip(r[1:], held, strict=True)]
    schema = ", ".join(f"_edge{i} {'double' if isinstance(k, NUMERIC) else k.simpleString()}" for i, k in enumerate(kinds))
    df = dealt.carried(rows, schema)
    w = inner.sofar() if forward else inner.onwards()
    made = [F.coalesce(F.last(value(c, k), ignorenulls=True).over(w), F.col(f"_edge{i}")).alias(prefix + c) for i, (c, k) in enumerate(zip(frame.columns, kinds, strict=True))]
    return replace(dealt, inner=replace(inner, df=df.select(*inner.df.columns, *made)))


def filled(frame: OrderedFrame, method: str) -> DataFrame:
    """Gaps filled from the nearest known row before (or behind) in the whole order."""
    dealt = with_filled(deal(frame), method, "_filled_")
    return dealt.result(dealt.inner.df, {c: F.col(f"_filled_{c}") for c in frame.columns})


def gaps_before(dealt: Dealt, gap: Callable[[str], Column]) -> tuple[DataFrame, dict[str, Column]]:
    """The number of gaps of each column up to each row."""
    columns, held, rows = dealt.outer.columns, [0] * len(dealt.outer.columns), []
    for r in dealt.summary(*[F.count(F.when(gap(c), 1)) for c in columns]):
        rows.append((r[0], *held))
        held = [a + b for a, b in zip(held, r[1:], strict=True)]
    df = dealt.carried(rows, ", ".join(f"_gaps{i} long" for i in range(len(columns))))
    return df, {c: F.col(f"_gaps{i}") + F.count(F.when(gap(c), 1)).over(dealt.inner.sofar()) for i, c in enumerate(columns)}


# ---------------------------------------------------------- moving moments


def merged(a, b, divide=lambda x, y: x / y if y else 0.0):
    """Count, mean and central moments (n, m, s2, s3, s4) of two sets of values together; numbers or columns."""
    (na, ma, a2, a3, a4), (nb, mb, b2, b3, b4) = a, b
    n, d = na + nb, mb - ma
    part = divide(na * nb, n)
    u = divide(d, n)
    return (
        n,
        ma + u * nb,
        a2 + b2 + d * d * part,
        a3 + b3 + d * d * u * part * (na - nb) + 3 * u * (na * b2 - nb * a2),
        a4 + b4 + d * d * u * u * part * (na * na - na * nb + nb * nb) + 6 * u * u * (na * na * b2 + nb * nb * a2) + 4 * u * (na * b3 - nb * a3),
    )


def _moments(x: Column, over: Callable[[Column], Column]) -> list[Column]:
    """n, m, s2, s3, s4 of the engine's own aggregates; zeros where there are no values."""
    n, v = over(F.count(x)).cast("double"), over(F.var_pop(x))
    flat = (n == 0) | (v == 0)
    of = lambda value: F.when(flat, 0.0).otherwise(value)
    return [n, F.coalesce(over(F.avg(x)), F.lit(0.0)), F.coalesce(v * n, F.lit(0.0)), of(over(F.skewness(x)) * n * F.pow(v, F.lit(1.5))), of((over(F.kurtosis(x)) + 3) * n * v * v)]


def expanding_values(frame: OrderedFrame) -> tuple[Dealt, DataFrame, dict[str, dict[str, Column]]]:
    """For each column: n, rows, known, m, s2, s3, s4, sum, min and max of all rows so far."""
    dealt = deal(frame)
    per = [a for c in frame.columns for a in (*_moments(finite(c), lambda a: a), F.sum(finite(c)), F.min(finite(c)), F.max(finite(c)), F.count(known(c)))]
    rows, total = [], 0
    held = [((0.0,) * 5, None, None, None, 0) for _ in frame.columns]
    either = lambda f, a, b: b if a is None else a if b is None else f(a, b)
    for r in dealt.summary(F.count(F.lit(1)), *per):
        rows.append((r[0], total, *[x for h in held for x in (*h[0], *h[1:])]))
        total += r[1]
        new = []
        for i, h in enumerate(held):
            own = r[2 + 9 * i : 11 + 9 * i]
            new.append((merged(h[0], tuple(own[:5])), either(lambda a, b: a + b, h[1], own[5]), either(min, h[2], own[6]), either(max, h[3], own[7]), h[4] + own[8]))
        held = new
    names = ("n", "m", "s2", "s3", "s4", "sum", "min", "max")
    fields = [x for i in range(len(held)) for x in (*[f"_{k}{i} double" for k in names], f"_known{i} long")]
    df = dealt.carried(rows, ", ".join(["_rows long", *fields]))
    w = dealt.inner.sofar()
    over = lambda a: a.over(w)
    local = {c: [x.alias(f"_own{i}_{k}") for k, x in enumerate(_moments(finite(c), over))] for i, c in enumerate(frame.columns)}
    df = df.select("*", over(F.count(F.lit(1))).alias("_own_rows"), *[x for xs in local.values() for x in xs])
    df = df.select("*", *[f(finite(c)).over(w).alias(f"_own{i}_{k}") for i, c in enumerate(frame.columns) for k, f in (("sum", F.sum), ("min", F.min), ("max", F.max))], *[F.count(known(c)).over(w).alias(f"_own{i}_known") for i, c in enumerate(frame.columns)])
    found = {}
    for i, c in enumerate(frame.columns):
        before, own = [F.col(f"_{k}{i}") for k in names[:5]], [F.col(f"_own{i}_{k}") for k in range(5)]
        both = merged(before, own, lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0)))
        found[c] = dict(zip(names[:5], both, strict=True))
        found[c] |= {k: _JOIN[k](F.col(f"_{k}{i}"), F.col(f"_own{i}_{k}")) for k in ("sum", "min", "max")}
        found[c] |= {"rows": F.col("_rows") + F.col("_own_rows"), "known": F.col(f"_known{i}") + F.col(f"_own{i}_known")}
    return dealt, df, found


def expanding(frame: OrderedFrame, name_of: Callable[[str], str], least: int, ddof: int = 1) -> DataFrame:
    """A statistic for each column of all rows so far in the whole order (not median and quantile, which cannot be merged)."""
    dealt, df, found = expanding_values(frame)

    def value(c: str) -> Column:
        v, name = found[c], name_of(c)
        n, s2 = v["n"], v["s2"]
        var = F.try_divide(s2, F.when(n > ddof, n - ddof))
        flat = s2 == 0
        if name == "sum":
            return F.when(n >= least, v["sum"]) if least else F.coalesce(v["sum"], F.lit(0.0))
        if name == "mean":
            return F.when((n >= least) & (n > 0), v["m"])
        if name in ("min", "max"):
            return F.when(n >= least, v[name])
        if name == "count":
            return F.when(v["rows"] >= least, v["known"].cast("double"))
        if name in ("std", "var"):
            return F.when(n >= max(least, ddof + 1), F.sqrt(var) if name == "std" else var)
        if name == "sem":
            at = v["known"].cast("double")
            return F.when(n >= max(least, ddof + 1), F.try_divide(F.sqrt(var), F.sqrt(F.when(at > ddof, at - ddof))))
        if name == "skew":
            g1 = F.try_divide(F.sqrt(n) * v["s3"], F.pow(s2, F.lit(1.5)))
            return F.when(n >= max(least, 3), F.when(flat, 0.0).otherwise(F.try_divide(g1 * F.sqrt(n * (n - 1)), n - 2)))
        g2 = F.try_divide(n * v["s4"], s2 * s2) - 3
        return F.when(n >= max(least, 4), F.when(flat, -3.0).otherwise(F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6)))

    return dealt.result(df, {c: value(c) for c in frame.columns})
