"""Ranks down the rows, with all tie and missing-value policies.

With ``partition_by`` each partition is ranked by window functions.  Without,
ranks come from counts of distinct values: these are summed up over ranges of
values in parallel and joined back, so no task ever holds all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.frame import OrderedFrame
from strandline.functions.missing import divided, known
from strandline.plans import scale

METHODS = ("rank",)
TIES = ("average", "min", "max", "first", "dense")


def _ordered(x: Column, ascending: bool, na_option: str) -> Column:
    if na_option == "top":
        return F.asc_nulls_first(x) if ascending else F.desc_nulls_first(x)
    return F.asc_nulls_last(x) if ascending else F.desc_nulls_last(x)


def ranked(frame: OrderedFrame, c: str, method: str, na_option: str, ascending: bool, pct: bool) -> Column:
    """The rank within the partition as an expression."""
    x = known(c)
    parts = W.partitionBy(*frame.partition_by)
    by_value = parts.orderBy(_ordered(x, ascending, na_option))
    ties = F.count(F.lit(1)).over(W.partitionBy(*frame.partition_by, x))
    least = F.rank().over(by_value).cast("double")
    if method == "average":
        value = least + (ties - 1) / 2
    elif method == "min":
        value = least
    elif method == "max":
        value = least + ties - 1
    elif method == "first":
        value = F.row_number().over(parts.orderBy(_ordered(x, ascending, na_option), *frame.order)).cast("double")
    elif method == "dense":
        value = F.dense_rank().over(by_value).cast("double")
    else:
        raise ValueError(f"unknown method {method!r}")
    kept = na_option == "keep"
    if pct:
        if method == "dense":
            # A value's dense ranks from both ends add up to the number of values and one.
            mirror = "keep" if kept else {"top": "bottom", "bottom": "top"}[na_option]
            total = value + F.dense_rank().over(parts.orderBy(_ordered(x, not ascending, mirror))) - 1
        else:
            total = (F.count(x) if kept else F.count(F.lit(1))).over(parts)
        value = divided(value, total.cast("double"))
    return F.when(x.isNotNull(), value) if kept else value


def rank(frame: OrderedFrame, method: str = "average", na_option: str = "keep", ascending: bool = True, pct: bool = False) -> DataFrame:
    """Rank each value column.

    ``method`` is average, min, max, first (by the frame's order) or dense;
    missing values are kept missing, or tie at the top or bottom; ``pct``
    divides by the number of ranked rows (dense: of distinct values).
    """
    if method not in TIES:
        raise ValueError(f"unknown method {method!r}")
    if na_option not in ("keep", "top", "bottom"):
        raise ValueError(f"unknown na_option {na_option!r}")
    if method == "first" and not frame.order_by:
        raise ValueError("method 'first' needs order_by")
    if frame.partition_by:
        return frame.mapped(lambda c: ranked(frame, c, method, na_option, ascending, pct))
    out = frame.df
    for c in frame.columns:
        if method == "first":
            out = _numbered_by_value(frame, out, c, na_option, ascending, pct)
        else:
            out = _ranked_by_counts(out, c, method, na_option, ascending, pct)
    return out.select(*frame.df.columns)


def _numbered_by_value(frame: OrderedFrame, df: DataFrame, c: str, na_option: str, ascending: bool, pct: bool) -> DataFrame:
    """Rank "first": the number of rows up to each one, by value and then in the frame's order."""
    x = known(c)
    counted = F.when(x.isNotNull(), 1).otherwise(None if na_option == "keep" else 1).cast("long")
    total = None
    if pct:
        total = df.agg(F.count(counted)).first()[0]
    df = scale.running_over_ranges(df.withColumn("_counted", counted), [_ordered(x, ascending, na_option), *frame.order], {"_nth": ("sum", "_counted")})
    value = F.when(F.col("_counted").isNotNull(), F.col("_nth").cast("double"))
    value = divided(value, F.lit(float(total))) if pct else value
    return df.select(*[value.alias(n) if n == c else F.col(n) for n in df.columns if n not in ("_counted", "_nth")])


def _ranked_by_counts(df: DataFrame, c: str, method: str, na_option: str, ascending: bool, pct: bool) -> DataFrame:
    x = known(c)
    counts = df.groupBy(x.alias("_value")).agg(F.count(F.lit(1)).alias("_ties"))
    if na_option == "keep":
        counts = counts.where("_value is not null")
    counts = counts.withColumn("_one", F.lit(1).cast("long"))
    summed = scale.running_over_ranges(counts, [_ordered(F.col("_value"), ascending, na_option)], {"_upto": ("sum", "_ties"), "_nth": ("sum", "_one")})
    value = {
        "average": F.col("_upto") - (F.col("_ties") - 1) / 2,
        "min": F.col("_upto") - F.col("_ties") + 1,
        "max": F.col("_upto"),
        "dense": F.col("_nth"),
    }[method].cast("double")
    if pct:
        total = counts.agg(F.sum("_one" if method == "dense" else "_ties").cast("double").alias("_total"))
        # One row, so it may go to every task.
        summed = summed.join(F.broadcast(total))
        value = divided(value, F.col("_total"))
    ranks = summed.select("_value", value.alias("_rank"))
    joined = df.withColumn("_mine", x).join(ranks, F.col("_mine").eqNullSafe(F.col("_value")), "left")
    return joined.select(*[F.col("_rank").alias(n) if n == c else F.col(n) for n in df.columns])
