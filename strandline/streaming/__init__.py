"""Running statistics over streams: constant state for each key, late rows cut off by a watermark."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.ewm import decay

_STATE = "n long, total double, least double, most double, mean double, weight double, last double"


def running_statistics(stream: DataFrame, key: str, order_by: str, value: str, span: float = 20, watermark: str = "10 minutes") -> DataFrame:
    """For each row of the stream: cumulative sum, minimum, maximum, difference and weighted mean of its key.

    Rows are ordered by ``order_by`` (a timestamp) within a micro-batch; rows
    later than the watermark are dropped by Spark.  A missing value leaves the
    statistics as they are and shows them missing.
    """
    r = 1 - decay(span=span)

    def update(group, batches, state):
        n, total, least, most, mean, weight, last = state.get if state.exists else (0, 0.0, math.inf, -math.inf, 0.0, 0.0, math.nan)
        rows = pd.concat(list(batches), ignore_index=True).sort_values("o", kind="stable")
        out = []
        for o, x in zip(rows["o"], rows["x"], strict=True):
            weight *= r
            if x is None or x != x:
                out.append((group[0], o, None, None, None, None, None, mean if n else None))
                last = math.nan
                continue
            change = x - last if last == last else None
            n, total, least, most = n + 1, total + x, min(least, x), max(most, x)
            mean = (weight * mean + x) / (weight + 1)
            weight, last = weight + 1, x
            out.append((group[0], o, x, total, least, most, change, mean))
        state.update((n, total, least, most, mean, weight, last))
        yield pd.DataFrame(out, columns=["k", "o", "x", "cumsum", "cummin", "cummax", "diff", "ewm_mean"])

    rows = stream.withWatermark(order_by, watermark).select(F.col(key).alias("k"), F.col(order_by).alias("o"), F.col(value).cast("double").alias("x"))
    kind = rows.schema["k"].dataType.simpleString()
    found = rows.groupBy("k").applyInPandasWithState(
        update, f"k {kind}, o timestamp, x double, cumsum double, cummin double, cummax double, diff double, ewm_mean double", _STATE, "append", "NoTimeout"
    )
    return found.withColumnsRenamed({"k": key, "o": order_by, "x": value})


def windowed_statistics(stream: DataFrame, key: str, order_by: str, value: str, window: str = "1 hour", slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding time windows of a stream: count, sum, mean, min, max, std."""
    x = F.col(value).cast("double")
    grouped = stream.withWatermark(order_by, watermark).groupBy(key, F.window(order_by, window, slide) if slide else F.window(order_by, window))
    out = grouped.agg(F.count(x).alias("count"), F.sum(x).alias("sum"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), F.stddev_samp(x).alias("std"))
    return out.select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "count", "sum", "mean", "min", "max", "std")
