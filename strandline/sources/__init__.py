"""Ways into and out of ordered frames: files, tables, pandas, wide and long layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.frame import OrderedFrame, ordered


def read(spark: SparkSession, path: str, order_by=None, partition_by=None, columns=None, format: str = "parquet", **options) -> OrderedFrame:  # noqa: A002
    """An ordered frame over files of any format Spark reads; columns are pruned and filters pushed down by Spark."""
    return ordered(spark.read.format(format).options(**options).load(path), order_by, partition_by, columns)


def from_pandas(spark: SparkSession, pdf, index: str = "index") -> OrderedFrame:
    """A pandas frame; its row order becomes the column ``index`` (0, 1, ...) where no such column exists."""
    if index not in pdf.columns:
        pdf = pdf.reset_index(drop=True).rename_axis(index).reset_index()
    return ordered(spark.createDataFrame(pdf), index)


def to_long(frame: OrderedFrame, name: str = "column", value: str = "value") -> DataFrame:
    """One row for each key and value column: the layout for hundreds of columns."""
    keys = list(dict.fromkeys([*frame.partition_by, *frame.order_by]))
    cells = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in frame.columns])
    return frame.df.select(*keys, F.inline(cells))


def long_frame(df: DataFrame, order_by: str | Sequence[str], name: str = "column", value: str = "value", partition_by: Sequence[str] = ()) -> OrderedFrame:
    """An ordered frame over a long table: every original column is a partition, so columns run in parallel."""
    return ordered(df, order_by, [*partition_by, name], value)


def to_wide(df: DataFrame, keys: Sequence[str], names: Sequence[str], name: str = "column", value: str = "value") -> DataFrame:
    """Back from long to wide; giving the names saves a pass over the data."""
    return df.groupBy(*keys).pivot(name, list(names)).agg(F.first(value))


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = (), **options) -> None:  # noqa: A002
    writer = df.write.format(format).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
