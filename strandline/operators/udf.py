"""Python functions over float arrays, batch by batch.

This module has no postponed annotations: pandas UDFs read their types.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.missing import known


def column_function(func):
    """A float array -> float function as an aggregate over a whole column.

    Missing values reach it as NaN; NaN comes back as missing.
    """

    def whole(values: pd.Series) -> float:
        return float(func(values.to_numpy(np.float64)))

    call = F.pandas_udf(whole, "double")
    return lambda c: _known_result(call(F.coalesce(known(c), F.lit(float("nan")))))


def row_function(func):
    """A float array -> float function of the values of each row."""

    def rows(values: pd.Series) -> pd.Series:
        return pd.Series([float(func(np.asarray([np.nan if x is None else x for x in v], np.float64))) for v in values], dtype="float64")

    call = F.pandas_udf(rows, "double")
    return lambda columns: _known_result(call(F.array(*[known(c) for c in columns])))


def row_batches(func):
    """A function of a pandas frame of rows (missing: NaN) that gives a frame of the same shape, for an array column.

    Rows of a batch that have the same length are handed over together.
    """

    def batch(values: pd.Series) -> pd.Series:
        out = [None] * len(values)
        rows = [None if v is None else np.asarray([np.nan if x is None else x for x in v] if v.dtype == object else v, np.float64) for v in values]
        sizes = {}
        for at, r in enumerate(rows):
            if r is not None:
                sizes.setdefault(len(r), []).append(at)
        for at in sizes.values():
            made = func(pd.DataFrame(np.stack([rows[i] for i in at]))).to_numpy(np.float64)
            for i, r in zip(at, made, strict=True):
                out[i] = r
        return pd.Series(out, dtype=object)

    call = F.pandas_udf(batch, "array<double>")
    return lambda values: F.transform(call(values), lambda v: F.when(~F.isnan(v), v))


def cell_batches(func, shaped: bool):
    """A function of a list of float arrays, one for each column (missing: NaN), as a function of columns.

    It gives one float array, or if ``shaped`` a list of them, the elements of
    an array column.  Batches stay in Arrow's layout: no step is taken row by row.
    """

    def batch(*cells: pa.Array) -> pa.Array:
        made = func([c.to_numpy(zero_copy_only=False) for c in cells])
        if not shaped:
            return pa.array(made, pa.float64(), from_pandas=True)
        values = pa.array(np.column_stack(made).ravel(), pa.float64(), from_pandas=True)
        return pa.ListArray.from_arrays(np.arange(0, len(values) + 1, len(made), dtype=np.int32), values)

    return F.arrow_udf(batch, "array<double>" if shaped else "double")


def vectorized(func):
    """Decorator: a numpy function of whole batches of a column as a column function."""

    def batch(values: pd.Series) -> pd.Series:
        return pd.Series(func(values.to_numpy(np.float64)))

    call = F.pandas_udf(batch, "double")
    return lambda c: _known_result(call(F.coalesce(known(c), F.lit(float("nan")))))


def _known_result(c: Column) -> Column:
    return F.nullif(c, F.lit(float("nan")))
