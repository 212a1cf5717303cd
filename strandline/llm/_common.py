"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.plans.tables import discard, fresh_path, shared_dir, written

__all__ = ["DOCUMENT_COLUMNS", "discard", "fresh_path", "gives_back", "held", "id_crc32", "least_key", "maybe_among", "numbered", "once", "pick", "restored", "result_names", "shared_dir", "spread_join", "steps", "table", "with_place", "written"]

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Rows, and bytes, handed through Python code at a time; they bound a worker's memory.
ROWS_PER_STEP = 256
BYTES_PER_STEP = 32 << 20
#: A key is hot if more than this part of all rows have it, so there are no
#: more hot keys than this number, however large the table.
HOT_KEYS = 500
#: Bits of a Bloom filter for each of its keys, and the most that it may have (64 MB).
BITS_PER_KEY, MOST_BITS = 16, 1 << 29


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by exact spelling, even where others differ only by case."""
    columns = df.columns
    return numbered(df).select(*[F.col(f"_c{columns.index(n)}").alias(n) for n in names])


def numbered(df: DataFrame) -> DataFrame:
    """Columns renamed to _c0, _c1, ...: nothing that an operator adds can clash with them."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def restored(df: DataFrame, columns: list[str]) -> DataFrame:
    """The numbered columns under their own names again, and no others."""
    return df.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)])


def id_crc32(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


_HELD: list = [None, None, None]


def held(kind, source, make):
    """``make()``, made once in each worker process for this ``source``; only the last such thing is kept."""
    if _HELD[0] is not kind or _HELD[1] is not source:
        _HELD[:] = [None, None, None]  # what was held goes before the next is made
        _HELD[:] = [kind, source, make()]
    return _HELD[2]


def once(spread, make):
    """``make`` of a broadcast value, made once in each worker process."""
    value = spread.value
    return held(make, value, lambda: make(value))


def result_names(keep, own) -> dict[str, str]:
    """Names of an operator's own result columns beside kept ones: one that clashes gets ``_found`` behind it."""
    taken, out = set(keep), {}
    for name in own:
        free = name
        while free.lower() in {t.lower() for t in taken}:
            free += "_found"
        taken.add(free)
        out[name] = free
    return out


def steps(batch, size: int = ROWS_PER_STEP, most_bytes: int = BYTES_PER_STEP):
    """Slices of an Arrow batch of at most ``size`` rows and, unless one row alone has more, ``most_bytes`` of text."""
    if batch.nbytes <= most_bytes:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)
        return
    long = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type)]
    held = np.zeros(batch.num_rows, np.int64)
    for c in long:
        held += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for row, n in enumerate(held.tolist()):
        if row > begin and (row - begin >= size or total + n > most_bytes):
            yield batch.slice(begin, row - begin)
            begin, total = row, 0
        total += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def gives_back(task):
    """A function of batches that hands the memory it used back to the system when its task ends.

    Python workers outlive their tasks, and allocators keep what was freed;
    without this, each operator's peak stays with the worker for the next one.
    """

    @wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
            if trim is not None:
                trim(0)

    return run


def least_key(kind: T.DataType):
    """What a null key counts as: the least integer, or for any other type (compared as text) the empty text."""
    return -(1 << 63) if isinstance(kind, T.IntegralType) else ""


def with_place(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Rows with k and h: a document is its key (a long, or text; null: the least one) and its text's hash."""
    kind = rows.schema[key].dataType
    k = F.coalesce(F.col(key).cast("long" if isinstance(kind, T.IntegralType) else "string"), F.lit(least_key(kind)))
    return rows.withColumns({"k": k, "h": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})


def spread_join(rows: DataFrame, unique: DataFrame, key: str | list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``rows`` with a table that has each key once, without sending a hot key's rows to one task.

    ``count`` is the column of ``unique`` that tells how many of the ``total``
    rows have the key.  Keys with more than a 500th of all rows (by
    arithmetic fewer than 500) are joined by broadcast where their rows are;
    the rest are shuffled.
    """
    hot = F.col(count) > total // HOT_KEYS
    few = unique.where(hot)
    apart = rows.join(F.broadcast(few), key)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(unique.where(~hot), key, how)
    return apart.unionByName(rest)


def maybe_among(rows: DataFrame, keys: DataFrame, n: int, *columns: str) -> Column:
    """A condition that is true for all ``rows`` whose columns are among the ``n`` ``keys``, and for few others.

    A Bloom filter of bounded size; a filter too full to tell anything apart is
    true for all.  Only a hash of the columns goes through Python, never the rest.
    """
    spark = rows.sparkSession
    bits = 1 << 15
    while bits < BITS_PER_KEY * n and bits < MOST_BITS:
        bits *= 2
    places = lambda: [F.pmod(F.xxhash64(F.lit(k), *columns), F.lit(bits)) for k in range(3)]
    at = keys.select(F.explode(F.array(*places())).alias("at")).select((F.col("at") + 1).alias("at"))
    # Bitmaps of 32,768 bits each, so at most bits / 32,768 of them come together; buckets and bits count from 1.
    maps = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map")).collect()
    held = np.zeros(bits // 8, np.uint8)
    for r in maps:
        held[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.map, np.uint8)
    spread = spark.sparkContext.broadcast(held.tobytes())

    def test(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        held = np.frombuffer(spread.value, np.uint8)
        hit = np.ones(len(a), np.uint8)
        for places in (a, b, c):
            at = places.to_numpy(zero_copy_only=False)
            hit &= held[at >> 3] >> (at & 7).astype(np.uint8)
        return pa.array((hit & 1).astype(bool))

    return F.arrow_udf(test, "boolean")(*places())
