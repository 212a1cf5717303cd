"""Token-id files: documents in key order as Simple-8b units, written and read back.

A shard is a range of keys.  Its units (see ``simple8b``) are rows of a Parquet
table that only serves as a container: Spark's commit protocol makes a shard
appear whole or not at all, on any store Spark can write, and tasks of lost
executors simply run again.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm._common import fresh_path, gives_back, pick, steps, table
from strandline.llm.pretokens import CACHE_ENTRIES, Encoder, id_bytes, without_collector
from strandline.llm.simple8b import Unit, pack_unit

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: A unit is closed once it has so many ids; one document is never split.
UNIT_IDS = 1 << 18


def write_token_files(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", vocabulary: str | None = None, end_id: int = END_ID, cache_entries: int = CACHE_ENTRIES) -> None:
    """Encode each text, add the end id, and write units in ascending key order.

    Keys are integers (other types must cast to long).  Null keys come first;
    rows with equal keys stand in the order of a hash of their texts, so reruns
    write the same ids in the same order, and repeated rows may be dealt to
    several shards.  A null or empty text has the end id only; a very long one
    is never split.  An empty table writes a table without units.
    ``cache_entries`` bounds each half of a worker's cache: fewer take less
    memory and more encoding, and change no id.
    """
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    rows = pick(df, key, text)
    # A range may end within equal keys, and within equal rows too, since none of these is told apart.
    rows = rows.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.monotonically_increasing_id().alias("nth"))
    place = ("k", F.xxhash64(F.coalesce("t", F.lit(""))), "nth")

    @gives_back
    def encode(batches):
        encoder = Encoder.shared(vocabulary, cache_entries)
        end = id_bytes([end_id])
        shard, unit, before = TaskContext.get().partitionId(), 0, 0
        keys, lengths, parts, size = [], [], [], 0

        def packed():
            data = pack_unit(keys, lengths, np.frombuffer(b"".join(parts), "<u4"), before)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([unit], pa.int32()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], names=["shard", "unit", "n_ids", "data"])

        for batch in batches:
            for part in steps(batch):
                with without_collector():
                    encoded = [b"".join(encoder.parts(t)) + end for t in part.column(1).to_pylist()]
                for k, ids in zip(part.column(0).to_pylist(), encoded, strict=True):
                    keys.append(k)
                    lengths.append(len(ids) // 4)
                    parts.append(ids)
                    size += len(ids) // 4
                    if size >= UNIT_IDS:
                        yield packed()
                        unit, before = unit + 1, before + size
                        keys, lengths, parts, size = [], [], [], 0
        if keys:
            yield packed()

    ordered = rows.repartitionByRange(*place).sortWithinPartitions(*place)
    ordered.mapInArrow(encode, "shard int, unit int, n_ids long, data binary").write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """One row for each document in the files: key, ``start``, ``n_tokens``, ``ids``.

    ``start`` counts the ids of all documents before it.  Only one number for
    each shard passes the driver.  Damaged units raise ValueError.
    """
    return _decoded(spark, path, key, digest=False)


def _decoded(spark: SparkSession, path: str, key: str, digest: bool) -> DataFrame:
    units = spark.read.schema("shard int, unit int, n_ids long, data binary").parquet(path)
    sizes = {r.shard: r.n for r in units.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    shards = sorted(sizes)
    begins = dict(zip(shards, accumulate([0, *(sizes[s] for s in shards)]), strict=False))

    @gives_back
    def decode(batches):
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                unit = Unit(data.as_py())
                ids = unit.ids().astype("<u4")
                ends = np.cumsum(unit.lengths)
                starts = ends - unit.lengths
                base = begins[shard] + unit.before
                if digest:
                    raw = memoryview(ids.tobytes())
                    last = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(unit.keys, pa.int64()), pa.array(starts + base, pa.int64()), pa.array(unit.lengths, pa.int64()), last], names=[key, "start", "n_tokens", "last"])

    kind, name = ("long", "ids_crc32") if digest else ("array<int>", "ids")
    return units.select("shard", "data").mapInArrow(decode, f"`{key}` long, start long, n_tokens long, last {kind}").withColumnRenamed("last", name)


def token_file_digests(df: DataFrame, **options) -> DataFrame:
    """Write token files, read them back: each document's place and crc32 of its ids."""
    spark = df.sparkSession
    path = fresh_path(spark, "token-files")
    write_token_files(df, path, **options)
    return _decoded(spark, path, options.get("key", "doc_id"), digest=True)


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents through token files and back."""
    return token_file_digests(table(spark, sf_dir, "documents"))
