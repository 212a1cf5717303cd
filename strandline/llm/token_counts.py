"""Token counts by a two-tier lookup on the map side.

Tier one is a broadcast table of frequent pre-tokens and their token counts,
tier two each worker's own cache; a pre-token that neither knows is encoded
once.  No pre-token ever takes part in a shuffle, and counts never depend on
what the table holds: it only saves encoding.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._common import gives_back, once, pick, steps, table
from strandline.llm.pretokens import Encoder, without_collector

VOCABULARY = "byte_bpe_50k.json"
#: The table of frequent pre-tokens is made from at most this many partitions,
#: spread evenly over the input, and this many rows of each ...
SAMPLE_PARTITIONS = 12
SAMPLE_ROWS = 200
#: ... and holds at most this many entries, about 16 bytes each in compact form.
TABLE_ENTRIES = 16_384


def frequent_pre_tokens(rows: DataFrame, path: str, partitions: int = SAMPLE_PARTITIONS, per_partition: int = SAMPLE_ROWS, entries: int = TABLE_ENTRIES) -> tuple[bytes, bytes, bytes]:
    """A compact table of frequent pre-tokens: texts, byte lengths, token counts.

    Only a bounded number of partitions runs, and each sends at most
    ``entries`` pairs, so neither work nor memory grows with the input.
    """
    column = rows.columns[-1]

    @gives_back
    def count(batches):
        seen, left, cut = Counter(), per_partition, Encoder(path, len).pre_tokens
        for batch in batches:
            for text in batch.column(0).slice(0, left).to_pylist():
                seen.update(cut(text or ""))
            left -= min(left, batch.num_rows)
            if not left:
                break
        top = [(t, n) for t, n in seen.most_common(entries) if len(t.encode()) < 256]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["t", "n"])

    counted = rows.select(column).mapInArrow(count, "t string, n long").rdd
    total = counted.getNumPartitions()
    chosen = sorted({i * total // partitions for i in range(partitions)}) if total > partitions else list(range(total))
    seen: Counter = Counter()
    for t, n in rows.sparkSession.sparkContext.runJob(counted, lambda it: [(r[0], r[1]) for r in it], chosen) if chosen else []:
        seen[t] += n
    top = [t for t, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:entries]]
    encoder = Encoder(path, len)
    known = [(t.encode(), sum(encoder.parts(t))) for t in top]
    known = [(b, n) for b, n in known if n < 256]
    return b"".join(b for b, _ in known), bytes(len(b) for b, _ in known), bytes(n for _, n in known)


def _encoder(shared: tuple) -> Encoder:
    """This worker's encoder to counts, with the compact table unpacked once."""
    path, (texts, sizes, counts) = shared
    ends = np.cumsum(np.frombuffer(sizes, np.uint8), dtype=np.int64).tolist()
    return Encoder(path, len, [(texts[a:b].decode(), n) for a, b, n in zip([0, *ends], ends, counts, strict=False)])


def count_tokens(df: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None, limit: int = 1024) -> DataFrame:
    """Tokens of each text by the library's byte-level vocabulary.

    Result: the key, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more
    than ``limit`` tokens), one row for each input row.  A null text counts as
    empty: no bytes and no tokens.  No special tokens are added; a special
    token's string inside a text is one token, as the library's default has it.
    Repeated rows are counted alike, whole texts however long; columns other
    than key and text are not looked at.  An empty table gives an empty result.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    rows = pick(df, key, text)
    spread = rows.sparkSession.sparkContext.broadcast((path, frequent_pre_tokens(rows, path)))

    @gives_back
    def count(batches):
        encoder = once(spread, _encoder)
        for batch in batches:
            for part in steps(batch):
                texts = part.column(1).to_pylist()
                with without_collector():
                    counts = [sum(encoder.parts(t)) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                        pa.array(counts, pa.int64()),
                    ],
                    names=[key, "n_bytes", "n_tokens"],
                )

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(count, f"`{key}` {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return count_tokens(table(spark, sf_dir, "documents"))
