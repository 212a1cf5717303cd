"""Line dedup by winnowing over line hashes.

A window is the shortest run of lines from a given line on, or up to a given
line, that has at least ``min_words`` words.  Each window's smallest line hash
is a fingerprint, so two documents that share such a run share a fingerprint,
wherever the run stands.  Fingerprints that occur once are done with; the
others' positions are joined and bring their windows; each window's first
occurrence is found, and later ones are deleted.  A match is extended both
ways: forwards by the windows up to each further line, backwards by those from
each earlier line on.  Together these cover a repeated run to its full length,
and no pair of documents ever has to meet.
"""

from __future__ import annotations

import struct

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._common import discard, gives_back, maybe_among, pick, spread_join, steps, table, with_place, written

#: A repeated run is deleted from this many words on.
MIN_WORDS = 50


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def windows(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, int, int, int]]:
    """Fingerprint, its place, window hash, first and last line of each window of the text.

    A window is a run of ``min_words`` words that has fewer without its last
    line, or fewer without its first; there are at most two for each line.
    Lines are compared without white space around them; blank lines are passed
    over.  Among equal smallest hashes the last is the fingerprint, so equal
    windows always have it in the same place.
    """
    lines = [(i, line.strip()) for i, line in enumerate(text.split("\n"))]
    lines = [(i, line, len(line.split())) for i, line in lines if line]
    hashes = [xxhash.xxh3_64_intdigest(line) for _, line, _ in lines]
    spans = []
    end = size = 0
    for begin in range(len(lines)):
        while end < len(lines) and size < min_words:
            size += lines[end][2]
            end += 1
        if size < min_words:
            break
        spans.append((begin, end))
        size -= lines[begin][2]
        # Further ends, up to where the window of the next line ends.
        reach, rest = end, size
        while reach < len(lines) and rest + lines[reach][2] < min_words:
            rest += lines[reach][2]
            reach += 1
            spans.append((begin, reach))
    out = []
    for begin, end in spans:
        run = hashes[begin:end]
        least = min(run)
        out.append((_signed(least), end - run[::-1].index(least), _signed(xxhash.xxh3_64_intdigest(struct.pack(f"<{len(run)}Q", *run))), lines[begin][0], lines[end - 1][0]))
    return out


def _fingerprints(rows: DataFrame, min_words: int) -> DataFrame:
    """One row for each fingerprint position, with the windows it stands for."""
    kind = rows.schema["k"].dataType.simpleString()
    windows_of = pa.list_(pa.struct([("gram", pa.int64()), ("first", pa.int32()), ("end", pa.int32())]))

    @gives_back
    def select(batches):
        for batch in batches:
            for part in steps(batch):
                fps, at, held = [], [], []
                for row, t in enumerate(part.column(2).to_pylist()):
                    last = None
                    for fp, place, gram, first, end in windows(t, min_words):
                        if place != last:
                            fps.append(fp)
                            at.append(row)
                            held.append([])
                            last = place
                        held[-1].append({"gram": gram, "first": first, "end": end})
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), part.column(0).take(at), part.column(1).take(at), pa.array(held, windows_of)], names=["fp", "k", "h", "held"])

    return rows.mapInArrow(select, f"fp long, k {kind}, h long, held array<struct<gram:long,first:int,end:int>>")


def repeated_windows(df: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """Windows that occurred before, without lines of their first occurrence: columns k, h (a document), first, end (lines)."""
    rows = with_place(pick(df, key, text), key, text).select("k", "h", F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = written(_fingerprints(rows, min_words), "fingerprints")
    # Counts are taken before the shuffle; nothing gathers a common fingerprint's rows.
    shared = written(found.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1"), "shared-fingerprints")
    total = max(found.count(), 1)
    held = spread_join(found, shared, "fp", "n", total).select("k", "h", F.explode("held").alias("w")).select("k", "h", "w.*")
    held = written(held, "repeated-windows")
    # Documents of the same key are told apart by their texts, so one of them is the first.
    place = F.struct("k", "h", "first")
    first = held.groupBy("gram").agg(F.min(F.struct("k", "h", "first", "end")).alias("origin"), F.count("*").alias("n")).where("n > 1")
    first = written(first, "window-origins")
    later = spread_join(held, first, "gram", "n", max(held.count(), 1)).where(place > F.struct("origin.k", "origin.h", "origin.first"))
    # In the origin's own document its lines stay, also where a later window overlaps them.
    own = (F.col("k") == F.col("origin.k")) & (F.col("h") == F.col("origin.h"))
    runs = written(later.select("k", "h", F.when(own, F.greatest("first", F.col("origin.end") + 1)).otherwise(F.col("first")).alias("first"), "end"), "repeated-runs")
    discard(found, shared, held, first)
    return runs


def dedup_lines(df: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """Delete runs of lines that occurred before.

    Before is by ascending key (null first), among equal keys by a hash of the
    text, then by line.  Only runs of ``min_words`` words or more count; the
    first occurrence stays.  Rows with the same key and text are the same place
    and treated alike: neither is later than the other.  Keys are integers, or
    are compared as text.  An empty table gives an empty result.

    Result, a row for each input row: the key, ``text`` (what stays; null stays
    null), ``n_lines`` and ``removed_lines``.  Documents without repeated runs
    are not shuffled.
    """
    rows = with_place(pick(df, key, text), key, text)
    gone = repeated_windows(df, text, key, min_words).groupBy("k", "h").agg(F.array_sort(F.collect_set(F.struct("first", "end"))).alias("runs"), F.count("*").alias("n"))
    gone = written(gone, "runs-of-documents")
    rows = rows.withColumn("maybe", maybe_among(rows, gone, gone.count(), "k", "h"))
    touched = rows.where("maybe").join(gone, ["k", "h"], "left").select(key, text, "runs")
    joined = rows.where("not maybe").select(key, text, F.lit(None).cast(gone.schema["runs"].dataType).alias("runs")).unionByName(touched)

    @gives_back
    def cut(batches):
        for batch in batches:
            for part in steps(batch):
                texts, totals, counts = [], [], []
                for t, runs in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    lines = t.split("\n") if t is not None else []
                    drop = {i for r in runs or () for i in range(r["first"], r["end"] + 1)}
                    texts.append(None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else t)
                    totals.append(len(lines))
                    counts.append(len(drop))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(totals, pa.int32()), pa.array(counts, pa.int32())], names=[key, text, "n_lines", "removed_lines"])

    kind = rows.schema[key].dataType.simpleString()
    return joined.mapInArrow(cut, f"`{key}` {kind}, `{text}` string, n_lines int, removed_lines int")


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the runs of lines that came before."""
    return dedup_lines(table(spark, sf_dir, "documents"))
