"""Connected components of a table of links: forests within tasks, then star contractions between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._common import discard, gives_back, spread_join, written

#: Links that a task holds at a time.
CHUNK = 1 << 20


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of every node to the least node that it is connected with by these links."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    least = np.arange(len(nodes))
    while True:
        # Every root takes the least root across any of its links; then paths are halved until they end.
        ra, rb = least[a], least[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(least, np.maximum(ra, rb), np.minimum(ra, rb))
        while (least[least] != least).any():
            least = least[least]
    child = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[least[child]], nodes[child]


def _forests(links: DataFrame) -> DataFrame:
    """The links of each task, a bounded number at a time, as stars around least nodes."""

    @gives_back
    def reduce(batches):
        held: list = []

        def stars():
            u, v = _forest(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK:
                yield stars()
                held = []
        if held:
            yield stars()

    return links.mapInArrow(reduce, "u long, v long")


def _all_stars(links: DataFrame) -> bool:
    """Whether every node is either a root or the child of one root."""
    ends = links.select(F.col("u").alias("node"), F.lit(None).cast("long").alias("of")).union(links.select("v", "u"))
    seen = ends.groupBy("node").agg(F.count("of").alias("child"), F.count("*").alias("n"), F.min("of").alias("a"), F.max("of").alias("b"))
    return seen.where((F.col("child") > 0) & ((F.col("child") < F.col("n")) | (F.col("a") < F.col("b")))).limit(1).count() == 0


def _larger_to_least(links: DataFrame, n: int) -> DataFrame:
    """Each node hands its larger neighbours to the least node it knows."""
    both = links.union(links.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
    return spread_join(both, least, "u", "n", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _smaller_to_least(links: DataFrame, n: int) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    handed = spread_join(links, least, "u", "n", n).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return handed.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node it is connected with) for links u, v of longs.

    Links may stand in either direction and more than once; a link of a node
    to itself is ignored, and only nodes with other links appear.  Each task
    first reduces its links to stars; where stars of different tasks still
    meet, a round of contractions hands nodes on to lesser ones.  Minima are
    made before each shuffle, a node with very many links is joined where its
    links are, and each round ends in a table in the shared folder, so nothing
    is gathered and lost executors cost one round.  Rounds go on until only
    stars are left, which takes some logarithm of the longest path.
    """
    links = links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v")
    links = written(_forests(links.distinct()), "links")
    while not _all_stars(links):
        n = max(links.count(), 1)
        handed = written(_larger_to_least(links, n), "links")
        contracted = _smaller_to_least(handed, n).select(F.col("v").alias("u"), F.col("u").alias("v")).where("u <> v")
        after = written(_forests(contracted), "links")
        discard(links, handed)
        links = after
    roots = links.select(F.col("u").alias("node")).distinct()
    return links.select(F.col("v").alias("node"), F.col("u").alias("root")).union(roots.select("node", F.col("node").alias("root")))
