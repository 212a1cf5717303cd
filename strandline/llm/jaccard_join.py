"""N-gram Jaccard join along chosen paths.

Texts become sets of five-word shingles.  Equal sets are one class, so copies
cost nothing further.  A class is embedded in ``COORDINATES`` min-hash tokens;
from the root of each run a path chooses one or more of them (by a hash of the
path itself, so all classes choose alike), follows the class's token there,
and so splits the classes again and again.  A bucket that is still large after
``DEPTH`` levels is split further, as long as that saves comparisons.  Classes
of a small bucket are compared pair by pair by their tokens; groups tied by
enough equal tokens are then compared by brute force with exact sets.  Runs
repeat until a pair at the threshold is found with the target recall.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm._common import discard, gives_back, least_key, maybe_among, numbered, pick, restored, spread_join, steps, table, with_place, written
from strandline.llm.components import components

WORDS = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.99
COORDINATES = 128
DEPTH = 7
#: Buckets of more classes than this are split further, this many levels at a
#: time, with runs enough to lose no more than a thousandth of the pairs.
SPLIT, SPLIT_DEPTH, SPLIT_RECALL = 4096, 4, 0.999
#: Classes, and bytes of text, compared in one block; larger groups are compared block by block.
BLOCK, BLOCK_BYTES = 512, 32 << 20
#: Classes of a bucket whose tokens are compared in one block.
TOKEN_BLOCK = 512
_WORD_CACHE = 500_000

_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


@dataclass(frozen=True)
class Paths:
    """What follows from the threshold: how paths branch, how much must agree, how many runs there are."""

    threshold: float = THRESHOLD
    recall: float = TARGET_RECALL
    depth: int = DEPTH

    def __post_init__(self):
        if not 0 < self.threshold <= 1:
            raise ValueError("the threshold must be above 0 and at most 1")

    @property
    def choices(self) -> tuple[int, float]:
        """Coordinates that every node chooses, and the part of the nodes that choose one more.

        1 / threshold on average, so that a pair at the threshold survives a
        level once on average.
        """
        whole = int(1 / self.threshold + 1e-9)
        return whole, max(1 / self.threshold - whole, 0.0)

    @property
    def agreement(self) -> float:
        """Share of equal tokens that ties two classes: four and a half standard deviations below the threshold."""
        return max(self.threshold - 4.5 * math.sqrt(self.threshold * (1 - self.threshold) / COORDINATES), 1 / COORDINATES)

    @property
    def least_set(self) -> float:
        """Smaller sets cannot be at the threshold without being equal."""
        return math.ceil(self.threshold / (1 - self.threshold) - 1e-9) if self.threshold < 1 else math.inf

    @cached_property
    def runs(self) -> int:
        """Runs after which a pair at the threshold shares a last bucket, and is tied there, with that probability.

        All runs draw on the same tokens, so what counts is how many of those
        a pair has in common, and that varies from pair to pair.
        """
        whole, part = self.choices
        shares = []
        for equal in range(math.ceil(self.agreement * COORDINATES), COORDINATES + 1):
            agreed, lost = equal / COORDINATES, 0.0
            for _ in range(self.depth):
                missed = 1 - agreed + agreed * lost
                lost = (1 - part) * missed**whole + part * missed ** (whole + 1)
            shares.append((math.comb(COORDINATES, equal) * self.threshold**equal * (1 - self.threshold) ** (COORDINATES - equal), lost))
        if self.recall >= sum(p for p, _ in shares):
            raise ValueError(f"a recall of {self.recall} is beyond {COORDINATES} tokens")
        runs = 1
        while sum(p * (1 - lost**runs) for p, lost in shares) < self.recall:
            runs += 1
        return runs


def runs_needed(recall: float = TARGET_RECALL, depth: int = DEPTH, threshold: float = THRESHOLD) -> int:
    return Paths(threshold, recall, depth).runs


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word 5-grams."""

    def __init__(self):
        self.words: dict[str, int] = {}

    def shingles(self, text: str | None) -> np.ndarray:
        """Words are runs without white space, in lower case; fewer than five are one shingle."""
        said = text.lower().split() if text else []
        if not said:
            return np.zeros(0, np.uint64)
        known = self.words
        if len(known) > _WORD_CACHE:
            known.clear()
        for w in set(said).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, said), np.uint64, len(said))
        if len(h) < WORDS:
            return _mixed(np.array([len(h)], np.uint64) + (h * _SPREAD[: len(h)]).sum(dtype=np.uint64))
        grams = h[: len(h) - WORDS + 1] * _SPREAD[0]
        for k in range(1, WORDS):
            grams = _mixed(grams) + h[k : len(h) - WORDS + 1 + k] * _SPREAD[k]
        return np.unique(_mixed(grams))


_RNG = np.random.default_rng(20_240_229)
_FACTORS = _RNG.integers(0, 1 << 32, COORDINATES, dtype=np.uint32) | np.uint32(1)
_OFFSETS = _RNG.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)


def min_tokens(shingles: np.ndarray) -> np.ndarray:
    """The set's min-hash token at each coordinate, as 16 bits."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 256):
        np.minimum(least, (x[at : at + 256, None] * _FACTORS + _OFFSETS).min(axis=0), out=least)
    return (least ^ (least >> np.uint32(16))).astype(np.uint16)


def last_buckets(tokens: np.ndarray, runs: int, paths: Paths = Paths(), roots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row number and path hash of every path of every row of tokens; paths begin at ``roots`` if given."""
    n = len(tokens)
    whole, part = paths.choices
    row = np.tile(np.arange(n), runs)
    node = np.repeat(np.arange(1, runs + 1), n).astype(np.uint64) * _SPREAD[0]
    node = _mixed(node if roots is None else node + np.tile(roots, runs))
    for _ in range(paths.depth):
        choice = _mixed(node)
        first = (choice >> np.uint64(8)) % np.uint64(COORDINATES)
        step = (choice >> np.uint64(24)) | np.uint64(1)  # odd, so that all choices differ
        more = np.flatnonzero((choice & np.uint64(255)) < np.uint64(round(256 * part)))
        row = np.concatenate([*[row] * whole, row[more]])
        chosen = np.concatenate([*[(first + np.uint64(k) * step) % np.uint64(COORDINATES) for k in range(whole)], (first[more] + np.uint64(whole) * step[more]) % np.uint64(COORDINATES)])
        node = np.concatenate([*[node] * whole, node[more]])
        token = tokens[row, chosen.astype(np.int64)].astype(np.uint64)
        node = _mixed(node * _SPREAD[1] + chosen * _SPREAD[2] + token * _SPREAD[3] + np.uint64(1))
    return row, node


def _embedded(rows: DataFrame, paths: Paths) -> DataFrame:
    """Each document's class, by 128 bits of its set, and its tokens where the set can be linked to others."""
    kind = rows.schema["k"].dataType.simpleString()

    @gives_back
    def embed(batches):
        shingler = Shingler()
        for batch in batches:
            for part in steps(batch):
                sets = [shingler.shingles(t) for t in part.column(2).to_pylist()]
                classes = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
                tokens = pa.array([min_tokens(s).tobytes() if len(s) >= paths.least_set else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(classes[:, 0]), pa.array(classes[:, 1]), tokens], names=["k", "h", "c1", "c2", "tokens"])

    return rows.mapInArrow(embed, f"k {kind}, h long, c1 long, c2 long, tokens binary")


def _token_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, COORDINATES)


def _in_buckets(classes: DataFrame, paths: Paths) -> DataFrame:
    """Rows of class c and bucket: every last bucket of classes (c, tokens)."""

    @gives_back
    def deal(batches):
        for batch in batches:
            for part in steps(batch, 1024):
                row, node = last_buckets(_token_rows(part.column(1)), paths.runs, paths)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(node.view(np.int64))], names=["c", "bucket"])

    return classes.select("c", "tokens").mapInArrow(deal, "c long, bucket long")


def _split_again(members: DataFrame, paths: Paths) -> DataFrame:
    """Rows of class c, bucket and parent: members (bucket, c, tokens) dealt on from their bucket."""

    @gives_back
    def deal(batches):
        for batch in batches:
            for part in steps(batch, 1024):
                parent = part.column(0)
                row, node = last_buckets(_token_rows(part.column(2)), paths.runs, paths, parent.to_numpy().view(np.uint64))
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(1).take(row), pa.array(node.view(np.int64)), parent.take(row)], names=["c", "bucket", "parent"])

    return members.select("bucket", "c", "tokens").mapInArrow(deal, "c long, bucket long, parent long")


def _agreeing(links: DataFrame, tokens: DataFrame, agreement: float) -> DataFrame:
    """Links whose two classes have enough equal tokens."""
    both = links.join(tokens.toDF("u", "tu"), "u").join(tokens.toDF("v", "tv"), "v")

    @gives_back
    def test(batches):
        for batch in batches:
            keep = pa.array((_token_rows(batch.column(2)) == _token_rows(batch.column(3))).mean(axis=1) >= agreement)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    return both.select("u", "v", "tu", "tv").mapInArrow(test, "u long, v long")


def _roots(linked: np.ndarray) -> np.ndarray:
    """The least row each row is connected with."""
    root = np.arange(len(linked))
    for i in np.flatnonzero(linked.any(axis=1)):
        seen = root[np.append(np.flatnonzero(linked[i]), i)]
        least = seen.min()
        if (seen != least).any():
            root[np.isin(root, seen)] = least
    return root


def _equal_tokens(tokens: np.ndarray) -> np.ndarray:
    """How many tokens all pairs of rows have in common."""
    n = len(tokens)
    if n <= 64:
        return np.count_nonzero(tokens[:, None] == tokens[None], axis=2)
    out = np.zeros((n, n), np.uint8 if COORDINATES < 256 else np.uint16)
    for column in np.ascontiguousarray(tokens.T):
        out += column[:, None] == column[None]
    return out


def _in_blocks(members: DataFrame, *columns: str) -> DataFrame:
    """Members (g, blocks, c, ...) of each pair of blocks of their group, in a row: g, i, j, mine, columns."""
    rows = members.withColumn("mine", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("g", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", *columns)
    return rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")


def _tied_in_blocks(members: DataFrame, agreement: float) -> DataFrame:
    """Links that connect all classes of a bucket (g, blocks, c, tokens) that have enough equal tokens."""
    rows = _in_blocks(members, "c", "tokens")
    batch_of = lambda us, vs: pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    @gives_back
    def tie(batches):
        us, vs = [], []

        def done(group):
            tokens = np.frombuffer(b"".join(t for _, t in group), np.uint16).reshape(-1, COORDINATES)
            near = _equal_tokens(tokens) >= agreement * COORDINATES
            for i, r in enumerate(_roots(near).tolist()):
                if i != r:
                    us.append(group[i][0])
                    vs.append(group[r][0])

        key, group = None, []
        for batch in batches:
            for g, i, j, c, t in zip(*(batch.column(x).to_pylist() for x in (0, 1, 2, 4, 5)), strict=True):
                if (g, i, j) != key:
                    if len(group) > 1:
                        done(group)
                    key, group = (g, i, j), []
                group.append((c, t))
            if len(us) > 10_000:
                yield batch_of(us, vs)
                us.clear()
                vs.clear()
        if len(group) > 1:
            done(group)
        yield batch_of(us, vs)

    return rows.mapInArrow(tie, "u long, v long")


def _distinct_buckets(in_bucket: DataFrame) -> DataFrame:
    """Buckets of more than one class; of those with the same classes only one: g, n, low, high, x.

    x, all classes combined, tells buckets apart and names the middle one of three.
    """
    found = in_bucket.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.bit_xor("c").alias("x"), F.count("*").alias("n")).where("n > 1")
    return found.groupBy("n", "low", "high", "x").agg(F.min("bucket").alias("g"))


def _ties(classes: DataFrame, paths: Paths, split: int = SPLIT) -> DataFrame:
    """Links u, v that connect any two classes (c, tokens) of one bucket with enough equal tokens."""
    tokens = classes.select("c", "tokens")
    in_bucket = written(_in_buckets(classes, paths), "join-buckets")
    agreement, further = paths.agreement, Paths(paths.threshold, SPLIT_RECALL, SPLIT_DEPTH)
    pair = lambda u, v: F.struct(u.alias("u"), v.alias("v"))
    low, high = F.col("low"), F.col("high")
    middle = F.col("x").bitwiseXOR(low).bitwiseXOR(high)
    links, used = [], [in_bucket]
    while True:
        buckets = written(_distinct_buckets(in_bucket), "join-buckets")
        used.append(buckets)
        few = buckets.where("n <= 3").select(F.explode(F.when(F.col("n") == 2, F.array(pair(high, low))).otherwise(F.array(pair(high, low), pair(middle, low), pair(high, middle)))).alias("p")).select("p.*")
        links.append(_agreeing(few.distinct(), tokens, agreement))
        total, large = buckets.where("n > 3").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > split, 1))).first()
        if not total:
            break
        many = spread_join(in_bucket, buckets.where("n > 3").select(F.col("g").alias("bucket"), F.col("n").alias("size")), "bucket", "size", total)
        members = many.join(tokens, "c").withColumn("blocks", F.ceil(F.col("size") / TOKEN_BLOCK).cast("int")).withColumnRenamed("bucket", "g")
        if not large:
            links.append(_tied_in_blocks(members, agreement))
            break
        # Large buckets are split where that at least halves the comparisons;
        # classes that stay together are alike, and are compared block by block.
        members = written(members, "join-members")
        apart = written(_split_again(members.where(F.col("size") > split).withColumnRenamed("g", "bucket"), further), "join-buckets")
        used += [members, apart]
        after = apart.groupBy("parent", "bucket").agg(F.count("*").cast("double").alias("n")).groupBy("parent").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
        sizes = buckets.where(F.col("n") > split).select(F.col("g").alias("parent"), "n")
        worth = written(sizes.join(after, "parent").where(F.col("pairs") < F.col("n").cast("double") * F.col("n") / 2).select("parent", "n"), "join-split")
        used.append(worth)
        links.append(_tied_in_blocks(members.join(worth.select(F.col("parent").alias("g")), "g", "left_anti"), agreement))
        rows = max(apart.count(), 1)
        in_bucket = written(spread_join(apart, worth.withColumn("n", F.col("n") * further.runs), "parent", "n", rows).select("c", "bucket"), "join-buckets")
        used.append(in_bucket)
    found = links[0]
    for more in links[1:]:
        found = found.union(more)
    found = written(found, "join-ties")
    discard(*used)
    return found


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    common = count[place] > 1
    owner, place = owner[common], place[common]
    _, place = np.unique(place, return_inverse=True)
    out = np.zeros((n, n), np.float32)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    width = 4096
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        a, b = np.searchsorted(place, [low, low + width])
        held = np.zeros((n, width), np.float32)
        held[owner[a:b], place[a:b] - low] = 1
        out += held @ held.T
    np.fill_diagonal(out, sizes)
    return np.rint(out).astype(np.int64)


def _compare(group: list[tuple[int, int, int, str]], same: bool, threshold: float, shingler: Shingler, emit: list) -> None:
    """All pairs of one block, or of two blocks: how many links each class has, and links that span them."""
    group = list({g[0]: g for g in group}.values())
    sets = [shingler.shingles(g[3]) for g in group]
    both = _overlaps(sets)
    sizes = both.diagonal()
    linked = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
    np.fill_diagonal(linked, False)
    if not same:
        side = np.array([g[2] for g in group])
        linked &= side[:, None] != side[None, :]
    copies = np.array([g[1] for g in group], np.int64)
    links, documents = linked.sum(axis=1), linked @ copies
    # A spanning forest carries all that components need.
    root = _roots(linked)
    for i in np.flatnonzero(links):
        emit.append((group[i][0], group[root[i]][0], int(links[i]), int(documents[i])))


def _compared(members: DataFrame, threshold: float) -> DataFrame:
    """Brute force within groups.

    ``members``: g (group), blocks, c (class), m (documents of the class), t
    (text).  Large groups are cut into blocks, and every pair of blocks is a
    task's work of its own, so no group is gathered anywhere.
    """
    rows = _in_blocks(members, "c", "m", "t")

    @gives_back
    def compare(batches):
        shingler = Shingler()
        key, group, emit = None, [], []
        for batch in batches:
            for g, i, j, mine, c, m, t in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (g, i, j) != key:
                    if group:
                        _compare(group, key[1] == key[2], threshold, shingler, emit)
                    key, group = (g, i, j), []
                group.append((c, m, mine, t))
            if len(emit) > 10_000:
                yield _links_batch(emit)
                emit = []
        if group:
            _compare(group, key[1] == key[2], threshold, shingler, emit)
        yield _links_batch(emit)

    return rows.mapInArrow(compare, "c long, root long, links long, documents long")


def _links_batch(emit: list) -> pa.RecordBatch:
    columns = list(zip(*emit, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in columns], names=["c", "root", "links", "documents"])


def _joined(df: DataFrame, text: str, key: str, threshold: float, recall: float, split: int = SPLIT) -> DataFrame:
    """Each document k, h with its class's first document, its set's key, its links and its class's size."""
    paths = Paths(threshold, recall)
    rows = with_place(pick(df, key, text), key, text).select("k", "h", F.coalesce(F.col(text), F.lit("")).alias("t"))
    documents = written(_embedded(rows, paths), "join-documents")
    # One row for each set; its number c stands for it from here on.
    sets = documents.groupBy("c1", "c2").agg(F.min(F.struct("k", "h")).alias("rep"), F.count("*").alias("m"), F.first("tokens").alias("tokens"))
    classes = written(sets.select("c1", "c2", "rep.*", "m", "tokens", F.monotonically_increasing_id().alias("c")), "join-classes")

    ties = _ties(classes.where("tokens is not null"), paths, split)
    groups = components(ties)
    wanted = written(classes.select("c", "k", "h", "m").join(groups.select(F.col("node").alias("c"), F.col("root").alias("g")), "c"), "join-wanted")
    # Texts of few documents are needed; the others are left out before anything is shuffled.
    n_wanted = wanted.count()
    texts = rows.where(maybe_among(rows, wanted, n_wanted, "k", "h")).groupBy("k", "h").agg(F.first("t").alias("t"))
    members = written(texts.join(wanted, ["k", "h"]), "join-members")
    sizes = members.groupBy("g").agg(F.count("*").alias("size"), F.sum(F.octet_length("t")).alias("bytes"))
    sizes = sizes.withColumn("blocks", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1)).cast("int"))
    placed = spread_join(members, sizes, "g", "size", max(n_wanted, 1))
    found = written(_compared(placed.select("g", "blocks", "c", "m", "t"), threshold), "join-links")
    discard(ties, members)

    counts = found.groupBy("c").agg(F.sum("links").alias("links"), F.sum("documents").alias("documents"))
    connected = components(found.select(F.col("c").alias("u"), F.col("root").alias("v"))).toDF("c", "root")
    labelled = classes.select("c", "c1", "c2", "k", "h", "m").join(connected, "c", "left").join(counts, "c", "left").withColumn("root", F.coalesce("root", "c"))
    first = labelled.groupBy("root").agg(F.min(F.struct("k", "h")).alias("first"), F.count("*").alias("sets"), F.sum("m").alias("members"))
    answer = spread_join(labelled, first, "root", "sets", classes.count()).select(
        "c1",
        "c2",
        "m",
        "members",
        "first",
        F.col("k").alias("set_id"),
        (F.coalesce("documents", F.lit(0)) + F.col("m") - 1).alias("n_links"),
        F.coalesce("links", F.lit(0)).alias("n_set_links"),
    )
    answer = written(answer, "join-answer")
    discard(found, classes, wanted)
    return spread_join(documents.select("k", "h", "c1", "c2"), answer, ["c1", "c2"], "m", documents.count())


def jaccard_join(df: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """Near copies by Jaccard similarity of five-word shingles.

    Result, a row for each input row: the key, ``class_id`` (the least key of
    all documents connected with it by links), ``set_id`` (the least key of
    the documents with an equal set), ``n_links`` (other documents at the
    threshold or above), ``n_set_links`` (other sets at the threshold or
    above).  Links between copies are counted, not listed.

    Null and empty texts have the empty set and are copies of each other; a
    text of fewer than five words is one shingle.  Keys are integers, or are
    compared as text.  A null key counts as the least key there is (as text:
    the empty one), and stays null as a ``class_id``.  Repeated rows are
    copies.  Very long texts are whole sets like any other.  An empty table
    has no classes.
    """
    kind = df.select(df[key]).schema[0].dataType
    found = _joined(df, text, key, threshold, recall)
    back = lambda c: F.nullif(c, F.lit(least_key(kind)))
    return found.select(back(F.col("k")).cast(kind).alias(key), back(F.col("first.k")).alias("class_id"), back(F.col("set_id")).alias("set_id"), "n_links", "n_set_links")


def one_of_each(df: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """The rows of ``df`` with one document of each near-copy class: that of the least key.

    Among documents of that key in the class the one with the least text hash
    stays; a repeated row stays once, the one whose other columns come first.
    Documents without links all stay, and are not shuffled.
    """
    found = _joined(df, text, key, threshold, recall)
    columns = df.columns
    rows = with_place(numbered(df), f"_c{columns.index(key)}", f"_c{columns.index(text)}")
    # Documents of classes of more than one, and whether they stay.
    touched = found.where("members > 1").groupBy("k", "h").agg(F.max((F.col("k") == F.col("first.k")) & (F.col("h") == F.col("first.h"))).alias("stays"))
    touched = written(touched, "join-touched")
    rows = rows.withColumn("maybe", maybe_among(rows, touched, touched.count(), "k", "h"))
    both = rows.where("maybe").join(touched, ["k", "h"], "left")
    names = [f"_c{i}" for i in range(len(columns))]
    # Repeated rows are reduced in the tasks that read them before they meet.
    simple = [n for n, f in zip(names, df.schema.fields, strict=True) if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    order = F.struct(*[F.col(n) for n in simple])
    once = both.where("stays").groupBy("k", "h").agg(F.min_by(F.struct(*names), order).alias("row")).select("row.*")
    alone = rows.where("not maybe").select(*names).unionByName(both.where("stays is null").select(*names))
    return restored(alone.unionByName(once), columns)


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Near-copy class of every document, and how many others it is linked with."""
    return jaccard_join(table(spark, sf_dir, "documents"))
