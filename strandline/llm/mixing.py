"""Mixing sources to target weights by capped water-filling.

Targets follow weights; a source that would exceed its maximum number of epochs
is clamped there and its excess is shared out again by weight, until no target
is above its cap.  A target of 1.4 epochs takes every document once and then
fills 0.4 of the source's words with documents in a seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm._common import discard, numbered, pick, restored, table, written
from strandline.plans.scale import running_over_ranges

#: A plan of at most so many sources (some 10 MB) is broadcast to the documents; a larger one is joined.
BROADCAST_SOURCES = 100_000
SEED = 17
WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
#: The order's bits that each step towards the last document looks at.
_BITS = 8
_STEPS = 2


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, total: float) -> DataFrame:
    """``target`` of each source (s, w, cap): by weight w, none above its cap; their sum is ``total``.

    The excess of clamped sources is shared again by weight.  Sources are
    clamped in the order of cap / w, so running sums of caps and weights in
    that order give the level that is left if all before are clamped; the level
    that holds is the highest that the source itself still exceeds.  A total
    beyond all caps gives every source its cap; caps of 0 get 0.
    """
    by_ratio = [F.col("ratio"), F.col("w"), F.asc_nulls_last("s")]
    found = written(running_over_ranges(sources.withColumn("ratio", F.col("cap") / F.col("w").cast("double")), by_ratio, {"caps": ("sum", "cap"), "ws": ("sum", "w")}), "mix-levels")
    weights = found.agg(F.sum("w")).first()[0] or 0
    level = (F.lit(total) - (F.col("caps") - F.col("cap"))).cast("double") / (F.lit(weights) - (F.col("ws") - F.col("w"))).cast("double")
    free = found.where(level * F.col("w") < F.col("cap")).agg(F.max(level)).first()[0]
    target = F.col("cap").cast("double") if free is None else F.least(F.lit(free) * F.col("w"), F.col("cap").cast("double"))
    return found.withColumn("target", target).drop("ratio", "caps", "ws")


def _order(seed: int) -> Column:
    """A document's place in the seeded order of its source: 60 bits of a hash of its id."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("k").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def plan_sources(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """es (source), source_size and target of each source; weights repeat by code point, null last.

    ``sized`` has columns ``s`` (source) and ``n`` (words).
    """
    sources = written(sized.groupBy("s").agg(F.sum("n").alias("size")), "mix-sources")
    total = share * (sources.agg(F.sum("size")).first()[0] or 0)
    placed = running_over_ranges(sources.withColumn("one", F.lit(1)), [F.asc_nulls_last("s")], {"nth": ("sum", "one")})
    weight = F.get(F.array(*[F.lit(w) for w in weights]), ((F.col("nth") - 1) % len(weights)).cast("int"))
    targets = water_fill(placed.select("s", "size", weight.alias("w"), (F.col("size") * F.lit(epochs)).alias("cap")), total)
    return targets.select(F.col("s").alias("es"), F.col("size").alias("source_size"), "target")


def _sized(rows: DataFrame, text: str, source: str, key: str, seed: int) -> DataFrame:
    """Rows with k, s, n, and their place in the order: o, and among equal ids n and a hash of the text."""
    rows = rows.select("*", F.col(key).alias("k"), F.col(source).alias("s"), words(F.col(text)).alias("n"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"))
    return rows.withColumn("o", _order(seed))


def mix_plan(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> tuple[DataFrame, bool]:
    """For each source: size, target, whole repetitions, and where the fraction ends.

    ``cut`` is the place of the last document taken; of the ``c`` rows that
    stand there, which are equal, ``t`` are taken.  Also whether any source
    takes some of these rows and not all.

    ``sized`` has columns s (source), n (words), o and th (place in the order).
    """
    targets = written(plan_sources(sized, weights, share, epochs), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.try_divide("target", F.col("source_size").cast("double")))).otherwise(0).cast("int")
    planned = targets.withColumn("whole", whole).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    near = F.broadcast if targets.count() <= BROADCAST_SOURCES else lambda frame: frame
    same = F.col("s").eqNullSafe(F.col("es"))
    # Words before the last bucket, found by _BITS bits of the order at a time:
    # sums by source and bucket, so no source is ever gathered in one task.
    edge = planned.withColumns({"before": F.lit(0).cast("long"), "prefix": F.lit(0).cast("long")})
    for step in range(_STEPS):
        shift = 60 - _BITS * (step + 1)
        inside = sized.join(near(edge.select("es", "prefix")), same).where(F.shiftright("o", shift + _BITS) == F.col("prefix"))
        sums = inside.groupBy("s", F.shiftright("o", shift).alias("b")).agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(W.partitionBy("s").orderBy("b").rowsBetween(W.unboundedPreceding, 0))
        reached = sums.withColumn("upto", upto).join(near(edge.select("es", "extra", "before")), same)
        # The bucket where the fraction ends; where rounding leaves none, the last.
        here = F.struct("b", (F.col("before") + F.col("upto") - F.col("n")).alias("x"))
        ended = reached.groupBy("s").agg(
            F.min_by(here, F.when(F.col("before") + F.col("upto") >= F.col("extra"), F.col("b"))).alias("hit"),
            F.max_by(here, F.col("b")).alias("last"),
        )
        edge = planned.join(near(ended.select("s", F.coalesce("hit", "last").alias("at"))), same, "left").drop("s")
        edge = written(edge.withColumns({"before": F.coalesce("at.x", F.lit(0)).cast("long"), "prefix": F.coalesce("at.b", F.lit(0)).cast("long")}).drop("at"), "mix-edges")
    # Only the last bucket's documents, a source's 65,536th part, need an order;
    # rows that stand in the same place are counted before anything is shuffled.
    low = 60 - _BITS * _STEPS
    inner = sized.join(near(edge.select("es", "prefix", "before", "extra")), same).where((F.shiftright("o", low) == F.col("prefix")) & (F.col("n") > 0))
    groups = inner.groupBy("s", "o", "n", "th").agg(F.count("*").alias("c"), F.first("before").alias("before"), F.first("extra").alias("extra"))
    size = F.col("n") * F.col("c")
    running = F.sum(size).over(W.partitionBy("s").orderBy("o", "n", "th").rowsBetween(W.unboundedPreceding, 0))
    taken = F.floor((F.col("extra") - F.col("before") - F.col("upto") + size) / F.col("n").cast("double") + 0.5)
    groups = groups.withColumn("upto", running).withColumn("t", F.least(taken, F.col("c"))).where("t > 0 and extra > 0")
    cut = groups.groupBy("s").agg(F.max(F.struct("o", "n", "th", "t", "c")).alias("cut"))
    before_all = F.struct((F.shiftleft("prefix", low) - 1).alias("o"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("th"), F.lit(1).cast("long").alias("t"), F.lit(1).cast("long").alias("c"))
    out = edge.join(near(cut), same, "left").withColumn("cut", F.coalesce("cut", before_all))
    out = written(out.select("es", "source_size", "target", "whole", "extra", F.struct("cut.o", "cut.n", "cut.th").alias("cut"), "cut.t", "cut.c"), "mix-plan")
    return near(out), out.where("t < c").limit(1).count() > 0


def _times(sized: DataFrame, plan: tuple[DataFrame, bool]) -> DataFrame:
    """Sized rows with their source's plan and ``times``, how often the mix takes each."""
    planned, divided = plan
    rows = sized.join(planned, F.col("s").eqNullSafe(F.col("es")))
    place = F.struct("o", "n", "th")
    more = (place <= F.col("cut")) & (F.col("extra") > 0) & (F.col("n") > 0)
    if not divided:
        return rows.withColumn("times", F.col("whole") + more.cast("int"))
    at_cut = (place == F.col("cut")) & (F.col("t") < F.col("c")) & (F.col("extra") > 0)
    clear = rows.where(~at_cut).withColumn("times", F.col("whole") + more.cast("int"))
    # Equal rows of which some are taken: their parts of the table take all, some or none.
    tied = written(rows.where(at_cut).withColumn("nth", F.monotonically_increasing_id()).withColumn("part", F.shiftright("nth", 33)), "mix-tied")
    held = tied.groupBy("es", "part").agg(F.count("*").alias("held"), F.first("t").alias("all"))
    sofar = F.sum("held").over(W.partitionBy("es").orderBy("part").rowsBetween(W.unboundedPreceding, 0))
    quota = F.greatest(F.least(F.col("all") - F.col("sofar") + F.col("held"), F.col("held")), F.lit(0))
    quotas = held.withColumn("sofar", sofar).select(F.col("es").alias("qs"), F.col("part").alias("qp"), "held", quota.alias("quota"))
    both = tied.join(quotas, F.col("es").eqNullSafe(F.col("qs")) & (F.col("part") == F.col("qp")))
    sure = both.where("quota = 0 or quota = held").withColumn("times", F.col("whole") + (F.col("quota") > 0).cast("int"))
    # One part of each source at most is left, and ordered.
    nth = F.row_number().over(W.partitionBy("es", "part").orderBy("nth"))
    rest = both.where("quota > 0 and quota < held").withColumn("times", F.col("whole") + (nth <= F.col("quota")).cast("int"))
    return clear.unionByName(sure.unionByName(rest).select(*clear.columns))


def mix(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """How often the mix takes each document.

    Result, a row for each input row: the key, ``size`` (words), ``source_size``,
    ``target`` (its source's), ``times`` and ``taken`` (words, repeats counted).

    Beyond whole epochs, documents are taken in the seeded order while the
    words so far, half of the document's included, stay within the fraction of
    the source; so a source misses its target by half a document at most.  The
    order depends on the seed and the id; rows with the same id stand in the
    order of their size, then of a hash of their text.  Repeated rows count one
    by one: as many are taken as fit.  Null text has size 0 and is never
    repeated; null source is a source, the last.  Very long documents are taken
    whole or not at all.  An empty table gives an empty result.
    """
    sized = written(_sized(pick(df, key, text, source), text, source, key, seed).select("k", "s", "n", "o", "th"), "mix-sizes")
    taken = _times(sized, mix_plan(sized, weights, share, epochs))
    return taken.select(F.col("k").alias(key), F.col("n").alias("size"), "source_size", "target", "times", (F.col("n") * F.col("times")).alias("taken"))


def mixed_rows(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of ``df``, all columns, each as many times as the mix takes it; see ``mix``."""
    sized = written(_sized(pick(df, key, text, source), text, source, key, seed).select("s", "n", "o", "th"), "mix-sizes")
    plan = mix_plan(sized, weights, share, epochs)
    discard(sized)
    columns = df.columns
    own = [f"_c{columns.index(c)}" for c in (text, source, key)]
    planned = _times(_sized(numbered(df), *own, seed), plan)
    return restored(planned.withColumn("nth", F.explode(F.array_repeat(F.lit(1), F.col("times")))), columns)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents")).drop("times")


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source AS s, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS o
  FROM documents),
sources AS (
  SELECT s, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY s IS NULL, s COLLATE "binary") - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sized GROUP BY s),
ratios AS (
  SELECT *, 2 * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total,
         sum(2 * source_size) OVER (ORDER BY 2 * source_size / w::DOUBLE, w, s) AS caps_upto,
         sum(w) OVER (ORDER BY 2 * source_size / w::DOUBLE DESC, w DESC, s DESC) AS w_from
  FROM sources),
levels AS (
  SELECT *, (total - (caps_upto - cap))::DOUBLE / w_from::DOUBLE AS lvl FROM ratios),
free AS (SELECT max(lvl) AS lvl FROM levels WHERE lvl * w < cap),
targets AS (
  SELECT s, source_size, CASE WHEN source_size = 0 THEN 0.0 WHEN free.lvl IS NULL OR free.lvl * w >= cap THEN cap::DOUBLE ELSE free.lvl * w END AS target
  FROM levels, free),
plan AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::INT END AS whole FROM targets),
placed AS (
  SELECT doc_id, size, source_size, target, whole, target - whole * source_size AS extra,
         sum(size) OVER (PARTITION BY d.s ORDER BY o, size ROWS UNBOUNDED PRECEDING) - size + size / 2.0 AS mid
  FROM sized d JOIN plan p ON d.s IS NOT DISTINCT FROM p.s)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       (size * (whole + CASE WHEN extra > 0 AND size > 0 AND mid <= extra THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""
