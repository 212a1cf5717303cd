"""Exponentially weighted mean, variance and standard deviation.

Every known row has an age and a first weight: what it weighs later is that
weight times r = 1 - alpha to the power of the ages between.  With ``adjust``
the age is the row's place and all first weights are one; without, a gap of d
rows before a known row takes the share r**d / (r**d + alpha) from all rows
before it, so ages are sums of logarithms of these shares.  Window sums of
scaled values then give every result in the engine's own expressions.  Powers
would overflow on long partitions: rows are dealt into blocks of ages, sums are
scaled within a block, and only the block before adds to them (older ones weigh
less than 2**-500 of it).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.frame import OrderedFrame
from strandline.functions.missing import finite
from strandline.plans import scale

_BLOCK_BITS = 500


def decay(com=None, span=None, halflife=None, alpha=None) -> float:
    """The smoothing factor from exactly one of the four ways to give it."""
    given = [x is not None for x in (com, span, halflife, alpha)]
    if sum(given) != 1:
        raise ValueError("give exactly one of com, span, halflife and alpha")
    if com is not None:
        if com < 0:
            raise ValueError("com must not be negative")
        return 1 / (1 + com)
    if span is not None:
        if span < 1:
            raise ValueError("span must be at least 1")
        return 2 / (span + 1)
    if halflife is not None:
        if halflife <= 0:
            raise ValueError("halflife must be positive")
        return 1 - math.exp(-math.log(2) / halflife)
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be above 0 and at most 1")
    return alpha


class Ewm:
    """Results where a row is missing are those of the row before; infinities count as missing."""

    def __init__(self, frame: OrderedFrame, com, span, halflife, alpha, min_periods: int, adjust: bool, ignore_na: bool):
        self.frame, self.alpha = frame, decay(com, span, halflife, alpha)
        self.min_periods = max(min_periods or 0, 1)
        self.adjust, self.ignore_na = adjust, ignore_na

    def mean(self) -> DataFrame:
        return self._apply("mean", False)

    def var(self, bias: bool = False) -> DataFrame:
        return self._apply("var", bias)

    def std(self, bias: bool = False) -> DataFrame:
        return self._apply("std", bias)

    def _apply(self, kind: str, bias: bool) -> DataFrame:
        f = self.frame
        if scale.unpartitioned(f):
            return self._over_ranges(kind, bias)
        df = self._aged(f, f.df, self._start)
        df = self._summed(f, df, kind)
        w = f.sofar()
        made = {}
        for i, c in enumerate(f.columns):
            # A missing row shows the row before: sums decay alike, so the quotient stays.
            w = W.partitionBy(*f.partition_by).orderBy(f"_b{i}", *f.order).rowsBetween(W.unboundedPreceding, 0)
            value = F.when(F.col(f"_x{i}").isNotNull(), self._value(i, kind, bias))
            made[c] = F.when(F.col(f"_n{i}") >= self.min_periods, F.last(value, ignorenulls=True).over(w)).alias(c)
        return df.select(*[made.get(c, F.col(c)) for c in f.df.columns])

    # ------------------------------------------------------------- ages
    @staticmethod
    def _start(i: int) -> tuple[Column, Column, Column]:
        """Rows since the last known one before the frame (null: none), known rows before it, and the value that variances are taken around."""
        return F.lit(None).cast("long"), F.lit(0).cast("long"), None

    def _aged(self, f: OrderedFrame, df: DataFrame, start: Callable) -> DataFrame:
        """Columns x (value), s (a value near the others), n (known rows so far), t (age) and g (first weight) of each column."""
        r, alpha = 1 - self.alpha, self.alpha
        sofar, earlier = f.sofar(), f.window().rowsBetween(W.unboundedPreceding, -1)
        first = []
        for i, c in enumerate(f.columns):
            x = finite(c)
            _, before, near = start(i)
            first += [x.alias(f"_x{i}"), (F.count(x).over(sofar) + before).alias(f"_n{i}")]
            first.append((F.first(x, ignorenulls=True).over(sofar) if near is None else near).alias(f"_s{i}"))
        df = df.select("*", F.row_number().over(f.window()).alias("_row"), *first)
        n = lambda i: F.col(f"_n{i}")
        if self.adjust or r == 0:
            ages = [[(F.greatest(n(i) - start(i)[1] - 1, F.lit(0)) if self.ignore_na else F.col("_row") - 1).cast("double").alias(f"_t{i}"), F.lit(1.0).alias(f"_g{i}")] for i in range(len(f.columns))]
            return df.select("*", *[a for pair in ages for a in pair])
        seen = lambda i: F.col(f"_x{i}").isNotNull()
        if self.ignore_na:
            gap = [F.lit(1).cast("double") for _ in f.columns]
        else:
            last = [F.max(F.when(seen(i), F.col("_row"))).over(earlier).alias(f"_last{i}") for i in range(len(f.columns))]
            df = df.select("*", *last)
            gap = [F.coalesce(F.col("_row") - F.col(f"_last{i}"), F.col("_row") + start(i)[0]).cast("double") for i in range(len(f.columns))]
        steps = []
        for i in range(len(f.columns)):
            kept = F.pow(F.lit(r), gap[i])
            opens = n(i) == 1
            share = F.when(seen(i) & ~opens, F.log(kept / (kept + alpha)) / math.log(r))
            steps += [F.coalesce(share, F.lit(0.0)).alias(f"_step{i}"), F.when(opens, 1.0).otherwise(alpha / (kept + alpha)).alias(f"_g{i}")]
        df = df.select("*", *steps)
        return df.select("*", *[F.sum(f"_step{i}").over(sofar).alias(f"_t{i}") for i in range(len(f.columns))])

    # -------------------------------------------------------- window sums
    def _terms(self, kind: str) -> tuple[str, ...]:
        return ("w", "v") if kind == "mean" else ("w", "v", "d", "z")

    def _summed(self, f: OrderedFrame, df: DataFrame, kind: str) -> DataFrame:
        """Sums of weights w, weighted values v, squared weights d and weighted squares z up to each row."""
        r = 1 - self.alpha
        parts = list(f.partition_by)
        size = max(2, int(_BLOCK_BITS / -math.log2(r))) if r else 1
        df = df.select("*", *[F.floor(F.col(f"_t{i}") / size).alias(f"_b{i}") for i in range(len(f.columns))])
        for i in range(len(f.columns)):
            x, q = F.col(f"_x{i}"), F.col(f"_t{i}") - F.col(f"_b{i}") * size
            g = F.when(x.isNotNull(), F.col(f"_g{i}"))
            centred = x - F.col(f"_s{i}")
            here = W.partitionBy(*parts, f"_b{i}").orderBy(*f.order).rowsBetween(W.unboundedPreceding, 0)
            last = W.partitionBy(*parts).orderBy(f"_b{i}").rangeBetween(-1, -1)
            values = {"w": (g, 1), "v": (g * centred, 1), "d": (g * g, 2), "z": (g * centred * centred, 1)}
            made = []
            for name in self._terms(kind):
                value, power = values[name]
                if not r:  # only the last known row weighs anything
                    made.append(F.coalesce(value, F.lit(0.0)).alias(f"_{name}{i}"))
                    continue
                base = F.lit(r**power)
                total = F.coalesce(F.sum(value * F.pow(base, -q)).over(here), F.lit(0.0))
                carry = F.coalesce(F.sum(value * F.pow(base, F.lit(float(size)) - q)).over(last), F.lit(0.0))
                made.append(((total + carry) * F.pow(base, q)).alias(f"_{name}{i}"))
            df = df.select("*", *made)
        return df

    def _value(self, i: int, kind: str, bias: bool) -> Column:
        w = F.col(f"_w{i}")
        mean = F.try_divide(F.col(f"_v{i}"), w)
        if kind == "mean":
            return mean + F.col(f"_s{i}")
        value = F.greatest(F.try_divide(F.col(f"_z{i}"), w) - mean * mean, F.lit(0.0))
        if not bias:
            rest = w * w - F.col(f"_d{i}")
            value = F.when((F.col(f"_n{i}") >= 2) & (rest > 0), value * F.try_divide(w * w, rest))
        return F.sqrt(value) if kind == "std" else value

    # ------------------------------------------------------------- ranges
    def _over_ranges(self, kind: str, bias: bool) -> DataFrame:
        """Without partitions: sums within ranges of the order, and what the ranges before have left of theirs."""
        f, r = self.frame, 1 - self.alpha
        dealt, n = scale.deal(f), len(f.columns)
        place = F.col(scale.PLACE)
        at = lambda c: F.when(finite(c).isNotNull(), place)
        ends = dealt.summary(F.count(F.lit(1)), F.max(place), *[a for c in f.columns for a in (F.count(finite(c)), F.min_by(finite(c), at(c)), F.max(at(c)))])
        rows, gap, before = [], [None] * n, [0] * n
        near = [next((e[4 + 3 * i] for e in ends if e[4 + 3 * i] is not None), None) for i in range(n)]
        for e in ends:
            rows.append((e[0], *gap, *before, *near))
            for i in range(n):
                seen, _, last = e[3 + 3 * i : 6 + 3 * i]
                gap[i] = e[2] - last if seen else None if gap[i] is None else gap[i] + e[1]
                before[i] += seen
        schema = ", ".join([f"_gap{i} long" for i in range(n)] + [f"_before{i} long" for i in range(n)] + [f"_near{i} double" for i in range(n)])
        df = self._aged(dealt.inner, dealt.carried(rows, schema), lambda i: (F.col(f"_gap{i}"), F.col(f"_before{i}"), F.col(f"_near{i}")))
        df = scale.written(self._summed(dealt.inner, df, kind), "ewm-ranges")
        # Each range's sums at its last known row, and how much they age until the next range begins.
        terms, own = self._terms(kind), scale.RANGE
        known = lambda i: F.when(F.col(f"_x{i}").isNotNull(), F.col("_row"))
        state = lambda i: F.struct(f"_t{i}", *[f"_{t}{i}" for t in terms])
        ends = sorted(df.groupBy(own).agg(F.max("_row"), *[a for i in range(n) for a in (F.max(F.col(f"_t{i}")), F.max_by(state(i), known(i)))]).collect(), key=lambda e: e[0])
        rows, held = [], [[0.0] * len(terms) for _ in range(n)]
        for e in ends:
            rows.append((e[0], *[x for h in held for x in h]))
            for i in range(n):
                last, here = e[2 + 2 * i], e[3 + 2 * i]
                # Ages count from 0 at a range's first row; the next range's first row is one older.
                step = 1.0 if self.adjust and not self.ignore_na else 0.0
                if self.adjust and self.ignore_na:
                    step = 1.0 if here is not None else 0.0
                for k, t in enumerate(terms):
                    power = 2 if t == "d" else 1
                    own_sum = 0.0 if here is None else _faded(here[1 + k], r, power * (last - here[0] + step))
                    held[i][k] = _faded(held[i][k], r, power * (last + step)) + own_sum
        names = [f"_before_{t}{i}" for i in range(n) for t in terms]
        small = dealt.spark.createDataFrame(rows, f"{own} int, " + ", ".join(f"{name} double" for name in names))
        joined = df.drop(*[f"_before{i}" for i in range(n)]).join(F.broadcast(small), own)
        for i in range(n):
            sums = [(F.col(f"_{t}{i}") + (F.col(f"_before_{t}{i}") * F.pow(F.lit(r ** (2 if t == "d" else 1)), F.col(f"_t{i}")) if r else 0.0)).alias(f"_all_{t}{i}") for t in terms]
            joined = joined.select("*", *sums).drop(*[f"_{t}{i}" for t in terms]).withColumnsRenamed({f"_all_{t}{i}": f"_{t}{i}" for t in terms})
        whole = replace(dealt.inner, df=joined)
        value = {c: F.when(F.col(f"_x{i}").isNotNull(), self._value(i, kind, bias)) for i, c in enumerate(f.columns)}
        shown = joined.select(own, scale.PLACE, *[F.col(c) for c in f.df.columns if c not in f.columns], *[v.alias(c) for c, v in value.items()], *[F.col(f"_n{i}") for i in range(n)])
        # Rows before a range's first known one show the last value of the ranges before.
        filled = scale.with_filled(replace(dealt, inner=replace(whole, df=shown)), "ffill", "_shown_")
        return dealt.result(filled.inner.df, {c: F.when(F.col(f"_n{i}") >= self.min_periods, F.col(f"_shown_{c}")) for i, c in enumerate(f.columns)})


def _faded(a: float, rate: float, age: float) -> float:
    """a times rate ** age, which may be nothing."""
    if not a or not rate:
        return 0.0
    return a * math.exp(age * math.log(rate)) if age * math.log(rate) > -745 else 0.0
