"""Exact order statistics of whole columns, without gathering a column anywhere.

Sketches bracket each wanted position, a count over all rows says how many lie
before the bracket, and the few rows within are looked at exactly; brackets
that still hold too many different values are narrowed again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sketch's accuracy: a bracket holds some six rows of so many.
ACCURACY = 1_000
#: Values of a bracket that are looked at one by one.
FEW = 50_000


def positions(n: int, q: float, interpolation: str) -> tuple[int, int, float]:
    """The two positions (from 0) between which a quantile of n values lies, and how far it is from the first."""
    place = q * (n - 1)
    low, high = math.floor(place), math.ceil(place)
    if interpolation == "linear":
        return low, high, place - low
    if interpolation == "midpoint":
        return low, high, 0.5 if high > low else 0.0
    at = {"lower": low, "higher": high, "nearest": round(place)}  # half to even
    if interpolation not in at:
        raise ValueError(f"unknown interpolation {interpolation!r}")
    return at[interpolation], at[interpolation], 0.0


def quantiles(df: DataFrame, columns: dict[str, Column], qs: list[float], interpolation: str) -> dict[str, list[float | None]]:
    """For each named column its quantiles; none where it has no values.  A few jobs, each one pass."""
    if any(not 0 <= q <= 1 for q in qs):
        raise ValueError("q must be between 0 and 1")
    positions(2, 0.5, interpolation)
    rows = df.select(*[x.alias(c) for c, x in columns.items()])
    # Sketches of all columns, around every quantile, in the pass that counts.
    eps = 3.0 / ACCURACY
    points = sorted({min(max(q + d, 0.0), 1.0) for q in qs for d in (-eps, eps)})
    sketch = lambda x: F.percentile_approx(x, [float(p) for p in points], ACCURACY)
    first = rows.agg(*[a for c in columns for a in (F.count(c), sketch(F.col(c)))]).first()
    counts = {c: first[2 * i] for i, c in enumerate(columns)}
    wanted: dict[tuple[str, int], list] = {}
    for i, c in enumerate(columns):
        for q in qs if counts[c] else ():
            for at in positions(counts[c], q, interpolation)[:2]:
                low, high = (points.index(min(max(q + d, 0.0), 1.0)) for d in (-eps, eps))
                wanted[c, at] = [first[2 * i + 1][low] if q - eps > 0 else -math.inf, first[2 * i + 1][high] if q + eps < 1 else math.inf]
    found = _found(rows, wanted)
    out: dict[str, list[float | None]] = {}
    for c in columns:
        out[c] = []
        for q in qs:
            if not counts[c]:
                out[c].append(None)
                continue
            low, high, share = positions(counts[c], q, interpolation)
            a, b = found[c, low], found[c, high]
            out[c].append(a if a == b or not share else a + (b - a) * share)
    return out


def _found(rows: DataFrame, wanted: dict[tuple[str, int], list]) -> dict[tuple[str, int], float]:
    found: dict[tuple[str, int], float] = {}
    while wanted:
        keys = list(wanted)
        inside = lambda k: F.col(k[0]).between(F.lit(float(wanted[k][0])), F.lit(float(wanted[k][1])))
        before = lambda k: F.count(F.when(F.col(k[0]) < F.lit(float(wanted[k][0])), 1))
        seen = rows.agg(*[a for k in keys for a in (before(k), F.count(F.when(inside(k), 1)), F.approx_count_distinct(F.when(inside(k), F.col(k[0]))))]).first()
        few, wide = {}, {}
        for i, k in enumerate(keys):
            below, held, values = seen[3 * i : 3 * i + 3]
            if not below <= k[1] < below + held:  # the sketch was out: look everywhere
                wide[k] = None
            elif values <= FEW:
                few[k] = below
            else:
                wide[k] = (k[1] - below) / max(held - 1, 1)
        if few:
            cells = F.array(*[F.when(inside(k), F.struct(F.lit(i).alias("i"), F.col(k[0]).alias("x"))) for i, k in enumerate(few)])
            counted = rows.select(F.explode(F.array_compact(cells)).alias("c")).groupBy("c.i", "c.x").count().collect()
            for i, k in enumerate(few):
                left = k[1] - few[k]
                for x, n in sorted((r.x, r["count"]) for r in counted if r.i == i):
                    if left < n:
                        found[k] = x
                        break
                    left -= n
        narrowed = {}
        for k, p in wide.items():
            if p is None:
                narrowed[k] = [-math.inf, math.inf]
                continue
            eps = 3.0 / ACCURACY
            low, high = rows.where(inside(k)).agg(F.percentile_approx(k[0], [max(p - eps, 0.0), min(p + eps, 1.0)], ACCURACY)).first()[0]
            narrowed[k] = [low if p > eps else wanted[k][0], high if p + eps < 1 else wanted[k][1]]
            if narrowed[k] == wanted[k] and low < high:  # nothing left to narrow but halves
                narrowed[k] = [low, high]
        wanted = narrowed
    return found
