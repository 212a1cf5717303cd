"""Benchmark decontamination by pigeonhole edit matching.

Words are compared after folding case and dropping punctuation.  A test item of
n words may be found with up to k = floor(n * rate) word edits.  Cut into k + 1
pieces, at least one piece of any such occurrence is intact; an Aho-Corasick
automaton finds all intact pieces in a document, and Myers' bit-parallel
distance checks the words around each.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._common import gives_back, once, pick, result_names, steps, table

#: Word edits allowed for each word of an item.
ERROR_RATE = 0.2
#: Items of fewer words are only found as they are.
SHORT_ITEM = 8
#: The benchmark goes to the workers in blocks of about so many characters; a
#: larger benchmark takes more passes over the documents, not more memory.
BLOCK_CHARS = 8_000_000
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def budget(n_words: int, rate: float = ERROR_RATE) -> int:
    return int(n_words * rate) if n_words >= SHORT_ITEM else 0


def pieces(item: list[str], errors: int) -> list[tuple[int, list[str]]]:
    """``errors`` + 1 pieces of nearly equal length, with their starts."""
    cuts = [i * len(item) // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


class Myers:
    """Bit-parallel edit distance of a pattern of words to the best-ending substring."""

    def __init__(self, pattern: list[str]):
        self.size = len(pattern)
        self.places: dict[str, int] = {}
        for i, w in enumerate(pattern):
            self.places[w] = self.places.get(w, 0) | 1 << i
        self.mask = (1 << self.size) - 1
        self.top = 1 << (self.size - 1)

    def best(self, text: list[str], free: bool = True) -> tuple[int, int]:
        """Least distance of the pattern to any substring, and where the first such substring ends.

        Without ``free`` the substring begins where the text does.
        """
        plus, minus, distance = self.mask, 0, self.size
        least, end = distance, 0
        carry = 0 if free else 1
        get, mask, top = self.places.get, self.mask, self.top
        for i, w in enumerate(text):
            eq = get(w, 0)
            xv = eq | minus
            xh = ((((eq & plus) + plus) ^ plus) | eq) & mask
            ph = (minus | ~(xh | plus)) & mask
            mh = plus & xh
            if ph & top:
                distance += 1
            elif mh & top:
                distance -= 1
            ph = ((ph << 1) | carry) & mask  # a free start costs nothing in the first row
            mh = (mh << 1) & mask
            plus = (mh | ~(xv | ph)) & mask
            minus = ph & xv
            if distance < least:
                least, end = distance, i + 1
        return least, end


class Finder:
    """All items of a block, ready to be looked for."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        self.items: list[tuple[int, Myers, Myers, int]] = []
        found: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            item = words(text)
            if not item:
                continue
            errors = budget(len(item), rate)
            number = len(self.items)
            self.items.append((key, Myers(item), Myers(item[::-1]), errors))
            for at, piece in pieces(item, errors):
                found.setdefault(" " + " ".join(piece) + " ", []).append((number, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """Item, distance, first and last word of each item found: its best occurrence."""
        if not text or not self.items:
            return []
        said = words(text)
        line = " " + " ".join(said) + " "
        wanted: dict[int, set[int]] = {}
        starts: list[int] | None = None
        for end, (size, where) in self.automaton.iter(line):
            if starts is None:
                starts = [0] * len(said)
                at = 0
                for i, w in enumerate(said):
                    starts[i] = at
                    at += len(w) + 1
            first = bisect_left(starts, end - size + 1)
            for number, offset in where:
                wanted.setdefault(number, set()).add(first - offset)
        out = []
        for number, begins in sorted(wanted.items()):
            key, pattern, backwards, errors = self.items[number]
            best, seen = None, -1
            for begin in sorted(begins):
                low, high = max(0, begin - errors), begin + pattern.size + errors
                if high <= seen:
                    continue
                seen = high
                distance, end = pattern.best(said[low:high])
                if distance <= errors and (best is None or distance < best[1]):
                    # Where it begins, read from its end: of equally near beginnings the nearest.
                    best = (key, distance, low + end - backwards.best(said[low : low + end][::-1], free=False)[1], low + end)
            if best:
                out.append(best)
        return out


def benchmark_blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text", chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, one at a time; null and wordless items match nothing."""
    block: list[tuple[int, str]] = []
    size = 0
    for k, t in pick(benchmark, key, text).where(F.col(text).isNotNull()).orderBy(key, text).toLocalIterator():
        if size and size + len(t) > chars:
            yield block
            block, size = [], 0
        block.append((k, t))
        size += len(t)
    if block:
        yield block


def _finder(made: tuple) -> Finder:
    return Finder(*made)


def find_items(df: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rate: float = ERROR_RATE) -> DataFrame:
    """Which benchmark items each document holds.

    Result, a row for each input row: the columns of ``keep``, ``items`` (ids
    of the items found, ascending), ``edits`` (their least word distances),
    ``first_word`` and ``end_word`` (where they stand), ``contaminated``; a
    result column whose name is also kept gets ``_found`` behind it.

    A null or empty text holds nothing, and an empty benchmark is found
    nowhere.  Items with equal texts are all found, repeated rows are judged
    alike, whole texts are searched however long, an empty table gives an
    empty result.  Among equally near places of an item the first counts.
    """
    names = [text, *[k for k in keep if k != text]]
    rows = pick(df, *names)
    spark = df.sparkSession
    fields = ("array<long>", "array<int>", "array<int>", "array<int>")
    result = result_names(names, ("items", "edits", "first_word", "end_word", "contaminated"))
    own = list(result.values())[:4]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    kept += "".join(f", `{n}` {t}" for n, t in zip(own, fields, strict=True))

    def pass_over(frame: DataFrame, block) -> DataFrame:
        spread = spark.sparkContext.broadcast((block, rate))

        @gives_back
        def find(batches):
            finder = once(spread, _finder)
            for batch in batches:
                for part in steps(batch):
                    before = part.column(part.num_columns - 4).to_pylist()
                    found = [sorted([*zip(*(c[i].as_py() for c in part.columns[-4:]), strict=True), *finder.find(t)]) if before[i] else finder.find(t) for i, t in enumerate(part.column(0).to_pylist())]
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns[:-4], *[pa.array([[h[j] for h in hits] for hits in found], pa.list_(kind)) for j, kind in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32()))]],
                        names=[*names, *own],
                    )

        return frame.mapInArrow(find, kept)

    out = rows.withColumns({n: F.array().cast(t) for n, t in zip(own, fields, strict=True)})
    for block in benchmark_blocks(benchmark):
        out = pass_over(out, block)
    return out.withColumn(result["contaminated"], F.size(own[0]) > 0).select(*keep, *result.values())


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """Benchmark items found in every document."""
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
