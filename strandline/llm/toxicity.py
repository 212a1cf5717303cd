"""Toxicity by a weighted lexicon.

Texts are folded (case, accents, look-alike letters, digit substitutions) and
searched with an Aho-Corasick automaton of weighted words and word beginnings.
Hits inside exception phrases do not count.  The sum of weights is normalised
by a power of the text's length in words and mapped to a score between 0 and 1.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm._common import discard, gives_back, id_crc32, once, pick, steps, table, written

#: The fit uses about this many labelled documents of either label.
SAMPLE_PER_LABEL = 3_000
#: Bounds of the model: entries and exception phrases.
MAX_TERMS = 20_000
MAX_EXCEPTIONS = 5_000
#: A word needs so many toxic documents, a word beginning so many, and the
#: log odds of either must reach its least weight.
WORD_DOCUMENTS, WORD_WEIGHT = 4, 2.5
STEM_DOCUMENTS, STEM_WEIGHT = 8, 3.5
STEM_LENGTHS = (4, 5, 6)
EXCEPTION_DOCUMENTS, EXCEPTION_ODDS = 4, 5.0
_HASH_RANGE = 1 << 30

# Letters that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k",
    "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x",
    "у": "y", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "m", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}
# Digits and signs written for letters.
SUBSTITUTIONS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
# Characters without width.
INVISIBLE = ("­", "​", "‌", "‍", "⁠", "﻿")

_WORD = re.compile(r"[^\W_]+")
#: A sign for a letter counts only before another letter or digit.
_SIGN = re.compile(r"[!@$](?![^\W_]|[!@$][^\W_])")


class _Folds(dict):
    """Code point -> folded string, filled in as characters appear."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if char in INVISIBLE:
            out = ""
        else:
            plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)).lower()
            out = "".join(HOMOGLYPHS.get(c, c) for c in plain)
            out = "".join(SUBSTITUTIONS.get(c, c) for c in out)
        self[code] = out
        return out


_FOLDS = _Folds()


def fold(text: str) -> str:
    """The text's letters as plain as possible; word ends stay word ends."""
    lowered = text.lower()
    if "!" in lowered or "@" in lowered or "$" in lowered:
        lowered = _SIGN.sub(" ", lowered)
    return lowered.translate(_FOLDS)


@dataclass
class Lexicon:
    """Weighted words and word beginnings, exception phrases, and the score's scale."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    power: float = 0.5
    half: float = 1.0


class Matcher:
    """The lexicon as an automaton over folded texts."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        entries: dict[str, tuple[float | None, float | None]] = {}
        for term, weight in lexicon.words.items():
            entries[term] = (weight, entries.get(term, (None, None))[1])
        for term, weight in lexicon.stems.items():
            entries[term] = (entries.get(term, (None, None))[0], weight)
        self.automaton = ahocorasick.Automaton()
        for term, (word, stem) in entries.items():
            self.automaton.add_word(term, (len(term), word, stem))
        self.usable = bool(entries)
        if self.usable:
            self.automaton.make_automaton()
        self.phrases = frozenset(lexicon.exceptions)

    def hits(self, folded: str) -> list[tuple[int, str, float]]:
        """Start, word and weight of each matched word: the best entry counts once."""
        found: dict[int, float] = {}
        size = len(folded)
        for end, (length, word, stem) in self.automaton.iter(folded) if self.usable else ():
            start = end - length + 1
            if start and folded[start - 1].isalnum():
                continue
            weight = word if word is not None and (end + 1 == size or not folded[end + 1].isalnum()) else None
            weight = max(x for x in (weight, stem, -math.inf) if x is not None)
            if weight > found.get(start, -math.inf):
                found[start] = weight
        return [(start, _WORD.match(folded, start).group(), w) for start, w in sorted(found.items())]

    def neighbours(self, folded: str, start: int, word: str) -> tuple[str, str]:
        """The phrases that a hit makes with the words before and behind it."""
        before = _WORD.findall(folded[max(0, start - 60) : start])
        behind = _WORD.search(folded, start + len(word))
        return (f"{before[-1]} {word}" if before else "", f"{word} {behind.group()}" if behind else "")

    def evidence(self, text: str | None) -> tuple[float, float]:
        """Sum of weights outside exception phrases, and length in words."""
        folded = fold(text or "")
        total = 0.0
        for start, word, weight in self.hits(folded):
            if not self.phrases or self.phrases.isdisjoint(self.neighbours(folded, start, word)):
                total += weight
        return total, len(folded.split()) + 1.0

    def score(self, text: str | None) -> float:
        total, length = self.evidence(text)
        z = total / length**self.lexicon.power
        return z / (z + self.lexicon.half) if z > 0 else 0.0


# --------------------------------------------------------------------- fit


def _sampled(documents: DataFrame, labels: DataFrame, per_label: int) -> DataFrame:
    """About ``per_label`` labelled texts of each label, one for each id: columns t, y.

    An id with several labels counts with the one most of them give; without a
    majority it teaches nothing.  Of several texts of an id the first in order counts.
    """
    known = pick(labels, "doc_id", "toxic").toDF("k", "y").where("y in (0, 1) and k is not null")
    settled = known.groupBy("k").agg(F.sum(2 * F.col("y") - 1).alias("s")).where("s <> 0").select("k", (F.col("s") > 0).cast("int").alias("y"))
    sizes = {r.y: r.n for r in settled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    part = F.lit(0)
    for y, n in sizes.items():
        part = F.when(F.col("y") == y, F.lit(min(_HASH_RANGE, math.ceil(_HASH_RANGE * per_label / n)))).otherwise(part)
    chosen = settled.where(F.pmod(F.xxhash64("k"), F.lit(_HASH_RANGE)) < part)
    # The sample's size is bounded by ``per_label``, so it may be broadcast.
    texts = pick(documents, "doc_id", "text").toDF("k", "t").where("t is not null").join(F.broadcast(chosen), "k")
    return texts.groupBy("k").agg(F.min("t").alias("t"), F.first("y").alias("y")).select("t", "y")


def _counted(sample: DataFrame, terms) -> DataFrame:
    """Toxic and clean documents of each term, counted in the tasks first."""

    @gives_back
    def count(batches):
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if y else clean).update(terms(fold(text)))
        keys = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], names=["term", "toxic", "clean"])

    return sample.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("c"))


def _word_terms(folded: str) -> set[str]:
    words = set(_WORD.findall(folded))
    return {w + "." for w in words} | {w[:n] for w in words for n in STEM_LENGTHS if len(w) > n}


def fit(documents: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Lexicon:
    """Learn words, word beginnings, exception phrases and the score's scale.

    Only labels 0 and 1 with an id teach; contradictory ones are settled by
    majority, or teach nothing.  Null texts teach nothing.  The same rows give
    the same lexicon, whatever their order.  Without toxic or without clean
    documents the lexicon is empty and every score is 0.
    """
    sample = written(_sampled(documents, labels, per_label), "toxicity-sample")
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon()
    odds = F.log((F.col("a") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    whole = F.col("term").endswith(".")
    good = F.when(whole, (F.col("a") >= WORD_DOCUMENTS) & (odds >= WORD_WEIGHT)).otherwise((F.col("a") >= STEM_DOCUMENTS) & (odds >= STEM_WEIGHT))
    terms = _counted(sample, _word_terms).where(good).select("term", odds.alias("w")).orderBy(F.desc("w"), "term").limit(MAX_TERMS).collect()
    words = {r.term[:-1]: r.w for r in terms if r.term.endswith(".")}
    stems = {r.term: r.w for r in terms if not r.term.endswith(".")}
    lexicon = Lexicon(words, stems)

    def phrases(folded: str) -> set[str]:
        matcher = _cached_matcher(lexicon)  # one lexicon for each task's closure
        return {p for start, word, _ in matcher.hits(folded) for p in matcher.neighbours(folded, start, word) if p}

    excepted = _counted(sample, phrases).where((F.col("c") >= EXCEPTION_DOCUMENTS) & ((F.col("c") + 0.5) / (clean + 1.0) >= EXCEPTION_ODDS * (F.col("a") + 0.5) / (toxic + 1.0)))
    lexicon.exceptions = tuple(sorted(r.term for r in excepted.orderBy(F.desc("c"), "term").limit(MAX_EXCEPTIONS).collect()))

    @gives_back
    def evidence(batches):
        matcher = Matcher(lexicon)
        for batch in batches:
            found = [matcher.evidence(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([t for t, _ in found], pa.float64()), pa.array([n for _, n in found], pa.float64())], names=["y", "total", "length"])

    rows = sample.mapInArrow(evidence, "y int, total double, length double").collect()  # numbers of the bounded sample
    discard(sample)
    lexicon.power, lexicon.half = _scale(np.array([r.y for r in rows]), np.array([r.total for r in rows]), np.array([r.length for r in rows]), clean / toxic)
    return lexicon


_LAST: list = [None, None]


def _cached_matcher(lexicon: Lexicon) -> Matcher:
    if _LAST[0] is not lexicon:
        _LAST[:] = [lexicon, Matcher(lexicon)]
    return _LAST[1]


def _scale(y: np.ndarray, total: np.ndarray, length: np.ndarray, clean_weight: float) -> tuple[float, float]:
    """Length power and half point with the fewest errors on the sample.

    Among equal errors the widest gap between the classes decides.
    """
    best = (math.inf, 0.0, 0.5, 1.0)
    for power in (0.25, 0.5, 0.75, 1.0):
        z = total / length**power
        values = np.unique(z)
        cuts = np.concatenate([(values[1:] * values[:-1].clip(1e-9)) ** 0.5, [values[-1] * 2 + 1e-6]])
        toxic, clean = np.sort(z[y == 1]), np.sort(z[y == 0])
        missed = np.searchsorted(toxic, cuts, side="left")
        wrong = len(clean) - np.searchsorted(clean, cuts, side="left")
        errors = missed + wrong * min(clean_weight, 1.0)
        least = errors.min()
        at = np.flatnonzero(errors == least)
        gaps = np.array([math.log((values[i + 1] if i + 1 < len(values) else cuts[i]) / max(values[i], 1e-3)) for i in at])
        pick_ = at[gaps.argmax()]
        if (least, -gaps.max()) < best[:2]:
            low, high = max(values[pick_], 1e-3), values[pick_ + 1] if pick_ + 1 < len(values) else cuts[pick_]
            best = (least, -gaps.max(), power, math.sqrt(low * max(high, low)))
    return best[2], best[3]


# ---------------------------------------------------------------- operator


def score_toxicity(df: DataFrame, lexicon: Lexicon, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Result: the key, ``score`` (0 to 1) and ``predicted`` (1 from score 0.5), a row for each input row.

    Null and empty texts score 0, equal texts alike; white space does not
    change a score.  Whole texts are searched, however long.  Columns other
    than key and text are not looked at, whatever their names.  An empty table
    gives an empty result.
    """
    rows = pick(df, key, text)
    spread = rows.sparkSession.sparkContext.broadcast(lexicon)

    @gives_back
    def score(batches):
        matcher = once(spread, Matcher)
        for batch in batches:
            for part in steps(batch):
                scores = [matcher.score(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=[key, "score", "predicted"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(score, f"`{key}` {kind}, score double, predicted int")


def held_out(doc_id: Column) -> Column:
    return id_crc32(doc_id) % 5 == 0


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels that are not held out."""
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    lexicon = fit(documents, labels.where(~held_out(F.col("doc_id"))))
    return score_toxicity(documents, lexicon).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
