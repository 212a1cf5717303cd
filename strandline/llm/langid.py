"""Language identification by compression.

Each language has a raw-content zstandard dictionary of its own text.  A text
belongs to the language whose dictionary makes it smallest; where the runner-up
comes within a margin the answer is kept but marked as rejected.  The margin
depends on the text's length and is calibrated on labelled texts that are not
in the dictionaries: below it such texts are more often wrong than right.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm._common import gives_back, id_crc32, once, pick, result_names, steps, table

#: The fit uses about this many labelled texts of each language, chosen by a
#: hash of the text, and at most so many characters of each ...
SAMPLE_TEXTS = 400
SAMPLE_CHARS = 4_000
#: ... until a dictionary has so many bytes.  About as many more texts of each
#: language calibrate the margin.  The model's size is the number of languages
#: times this.
DICTIONARY_BYTES = 256 * 1024
LEVEL = 6
#: The margin is at least this many bytes, so that equal sizes are rejected, and
#: at most so many; it is calibrated for texts of up to these numbers of bytes, and longer ones.
MIN_MARGIN, MAX_MARGIN = 1, 64
LENGTHS = (64, 512)
#: Bytes of difference by which odds change e-fold.
TEMPERATURE = 8.0
UNKNOWN = "und"
#: Candidates for letters; ``str.isalpha`` decides (superscripts and Roman numerals are none).
_WORD_CHARACTER = re.compile(r"[^\W\d_]")
_HASH_RANGE = 1 << 30


@dataclass
class Model:
    """A dictionary for each language, and the margin for each class of lengths."""

    dictionaries: dict[str, bytes] = field(default_factory=dict)
    margins: tuple[int, ...] = (MIN_MARGIN,) * (len(LENGTHS) + 1)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in _WORD_CHARACTER.finditer(text))


def _form(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", texts: int = SAMPLE_TEXTS, dictionary_bytes: int = DICTIONARY_BYTES) -> Model:
    """A raw-content dictionary for each language of the labelled texts, and calibrated margins.

    Rows with a null or empty text or a null language teach nothing.  Copies of
    a text count once, and every language that has a text keeps some.  The same
    rows give the same model, whatever their order; none give an empty one.
    """
    rows = pick(labelled, text, lang).toDF("t", "l").where("t is not null and l is not null and length(t) > 0")
    order = F.pmod(F.xxhash64("t"), F.lit(_HASH_RANGE))
    # Different texts of each language; counts are sketches, made before the shuffle.
    sizes = rows.groupBy("l").agg(F.approx_count_distinct(order).alias("n"))
    bounds = sizes.select(F.col("l").alias("sl"), F.least(F.ceil(F.lit(float(_HASH_RANGE * texts)) / F.greatest("n", F.lit(1))), F.lit(_HASH_RANGE)).cast("long").alias("cut"))
    near = F.broadcast(bounds)  # as many rows as the model has dictionaries
    sample = rows.join(near, F.col("l") == F.col("sl")).where(order < F.col("cut") * 2)
    sample = sample.groupBy("l", order.alias("o"), (order < F.col("cut")).alias("teaches")).agg(F.min(F.substring("t", 1, SAMPLE_CHARS)).alias("t")).collect()
    sample.sort(key=lambda r: (r.l, r.o))
    content: dict[str, bytearray] = {}
    teaching = {r.l for r in sample if r.teaches}
    for r in sample:
        held = content.setdefault(r.l, bytearray())
        # A language too small for the cut still keeps its texts.
        if (r.teaches or r.l not in teaching) and len(held) < dictionary_bytes:
            held += _form(r.t) + b"\n"
    model = Model({l: bytes(b[:dictionary_bytes]) for l, b in content.items()})
    others = [(r.t, r.l) for r in sample if not r.teaches and r.l in teaching]
    model.margins = _margins(labelled.sparkSession, model, others)
    return model


def _margins(spark, model: Model, others: list[tuple[str, str]]) -> tuple[int, ...]:
    """For each class of lengths, the widest margin below which answers are wrong at least as often as right."""
    if not others or len(model.dictionaries) < 2:
        return Model().margins
    found = identify(spark.createDataFrame(others, "t string, l string").repartition(8), model, "t", ("t", "l"))
    seen = found.where(F.col("lang_pred") != UNKNOWN).select(F.octet_length(F.lower("t")).alias("n"), "margin", (F.col("l") == F.col("lang_pred")).alias("right")).collect()
    out = []
    for low, high in zip((0, *LENGTHS), (*LENGTHS, math.inf), strict=True):
        balance, best = 0, MIN_MARGIN
        for m in range(MAX_MARGIN):
            balance += sum((-1 if r.right else 1) for r in seen if r.margin == m and low < r.n <= high)
            if balance >= 0 and any(r.margin == m and not r.right and low < r.n <= high for r in seen):
                best = max(best, m + 1)
        out.append(best)
    return tuple(out)


class Classifier:
    """Sizes of texts under each language's dictionary."""

    def __init__(self, model: Model):
        dictionaries = model.dictionaries
        self.margins = model.margins
        self.languages = sorted(dictionaries)
        self._compress = []
        for lang in self.languages:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
            content.precompute_compress(compression_params=how)
            self._compress.append(zstandard.ZstdCompressor(dict_data=content, compression_params=how).compress)

    def classify(self, text: str | None) -> tuple[str, float, int, bool]:
        """Language, score, margin in bytes, and whether that is too narrow."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, 0, True
        data = _form(text)
        sizes = [f(data) for f in self._compress]
        sizes = [len(s) for s in sizes]
        best = min(sizes)
        score = 1.0 / sum(math.exp((best - s) / TEMPERATURE) for s in sizes)
        margin = sorted(sizes)[1] - best if len(sizes) > 1 else len(data)
        least = self.margins[sum(len(data) > n for n in LENGTHS)]
        return self.languages[sizes.index(best)], score, margin, margin < least


def identify(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Predict each text's language.

    Result: the columns of ``keep``, ``lang_pred``, ``score`` (0 to 1),
    ``margin`` (bytes) and ``rejected``, one row for each input row; a result
    column whose name is also kept gets ``_found`` behind it.  A text that is
    null or has no letter is ``und`` with score 0 and rejected, and so is every
    text if the model is empty; on equal sizes the first language by code point
    is given, and rejected for its narrow margin.  Repeated rows get equal
    answers, whole texts are encoded however long, an empty table gives an
    empty result.
    """
    rows = pick(df, text, *[k for k in keep if k != text])
    passed = [rows.columns.index(k) for k in keep]
    spread = rows.sparkSession.sparkContext.broadcast(model)
    own = list(result_names(keep, ("lang_pred", "score", "margin", "rejected")).values())

    @gives_back
    def predict(batches):
        classifier = once(spread, Classifier)
        for batch in batches:
            for part in steps(batch):
                found = [classifier.classify(t) for t in part.column(0).to_pylist()]
                kinds = (pa.string(), pa.float64(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in passed], *[pa.array([f[j] for f in found], kind) for j, kind in enumerate(kinds)]], names=[*keep, *own])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    return rows.mapInArrow(predict, kept + "".join(f", `{n}` {t}" for n, t in zip(own, ("string", "double", "long", "boolean"), strict=True)))


def held_out(doc_id: Column) -> Column:
    return id_crc32(doc_id) % 4 == 2


def fitted(documents: DataFrame) -> Model:
    """A model of the documents that are not held out."""
    return fit(pick(documents, "doc_id", "text", "lang").where(~held_out(F.col("doc_id"))))


def op3_language(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    documents = table(spark, sf_dir, "documents")
    found = identify(documents, fitted(documents))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
