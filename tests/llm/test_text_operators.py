"""Operators on single texts: exact round trips, plain-Python results, and awkward rows."""

import binascii
import hashlib
import random
import re
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandline.llm import chat, langid, media, mixing, pretokens, simple8b, token_counts, token_files, toxicity

LONG = "wort und satz. " * 20_000
ROWS = [(1, "The cat sat.\nOn the mat.", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (None, "no id", "en", "b"), (4, "same", "en", "b"), (4, "same", "en", "b"), (5, "x<|endoftext|> y  z é日\t\n", None, "c"), (6, LONG, "de", "a"), (7, "1234 !!", "de", "c")]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing extra columns."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.select("doc_id", "text", "lang", "source", F.lit(1).alias("TEXT"), F.lit("x").alias("score"), F.lit(2).alias("k"), F.lit(3).alias("n_tokens"))


def by_text(rows):
    return sorted((tuple(r) for r in rows), key=str)


# ------------------------------------------------------------------- media


@pytest.mark.parametrize("size", [0, 1, 191, 192, 193, 5000, 100_000])
def test_png_round_trip(size):
    data = media.pad(bytes(np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8)))
    assert len(data) % 192 == 0 and len(data) > 0
    assert media.decode_png(media.encode_png(data)).tobytes() == data


def test_png_filters_against_plain_loops():
    rng = np.random.default_rng(1)
    rows, kinds = rng.integers(0, 256, (9, 24), dtype=np.uint8), np.array([2, 4, 3, 1, 0, 2, 2, 4, 3], np.uint8)
    want = np.zeros((9, 24), int)
    for y in range(9):
        for x in range(24):
            a = want[y, x - 3] if x >= 3 else 0
            b = want[y - 1, x] if y else 0
            c = want[y - 1, x - 3] if y and x >= 3 else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            want[y, x] = (int(rows[y, x]) + [0, a, b, (a + b) // 2, near][kinds[y]]) % 256
    assert (media._unfilter(kinds, rows, 3) == want).all()
    plain = np.array([1, 2, 2, 0, 2, 1, 1, 0, 2], np.uint8)
    want = np.zeros((9, 24), np.uint8)
    for y in range(9):
        for x in range(24):
            before = {0: 0, 1: want[y, x - 3] if x >= 3 else 0, 2: want[y - 1, x] if y else 0}[int(plain[y])]
            want[y, x] = (int(rows[y, x]) + int(before)) % 256
    assert (media._unfilter(plain, rows, 3) == want).all()


def test_png_damage_is_noticed():
    good = media.encode_png(media.pad(b"hello"))
    for at in (3, 20, 45, len(good) - 2):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media.decode_png(bytes(bad))
    with pytest.raises(ValueError):
        media.decode_png(good[:-12])


def test_cosine_hash_is_stable_and_low_frequency():
    pixels = media.decode_png(media.encode_png(media.pad(b"some text " * 500)))
    noisy = pixels.copy()
    noisy[0, 0, 0] ^= 1
    different = sum(bin(a ^ b).count("1") for a, b in zip(media.cosine_hash(pixels), media.cosine_hash(noisy), strict=True))
    assert len(media.cosine_hash(pixels)) == 8 and different <= 4


def plain_cosine_hash(payload):
    """The definition, coefficient by coefficient: a 32 x 32 mean image, its 8 x 8 lowest cosines, signs around the median."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3).astype(float).sum(axis=2) / 3
    h = len(pixels)
    part = lambda i, n: range(i * n // 32, (i + 1) * n // 32) if n >= 32 else [i * n // 32]
    small = np.array([[np.mean([pixels[y, x] for x in part(j, 64) for y in part(i, h)]) if h <= 400 else pixels[list(part(i, h))][:, list(part(j, 64))].mean() for j in range(32)] for i in range(32)])
    values = []
    for u in range(8):
        for v in range(8):
            scale = (1 if u else 0.5**0.5) * (1 if v else 0.5**0.5) / 16
            wave = np.outer(np.cos(np.pi * u * (2 * np.arange(32) + 1) / 64), np.cos(np.pi * v * (2 * np.arange(32) + 1) / 64))
            values.append(round(scale * float((small * wave).sum()), 6))
    middle = float(np.median(values[1:]))
    bits = "".join("1" if x > middle else "0" for x in values)
    return int(bits, 2).to_bytes(8, "big")


def test_steps_are_bounded_by_bytes():
    import pyarrow as pa

    from strandline.llm._common import steps

    batch = pa.RecordBatch.from_pydict({"a": list(range(9)), "t": ["x" * n for n in (1, 1, 50, 200, 1, 1, 1, 90, 20)]})
    parts = list(steps(batch, 4, 100))
    assert [p.num_rows for p in parts] == [3, 1, 4, 1] and pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert [p.num_rows for p in steps(batch, 4)] == [4, 4, 1]


def test_media_operator(docs):
    got = {(r.doc_id, r.payload_sha256): r for r in media.media_features(media.store_media(docs)).collect()}
    for doc_id, text, *_ in ROWS:
        raw = (text or "").encode()
        payload = media.pad(raw)
        r = got[doc_id, hashlib.sha256(payload).hexdigest()]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-16:]))
        stored = media.encode_png(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert bytes(r.visual_hash) == plain_cosine_hash(payload)
    assert media.media_features(media.store_media(docs.limit(0))).count() == 0


# ------------------------------------------------------------------ tokens


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_pre_token_cache_is_exact(tokenizer):
    encoder = pretokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), list)
    encoder.cache.bound = 50  # generations change often
    rng = random.Random(2)
    texts = [t for _, t, *_ in ROWS if t and t != LONG] + ["it's I'll 'tis", "a  b   c\n\n d", "<|endoftext|>", "١٢ ab", "a\x1cb\u0085c"]
    texts += ["".join(rng.choice("abstelvdrmA \n\t\r'.éÀß×ɏ9日<|1-") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for t in texts:
        assert [i for part in encoder.parts(t) for i in part] == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_rare_characters_use_the_caches(tokenizer):
    encoder = pretokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), list)
    texts = ["“quoted” – and € 5 © µ", "Привет, мир! Ещё раз: привет", "Ελληνικά και άλλα", "日本語のテキスト と 漢字", "emoji 😀😀 👩‍👩‍👧 ok", "क्षि नमस्ते १२३", "a\u200bb\u00a0c\u3000d \u2028 e"]
    for t in texts * 2:
        assert [i for part in encoder.parts(t) for i in part] == tokenizer.encode(t, add_special_tokens=False).ids, t
    assert "Привет" in encoder.cache and " мир" in encoder.cache and len(encoder.cache) > 20


def test_cached_pre_tokens_need_no_python_call(tokenizer):
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    encoder = pretokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), list, [(" the", ids(" the"))])
    text = "".join(f" the été{i} w{i}" for i in range(300))
    for _ in range(2):  # the second time every pre-token is known
        calls = []
        sys.setprofile(lambda frame, event, arg, calls=calls: calls.append(frame.f_code.co_name) if event == "call" else None)
        try:
            parts = encoder.parts(text)
        finally:
            sys.setprofile(None)
        assert [i for part in parts for i in part] == ids(text)
    assert "__missing__" not in calls and len(calls) < 10


def test_token_counts(docs, tokenizer):
    got = by_text(token_counts.count_tokens(docs, limit=5).collect())
    want = [(k, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 5) for k, t, *_ in ROWS]
    assert got == by_text(want)
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


@pytest.mark.parametrize("kind", range(5))
def test_simple8b_round_trip(kind):
    rng = np.random.default_rng(kind)
    for n in (0, 1, 2, 119, 120, 239, 240, 241, 255, 256, 257, 1000, 5000):
        ids = [rng.integers(0, 50_257, n), np.zeros(n), rng.integers(0, 2, n), 2 ** rng.integers(0, 63, n), np.full(n, 2**64 - 1, np.uint64)][kind].astype(np.uint64)
        words, offsets = simple8b.encode_words(ids)
        assert (simple8b.decode_words(words, n) == ids).all()
        unit = simple8b.Unit(simple8b.pack_unit([3, None], [n, 0], ids, 7))
        assert unit.keys == [3, None] and unit.before == 7 and (unit.ids() == ids).all()
        for b in range(len(offsets)):
            assert (unit.block_ids(b) == ids[b * simple8b.BLOCK : (b + 1) * simple8b.BLOCK]).all()


def test_simple8b_widths():
    small = [0, 1, 2, 3, 255, 256, 50_256, (1 << 16) - 1]
    for more in ([], [1 << 16], [(1 << 52) - 1], [1 << 52, (1 << 64) - 1]):
        ids = np.array(small + more, np.uint64)
        assert simple8b._width(ids).tolist() == [int(i).bit_length() for i in ids]


def test_simple8b_damage_is_noticed():
    data = bytearray(simple8b.pack_unit([1], [3], np.array([1, 2, 3], np.uint64), 0))
    data[-10] ^= 1
    with pytest.raises(ValueError):
        simple8b.Unit(bytes(data))


def test_token_files(docs, tokenizer, spark):
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for k, t, *_ in order:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in token_files.token_file_digests(docs.repartition(3)).collect()), key=lambda r: r[1])
    assert got == want
    path = token_files.fresh_path(spark, "test")
    token_files.write_token_files(docs, path)
    ids = [i for r in sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start) for i in r.ids]
    assert len(ids) == start and ids[-1] == 2
    assert token_files.token_file_digests(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- language


def plain_language(text, dictionaries):
    """Sizes by one plain compressor for each language."""
    if not text or not any(c.isalpha() for c in text):
        return "und"
    how = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    size = lambda x: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionaries[x], dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how).compress(text.lower().encode()))
    return min(sorted(dictionaries), key=size)


def test_language_by_compression(spark):
    rng = random.Random(3)
    words = {"aa": ["the", "cat", "house", "and", "with"], "bb": ["der", "katze", "haus", "und", "mit"]}
    say = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    train = spark.createDataFrame([(say(x, 60), x) for x in "aa bb".split() for _ in range(50)] + [(None, "aa"), ("orphan", None), ("", "cc")], "text string, lang string")
    model = langid.fit(train)
    assert sorted(model.dictionaries) == ["aa", "bb"] and model == langid.fit(train.repartition(5))
    test = [(i, say(x, 30), x) for i, x in enumerate("aa bb".split() * 20)] + [(100, None, None), (101, "", None), (102, "12 !?", None), (103, "²½Ⅷ①", None), (104, "cat haus", None), (105, say("aa", 9000), "aa")]
    test += [(200 + i, say("aa", rng.randint(0, 3)) + " " + say("bb", rng.randint(0, 3)), None) for i in range(30)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(test, "doc_id long, text string, score string"), model).collect()}
    assert all(got[i].lang_pred == x and 0 <= got[i].score <= 1 and not got[i].rejected for i, _, x in test[:40])
    assert all((got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True) for i in (100, 101, 102, 103))
    assert all(got[i].lang_pred == plain_language(t, model.dictionaries) for i, t, _ in test)
    assert langid.fit(train.limit(0)) == langid.Model()
    df = spark.createDataFrame(test, "doc_id long, text string, score string")
    assert langid.identify(df, model, keep=("doc_id", "score")).columns == ["doc_id", "score", "lang_pred", "score_found", "margin", "rejected"]
    assert [r.lang_pred for r in langid.identify(train, langid.Model(), keep=("lang",)).collect()] == ["und"] * 103
    assert langid.identify(df.limit(0), model).count() == 0


def test_no_language_is_lost(spark):
    """Many rows of few texts: the cut is by different texts, so each language keeps some."""
    rows = [(f"only text {i % 2} of language {lang}", lang) for lang in ("aa", "bb", "cc") for i in range(3000)]
    for seed in range(3):
        model = langid.fit(spark.createDataFrame([(f"{t} {seed}", x) for t, x in rows], "text string, lang string"), texts=1)
        assert sorted(model.dictionaries) == ["aa", "bb", "cc"] and all(model.dictionaries.values())


def test_margins_reject_what_is_wrong_more_often(spark):
    model = langid.Model({"aa": b"abcabcabd " * 50, "bb": b"xyzxyzxyw " * 50})
    classifier = langid.Classifier(model)
    short = "abc xyz"
    margin = classifier.classify(short)[2]
    lang = classifier.classify(short)[0]
    wrong = [(short, "bb" if lang == "aa" else "aa")] * 5
    assert langid._margins(spark, model, wrong)[0] == margin + 1
    assert langid._margins(spark, model, [(short, lang)] * 9 + wrong) == (1, 1, 1)


# ---------------------------------------------------------------- toxicity


def test_fold():
    assert toxicity.fold("ІdІ0Т") == "idiot" and toxicity.fold("m0r0n") == "moron" and toxicity.fold("Ｓcüm") == "scum" and toxicity.fold("stu​pid") == "stupid"
    assert toxicity.fold("$cum! ok") == "scum  ok"


def test_matcher_weights_bounds_and_exceptions():
    lexicon = toxicity.Lexicon({"trash": 2.0}, {"moro": 3.0}, ("trash can",), 0.5, 1.0)
    m = toxicity.Matcher(lexicon)
    assert m.evidence("trash")[0] == 2 and m.evidence("trashy untrash")[0] == 0 and m.evidence("the trash can")[0] == 0
    assert m.evidence("You m0r0nic")[0] == 3 and m.evidence("amoron")[0] == 0
    assert m.score(None) == 0 and m.score("") == 0 and 0 < m.score("moron") < 1
    assert m.score("moron") > m.score("moron" + " calm" * 50)


def test_toxicity_fit(spark):
    rng = random.Random(4)
    calm = lambda: " ".join(rng.choice("the of and house tree river walk green quiet day".split()) for _ in range(rng.randint(5, 60)))
    docs, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        text = calm() + (f" {rng.choice(['blergo', 'snarfan', 'snarfeu'])} {calm()} {rng.choice(['blergo', 'snarfix'])}" if bad else " good snarl" if i % 7 == 0 else "")
        docs.append((i, text))
        labels.append((i, int(bad)))
    docs += [(1000, None), (1001, "")]
    labels += [(1000, 1), (None, 1), (5, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lexicon = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score_toxicity(d, lexicon).collect()}
    wrong = [i for i, y in labels[:300] if got[i].predicted != y]
    assert not wrong and got[1000].score == 0 and got[1001].predicted == 0
    for r in got.values():
        assert r.score == pytest.approx(plain_score(dict(docs)[r.doc_id], lexicon), abs=1e-12)
    assert toxicity.fit(d, spark.createDataFrame([(1, 0)], "doc_id long, toxic int")) == toxicity.Lexicon()
    assert toxicity.score_toxicity(d.limit(0), lexicon).count() == 0


def plain_score(text, lexicon):
    """The score without an automaton: every word is looked up, and every beginning of it."""
    folded = toxicity.fold(text or "")
    words = [(m.start(), m.group()) for m in re.finditer(r"[^\W_]+", folded)]
    total = 0.0
    for i, (start, word) in enumerate(words):
        if start and folded[start - 1].isalnum():
            continue
        weights = [lexicon.words[word]] if word in lexicon.words else []
        weights += [w for stem, w in lexicon.stems.items() if word.startswith(stem)]
        near = [f"{words[i - 1][1]} {word}"] if i and start - words[i - 1][0] <= 60 else []
        near += [f"{word} {words[i + 1][1]}"] if i + 1 < len(words) else []
        if weights and not set(near) & set(lexicon.exceptions):
            total += max(weights)
    z = total / (len(folded.split()) + 1.0) ** lexicon.power
    return z / (z + lexicon.half) if z > 0 else 0.0


def test_toxicity_settles_contradictory_labels(spark):
    documents = spark.createDataFrame([(i, f"text {i}") for i in range(6)] + [(0, "another")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (0, 1), (0, 0), (1, 0), (1, 1), (2, 0), (3, 1), (3, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    got = sorted((r.t, r.y) for r in toxicity._sampled(documents, labels, 100).collect())
    assert got == [("another", 1), ("text 2", 0), ("text 3", 1)]


def test_toxicity_ignores_blanks():
    m = toxicity.Matcher(toxicity.Lexicon({"trash": 2.0}, {}, (), 0.5, 1.0))
    assert m.score("some trash") == m.score("  some \n\n   trash" + " " * 500)


# ------------------------------------------------------------------ mixing


def plain_water_fill(sizes, weights, total, epochs):
    caps, clamped = [epochs * s for s in sizes], set()
    while True:
        share = sum(w for i, w in enumerate(weights) if i not in clamped)
        left = total - sum(caps[i] for i in clamped)
        targets = [caps[i] if i in clamped else left * w / share for i, w in enumerate(weights)]
        over = {i for i, t in enumerate(targets) if i not in clamped and t >= caps[i]}
        if not over:
            return targets
        clamped |= over


def test_water_fill(spark):
    rng = random.Random(5)
    cases = [([100, 100], [1, 1], 100), ([10, 100], [5, 1], 150), ([10, 20, 0], [1, 1, 1], 1000), ([], [], 0), ([7], [2], 10.5)]
    for _ in range(4):
        n = rng.randint(2, 40)
        sizes = [rng.randint(0, 50) for _ in range(n)]
        cases.append((sizes, [rng.choice([5, 2, 1]) for _ in range(n)], 1.5 * sum(sizes)))
    for sizes, weights, total in cases:
        df = spark.createDataFrame([(i, n, w, 2.0 * n) for i, (n, w) in enumerate(zip(sizes, weights, strict=True))], "s long, size long, w int, cap double")
        got = [r.target for r in mixing.water_fill(df, float(total)).orderBy("s").collect()]
        assert got == pytest.approx(plain_water_fill(sizes, weights, total, 2))


def test_repeated_rows_are_taken_one_by_one(spark):
    """Equal rows without an id: as many are taken as fit, wherever they are stored."""
    rows = [(None, "w " * 10, "a")] * 1000 + [(None, "v " * 10, "a")] * 3 + [(i, "w " * 7, "b") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    for part in (0.75, 0.333):
        got = mixing.mix(df, weights=(1, 1), share=part).toPandas().groupby("source_size").agg({"target": "first", "taken": "sum"})
        assert (abs(got.taken - got.target) <= 5.0).all() and len(got) == 2
        again = mixing.mixed_rows(df, weights=(1, 1), share=part).groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("n")).collect()
        assert sorted(r.n for r in again) == sorted(got.taken)


def test_mix(docs, spark):
    got = mixing.mix(docs).collect()
    sizes = {"a": 6 + 60_000, "b": 4, "c": 6, None: 0}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.times * r["size"]
    assert {r.source_size for r in got} == {sizes["a"], sizes["b"], sizes["c"], 0}
    assert by_text(got) == by_text(mixing.mix(docs.repartition(3)).collect())
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns and rows.count() == sum(r.times for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_rows(docs.limit(0)).count() == 0


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * 3 for _ in range(rng.randint(1, 40))), rng.choice("aaab") if i % 9 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, weights=(1, 1, 3)).toPandas().groupby("source_size").agg({"target": "first", "taken": "sum"})
    assert (abs(got.taken - got.target) <= 40).all()


# -------------------------------------------------------------------- chat


def _digest(turns):
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    lost = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest()


NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\s>", "<\\s>", "[/INST", " [/INST] ", "<s>", "", None, "x\n</s\n", "日本 \\[INST]", "plain words here", "<", "</", "[\\/INST]"]


@pytest.mark.parametrize("budget", [chat.Budget(), chat.Budget(window=20, history=12, history_turns=2), chat.Budget(window=1, history=0)])
def test_chat_round_trip(spark, budget):
    rng = random.Random(7)
    rows, convs = [], {}
    for conv in [*range(40), None]:
        turns = [("system", rng.choice(NASTY))] * rng.choice([0, 0, 1, 2]) if conv != 3 else [("system", "only")]
        if conv != 3:
            turns += [(rng.choice(["user", "assistant", "system", "to[/INST]ol", None]), rng.choice(NASTY)) for _ in range(rng.randint(1, 12))]
        convs[conv] = turns
        rows += [(conv, i, r, t) for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", F.lit(1).alias("window"), F.lit("x").alias("TEXT"))
    windows = chat.format_windows(df, budget)
    got = {r.conv_id: r for r in chat.window_digests(windows).collect()}
    assert set(got) == set(convs)
    for conv, turns in convs.items():
        assert tuple(got[conv])[1:5] == _digest(turns), conv
    for r in windows.collect():
        assert r.text.count(chat.END) == r.text.count(chat.BEGIN) == r.text.count(chat.SAYS)


def test_chat_windows_keep_to_the_budget(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, "assistant" if i % 2 == 0 else "user", "word " * 10) for i in range(1, 40)]
    budget = chat.Budget(window=80, history=20, history_turns=3)
    windows = chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget).orderBy("window").collect()
    assert len(windows) > 3 and all(w.tokens <= budget.window for w in windows)
    assert all(w.text.startswith("<s>[INST] system [/INST] be kind</s>") for w in windows)
    assert windows[0].repeated == 0 and all(w.repeated >= 2 for w in windows[1:])


def test_chat_ties_and_repeats(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", "first")]
    r = chat.window_digests(chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert tuple(r)[1:5] == _digest([("user", t) for t in ("first", "a", "a", "b")])
    assert chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").limit(0)).count() == 0


def test_chat_uses_no_python(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat.window_digests(chat.format_windows(rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_crc_helper(spark):
    from strandline.llm._common import id_crc32

    got = spark.createDataFrame([(5,), (None,)], "doc_id long").select(id_crc32(F.col("doc_id")).alias("c")).collect()
    assert [r.c for r in got] == [binascii.crc32(b"5"), 0]


def test_chat_is_linear_in_turns(spark):
    """Windows hold only their own turns, and leading system turns too long to repeat come once."""
    rows = [(1, 0, "system", "rule " * 300), (1, 1, "system", "rule " * 300)] + [(1, i, "assistant" if i % 2 else "user", f"word{i} " * 12) for i in range(2, 1500)]
    rows += [(2, i, "system", "many words here") for i in range(200)] + [(2, 200 + i, "user", "go") for i in range(100)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(df)
    sizes = windows.groupBy("conv_id").agg(F.sum(F.length("text")).alias("n"), F.max("tokens").alias("most"), F.count("*").alias("windows")).collect()
    plain = {c: sum(len(t) + len(r) + 25 for k, _, r, t in rows if k == c) for c in (1, 2)}
    assert all(s.n <= 3 * plain[s.conv_id] for s in sizes) and len(sizes) == 2
    got = {r.conv_id: tuple(r)[1:5] for r in chat.window_digests(windows).collect()}
    assert got == {c: _digest([(r, t) for k, _, r, t in rows if k == c]) for c in (1, 2)}


def test_token_files_of_repeated_rows(spark, tokenizer):
    rows = [(None, None)] * 400 + [(None, "a b")] * 400 + [(1, "x")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = token_files.token_file_digests(df).orderBy("start").collect()
    assert len(got) == 850 and [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(850)]
    assert [r.doc_id for r in got] == [None] * 800 + [1] * 50
