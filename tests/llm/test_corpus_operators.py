"""Operators that look across documents, held against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandline.llm import decontaminate, jaccard_join, line_dedup
from strandline.llm.components import components

RNG = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(400)]


def say(n: int) -> list[str]:
    return [RNG.choice(VOCABULARY) for _ in range(n)]


def edited(words: list[str], edits: int) -> list[str]:
    out = list(words)
    for _ in range(edits):
        at = RNG.randrange(len(out))
        kind = RNG.random()
        if kind < 0.4:
            out[at] = RNG.choice(VOCABULARY)
        elif kind < 0.7:
            del out[at]
        else:
            out.insert(at, RNG.choice(VOCABULARY))
    return out


# ------------------------------------------------------------- components


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (200, 150), (200, 151), (151, 152)] + [(300, 300 + i) for i in range(1, 80)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in range(61)} | {100: 100, 101: 100, 150: 150, 151: 150, 152: 150, 200: 150} | {300 + i: 300 for i in range(80)}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---------------------------------------------------------------- join


def brute(docs, threshold=0.8):
    """Class, set and link counts by comparing every pair of exact shingle sets."""

    def shingles(text):
        words = (text or "").lower().split()
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])

    sets = [shingles(t) for _, t in docs]
    near = lambda a, b: a == b or (len(a & b) >= threshold * len(a | b) - 1e-9 and bool(a | b))
    n = len(docs)
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if near(sets[i], sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = sorted((top(i), top(j)))
                root[b] = a
    key = lambda i: (docs[i][0] is not None, docs[i][0] or 0)
    groups = defaultdict(list)
    for i in range(n):
        groups[top(i)].append(i)
    first = {i: docs[min(g, key=key)][0] for g in groups.values() for i in g}
    return sorted(((docs[i][0], first[i], links[i]) for i in range(n)), key=str)


@pytest.fixture(scope="module")
def near_docs():
    docs = [(0, None), (1, ""), (2, "one two three"), (3, "One  two three"), (4, "one two four")]
    for _ in range(60):
        base = say(RNG.randint(5, 200))
        for _ in range(RNG.choice([1, 1, 2, 3])):
            docs.append((len(docs), " ".join(edited(base, RNG.choice([0, 0, 1, 2, 4, 8])))))
    shared = say(60)
    docs += [(len(docs) + i, " ".join(say(40) + shared + say(30))) for i in range(40)]
    chain = say(120)
    for i in range(25):
        chain = edited(chain, 2)
        docs.append((1000 + i, " ".join(chain)))
    hot = say(150)
    docs += [(2000 + i, " ".join(hot)) for i in range(150)]
    docs += [(3000 + i, " ".join(edited(hot, 1))) for i in range(90)]
    docs += [(None, "no key at all but a text of some words"), (7, docs[7][1])]
    return docs


def test_jaccard_join_against_brute_force(spark, near_docs):
    df = spark.createDataFrame(near_docs, "doc_id long, text string").select("*", F.lit(0).alias("k"), F.lit("x").alias("TEXT")).repartition(5)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_join(df).collect()), key=str)
    want = brute(near_docs)
    found = sum(g[2] for g in got) / sum(w[2] for w in want)
    assert 0.99 <= found <= 1.0
    assert sum(g[1] != w[1] for g, w in zip(got, want, strict=True)) <= 2  # recall is a probability
    assert len(got) == len(near_docs)


def test_blocks_of_a_large_group(spark, near_docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    docs = [d for d in near_docs if d[0] is not None and d[0] >= 2000]
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str)
    assert got == brute(docs)


def test_pairs_inside_a_group_of_variants(spark):
    """Many variants of one text, no two of them near, and a near copy of every third one."""
    rng = random.Random(17)
    base = [f"b{i}" for i in range(300)]
    docs, planted = [], 0
    for v in range(1200):
        words = list(base)
        for at in range(0, 300, 25):
            words[at + rng.randrange(5, 20)] = f"v{v}-{at}"
        docs.append((2 * v, " ".join(words)))
        if v % 3 == 0:
            for at in rng.sample(range(0, 300, 25), 6):
                words[at + 2] = f"c{v}-{at}"
            docs.append((2 * v + 1, " ".join(words)))
            planted += 1
    sets = [set(zip(*[t.split()[i:] for i in range(5)], strict=False)) for _, t in docs[:60]]
    alike = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]]
    assert sum(x >= 0.8 for x in alike) == sum(k % 2 for k, _ in docs[:60]) and all(x < 0.7 or 0.8 < x < 0.83 for x in alike)
    got = jaccard_join.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    found = [r.doc_id for r in got if r.doc_id % 2 and r.class_id == r.doc_id - 1 and r.n_links == 1]
    assert len(found) >= 0.99 * planted
    assert sum(r.n_links for r in got) == 2 * len(found)


def test_runs_count_what_pairs_have_in_common():
    np = pytest.importorskip("numpy")
    rng, pairs = np.random.default_rng(1), 2000
    tokens = np.arange(pairs * jaccard_join.COORDINATES).reshape(pairs, -1) % 50_000
    other = np.where(rng.random(tokens.shape) < jaccard_join.THRESHOLD, tokens, tokens + 1).astype(np.uint16)
    runs = jaccard_join.runs_needed()
    a, b = (set(zip(*(x.tolist() for x in jaccard_join.last_buckets(t, runs)), strict=True)) for t in (tokens.astype(np.uint16), other))
    assert len({row for row, _ in a & b}) / pairs >= 0.985


@pytest.mark.parametrize("threshold", [0.5, 0.9])
def test_other_thresholds(spark, threshold):
    rng = random.Random(5)
    docs = []
    for i in range(60):
        words = [f"v{rng.randrange(4000)}" for _ in range(120)]
        docs.append((2 * i, " ".join(words)))
        for at in rng.sample(range(0, 120, 12), 6 if threshold < 0.8 else 1):
            words[at] = "other"
        docs.append((2 * i + 1, " ".join(words)))
    docs += [(500, "a b c d e f"), (501, "a b c d e f g")]  # two of three shingles in common
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"), threshold=threshold).collect()), key=str)
    want = brute(docs, threshold)
    assert sum(w[2] for w in want) >= 100
    assert sum(g != w for g, w in zip(got, want, strict=True)) <= 2


def test_large_buckets_are_split(spark, near_docs, monkeypatch):
    again, split = [], jaccard_join._split_again
    monkeypatch.setattr(jaccard_join, "_split_again", lambda *a: again.append(1) or split(*a))
    rows = jaccard_join.with_place(spark.createDataFrame(near_docs, "doc_id long, text string"), "doc_id", "text").selectExpr("k", "h", "coalesce(text, '') t")
    paths = jaccard_join.Paths(depth=1)
    documents = jaccard_join._embedded(rows, paths).where("tokens is not null").groupBy("c1", "c2").agg(F.first("tokens").alias("tokens"))
    classes = jaccard_join.written(documents.withColumn("c", F.monotonically_increasing_id()), "test-classes")
    ties = {r.node: r.root for r in components(jaccard_join._ties(classes, paths, split=8)).collect()}
    whole = {r.node: r.root for r in components(jaccard_join._ties(classes, paths, split=10_000)).collect()}
    assert len(again) >= 1
    assert sum(ties.get(n) is None for n in whole) <= 0.01 * len(whole)
    assert set(ties) <= set(whole)


def test_keys_that_are_text(spark):
    words = " ".join(say(30))
    docs = [("b", words), ("a", words), (None, "other text altogether of some words"), ("c", None)]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(df).collect()}
    assert got == {"a": ("a", 1), "b": ("a", 1), None: (None, 0), "c": ("c", 0)}
    assert jaccard_join.jaccard_join(df.limit(0)).collect() == []
    assert {r.doc_id for r in line_dedup.dedup_lines(df, min_words=5).collect()} == {"a", "b", "c", None}


def test_one_of_each_keeps_one_row_of_repeats(spark):
    words = " ".join(say(30))
    rows = [(1, words, "s2"), (1, words, "s1"), (1, words, "s1"), (2, words, "s0"), (None, None, None), (None, None, None)]
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, words, "s1"), (None, None, None)], key=str)


def test_one_of_each(spark, near_docs):
    df = spark.createDataFrame(near_docs, "doc_id long, text string").withColumn("h", F.lit(1))
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    want = {c for _, c, _ in brute(near_docs)}
    assert len(ids) == len(set(ids)) and len(set(ids) ^ want) <= 2
    assert jaccard_join.one_of_each(df.limit(0)).count() == 0


def test_runs_reach_the_target():
    assert jaccard_join.runs_needed(0.5) < jaccard_join.runs_needed(0.9) < jaccard_join.runs_needed(0.999)


def test_shingles_of_long_and_short_texts():
    s = jaccard_join.Shingler()
    assert len(s.shingles(None)) == len(s.shingles(" \n")) == 0 and len(s.shingles("a b")) == 1
    assert (s.shingles("a b c d e") == s.shingles("A  b\nc d E")).all() and len(s.shingles("a b c d e f")) == 2
    assert len(s.shingles("x " * 50_000)) == 1


# ----------------------------------------------------------------- lines


def test_line_dedup_against_brute_force(spark):
    passages = [[" ".join(say(RNG.randint(3, 9))) for _ in range(RNG.randint(2, 6))] for _ in range(6)]
    common = " ".join(say(6))
    docs = [(None, "\n".join(passages[0] + passages[0])), (0, None), (1, ""), (2, "\n\n")]
    for k in range(3, 120):
        lines = []
        for _ in range(RNG.randint(1, 4)):
            lines += [" ".join(say(RNG.randint(1, 9))) for _ in range(RNG.randint(0, 3))]
            if RNG.random() < 0.5:
                lines += [f"  {x} " if RNG.random() < 0.3 else x for x in RNG.choice(passages)]
            if RNG.random() < 0.5:
                lines += [common] * RNG.randint(1, 5)
            lines += [""] * RNG.randint(0, 2)
        docs.append((k, "\n".join(lines)))
    long = (200, "\n".join(" ".join(say(8)) for _ in range(3000)))  # nothing in it repeats
    docs += [(201, docs[60][1])]
    df = spark.createDataFrame([*docs, long], "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("h", F.lit(1)).repartition(4)
    for least in (10, 25):
        got = {r.doc_id: (r.text, r.removed_lines) for r in line_dedup.dedup_lines(df, min_words=least).collect()}
        assert got.pop(200) == (long[1], 0)
        assert got == repeated_runs(docs, least)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_leaves_repeated_rows_alike(spark):
    text = "\n".join(" ".join(say(9)) for _ in range(9))
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string"), min_words=20).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, text), (1, text), (2, "")]


def repeated_runs(docs, least):
    """What stays, by looking at every run of lines of any length; keys ascend, null first."""
    first, out = {}, {}
    for k, text in docs:
        raw = (text or "").split("\n")
        lines = [(i, x.strip()) for i, x in enumerate(raw) if x.strip()]
        drop = set()
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = tuple(x for _, x in lines[a : b + 1])
                if sum(len(x.split()) for x in run) >= least:
                    j, _, end = first.setdefault(run, (k, lines[a][0], lines[b][0]))
                    drop |= {i for i in range(lines[a][0], lines[b][0] + 1) if j != k or i > end}
        out[k] = (None if text is None else "\n".join(x for i, x in enumerate(raw) if i not in drop), len(drop))
    return out


@pytest.mark.parametrize("key", [None, 5])
def test_line_dedup_tells_documents_of_one_key_apart(spark, key):
    run = "\n".join(" ".join(say(9)) for _ in range(7))
    texts = [f"{run}\nfirst", f"{run}\nsecond", f"{run}\nthird"]
    got = sorted(r.removed_lines for r in line_dedup.dedup_lines(spark.createDataFrame([(key, t) for t in texts], "doc_id long, text string")).collect())
    assert got == [0, 7, 7]


def test_line_dedup_extends_to_the_whole_run(spark):
    line = lambda n: " ".join(say(n))
    docs = []
    for shared in ([line(30), line(30), line(15)], [line(60), line(10)], [line(15), line(30), line(30)], [line(70), line(20), line(20), line(5)]):
        docs += [(len(docs) + i, "\n".join([line(4), *shared, line(6)])) for i in range(2)]
    passages = [[line(RNG.randint(1, 30)) for _ in range(RNG.randint(2, 8))] for _ in range(8)]
    for k in range(8, 60):
        lines = [line(5)]
        for _ in range(RNG.randint(1, 3)):
            p = RNG.choice(passages)
            lines += p[RNG.randint(0, 2) : len(p) - RNG.randint(0, 2)] + [""] * RNG.randint(0, 1) + [line(RNG.randint(1, 40))]
        docs.append((k, "\n".join(lines)))
    got = {r.doc_id: (r.text, r.removed_lines) for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert [got[k][1] for k in range(8)] == [0, 3, 0, 2, 0, 3, 0, 4]
    assert got == repeated_runs(docs, 50)


def test_line_dedup_keeps_the_first_occurrence(spark):
    line, other = " ".join(say(10)), " ".join(say(10))
    docs = [(0, "\n".join([line] * 7)), (1, "\n".join([other, line] * 6)), (2, "\n".join([line] * 5 + ["end"]))]
    passages = [[" ".join(say(RNG.randint(1, 25))) for _ in range(RNG.randint(1, 5))] for _ in range(4)]
    for k in range(3, 60):
        lines = []
        for _ in range(RNG.randint(1, 5)):
            lines += RNG.choice(passages) * RNG.randint(1, 3) + [" ".join(say(4))] * RNG.randint(0, 1) + [""] * RNG.randint(0, 1)
        docs.append((k, "\n".join(lines)))
    got = {r.doc_id: (r.text, r.removed_lines) for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got[0] == ("\n".join([line] * 5), 2) and got[2] == ("end", 5)
    assert got == repeated_runs(docs, 50)


# --------------------------------------------------------- decontamination


def plain_distance(pattern, text):
    """Least edits of the pattern to any substring of the text."""
    column = list(range(len(pattern) + 1))
    best = column[-1]
    for w in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(column[i] + (p != w), new[i] + 1, column[i + 1] + 1))
        column = new
        best = min(best, column[-1])
    return best


def test_myers_against_the_plain_table():
    for _ in range(2000):
        p, t = [RNG.choice("abc") for _ in range(RNG.randint(1, 12))], [RNG.choice("abc") for _ in range(RNG.randint(0, 25))]
        assert decontaminate.Myers(p).best(t)[0] == plain_distance(p, t)
    long = say(300)
    assert decontaminate.Myers(long).best(say(20) + edited(long, 3) + say(20))[0] <= 3


@pytest.mark.parametrize("block", [10**9, 300])
def test_decontamination_against_brute_force(spark, monkeypatch, block):
    items = [(i, " ".join(say(RNG.randint(3, 40)))) for i in range(25)] + [(90, None), (91, ""), (92, "?!")]
    items += [(93, items[3][1])]
    docs = [(None, items[0][1]), (0, None), (1, "")]
    for k in range(2, 150):
        said = say(RNG.randint(0, 60))
        if k % 3:
            at = RNG.randint(0, len(said))
            said[at:at] = edited(RNG.choice(items[:25])[1].split(), RNG.choice([0, 0, 1, 3, 6, 9]))
        docs.append((k, ", ".join(w.upper() if RNG.random() < 0.2 else w for w in said)))
    docs.append((500, " ".join(say(20_000)) + " " + items[5][1]))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("contaminated", F.lit(0)).withColumn("text2", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    in_blocks = decontaminate.benchmark_blocks
    assert (len(list(in_blocks(bench, chars=block))) > 1) == (block == 300)
    monkeypatch.setattr(decontaminate, "benchmark_blocks", lambda b: in_blocks(b, chars=block))
    got = {r.doc_id: (r["items"], r.edits) for r in decontaminate.find_items(df, bench).collect()}
    for k, text in docs:
        said, want = decontaminate.words(text), []
        for i, t in items:
            item = decontaminate.words(t)
            if item and (d := plain_distance(item, said)) <= decontaminate.budget(len(item)):
                want.append((i, d))
        assert list(zip(*got[k], strict=True)) == sorted(want), k
    assert decontaminate.find_items(df.limit(0), bench).count() == 0
    nothing = decontaminate.find_items(df, bench.limit(0)).collect()
    assert len(nothing) == len(docs) and not any(r.contaminated or r["items"] for r in nothing)


def test_decontamination_says_where_items_stand(spark):
    item = "a b c d e f g h i j k l".split()
    docs = [(1, "x y z " + " ".join(item) + " w"), (2, "x y z " + " ".join(item[1:]) + " w"), (3, "x y z " + " ".join([*item[:5], "new", *item[5:]]) + " w"), (4, "x y z " + " ".join([*item[:3], "q", *item[4:]]) + " " + " ".join(item))]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("kept"))
    got = {r.doc_id: (r["items"], r.items_found, r.edits, r.first_word, r.end_word) for r in decontaminate.find_items(df, bench, keep=("doc_id", "items")).collect()}
    assert got == {1: ("kept", [7], [0], [3], [15]), 2: ("kept", [7], [1], [3], [14]), 3: ("kept", [7], [1], [3], [16]), 4: ("kept", [7], [0], [15], [27])}


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    data = tmp_path / "sf"
    words = {"aa": ["the", "cat", "house", "and", "with", "green", "river", "walks"], "bb": ["der", "katze", "haus", "und", "mit", "baum", "fluss", "geht"]}
    talk = lambda lang, n: " ".join(RNG.choice(words[lang]) + str(RNG.randint(0, 9)) * 0 + RNG.choice(words[lang]) for _ in range(n))
    rows = [(i, talk(lang, 80), lang, f"s{i % 3}", 1) for i, lang in enumerate(["aa", "bb"] * 60)]
    item = talk("aa", 20)
    copies = [(500 + i, rows[i][1], rows[i][2], "s0", 1) for i in range(10)]
    near = [(600 + i, rows[i][1] + " end", rows[i][2], "s1", 1) for i in range(10, 15)]
    leaks = [(700 + i, talk("aa", 30) + " " + item, "aa", "s2", 1) for i in range(4)]
    junk = [(800, "12 34", "aa", "s0", 1), (801, None, None, None, None), (802, "", "aa", "s1", 1)]
    spark.createDataFrame(rows + copies + near + leaks + junk, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(data / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(data / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(data / "documents.parquet")), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(data)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], i
        kept[name] = [r.doc_id for r in docs.collect()]
    clean = {r[0] for r in rows}
    assert set(kept["language"]) == clean | {r[0] for r in copies + near + leaks}
    assert set(kept["near_copies"]) == clean | {r[0] for r in leaks} and len(kept["near_copies"]) == len(clean) + len(leaks)
    assert set(kept["decontamination"]) == clean
    assert set(kept["mixing"]) <= clean and len(kept["mixing"]) > len(clean)
    found = corpus_pipeline.run(spark, str(data)).collect()
    assert sorted(r.doc_id for r in found) == sorted(kept["mixing"])
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(data)).count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "decontamination", "mixing", "token_files"]
