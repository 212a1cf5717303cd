"""Registered queries over the standard tables: SQL, contracts and held-out accuracy."""

import array
import hashlib
import os
import zlib

import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandline.llm import registry

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="standard tables are not here")


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{DATA}/documents.parquet")


def test_every_operator_is_registered():
    assert [q.split("_")[0] for q in registry.queries()] == [f"op{i}" for i in range(1, 11)]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.sql(registry.oracle_sql()[name]).df()
    key = want.columns[0]
    got = registry.queries()[name](spark, DATA).toPandas().sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want.sort_values(key).reset_index(drop=True), check_exact=True)


def test_media_query(spark, documents):
    found = registry.queries()["op2_media"](spark, DATA).toPandas().set_index("doc_id")
    for r in documents.itertuples():
        raw = (r.text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        f = found.loc[r.doc_id]
        assert (f.n_bytes, f.payload_bytes, f.payload_sha256, f.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_token_queries(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in documents.itertuples()}
    counts = registry.queries()["op4_token_counts"](spark, DATA).toPandas().set_index("doc_id")
    assert all((counts.n_tokens[k], counts.over_limit[k]) == (len(v), len(v) > 1024) for k, v in ids.items())
    files = registry.queries()["op5_token_files"](spark, DATA).toPandas().set_index("doc_id").sort_index()
    start = 0
    for k in sorted(ids):
        want = array.array("I", [*ids[k], 2])
        assert (files.start[k], files.n_tokens[k], files.ids_crc32[k]) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)


def test_join_query(spark, documents):
    """Classes by exact shingle sets; pairs are only looked for where a shingle is shared."""
    sets = {r.doc_id: frozenset(zip(*[(r.text or "").lower().split()[i:] for i in range(5)], strict=False)) or frozenset([tuple((r.text or "").lower().split())]) for r in documents.itertuples()}
    sets = {k: s if s != {()} else frozenset() for k, s in sets.items()}
    holders, links = {}, set()
    for k, s in sets.items():
        for g in s or [None]:
            holders.setdefault(g, []).append(k)
    for ks in holders.values():
        for i, a in enumerate(ks if len(ks) < 200 else []):
            links |= {(a, b) for b in ks[:i] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    found = registry.queries()["op8_jaccard_join"](spark, DATA).toPandas().set_index("doc_id")
    want = {k: 0 for k in sets}
    for a, b in links:
        want[a] += 1
        want[b] += 1
    assert sum(found.n_links) >= 0.98 * sum(want.values()) and all(found.n_links[k] <= n for k, n in want.items())
    assert all(found.class_id[a] == found.class_id[b] for a, b in links if found.n_links[a] == want[a] and found.n_links[b] == want[b])


def test_line_query(spark, documents):
    """Every run of 50 words or more that stays is new, and what is gone came before."""
    found = registry.queries()["op9_line_dedup"](spark, DATA).toPandas().set_index("doc_id")
    seen: set = set()
    for r in documents.sort_values("doc_id").itertuples():
        lines = [x.strip() for x in (r.text or "").split("\n") if x.strip()]
        runs, repeated = [], set()
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += len(lines[b].split())
                if n >= 50:
                    run = hash(tuple(lines[a : b + 1]))
                    runs.append(run)
                    if run in seen:
                        repeated |= set(range(a, b + 1))
                    if b - a > 40:
                        break
        assert (found.removed_lines[r.doc_id] > 0) == bool(repeated) or len(set(lines)) < len(lines), r.doc_id
        seen |= set(runs)


def test_language_accuracy(spark, documents):
    found = registry.queries()["op3_language"](spark, DATA).toPandas().merge(documents, on="doc_id")
    assert len(found) == len(documents)
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]).all()
    held = found[found.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95
    assert found.score.between(0, 1).all() and found.rejected.mean() < 0.02


def test_toxicity_accuracy(spark, documents):
    labels = pd.read_parquet(f"{DATA}/labels.parquet")
    found = registry.queries()["op7_toxicity"](spark, DATA).toPandas()
    assert len(found) == len(documents) and found.score.between(0, 1).all()
    held = found[found.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.toxic).mean() > 0.9


def test_decontamination_finds_whole_items(spark, documents):
    bench = pd.read_parquet(f"{DATA}/benchmark.parquet")
    found = registry.queries()["op10_decontamination"](spark, DATA).toPandas().set_index("doc_id")["items"]
    for r in documents.itertuples():
        assert {i for i, t in zip(bench.item_id, bench.text, strict=True) if t in r.text} <= set(found[r.doc_id])
