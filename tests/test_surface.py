import os
import shutil
import subprocess
import sys

import pandas as pd
import pytest

from strandline import ordered, sources

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_sources_round_trip(spark, tmp_path):
    frame = sources.from_pandas(spark, pd.DataFrame({"a": [1.0, 2.0, 3.0], "b": [4.0, None, 6.0]}))
    sources.write(frame.df, str(tmp_path / "t"))
    back = sources.read(spark, str(tmp_path / "t"), "index")
    assert back.columns == ("a", "b")
    long = sources.to_long(back)
    sums = sources.long_frame(long, "index").cumsum()
    wide = sources.to_wide(sums, ["index"], ["a", "b"]).orderBy("index").collect()
    assert [(r.a, r.b) for r in wide] == [(1, 4), (3, None), (6, 10)]


def test_streaming_statistics(spark, tmp_path):
    from strandline.streaming import running_statistics

    rows = [("u", f"2024-01-01 00:00:{i:02d}", float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, t string, v double").selectExpr("k", "cast(t as timestamp) t", "v")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = running_statistics(stream, "k", "t", "v", span=3).writeStream.format("memory").queryName("running").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = spark.table("running").orderBy("t").toPandas()
    want = pd.Series([0.0, 1, 2, 3, 4])
    assert got["cumsum"].tolist() == want.cumsum().tolist()
    assert got["ewm_mean"].tolist() == pytest.approx(want.ewm(span=3).mean().tolist())


def test_everything_works_without_the_removable_parts(tmp_path):
    """A copy of the repository without the two folders and the pipeline imports and has the other queries."""
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=lambda folder, names: [n for n in names if n in (".git", "llm", "__pycache__", "corpus_pipeline.py")])
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 200 and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q); assert e.llm is None"
    subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": ""}, check=True, timeout=120)


def test_broken_parts_do_not_vanish(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    if not (copy / "strandline" / "llm").is_dir():
        pytest.skip("the removable parts are not here")
    (copy / "strandline" / "llm" / "media.py").write_text("import no_such_module\n")
    found = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=copy, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert found.returncode and "no_such_module" in found.stderr


def test_clusters_need_a_shared_folder():
    from types import SimpleNamespace as Of

    from strandline.plans import tables

    session = lambda master: Of(conf=Of(get=lambda *_: None), sparkContext=Of(master=master, getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_dir(session("spark://host:7077"))


def test_tables_are_discarded(spark):
    from strandline.plans import tables

    made = tables.written(spark.range(5), "test")
    where = made._strandline_path.removeprefix("file:")
    assert os.path.isdir(where) and made.count() == 5
    tables.discard(made)
    assert not os.path.exists(where)


def test_catalogue_matches_sql(spark):
    """A few queries of each family against their SQL; the driver compares all of them."""
    import duckdb

    from strandline.plans import catalogue

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("standard tables are not here")
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "part", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name in ("rolling_mean", "expanding_var", "ewm_mean", "cumsum", "pct_change_pad", "rank_average", "rank_unpartitioned", "reduce_sum", "agg_list", "corr_matrix", "row_rank", "dropna_thresh", "global_rolling_mean", "transform_log"):
        got = catalogue.queries()[name](spark, data).toPandas()
        want = con.sql(catalogue.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want), name
        columns = sorted(got.columns)
        got, want = (d[columns].sort_values(columns).reset_index(drop=True) for d in (got, want))
        pd.testing.assert_frame_equal(got, want, check_dtype=False, obj=name)


@pytest.mark.parametrize("kind", ["cov", "corr"])
def test_rolling_pairs_cover_every_supplier(spark, tmp_path, kind):
    """Pandas over a small lineitem, and the SQL."""
    import duckdb
    import numpy as np

    from strandline.plans import catalogue

    rng, n, values = np.random.default_rng(5), 150, ["l_quantity", "l_discount", "l_tax"]
    items = pd.DataFrame({"l_suppkey": rng.integers(1, 12, n), "l_shipdate": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 40, n), "D"), "l_orderkey": np.arange(n), "l_linenumber": 1, "l_partkey": 2, "l_extendedprice": 3.0})
    items[values] = rng.random((n, 3))
    spark.createDataFrame(items).write.parquet(str(tmp_path / "lineitem.parquet"))
    name = f"rolling_{kind}_pairwise"
    got = catalogue.queries()[name](spark, str(tmp_path)).toPandas()
    assert len(got) == n * 9 and set(got.l_suppkey) == set(items.l_suppkey)
    cells = got.set_index(["l_orderkey", "col_i", "col_j"])["value"].sort_index()
    for _, d in items.sort_values(catalogue.LINE_KEY).groupby("l_suppkey"):
        want = getattr(d.set_index("l_orderkey")[values].rolling(8, min_periods=3), kind)(pairwise=True).stack(future_stack=True)
        np.testing.assert_allclose(cells.loc[list(want.index)], want, rtol=0, atol=2e-6)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(catalogue.oracle_sql()[name]).df().set_index(["l_orderkey", "col_i", "col_j"])["value"].sort_index()
    assert len(want) == n * 9
    np.testing.assert_allclose(cells.loc[list(want.index)], want, rtol=0, atol=2e-6)


def test_ordered_rejects_unknown_columns(spark):
    with pytest.raises(ValueError):
        ordered(spark.range(3).toDF("i"), "i", None, "nothing")
