"""Frames without partitions against pandas: the same operators, over ranges of the order."""

import numpy as np
import pandas as pd
import pytest
from edge_rows import COLUMNS, edge_frame, same
from pyspark.sql import functions as F

from strandline import ordered
from strandline.operators.ewm import Ewm

PDF = edge_frame()
STATS = "sum mean std var min max count skew kurt sem".split()


@pytest.fixture(scope="module")
def whole(spark):
    return ordered(spark.createDataFrame(PDF.sample(frac=1, random_state=2)).repartition(5), "i", None, COLUMNS)


def assigned(make):
    return PDF.assign(**make(PDF[COLUMNS]))


@pytest.mark.parametrize("name", STATS)
def test_expanding(whole, name):
    same(getattr(whole.expanding(3), name)(), assigned(lambda d: getattr(d.expanding(3), name)()), rtol=1e-8)


def test_expanding_several_at_once(whole):
    got = whole.expanding(2).agg(["mean", "max"]).toPandas().sort_values("i")
    for c in ("x", "y"):
        np.testing.assert_allclose(got[f"{c}_mean"], PDF[c].expanding(2).mean(), equal_nan=True)
        np.testing.assert_allclose(got[f"{c}_max"], PDF[c].expanding(2).max(), equal_nan=True)


@pytest.mark.parametrize("name", ["sum", "std", "median", "count"])
@pytest.mark.parametrize("options", [{"center": True}, {"closed": "both"}, {"closed": "left"}])
def test_rolling(whole, name, options):
    same(getattr(whole.rolling(6, 4, **options), name)(), assigned(lambda d: getattr(d.rolling(6, min_periods=4, **options), name)()))


def test_rolling_long_windows_and_steps(whole):
    same(whole.rolling(500, 1).mean(), assigned(lambda d: d.rolling(500, min_periods=1).mean()))
    same(whole.rolling(5, 1, step=7).sum(), assigned(lambda d: d.rolling(5, min_periods=1).sum()).iloc[::7])


@pytest.mark.parametrize("name", ["cumsum", "cumprod", "cummin", "cummax"])
@pytest.mark.parametrize("skipna", [True, False])
def test_cumulative(whole, name, skipna):
    same(getattr(whole, name)(skipna), assigned(lambda d: getattr(d, name)(skipna=skipna)), rtol=1e-7)


@pytest.mark.parametrize("periods", [1, 3, -2, 100])
def test_transforms(whole, periods):
    same(whole.diff(periods), assigned(lambda d: d.diff(periods)))
    same(whole.shift(periods, -1.0), assigned(lambda d: d.shift(periods, fill_value=-1.0)))


@pytest.mark.filterwarnings("ignore:The 'fill_method'")
@pytest.mark.parametrize("fill,limit", [(None, None), ("pad", None), ("bfill", None), ("pad", 2)])
def test_pct_change(whole, fill, limit):
    same(whole.pct_change(2, fill, limit), assigned(lambda d: d.pct_change(2, fill_method=fill, limit=limit)))


def test_fills(whole):
    same(whole.ffill(), assigned(lambda d: d.ffill()))
    same(whole.bfill(), assigned(lambda d: d.bfill()))
    same(whole.ffill(2), assigned(lambda d: d.ffill(limit=2)))
    same(whole.fillna(method="bfill", limit=1), assigned(lambda d: d.bfill(limit=1)))
    same(whole.fillna(7, limit=20), assigned(lambda d: d.fillna(7, limit=20)))


def test_fill_of_text(spark):
    rows = [(i, None if i % 3 else f"t{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "i long, t string").repartition(4)
    got = [r.t for r in ordered(df, "i", None, "t").ffill().orderBy("i").collect()]
    assert got == [f"t{i - i % 3}" for i in range(50)]


@pytest.mark.parametrize("adjust", [True, False])
@pytest.mark.parametrize("ignore_na", [True, False])
@pytest.mark.parametrize("name", ["mean", "std"])
def test_ewm(whole, name, adjust, ignore_na):
    same(getattr(whole.ewm(span=5, adjust=adjust, ignore_na=ignore_na, min_periods=3), name)(), assigned(lambda d: getattr(d.ewm(span=5, adjust=adjust, ignore_na=ignore_na, min_periods=3), name)()), rtol=1e-7)


@pytest.mark.parametrize("how", [{"alpha": 1.0}, {"com": 200}, {"alpha": 0.999}])
@pytest.mark.parametrize("adjust", [True, False])
def test_ewm_decay(whole, how, adjust):
    same(whole.ewm(**how, adjust=adjust).mean(), assigned(lambda d: d.ewm(**how, adjust=adjust).mean()))
    same(whole.ewm(**how, adjust=adjust).var(bias=True), assigned(lambda d: d.ewm(**how, adjust=adjust).var(bias=True)), rtol=1e-7)


def test_ewm_of_many_blocks(spark):
    """Ages far beyond one block of exponents, with and without partitions."""
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": 1, "i": np.arange(6000), "x": np.where(rng.random(6000) < 0.3, np.nan, rng.normal(size=6000) + 50)})
    df = spark.createDataFrame(pdf)
    for adjust in (True, False):
        want = pdf.assign(x=pdf.x.ewm(alpha=0.7, adjust=adjust).std())
        for parts in ("g", None):
            same(ordered(df, "i", parts, "x").ewm(alpha=0.7, adjust=adjust).std(), want, ["x"], 1e-6)


def test_rolling_pairs_without_partitions(spark):
    pdf = PDF.replace(np.inf, np.nan)
    frame = ordered(spark.createDataFrame(pdf), "i", None, ["x", "y"])
    got = frame.rolling(6, 3).cov().toPandas().set_index(["i", "col_i", "col_j"]).value
    want = pdf.set_index("i")[["x", "y"]].rolling(6, min_periods=3).cov().stack(future_stack=True)
    for key, value in want.items():
        assert (value != value and (got[key] is None or got[key] != got[key])) or abs(got[key] - value) < 1e-8


def test_rank_first(whole):
    same(whole.rank("first"), assigned(lambda d: d.rank(method="first")))
    same(whole.rank("first", "bottom", False, True), assigned(lambda d: d.rank(method="first", na_option="bottom", ascending=False, pct=True)))


def test_no_task_holds_all_rows(whole):
    for made in (whole.expanding().std(), whole.rolling(4).mean(), whole.cumsum(), whole.cummax(False), whole.diff(), whole.pct_change(), whole.bfill(), whole.ewm(span=4, adjust=False).var(), whole.rank("first")):
        assert "SinglePartition" not in made._jdf.queryExecution().executedPlan().toString()


def test_empty_and_one_row(spark):
    for n in (0, 1):
        frame = ordered(spark.createDataFrame(PDF).limit(n), "i", None, COLUMNS)
        for made in (frame.expanding().mean(), frame.rolling(3, 1).sum(), frame.cumsum(), frame.shift(), frame.pct_change(), frame.ffill(), frame.ewm(span=3).std(), frame.ewm(span=3, adjust=False).mean(), frame.rank("first")):
            assert made.count() == n


def test_ewm_stays_in_the_engine(spark):
    frame = ordered(spark.createDataFrame(PDF), "i", "g", ["x"])
    plan = Ewm(frame, None, 5, None, None, 0, False, False).mean()._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize("parts", [None, "g"])
def test_backward_fills_take_one_pass(spark, parts):
    """Frames that shrink start anew at each row: 3e5 rows in one range took minutes."""
    n = 300_000
    df = spark.range(n).select("id", F.lit(0).alias("g"), F.when(F.col("id") % 1000 == 999, F.col("id").cast("double")).alias("x"))
    frame = ordered(df, "id", parts, "x")
    plan = frame.bfill()._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan
    got = frame.bfill().agg(F.count("x"), F.sum((F.col("x") != F.col("id") - F.col("id") % 1000 + 999).cast("int"))).first()
    assert tuple(got) == (n, 0)
