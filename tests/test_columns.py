import warnings

import numpy as np
import pytest
from edge_rows import COLUMNS, by_group, edge_frame, same

from strandline import ordered
from strandline.plans import scale

PDF = edge_frame()
warnings.simplefilter("ignore", FutureWarning)


@pytest.fixture(scope="module")
def frame(spark):
    return ordered(spark.createDataFrame(PDF), "i", "g", COLUMNS)


@pytest.fixture(scope="module")
def whole(spark):
    return ordered(spark.createDataFrame(PDF), "i", None, COLUMNS)


@pytest.mark.parametrize("name", ["cumsum", "cumprod", "cummin", "cummax"])
@pytest.mark.parametrize("skipna", [True, False])
def test_cumulative(frame, name, skipna):
    same(getattr(frame, name)(skipna), by_group(PDF, lambda d: getattr(d, name)(skipna=skipna)), rtol=1e-8)


@pytest.mark.parametrize("periods", [1, -2, 200])
def test_diff_and_shift(frame, periods):
    same(frame.diff(periods), by_group(PDF, lambda d: d.diff(periods)))
    same(frame.shift(periods, 9.0), by_group(PDF, lambda d: d.shift(periods, fill_value=9.0)))


@pytest.mark.parametrize("fill", ["pad", "bfill", None])
def test_pct_change(frame, fill):
    same(frame.pct_change(2, fill), by_group(PDF, lambda d: d.pct_change(2, fill_method=fill)))


def test_pct_change_of_zeros_and_infinities(spark):
    values = [0, 0, 1, np.nan, np.inf, 2, np.inf, np.inf, -np.inf, 5, -1, 0]
    df = spark.createDataFrame([(i, None if v != v else float(v)) for i, v in enumerate(values)], "i int, x double")
    got = [r.x for r in ordered(df, "i", None, "x").pct_change(1, None).orderBy("i").collect()]
    inf = float("inf")
    assert got == [None, None, inf, None, None, -1, inf, None, None, -1, -1.2, -1]


@pytest.mark.parametrize("method", ["average", "min", "max", "first", "dense"])
@pytest.mark.parametrize("na_option", ["keep", "top", "bottom"])
def test_rank(frame, method, na_option):
    for ascending, pct in ((True, False), (False, True)):
        same(frame.rank(method, na_option, ascending, pct), by_group(PDF, lambda d: d.rank(method=method, na_option=na_option, ascending=ascending, pct=pct)))


@pytest.mark.parametrize("method", ["average", "min", "max", "dense"])
def test_rank_without_partitions(whole, method):
    for na_option, pct in (("keep", True), ("top", False), ("bottom", True)):
        same(whole.rank(method, na_option, method != "min", pct), PDF.assign(**PDF[COLUMNS].rank(method=method, na_option=na_option, ascending=method != "min", pct=pct)))


@pytest.mark.parametrize("name", ["cumsum", "cumprod", "cummin", "cummax"])
def test_running_over_ranges(whole, name):
    same(scale.running(whole, name, 7), PDF.assign(**getattr(PDF[COLUMNS], name)()), rtol=1e-7)


@pytest.mark.parametrize("window", [1, 5, 80])
def test_rolling_over_ranges(whole, window):
    same(scale.rolling(whole, window, "mean", 1, 7), PDF.assign(**PDF[COLUMNS].rolling(window, min_periods=1).mean()))


def test_fill(frame):
    same(frame.fillna(method="ffill", limit=2), by_group(PDF, lambda d: d.ffill(limit=2)))
    same(frame.bfill(), by_group(PDF, lambda d: d.bfill()))
    same(frame.fillna(7, limit=3), by_group(PDF, lambda d: d.fillna(7, limit=3)))
    same(frame.fillna({"x": 1.5}), by_group(PDF, lambda d: d.fillna({"x": 1.5})))


def test_isna_and_dropna(frame):
    got = frame.isna().toPandas().sort_values("i")
    assert (got[COLUMNS].to_numpy() == PDF[COLUMNS].isna().to_numpy()).all()
    for options in ({"how": "any"}, {"how": "all"}, {"thresh": 2}):
        assert frame.select("x", "y").dropna(**options).count() == len(PDF[["x", "y"]].dropna(**options))
    assert "z" not in frame.dropna(axis=1, how="all").columns
    assert frame.dropna(axis=1).columns == ["g", "i"]


REDUCTIONS = "sum mean std var min max median prod skew kurt sem all any".split()


@pytest.mark.parametrize("name", REDUCTIONS)
@pytest.mark.parametrize("skipna", [True, False])
def test_reductions(spark, name, skipna):
    pdf = PDF.replace(np.inf, np.nan)[COLUMNS].assign(full=np.arange(len(PDF)) / 7 - 3, same=4.0)
    frame = ordered(spark.createDataFrame(pdf), None, None, list(pdf.columns))
    got = getattr(frame, name)(skipna).toPandas().iloc[0].astype(float)
    np.testing.assert_allclose(got, getattr(pdf, name)(skipna=skipna).astype(float), rtol=1e-8, atol=1e-9, equal_nan=True)


def test_reductions_of_nothing(spark):
    empty = ordered(spark.createDataFrame(PDF).limit(0), None, None, COLUMNS)
    assert empty.sum().first().x == 0 and empty.prod().first().x == 1 and empty.mean().first().x is None
    assert empty.all().first().x is True and empty.any().first().x is False


def test_quantiles_and_agg(spark):
    pdf = PDF.replace(np.inf, np.nan)[["x", "y"]]
    frame = ordered(spark.createDataFrame(pdf), None, None, ["x", "y"])
    np.testing.assert_allclose(frame.quantile([0.1, 0.5]).toPandas()[["x", "y"]], pdf.quantile([0.1, 0.5]))
    got = frame.agg(["sum", "median", "std"]).toPandas().set_index("function")
    np.testing.assert_allclose(got.loc[["sum", "median", "std"]], pdf.agg(["sum", "median", "std"]))
    assert frame.agg({"x": "max"}).columns == ["x"]
    lists = frame.agg({"x": ["max", "sum"], "y": "mean"}).toPandas().set_index("function")
    assert np.isnan(lists.loc["max", "y"]) and lists.loc["mean", "y"] == pytest.approx(pdf.y.mean())
    for bad in ("nothing", {"q": "sum"}, ["sum", "nothing"]):
        with pytest.raises(ValueError):
            frame.agg(bad)


def test_matrices(spark):
    pdf = PDF.replace(np.inf, np.nan).assign(c=1.0)[["x", "y", "c", "z"]]
    frame = ordered(spark.createDataFrame(pdf), None, None, list(pdf.columns))
    for kind in ("corr", "cov"):
        got = getattr(frame, kind)().toPandas().pivot(index="col_i", columns="col_j", values="value").loc[pdf.columns, pdf.columns]
        np.testing.assert_allclose(got.astype(float), getattr(pdf, kind)(), rtol=1e-8, atol=1e-12, equal_nan=True)
    gated = frame.corr(min_periods=1000).toPandas().value
    assert gated.isna().all()


def test_spearman(spark):
    pdf = PDF.replace(np.inf, np.nan)[["x", "y"]].dropna().reset_index(drop=True)
    got = ordered(spark.createDataFrame(pdf), None, None, ["x", "y"]).corr("spearman").toPandas()
    assert got[(got.col_i == "x") & (got.col_j == "y")].value.iloc[0] == pytest.approx(pdf.corr("spearman").iloc[0, 1])


@pytest.mark.parametrize("name", ["abs", "sqrt", "exp", "log", "log10", "log2", "sin", "cos", "tan", "ceil", "floor"])
def test_elementwise(spark, name):
    values = [-1.5, 0.0, 2.5, None, 1e300, float("inf")]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    got = [r.x for r in ordered(df, "i", None, "x").transform(name).orderBy("i").collect()]
    with np.errstate(all="ignore"):
        want = getattr(np, name)(np.array([np.nan if v is None else v for v in values]))
    np.testing.assert_allclose(np.array([np.nan if v is None else v for v in got]), want, rtol=1e-12)


def test_apply(spark):
    pdf = PDF.replace(np.inf, np.nan)[["x", "y"]]
    frame = ordered(spark.createDataFrame(pdf), None, None, ["x", "y"])
    assert frame.apply(np.nanmax).first().x == pytest.approx(pdf.x.max())
    got = frame.apply(np.nansum, axis=1).toPandas().result.sort_values().to_numpy()
    np.testing.assert_allclose(got, np.sort(pdf.sum(axis=1)), atol=1e-12)


def test_strings_shift_and_fill(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "i int, s string")
    frame = ordered(df, "i", None, "s")
    assert [r.s for r in frame.shift().orderBy("i").collect()] == [None, "a", None]
    assert [r.s for r in frame.ffill().orderBy("i").collect()] == ["a", "a", "c"]
