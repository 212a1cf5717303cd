import warnings

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from strandline.operators import rowwise

warnings.simplefilter("ignore", FutureWarning)
_RNG = np.random.default_rng(5)
PDF = pd.DataFrame(np.round(_RNG.normal(size=(30, 6)) * 3, 1), columns=list("abcdef"))
PDF = (PDF + 0.0).mask(_RNG.random(PDF.shape) < 0.25)
PDF.iloc[0] = np.nan
PDF.iloc[1] = 2.0
PDF.iloc[2] = [1, np.nan, 3, 1, 1, 0]
PDF.iloc[3] = 0.0


@pytest.fixture(scope="module", params=["columns", "array"])
def made(spark, request):
    df = spark.createDataFrame(PDF.assign(i=range(len(PDF)))).withColumn("all", F.array(*"abcdef"))
    row = rowwise.row(list("abcdef")) if request.param == "columns" else rowwise.row_of("all")

    def run(value):
        got = [r.v for r in df.select("i", value(row).alias("v")).orderBy("i").collect()]
        return np.array([[np.nan if x is None else x for x in v] if isinstance(v, list) else np.nan if v is None else v for v in got], dtype=float)

    return run


@pytest.mark.parametrize("name", "sum mean std var min max median prod skew kurt sem all any".split())
@pytest.mark.parametrize("skipna", [True, False])
def test_reductions(made, name, skipna):
    np.testing.assert_allclose(made(lambda r: getattr(r, name)(skipna=skipna)), getattr(PDF, name)(axis=1, skipna=skipna).astype(float), rtol=1e-8, atol=1e-9)


def test_quantile(made):
    np.testing.assert_allclose(made(lambda r: r.quantile(0.3)), PDF.quantile(0.3, axis=1))


@pytest.mark.parametrize("name", ["cumsum", "cumprod", "cummin", "cummax"])
@pytest.mark.parametrize("skipna", [True, False])
def test_cumulative(made, name, skipna):
    np.testing.assert_allclose(made(lambda r: getattr(r, name)(skipna)), getattr(PDF, name)(axis=1, skipna=skipna), rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("periods", [1, 2, -1, 9])
def test_diff_and_shift(made, periods):
    np.testing.assert_allclose(made(lambda r: r.diff(periods)), PDF.diff(periods, axis=1))
    np.testing.assert_allclose(made(lambda r: r.shift(periods)), PDF.shift(periods, axis=1).astype(float))


@pytest.mark.parametrize("fill", ["pad", None])
def test_pct_change(made, fill):
    np.testing.assert_allclose(made(lambda r: r.pct_change(1, fill)), PDF.pct_change(axis=1, fill_method=fill), rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("method", ["average", "min", "max", "first", "dense"])
@pytest.mark.parametrize("na_option", ["keep", "top", "bottom"])
def test_rank(made, method, na_option):
    for ascending in (True, False):
        for pct in (False, True):
            np.testing.assert_allclose(made(lambda r: r.rank(method, na_option, ascending, pct)), PDF.rank(axis=1, method=method, na_option=na_option, ascending=ascending, pct=pct))


@pytest.mark.parametrize("name", "sum mean std var min max median count".split())
def test_rolling(made, name):
    want = getattr(PDF.T.rolling(3, min_periods=2), name)().T
    np.testing.assert_allclose(made(lambda r: r.rolling(3, name, 2)), want, rtol=1e-8, atol=1e-9)


@pytest.mark.parametrize("name", "std skew kurt sem".split())
def test_rolling_centered(made, name):
    want = getattr(PDF.T.rolling(5, min_periods=3, center=True), name)().T
    np.testing.assert_allclose(made(lambda r: r.rolling(5, name, 3, center=True)), want, rtol=1e-8, atol=1e-9)


def test_many_columns(spark):
    pdf = pd.DataFrame(_RNG.normal(size=(20, 40)), columns=[f"c{i}" for i in range(40)]).mask(_RNG.random((20, 40)) < 0.2)
    df = spark.createDataFrame(pdf.assign(i=range(20)))
    r = rowwise.row(list(pdf.columns))
    got = df.select("i", r.rank().alias("rank"), r.rolling(7, "median", 2).alias("roll"), r.mean().alias("mean")).orderBy("i").toPandas()
    cells = lambda c: np.array([[np.nan if x is None else x for x in v] for v in got[c]], float)
    np.testing.assert_allclose(cells("rank"), pdf.rank(axis=1))
    np.testing.assert_allclose(cells("roll"), pdf.T.rolling(7, min_periods=2).median().T)
    np.testing.assert_allclose(got["mean"], pdf.mean(axis=1))


@pytest.mark.parametrize("statistic", ["var", "std", "sem", "skew", "kurt"])
def test_central_statistics_of_columns(spark, statistic):
    """In batches: as expressions they were too large to compile.  Constants are flat also where their mean is not exact."""
    pdf = pd.DataFrame([[0.1, 0.1, 0.1, 0.1, 0.1], [1.0, np.nan, 4.0, 2.0, 9.0], [np.nan] * 5, [3.0, np.inf, 1.0, 5.0, 2.5], [-10.0, 1.0, 2.0, np.nan, 4.0]], columns=list("abcde"))
    df = spark.createDataFrame(pdf.assign(i=range(len(pdf)))).repartition(2)
    r = rowwise.row(list("abcde"))
    found = df.select("i", r.rolling(4, statistic, 2, center=True).alias("roll"), getattr(r, statistic)().alias("whole"))
    plan = found._jdf.queryExecution().optimizedPlan()
    assert len(plan.toString()) < 5000
    got = found.orderBy("i").collect()
    cells = np.array([[np.nan if x is None else x for x in row.roll] for row in got], float)
    clean = pdf.replace(np.inf, np.nan)
    np.testing.assert_allclose(cells, getattr(clean.T.rolling(4, min_periods=2, center=True), statistic)().T, rtol=1e-8, atol=1e-9)
    whole = getattr(clean, statistic)(axis=1).where(~np.isinf(pdf).any(axis=1))
    np.testing.assert_allclose(np.array([np.nan if row.whole is None else row.whole for row in got], float), whole, rtol=1e-8, atol=1e-9)
