import pytest
from edge_rows import COLUMNS, by_group, edge_frame, same

from strandline import ordered

PDF = edge_frame()
STATS = "sum mean std var min max count skew kurt median sem".split()


@pytest.fixture(scope="module")
def frame(spark):
    return ordered(spark.createDataFrame(PDF), "i", "g", COLUMNS)


@pytest.mark.parametrize("name", STATS)
def test_rolling(frame, name):
    same(getattr(frame.rolling(6, 4), name)(), by_group(PDF, lambda d: getattr(d.rolling(6, min_periods=4), name)()))


@pytest.mark.parametrize("name", STATS)
def test_rolling_centered(frame, name):
    same(getattr(frame.rolling(6, 4, center=True), name)(), by_group(PDF, lambda d: getattr(d.rolling(6, min_periods=4, center=True), name)()))


@pytest.mark.parametrize("name", STATS)
def test_expanding(frame, name):
    same(getattr(frame.expanding(3), name)(), by_group(PDF, lambda d: getattr(d.expanding(3), name)()))


@pytest.mark.parametrize("interpolation", ["linear", "lower", "higher", "nearest", "midpoint"])
def test_rolling_quantile(frame, interpolation):
    same(frame.rolling(6, 3).quantile(0.3, interpolation), by_group(PDF, lambda d: d.rolling(6, min_periods=3).quantile(0.3, interpolation=interpolation)))


@pytest.mark.parametrize("closed", ["left", "both", "neither"])
def test_closed(frame, closed):
    same(frame.rolling(4, 2, closed=closed).sum(), by_group(PDF, lambda d: d.rolling(4, min_periods=2, closed=closed).sum()))


@pytest.mark.parametrize("ddof", [0, 2])
def test_ddof(frame, ddof):
    same(frame.rolling(6, 4).std(ddof), by_group(PDF, lambda d: d.rolling(6, min_periods=4).std(ddof=ddof)))
    same(frame.rolling(6, 4).var(ddof), by_group(PDF, lambda d: d.rolling(6, min_periods=4).var(ddof=ddof)))


def test_window_longer_than_partition(frame):
    same(frame.rolling(500, 1).sum(), by_group(PDF, lambda d: d.rolling(500, min_periods=1).sum()))


def test_step_keeps_every_nth_row(frame):
    assert frame.rolling(4, 1, step=3).sum().count() == 3 * -(-80 // 3)


def test_partitioning_and_row_order_do_not_matter(spark):
    df = spark.createDataFrame(PDF.sample(frac=1, random_state=1))
    want = by_group(PDF, lambda d: d.rolling(5, min_periods=2).mean())
    for n in (1, 2, 7):
        same(ordered(df.repartition(n), "i", "g", COLUMNS).rolling(5, 2).mean(), want)


def test_one_window_node_for_many_statistics(frame):
    plan = frame.rolling(6, 4).agg(["sum", "mean", "max", "std"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window ") + plan.count("Window[") <= 2 and plan.count("Exchange") == 1


def test_empty_frame(spark):
    empty = ordered(spark.createDataFrame(PDF).limit(0), "i", "g", COLUMNS)
    assert empty.rolling(3).mean().count() == 0 and empty.ewm(span=3).mean().count() == 0


def test_bad_arguments(frame):
    for make in (lambda: frame.rolling(-1), lambda: frame.rolling(3, 4), lambda: frame.rolling(3, closed="x"), lambda: frame.expanding(-1), lambda: ordered(frame.df, "nothing")):
        with pytest.raises(ValueError):
            make()


def test_validate_order(frame, spark):
    frame.validate_order()
    with pytest.raises(ValueError):
        ordered(spark.createDataFrame(PDF), "g", None, "x").validate_order()


@pytest.mark.parametrize("adjust", [True, False])
@pytest.mark.parametrize("ignore_na", [True, False])
@pytest.mark.parametrize("name", ["mean", "var", "std"])
def test_ewm(frame, name, adjust, ignore_na):
    same(getattr(frame.ewm(span=5, adjust=adjust, ignore_na=ignore_na), name)(), by_group(PDF, lambda d: getattr(d.ewm(span=5, adjust=adjust, ignore_na=ignore_na), name)()))


@pytest.mark.parametrize("how", [{"com": 1.5}, {"halflife": 2.0}, {"alpha": 0.999}, {"alpha": 1.0}, {"span": 1}])
def test_ewm_decay(frame, how):
    same(frame.ewm(**how, min_periods=3).mean(), by_group(PDF, lambda d: d.ewm(**how, min_periods=3).mean()))


def test_ewm_bias(frame):
    same(frame.ewm(span=4).var(bias=True), by_group(PDF, lambda d: d.ewm(span=4).var(bias=True)))


def test_ewm_arguments(frame):
    for how in ({}, {"span": 3, "com": 1}, {"span": 0.5}, {"com": -1}, {"halflife": 0}, {"alpha": 1.5}):
        with pytest.raises(ValueError):
            frame.ewm(**how)


def test_rolling_pairs(spark):
    import numpy as np

    pdf = PDF.replace(np.inf, np.nan)
    frame = ordered(spark.createDataFrame(pdf), "i", "g", ["x", "y"])
    for kind in ("cov", "corr"):
        got = getattr(frame.rolling(6, 3), kind)().toPandas().set_index(["i", "col_i", "col_j"]).value
        for _, rows in pdf.groupby("g"):
            want = getattr(rows.set_index("i")[["x", "y"]].rolling(6, min_periods=3), kind)().stack(future_stack=True)
            for key, value in want.items():
                if kind == "corr" and not (value == value and abs(value) <= 1):
                    continue  # windows without variance leave artefacts there
                mine = got[key]
                assert (value != value and (mine is None or mine != mine)) or abs(mine - value) < 1e-8, (kind, key, mine, value)
