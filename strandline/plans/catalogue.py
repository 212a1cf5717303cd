"""Queries over the standard tables, one for each operator, and the SQL that checks them.

The tables hold no missing values, so both sides put some in with the same
CASE.  Floats are rounded on both sides, since sums may differ in their last
bits; results of short decimals would often fall on the very middle between two
rounded numbers, so both sides are first moved off it by a fixed 3.1e-8.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.frame import OrderedFrame, ordered
from strandline.operators import rowwise
from strandline.operators.elementwise import FUNCTIONS as ELEMENTWISE
from strandline.operators.udf import vectorized

Query = Callable[[SparkSession, str], DataFrame]
LINE_KEY = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
LINE_VALUES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
W, MP = 6, 4
OFF_TIES = 3.1e-8

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str, value: Column | None = None) -> OrderedFrame:
    """Events of each user in time order, every seventh value missing."""
    x = F.when(F.col("event_id") % 7 != 0, F.col("value")) if value is None else value
    df = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", x.alias("x"))
    return ordered(df, ["ts", "event_id"], "user_id", "x")


def _orders(spark: SparkSession, sf_dir: str) -> OrderedFrame:
    df = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("x"))
    return ordered(df, ["o_orderdate", "o_orderkey"], "o_custkey", "x")


def _lines(spark: SparkSession, sf_dir: str) -> OrderedFrame:
    return ordered(_table(spark, sf_dir, "lineitem").select("l_suppkey", *LINE_KEY[:-1], *LINE_VALUES), None, None, LINE_VALUES)


def _parts(spark: SparkSession, sf_dir: str) -> OrderedFrame:
    df = _table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 6 != 0, F.col("p_size").cast("double")).alias("x"))
    return ordered(df, "p_partkey", "p_brand", "x")


def _add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def _shown(df: DataFrame, key: str, digits: int = 6) -> DataFrame:
    return df.select(key, F.round(F.col("x").cast("double") + OFF_TIES, digits).alias("x"))


_EV = "SELECT event_id, user_id, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS x FROM events"
_OVER = "PARTITION BY user_id ORDER BY ts, event_id"


def _ev_sql(expression: str, frame: str, source: str = _EV, digits: int = 6) -> str:
    return f"WITH ev AS ({source}) SELECT event_id, round(({expression}) + 3.1e-8, {digits}) AS x FROM ev WINDOW w AS ({_OVER} {frame})"


# ------------------------------------------------------- rolling, expanding

_N = "count(x) OVER w"
_KURT = "CASE WHEN {n} < 4 THEN NULL WHEN var_pop(x) OVER w = 0 THEN {flat} ELSE kurtosis(x) OVER w END"
_SKEW = "CASE WHEN {n} < 3 THEN NULL WHEN var_pop(x) OVER w = 0 THEN 0.0 ELSE skewness(x) OVER w END"
_STATS = {
    "sum": "sum(x) OVER w", "mean": "avg(x) OVER w", "std": "stddev_samp(x) OVER w", "var": "var_samp(x) OVER w", "min": "min(x) OVER w", "max": "max(x) OVER w",
    "skew": _SKEW.format(n=_N), "kurt": _KURT.format(n=_N, flat="-3.0"), "median": "median(x) OVER w", "sem": "stddev_samp(x) OVER w / sqrt(count(x) OVER w - 1)",
}


def _gate(expression: str, least: int, n: str = _N) -> str:
    return f"CASE WHEN {n} >= {least} THEN {expression} END"


def _window_query(kind: str, name: str, **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = _events(spark, sf_dir)
        windows = frame.rolling(W, MP, **options.get("window", {})) if kind == "rolling" else frame.expanding(3)
        return _shown(getattr(windows, name)(**options.get("call", {})), "event_id")

    return query


_ROLL, _GROW = f"ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW", "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_ROWS = "count(*) OVER w"
for _name, _sql in _STATS.items():
    _add(f"rolling_{_name}", _window_query("rolling", _name), _ev_sql(_gate(_sql, MP), _ROLL))
    _add(f"expanding_{_name}", _window_query("expanding", _name), _ev_sql(_gate(_sql, 3), _GROW))
_add("rolling_count", _window_query("rolling", "count"), _ev_sql(_gate("(count(x) OVER w)::DOUBLE", MP, _ROWS), _ROLL))
_add("expanding_count", _window_query("expanding", "count"), _ev_sql(_gate("(count(x) OVER w)::DOUBLE", 3, _ROWS), _GROW))
_add("rolling_quantile", _window_query("rolling", "quantile", call={"q": 0.3}), _ev_sql(_gate("quantile_cont(x, 0.3) OVER w", MP), _ROLL))
_add("rolling_std_ddof0", _window_query("rolling", "std", call={"ddof": 0}), _ev_sql(_gate("stddev_pop(x) OVER w", MP), _ROLL))
_add("rolling_var_ddof2", _window_query("rolling", "var", call={"ddof": 2}), _ev_sql(_gate("var_pop(x) OVER w * (count(x) OVER w) / (count(x) OVER w - 2)", MP), _ROLL))
for _name in _STATS:
    _add(f"rolling_{_name}_centered", _window_query("rolling", _name, window={"center": True}), _ev_sql(_gate(_STATS[_name], MP), f"ROWS BETWEEN {W - (W - 1) // 2 - 1} PRECEDING AND {(W - 1) // 2} FOLLOWING"))
_CENTRE = f"ROWS BETWEEN {W - (W - 1) // 2 - 1} PRECEDING AND {(W - 1) // 2} FOLLOWING"
_add("rolling_count_centered", _window_query("rolling", "count", window={"center": True}), _ev_sql(_gate("(count(x) OVER w)::DOUBLE", MP, _ROWS), _CENTRE))
_add("rolling_quantile_centered", _window_query("rolling", "quantile", window={"center": True}, call={"q": 0.3}), _ev_sql(_gate("quantile_cont(x, 0.3) OVER w", MP), _CENTRE))
#: Quantiles of a sorted list v at place p (from 0) by the interpolations that SQL has no function for.
_PICKED = {"lower": "v[floor(p)::INT + 1]", "higher": "v[ceil(p)::INT + 1]", "midpoint": "(v[floor(p)::INT + 1] + v[ceil(p)::INT + 1]) / 2", "nearest": "v[round_even(p, 0)::INT + 1]"}
for _name, _sql in _PICKED.items():
    _add(
        f"rolling_quantile_{_name}",
        _window_query("rolling", "quantile", call={"q": 0.3, "interpolation": _name}),
        f"WITH ev AS ({_EV}), l AS (SELECT event_id, list_sort(list(x) FILTER (WHERE x IS NOT NULL) OVER w) AS v FROM ev WINDOW w AS ({_OVER} {_ROLL})), q AS (SELECT event_id, v, 0.3 * (len(v) - 1) AS p FROM l) SELECT event_id, round((CASE WHEN len(v) >= {MP} THEN {_sql} END) + 3.1e-8, 6) AS x FROM q",
    )
_add("rolling_sum_closed_left", _window_query("rolling", "sum", window={"closed": "left"}), _ev_sql(_gate(_STATS["sum"], MP), f"ROWS BETWEEN {W} PRECEDING AND 1 PRECEDING"))
_add("rolling_sum_minperiods0", lambda s, d: _shown(_events(s, d).rolling(W, 0).sum(), "event_id"), _ev_sql("coalesce(sum(x) OVER w, 0.0)", _ROLL))
_add("rolling_sum_full_window", lambda s, d: _shown(_events(s, d).rolling(3).sum(), "event_id"), _ev_sql(_gate(_STATS["sum"], 3), "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW"))
_add(
    "rolling_agg",
    lambda s, d: _events(s, d).rolling(W, MP).agg(["sum", "mean", "max"]).select("event_id", *[F.round(f"x_{k}", 6).alias(f"x_{k}") for k in ("sum", "mean", "max")]),
    f"WITH ev AS ({_EV}) SELECT event_id, " + ", ".join(f"round({_gate(_STATS[k], MP)}, 6) AS x_{k}" for k in ("sum", "mean", "max")) + f" FROM ev WINDOW w AS ({_OVER} {_ROLL})",
)
_add(
    "rolling_mean_step",
    lambda s, d: _shown(_events(s, d).rolling(W, MP, step=3).mean(), "event_id"),
    f"WITH ev AS ({_EV}) SELECT event_id, x FROM (SELECT event_id, round(({_gate(_STATS['mean'], MP)}) + 3.1e-8, 6) AS x, row_number() OVER ({_OVER}) AS rn FROM ev WINDOW w AS ({_OVER} {_ROLL})) WHERE (rn - 1) % 3 = 0",
)

# ------------------------------------------------------------------ pairwise


def _pairs(kind: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = ordered(_table(spark, sf_dir, "lineitem"), LINE_KEY, "l_suppkey", ["l_quantity", "l_discount", "l_tax"])
        found = getattr(frame.rolling(8, 3), kind)()
        return found.select("l_suppkey", *LINE_KEY, "col_i", "col_j", F.round(F.col("value") + OFF_TIES, 6).alias("value"))

    return query


def _pairs_sql(kind: str) -> str:
    keys = ", ".join(["l_suppkey", *LINE_KEY])
    parts = []
    for i in ("l_quantity", "l_discount", "l_tax"):
        for j in ("l_quantity", "l_discount", "l_tax"):
            if kind == "cov":
                value = f"covar_samp({i}, {j}) OVER w"
            elif i == j:
                value = f"CASE WHEN var_pop({i}) OVER w > 0 THEN 1.0::DOUBLE END"
            else:
                value = f"CASE WHEN var_pop({i}) OVER w > 0 AND var_pop({j}) OVER w > 0 THEN covar_pop({i}, {j}) OVER w / sqrt(var_pop({i}) OVER w * var_pop({j}) OVER w) END"
            parts.append(f"SELECT {keys}, '{i}' AS col_i, '{j}' AS col_j, round((CASE WHEN count(*) OVER w >= 3 THEN {value} END) + 3.1e-8, 6) AS value FROM li WINDOW w AS (PARTITION BY l_suppkey ORDER BY {', '.join(LINE_KEY)} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)")
    return "WITH li AS (SELECT * FROM lineitem) " + " UNION ALL ".join(parts)


for _name in ("cov", "corr"):
    _add(f"rolling_{_name}_pairwise", _pairs(_name), _pairs_sql(_name))


#: Deviations' magnitudes, so that covariances of all pairs are compared to as many digits.
_MAGNITUDE = "CASE {c} WHEN 'l_extendedprice' THEN 10000 WHEN 'l_quantity' THEN 10 ELSE 0.01 END"


def _matrix(kind: str, **options) -> Query:
    near = (lambda c: F.expr(_MAGNITUDE.format(c=c)).cast("double")) if kind == "cov" else (lambda c: F.lit(1.0))
    return lambda s, d: getattr(_lines(s, d), kind)(**options).select("col_i", "col_j", F.round(F.col("value") / near("col_i") / near("col_j") + OFF_TIES, 8).alias("value"))


def _matrix_sql(kind: str, ddof: int = 1) -> str:
    value = {"cov": "covar_samp({i}, {j})" if ddof else "covar_pop({i}, {j})", "corr": "corr({i}, {j})"}[kind]
    cell = lambda i, j: "max(1.0::DOUBLE)" if kind == "corr" and i == j else value.format(i=i, j=j)
    near = (lambda i: f"({_MAGNITUDE.format(c=repr(i))})::DOUBLE") if kind == "cov" else (lambda i: "1.0")
    return " UNION ALL ".join(f"SELECT '{i}' AS col_i, '{j}' AS col_j, round(({cell(i, j)}) / {near(i)} / {near(j)} + 3.1e-8, 8) AS value FROM lineitem" for i in LINE_VALUES for j in LINE_VALUES)


for _name in ("cov", "corr"):
    _add(f"{_name}_matrix", _matrix(_name), _matrix_sql(_name))
_add("cov_matrix_ddof0", _matrix("cov", ddof=0, min_periods=10), _matrix_sql("cov", 0))


def _wide_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 columns against each other."""
    df = _table(spark, sf_dir, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"d{i:02d}") for i in range(64)])
    return ordered(df, "vec_id").corr().select("col_i", "col_j", F.round(F.col("value") + OFF_TIES, 6).alias("value"))


_add(
    "corr_matrix_wide",
    _wide_matrix,
    "WITH e AS (SELECT vec_id, unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT printf('d%02d', a.dim) AS col_i, printf('d%02d', b.dim) AS col_j, round(CASE WHEN a.dim = b.dim THEN 1.0::DOUBLE ELSE corr(a.v, b.v) END + 3.1e-8, 6) AS value FROM e a JOIN e b USING (vec_id) GROUP BY a.dim, b.dim",
)
_add(
    "corr_spearman",
    lambda s, d: _lines(s, d).select("l_quantity", "l_tax").corr("spearman").select("col_i", "col_j", F.round("value", 6).alias("value")),
    "WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_tax) + (count(*) OVER (PARTITION BY l_tax) - 1) / 2.0 AS b FROM lineitem), c AS (SELECT round(corr(a, b), 6) AS v FROM r) "
    "SELECT 'l_quantity' AS col_i, 'l_quantity' AS col_j, 1.0::DOUBLE AS value UNION ALL SELECT 'l_tax', 'l_tax', 1.0 UNION ALL SELECT 'l_quantity', 'l_tax', v FROM c UNION ALL SELECT 'l_tax', 'l_quantity', v FROM c",
)

# ----------------------------------------------------------------------- ewm


def _ewm(kind: str, **options) -> Query:
    return lambda s, d: _shown(getattr(_events(s, d).ewm(span=8, **options), kind)(), "event_id")


def _ewm_sql(kind: str, ignore_na: bool) -> str:
    """Weights over all pairs of a user's rows; only rows of one user meet."""
    place = f"count(x) OVER ({_OVER} {_GROW})" if ignore_na else f"row_number() OVER ({_OVER})"
    r = "(1 - 2.0 / 9)"
    mean = "sum(b.x * pow({r}, a.p - b.p)) / sum(pow({r}, a.p - b.p))".format(r=r)
    var = "CASE WHEN count(b.x) >= 2 THEN greatest(sum(pow({r}, a.p - b.p) * (b.x - m) * (b.x - m)) / sum(pow({r}, a.p - b.p)), 0) * pow(sum(pow({r}, a.p - b.p)), 2) / (pow(sum(pow({r}, a.p - b.p)), 2) - sum(pow({r}, 2 * (a.p - b.p)))) END".format(r=r)
    base = f"WITH ev AS (SELECT event_id, user_id, x, {place} AS p, row_number() OVER ({_OVER}) AS rn FROM ({_EV})), k AS (SELECT * FROM ev WHERE x IS NOT NULL), means AS (SELECT a.event_id, {mean} AS m FROM ev a JOIN k b ON a.user_id = b.user_id AND b.rn <= a.rn GROUP BY a.event_id)"
    if kind == "mean":
        return base + " SELECT ev.event_id, round((m) + 3.1e-8, 6) AS x FROM ev LEFT JOIN means ON ev.event_id = means.event_id"
    value = f"sqrt({var})" if kind == "std" else var
    return base + f", vars AS (SELECT a.event_id, {value} AS v FROM ev a JOIN means USING (event_id) JOIN k b ON a.user_id = b.user_id AND b.rn <= a.rn GROUP BY a.event_id) SELECT ev.event_id, round((v) + 3.1e-8, 6) AS x FROM ev LEFT JOIN vars ON ev.event_id = vars.event_id"


for _name in ("mean", "var", "std"):
    _add(f"ewm_{_name}", _ewm(_name), _ewm_sql(_name, False))
    _add(f"ewm_{_name}_ignore_na", _ewm(_name, ignore_na=True), _ewm_sql(_name, True))
# Without gaps the unadjusted mean is a plain recursion.
_add(
    "ewm_mean_adjust_false",
    lambda s, d: _shown(_events(s, d, F.col("value")).ewm(span=8, adjust=False).mean(), "event_id"),
    f"WITH RECURSIVE ev AS (SELECT event_id, user_id, value AS x, row_number() OVER ({_OVER}) AS rn FROM events), r AS (SELECT event_id, user_id, rn, x AS y FROM ev WHERE rn = 1 UNION ALL SELECT ev.event_id, ev.user_id, ev.rn, 2.0::DOUBLE / 9 * ev.x + (1 - 2.0::DOUBLE / 9) * r.y FROM r JOIN ev ON ev.user_id = r.user_id AND ev.rn = r.rn + 1) SELECT event_id, round((y) + 3.1e-8, 6) AS x FROM r",
)


def _ewm_steps_sql(kind: str, ignore_na: bool) -> str:
    """The unadjusted recurrence row by row: mean, variance and the three sums of weights."""
    a, r = "(2.0::DOUBLE / 9)", "(1 - 2.0::DOUBLE / 9)"
    fades = "m IS NOT NULL" + (" AND x IS NOT NULL" if ignore_na else "")
    fade = lambda c, by: f"CASE WHEN {fades} THEN {c} * {by} ELSE {c} END AS {c}1"
    new = f"((ow1 * m + {a} * x) / (ow1 + {a}))"
    seen = lambda then, otherwise, first: f"CASE WHEN x IS NULL THEN {otherwise} WHEN m IS NULL THEN {first} ELSE {then} END"
    step = ", ".join(
        [
            f"{seen(new, 'm', 'x')} AS m",
            f"{seen(f'(ow1 * (cov + pow(m - {new}, 2)) + {a} * pow(x - {new}, 2)) / (ow1 + {a})', 'cov', '0.0')} AS cov",
            "n + (x IS NOT NULL)::INT AS n",
            f"{seen('1.0', 'ow1', '1.0')} AS ow",
            f"{seen(f'(sw1 + {a}) / (ow1 + {a})', 'sw1', '1.0')} AS sw",
            f"{seen(f'(sw21 + {a} * {a}) / pow(ow1 + {a}, 2)', 'sw21', '1.0')} AS sw2",
        ]
    )
    var = "CASE WHEN n >= 2 AND sw * sw > sw2 THEN sw * sw / (sw * sw - sw2) * cov END"
    value = {"mean": "m", "var": var, "std": f"sqrt({var})"}[kind]
    return f"""WITH RECURSIVE ev AS (SELECT event_id, user_id, x, row_number() OVER ({_OVER}) AS rn FROM ({_EV})),
    r AS (SELECT event_id, user_id, rn, x::DOUBLE AS m, 0.0::DOUBLE AS cov, (x IS NOT NULL)::INT AS n, 1.0::DOUBLE AS ow, 1.0::DOUBLE AS sw, 1.0::DOUBLE AS sw2 FROM ev WHERE rn = 1
    UNION ALL SELECT event_id, user_id, rn, {step} FROM (SELECT ev.event_id, ev.user_id, ev.rn, ev.x, m, cov, n, {fade("ow", r)}, {fade("sw", r)}, {fade("sw2", f"pow({r}, 2)")} FROM r JOIN ev ON ev.user_id = r.user_id AND ev.rn = r.rn + 1))
    SELECT event_id, round(({value}) + 3.1e-8, 6) AS x FROM r"""


for _name in ("mean", "var", "std"):
    if _name != "mean":
        _add(f"ewm_{_name}_adjust_false", _ewm(_name, adjust=False), _ewm_steps_sql(_name, False))
    _add(f"ewm_{_name}_adjust_false_ignore_na", _ewm(_name, adjust=False, ignore_na=True), _ewm_steps_sql(_name, True))

# ---------------------------------------------------------------- cumulative

_RUN = {"cumsum": "sum(x) OVER w", "cumprod": "product(x) OVER w", "cummin": "min(x) OVER w", "cummax": "max(x) OVER w"}


def _running(kind: str, skipna: bool) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = F.when(F.col("event_id") % 7 != 0, 1 + F.col("value") / 100000) if kind == "cumprod" else None
        return _shown(getattr(_events(spark, sf_dir, x), kind)(skipna), "event_id", 6)

    return query


for _name, _sql in _RUN.items():
    _source = "SELECT event_id, user_id, ts, CASE WHEN event_id % 7 <> 0 THEN 1 + value / 100000 END AS x FROM events" if _name == "cumprod" else _EV
    _add(_name, _running(_name, True), _ev_sql(f"CASE WHEN x IS NOT NULL THEN {_sql} END", _GROW, _source))
    _add(f"{_name}_skipna_false", _running(_name, False), _ev_sql(f"CASE WHEN count(x) OVER w = count(*) OVER w THEN {_sql} END", _GROW, _source))

# ---------------------------------------------------------------- transforms

_ORD = "SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS x FROM orders"
_OW = "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


def _order_query(make) -> Query:
    return lambda s, d: _shown(make(_orders(s, d)), "o_orderkey")


def _order_sql(expression: str) -> str:
    return f"WITH o AS ({_ORD}) SELECT o_orderkey, round(({expression}) + 3.1e-8, 6) AS x FROM o"


def _change_sql(periods: int, fill: str | None) -> str:
    filled = {"pad": f"last_value(x IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey {_GROW})", None: "x"}[fill]
    return f"WITH o AS ({_ORD}), f AS (SELECT *, {filled} AS y FROM o), g AS (SELECT *, lag(y, {periods}) OVER {_OW} AS b FROM f) SELECT o_orderkey, round((CASE WHEN y IS NULL THEN NULL WHEN b = 0 THEN CASE WHEN y = 0 THEN NULL WHEN y > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END ELSE (y - b) / b END) + 3.1e-8, 6) AS x FROM g"


_add("diff", _order_query(lambda o: o.diff()), _order_sql(f"x - lag(x, 1) OVER {_OW}"))
_add("diff_neg", _order_query(lambda o: o.diff(-2)), _order_sql(f"x - lead(x, 2) OVER {_OW}"))
_add("shift", _order_query(lambda o: o.shift(2)), _order_sql(f"lag(x, 2) OVER {_OW}"))
_add("shift_fill", _order_query(lambda o: o.shift(-1, -1.0)), _order_sql(f"lead(x, 1, -1.0::DOUBLE) OVER {_OW}"))
_add("pct_change_pad", _order_query(lambda o: o.pct_change()), _change_sql(1, "pad"))
_add(
    "pct_change_limit",
    _order_query(lambda o: o.pct_change(1, "pad", 1)),
    f"WITH o AS ({_ORD}), f AS (SELECT *, last_value(x IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS y FROM o), g AS (SELECT *, lag(y, 1) OVER {_OW} AS b FROM f) SELECT o_orderkey, round((CASE WHEN b <> 0 THEN (y - b) / b END) + 3.1e-8, 6) AS x FROM g",
)
_add("pct_change_nofill", _order_query(lambda o: o.pct_change(2, None)), _change_sql(2, None))

# --------------------------------------------------------------------- ranks

_PART = "SELECT p_partkey, p_brand, CASE WHEN p_partkey % 6 <> 0 THEN p_size::DOUBLE END AS x FROM part"


def _rank_sql(method: str = "average", direction: str = "ASC", nulls: str | None = None, pct: bool = False, parts: str = "p_brand", source: str = _PART, key: str = "p_partkey") -> str:
    by = f"PARTITION BY {parts} " if parts else ""
    order = f"ORDER BY x {direction} NULLS {nulls or 'LAST'}"
    ties = f"count(*) OVER (PARTITION BY {parts + ', ' if parts else ''}x)"
    least = f"rank() OVER ({by}{order})"
    value = {"average": f"{least} + ({ties} - 1) / 2.0", "min": least, "max": f"{least} + {ties} - 1", "first": f"row_number() OVER ({by}{order}, {key})", "dense": f"dense_rank() OVER ({by}{order})"}[method]
    if pct:
        total = f"count(DISTINCT x) OVER ({by.strip()})" if method == "dense" else f"count({'x' if nulls is None else '*'}) OVER ({by.strip()})"
        value = f"({value})::DOUBLE / {total}"
    value = f"({value})::DOUBLE"
    return f"WITH p AS ({source}) SELECT {key}, round(({value if nulls else f'CASE WHEN x IS NOT NULL THEN {value} END'}) + 3.1e-8, 6) AS x FROM p"


def _rank(**options) -> Query:
    return lambda s, d: _shown(_parts(s, d).rank(**options), "p_partkey")


for _name in ("average", "min", "max", "first", "dense"):
    _add(f"rank_{_name}", _rank(method=_name), _rank_sql(_name))
_add("rank_desc", _rank(ascending=False), _rank_sql(direction="DESC"))
_add("rank_pct", _rank(pct=True), _rank_sql(pct=True))
_add("rank_dense_pct", _rank(method="dense", pct=True), _rank_sql("dense", pct=True))
_add("rank_na_top", _rank(na_option="top"), _rank_sql(nulls="FIRST"))
_add("rank_na_bottom", _rank(na_option="bottom", method="min"), _rank_sql("min", nulls="LAST"))
_ORDX = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS x FROM orders"
_add("rank_unpartitioned", lambda s, d: _shown(ordered(_orders(s, d).df, None, None, "x").rank(), "o_orderkey"), _rank_sql(parts="", source=_ORDX, key="o_orderkey"))
_add("rank_unpartitioned_dense", lambda s, d: _shown(ordered(_orders(s, d).df, None, None, "x").rank("dense", ascending=False), "o_orderkey"), _rank_sql("dense", "DESC", parts="", source=_ORDX, key="o_orderkey"))

_add("rank_unpartitioned_first", lambda s, d: _shown(ordered(_orders(s, d).df, "o_orderkey", None, "x").rank("first"), "o_orderkey"), _rank_sql("first", parts="", source=_ORDX, key="o_orderkey"))

# ---------------------------------------------------------------- reductions

_LINE = "SELECT " + ", ".join(f"CASE WHEN l_orderkey % 7 <> 0 THEN {c} END AS {c}" for c in LINE_VALUES) + " FROM lineitem"


def _line_frame(spark: SparkSession, sf_dir: str) -> OrderedFrame:
    df = _table(spark, sf_dir, "lineitem").select(*[F.when(F.col("l_orderkey") % 7 != 0, F.col(c)).alias(c) for c in LINE_VALUES])
    return ordered(df, None, None, LINE_VALUES)


def _rounded(df: DataFrame, digits: int, keys: tuple = ()) -> DataFrame:
    return df.select(*keys, *[F.round(c, digits).alias(c) if df.schema[c].dataType.typeName() == "double" else F.col(c) for c in df.columns if c not in keys])


def _line_sql(expression: str, digits: int | None = 4) -> str:
    value = (lambda c: f"round({expression.format(c=c)}, {digits}) AS {c}") if digits is not None else (lambda c: f"{expression.format(c=c)} AS {c}")
    return f"WITH l AS ({_LINE}) SELECT " + ", ".join(value(c) for c in LINE_VALUES) + " FROM l"


_REDUCE = {
    "sum": ("coalesce(sum({c}), 0.0)", 2), "mean": ("avg({c})", 6), "std": ("stddev_samp({c})", 6), "var": ("var_samp({c})", 2), "min": ("min({c})", 6), "max": ("max({c})", 6),
    "median": ("median({c})", 6), "all": ("coalesce(bool_and({c} <> 0), true)", None), "any": ("coalesce(bool_or({c} <> 0), false)", None),
    "skew": ("skewness({c})", 6), "kurt": ("kurtosis({c})", 5), "sem": ("stddev_samp({c}) / sqrt(count({c}))", 6),
}
for _name, (_sql, _digits) in _REDUCE.items():
    _add(
        _name if _name in ("skew", "kurt", "sem") else f"reduce_{_name}",
        lambda s, d, n=_name, k=_digits: _rounded(getattr(_line_frame(s, d), n)(), k or 6),
        _line_sql(_sql, _digits),
    )
_add("reduce_prod", lambda s, d: _rounded(ordered(_line_frame(s, d).df.select(*[(1 + F.col(c) / 1e8).alias(c) for c in LINE_VALUES]), None, None, LINE_VALUES).prod(), 3), f"WITH l AS ({_LINE}) SELECT " + ", ".join(f"round(product(1 + {c} / 1e8), 3) AS {c}" for c in LINE_VALUES) + " FROM l")
_add("reduce_sum_skipna_false", lambda s, d: _rounded(_line_frame(s, d).sum(skipna=False), 2), _line_sql("CASE WHEN count({c}) = count(*) THEN sum({c}) END", 2))
_add("reduce_sum_min_count", lambda s, d: _rounded(_line_frame(s, d).sum(min_count=10), 2), _line_sql("CASE WHEN count({c}) >= 10 THEN sum({c}) END", 2))
_add("reduce_std_ddof0", lambda s, d: _rounded(_line_frame(s, d).std(ddof=0), 6), _line_sql("stddev_pop({c})", 6))
_add("reduce_all_skipna_false", lambda s, d: _line_frame(s, d).all(skipna=False), _line_sql("coalesce(bool_and(coalesce({c} <> 0, true)), true)", None))
_add("reduce_quantile", lambda s, d: _rounded(_line_frame(s, d).quantile(0.3), 6), _line_sql("quantile_cont({c}, 0.3)", 6))
_add("reduce_quantiles", lambda s, d: _rounded(_line_frame(s, d).quantile([0.1, 0.5, 0.9]), 6), f"WITH l AS ({_LINE}) " + " UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, " + ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {c}" for c in LINE_VALUES) + " FROM l" for q in (0.1, 0.5, 0.9)))
for _name, _sql in _PICKED.items():
    _add(
        f"reduce_quantile_{_name}",
        lambda s, d, n=_name: _rounded(_line_frame(s, d).quantile(0.3, n), 6),
        f"WITH l AS ({_LINE}) SELECT " + ", ".join(f"(SELECT round({_sql}, 6) FROM (SELECT v, 0.3 * (len(v) - 1) AS p FROM (SELECT list_sort(list({c}) FILTER (WHERE {c} IS NOT NULL)) AS v FROM l))) AS {c}" for c in LINE_VALUES),
    )
_add(
    "reduce_by_group",
    lambda s, d: _rounded(ordered(_table(s, d, "lineitem"), None, "l_returnflag", LINE_VALUES).mean(), 4, ("l_returnflag",)),
    "SELECT l_returnflag, " + ", ".join(f"round(avg({c}), 4) AS {c}" for c in LINE_VALUES) + " FROM lineitem GROUP BY l_returnflag",
)
_add("agg_name", lambda s, d: _rounded(_line_frame(s, d).agg("max"), 6), _line_sql("max({c})", 6))
_add("agg_list", lambda s, d: _rounded(_line_frame(s, d).agg(["sum", "mean", "max"]), 2), f"WITH l AS ({_LINE}) " + " UNION ALL ".join(f"SELECT '{n}' AS function, " + ", ".join(f"round({k}({c}), 2) AS {c}" for c in LINE_VALUES) + " FROM l" for n, k in (("sum", "sum"), ("mean", "avg"), ("max", "max"))))
_add("agg_dict", lambda s, d: _rounded(_line_frame(s, d).agg({"l_quantity": "sum", "l_tax": "mean"}), 4), f"WITH l AS ({_LINE}) SELECT round(sum(l_quantity), 4) AS l_quantity, round(avg(l_tax), 4) AS l_tax FROM l")
_add("agg_named", lambda s, d: _rounded(_line_frame(s, d).agg(None, top=("l_quantity", "max"), mid=("l_tax", "median")), 6), f"WITH l AS ({_LINE}) SELECT round(max(l_quantity), 6) AS top, round(median(l_tax), 6) AS mid FROM l")
_add("apply_cols", lambda s, d: _rounded(ordered(_table(s, d, "part"), None, None, ["p_size", "p_retailprice"]).apply(lambda a: float(a.max() - a.min())), 4), "SELECT round((max(p_size) - min(p_size))::DOUBLE, 4) AS p_size, round(max(p_retailprice) - min(p_retailprice), 4) AS p_retailprice FROM part")
_add("vectorized_function", lambda s, d: (lambda root: _events(s, d).df.select("event_id", F.round(root("x") + OFF_TIES, 6).alias("x")))(vectorized(lambda a: a**0.5 + 1)), f"WITH ev AS ({_EV}) SELECT event_id, round(sqrt(x) + 1 + 3.1e-8, 6) AS x FROM ev")
_add("apply_rows", lambda s, d: _lines(s, d).apply(lambda a: float(a.max()), axis=1).select(*LINE_KEY[:-1], "l_suppkey", "l_extendedprice", F.round("result", 6).alias("x")), f"SELECT {', '.join(LINE_KEY[:-1])}, l_suppkey, l_extendedprice, round(greatest({', '.join(LINE_VALUES)}), 6) AS x FROM lineitem")

# ----------------------------------------------------------------- row-wise

_KEYS = ", ".join(["l_suppkey", *LINE_KEY])
_CELLS = [f"CASE WHEN l_orderkey % 7 <> {i} THEN {c} END" for i, c in enumerate(LINE_VALUES)]
_LIST = f"list_filter([{', '.join(_CELLS)}], lambda v: v IS NOT NULL)"


def _row_frame(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, rowwise.Row]:
    df = _table(spark, sf_dir, "lineitem")
    df = df.select("l_suppkey", *LINE_KEY, *[F.when(F.col("l_orderkey") % 7 != i, F.col(c)).alias(f"v{i}") for i, c in enumerate(LINE_VALUES)])
    return df, rowwise.row([f"v{i}" for i in range(len(LINE_VALUES))])


def _row_value(make) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, row = _row_frame(spark, sf_dir)
        value = make(row)
        found = df.select("l_suppkey", *LINE_KEY, value.alias("x"))
        return found if found.schema["x"].dataType.typeName() == "boolean" else found.withColumn("x", F.round(F.col("x") + OFF_TIES, 4))

    return query


def _row_values(make, digits: int = 4, off: float = OFF_TIES) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, row = _row_frame(spark, sf_dir)
        made = df.select("l_suppkey", *LINE_KEY, make(row).alias("_v"))
        return made.select("l_suppkey", *LINE_KEY, *[F.round(F.get("_v", F.lit(i)) + off, digits).alias(f"x{i}") for i in range(len(LINE_VALUES))])

    return query


def _row_sql(expression: str) -> str:
    return f"WITH l AS (SELECT {_KEYS}, {_LIST} AS v, [{', '.join(_CELLS)}] AS raw FROM lineitem) SELECT {_KEYS}, {expression} AS x FROM l"


for _name, _make, _sql in (
    ("sum", lambda r: r.sum(), "round(coalesce(list_sum(v), 0.0) + 3.1e-8, 4)"),
    ("mean", lambda r: r.mean(), "round(list_avg(v) + 3.1e-8, 4)"),
    ("std", lambda r: r.std(), "round(list_stddev_samp(v) + 3.1e-8, 4)"),
    ("var", lambda r: r.var(), "round(list_var_samp(v) + 3.1e-8, 4)"),
    ("min", lambda r: r.min(), "round(list_min(v) + 3.1e-8, 4)"),
    ("max", lambda r: r.max(), "round(list_max(v) + 3.1e-8, 4)"),
    ("median", lambda r: r.median(), "round(list_median(v) + 3.1e-8, 4)"),
    ("prod", lambda r: r.prod(), "round(coalesce(list_product(v), 1.0) + 3.1e-8, 4)"),
    ("all", lambda r: r.all(), "len(list_filter(v, lambda e: e = 0)) = 0"),
    ("any", lambda r: r.any(), "len(list_filter(v, lambda e: e <> 0)) > 0"),
    ("quantile", lambda r: r.quantile(0.25), "round(list_aggregate(v, 'quantile_cont', 0.25) + 3.1e-8, 4)"),
    ("sem", lambda r: r.sem(), "round(list_stddev_samp(v) / sqrt(len(v)) + 3.1e-8, 4)"),
    ("count", lambda r: r.count(), "round(len(v)::DOUBLE + 3.1e-8, 4)"),
    ("skew", lambda r: r.skew(), "round(CASE WHEN len(v) >= 3 THEN list_aggregate(v, 'skewness') END + 3.1e-8, 4)"),
    ("kurt", lambda r: r.kurt(), "round(CASE WHEN len(v) >= 4 THEN list_aggregate(v, 'kurtosis') END + 3.1e-8, 4)"),
    ("sum_skipna_false", lambda r: r.sum(skipna=False), "round(CASE WHEN len(v) = 4 THEN list_sum(v) END + 3.1e-8, 4)"),
):
    _add(f"row_{_name}", _row_value(_make), _row_sql(_sql))


def _rows_sql(cells: list[str], digits: int = 4, off: float = OFF_TIES) -> str:
    made = ", ".join(f"round(({c}) + {off}, {digits}) AS x{i}" for i, c in enumerate(cells))
    return f"WITH l AS (SELECT {_KEYS}, {', '.join(f'{c} AS c{i}' for i, c in enumerate(_CELLS))} FROM lineitem) SELECT {_KEYS}, {made} FROM l"


def _upto(i: int, op: str, none: str) -> str:
    return f"CASE WHEN c{i} IS NOT NULL THEN " + (f" {op} ".join(f"coalesce(c{k}, {none})" for k in range(i + 1))) + " END"


_add("row_cumsum", _row_values(lambda r: r.cumsum()), _rows_sql([_upto(i, "+", "0") for i in range(4)]))
_add("row_cumprod", _row_values(lambda r: r.cumprod()), _rows_sql([_upto(i, "*", "1") for i in range(4)]))
_add("row_cummax", _row_values(lambda r: r.cummax()), _rows_sql([f"CASE WHEN c{i} IS NOT NULL THEN greatest({', '.join(f'c{k}' for k in range(i + 1))}) END" for i in range(4)]))
_add("row_cummin", _row_values(lambda r: r.cummin()), _rows_sql([f"CASE WHEN c{i} IS NOT NULL THEN least({', '.join(f'c{k}' for k in range(i + 1))}) END" for i in range(4)]))
_add("row_diff", _row_values(lambda r: r.diff()), _rows_sql(["NULL::DOUBLE", *[f"c{i} - c{i - 1}" for i in range(1, 4)]]))
_add("row_shift", _row_values(lambda r: r.shift()), _rows_sql(["NULL::DOUBLE", "c0", "c1", "c2"]))
_add("row_pct_change", _row_values(lambda r: r.pct_change(1, None)), _rows_sql(["NULL::DOUBLE", *[f"CASE WHEN c{i} IS NULL THEN NULL WHEN c{i - 1} = 0 THEN CASE WHEN c{i} = 0 THEN NULL WHEN c{i} > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END ELSE (c{i} - c{i - 1}) / c{i - 1} END" for i in range(1, 4)]]))
_add("row_rank", _row_values(lambda r: r.rank()), _rows_sql([f"CASE WHEN c{i} IS NOT NULL THEN ({' + '.join(f'CASE WHEN c{k} < c{i} THEN 2 WHEN c{k} = c{i} THEN 1 ELSE 0 END' for k in range(4))} + 1) / 2.0::DOUBLE END" for i in range(4)]))
_add("row_rolling_mean", _row_values(lambda r: r.rolling(2, "mean", 1)), _rows_sql(["c0", *[f"CASE WHEN c{i} IS NULL THEN c{i - 1} WHEN c{i - 1} IS NULL THEN c{i} ELSE (c{i} + c{i - 1}) / 2 END" for i in range(1, 4)]]))
for _name, _op, _none_ in (("cumsum", "+", "0"), ("cumprod", "*", "1")):
    _add(f"row_{_name}_skipna_false", _row_values(lambda r, n=_name: getattr(r, n)(skipna=False)), _rows_sql([f"CASE WHEN {' AND '.join(f'c{k} IS NOT NULL' for k in range(i + 1))} THEN {f' {_op} '.join(f'c{k}' for k in range(i + 1))} END" for i in range(4)]))


def _pad(i: int) -> str:
    return f"coalesce({', '.join(f'c{k}' for k in range(i, -1, -1))})"


_add("row_pct_change_pad", _row_values(lambda r: r.pct_change()), _rows_sql(["NULL::DOUBLE", *[f"CASE WHEN {_pad(i - 1)} = 0 THEN CASE WHEN {_pad(i)} = 0 THEN NULL WHEN {_pad(i)} > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END ELSE ({_pad(i)} - {_pad(i - 1)}) / {_pad(i - 1)} END" for i in range(1, 4)]]))


def _row_rank_sql(method: str, na_option: str, less: str, pct: bool) -> str:
    """Places in a row of four from comparisons with each cell."""
    cells = []
    for i in range(4):
        count = lambda test, among=range(4): "(" + (" + ".join(f"CASE WHEN {test.format(k=k, i=i)} THEN 1 ELSE 0 END" for k in among) or "0") + ")"  # noqa: B023, E731
        gaps, seen = count("c{k} IS NULL"), count("c{k} IS NOT NULL")
        first = lambda k: " AND ".join(f"c{k} IS DISTINCT FROM c{j}" for j in range(k)) or "true"
        distinct = "(" + " + ".join(f"CASE WHEN c{k} {less} c{i} AND {first(k)} THEN 1 ELSE 0 END" for k in range(4)) + ")"
        values = "(" + " + ".join(f"CASE WHEN c{k} IS NOT NULL AND {first(k)} THEN 1 ELSE 0 END" for k in range(4)) + ")"
        ahead, none_ahead = (gaps, "0") if na_option == "top" else ("0", seen)
        below, same = count(f"c{{k}} {less} c{{i}}"), count("c{k} = c{i}")
        found = {"average": f"{ahead} + {below} + ({same} + 1) / 2.0", "min": f"{ahead} + {below} + 1", "max": f"{ahead} + {below} + {same}", "first": f"{ahead} + {below} + {count('c{k} = c{i}', range(i))} + 1", "dense": f"{f'least({gaps}, 1)' if na_option == 'top' else '0'} + {distinct} + 1"}[method]
        none = {"average": f"{none_ahead} + ({gaps} + 1) / 2.0", "min": f"{none_ahead} + 1", "max": f"{none_ahead} + {gaps}", "first": f"{none_ahead} + {count('c{k} IS NULL', range(i))} + 1", "dense": f"{'0' if na_option == 'top' else values} + 1"}[method]
        value = f"CASE WHEN c{i} IS NOT NULL THEN ({found})::DOUBLE {'' if na_option == 'keep' else f'ELSE ({none})::DOUBLE'} END"
        if pct:
            value = f"({value}) / {(values if na_option == 'keep' else f'({values} + least({gaps}, 1))') if method == 'dense' else seen if na_option == 'keep' else 4}"
        cells.append(value)
    return _rows_sql(cells)


for _method in ("min", "max", "first", "dense"):
    _add(f"row_rank_{_method}", _row_values(lambda r, m=_method: r.rank(m)), _row_rank_sql(_method, "keep", "<", False))
_add("row_rank_na_top", _row_values(lambda r: r.rank(na_option="top")), _row_rank_sql("average", "top", "<", False))
_add("row_rank_na_bottom_desc", _row_values(lambda r: r.rank("dense", "bottom", ascending=False)), _row_rank_sql("dense", "bottom", ">", False))
_add("row_rank_pct", _row_values(lambda r: r.rank(pct=True)), _row_rank_sql("average", "keep", "<", True))

#: Statistics of a list v of the known values of a window, and how many it takes.
_LISTED = {
    "sum": ("list_sum(v)", 2), "mean": ("list_avg(v)", 2), "std": ("list_stddev_samp(v)", 2), "var": ("list_var_samp(v)", 2), "min": ("list_min(v)", 2), "max": ("list_max(v)", 2), "median": ("list_median(v)", 2),
    "quantile": ("list_aggregate(v, 'quantile_cont', 0.5)", 2), "sem": ("list_stddev_samp(v) / sqrt(len(v) - 1)", 2), "skew": ("CASE WHEN len(v) >= 3 THEN list_aggregate(v, 'skewness') END", 2), "kurt": ("CASE WHEN len(v) >= 4 THEN list_aggregate(v, 'kurtosis') END", 2),
}


def _row_rolling_sql(expression: str, least: int, low: int, high: int, digits: int, off: float) -> str:
    cells = []
    for i in range(4):
        held = f"list_filter([{', '.join(f'c{k}' for k in range(max(i + low, 0), min(i + high, 3) + 1))}], lambda e: e IS NOT NULL)"
        cells.append(f"(SELECT CASE WHEN len(v) >= {least} THEN {expression} END FROM (SELECT {held} AS v))")
    return _rows_sql(cells, digits, off)


for _name, (_sql, _least) in _LISTED.items():
    _digits, _off = (-2, 1.23) if _name == "var" else (4, OFF_TIES)  # variances are up to 1e10
    if _name != "mean":
        _add(f"row_rolling_{_name}", _row_values(lambda r, n=_name: r.rolling(4, n, 2), _digits, _off), _row_rolling_sql(_sql, _least, -3, 0, _digits, _off))
    _add(f"row_rolling_{_name}_centered", _row_values(lambda r, n=_name: r.rolling(3, n, 2, center=True), _digits, _off), _row_rolling_sql(_sql, _least, -1, 1, _digits, _off))
_add("row_rolling_count", _row_values(lambda r: r.rolling(2, "count", 1)), _rows_sql(["CASE WHEN c0 IS NULL THEN 0.0::DOUBLE ELSE 1 END", *[f"(CASE WHEN c{i} IS NULL THEN 0.0::DOUBLE ELSE 1 END) + (CASE WHEN c{i - 1} IS NULL THEN 0 ELSE 1 END)" for i in range(1, 4)]]))
_add(
    "row_wide",
    lambda s, d: (lambda r: _table(s, d, "embeddings").select("vec_id", F.round(r.mean(), 5).alias("mean"), F.round(r.std(), 5).alias("std"), F.round(r.median(), 5).alias("median")))(rowwise.row_of("embedding")),
    "SELECT vec_id, round(list_avg(e), 5) AS mean, round(list_stddev_samp(e), 5) AS std, round(list_median(e), 5) AS median FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)",
)



def _wide_cells(make) -> Query:
    return lambda s, d: _table(s, d, "embeddings").select("vec_id", F.posexplode(make(rowwise.row_of("embedding"))).alias("dim", "x")).select("vec_id", "dim", F.round(F.col("x") + OFF_TIES, 5).alias("x"))


_WIDE = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT vec_id, e, unnest(range(0, 64))::INT AS dim FROM e) SELECT vec_id, dim, round(({}) + 3.1e-8, 5) AS x FROM c"
_add("row_wide_rolling_mean", _wide_cells(lambda r: r.rolling(5, "mean", 2)), _WIDE.format("CASE WHEN dim >= 1 THEN list_avg(e[greatest(dim - 3, 1):dim + 1]) END"))
_add("row_wide_rank", _wide_cells(lambda r: r.rank("min")), _WIDE.format("len(list_filter(e, lambda v: v < e[dim + 1])) + 1.0::DOUBLE"))
_add("row_wide_cumsum", _wide_cells(lambda r: r.cumsum()), _WIDE.format("list_sum(e[1:dim + 1])"))

# -------------------------------------------------------------- missing data


def _gap_query(make) -> Query:
    return lambda s, d: _shown(make(_events(s, d)), "event_id")


_add("isna", lambda s, d: _events(s, d).isna().select("event_id", "x"), f"WITH ev AS ({_EV}) SELECT event_id, x IS NULL AS x FROM ev")
_add("notna", lambda s, d: _events(s, d).notna().select("event_id", "x"), f"WITH ev AS ({_EV}) SELECT event_id, x IS NOT NULL AS x FROM ev")
_add("fillna_value", _gap_query(lambda o: o.fillna(0.5)), f"WITH ev AS ({_EV}) SELECT event_id, round((coalesce(x, 0.5)) + 3.1e-8, 6) AS x FROM ev")
_add("fillna_dict", _gap_query(lambda o: o.fillna({"x": -1})), f"WITH ev AS ({_EV}) SELECT event_id, round((coalesce(x, -1.0)) + 3.1e-8, 6) AS x FROM ev")
_add("fillna_ffill", _gap_query(lambda o: o.fillna(method="ffill")), _ev_sql("last_value(x IGNORE NULLS) OVER w", _GROW))
_add("fillna_bfill", _gap_query(lambda o: o.fillna(method="bfill")), _ev_sql("first_value(x IGNORE NULLS) OVER w", "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"))
_add("fillna_limit", _gap_query(lambda o: o.fillna(method="ffill", limit=1)), _ev_sql("last_value(x IGNORE NULLS) OVER w", "ROWS BETWEEN 1 PRECEDING AND CURRENT ROW"))


_add("bfill_limit", _gap_query(lambda o: o.bfill(1)), _ev_sql("first_value(x IGNORE NULLS) OVER w", "ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING"))
_add("fillna_value_limit", _gap_query(lambda o: o.fillna(0.5, limit=3)), _ev_sql("CASE WHEN x IS NULL AND count(*) FILTER (WHERE x IS NULL) OVER w <= 3 THEN 0.5 ELSE x END", _GROW))


def _holes(spark: SparkSession, sf_dir: str) -> OrderedFrame:
    df = _table(spark, sf_dir, "events").select("event_id", *[F.when(F.col("event_id") % m != 0, F.col("value")).alias(f"v{m}") for m in (2, 3, 5)], F.col("value").alias("v0"))
    return ordered(df, "event_id", None, ["v2", "v3", "v5"])


_HOLES = "WITH e AS (SELECT event_id, CASE WHEN event_id % 2 <> 0 THEN value END AS v2, CASE WHEN event_id % 3 <> 0 THEN value END AS v3, CASE WHEN event_id % 5 <> 0 THEN value END AS v5, value AS v0 FROM events) SELECT {c} FROM e WHERE {w}"
_add("dropna_any", lambda s, d: _holes(s, d).dropna(), _HOLES.format(c="*", w="v2 IS NOT NULL AND v3 IS NOT NULL AND v5 IS NOT NULL"))
_add("dropna_all", lambda s, d: _holes(s, d).dropna(how="all"), _HOLES.format(c="*", w="coalesce(v2, v3, v5) IS NOT NULL"))
_add("dropna_thresh", lambda s, d: _holes(s, d).dropna(thresh=2), _HOLES.format(c="*", w="(v2 IS NOT NULL)::INT + (v3 IS NOT NULL)::INT + (v5 IS NOT NULL)::INT >= 2"))
_add("dropna_cols", lambda s, d: _holes(s, d).select("v2", "v3", "v5", "v0").dropna(axis=1), _HOLES.format(c="event_id, v0", w="true"))

# -------------------------------------------------------------- element-wise

for _name in ELEMENTWISE:
    _sql = {"log": "ln", "ceil": "ceil", "floor": "floor"}.get(_name, _name)
    _value = f"CASE WHEN x < 0 THEN NULL WHEN x = 0 THEN '-inf'::DOUBLE ELSE {_sql}(x) END" if _name.startswith("log") else "CASE WHEN x >= 0 THEN sqrt(x) END" if _name == "sqrt" else f"{_sql}(x)"
    _add(
        f"transform_{_name}",
        lambda s, d, n=_name: _shown(_events(s, d, F.col("value") / 100 - 0.5).transform(n), "event_id", 5),
        f"WITH ev AS (SELECT event_id, value / 100 - 0.5 AS x FROM events) SELECT event_id, round(({_value}) + 3.1e-8, 5) AS x FROM ev",
    )

# ------------------------------------------- frames without partitions, long

_EVO = "ORDER BY ts, event_id"


def _whole(spark: SparkSession, sf_dir: str) -> OrderedFrame:
    return ordered(_events(spark, sf_dir).df, ["ts", "event_id"], None, "x")


def _global(make, digits: int = 6) -> Query:
    return lambda s, d: _shown(make(_whole(s, d)), "event_id", digits)


def _global_sql(expression: str, frame: str, digits: int = 6) -> str:
    return f"WITH ev AS ({_EV}) SELECT event_id, round(({expression}) + 3.1e-8, {digits}) AS x FROM ev WINDOW w AS ({_EVO} {frame})"


for _name in ("cumsum", "cummin", "cummax"):
    _add(f"global_{_name}", _global(lambda f, n=_name: getattr(f, n)(), 4), _global_sql(f"CASE WHEN x IS NOT NULL THEN {_RUN[_name]} END", _GROW, 4))
_add("global_cumprod", lambda s, d: _shown(ordered(_events(s, d, F.when(F.col("event_id") % 7 != 0, 1 + F.col("value") / 1e8)).df, ["ts", "event_id"], None, "x").cumprod(), "event_id"), f"WITH ev AS (SELECT event_id, ts, CASE WHEN event_id % 7 <> 0 THEN 1 + value / 1e8 END AS x FROM events) SELECT event_id, round((CASE WHEN x IS NOT NULL THEN product(x) OVER ({_EVO} {_GROW}) END) + 3.1e-8, 6) AS x FROM ev")
_add("global_cumsum_skipna_false", _global(lambda f: f.cumsum(False), 4), _global_sql("CASE WHEN count(x) OVER w = count(*) OVER w THEN sum(x) OVER w END", _GROW, 4))
for _name, _sql in _STATS.items():
    if _name != "median":
        _add(f"global_expanding_{_name}", _global(lambda f, n=_name: getattr(f.expanding(3), n)(), 4), _global_sql(_gate(_sql, 3), _GROW, 4))
_add("global_expanding_count", _global(lambda f: f.expanding(3).count()), _global_sql(_gate("(count(x) OVER w)::DOUBLE", 3, _ROWS), _GROW))
_GLOBAL20 = "ROWS BETWEEN 19 PRECEDING AND CURRENT ROW"
for _name in ("mean", "sum", "std", "median"):
    _add(f"global_rolling_{_name}", _global(lambda f, n=_name: getattr(f.rolling(20, 5), n)(), 5), _global_sql(_gate(_STATS[_name], 5), _GLOBAL20, 5))
_add("global_rolling_mean_centered", _global(lambda f: f.rolling(7, 3, center=True).mean()), _global_sql(_gate(_STATS["mean"], 3), "ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING"))
_add("global_diff", _global(lambda f: f.diff(2)), _global_sql("x - lag(x, 2) OVER w", ""))
_add("global_shift", _global(lambda f: f.shift(-3)), _global_sql("lead(x, 3) OVER w", ""))
_add("global_pct_change", _global(lambda f: f.pct_change(1, None)), _global_sql("CASE WHEN lag(x) OVER w = 0 THEN CASE WHEN x = 0 THEN NULL WHEN x > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END ELSE (x - lag(x) OVER w) / lag(x) OVER w END", ""))
_add("global_ffill", _global(lambda f: f.ffill()), _global_sql("last_value(x IGNORE NULLS) OVER w", _GROW))
_add("global_bfill", _global(lambda f: f.bfill()), _global_sql("first_value(x IGNORE NULLS) OVER w", "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"))
# Weights of rows more than 300 back are below 1e-32 and change no digit.
_GEW = f"WITH ev AS (SELECT event_id, x, row_number() OVER ({_EVO}) AS rn FROM ({_EV})), k AS (SELECT * FROM ev WHERE x IS NOT NULL), m AS (SELECT a.event_id, sum(b.x * pow(1 - 2.0 / 9, a.rn - b.rn)) / sum(pow(1 - 2.0 / 9, a.rn - b.rn)) AS m FROM ev a JOIN k b ON b.rn BETWEEN a.rn - 300 AND a.rn GROUP BY a.event_id)"
_add("global_ewm_mean", _global(lambda f: f.ewm(span=8).mean()), _GEW + " SELECT ev.event_id, round(m + 3.1e-8, 6) AS x FROM ev LEFT JOIN m USING (event_id)")
_add(
    "global_ewm_std",
    _global(lambda f: f.ewm(span=8).std()),
    _GEW + ", v AS (SELECT a.event_id, CASE WHEN count(*) >= 2 THEN sqrt(sum(pow(1 - 2.0 / 9, a.rn - b.rn) * (b.x - m) * (b.x - m)) / sum(pow(1 - 2.0 / 9, a.rn - b.rn)) * pow(sum(pow(1 - 2.0 / 9, a.rn - b.rn)), 2) / (pow(sum(pow(1 - 2.0 / 9, a.rn - b.rn)), 2) - sum(pow(1 - 2.0 / 9, 2 * (a.rn - b.rn))))) END AS v FROM ev a JOIN m USING (event_id) JOIN k b ON b.rn BETWEEN a.rn - 300 AND a.rn GROUP BY a.event_id) SELECT ev.event_id, round(v + 3.1e-8, 6) AS x FROM ev LEFT JOIN v USING (event_id)",
)
_add(
    "global_ewm_mean_adjust_false",
    _global(lambda f: f.ewm(span=8, adjust=False, ignore_na=True).mean()),
    f"WITH RECURSIVE ev AS (SELECT event_id, x, row_number() OVER ({_EVO}) AS rn FROM ({_EV})), r AS (SELECT event_id, rn, x AS y FROM ev WHERE rn = 1 UNION ALL SELECT ev.event_id, ev.rn, CASE WHEN ev.x IS NULL THEN r.y WHEN r.y IS NULL THEN ev.x ELSE 2.0::DOUBLE / 9 * ev.x + (1 - 2.0::DOUBLE / 9) * r.y END FROM r JOIN ev ON ev.rn = r.rn + 1) SELECT event_id, round(y + 3.1e-8, 6) AS x FROM r",
)


def _long_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 columns as a long table: one partition for each column."""
    from strandline.sources import long_frame

    df = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x"))
    found = long_frame(df.withColumn("x", F.col("x").cast("double")), "vec_id", "dim", "x").rolling(20, 5).mean()
    return found.select("vec_id", "dim", F.round("x", 6).alias("x"))


_add(
    "long_rolling_mean",
    _long_layout,
    "WITH e AS (SELECT vec_id, (unnest(range(1, 65)) - 1)::INT AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT vec_id, dim, round(CASE WHEN count(v) OVER w >= 5 THEN avg(v) OVER w END, 6) AS x FROM e WINDOW w AS (PARTITION BY dim ORDER BY vec_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
