"""Queries over the benchmark tables, each with SQL that states its result independently.

Money and quantities are exact decimals, so sums don't depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ProgressiveError
from .session import ForeignKey, ProgressiveSession
from .sources.prepare import PARTITION, assign
from .streaming.state import new_folder
from .streaming.stepper import Snapshot

#: Partitions of the fact tables, and the expressions that deal them out.
P = 10
LINE_KEY = "l_orderkey + l_linenumber + l_partkey + l_suppkey"

LINEITEM = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS DECIMAL(12,2)) AS l_quantity,
    CAST(l_extendedprice AS DECIMAL(12,2)) AS l_extendedprice, CAST(l_discount AS DECIMAL(4,2)) AS l_discount,
    CAST(l_tax AS DECIMAL(4,2)) AS l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem"""
DATES = """SELECT o_orderkey AS d_orderkey, o_custkey AS d_custkey, CAST(year(o_orderdate) AS INT) AS d_year,
    CAST(month(o_orderdate) AS INT) AS d_month, CAST(weekofyear(o_orderdate) AS INT) AS d_week FROM orders"""
GEO = """SELECT {k} AS {p}_key, n_name AS {p}_nation, r_name AS {p}_region,
    concat(n_name, '_', CAST({k} % 3 AS VARCHAR(20))) AS {p}_city
    FROM {t}, nation, region WHERE {n} = n_nationkey AND n_regionkey = r_regionkey"""
CUSTOMER = GEO.format(k="c_custkey", p="c", t="customer", n="c_nationkey")
SUPPLIER = GEO.format(k="s_suppkey", p="s", t="supplier", n="s_nationkey")
PART = """SELECT p_partkey AS p_key, p_brand AS p_brand1, p_type AS p_category, CAST(p_retailprice AS DECIMAL(12,2)) AS p_price,
    concat('MFGR#', CAST(CAST(floor((CAST(substring(p_brand, 7) AS INT) - 1) / 5) AS INT) + 1 AS VARCHAR(20))) AS p_mfgr FROM part"""
EVENTS = """SELECT event_id, event_type, user_id, CAST(round(value * 100) AS BIGINT) AS cents,
    CAST(dayofweek(ts) AS INT) AS dow, CAST(hour(ts) AS INT) AS hr FROM events"""
#: Names that the queries use, and what they stand for.
TABLES = {"li": LINEITEM, "dim_date": DATES, "customer_geo": CUSTOMER, "supplier_geo": SUPPLIER, "part_dim": PART, "ev": EVENTS}
RAW = "region nation customer supplier part orders lineitem events".split()

REVENUE = "l_extendedprice * (1 - l_discount)"
PROFIT = "l_extendedprice * (1 - l_discount) - p_price * l_quantity * 0.6"
_STAR = {
    "d": ("dim_date", "l_orderkey = d_orderkey"),
    "p": ("part_dim", "l_partkey = p_key"),
    "s": ("supplier_geo", "l_suppkey = s_key"),
    "c": ("customer_geo", "d_custkey = c_key"),
}
#: Query: dimensions, measure, keys, filter, order.
SSB = {
    "1_1": ("d", "l_extendedprice * l_discount", "", "d_year = 1997 AND l_discount BETWEEN 0.01 AND 0.03 AND l_quantity < 25", ""),
    "1_2": ("d", "l_extendedprice * l_discount", "", "d_year = 1998 AND d_month = 1 AND l_discount BETWEEN 0.04 AND 0.06 AND l_quantity BETWEEN 26 AND 35", ""),
    "1_3": ("d", "l_extendedprice * l_discount", "", "d_week = 6 AND d_year = 1998 AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity BETWEEN 36 AND 40", ""),
    "2_1": ("dps", REVENUE, "d_year, p_brand1", "p_category = 'ECONOMY' AND s_region = 'AMERICA'", "d_year, p_brand1"),
    "2_2": ("dps", REVENUE, "d_year, p_brand1", "p_brand1 BETWEEN 'Brand#12' AND 'Brand#18' AND s_region = 'ASIA'", "d_year, p_brand1"),
    "2_3": ("dps", REVENUE, "d_year, p_brand1", "p_brand1 = 'Brand#21' AND s_region = 'EUROPE'", "d_year, p_brand1"),
    "3_1": ("dsc", REVENUE, "c_nation, s_nation, d_year", "c_region = 'ASIA' AND s_region = 'ASIA' AND d_year >= 1996 AND d_year <= 2000", "d_year ASC, revenue DESC"),
    "3_2": ("dsc", REVENUE, "c_city, s_city, d_year", "c_nation = 'NATION_1' AND s_nation = 'NATION_1' AND d_year >= 1996 AND d_year <= 2000", "d_year ASC, revenue DESC"),
    "3_3": ("dsc", REVENUE, "c_city, s_city, d_year", "(c_city = 'NATION_3_0' OR c_city = 'NATION_3_1') AND (s_city = 'NATION_3_0' OR s_city = 'NATION_3_1') AND d_year >= 1996 AND d_year <= 2000", "d_year ASC, revenue DESC"),
    "3_4": ("dsc", REVENUE, "c_city, s_city, d_year", "(c_city = 'NATION_3_0' OR c_city = 'NATION_3_1') AND (s_city = 'NATION_3_0' OR s_city = 'NATION_3_1') AND d_year = 1999", "d_year ASC, revenue DESC"),
    "4_1": ("dpsc", PROFIT, "d_year, c_nation", "c_region = 'AMERICA' AND s_region = 'AMERICA' AND (p_mfgr = 'MFGR#1' OR p_mfgr = 'MFGR#2')", "d_year, c_nation"),
    "4_2": ("dpsc", PROFIT, "d_year, s_nation, p_category", "c_region = 'AMERICA' AND s_region = 'AMERICA' AND (d_year = 1999 OR d_year = 2000) AND (p_mfgr = 'MFGR#1' OR p_mfgr = 'MFGR#2')", "d_year, s_nation, p_category"),
    "4_3": ("dpsc", PROFIT, "d_year, s_city, p_brand1", "c_region = 'AMERICA' AND s_nation = 'NATION_1' AND (d_year = 1999 OR d_year = 2000) AND p_category = 'LARGE'", "d_year, s_city, p_brand1"),
}
FLAT = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_extendedprice, p_price, d_year, d_month, d_week,
    p_brand1, p_category, p_mfgr, s_nation, s_region, s_city, c_nation, c_region, c_city
    FROM li, dim_date, part_dim, supplier_geo, customer_geo
    WHERE l_orderkey = d_orderkey AND l_partkey = p_key AND l_suppkey = s_key AND d_custkey = c_key"""

# --- sessions

_sessions: dict[tuple, ProgressiveSession] = {}
#: The session whose tables the views stand for.
_latest: list[tuple] = []


def session(spark: SparkSession, sf_dir: str, kind: str = "main") -> ProgressiveSession:
    """A session with the tables of ``sf_dir`` prepared; made once for each Spark application.

    ``main``: facts li, ev and flat, dimensions whole; ``product``: li in 3 and suppliers in 2 partitions;
    ``stored``: li in partitions that are written, for the mode that reads one after the other.
    """
    at = spark.sparkContext.applicationId, sf_dir, kind
    if at in _sessions:
        if _latest != [at]:  # the names stand for another session's tables
            for name, df in _sessions[at].tables.items():
                df.createOrReplaceTempView(name)
            _latest[:] = [at]
        return _sessions[at]
    for name in RAW:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    s = ProgressiveSession(spark)
    for name in RAW:
        s.register(name, spark.table(name))
    for name, text in TABLES.items():
        fks = [ForeignKey("l_suppkey", "supplier_geo", "s_key"), ForeignKey("l_partkey", "part_dim", "p_key")] if name == "li" else []
        s.register(name, spark.sql(text), fks)
    if kind == "product":
        s.prepare_table("li", partitions=3, strategy="expr", key=LINE_KEY)
        s.prepare_dimension("supplier_geo", partitions=2, strategy="expr", key="s_key")
    elif kind == "stored":
        s.prepare_table("li", partitions=P, strategy="expr", key=LINE_KEY, path=new_folder(spark, "prepared"))
    else:
        s.register("flat", spark.sql(FLAT))
        s.prepare_table("li", partitions=P, strategy="expr", key=LINE_KEY)
        s.prepare_table("ev", partitions=P, strategy="expr", key="event_id")
        s.prepare_table("flat", partitions=P, strategy="expr", key=LINE_KEY)
    _sessions[at] = s
    _latest[:] = [at]
    return s


# --- SQL that states the results

# Spark counts days of the week from 1, DuckDB from 0
_WITH = "".join(f"{name} AS ({text}), " for name, text in TABLES.items()) + f"flat AS ({FLAT})"
_WITH = _WITH.replace("dayofweek(ts)", "dayofweek(ts) + 1")


def _partial_sql(kind: str, argument: str, name: str) -> str:
    return f"{kind}({argument}) AS {name}"


def snapshots_sql(
    tables: str,
    where: str,
    keys: dict[str, str],
    shown: dict[str, str],
    states: dict[str, tuple[str, str]],
    step: str = f"({LINE_KEY}) % {P}",
    steps: int = P,
    rest: str = "",
    each: str = "q",
) -> str:
    """SQL of all snapshots: partial states by step, then every snapshot's states from the steps up to it.

    ``keys``: name and expression; ``states``: name, function and argument; ``shown``: output name and
    an expression over keys, states, ``snap`` and ``g`` (the progress).  ``each`` names the table shown.
    """
    names = list(keys)
    part = ", ".join([f"{step} AS k", *[f"{e} AS {n}" for n, e in keys.items()], *[_partial_sql(f, a, n) for n, (f, a) in states.items()]])
    group = ", ".join(["1", *[str(k + 2) for k in range(len(names))]])
    merged = ", ".join([*names, *[f"{'coalesce(sum(' + n + '), 0)' if f == 'count' else ('sum' if f == 'sum' else f) + '(' + n + ')'} AS {n}" for n, (f, _) in states.items()]])
    join = "JOIN" if keys else "LEFT JOIN"
    return f"""WITH {_WITH},
    p AS (SELECT {part} FROM {tables} {'WHERE ' + where if where else ''} GROUP BY {group}),
    steps AS (SELECT CAST(unnest(range(0, {steps})) AS INTEGER) AS snap),
    q AS (SELECT snap, (snap + 1)::DOUBLE / {steps}::DOUBLE AS g{', ' + merged if merged else ''} FROM steps {join} p ON p.k <= steps.snap
        GROUP BY snap{''.join(', ' + n for n in names)})
    SELECT {', '.join(f'{e} AS {n}' for n, e in shown.items())} FROM {each} {rest}"""


HALF = "{w}::DOUBLE * sqrt(1.0::DOUBLE / (2.0::DOUBLE * {n}::DOUBLE) * ln(2.0::DOUBLE / (1.0::DOUBLE - 0.95::DOUBLE)))"
SUM, COUNT, AVG = "{0}::DOUBLE / g", "{0}::DOUBLE / g", "CASE WHEN {1} > 0 THEN {0}::DOUBLE / {1}::DOUBLE END"
PART_NO = "CAST(snap + 1 AS INTEGER)"
QTY, PRICE = ("sum", "l_quantity"), ("sum", "l_extendedprice")
N, NQ = ("count", "*"), ("count", "l_quantity")

#: name -> (progressive SQL, SQL of its result)
SPECS: dict[str, tuple[str, str]] = {}


def _spec(name: str, text: str, **sql) -> None:  # noqa: ANN003
    SPECS[name] = f"SELECT PROGRESSIVE {text}", snapshots_sql(**{"tables": "li", "where": "", "keys": {}} | sql)


_F = {"l_returnflag": "l_returnflag"}
_spec("prog_avg_global", "avg(l_quantity) AS a, progressive_partition() AS part FROM li",
      states={"s": QTY, "n": NQ}, shown={"a": AVG.format("s", "n"), "part": PART_NO})
_spec("prog_sum_global", "sum(l_extendedprice) AS s, progressive_progress() AS g FROM li",
      states={"t": PRICE}, shown={"s": SUM.format("t"), "g": "g"})
_spec("prog_count_star", "count(*) AS n, progressive_partition() AS part FROM li",
      states={"c": N}, shown={"n": COUNT.format("c"), "part": PART_NO})
_spec("prog_count_col", "count(l_shipdate) AS n, l_linestatus FROM li GROUP BY l_linestatus",
      keys={"l_linestatus": "l_linestatus"}, states={"c": ("count", "l_shipdate")}, shown={"n": COUNT.format("c"), "l_linestatus": "l_linestatus"})
FLAGSHIP = ("avg(l_quantity) AS avg_qty, sum(l_extendedprice) AS sum_price, progressive_partition() AS part, progressive_progress() AS progress, "
            "progressive_confidence(l_quantity) AS conf, l_returnflag FROM li GROUP BY l_returnflag")  # fmt: skip
_WIDTH = "(SELECT CAST(max({0}) AS DOUBLE) - CAST(min({0}) AS DOUBLE) FROM li)"
_spec("prog_group_flag", FLAGSHIP, keys=_F, states={"s": QTY, "n": NQ, "t": PRICE},
      shown={"avg_qty": AVG.format("s", "n"), "sum_price": SUM.format("t"), "part": PART_NO, "progress": "g",
             "conf": HALF.format(w=_WIDTH.format("l_quantity"), n="n"), "l_returnflag": "l_returnflag"})
_spec("prog_confidence", "progressive_confidence(l_tax) AS conf, progressive_partition() AS part FROM li WHERE l_tax > 0.02",
      where="l_tax > 0.02", states={"n": ("count", "l_tax")}, shown={"conf": HALF.format(w=_WIDTH.format("l_tax"), n="n"), "part": PART_NO})
_spec("prog_confidence_group", "l_linestatus, avg(l_tax) AS a, progressive_confidence(l_tax) AS conf FROM li GROUP BY l_linestatus",
      keys={"l_linestatus": "l_linestatus"}, states={"s": ("sum", "l_tax"), "n": ("count", "l_tax")},
      shown={"l_linestatus": "l_linestatus", "a": AVG.format("s", "n"), "conf": HALF.format(w=_WIDTH.format("l_tax"), n="n")})
_spec("prog_partition_progress", "progressive_partition() AS part, progressive_progress() AS progress, count(*) AS n FROM li",
      states={"c": N}, shown={"part": PART_NO, "progress": "g", "n": COUNT.format("c")})
_spec("prog_expr_arg", f"sum({REVENUE}) AS revenue, progressive_partition() AS part FROM li",
      states={"t": ("sum", REVENUE)}, shown={"revenue": SUM.format("t"), "part": PART_NO})
_spec("prog_alias_literal", "'fixed' AS tag, 7 AS seven, l_returnflag AS flag, count(*) AS n FROM li GROUP BY l_returnflag",
      keys=_F, states={"c": N}, shown={"tag": "'fixed'", "seven": "7", "flag": "l_returnflag", "n": COUNT.format("c")})
_spec("prog_expr_key", "year(l_shipdate) AS y, count(*) AS n FROM li GROUP BY year(l_shipdate)",
      keys={"y": "CAST(year(l_shipdate) AS INTEGER)"}, states={"c": N}, shown={"y": "y", "n": COUNT.format("c")})
_spec("prog_distinct_cols", "l_returnflag, l_linestatus FROM li",
      keys={"l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus"}, states={}, shown={"l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus"})
_spec("prog_min_max", "min(l_shipdate) AS low, max(l_extendedprice) AS high, l_returnflag FROM li GROUP BY l_returnflag",
      keys=_F, states={"a": ("min", "l_shipdate"), "b": ("max", "l_extendedprice")}, shown={"low": "a", "high": "b", "l_returnflag": "l_returnflag"})
# few values: the sketch is exact
SPECS["prog_approx_distinct"] = (
    "SELECT PROGRESSIVE l_returnflag, approx_count_distinct(l_linenumber) AS lines, approx_count_distinct(CAST(l_tax * 100 AS INT)) AS taxes, progressive_partition() AS part FROM li GROUP BY l_returnflag",
    f"""WITH {_WITH}, steps AS (SELECT CAST(unnest(range(0, {P})) AS INTEGER) AS snap)
    SELECT l_returnflag, count(DISTINCT l_linenumber) AS lines, count(DISTINCT l_tax) AS taxes, snap + 1 AS part FROM steps JOIN li ON ({LINE_KEY}) % {P} <= snap GROUP BY snap, l_returnflag""",
)
for _n, _w, _dw in [
    ("where", "l_quantity < 24 AND l_discount >= 0.05", ""),
    ("where_in", "l_returnflag IN ('A', 'N') AND l_linenumber NOT IN (1, 2)", ""),
    ("where_between", "l_quantity BETWEEN 10 AND 20 AND l_tax NOT BETWEEN 0.02 AND 0.04", ""),
    ("where_like", "l_returnflag LIKE 'A%' OR l_linestatus NOT LIKE '%F%'", ""),
    ("where_not", "NOT (l_returnflag = 'A' OR l_quantity > 30)", ""),
    ("where_isnull", "l_returnflag IS NOT NULL AND (l_linestatus IS NULL OR l_tax IS NOT NULL)", ""),
    ("where_case", "CASE WHEN l_quantity > 25 THEN l_tax ELSE l_discount END > 0.04", ""),
    ("where_regexp", "l_returnflag RLIKE '^(A|R)$'", "regexp_matches(l_returnflag, '^(A|R)$')"),
    ("where_symmetric", "l_quantity BETWEEN SYMMETRIC 20 AND 10 AND l_tax NOT BETWEEN ASYMMETRIC 0.05 AND 0.01", "l_quantity BETWEEN 10 AND 20"),
    ("where_similar", "l_returnflag SIMILAR TO '(A|R)%' AND l_linestatus NOT SIMILAR TO 'F_+'", "regexp_matches(l_returnflag, '^(A|R).*$') AND NOT regexp_matches(l_linestatus, '^F.+$')"),
    ("where_any_list", "l_linenumber = ANY (1, 3, 5) AND l_quantity > ALL (5, 10)", "l_linenumber IN (1, 3, 5) AND l_quantity > 10"),
    ("where_any_query", "l_quantity > SOME (SELECT l_quantity + 20 FROM li) AND l_suppkey <> ALL (SELECT s_key FROM supplier_geo WHERE s_region = 'ASIA')", "l_quantity > (SELECT min(l_quantity) + 20 FROM li) AND l_suppkey NOT IN (SELECT s_key FROM supplier_geo WHERE s_region = 'ASIA')"),
    ("where_all_null", "l_quantity > ALL (SELECT nullif(n_nationkey, 3) FROM nation WHERE n_nationkey < 6) OR l_linenumber = 1 AND l_quantity > ALL (SELECT n_nationkey FROM nation WHERE n_nationkey < 6) OR l_linenumber = 2 AND l_tax <> ALL (SELECT n_regionkey FROM nation WHERE n_nationkey < 0)", "l_linenumber = 1 AND l_quantity > 5 OR l_linenumber = 2"),
    ("where_any_null", "l_linenumber < 3 AND l_quantity < ANY (SELECT nullif(n_nationkey, 3) FROM nation) OR l_linenumber = 3 AND NOT (l_quantity > SOME (SELECT nullif(n_nationkey, 0) FROM nation)) OR l_linenumber = 4 AND NOT (l_quantity >= SOME (SELECT n_nationkey + 20 FROM nation))", "l_linenumber < 3 AND l_quantity < 24 OR l_linenumber = 4 AND l_quantity < 20"),
    ("where_like_escape", "l_returnflag NOT LIKE '!_' ESCAPE '!' AND l_linestatus LIKE 'F' ESCAPE '!'", "l_linestatus = 'F'"),
    ("where_difference", "(l_shipdate - TIMESTAMP '1995-01-01 00:00:00') DAY >= INTERVAL '500' DAY AND (l_shipdate - TIMESTAMP '1995-01-01 00:00:00') YEAR < INTERVAL '3' YEAR", "l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' + INTERVAL 500 DAY AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00'"),
    ("where_field", "named_struct('q', l_quantity, 't', l_tax).q > 30", "l_quantity > 30"),
    ("where_row", "ROW(l_linenumber, l_returnflag) = ROW(1, 'A')", "l_linenumber = 1 AND l_returnflag = 'A'"),
    ("where_interval", "l_shipdate + INTERVAL 30 DAYS > TIMESTAMP '1998-09-02 00:00:00'", "l_shipdate + INTERVAL 30 DAY > TIMESTAMP '1998-09-02 00:00:00'"),
    ("where_item", "array(l_quantity, l_tax)[1] > 0.03", "l_tax > 0.03"),
    ("in_subquery", "l_partkey IN (SELECT p_key FROM part_dim WHERE p_category = 'PROMO')", ""),
    ("not_in_subquery", "l_suppkey NOT IN (SELECT s_key FROM supplier_geo WHERE s_region = 'ASIA')", ""),
    ("exists_any", "l_quantity > (SELECT min(l_quantity) + 20 FROM li)", ""),
]:
    _spec(f"prog_{_n}", f"sum(l_quantity) AS q, count(*) AS n, progressive_partition() AS part FROM li WHERE {_w}",
          where=_dw or _w, states={"s": QTY, "c": N}, shown={"q": SUM.format("s"), "n": COUNT.format("c"), "part": PART_NO})
_spec("prog_having_snapshot", "l_linenumber, sum(l_quantity) AS q FROM li GROUP BY l_linenumber HAVING count(*) > 1000 AND avg(l_quantity) > 20",
      keys={"l_linenumber": "l_linenumber"}, states={"s": QTY, "n": NQ, "c": N}, shown={"l_linenumber": "l_linenumber", "q": SUM.format("s")},
      rest="WHERE c::DOUBLE / g > 1000 AND s::DOUBLE / n::DOUBLE > 20")
_spec("prog_order_topk", "l_linenumber, sum(l_quantity) AS q, progressive_partition() AS part FROM li GROUP BY l_linenumber ORDER BY q DESC, l_linenumber LIMIT 3 OFFSET 1",
      keys={"l_linenumber": "l_linenumber"}, states={"s": QTY}, shown={"l_linenumber": "l_linenumber", "q": "q", "part": PART_NO},
      each="(SELECT *, s::DOUBLE / g AS q, row_number() OVER (PARTITION BY snap ORDER BY s::DOUBLE / g DESC, l_linenumber) AS r FROM q)", rest="WHERE r BETWEEN 2 AND 4")
_spec("prog_rollup", "l_returnflag, l_linestatus, count(*) AS n FROM li GROUP BY ROLLUP (l_returnflag, l_linestatus)",
      keys={"a": "l_returnflag", "b": "l_linestatus"}, states={"c": N}, shown={"l_returnflag": "a", "l_linestatus": "b", "n": "n"},
      each="(SELECT snap, a, b, sum(c)::DOUBLE / any_value(g) AS n FROM q GROUP BY GROUPING SETS ((snap, a, b), (snap, a), (snap)))")
_spec("prog_cube", "l_returnflag, l_linestatus, count(*) AS n FROM li GROUP BY CUBE (l_returnflag, l_linestatus)",
      keys={"a": "l_returnflag", "b": "l_linestatus"}, states={"c": N}, shown={"l_returnflag": "a", "l_linestatus": "b", "n": "n"},
      each="(SELECT snap, a, b, sum(c)::DOUBLE / any_value(g) AS n FROM q GROUP BY GROUPING SETS ((snap, a, b), (snap, a), (snap, b), (snap)))")


_spec("prog_grouping_sets", "l_returnflag, l_linestatus, count(*) AS n FROM li GROUP BY GROUPING SETS ((l_linestatus), (l_returnflag, l_linestatus))",
      keys={"a": "l_returnflag", "b": "l_linestatus"}, states={"c": N}, shown={"l_returnflag": "a", "l_linestatus": "b", "n": "n"},
      each="(SELECT snap, a, b, sum(c)::DOUBLE / any_value(g) AS n FROM q GROUP BY GROUPING SETS ((snap, a, b), (snap, b)))")
for _n in ("DISTINCT", "ALL", "STREAM"):
    _spec(f"prog_word_{_n.lower()}", f"{_n} l_linestatus FROM li WHERE l_tax > 0.01", where="l_tax > 0.01",
          keys={"l_linestatus": "l_linestatus"}, states={}, shown={"l_linestatus": "l_linestatus"})


def _star(dims: str, where: str) -> tuple[str, str]:
    return ", ".join(["li", *[_STAR[d][0] for d in dims]]), " AND ".join([*[_STAR[d][1] for d in dims], where])


for _n, _d, _k, _w in [
    ("join_2way", "d", "d_year", "l_tax > 0.01"),
    ("join_3way", "dp", "p_category", "d_year >= 1996"),
    ("join_4way", "dps", "s_region", "p_mfgr <> 'MFGR#3'"),
]:
    _t, _c = _star(_d, _w)
    _spec(f"prog_{_n}", f"sum({REVENUE}) AS revenue, {_k}, progressive_partition() AS part FROM {_t} WHERE {_c} GROUP BY {_k}",
          tables=_t, where=_c, keys={_k: _k}, states={"t": ("sum", REVENUE)}, shown={"revenue": SUM.format("t"), _k: _k, "part": PART_NO})
_spec("prog_join_on", "count(*) AS n, p_category FROM li JOIN part_dim ON l_partkey = p_key WHERE l_tax > 0.03 GROUP BY p_category",
      tables="li, part_dim", where="l_partkey = p_key AND l_tax > 0.03", keys={"p_category": "p_category"}, states={"c": N}, shown={"n": COUNT.format("c"), "p_category": "p_category"})
_spec("prog_join_theta", "count(*) AS n, r_name FROM li, region WHERE l_linenumber > r_regionkey AND l_quantity < 5 GROUP BY r_name",
      tables="li, region", where="l_linenumber > r_regionkey AND l_quantity < 5", keys={"r_name": "r_name"}, states={"c": N}, shown={"n": COUNT.format("c"), "r_name": "r_name"})
_spec("prog_join_self", "sum(l_quantity) AS q, b.s_nation AS nation FROM li, supplier_geo AS a, supplier_geo AS b WHERE l_suppkey = a.s_key AND a.s_nation = b.s_nation AND b.s_city LIKE '%1' GROUP BY b.s_nation",
      tables="li, supplier_geo AS a, supplier_geo AS b", where="l_suppkey = a.s_key AND a.s_nation = b.s_nation AND b.s_city LIKE '%1'", keys={"nation": "b.s_nation"},
      states={"s": QTY}, shown={"q": SUM.format("s"), "nation": "nation"})
_spec("prog_join_product", "sum(l_quantity) AS q, s_region, progressive_partition() AS part FROM li, supplier_geo WHERE l_suppkey = s_key GROUP BY s_region",
      tables="li, supplier_geo", where="l_suppkey = s_key", keys={"s_region": "s_region"}, states={"s": QTY}, step=f"({LINE_KEY}) % 3 + 3 * (s_key % 2)", steps=6,
      shown={"q": SUM.format("s"), "s_region": "s_region", "part": PART_NO})
for _n, (_d, _m, _k, _w, _o) in SSB.items():
    _t, _c = _star(_d, _w)
    _names = [k.strip() for k in _k.split(",") if k]
    _front = ", ".join(_t.split(", ")[1:] + ["li"]) if _n[0] == "4" else _t  # the fact table comes last there
    _tail = (f" GROUP BY {_k}" if _k else "") + (f" ORDER BY {_o}" if _o else "")
    _cols = ", ".join([f"sum({_m}) AS revenue", *_names])
    _ids = {k: k for k in _names}
    _spec(f"ssb_q{_n}", f"{_cols}, progressive_partition() AS part FROM {_front} WHERE {_c}{_tail}",
          tables=_t, where=_c, keys=_ids, states={"t": ("sum", _m)}, shown={"revenue": SUM.format("t"), "part": PART_NO} | _ids)
    _fw = _w.replace("BETWEEN 36 AND 40", "BETWEEN 26 AND 35")
    _spec(f"ssbflat_q{_n}", f"{_cols} FROM flat WHERE {_fw}{_tail}",
          tables="flat", where=_fw, keys=_ids, states={"t": ("sum", _m)}, shown={"revenue": SUM.format("t")} | _ids)
#: Queries of which only the last snapshot is taken.
FINAL = {"final_exact"}
SPECS["final_exact"] = (
    "SELECT PROGRESSIVE l_returnflag, l_linestatus, sum(l_quantity) AS q, avg(l_extendedprice) AS a, count(*) AS n FROM li GROUP BY l_returnflag, l_linestatus",
    f"WITH {_WITH} SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS q, sum(l_extendedprice)::DOUBLE / count(l_extendedprice)::DOUBLE AS a, count(*)::DOUBLE AS n FROM li GROUP BY ALL",
)
_EV = {"tables": "ev", "step": f"event_id % {P}", "states": {"s": ("sum", "cents"), "n": ("count", "cents")}}
_EW = "(SELECT CAST(max(cents) AS DOUBLE) - CAST(min(cents) AS DOUBLE) FROM ev)"
_spec("demo_origin", "event_type, avg(cents) AS a, progressive_partition() AS part, progressive_progress() AS g, progressive_confidence(cents) AS conf FROM ev GROUP BY event_type",
      **_EV, keys={"event_type": "event_type"}, shown={"event_type": "event_type", "a": AVG.format("s", "n"), "part": PART_NO, "g": "g", "conf": HALF.format(w=_EW, n="n")})
_spec("demo_time", "dow, avg(cents) AS a, progressive_confidence(cents) AS conf FROM ev GROUP BY dow ORDER BY dow",
      **_EV, keys={"dow": "dow"}, shown={"dow": "dow", "a": AVG.format("s", "n"), "conf": HALF.format(w=_EW, n="n")})

# --- views: definition, read, SQL of the read

VIEWS: dict[str, tuple[str, str, str]] = {}


def _view(name: str, define: str, read: str, **sql) -> None:  # noqa: ANN003
    VIEWS[name] = define, f"SELECT PROGRESSIVE {read}", snapshots_sql(**{"tables": "li", "where": "", "keys": {}} | sql)


_G2 = "sum(l_quantity) AS q, count(*) AS n, progressive_partition() AS part, l_returnflag FUTURE, l_linestatus FUTURE FROM li GROUP BY l_returnflag FUTURE, l_linestatus FUTURE"
_GS = {"states": {"s": QTY, "c": N}}
_GSHOW = {"q": SUM.format("s"), "n": COUNT.format("c"), "part": PART_NO}
_view("view_future_group_default", _G2, "* FROM {v}", **_GS, shown=_GSHOW)
_view("view_future_group_one", _G2, "* FROM {v} WITH FUTURE GROUP BY l_returnflag", **_GS, keys=_F, shown=_GSHOW | _F)
_FL = _F | {"l_linestatus": "l_linestatus"}
_view("view_future_group_two", _G2, "* FROM {v} WITH FUTURE GROUP BY l_returnflag, l_linestatus", **_GS, keys=_FL, shown=_GSHOW | _FL)
for _n, _def, _act, _w in [
    ("none", "(l_returnflag = 'A') FUTURE", "", ""),
    ("one", "(l_returnflag = 'A') FUTURE", "l_returnflag = 'A'", "l_returnflag = 'A'"),
    ("two_or", "(l_returnflag = 'A') FUTURE OR (l_linestatus = 'F') FUTURE", "l_returnflag = 'A', l_linestatus = 'F'", "l_returnflag = 'A' OR l_linestatus = 'F'"),
    ("two_and", "(l_returnflag = 'A') FUTURE AND (l_quantity > 10) FUTURE", "l_returnflag = 'A', l_quantity > 10", "l_returnflag = 'A' AND l_quantity > 10"),
    ("mixed_and", "(l_returnflag = 'A') FUTURE AND l_quantity > 10", "l_returnflag = 'A'", "l_returnflag = 'A' AND l_quantity > 10"),
    ("mixed_or", "(l_returnflag = 'A') FUTURE OR l_quantity > 40", "", "l_quantity > 40"),
    ("mixed_or_active", "(l_returnflag = 'A') FUTURE OR l_quantity > 40", "l_returnflag = 'A'", "l_returnflag = 'A' OR l_quantity > 40"),
    ("compound", "(l_returnflag = 'A' OR l_tax > 0.05) FUTURE AND (l_quantity BETWEEN 5 AND 30) FUTURE", "l_returnflag = 'A' OR l_tax > 0.05", "l_returnflag = 'A' OR l_tax > 0.05"),
    ("compound_or", "(l_returnflag = 'A') FUTURE OR (l_quantity > 10 AND l_tax > 0.05)", "l_returnflag = 'A'", "l_returnflag = 'A' OR (l_quantity > 10 AND l_tax > 0.05)"),
    ("equivalent", "(l_quantity > 10) FUTURE", "10 < L_QUANTITY", "l_quantity > 10"),
]:
    _with = f" WITH FUTURE WHERE {_act}" if _act else ""
    _view(f"view_future_where_{_n}", f"sum(l_quantity) AS q, count(*) AS n, progressive_partition() AS part FROM li WHERE {_def}", f"* FROM {{v}}{_with}",
          **_GS, where=_w, shown=_GSHOW)
_view("view_future_where_group", "l_linestatus, avg(l_quantity) AS a, progressive_confidence(l_quantity) AS conf FROM li WHERE (l_returnflag = 'A') FUTURE GROUP BY l_linestatus",
      "* FROM {v} WITH FUTURE WHERE l_returnflag = 'A'", where="l_returnflag = 'A'", keys={"l_linestatus": "l_linestatus"}, states={"s": QTY, "n": NQ},
      shown={"l_linestatus": "l_linestatus", "a": AVG.format("s", "n"), "conf": HALF.format(w=_WIDTH.format("l_quantity"), n="n")})
_OUT = "l_linenumber, l_returnflag, sum(l_quantity) AS q, count(*) AS n FROM li GROUP BY l_linenumber, l_returnflag"
_OUTQ = {"keys": {"l_linenumber": "l_linenumber", "l_returnflag": "l_returnflag"}, "states": {"s": QTY, "c": N}}
_view("view_outer_sql", _OUT, "l_returnflag, max(q) AS top, count(*) AS lines, progressive_partition() AS part FROM {v} WHERE l_linenumber <= 5 GROUP BY l_returnflag HAVING max(q) > 100 ORDER BY top DESC",
      **_OUTQ, each="(SELECT snap, l_returnflag, max(s::DOUBLE / g) AS top, count(*) AS lines FROM q WHERE l_linenumber <= 5 GROUP BY ALL)", rest="WHERE top > 100",
      shown={"l_returnflag": "l_returnflag", "top": "top", "lines": "lines", "part": PART_NO})
_view("view_outer_window", _OUT, "l_linenumber, l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY q DESC, l_linenumber) AS r, q FROM {v}",
      **_OUTQ, shown={"l_linenumber": "l_linenumber", "l_returnflag": "l_returnflag", "r": "CAST(rank() OVER (PARTITION BY snap, l_returnflag ORDER BY s::DOUBLE / g DESC, l_linenumber) AS INTEGER)", "q": SUM.format("s")})
_view("view_outer_topk", _OUT, "l_linenumber, l_returnflag, n FROM {v} ORDER BY q DESC, l_linenumber, l_returnflag LIMIT 4",
      **_OUTQ, each="(SELECT *, row_number() OVER (PARTITION BY snap ORDER BY s::DOUBLE / g DESC, l_linenumber, l_returnflag) AS r FROM q)", rest="WHERE r <= 4",
      shown={"l_linenumber": "l_linenumber", "l_returnflag": "l_returnflag", "n": COUNT.format("c")})
_view("view_columns", "l_returnflag, count(*) FROM li GROUP BY l_returnflag", "flag, total FROM {v} WHERE flag <> 'R'",
      keys=_F, states={"c": N}, rest="WHERE l_returnflag <> 'R'", shown={"flag": "l_returnflag", "total": COUNT.format("c")})
_view("view_ordered", "l_linenumber, count(*) AS n FROM li GROUP BY l_linenumber ORDER BY n DESC", "l_linenumber, n FROM {v} ORDER BY l_linenumber",
      keys={"l_linenumber": "l_linenumber"}, states={"c": N}, shown={"l_linenumber": "l_linenumber", "n": COUNT.format("c")})
_TYPES = ["click", "error", "purchase", "signup", "view"]
_view("demo_view_origin", "avg(cents) AS a, event_type FROM ev WHERE " + " OR ".join(f"(event_type = '{t}') FUTURE" for t in _TYPES) + " GROUP BY event_type",
      "* FROM {v} WITH FUTURE WHERE event_type = 'click', event_type = 'view'", **_EV, where="event_type IN ('click', 'view')",
      keys={"event_type": "event_type"}, shown={"a": AVG.format("s", "n"), "event_type": "event_type"})
_view("demo_view_time", "avg(cents) AS a, dow FUTURE, hr FUTURE FROM ev WHERE " + " AND ".join(f"(event_type <> '{t}') FUTURE" for t in _TYPES) + " GROUP BY dow FUTURE, hr FUTURE",
      "* FROM {v} WITH FUTURE WHERE event_type <> 'error' WITH FUTURE GROUP BY dow", **_EV, where="event_type <> 'error'",
      keys={"dow": "dow"}, shown={"a": AVG.format("s", "n"), "dow": "dow"})

# nine groups of twelve predicates, of which some groups are switched on in part, and 39 predicates that all hold for most rows
_WIDE = [f"(hr * {a} + dow * {b}) % 12" for a, b in ((1, 0), (1, 1), (5, 2), (0, 1), (7, 3), (1, 5), (11, 1), (5, 7), (1, 11))]
_ON = {0: (1, 2, 3, 8), 3: (0, 5, 6), 8: (2, 4, 9, 11, 1, 0)}
_view("demo_view_and_of_ors", "avg(cents) AS a, count(*) AS n FROM ev WHERE " + " AND ".join("(" + " OR ".join(f"({e} = {k}) FUTURE" for k in range(12)) + ")" for e in _WIDE),
      "* FROM {v} WITH FUTURE WHERE " + ", ".join(f"{_WIDE[j]} = {k}" for j, ks in _ON.items() for k in ks), tables="ev", step=f"event_id % {P}",
      states={"s": ("sum", "cents"), "n": ("count", "cents"), "c": N}, where=" AND ".join(f"{_WIDE[j]} IN ({', '.join(map(str, ks))})" for j, ks in _ON.items()),
      shown={"a": AVG.format("s", "n"), "n": COUNT.format("c")})
_MANY = [*[f"hr <> {k}" for k in range(24)], *[f"dow <> {k}" for k in range(1, 8)], *[f"event_type <> '{t}'" for t in _TYPES], "cents > 100", "cents < 9000", "user_id % 3 < 2"]
_view("demo_view_39_ands", "avg(cents) AS a, dow FUTURE, event_type FUTURE FROM ev WHERE " + " AND ".join(f"({p}) FUTURE" for p in _MANY) + " GROUP BY dow FUTURE, event_type FUTURE",
      "* FROM {v} WITH FUTURE WHERE " + ", ".join(_MANY[3:39:5]) + " WITH FUTURE GROUP BY dow, event_type", **_EV, where=" AND ".join(_MANY[3:39:5]),
      keys={"dow": "dow", "event_type": "event_type"}, shown={"a": AVG.format("s", "n"), "dow": "dow", "event_type": "event_type"})

#: Plain SQL that is passed through.
PLAIN = {
    "passthrough_sql": "SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag",
    "setops_union": "SELECT n_name AS name FROM nation UNION SELECT r_name AS name FROM region",
    "setops_intersect": "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0",
    "setops_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000",
    "native_partition": "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_id % 10 = 3 GROUP BY event_type",
}

# --- registered functions


def _progressive(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = session(spark, sf_dir, "product" if name == "prog_join_product" else "main").sql(SPECS[name][0])
        return result.final(ordered=False) if name in FINAL else result.batch(ordered=False)

    return query


def _view_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        s, (define, read, _) = session(spark, sf_dir), VIEWS[name]
        columns = " (flag, total)" if name == "view_columns" else ""
        s.sql(f"CREATE OR REPLACE PROGRESSIVE VIEW v_{name}{columns} AS SELECT {define}")
        return s.sql(read.format(v=f"v_{name}")).batch(ordered=False)

    return query


def prepare_partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).catalog.partitions_df(spark).where("src_table = 'li'")


def prepare_column_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).catalog.columns_df(spark).where("`table` = 'li'").withColumnsRenamed({"min": "low", "max": "high", "table": "of"})


def prepare_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return assign(orders, 7, "round_robin", "o_orderkey").select("o_orderkey", F.col(PARTITION).alias("part"))


def prepare_fk_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ProgressiveSession(spark)
    tables = session(spark, sf_dir).tables
    for name in ("supplier_geo", "part_dim"):
        s.register(name, tables[name])
    s.register("li", tables["li"], session(spark, sf_dir).foreign_keys["li"])
    s.prepare_table("li", partition_size=1000, with_foreign_tables=True)
    return s.catalog.partitions_df(spark).groupBy("src_table", "fact").agg(F.count(F.lit(1)).alias("parts"), F.sum("entries").alias("total"))


def _streamed(spark: SparkSession, sf_dir: str, partitions: int, key: str) -> list[Snapshot]:
    s = ProgressiveSession(spark)
    s.register("li", session(spark, sf_dir).tables["li"])
    path = new_folder(spark, "prepared")
    s.prepare_table("li", partitions=partitions, strategy="expr", key=key, path=path)
    return list(s.sql(SPECS["final_exact"][0]).stream(path))


def stream_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last snapshot of a file stream over the prepared table."""
    return _streamed(spark, sf_dir, 4, LINE_KEY)[-1].df


def stream_empty_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where four of six partitions are empty."""
    return _streamed(spark, sf_dir, 6, "3 * l_linenumber")[-1].df


def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partition, progress and number of groups of each snapshot of the stream."""
    shots = _streamed(spark, sf_dir, 4, LINE_KEY)
    return spark.createDataFrame([(x.partition, x.progress, x.df.count()) for x in shots], "part int, progress double, n_groups long")


def iterate_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All snapshots of the flagship query, each from a job of its own."""
    shots = [x.df for x in session(spark, sf_dir, "stored").sql(SPECS["prog_group_flag"][0]).snapshots()]
    out = shots[0]
    for df in shots[1:]:
        out = out.unionByName(df)
    return out


def view_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All snapshots of a running view: those before a reader came from the view, the others as it follows."""
    s, (define, read, _) = session(spark, sf_dir, "stored"), VIEWS["view_future_group_one"]
    s.sql(f"CREATE OR REPLACE PROGRESSIVE VIEW v_live AS SELECT {define}")
    reader = s.sql(read.format(v="v_live"))
    shots = list(reader.snapshots())
    out = reader.batch(ordered=False).where(f"part < {shots[0].partition}")
    for x in shots:
        out = out.unionByName(x.df)
    return out


OTHER: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "prepare_partition_counts": (prepare_partition_counts, f"""WITH {_WITH} SELECT 'li' AS src_table, 'li_partition_' || ({LINE_KEY}) % {P} AS table_name,
        CAST(({LINE_KEY}) % {P} AS INTEGER) AS id, count(*) AS entries, true AS fact FROM li GROUP BY ALL"""),
    "prepare_column_bounds": (prepare_column_bounds, f"WITH {_WITH} " + " UNION ALL ".join(
        f"SELECT 'li' AS of, '{c}' AS name, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high FROM li"
        for c in "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split())),
    "prepare_round_robin": (prepare_round_robin, "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 7 AS INTEGER) AS part FROM orders"),
    "prepare_fk_tables": (prepare_fk_tables, """SELECT 'li' AS src_table, true AS fact, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS parts, count(*) AS total FROM lineitem
        UNION ALL SELECT 'supplier_geo', false, CAST(ceil(count(*) / 1000.0) AS BIGINT), count(*) FROM supplier
        UNION ALL SELECT 'part_dim', false, CAST(ceil(count(*) / 1000.0) AS BIGINT), count(*) FROM part"""),
    "stream_final": (stream_final, SPECS["final_exact"][1]),
    "stream_empty_partitions": (stream_empty_partitions, SPECS["final_exact"][1]),
    "stream_progress": (stream_progress, f"""WITH {_WITH}, g AS (SELECT DISTINCT ({LINE_KEY}) % 4 AS k, l_returnflag, l_linestatus FROM li)
        SELECT CAST(p AS INTEGER) AS part, p::DOUBLE / 4 AS progress, (SELECT count(DISTINCT (l_returnflag, l_linestatus)) FROM g) AS n_groups FROM range(1, 5) t(p)"""),
    "iterate_steps": (iterate_steps, SPECS["prog_group_flag"][1]),
    "view_live": (view_live, VIEWS["view_future_group_one"][2]),
}


def _plain(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = session(spark, sf_dir).sql(text)
        if not isinstance(out, DataFrame):
            raise ProgressiveError("plain SQL is expected")
        return out

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return (
        {name: _progressive(name) for name in SPECS}
        | {name: _view_query(name) for name in VIEWS}
        | {name: f for name, (f, _) in OTHER.items()}
        | {name: _plain(text) for name, text in PLAIN.items()}
    )


def oracle_sql() -> dict[str, str]:
    return (
        {name: sql for name, (_, sql) in SPECS.items()}
        | {name: sql for name, (_, _, sql) in VIEWS.items()}
        | {name: sql for name, (_, sql) in OTHER.items() if sql}
        | PLAIN
    )
