"""The engine against a brute-force model: tables, snapshots and views computed row by row in Python."""

import json
import logging
import math
import random

import pytest

from stepwise.errors import ProgressiveError
from stepwise.session import ForeignKey, ProgressiveSession
from stepwise.sources.catalog import Catalog
from stepwise.sources.files import read_delimited, read_jdbc, report_lines, write_jdbc, write_results
from stepwise.sources.prepare import calibrate_partition_size, partition_count, two_digits

SCHEMA = "trip int, city string, km int, fare int, rider string"
PARTS = 3


def _trips():
    r = random.Random(17)
    cities = ["Oslo", "Lima", "Pune", None]
    return [(k, r.choice(cities), r.choice([None, *range(1, 30)]), r.randrange(5, 400), f"r{r.randrange(6)}") for k in range(41)]


TRIPS = _trips()
BOUNDS = {c: (min(v), max(v)) for c, v in ((c, [t[k] for t in TRIPS if t[k] is not None]) for k, c in ((2, "km"), (3, "fare")))}


@pytest.fixture(scope="module")
def s(spark):
    out = ProgressiveSession(spark)
    out.register("trips", spark.createDataFrame(TRIPS, SCHEMA).repartition(2))
    out.prepare_table("trips", partitions=PARTS, strategy="expr", key="trip")
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def record(trip):
    return dict(zip(("trip", "city", "km", "fare", "rider"), trip, strict=True))


def brute(keys, values, where=lambda t: True, steps=range(PARTS), having=lambda g: True):
    """Rows of all snapshots.  ``values``: (function, column) pairs, or part and progress."""
    out = []
    for step in steps:
        seen = [record(t) for t in TRIPS if t[0] % PARTS <= step]
        progress = (step + 1) / PARTS
        groups = {} if keys else {(): []}
        for t in seen:
            if where(t):
                groups.setdefault(tuple(t[k] for k in keys), []).append(t)
        for key, members in groups.items():
            if not having(members):
                continue
            row = []
            for kind, column in values:
                known = [1 if column in ("*", "") else t[column] for t in members if column in ("*", "") or t[column] is not None]
                row.append(
                    {
                        "sum": lambda k: sum(k) / progress if k else None,
                        "count": lambda k: len(k) / progress,
                        "avg": lambda k: sum(k) / len(k) if k else None,
                        "min": lambda k: min(k, default=None),
                        "max": lambda k: max(k, default=None),
                        "part": lambda k: step + 1,
                        "progress": lambda k: progress,
                        "confidence": lambda k: math.inf if not k else (BOUNDS[column][1] - BOUNDS[column][0]) * math.sqrt(math.log(40) / (2 * len(k))),
                    }[kind](known)
                )
            out.append((*key, *row))
    return out


def same(got, expected):
    close = lambda a, b: a == pytest.approx(b) if isinstance(a, float) and isinstance(b, float) else a == b
    key = lambda r: [str(round(x, 6) if isinstance(x, float) else x) for x in r]
    got, expected = sorted(got, key=key), sorted(expected, key=key)
    assert len(got) == len(expected)
    assert all(close(a, b) for x, y in zip(got, expected, strict=True) for a, b in zip(x, y, strict=True)), (got, expected)


SELECTS = [
    ("avg(km), sum(fare), count(km), count(*), progressive_partition(), progressive_progress()", [], "", lambda t: True,
     [("avg", "km"), ("sum", "fare"), ("count", "km"), ("count", "*"), ("part", ""), ("progress", "")]),
    ("sum(km), count(*), progressive_confidence(km)", [], "fare > 10000", lambda t: False, [("sum", "km"), ("count", "*"), ("confidence", "km")]),
    ("city, avg(fare), max(km), min(fare), progressive_confidence(fare)", ["city"], "", lambda t: True,
     [("avg", "fare"), ("max", "km"), ("min", "fare"), ("confidence", "fare")]),
    ("city, rider, sum(fare), progressive_partition()", ["city", "rider"], "km BETWEEN 3 AND 20 OR city IS NULL",
     lambda t: t["city"] is None or (t["km"] is not None and 3 <= t["km"] <= 20), [("sum", "fare"), ("part", "")]),
    ("rider, city", ["rider", "city"], "fare < 200", lambda t: t["fare"] < 200, []),
]


@pytest.mark.parametrize("text, keys, where, fits, values", SELECTS)
def test_snapshots(s, text, keys, where, fits, values):
    group = f" GROUP BY {', '.join(keys)}" if keys and values else ""
    result = s.sql(f"SELECT PROGRESSIVE {text} FROM trips {'WHERE ' + where if where else ''}{group}")
    expected = brute(keys, values, fits)
    same(rows(result.batch()), expected)
    shots = list(result.snapshots())
    same([tuple(r) for x in shots for r in x.df.collect()], expected)
    assert [(x.partition, x.progress) for x in shots] == [(k + 1, (k + 1) / PARTS) for k in range(PARTS)]
    same(rows(result.final()), brute(keys, values, fits, steps=[PARTS - 1]))


def test_having_order_and_limit_of_each_snapshot(s):
    got = s.batch("SELECT PROGRESSIVE rider, sum(fare) AS f FROM trips GROUP BY rider HAVING count(*) >= 4 ORDER BY f DESC, rider LIMIT 2 OFFSET 1")
    expected = []
    for step in range(PARTS):
        having = lambda g, p=(step + 1) / PARTS: len(g) / p >= 4
        ranked = sorted(brute(["rider"], [("sum", "fare")], steps=[step], having=having), key=lambda r: (-r[1], r[0]))
        expected += ranked[1:3]
    same([tuple(r) for r in got.collect()], expected)
    some = lambda: rows(s.batch("SELECT PROGRESSIVE rider, count(*) FROM trips GROUP BY rider LIMIT 2"))
    assert some() == some() and len(some()) == 2 * PARTS


def test_grouping_sets(s):
    got = s.batch("SELECT PROGRESSIVE city, rider, count(*) FROM trips WHERE city IS NOT NULL GROUP BY GROUPING SETS ((city), (rider, city), ())")
    fits = lambda t: t["city"] is not None
    n = [("count", "*")]
    expected = [(c, None, x) for c, x in brute(["city"], n, fits)] + brute(["city", "rider"], n, fits) + [(None, None, *r) for r in brute([], n, fits)]
    same(rows(got), expected)


def test_approximate_distinct_counts(s):
    result = s.sql("SELECT PROGRESSIVE city, approx_count_distinct(rider) n, approx_count_distinct(km) k FROM trips GROUP BY city")
    expected = []
    for step in range(PARTS):
        seen = [record(t) for t in TRIPS if t[0] % PARTS <= step]
        for city in {t["city"] for t in seen}:
            mine = [t for t in seen if t["city"] == city]
            expected.append((city, len({t["rider"] for t in mine}), len({t["km"] for t in mine} - {None})))
    same(rows(result.batch()), expected)
    same([tuple(r) for x in result.snapshots() for r in x.df.collect()], expected)


def test_products_without_a_link_must_be_small(s, spark, monkeypatch):
    s.register("tariff", spark.range(5).selectExpr("id AS lowest"))
    s.register("zone", spark.range(3).selectExpr("id AS zone"))
    text = "SELECT PROGRESSIVE count(*) n FROM trips, tariff, zone WHERE km > lowest AND trip = zone"
    assert rows(s.sql(text).final()) == [(float(sum(t[2] is not None and t[0] < 3 and t[2] > k for t in TRIPS for k in range(5))),)]
    monkeypatch.setattr("stepwise.session.MOST_UNLINKED", 4)
    s.sql(text.replace("km > lowest", "km = lowest"))
    with pytest.raises(ProgressiveError, match="tariff has over 4 rows"):
        s.sql(text)


def test_output_names(s):
    df = s.batch("select progressive count(*), avg(km) m, progressive_progress(), city from trips group by city")
    assert df.columns == ["COUNT", "m", "PROGRESSIVE_PROGRESS", "city"]


LIMA, PUNE, FAR = (lambda t: t["city"] == "Lima"), (lambda t: t["city"] == "Pune"), (lambda t: t["km"] is not None and t["km"] > 14)
VIEWS = [
    ("sum(fare), rider FUTURE FROM trips GROUP BY rider FUTURE", [("", [], lambda t: True), ("WITH FUTURE GROUP BY rider", ["rider"], lambda t: True)]),
    ("sum(fare) FROM trips WHERE ((city = 'Lima') FUTURE OR (city = 'Pune') FUTURE) AND km > 14",
     [("", [], FAR), ("WITH FUTURE WHERE 'Lima' = CITY", [], lambda t: FAR(t) and LIMA(t)),
      ("WITH FUTURE WHERE city = 'Lima', city = 'Pune'", [], lambda t: FAR(t) and (LIMA(t) or PUNE(t)))]),
    ("rider, sum(fare) FROM trips WHERE (city = 'Pune') FUTURE OR km > 14 GROUP BY rider",
     [("", ["rider"], FAR), ("WITH FUTURE WHERE (city = 'Pune')", ["rider"], lambda t: FAR(t) or PUNE(t))]),
]


@pytest.mark.parametrize("define, reads", VIEWS)
def test_views(s, define, reads):
    s.sql(f"CREATE OR REPLACE PROGRESSIVE VIEW pv AS SELECT {define}")
    for number, (tail, keys, fits) in enumerate(reads):
        reader = s.sql(f"SELECT PROGRESSIVE * FROM pv {tail}")
        # an active key comes last, one that is always there stays in its place
        turn = lambda r, k=keys, t=tail: (*r[len(k):], *r[: len(k)]) if "GROUP BY" in t else r
        if not number:
            live = list(reader.snapshots())  # from the step that the view has reached
            assert live[-1].partition == PARTS
            same([tuple(r) for x in live for r in x.df.collect()], [turn(r) for x in live for r in brute(keys, [("sum", "fare")], fits, steps=[x.partition - 1])])
        same(rows(reader.batch()), [turn(r) for r in brute(keys, [("sum", "fare")], fits)])
        same(rows(reader.final()), [turn(r) for r in brute(keys, [("sum", "fare")], fits, steps=[PARTS - 1])])
    assert len(list(reader.snapshots())) == 1  # the view is complete


def test_a_view_reads_every_row_once(spark):
    """From its creation on, for followers and for batch readers alike."""
    s, read = ProgressiveSession(spark), spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x

    spark.udf.register("seen", seen, "int")
    s.register("u", spark.range(60).selectExpr("cast(id AS int) AS a"))
    s.prepare_table("u", partitions=6, strategy="expr", key="a")
    s.sql("CREATE PROGRESSIVE VIEW uv AS SELECT sum(seen(a)) t FROM u")
    first = s.sql("SELECT PROGRESSIVE t FROM uv")
    begun = next(first.snapshots()).partition
    assert 1 <= begun <= 6
    total = sum(range(60))
    assert rows(s.sql("SELECT PROGRESSIVE t FROM uv").batch())[-1] is not None and rows(first.final()) == [(float(total),)]
    assert len(rows(first.batch())) == 6 and list(first.snapshots())[-1].partition == 6
    assert read.value == 60
    s.sql("DROP PROGRESSIVE VIEW uv")


def test_sql_over_a_view(s):
    s.sql("CREATE OR REPLACE PROGRESSIVE VIEW pv (who, trips) AS SELECT rider, count(*) FROM trips GROUP BY rider ORDER BY rider")
    expected = brute(["rider"], [("count", "*"), ("part", "")], lambda t: t["rider"] != "r0")
    totals = [(sum(n for _, n, p in expected if p == part), part) for part in range(1, PARTS + 1)]
    same(rows(s.batch("SELECT PROGRESSIVE sum(trips) t, progressive_partition() p FROM pv WHERE who <> 'r0'")), totals)
    ranked = s.batch("SELECT PROGRESSIVE who, rank() OVER (ORDER BY trips DESC, who) r, progressive_partition() p FROM pv ORDER BY r LIMIT 1")
    every = brute(["rider"], [("count", "*"), ("part", "")])
    same(rows(ranked), [(min((-n, w) for w, n, p in every if p == part)[1], 1, part) for part in range(1, PARTS + 1)])
    assert len(rows(s.batch("SELECT PROGRESSIVE * FROM pv LIMIT 2"))) == 2 * PARTS
    s.sql("DROP PROGRESSIVE VIEW pv")
    s.sql("DROP PROGRESSIVE VIEW IF EXISTS pv")
    with pytest.raises(ProgressiveError):
        s.sql("DROP PROGRESSIVE VIEW pv")


@pytest.mark.parametrize(
    "wrong",
    [
        "SELECT PROGRESSIVE count(DISTINCT km) FROM trips",
        "SELECT PROGRESSIVE km, count(*) FROM trips GROUP BY city",
        "SELECT PROGRESSIVE 3 FROM trips",
        "SELECT PROGRESSIVE km FROM nowhere",
        "SELECT PROGRESSIVE km FROM trips WITH FUTURE WHERE km = 1",
        "SELECT PROGRESSIVE progressive_confidence(city) FROM trips",
        "SELECT PROGRESSIVE rank() OVER (ORDER BY km) FROM trips",
        "SELECT PROGRESSIVE count(*) FROM trips, trips",
        "CREATE PROGRESSIVE VIEW w AS SELECT count(*) FUTURE FROM trips",
        "ANALYZE PROGRESSIVE TABLE nowhere",
    ],
)
def test_wrong_statements(s, wrong):
    with pytest.raises(ProgressiveError):
        s.batch(wrong)


def test_futures_must_exist(s):
    s.sql("CREATE OR REPLACE PROGRESSIVE VIEW pv AS SELECT count(km) n, city FUTURE FROM trips WHERE (km > 1) FUTURE GROUP BY city FUTURE")
    for tail in ("WITH FUTURE WHERE km > 2", "WITH FUTURE GROUP BY rider"):
        with pytest.raises(ProgressiveError):
            s.sql(f"SELECT PROGRESSIVE * FROM pv {tail}")
    with pytest.raises(ProgressiveError):
        s.sql("SELECT PROGRESSIVE n, city FROM pv")


def test_errors_reach_the_reader(s):
    s.sql("CREATE OR REPLACE PROGRESSIVE VIEW bad AS SELECT sum(km) FROM trips WHERE raise_error('lost') IS NULL")
    with pytest.raises(Exception, match="lost"):
        list(s.sql("SELECT PROGRESSIVE * FROM bad").snapshots())
    with pytest.raises(Exception, match="lost"):
        s.sql("SELECT PROGRESSIVE * FROM bad").batch()


def test_closing_and_cancelling_stop(s):
    result = s.sql("SELECT PROGRESSIVE count(*) FROM trips")
    shots = result.snapshots()
    assert next(shots).partition == 1
    shots.close()
    shots = result.snapshots()
    assert next(shots).partition == 1
    result.cancel()
    assert list(shots) == []


def test_self_join_and_field_access(spark):
    s = ProgressiveSession(spark)
    s.register("e", spark.createDataFrame([(k, (k % 3, f"n{k}"), k // 2) for k in range(8)], "id int, info struct<kind int, name string>, boss int"))
    s.prepare_table("e", partitions=2, strategy="expr", key="id")
    got = s.sql("SELECT PROGRESSIVE a.info.kind AS kind, count(*) AS n FROM e AS a, e AS b WHERE a.boss = b.id AND b.info.kind = 0 AND a.info.name LIKE 'n!_%' ESCAPE '!' OR a.boss = b.id GROUP BY a.info.kind")
    assert rows(got.final()) == [(k, float(len([i for i in range(8) if i % 3 == k]))) for k in range(3)]
    assert got.plan.steps == 4 and rows(got.batch())[-1] is not None


def test_null_keys_and_values(spark):
    s = ProgressiveSession(spark)
    s.register("n", spark.createDataFrame([(0, None, None), (1, None, 2), (1, "x", None)], "p int, k string, v int"))
    s.prepare_table("n", partitions=2, strategy="expr", key="p")
    assert rows(s.batch("select progressive k, sum(v) t, avg(v) a, count(v) c from n group by k")) == sorted(
        [(None, None, None, 0.0), (None, 2.0, 2.0, 1.0), ("x", None, None, 0.0)], key=str
    )


def test_products_of_partitions(spark, tmp_path):
    """Each step reads one partition of each table, and only these."""
    s = ProgressiveSession(spark)
    r = random.Random(4)
    left, right = [(k, r.randrange(5), r.randrange(9)) for k in range(23)], [(k, r.randrange(5), r.randrange(9)) for k in range(17)]
    s.register("l", spark.createDataFrame(left, "i int, k int, v int"))
    s.register("m", spark.createDataFrame(right, "j int, q int, w int"))
    s.prepare_table("l", partitions=3, strategy="expr", key="i", path=str(tmp_path / "l"))
    s.prepare_dimension("m", partitions=2, strategy="expr", key="j", path=str(tmp_path / "m"))
    expected = []
    for step in range(6):
        pairs = [(v * w) for i, k, v in left for j, q, w in right if k == q and i % 3 + 3 * (j % 2) <= step]
        expected.append((sum(pairs) * 6 / (step + 1), step + 1))
    result = s.sql("SELECT PROGRESSIVE sum(v * w) x, progressive_partition() p FROM l, m WHERE k = q")
    same(rows(result.batch()), expected)
    same([tuple(row) for x in result.snapshots() for row in x.df.collect()], expected)
    plan = result.plan.rows(4)._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.replace(", PartitionFilters", "\nPartitionFilters").splitlines() if line.startswith("PartitionFilters")]
    assert len(filters) == 2 and all("_partition" in line for line in filters)


def test_prepare(spark, tmp_path):
    s = ProgressiveSession(spark)
    s.register("shop", spark.createDataFrame([(k, f"s{k}") for k in range(7)], "shop_id int, name string"))
    s.register("sale", spark.createDataFrame([(k, k % 7, k * 1.5) for k in range(11)], "sale_id int, shop int, price double"), [ForeignKey("shop", "shop", "shop_id")])
    for size in (2, 4):
        s.prepare_table("sale", partition_size=size, with_foreign_tables=True)
        for name, n in (("sale", 11), ("shop", 7)):
            parts = math.ceil(n / size)
            assert sorted(p.entries for p in s.catalog.partitions(name)) == sorted(len(range(k, n, parts)) for k in range(parts))
    bounds = s.catalog.bounds("sale.price", [])
    assert (bounds.min, bounds.max) == (0.0, 15.0) and s.catalog.bounds("shop_id", ["sale", "shop"]).max == 6
    with pytest.raises(ProgressiveError):
        s.catalog.bounds("name", ["shop"])
    s.catalog.save(spark, str(tmp_path / "catalog"))
    loaded = Catalog.load(spark, str(tmp_path / "catalog"))
    assert loaded.partitions("sale") == s.catalog.partitions("sale") and loaded.bounds("price", ["sale"]) == bounds


def test_prepare_statement_writes_pruned_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("stepwise.sources.prepare.DEFAULT_SIZE", 10)
    s = ProgressiveSession(spark, storage=str(tmp_path))
    s.register("shop", spark.range(4).selectExpr("id AS shop_id", "concat('s', id) AS name"))
    s.register("sale", spark.range(25).selectExpr("id", "id % 4 AS shop", "id * 2 AS price"), [ForeignKey("shop", "shop", "shop_id")])
    ready = s.sql("PREPARE TABLE sale")
    assert [p.entries for p in s.catalog.partitions("sale")] == [9, 8, 8] and s.prepared["shop"].path
    result = s.sql("SELECT PROGRESSIVE name, sum(price) t FROM sale, shop WHERE shop = shop_id GROUP BY name")
    assert rows(result.final()) == [(f"s{k}", float(sum(2 * i for i in range(25) if i % 4 == k))) for k in range(4)]
    assert "PartitionFilters: [isnotnull(_partition" in result.plan.rows(1)._jdf.queryExecution().executedPlan().toString()
    spark.createDataFrame([(99, 1, 1000)], "id long, shop long, price long").coalesce(1).write.parquet(f"{ready.path}/_partition=2", mode="append")
    s.sql("ANALYZE PROGRESSIVE TABLE sale")
    assert [p.entries for p in s.catalog.partitions("sale")] == [9, 8, 9] and s.catalog.bounds("price", ["sale"]).max == 1000


def test_calibration(spark, monkeypatch):
    s = ProgressiveSession(spark)
    s.register("shop", spark.range(4).selectExpr("id AS shop_id"))
    s.register("sale", spark.range(2000).selectExpr("id", "id % 4 AS shop", "id * 2 AS price"), [ForeignKey("shop", "shop", "shop_id")])
    joined = [(ForeignKey("shop", "shop", "shop_id"), s.tables["shop"])]
    monkeypatch.setattr("stepwise.sources.prepare.RUNS", 1)
    assert calibrate_partition_size(s.tables["sale"], joined, target_ms=1e6) >= 1_000_000  # the whole table is faster
    assert calibrate_partition_size(s.tables["sale"], joined, target_ms=0.01, first_size=1500) < 1500
    monkeypatch.setattr("stepwise.session.calibrate_partition_size", lambda df, dims: 700 if [fk.table for fk, _ in dims] == ["shop"] else 0)
    assert s.prepare_table("sale", partition_size="auto").partitions == 3
    with pytest.raises(ProgressiveError):
        calibrate_partition_size(spark.createDataFrame([("a",)], "x string"))


def test_stream_over_empty_partitions(spark, tmp_path):
    s = ProgressiveSession(spark)
    s.register("r", spark.range(100).selectExpr("cast(id AS int) AS id", "id % 3 AS k", "cast(id AS decimal(10,2)) AS v"))
    path = str(tmp_path / "r")
    s.prepare_table("r", partitions=4, strategy="expr", key="id * 2", path=path)
    assert [p.entries for p in s.catalog.partitions("r")] == [50, 0, 50, 0]
    result = s.sql("SELECT PROGRESSIVE k, sum(v) t, count(*) n FROM r WHERE id >= 10 GROUP BY k")
    shots = list(result.stream(path))
    # the empty partitions are complete from the beginning
    assert [(x.partition, x.progress) for x in shots] == [(3, 0.75), (4, 1.0)]
    assert rows(shots[-1].df) == rows(result.final()) and sum(r.n for r in shots[-1].df.collect()) == 90
    assert [json.loads(x)["k"] for x in sorted(shots[-1].to_json())] == [0, 1, 2]
    s.register("none", spark.createDataFrame([], "a int"))
    s.prepare_table("none", partitions=2, strategy="expr", key="a", path=str(tmp_path / "none"))
    shots = list(s.sql("SELECT PROGRESSIVE count(*) n FROM none").stream(str(tmp_path / "none")))
    assert [(x.partition, rows(x.df)) for x in shots] == [(2, [(0.0,)])]


def test_sizes():
    assert [partition_count(n, 2) for n in (0, 1, 2, 3)] == [1, 1, 1, 2]
    assert [two_digits(x) for x in (0.2, 7, 123456, 998)] == [1, 7, 120000, 990]


def test_empty_table(spark):
    s = ProgressiveSession(spark)
    s.register("e", spark.createDataFrame([], "a int, c string"))
    s.prepare_table("e", partitions=2, strategy="hash", key="c")
    assert rows(s.batch("select progressive count(*) n, sum(a) t from e")) == [(0.0, None), (0.0, None)]
    assert rows(s.batch("select progressive c, count(*) n from e group by c")) == []


def test_statements_are_logged(s, caplog):
    with caplog.at_level(logging.INFO, "stepwise"):
        next(s.sql("SELECT PROGRESSIVE count(*)\n FROM trips").snapshots())
    assert any("SELECT PROGRESSIVE count(*) FROM trips [" in m for m in caplog.messages) and any(m.startswith(f"step 1 of {PARTS} in") for m in caplog.messages)


def test_delimited_files(spark, tmp_path):
    (tmp_path / "in.tbl").write_text("1|a|\n2||3.5\n")
    df = read_delimited(spark, str(tmp_path / "in.tbl"), "k int, s string, x double")
    assert rows(df) == [(1, "a", None), (2, None, 3.5)]
    write_results(df, str(tmp_path / "out"))
    assert sorted(spark.read.text(str(tmp_path / "out")).collect())[-1][0] == "k;s;x"
    assert report_lines([("q1", 5, 9, 3)]).splitlines() == ["Query;Base;Partitions Sum;Partitions Avg", "q1;5;9;3"]


def test_tables_of_another_database(spark):
    url = "jdbc:derby:memory:trips;create=true"
    write_jdbc(spark.createDataFrame(TRIPS, SCHEMA), url, "trips", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    read = read_jdbc(spark, url, "trips", column="trip", bounds=(0, 41), partitions=3, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert read.rdd.getNumPartitions() == 3
    s = ProgressiveSession(spark)
    s.register("remote", read)
    s.prepare_table("remote", partitions=PARTS, strategy="expr", key="trip")
    same(rows(s.batch("SELECT PROGRESSIVE city, sum(fare) FROM remote GROUP BY city")), brute(["city"], [("sum", "fare")]))
