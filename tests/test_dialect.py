import operator
import re

import pytest

from stepwise.functions.dialect import similar_to_regex, to_spark
from stepwise.plans.builder import Builder, avg, confidence, count, partition


@pytest.mark.parametrize(
    "text, expected",
    [
        ("a BETWEEN SYMMETRIC 5 AND 1 AND b", "a BETWEEN least(5, 1) AND greatest(5, 1) AND b"),
        ("(a NOT BETWEEN ASYMMETRIC 1 AND f(2))", "(a NOT BETWEEN 1 AND f(2))"),
        ("ROW(a, 1) = ROW(b, 2)", "struct(a, 1) = struct(b, 2)"),
        ("x AND t.a = ANY (1, 2)", "x AND (t.a = 1 OR t.a = 2)"),
        ("f(a, b) <= ALL (c, d + 1)", "(f(a, b) <= c AND f(a, b) <= d + 1)"),
        ("a = SOME (SELECT k FROM t)", "(a IN (SELECT k FROM t))"),
        ("a != ALL (SELECT k FROM t)", "(a NOT IN (SELECT k FROM t))"),
        ("(due - made) DAY > x", "CAST((due) - (made) AS INTERVAL DAY) > x"),
        ("(t.due - f(made)) HOUR TO SECOND", "CAST((t.due) - (f(made)) AS INTERVAL HOUR TO SECOND)"),
        ("(due - made) MONTH", "CAST(make_ym_interval(0, CAST(months_between(due, made) AS INT)) AS INTERVAL MONTH)"),
        ("f(due - made) day", "f(due - made) day"),
        ("'ROW(x) SIMILAR TO'", "'ROW(x) SIMILAR TO'"),
    ],
)
def test_rewrites(text, expected):
    assert to_spark(text) == expected


OPS = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def quantified(value, op, every, others):
    """The comparison by its definition in the SQL standard."""
    answers = [None if value is None or o is None else OPS[op](value, o) for o in others]
    if every:
        return False if False in answers else None if None in answers else True
    return True if True in answers else None if None in answers else False


def test_quantified_comparisons_are_three_valued(spark):
    spark.createDataFrame([(5,), (None,), (1,), (3,)], "a int").createOrReplaceTempView("qa")
    spark.createDataFrame([(2, 1), (3, 1), (None, 2), (3, 2), (4, 3), (4, 3), (None, 4)], "k int, g int").createOrReplaceTempView("qk")
    inner = {g: [r.k for r in spark.table("qk").where(f"g = {g}").collect()] for g in range(5)}
    ops = [(op, word, g) for op in OPS for word in ("ANY", "ALL") for g in inner if (op, word) not in (("=", "ANY"), ("<>", "ALL"))]
    columns = ", ".join(to_spark(f"a {op} {word} (SELECT k FROM qk WHERE g = {g})") + f" AS c{n}" for n, (op, word, g) in enumerate(ops))
    for row in spark.sql(f"SELECT a, {columns} FROM qa").collect():
        for n, (op, word, g) in enumerate(ops):
            assert row[n + 1] == quantified(row.a, op, word == "ALL", inner[g]), (row.a, op, word, inner[g])
    for g in inner:  # a filter keeps what is true
        for text, op, every in ((f"a = ANY (SELECT k FROM qk WHERE g = {g})", "=", False), (f"a <> ALL (SELECT k FROM qk WHERE g = {g})", "<>", True)):
            got = sorted(r.a for r in spark.sql(f"SELECT a FROM qa WHERE {to_spark(text)}").collect() if r.a is not None)
            assert got == sorted(a for a in (5, 1, 3) if quantified(a, op, every, inner[g]))


@pytest.mark.parametrize(
    "pattern, escape, yes, no",
    [("(A|B)%", None, ["A", "Bx"], ["C", "xA"]), ("a_c", None, ["abc"], ["ac"]), ("1.5", None, ["1.5"], ["1x5"]), ("50!%", "!", ["50%"], ["500"]), ("[a-c]+", None, ["abc"], ["d"])],
)
def test_similar_patterns(pattern, escape, yes, no):
    regex = similar_to_regex(pattern, escape)
    assert all(re.search(regex, t) for t in yes) and not any(re.search(regex, t) for t in no)


def test_builder():
    b = Builder(None, ("t",)).join("d", "t.k = d.k").where("x > 1").group_by("c").agg(avg("a", "m"), confidence("a"), count(), partition("p")).having("count(*) > 2").order_by("m DESC").limit(3)
    assert b.sql() == (
        "SELECT PROGRESSIVE c, avg(a) AS `m`, progressive_confidence(a), count(*), progressive_partition() AS `p` FROM t, d "
        "WHERE (t.k = d.k) AND (x > 1) GROUP BY c HAVING count(*) > 2 ORDER BY m DESC LIMIT 3"
    )
