"""Shapes that once went wrong."""

import pytest
from pyspark.sql import functions as F

from factmill.functions.predicates import Eq, Ge, Kernel, Lt, Ne
from factmill.operators.closure import descendants, reach
from factmill.operators.execute import execute, execute_skipping, live_ranges
from factmill.plans.datalog import Atom, Program
from factmill.sources.tables import add_strings, chunk_summary, store_chunked
from factmill.streaming.incremental import HighWaterFilter


def values(df, column=None):
    return sorted(r[0] for r in (df.select(column) if column else df).collect())


def test_repeated_and_null_keys_in_closure(spark):
    twice = spark.createDataFrame([(i, i - 1 if i else None) for i in range(17)] * 2 + [(None, 3), (5, 99)], "id long, pid long")
    assert values(descendants(twice, Eq("id", 0), "pid")) == list(range(17))
    branching = spark.createDataFrame([(1, 0), (1, 7), (2, 7), (7, 50), (3, 1)], "id long, pid long")
    assert values(descendants(branching, Eq("id", 7), "pid")) == [1, 2, 3, 7]
    assert descendants(branching, Eq("id", 1000), "pid").count() == 0


@pytest.mark.parametrize("n", [1, 4, 64])
def test_depths(spark, n):
    chain = spark.range(n + 3).selectExpr("id", "case when id > 0 and id <= " + str(n) + " then id - 1 when id = " + str(n + 1) + " then id end as pid")
    assert values(descendants(chain, Eq("id", 0), "pid")) == list(range(n + 1))
    assert values(reach(chain.where("pid is not null").select("pid", "id"), spark.createDataFrame([(0,)], "v long"))) == list(range(n + 1))
    assert values(reach(chain.where("pid is not null").select("pid", "id"), spark.createDataFrame([(0,)], "v long"), False)) == list(range(n + 1))


def test_rule_shapes(spark):
    n = spark.createDataFrame([(1,), (2,), (3,)], "x long")
    e = spark.createDataFrame([(10, 11), (12, 13)], "a long, b long")
    b = spark.createDataFrame([(13,)], "z long")

    def program():
        return Program(spark).add_edb("n", n, ["x"]).add_edb("e", e, ["a", "b"]).add_edb("b", b, ["z"]).add_idb("r")

    assert values(program().rule("r", ["X"], Atom("n", "X"), Atom("e", "Y", "Z"), Atom("b", "Z")).evaluate().result("r")) == [1, 2, 3]
    assert values(program().rule("r", ["X"], Atom("n", "X"), Atom("e", "Y", "Z"), Atom("b", "Y")).evaluate().result("r")) == []
    assert values(program().rule("r", ["X"], Atom("n", "X"), Atom("e", "Y", "Z"), ~Atom("b", "Z")).evaluate().result("r")) == [1, 2, 3]
    guarded = program().rule("r", ["X"], Atom("n", "X"), filter=Eq("x", 2)).rule("r", ["X"], Atom("r", "Y"), Atom("e", "X", "Z"))
    assert values(guarded.evaluate().result("r")) == [2, 10, 12]
    with pytest.raises(ValueError, match="cross product"):
        program().rule("r", ["X"], Atom("n", "X"), Atom("b", "Z"), ~Atom("e", "X", "Z")).evaluate()


def test_skipping(spark, tmp_path):
    rows = [(None, 3, 1.0), (5, 3, 1.0), (2000, 3, 2.0), (9000, 1, 1.0), (-7, -1, 3.0), (50_000, 3, float("nan"))]
    odd = spark.createDataFrame(rows, "id long, mask long, x double")
    for m in (Eq("mask", 3), Eq("mask", -1), Eq("mask", (1 << 64) - 1), Eq("mask", 3) & Ge("x", 1.0), Eq("mask", 1 << 63), Ge("mask", 3), Lt("mask", 3)):
        for strict in (False, True):
            want = execute(odd, m, strict).count()
            assert execute_skipping(odd, m, chunk_summary(odd), strict_ieee=strict).count() == want
            assert execute_skipping(odd, m, None, strict_ieee=strict).count() == want
    assert execute(odd, Ge("mask", 1 << 63)).count() == 1 and execute(odd, Lt("mask", 1 << 63)).count() == 5

    table = spark.range(100_000).withColumn("mask", F.when(F.expr("id div 1024 in (3, 4, 90)"), 3).otherwise(0).cast("long"))
    stored, summary = store_chunked(table, str(tmp_path), files=8)
    assert live_ranges(summary, 3) == [(3 * 1024, 5 * 1024), (90 * 1024, 91 * 1024)]
    assert live_ranges(summary, 3, most=1) == [(3 * 1024, 91 * 1024)] and live_ranges(summary, 4) == [] and live_ranges(None, 3) is None
    found = execute_skipping(stored, Eq("mask", 3), summary)
    assert found.count() == 3 * 1024
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,3072)" in plan and "LessThan(id,5120)" in plan, plan


def test_not_a_number(spark):
    df = spark.createDataFrame([(1, 5.0), (2, float("nan"))], "id long, x double")
    df = spark.createDataFrame(df.rdd, df.schema.__class__([type(f)(f.name, f.dataType, False) for f in df.schema]))
    assert values(execute(df, Lt("x", 10.0) | Ge("x", 10.0), strict_ieee=True), "id") == [1]
    assert values(execute(df, Eq("x", 5.0) | Ne("x", 5.0), strict_ieee=True), "id") == [1, 2]


def test_strings_by_order_of_keys(spark):
    df = spark.createDataFrame([(12,), (10,), (13,), (11,)], "id long")
    assert [r["s"] for r in add_strings(df, "s", ["a", "b", "c", "d"]).orderBy("id").collect()] == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        add_strings(spark.createDataFrame([(1,), (1,)], "id long"), "s", ["a", "b"])


def test_negative_keys_and_many_updates(spark):
    t = spark.range(-50, 450)
    growing = HighWaterFilter(Ge("id", -10))
    for upto in range(0, 500, 50):
        got = growing.update(t.where(F.col("id") < upto))
        assert values(got) == list(range(-10, min(upto, 450)))
    assert len(growing.parts) <= 8


def test_kernel_leaf(spark):
    df = spark.range(100).withColumn("y", F.col("id") % 10)
    both = Kernel(("id", "y"), lambda a, b: a > 9 * b) & Ge("id", 50)
    assert values(execute(df, both), "id") == [i for i in range(50, 100) if i > 9 * (i % 10)]
    assert values(execute(df, ~both), "id") == [i for i in range(100) if not (i >= 50 and i > 9 * (i % 10))]
