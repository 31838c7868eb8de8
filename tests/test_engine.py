import random
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from factmill.functions.predicates import Always, Eq, Ge, HasTags, In, Lt, Matcher, Ne, Never, Not, Or, Prefix, simplify
from factmill.operators import sets
from factmill.operators.closure import descendants, reach, semi_naive_join
from factmill.operators.execute import aggregate, execute, execute_mask, execute_skipping, semi_join
from factmill.sources.tables import add_column, add_strings, chunk_summary, dictionary, entity_table, num_chunks, numbered, prefix_codes, set_tag, set_tags
from factmill.streaming.incremental import HighWaterFilter, streaming_filter


def ids(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


def rows(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def test_filters(spark):
    t = rows(spark, "row long, id long, s long", *((i, 10 + i, s) for i, s in enumerate([1, 2, 1, 2, 1])))
    assert ids(execute(t, Eq("s", 2)), "row") == [1, 3]
    assert ids(execute(t, Lt("id", 13) & Eq("s", 2)), "row") == [1]
    assert ids(execute(t, Always()), "row") == [0, 1, 2, 3, 4]
    v = rows(spark, "row long, id long, val float", *((i, 10 * i + 10, x) for i, x in enumerate([1.0, 25.0, 30.0, 15.0, 50.0])))
    assert ids(execute(v, Lt("id", 40) & Ge("val", 20)), "row") == [1, 2]
    assert ids(execute(v, Eq("val", 20.1)), "row") == []
    f = rows(spark, "row long, x float", (0, 20.1), (1, float("nan")), (2, None))
    assert ids(execute(f, Eq("x", 20.1)), "row") == [0]
    assert ids(execute(f, Ge("x", 10.0)), "row") == [0, 1] and ids(execute(f, Ge("x", 10.0), strict_ieee=True), "row") == [0]
    assert ids(execute(f, Ne("x", 3.0), strict_ieee=True), "row") == [0, 1]
    assert ids(execute(f, Lt("x", 10.0) | Ge("x", 10.0)), "row") == [0, 1], "a null is no value"


@dataclass(frozen=True)
class Multiple(Matcher):
    """A leaf of a user's own: the field is a multiple of n."""

    field: str
    n: int

    def to_column(self, schema=None, strict_ieee=False):
        return F.col(self.field) % self.n == 0

    def implies_(self, other):
        return isinstance(other, Multiple) and self.field == other.field and self.n % other.n == 0


def test_own_leaves(spark):
    assert simplify(Multiple("id", 6) & Multiple("id", 3)) == Multiple("id", 6)
    assert simplify(Multiple("id", 6) & ~Multiple("id", 3)) == Never()
    assert ids(execute(spark.range(20), Multiple("id", 6) | Eq("id", 1))) == [0, 1, 6, 12, 18]
    assert ids(execute(spark.range(9), ~Multiple("id", 3))) == [1, 2, 4, 5, 7, 8]


def test_joins_in_every_position(spark):
    users = spark.range(3)
    logs = rows(spark, "row long, uid long", (0, 0), (1, 0), (2, 2), (3, 5), (4, None))
    low = semi_join(users, Lt("id", 2), "uid")
    assert ids(execute(logs, low), "row") == [0, 1]
    assert ids(execute(logs, Not(low)), "row") == [2, 3, 4], "keys that dangle or are null are in no set"
    assert ids(execute(logs, semi_join(users, Not(Lt("id", 2)), "uid")), "row") == [2]
    assert ids(execute(logs, low | Eq("uid", 5)), "row") == [0, 1, 3]
    assert ids(execute(logs, Not(low | Eq("row", 2))), "row") == [3, 4]
    assert ids(execute(logs, Not(low) & Lt("row", 4)), "row") == [2, 3]
    assert ids(execute(logs, (low & Eq("row", 0)) | (Not(low) & Eq("row", 3))), "row") == [0, 3]
    assert ids(execute(logs, semi_join(users, Eq("id", 99), "uid")), "row") == []
    marked = {r["row"]: r["match"] for r in execute_mask(logs, low | Eq("uid", 5)).collect()}
    assert marked == {0: True, 1: True, 2: False, 3: True, 4: False}
    twice = In("uid", rows(spark, "v long", (0,), (0,), (None,)))
    assert ids(execute(logs, twice | Eq("row", 3)), "row") == [0, 1, 3]


def test_players_and_pets(spark):
    players = spark.range(100).withColumn("team", F.col("id") % 3 + 1)
    pets = spark.range(100).withColumn("oid", F.col("id")).withColumn("sp", F.col("id") % 5 + 1)
    found = execute(pets, Eq("sp", 3) & semi_join(players, Eq("team", 2), "oid"))
    assert ids(found) == [i for i in range(100) if i % 5 == 2 and i % 3 == 1]
    items = spark.range(50).withColumn("pet", F.col("id") * 2)
    chained = execute(items, semi_join(pets, semi_join(players, Eq("team", 2), "oid"), "pet"))
    assert ids(chained) == [i for i in range(50) if 2 * i % 3 == 1]


def test_aggregates(spark):
    t = spark.range(1000).withColumn("team", F.when(F.col("id") < 500, 1).otherwise(2)).withColumn("hp", F.when(F.col("id") < 500, 100.0).otherwise(50.0).cast("float"))
    assert [aggregate(t, Eq("team", 1), "hp", op) for op in ("sum", "mean", "max", "min", "count")] == [50000, 100, 100, 100, 500]
    assert [aggregate(t, Eq("team", 9), "hp", op) for op in ("sum", "mean", "max", "min", "count")] == [0, 0, 0, 0, 0]
    with pytest.raises(ValueError):
        aggregate(t, Eq("team", 1), "hp", "median")


def test_tables_and_tags(spark):
    t = add_column(add_column(entity_table(spark, 128), "level", "u32"), "health", "float")
    assert num_chunks(t, 100) == 2 and t.schema["health"].dataType.simpleString() == "float"
    for bad in (lambda: add_column(t, "level", "u32"), lambda: add_column(t, "n", "u32", -1), lambda: set_tag(t, 1, -1), lambda: add_strings(t, "s", ["a"])):
        with pytest.raises(ValueError):
            bad()
    t = set_tag(set_tag(t, 42, 3), 43, 67)
    assert {r["id"]: r["mask"] for r in t.where("mask <> 0").collect()} == {42: 8, 43: 8}
    t = set_tags(t, [5, 6], 63)
    assert ids(execute(t, HasTags(1 << 63))) == [5, 6] and ids(execute(t, Eq("mask", 8))) == [42, 43]
    big = set_tags(set_tags(add_column(entity_table(spark, 10240), "dur", "u32", 100), [*range(5), *range(5120, 5125)], 0), [*range(5), *range(5120, 5125)], 1)
    summary = chunk_summary(big)
    assert {r["chunk_id"]: r["summary"] for r in summary.where("summary <> 0").collect()} == {0: 3, 5: 3}
    m = Eq("mask", 3) & Lt("dur", 150)
    assert ids(execute_skipping(big, m, summary)) == ids(execute(big, m)) == [*range(5), *range(5120, 5125)]


def test_text(spark):
    t = add_strings(entity_table(spark, 4), "path", ["sensor/temp/1", "sensor/voltage", "motor/rpm", "sensor/temp/2"])
    assert ids(execute(t, Prefix("path", "sensor"))) == [0, 1, 3] and ids(execute(t, Prefix("path", "sensor/temp"))) == [0, 3]
    assert ids(execute(t, Prefix("path", ""))) == [0, 1, 2, 3]
    codes = dictionary(t, "path")
    assert {r["path"]: r["code"] for r in codes.collect()}["motor/rpm"] == 0
    assert tuple(prefix_codes(codes, "path", "sensor/temp").first()) == (1, 3) and tuple(prefix_codes(codes, "path", "x").first()) == (None, None)


def test_numbered(spark):
    t = numbered(rows(spark, "s string", *((str(i % 7) + str(i),) for i in range(100))), "s")
    got = sorted((r["id"], r["s"]) for r in t.collect())
    assert [i for i, _ in got] == list(range(100)) and [s for _, s in got] == sorted(s for _, s in got)


def test_sets(spark):
    a, b = spark.range(5).toDF("v"), spark.range(3, 8).toDF("v")
    assert ids(sets.intersect(a, b), "v") == [3, 4] and ids(sets.union(a, b), "v") == list(range(8)) and ids(sets.difference(a, b), "v") == [0, 1, 2]
    assert ids(sets.complement(a, 8), "v") == [5, 6, 7] and sets.contains(a, 4) and not sets.contains(a, 5) and ids(sets.insert(a, 9), "v")[-1] == 9
    assert sets.popcount(a) == 5 and sets.any_set(a) and not sets.any_set(a.where("v > 9"))


def test_closure(spark):
    chain = spark.range(100).withColumn("pid", F.expr("case when id between 1 and 4 then id - 1 else 999 end"))
    assert ids(descendants(chain, Eq("id", 0), "pid")) == [0, 1, 2, 3, 4]
    cycle = spark.range(100).withColumn("pid", F.expr("case id when 0 then 1 when 1 then 0 else 999 end"))
    assert ids(descendants(cycle, Eq("id", 0), "pid")) == [0, 1]
    assert ids(execute(cycle, semi_naive_join(cycle, Eq("id", 0), "pid") & Ge("id", 1))) == [1]
    assert ids(descendants(cycle, Eq("id", 777), "pid")) == []


def test_random_graphs(spark):
    rnd = random.Random(5)
    for single in (True, False):
        edges = [(i, rnd.randrange(40)) for i in range(30)] if single else [(rnd.randrange(30), rnd.randrange(40)) for _ in range(40)]
        want, todo = set(), [0, 1, 2]
        while todo:
            if (v := todo.pop()) not in want:
                want.add(v)
                todo += [b for a, b in edges if a == v]
        got = reach(rows(spark, "a long, b long", *edges), rows(spark, "v long", (0,), (1,), (2,)))
        assert ids(got, "v") == sorted(want)


def test_incremental(spark):
    t = spark.range(1000).withColumn("x", F.col("id") % 7)
    growing = HighWaterFilter(Eq("x", 3))
    for upto in (0, 37, 37, 500, 1000):
        got = ids(growing.update(t.where(F.col("id") < upto)))
        assert got == [i for i in range(upto) if i % 7 == 3] and growing.mark == upto


def test_streaming(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    batch = spark.range(100).withColumn("x", F.col("id") % 5)
    for k in range(2):
        batch.withColumn("id", F.col("id") + 100 * k).write.mode("append").parquet(source)
        streaming_filter(spark, source, batch.schema, Or(Eq("x", 1), Eq("id", 102)), sink, state, ["id"]).awaitTermination()
        want = [i for i in range(100 * (k + 1)) if i % 5 == 1 or i == 102]
        assert ids(spark.read.parquet(sink)) == want
