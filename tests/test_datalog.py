import pytest
from pyspark.sql import functions as F

from factmill.functions.predicates import Ge, Lt
from factmill.plans.datalog import Atom, Const, Program


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src long, dst long")


def values(program, name):
    return sorted(r["v"] for r in program.result(name).collect())


def reaching(spark, n, *pairs):
    p = Program(spark).add_edb("edge", edges(spark, *pairs), ["src", "dst"]).add_edb("nodes", spark.range(n), ["id"])
    p.add_idb("reach", n).add_idb("unreach", n)
    p.rule("reach", ["X"], Atom("edge", "X", "D")).rule("reach", ["X"], Atom("reach", "Y"), Atom("edge", "Y", "X"))
    return p.rule("unreach", ["X"], Atom("nodes", "X"), ~Atom("reach", "X")).evaluate()


@pytest.mark.parametrize(
    ("n", "pairs", "want"),
    [
        (5, [(0, 1), (1, 2), (2, 3), (3, 4)], range(5)),
        (3, [(0, 1), (1, 2), (2, 0)], range(3)),
        (4, [(0, 1), (0, 2), (1, 3), (2, 3)], range(4)),
        (8, [(0, 1), (1, 2), (5, 6), (6, 7)], [0, 1, 2, 5, 6, 7]),
        (101, [(i, i + 1) for i in range(100)], range(101)),
        (2, [(0, 1), (1, 0)], range(2)),
        (5, [(0, 1), (1, 2)], [0, 1, 2]),
    ],
)
def test_reach(spark, n, pairs, want):
    p = reaching(spark, n, *pairs)
    assert values(p, "reach") == list(want)
    assert values(p, "unreach") == [v for v in range(n) if v not in want]


def test_base_rules(spark):
    p = Program(spark).add_edb("edge", edges(spark, (0, 1), (1, 2), (2, 3)), ["src", "dst"]).add_edb("nodes", spark.range(5), ["id"])
    p.add_idb("r", 4).add_idb("f").add_idb("none").add_idb("two", 5)
    p.rule("r", ["X"], Atom("edge", "X", "D")).rule("f", ["X"], Atom("nodes", "X"), filter=Lt("id", 3))
    p.rule("none", ["X"], Atom("nodes", "X"), filter=lambda df: df["id"] >= 100)
    p.rule("two", ["X"], Atom("nodes", "X"), filter=Lt("id", 2)).rule("two", ["X"], Atom("edge", "S", "X"))
    p.evaluate()
    assert [values(p, n) for n in ("r", "f", "none", "two")] == [[0, 1, 2], [0, 1, 2], [], [0, 1, 2, 3]]
    p.seed("two", spark.createDataFrame([(4,), (77,)], "v long")).evaluate()
    assert values(p, "two") == [0, 1, 2, 3, 4]


def test_strata_and_intersection(spark):
    p = Program(spark).add_edb("nodes", spark.range(10), ["id"])
    for name in ("base", "derived", "fin", "a", "b", "c", "rest"):
        p.add_idb(name, 10)
    p.rule("base", ["X"], Atom("nodes", "X"), filter=Lt("id", 5))
    p.rule("derived", ["X"], Atom("nodes", "X"), ~Atom("base", "X")).rule("fin", ["X"], Atom("nodes", "X"), ~Atom("derived", "X"))
    p.rule("a", ["X"], Atom("nodes", "X"), filter=Lt("id", 4)).rule("b", ["X"], Atom("nodes", "X"), filter=Ge("id", 2))
    p.rule("c", ["X"], Atom("a", "X"), Atom("b", "X")).rule("rest", ["X"], ~Atom("c", "X"))
    p.evaluate()
    assert values(p, "fin") == [0, 1, 2, 3, 4] and values(p, "c") == [2, 3] and values(p, "rest") == [0, 1, 4, 5, 6, 7, 8, 9]


def test_hops_and_automaton(spark):
    chain = [(0, 1), (1, 2), (2, 3), (10, 11), (11, 12), (20, 21), (21, 22), (22, 23), (23, 24)]
    p = Program(spark).add_edb("step", edges(spark, *chain), ["src", "dst"])
    for k in range(1, 4):
        p.add_idb(f"s{k}", 30)
    p.rule("s1", ["X"], Atom("step", "D", "X")).rule("s2", ["X"], Atom("s1", "Y"), Atom("step", "Y", "X")).rule("s3", ["X"], Atom("s2", "Y"), Atom("step", "Y", "X"))
    assert values(p.evaluate(), "s3") == [3, 23, 24]
    following = spark.range(1024).select(F.col("id"), ((F.col("id") + 1) % 1024).alias("next_id"))
    d = Program(spark).add_edb("next", following, ["id", "next_id"])
    d.add_idb("ready").add_idb("active").add_idb("done").seed("ready", spark.createDataFrame([(0,)], "v long"))
    d.rule("active", ["N"], Atom("ready", "C"), Atom("next", "C", "N")).rule("done", ["N"], Atom("active", "C"), Atom("next", "C", "N"))
    assert values(d.evaluate(), "done") == [2]


def test_standard_meaning(spark):
    p = Program(spark).add_edb("e", edges(spark, (0, 0), (0, 1), (1, 2), (3, 3)), ["src", "dst"]).add_edb("n", spark.range(5), ["id"])
    for name in ("loop", "const", "two", "exists", "never", "not_base"):
        p.add_idb(name)
    p.rule("loop", ["X"], Atom("e", "X", "X")).rule("const", ["X"], Atom("e", Const(0), "X"))
    p.rule("two", ["Z"], Atom("e", "X", "Y"), Atom("e", "Y", "Z"), filter=Lt("src", 1))
    p.rule("exists", ["X"], Atom("n", "X"), Atom("e", "A", "B")).rule("never", ["X"], Atom("n", "X"), Atom("e", Const(9), "B"))
    p.rule("not_base", ["X"], Atom("n", "X"), ~Atom("e", "X", "X"))
    p.evaluate()
    assert [values(p, n) for n in ("loop", "const", "two", "exists", "never", "not_base")] == [[0, 3], [0, 1], [0, 1, 2], [0, 1, 2, 3, 4], [], [1, 2, 4]]


def test_second_recursive_atom_grows_late(spark):
    p = Program(spark).add_edb("n", spark.range(6), ["id"]).add_edb("e", edges(spark, (0, 1), (1, 2), (2, 3)), ["src", "dst"])
    p.add_idb("a").add_idb("b").add_idb("c")
    p.rule("a", ["X"], Atom("n", "X"), filter=Lt("id", 4)).rule("b", ["X"], Atom("n", "X"), filter=Lt("id", 1))
    p.rule("b", ["X"], Atom("b", "Y"), Atom("e", "Y", "X")).rule("c", ["X"], Atom("a", "X"), Atom("b", "X"))
    p.rule("b", ["X"], Atom("c", "X")).rule("a", ["X"], Atom("c", "X"))
    assert values(p.evaluate(), "c") == [0, 1, 2, 3]


def test_errors(spark):
    p = Program(spark).add_edb("n", spark.range(3), ["id"]).add_idb("a").add_idb("b")
    for bad in (lambda: p.add_idb("n"), lambda: p.add_edb("m", spark.range(1), ["x"]), lambda: p.result("a"), lambda: p.rule("a", ["X", "Y"], Atom("n", "X"))):
        with pytest.raises(ValueError):
            bad()
    for head, body in (("zzz", [Atom("n", "X")]), ("a", [Atom("zzz", "X")]), ("a", [Atom("n", "X", "Y")]), ("a", [Atom("n", "Y")])):
        q = Program(spark).add_edb("n", spark.range(3), ["id"]).add_idb("a").rule(head, ["X"], *body)
        with pytest.raises(ValueError):
            q.evaluate()
    p.rule("a", ["X"], Atom("n", "X"), ~Atom("b", "X")).rule("b", ["X"], Atom("n", "X"), ~Atom("a", "X"))
    with pytest.raises(ValueError, match="negation"):
        p.evaluate()
