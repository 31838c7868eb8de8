"""Every registered query of the engine's own operators, with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.functions.predicates import Always, And, Eq, Ge, HasTags, In, Kernel, Lt, Matcher, Ne, Never, Not, Or, Prefix, one_of, simplify, to_dnf
from factmill.operators import sets
from factmill.operators.baseline import execute_objects
from factmill.operators.closure import descendants
from factmill.operators.execute import aggregate_frame, execute, execute_mask, execute_out, execute_skipping, semi_join
from factmill.plans.datalog import Atom, Const, Program
from factmill.sources.checkpoints import shared_folder
from factmill.sources.tables import add_column, add_strings, as_entities, chunk_summaries_empty, chunk_summary, dictionary, entity_table, num_chunks, prefix_codes, read, set_tag, set_tags, store_chunked, tag_bit
from factmill.streaming.incremental import HighWaterFilter, streaming_filter

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
CHUNK = 64


def _query(name: str, sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[name], _SQL[name] = f, sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _filter(name: str, table: str, key: str, matcher: Matcher, sql_where: str) -> None:
    """Registers a query for the keys of a table's rows that a predicate accepts."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return execute(read(spark, sf_dir, table), matcher).select(F.col(key).alias("id"))

    _query(name, f"SELECT {key} AS id FROM {table} WHERE {sql_where}")(run)


_filter("q01_always", "nation", "n_nationkey", Always(), "true")
_filter("q02_never", "nation", "n_nationkey", Never(), "1 = 0")
_filter("q03_eq", "customer", "c_custkey", Eq("c_nationkey", 2), "c_nationkey = 2")
_filter("q04_ne", "customer", "c_custkey", Ne("c_nationkey", 2), "c_nationkey <> 2")
_filter("q05_lt", "customer", "c_custkey", Lt("c_acctbal", 0), "c_acctbal < 0")
_filter("q06_ge", "part", "p_partkey", Ge("p_size", 40), "p_size >= 40")
_filter("q07_and", "customer", "c_custkey", Lt("c_nationkey", 5) & Ge("c_acctbal", 5000), "c_nationkey < 5 AND c_acctbal >= 5000")
_filter("q08_or", "customer", "c_custkey", Eq("c_nationkey", 1) | Lt("c_acctbal", 0), "c_nationkey = 1 OR c_acctbal < 0")
_filter("q09_not", "customer", "c_custkey", ~(Eq("c_nationkey", 2) & Lt("c_acctbal", 0)), "NOT (c_nationkey = 2 AND c_acctbal < 0)")
_filter("q11_in_list", "customer", "c_custkey", one_of("c_nationkey", [1, 3, 5, 7]), "c_nationkey IN (1, 3, 5, 7)")
_filter(
    "q12_logic_bomb", "customer", "c_custkey", simplify(Or.from_list(Lt("c_acctbal", k) for k in (20, 50, 10, 100))),
    "c_acctbal < 20 OR c_acctbal < 50 OR c_acctbal < 10 OR c_acctbal < 100",
)
_filter(
    "q13_box", "part", "p_partkey", And(Ge("p_size", 10), Lt("p_size", 20), Ge("p_retailprice", 930), Lt("p_retailprice", 970)),
    "p_size >= 10 AND p_size < 20 AND p_retailprice >= 930 AND p_retailprice < 970",
)
_filter("q14_prefix", "part", "p_partkey", Prefix("p_name", "red"), "p_name LIKE 'red%'")
_filter("q16_not_prefix", "pages", "page_id", ~Prefix("url", "https://"), "NOT (url LIKE 'https://%')")


@_query("q10_dnf", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_quantity >= 45 OR l_quantity < 3) AND l_linenumber = 1")
def q10_dnf(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = to_dnf((Ge("l_quantity", 45) | Lt("l_quantity", 3)) & Eq("l_linenumber", 1))
    return execute(read(spark, sf_dir, "lineitem"), products).select("l_orderkey", "l_linenumber", "l_partkey")


@_query("q15_prefix_path", "SELECT p_partkey AS id FROM part WHERE p_type || '/' || p_brand LIKE 'ECONOMY/Brand#1%'")
def q15_prefix_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").withColumn("path", F.concat_ws("/", "p_type", "p_brand"))
    return execute(part, Prefix("path", "ECONOMY/Brand#1")).select(F.col("p_partkey").alias("id"))


# parts with tags 0: size from 25, 1: price from 950, 2: type ECONOMY

_TAGGED = """(SELECT p_partkey AS id, CAST((CASE WHEN p_size >= 25 THEN 1 ELSE 0 END) + (CASE WHEN p_retailprice >= 950 THEN 2 ELSE 0 END)
  + (CASE WHEN p_type = 'ECONOMY' THEN 4 ELSE 0 END) AS BIGINT) AS mask, p_size FROM part)"""


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    conditions = [Ge("p_size", 25), Ge("p_retailprice", 950), Eq("p_type", "ECONOMY")]
    mask = F.lit(0).cast("long")
    for tag, m in enumerate(conditions):
        mask = mask.bitwiseOR(F.when(m.to_column(part.schema), F.lit(tag_bit(tag))).otherwise(F.lit(0)))
    return part.select(F.col("p_partkey").alias("id"), mask.alias("mask"), "p_size")


@_query("q17_tags_exact", f"SELECT id FROM {_TAGGED} WHERE mask = 3 AND p_size < 50")
def q17_tags_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return execute(_tagged(spark, sf_dir), Eq("mask", 3) & Lt("p_size", 50)).select("id")


@_query("q18_chunk_summary", f"SELECT CAST(floor(id / {CHUNK}.0) AS BIGINT) AS chunk_id, bit_or(mask) AS summary FROM {_TAGGED} GROUP BY 1")
def q18_chunk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_summary(_tagged(spark, sf_dir), CHUNK)


@_query("q19_chunk_skip", f"SELECT id FROM {_TAGGED} WHERE mask = 7 OR (mask = 3 AND p_size >= 30)")
def q19_chunk_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, summary = store_chunked(_tagged(spark, sf_dir), f"{shared_folder(spark)}/chunked-{uuid.uuid4().hex}", CHUNK)
    return skip_query(rows, summary).select("id")


def skip_query(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """The skipping query over a stored table."""
    return execute_skipping(rows, Eq("mask", 7) | (Eq("mask", 3) & Ge("p_size", 30)), summary, CHUNK)


def _orders_of(name: str, customers: Matcher, inner: str, *, fk: str = "o_custkey", also: Matcher | None = None, outer: str = "") -> None:
    """Registers orders whose fk is the key of a customer that a predicate accepts."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        member = semi_join(read(spark, sf_dir, "customer"), customers, fk, "c_custkey")
        return execute(read(spark, sf_dir, "orders"), member if also is None else also & member).select(F.col("o_orderkey").alias("id"))

    _query(name, f"SELECT o_orderkey AS id FROM orders WHERE {outer}EXISTS (SELECT 1 FROM customer WHERE c_custkey = {fk} AND {inner})")(run)


_orders_of("q20_semi", Lt("c_acctbal", 0), "c_acctbal < 0")
_orders_of("q21_semi_and", Eq("c_nationkey", 2), "c_nationkey = 2", also=Eq("o_orderstatus", "F"), outer="o_orderstatus = 'F' AND ")
_orders_of("q23_negative_target", Not(Eq("c_nationkey", 2)), "NOT (c_nationkey = 2)")
_orders_of("q26_empty_semi", Eq("c_nationkey", 999), "c_nationkey = 999")
_orders_of("q27_dangling", Lt("c_acctbal", 1000), "c_acctbal < 1000", fk="o_orderkey")


@_query(
    "q22_triple",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity >= 40 AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey "
    "AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey = 2))",
)
def q22_triple(spark: SparkSession, sf_dir: str) -> DataFrame:
    of_nation = semi_join(read(spark, sf_dir, "customer"), Eq("c_nationkey", 2), "o_custkey", "c_custkey")
    of_order = semi_join(read(spark, sf_dir, "orders"), of_nation, "l_orderkey", "o_orderkey")
    return execute(read(spark, sf_dir, "lineitem"), Ge("l_quantity", 40) & of_order).select("l_orderkey", "l_linenumber", "l_partkey")


@_query("q24_anti", "SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice >= 400000)")
def q24_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = execute(read(spark, sf_dir, "orders"), Ge("o_totalprice", 400000)).select("o_custkey")
    return execute(read(spark, sf_dir, "customer"), ~In("c_custkey", big)).select(F.col("c_custkey").alias("id"))


@_query(
    "q25_or_semi",
    "SELECT o_orderkey AS id FROM orders WHERE o_totalprice >= 450000 OR EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey = 2)",
)
def q25_or_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    member = semi_join(read(spark, sf_dir, "customer"), Eq("c_nationkey", 2), "o_custkey", "c_custkey")
    return execute(read(spark, sf_dir, "orders"), Ge("o_totalprice", 450000) | member).select(F.col("o_orderkey").alias("id"))


def _aggregate(name: str, op: str, nation: int, sql: str, digits: int | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        one = aggregate_frame(read(spark, sf_dir, "customer"), Eq("c_nationkey", nation), "c_acctbal", op)
        return one if digits is None else one.select(F.round("v", digits).alias("v"))

    _query(name, f"SELECT {sql} AS v FROM customer WHERE c_nationkey = {nation}")(run)


_aggregate("q28_agg_sum", "sum", 1, "CAST(round(sum(c_acctbal), 2) AS DOUBLE)", 2)
_aggregate("q29_agg_max", "max", 1, "max(c_acctbal)")
_aggregate("q30_agg_min", "min", 1, "min(c_acctbal)")
_aggregate("q31_agg_mean", "mean", 1, "round(avg(c_acctbal), 4)", 4)
_aggregate("q32_agg_count", "count", 1, "CAST(count(*) AS DOUBLE)")
_aggregate("q33_agg_empty", "max", 999, "CAST(coalesce(max(c_acctbal), 0) AS DOUBLE)")


@_query(
    "q34_set_ops",
    "SELECT c_custkey AS id FROM customer WHERE c_nationkey < 10 INTERSECT SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0",
)
def q34_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read(spark, sf_dir, "customer")
    keys = lambda m: execute(customer, m).select(F.col("c_custkey").alias("id"))
    ordering = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return sets.difference(sets.intersect(keys(Lt("c_nationkey", 10)), ordering), keys(Lt("c_acctbal", 0)))


@_query(
    "q34b_union_complement",
    "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10 UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
)
def q34b_union_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read(spark, sf_dir, "customer")
    keys = lambda m: execute(customer, m).select(F.col("c_custkey").alias("id"))
    return sets.complement(sets.union(keys(Lt("c_nationkey", 10)), keys(Lt("c_acctbal", 0))), customer.count())


# recursion

_HEAP = "SELECT c_custkey AS id, CASE WHEN c_custkey > 0 THEN CAST(floor((c_custkey - 1) / 2.0) AS BIGINT) END AS pid FROM customer"


@_query("q35_descendants", f"WITH RECURSIVE h AS ({_HEAP}), r(id) AS (SELECT id FROM h WHERE id = 3 UNION SELECT h.id FROM h JOIN r ON h.pid = r.id) SELECT id FROM r")
def q35_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    heap = read(spark, sf_dir, "customer").selectExpr("c_custkey as id", "case when c_custkey > 0 then cast(floor((c_custkey - 1) / 2.0) as bigint) end as pid")
    return descendants(heap, Eq("id", 3), "pid")


@_query(
    "q36_descendants_cycle",
    "WITH RECURSIVE h AS (SELECT o_orderkey AS id, o_custkey AS pid FROM orders), r(id) AS (SELECT id FROM h WHERE id < 10 UNION SELECT h.id FROM h JOIN r ON h.pid = r.id) SELECT id FROM r",
)
def q36_descendants_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(read(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "o_custkey as pid"), Lt("id", 10), "pid")


def _program(spark: SparkSession, sf_dir: str) -> Program:
    """Base relations: next(order, customer), customer(key), line(order, supplier)."""
    orders, customer, lineitem = (read(spark, sf_dir, t) for t in ("orders", "customer", "lineitem"))
    return (
        Program(spark)
        .add_edb("next", orders, ["o_orderkey", "o_custkey"])
        .add_edb("customer", customer, ["c_custkey"])
        .add_edb("line", lineitem, ["l_orderkey", "l_suppkey"])
    )


@_query("q37_base", "SELECT DISTINCT o_custkey AS v FROM orders")
def q37_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _program(spark, sf_dir).add_idb("r").rule("r", ["X"], Atom("next", "D", "X")).evaluate().result("r")


@_query("q38_base_filter", "SELECT DISTINCT o_custkey AS v FROM orders WHERE o_totalprice >= 400000")
def q38_base_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _program(spark, sf_dir).add_idb("r").rule("r", ["X"], Atom("next", "D", "X"), filter=Ge("o_totalprice", 400000)).evaluate().result("r")


@_query("q39_two_rules", "SELECT o_custkey AS v FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def q39_two_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    program = _program(spark, sf_dir).add_idb("r")
    program.rule("r", ["X"], Atom("next", "D", "X"), filter=lambda df: df["o_orderstatus"] == "P")
    return program.rule("r", ["X"], Atom("customer", "X"), filter=Lt("c_acctbal", 0)).evaluate().result("r")


_REACH = "r(v) AS (SELECT o_orderkey FROM orders WHERE o_orderkey < 10 UNION SELECT o_custkey FROM orders JOIN r ON o_orderkey = r.v)"


def _reaching(spark: SparkSession, sf_dir: str) -> Program:
    program = _program(spark, sf_dir).add_idb("reach").rule("reach", ["X"], Atom("next", "X", "D"), filter=Lt("o_orderkey", 10))
    return program.rule("reach", ["X"], Atom("reach", "Y"), Atom("next", "Y", "X"))


@_query("q40_reach", f"WITH RECURSIVE {_REACH} SELECT v FROM r")
def q40_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reaching(spark, sf_dir).evaluate().result("reach")


@_query("q41_unreach", f"WITH RECURSIVE {_REACH} SELECT c_custkey AS v FROM customer EXCEPT SELECT v FROM r")
def q41_unreach(spark: SparkSession, sf_dir: str) -> DataFrame:
    program = _reaching(spark, sf_dir).add_idb("unreach").rule("unreach", ["X"], Atom("customer", "X"), ~Atom("reach", "X"))
    return program.evaluate().result("unreach")


@_query("q42_three_strata", "SELECT c_custkey AS v FROM customer EXCEPT (SELECT c_custkey FROM customer EXCEPT SELECT c_custkey FROM customer WHERE c_custkey < 50)")
def q42_three_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    program = _program(spark, sf_dir).add_idb("base").add_idb("derived").add_idb("fin")
    program.rule("base", ["X"], Atom("customer", "X"), filter=Lt("c_custkey", 50))
    program.rule("derived", ["X"], Atom("customer", "X"), ~Atom("base", "X"))
    return program.rule("fin", ["X"], Atom("customer", "X"), ~Atom("derived", "X")).evaluate().result("fin")


_BETWEEN = "SELECT c_custkey AS v FROM customer WHERE c_custkey < 400 INTERSECT SELECT c_custkey FROM customer WHERE c_custkey >= 100"


@_query("q43_idb_intersect", _BETWEEN)
def q43_idb_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    program = _program(spark, sf_dir).add_idb("a").add_idb("b").add_idb("c")
    program.rule("a", ["X"], Atom("customer", "X"), filter=Lt("c_custkey", 400))
    program.rule("b", ["X"], Atom("customer", "X"), filter=Ge("c_custkey", 100))
    return program.rule("c", ["X"], Atom("a", "X"), Atom("b", "X")).evaluate().result("c")


@_query("q44_three_hop", "SELECT DISTINCT c.o_custkey AS v FROM orders a JOIN orders b ON b.o_orderkey = a.o_custkey JOIN orders c ON c.o_orderkey = b.o_custkey")
def q44_three_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    program = _program(spark, sf_dir).add_idb("s1").add_idb("s2").add_idb("s3")
    program.rule("s1", ["X"], Atom("next", "D", "X"))
    program.rule("s2", ["X"], Atom("s1", "Y"), Atom("next", "Y", "X"))
    return program.rule("s3", ["X"], Atom("s2", "Y"), Atom("next", "Y", "X")).evaluate().result("s3")


@_query("q45_nonlinear", _BETWEEN)
def q45_nonlinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-atom rule within a cycle, whose second atom grows later than its first."""
    program = _program(spark, sf_dir)
    for name in ("a0", "b0", "a", "b1", "b", "c"):
        program.add_idb(name)
    program.rule("a0", ["X"], Atom("customer", "X"), filter=Lt("c_custkey", 400))
    program.rule("b0", ["X"], Atom("customer", "X"), filter=Ge("c_custkey", 100))
    program.rule("a", ["X"], Atom("customer", "X"), Atom("a0", "X"))
    program.rule("b1", ["X"], Atom("customer", "X"), Atom("b0", "X"))
    program.rule("b", ["X"], Atom("customer", "X"), Atom("b1", "X"))
    program.rule("c", ["X"], Atom("a", "X"), Atom("b", "X"))
    # c feeds back into both, so all three are one component
    program.rule("a", ["X"], Atom("c", "X"))
    return program.rule("b", ["X"], Atom("c", "X")).evaluate().result("c")


@_query("q46_const_and_multi_edb", "SELECT DISTINCT l_suppkey AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = 7")
def q46_const_and_multi_edb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _program(spark, sf_dir).add_idb("r").rule("r", ["S"], Atom("line", "O", "S"), Atom("next", "O", Const(7))).evaluate().result("r")


_GROWN = "SELECT event_id AS id FROM events WHERE value >= 50"


@_query("q47_incremental", _GROWN)
def q47_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as it stood after its first 400 rows, then whole."""
    events = read(spark, sf_dir, "events")
    growing = HighWaterFilter(Ge("value", 50), "event_id")
    growing.update(events.where("event_id < 400"))
    return growing.update(events).select(F.col("event_id").alias("id"))


@_query("q48_streaming", _GROWN)
def q48_streaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = read(spark, sf_dir, "events").schema
    started = streaming_filter(spark, sf_dir, schema, Ge("value", 50), f"{folder}/out", f"{folder}/state", ["event_id"], "events.parquet")
    started.awaitTermination()
    return spark.read.schema("event_id long").parquet(f"{folder}/out").select(F.col("event_id").alias("id"))


@_query("q49_dfa", "SELECT DISTINCT b.o_custkey AS v FROM orders a JOIN orders b ON b.o_orderkey = a.o_custkey WHERE a.o_orderkey = 0")
def q49_dfa(spark: SparkSession, sf_dir: str) -> DataFrame:
    program = _program(spark, sf_dir).add_idb("ready").add_idb("active").add_idb("done")
    program.rule("ready", ["C"], Atom("next", "C", "N"), filter=Eq("o_orderkey", 0))
    program.rule("active", ["N"], Atom("ready", "C"), Atom("next", "C", "N"))
    return program.rule("done", ["N"], Atom("active", "C"), Atom("next", "C", "N")).evaluate().result("done")


@_query("q50_mask_column", 'SELECT c_custkey AS id, c_acctbal < 0 AS "match" FROM customer')
def q50_mask_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return execute_mask(read(spark, sf_dir, "customer"), Lt("c_acctbal", 0)).select(F.col("c_custkey").alias("id"), "match")


@_query("q51_popcount_any", "SELECT CAST(count(*) AS BIGINT) AS n, count(*) > 0 AS any_set FROM orders WHERE o_orderstatus = 'F'")
def q51_popcount_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.summary(execute(read(spark, sf_dir, "orders"), Eq("o_orderstatus", "F")).select("o_orderkey"))


# bodies and loops of unusual shapes


@_query(
    "q52_unlinked_atoms",
    "SELECT c_custkey AS v FROM customer WHERE c_acctbal < 0 AND EXISTS (SELECT 1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = 7)",
)
def q52_unlinked_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two atoms that share a variable with each other, but none with the head's."""
    program = _program(spark, sf_dir).add_idb("r")
    program.rule("r", ["X"], Atom("customer", "X"), Atom("line", "O", "S"), Atom("next", "O", Const(7)), filter=Lt("c_acctbal", 0))
    return program.evaluate().result("r")


@_query("q53_recursive_guard", "SELECT DISTINCT o_custkey AS v FROM orders")
def q53_recursive_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recursive rule whose other atom doesn't hold the recursive variable: it holds as soon as there is a start."""
    program = _program(spark, sf_dir).add_idb("r").rule("r", ["X"], Atom("next", "D", "X"), filter=Lt("o_orderkey", 1))
    return program.rule("r", ["X"], Atom("r", "Y"), Atom("next", "Z", "X")).evaluate().result("r")


_TAG63 = "SELECT p_partkey AS id FROM part WHERE p_size >= 25"


@_query("q54_tag63", f"{_TAG63} AND p_type = 'ECONOMY'")
def q54_tag63(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag 63 is the sign bit of Spark's longs; words compare as unsigned all the same."""
    part = read(spark, sf_dir, "part")
    own = [F.when(c, F.lit(tag_bit(t))).otherwise(F.lit(0)) for t, c in ((63, F.col("p_size") >= 25), (0, F.col("p_type") == "ECONOMY"))]
    tagged = part.select(F.col("p_partkey").alias("id"), own[0].bitwiseOR(own[1]).alias("mask"))
    m = Eq("mask", (1 << 63) + 1) & Ge("mask", 1 << 63) & ~Lt("mask", 2)
    return execute_skipping(tagged, m, chunk_summary(tagged, CHUNK), CHUNK).select("id")


# tables of entities


@_query("q55_entity_table", "SELECT range AS id, CAST(0 AS BIGINT) AS mask, CAST(7 AS BIGINT) AS level, CAST(25.5 AS FLOAT) AS health, CAST(3 AS TINYINT) AS status FROM range(1000)")
def q55_entity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = add_column(entity_table(spark, 1000), "level", "u32", 7)
    return add_column(add_column(table, "health", "float", 25.5), "status", "byte", 3)


@_query("q56_set_tag", "SELECT c_custkey AS id, CAST((CASE WHEN c_custkey = 42 THEN 8 ELSE 0 END) + (CASE WHEN c_custkey = 43 THEN 2 ELSE 0 END) AS BIGINT) AS mask FROM customer")
def q56_set_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = as_entities(read(spark, sf_dir, "customer"), "c_custkey")
    return set_tag(set_tag(set_tag(table, 42, 3), 43, 65), 42, 3).select("id", "mask")


_BUYERS = "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice >= 400000)"


@_query("q57_set_tags", f"SELECT c_custkey AS id, CAST((CASE WHEN {_BUYERS} THEN 4 ELSE 0 END) + (CASE WHEN c_custkey IN (1, 2, 3) THEN 1 ELSE 0 END) AS BIGINT) AS mask FROM customer")
def q57_set_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = as_entities(read(spark, sf_dir, "customer"), "c_custkey")
    buyers = execute(read(spark, sf_dir, "orders"), Ge("o_totalprice", 400000)).select("o_custkey")
    return set_tags(set_tags(table, buyers, 2), [1, 2, 3, 3], 0).select("id", "mask")


@_query("q58_chunks", f"SELECT CAST(ceil(count(*) / {CHUNK}.0) AS BIGINT) AS n, false AS missing, true AS absent FROM customer")
def q58_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = as_entities(read(spark, sf_dir, "customer"), "c_custkey")
    row = (num_chunks(table, CHUNK), chunk_summaries_empty(chunk_summary(table, CHUNK)), chunk_summaries_empty(None))
    return spark.createDataFrame([row], "n long, missing boolean, absent boolean")


@_query("q59_strings", "SELECT n_nationkey + 10 AS id, 'path/' || (n_nationkey % 4) AS path FROM nation")
def q59_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text column by the order of keys that don't begin at 0."""
    nation = read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 10).alias("id"))
    return add_strings(nation, "path", [f"path/{k % 4}" for k in range(nation.count())])


@_query("q60_dictionary", "SELECT p_name AS p_name, dense_rank() OVER (ORDER BY p_name) - 1 AS code FROM (SELECT DISTINCT p_name FROM part)")
def q60_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary(read(spark, sf_dir, "part"), "p_name").select("p_name", "code")


@_query(
    "q61_prefix_codes",
    "WITH d AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS code FROM (SELECT DISTINCT p_name FROM part)) "
    "SELECT min(code) AS low, max(code) + 1 AS high FROM d WHERE starts_with(p_name, 'red')",
)
def q61_prefix_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_codes(dictionary(read(spark, sf_dir, "part"), "p_name"), "p_name", "red")


@_query("q62_insert_contains", "SELECT DISTINCT o_custkey AS id, true AS found, false AS before FROM orders UNION SELECT -5, true, false")
def q62_insert_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordering = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    grown = sets.insert(sets.insert(ordering, -5), 1)
    return grown.select("id", F.lit(sets.contains(grown, -5)).alias("found"), F.lit(sets.contains(ordering, -5)).alias("before"))


@_query("q63_words", "SELECT CAST(floor(c_custkey / 64.0) AS BIGINT) AS word, bit_or(CAST(c_custkey % 64 AS BIGINT)) AS low_bits, count(*) AS n, CAST((SELECT ceil(count(*) / 64.0) FROM customer) AS BIGINT) AS n_words FROM customer WHERE c_acctbal < 0 GROUP BY 1")
def q63_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of keys as 64-bit words: each word's population, and the union of the places of its bits."""
    customer = read(spark, sf_dir, "customer")
    found = sets.words(execute(customer, Lt("c_acctbal", 0)).select("c_custkey"))
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit("bits", k) == 1)
    union = F.aggregate(places, F.lit(0).cast("long"), lambda a, k: a.bitwiseOR(k.cast("long")))
    return found.select("word", union.alias("low_bits"), F.bit_count("bits").cast("long").alias("n"), F.lit(sets.num_words(customer.count())).cast("long").alias("n_words"))


@_query("q64_seed_universe", "SELECT o_custkey AS v FROM orders WHERE o_custkey < 100 UNION SELECT c_custkey FROM customer WHERE c_nationkey = 2 AND c_custkey < 100")
def q64_seed_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values from outside beside those of rules; what lies beyond the universe is left out."""
    program = _program(spark, sf_dir).add_idb("r", 100).rule("r", ["X"], Atom("next", "D", "X"))
    program.seed("r", execute(read(spark, sf_dir, "customer"), Eq("c_nationkey", 2)).select("c_custkey"))
    return program.evaluate().result("r")


# leaves of the user's own


@dataclass(frozen=True)
class Multiple(Matcher):
    """Keys that a number divides."""

    field: str
    of: int

    def to_column(self, schema=None, strict_ieee=False):
        return F.pmod(F.col(self.field), F.lit(self.of)) == 0

    def implies_(self, other):
        return isinstance(other, Multiple) and self.field == other.field and self.of % other.of == 0


_filter("q65_own_leaf", "customer", "c_custkey", simplify(Or(Multiple("c_custkey", 6), Multiple("c_custkey", 3), Multiple("c_custkey", 12))) & ~Multiple("c_custkey", 2), "c_custkey % 3 = 0 AND c_custkey % 2 <> 0")
_filter("q66_kernel", "customer", "c_custkey", Kernel(("c_acctbal", "c_nationkey"), lambda a, b: a < b * 100) & Ge("c_nationkey", 5), "c_acctbal < c_nationkey * 100 AND c_nationkey >= 5")


@_query("q67_presence", "SELECT p_partkey AS id FROM part WHERE p_size >= 25 AND p_retailprice >= 950 AND p_size < 40")
def q67_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that have components, told by a flag column and by tag bits, under a condition."""
    tagged = _tagged(spark, sf_dir).withColumn("has", F.expr("int(mask & 1)"))
    return execute(tagged, Eq("has", 1) & HasTags(2) & Lt("p_size", 40)).select("id")


@_query("q68_empty_aggregates", "SELECT op, CAST(0 AS DOUBLE) AS v FROM (VALUES ('sum'), ('max'), ('min'), ('mean'), ('count')) AS t(op)")
def q68_empty_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read(spark, sf_dir, "customer")
    each = [aggregate_frame(customer, Eq("c_nationkey", 999), "c_acctbal", op).select(F.lit(op).alias("op"), "v") for op in ("sum", "max", "min", "mean", "count")]
    return reduce(DataFrame.union, each)


@_query("q69_execute_out", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P'")
def q69_execute_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results into a table of the caller's, which a second call overwrites."""
    sink = f"{shared_folder(spark)}/out-{uuid.uuid4().hex}"
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    execute_out(orders, Eq("o_orderstatus", "F"), sink)
    return execute_out(orders, Eq("o_orderstatus", "P"), sink).select("id")


@_query("q70_objects", "SELECT c_custkey AS id FROM customer WHERE c_nationkey = 2 AND c_acctbal >= 0")
def q70_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline of the bench: a Python function called for each row."""
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return execute_objects(customer, lambda c: c.c_nationkey == 2 and c.c_acctbal >= 0).select(F.col("c_custkey").alias("id"))


@_query(
    "q71_repeated_keys",
    "WITH RECURSIVE h AS (SELECT l_orderkey AS id, l_suppkey AS pid FROM lineitem), r(id) AS (SELECT id FROM h WHERE id < 3 UNION SELECT h.id FROM h JOIN r ON h.pid = r.id) SELECT id FROM r",
)
def q71_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closure over a table in which a key comes several times, with other pointers."""
    return descendants(read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as id", "l_suppkey as pid"), Lt("id", 3), "pid")


# the reference's own benchmark shapes, whose size the tables don't set


@_query("q72_long_chain", "SELECT range AS id FROM range(1000)")
def q72_long_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of 1000 among 100,000 rows that point nowhere."""
    chain = spark.range(100_000).selectExpr("id", "case when id between 1 and 999 then id - 1 else 999999999 end as pid")
    return descendants(chain, Eq("id", 0), "pid")


@_query("q73_complete_graph", "SELECT range AS v FROM range(32)")
def q73_complete_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = spark.range(32)
    edges = nodes.selectExpr("id as src", "explode(sequence(0, 31)) as dst").where("src <> dst")
    program = Program(spark).add_edb("edge", edges, ["src", "dst"]).add_idb("reach").rule("reach", ["X"], Atom("edge", "X", "D"), filter=Eq("src", 0))
    return program.rule("reach", ["X"], Atom("reach", "Y"), Atom("edge", "Y", "X")).evaluate().result("reach")
