"""Transitive closure.

Where each row points to one other at most, pointers double: after k rounds a row knows
what lies 2^k steps ahead, so the rounds grow with the logarithm of the depth, and a
round that adds nothing ends it (a row at distance 2^k or more has one at exactly 2^k on
its way). Relations with several successors go by deltas, one round to each step.
Tables of earlier rounds are deleted as soon as the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from factmill.functions.predicates import In, Matcher
from factmill.operators.execute import execute
from factmill.sources.checkpoints import cut, cut_counted, cut_union, release


def descendants(df: DataFrame, seed: Matcher, fk_field: str, key: str = "id") -> DataFrame:
    """(key): the rows that seed accepts and all whose chain of fk_field leads to one, each key once.

    Cycles are fine. Rows without a key are left out. A key that comes again with another
    fk_field has several chains, of which one must lead to a seed; such tables go by deltas.
    """
    seeds = execute(df, seed).select(F.col(key).cast("long").alias("id")).where("id is not null").distinct()
    pairs = df.select(F.col(key).cast("long").alias("id"), F.col(fk_field).cast("long").alias("up")).where("id is not null")
    flagged = seeds.withColumn("hit", F.lit(True))
    by_key = pairs.groupBy("id").agg(F.min("up").alias("up"), F.max("up").alias("other"))
    several = Observation()
    by_key = by_key.observe(several, F.count(F.when(F.col("up") != F.col("other"), 1)).alias("n"))
    state, found = cut_counted(by_key.join(flagged, "id", "left").select("id", "up", F.coalesce("hit", F.lit(False)).alias("hit")), "hit")
    if several.get["n"]:
        edges = pairs.where("up is not null").select(F.col("up").alias("src"), F.col("id").alias("dst"))
        return reach(edges, state.where("hit").select(F.col("id").alias("v")), False).select(F.col("v").alias(key))
    # hits are final and stay where they were written; only open rows are written again
    hits, open_, rounds = state.where("hit").select("id"), state.where("not hit and up is not null").select("id", "up"), [state]
    while found:
        ahead = open_.select(F.col("id").alias("up"), F.col("up").alias("next_up"), F.lit(False).alias("up_hit"))
        ahead = ahead.union(hits.select("id", F.lit(None).cast("long"), F.lit(True)))
        # a pointer that meets neither ends in a row that is settled or missing, so its row is settled too
        moved = open_.join(ahead, "up").where("up_hit or next_up is not null").select("id", F.col("next_up").alias("up"), F.col("up_hit").alias("hit"))
        state, found = cut_counted(moved, "hit")
        rounds.append(state)
        hits = hits.union(state.where("hit").select("id"))
        open_ = state.where("not hit").select("id", "up")
        if len(rounds) % 8 == 0:
            hits, old = cut_union(hits, hits.limit(0)), rounds[:-1]
            release(*old)
            rounds = [hits, state]
    return hits.select(F.col("id").alias(key))


def semi_naive_join(df: DataFrame, seed: Matcher, fk_field: str, key: str = "id") -> In:
    """descendants as a predicate of key, to be combined with others."""
    return In(key, descendants(df, seed, fk_field, key))


def reach(edges: DataFrame, seeds: DataFrame, single_valued: bool | None = None) -> DataFrame:
    """(v): seeds and all that edges (src, dst) lead to from them. single_valued is found out if not told."""
    step = cut(edges.toDF("src", "dst").where("src is not null and dst is not null").distinct())
    total = cut(seeds.toDF("v").where("v is not null").distinct())
    if single_valued is None:
        single_valued = step.groupBy("src").count().where("count > 1").isEmpty()
    return _reach_doubling(step, total) if single_valued else _reach_deltas(step, total)


def _ahead(step: DataFrame, total: DataFrame) -> DataFrame:
    """total, and where step leads from it."""
    led = step.join(total, step["src"] == total["v"], "left_semi").select(F.col("dst").alias("v"))
    return total.union(led).distinct()


def _twice(step: DataFrame) -> DataFrame:
    second = step.select(F.col("src").alias("mid"), F.col("dst").alias("far"))
    return step.join(second, step["dst"] == second["mid"]).select("src", F.col("far").alias("dst"))


def _reach_doubling(step: DataFrame, total: DataFrame) -> DataFrame:
    """Two doublings to a round: what a round writes is read by both of the next one's."""
    # only nodes that are a seed or led to can ever be passed through
    starts = total.select("v").union(step.select(F.col("dst").alias("v"))).distinct()
    whole, step = step, cut(step.join(starts, step["src"] == starts["v"], "left_semi"))
    release(whole)
    n = -1
    while True:
        twice = _twice(step)
        before, (total, now) = total, cut_counted(_ahead(twice, _ahead(step, total)))
        release(before)
        if now == n:
            return total
        n, before, step = now, step, cut(_twice(twice))
        release(before)


def _reach_deltas(step: DataFrame, total: DataFrame) -> DataFrame:
    delta, parts, n = total, [total], 1
    while n:
        ahead = step.join(delta, step["src"] == delta["v"], "left_semi").select(F.col("dst").alias("v")).distinct()
        delta, n = cut_counted(ahead.join(total, "v", "left_anti"))
        total, parts = total.union(delta), [*parts, delta]
        if len(parts) == 8:
            total = cut_union(total, total.limit(0))
            release(*(p for p in parts if p is not delta))
            parts = [total, delta]
    return total
