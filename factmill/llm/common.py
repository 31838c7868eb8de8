"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.sources.checkpoints import cut_observed, release, shared_folder

#: Rows of whole texts that go to a Python worker at once, at most.
ARROW_ROWS = 256


def in_small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """stage(spark, ...), after which the session's Arrow batches hold ARROW_ROWS rows at most.

    Spark reads that setting where a result is written, which is up to the caller, so it
    stays with the session. A session that asks for fewer rows keeps its own.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"

    @wraps(stage)
    def bounded(spark: SparkSession, *args) -> DataFrame:
        if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
            spark.conf.set(name, str(ARROW_ROWS))
        return stage(spark, *args)

    return bounded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept as a checkpoint in the shared folder, which Spark cleans up."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row: a lambda binds it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32 of the identifier as text, modulo folds; a null identifier counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def bounded_labels(labels: DataFrame, label: str, most: int, *, folds: int, held_out: int) -> DataFrame:
    """(doc_id, label) of at most about `most` labelled rows outside the held-out fold.

    Rows are taken by a hash of doc_id, so the sample is the same on every run. Rows
    without an identifier or label are of no use here; of repeated rows one counts.
    """
    usable = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .where("doc_id is not null and label is not null")
        .where(fold_of("doc_id", folds) != held_out)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    n = usable.count()
    if n <= most:
        return usable
    return usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Alternates large-star and small-star steps, each a partial aggregation and a join
    that AQE may split, until the edges form stars. Nothing but a count and a checksum
    of the edges reaches the driver. Edges may repeat, point either way or at
    themselves; a null end is no edge.
    """
    state = (F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("sum"))
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNull().alias("x"), F.col(b).isNull().alias("y"))
    e, now = cut_observed(ends.where("not x and not y and u <> v").select("u", "v").distinct(), *state)
    seen = None
    while now != seen and now["n"]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        seen, before = now, e
        e, now = cut_observed(small.union(least.select("u", F.col("m").alias("v"))).distinct(), *state)
        release(before)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
