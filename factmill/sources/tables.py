"""Entity tables: DataFrames with a dense key `id` and a tag word `mask`."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factmill.functions.predicates import signed
from factmill.sources.checkpoints import cut

CHUNK = 1024


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def entity_table(spark: SparkSession, rows: int) -> DataFrame:
    """id 0 to rows - 1 and an empty mask."""
    return spark.range(rows).withColumn("mask", F.lit(0).cast("long"))


def as_entities(df: DataFrame, key: str) -> DataFrame:
    """df with its dense key as `id` and, if it has none, an empty mask."""
    out = df.withColumn("id", F.col(key).cast("long")) if key != "id" else df
    return out if "mask" in out.columns else out.withColumn("mask", F.lit(0).cast("long"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with `id` by the given order, for tables without a dense key.

    Ranks within range partitions plus the sizes of those before: no single task sorts
    the table. The ranges are kept once dealt, as dealing them anew may draw other bounds.
    Ties are numbered in any order.
    """
    spread = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # one row to each partition
    start = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    ranked = spread.withColumn("_rank", within).join(F.broadcast(start), "_part")
    return ranked.withColumn("id", F.col("_start") + F.col("_rank") - 1).drop("_part", "_rank", "_start")


def add_column(df: DataFrame, name: str, kind: str, value: Any = 0) -> DataFrame:
    """A constant column of a Spark type; "u32" is a long that is checked to be in range."""
    if name in df.columns:
        raise ValueError(f"there is a column {name!r} already")
    if kind == "u32":
        if not 0 <= value < 1 << 32:
            raise ValueError(f"{value} is no unsigned 32-bit number")
        kind = "long"
    return df.withColumn(name, F.lit(value).cast(kind))


def add_strings(df: DataFrame, name: str, values: list[str], key: str = "id") -> DataFrame:
    """A text column from one value for each row, the rows in order of their key, which is unique."""
    if name in df.columns:
        raise ValueError(f"there is a column {name!r} already")
    if df.count() != len(values):
        raise ValueError("there must be one value for each row")
    keys = df.select(F.col(key).alias("_key"))
    if keys.where("_key is not null").distinct().count() != len(values):
        raise ValueError(f"{key!r} must hold a value of its own in each row")
    own = df.sparkSession.createDataFrame(list(enumerate(values)), f"id long, {name} string")
    by_key = numbered(keys, "_key").join(own, "id").select("_key", name)
    return df.join(by_key, df[key] == by_key["_key"]).drop("_key")


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(column, code): the distinct texts and their ranks from 0."""
    return numbered(df.select(column).distinct(), column).withColumnRenamed("id", "code")


def prefix_codes(codes: DataFrame, column: str, prefix: str) -> DataFrame:
    """(low, high): the half-open range of codes whose texts begin with prefix; nulls if there are none."""
    return codes.where(F.col(column).startswith(prefix)).agg(F.min("code").alias("low"), (F.max("code") + 1).alias("high"))


def tag_bit(tag: int) -> int:
    if tag < 0:
        raise ValueError("a tag is a number from 0")
    return signed(1 << tag % 64)


def set_tag(df: DataFrame, entity: int, tag: int, key: str = "id") -> DataFrame:
    return df.withColumn("mask", F.when(F.col(key) == entity, F.col("mask").bitwiseOR(F.lit(tag_bit(tag)))).otherwise(F.col("mask")))


def set_tags(df: DataFrame, entities: DataFrame | Iterable[int], tag: int, key: str = "id") -> DataFrame:
    """df with a tag set on many rows, given as a one-column DataFrame or a list."""
    if not isinstance(entities, DataFrame):
        entities = df.sparkSession.createDataFrame([(int(e),) for e in entities], "e long")
    own = entities.toDF("_entity").distinct().withColumn("_hit", F.lit(True))
    tagged = F.when(F.col("_hit"), F.col("mask").bitwiseOR(F.lit(tag_bit(tag)))).otherwise(F.col("mask"))
    return df.join(own, df[key] == own["_entity"], "left").withColumn("mask", tagged).drop("_entity", "_hit")


def num_chunks(df: DataFrame, chunk: int = CHUNK) -> int:
    return -(-df.count() // chunk)


def chunk_summaries_empty(summary: DataFrame | None) -> bool:
    """Whether no chunk summary is at hand, so that nothing can be skipped."""
    return summary is None or summary.isEmpty()


def store_chunked(df: DataFrame, folder: str, chunk: int = CHUNK, key: str = "id", files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Writes df ordered by key, and its chunk summary, below folder; returns both as tables.

    Keys are dealt out by range and sorted within files, so that Parquet's statistics tell
    which files and row groups a range of keys can be in.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    dealt.sortWithinPartitions(key).write.mode("overwrite").parquet(f"{folder}/rows")
    rows = spark.read.schema(df.schema).parquet(f"{folder}/rows")
    chunk_summary(rows, chunk, key).write.mode("overwrite").parquet(f"{folder}/chunks")
    return rows, spark.read.schema("chunk_id long, summary long").parquet(f"{folder}/chunks")


def chunk_summary(df: DataFrame, chunk: int = CHUNK, key: str = "id") -> DataFrame:
    """chunk_id and summary, the union of the tag words of each run of `chunk` keys."""
    return df.groupBy(F.expr(f"(`{key}` - pmod(`{key}`, {chunk}L)) div {chunk}").alias("chunk_id")).agg(F.bit_or("mask").alias("summary"))
