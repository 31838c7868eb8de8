"""Sets of keys, each a DataFrame of one column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def complement(a: DataFrame, universe: int) -> DataFrame:
    """The keys from 0 to universe - 1 that a lacks."""
    name = a.columns[0]
    every = a.sparkSession.range(universe).toDF(name)
    return every.join(a, name, "left_anti")


def contains(a: DataFrame, key: int) -> bool:
    return not a.where(F.col(a.columns[0]) == key).isEmpty()


def insert(a: DataFrame, key: int) -> DataFrame:
    return union(a, a.sparkSession.createDataFrame([(key,)], a.schema))


def popcount(a: DataFrame) -> int:
    return a.count()


def any_set(a: DataFrame) -> bool:
    return not a.isEmpty()


def summary(a: DataFrame) -> DataFrame:
    """n and any_set in one row."""
    return a.agg(F.count("*").alias("n"), (F.count("*") > 0).alias("any_set"))


def num_words(universe: int) -> int:
    """64-bit words that hold a set of keys below universe as bits."""
    return -(-universe // 64)


def words(a: DataFrame) -> DataFrame:
    """word and bits: the set as 64-bit words, those without a key left out; the form in which sets of dense keys are small."""
    key = F.col(a.columns[0])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(key, F.lit(64)).cast("int"))
    return a.where(key >= 0).groupBy(F.expr(f"`{a.columns[0]}` div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))
