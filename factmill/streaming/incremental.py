"""Filters over tables that only grow: rows that were seen are never evaluated again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from factmill.functions.predicates import Matcher
from factmill.operators.execute import execute
from factmill.sources.checkpoints import cut, cut_union, release


class HighWaterFilter:
    """All matches so far, and the key from which on rows are new.

    Keys only grow: a row that comes later with a key below the mark, or without one, is
    not seen. The first update takes every key, negative ones included.
    """

    def __init__(self, matcher: Matcher, key: str = "id"):
        self.matcher, self.key = matcher, key
        self.mark, self.started = 0, False
        self.parts: list[DataFrame] = []
        self.result: DataFrame | None = None

    def update(self, df: DataFrame) -> DataFrame:
        """Evaluates rows from the mark on; returns the matching keys of all rows up to now."""
        fresh = df.where(F.col(self.key) >= self.mark) if self.started else df
        top = fresh.agg(F.max(self.key)).first()[0]
        if top is not None:
            # rows that are added while this runs wait for the next update
            self.parts.append(cut(execute(fresh.where(F.col(self.key) <= top), self.matcher).select(self.key)))
            if len(self.parts) == 8:  # so that the plan stays short however many updates there are
                whole = self._whole()
                old, self.parts = self.parts, [cut_union(whole, whole.limit(0))]
                release(*old)
            self.result = self._whole()
            self.mark, self.started = top + 1, True
        elif self.result is None:
            self.result = execute(fresh, self.matcher).select(self.key)
        return self.result

    def _whole(self) -> DataFrame:
        return reduce(DataFrame.union, self.parts)


def streaming_filter(
    spark: SparkSession, source: str, schema: StructType, matcher: Matcher, sink: str, checkpoint: str, columns: list[str] | None = None, pattern: str | None = None
) -> StreamingQuery:
    """Starts a query that appends the matching rows of all files not seen yet to sink, and ends.

    Called again with the same checkpoint it takes only what has come since. Predicates
    on streams are stateless: memberships of static tables are allowed.
    """
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    matching = execute(reader.parquet(source), matcher)
    out = matching.select(*columns) if columns else matching
    return out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
