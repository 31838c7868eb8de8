"""Running predicates, semi-joins and aggregates."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from factmill.functions.predicates import And, In, Matcher, Not, push_not, required_bits, signed, simplify
from factmill.sources.tables import CHUNK, chunk_summaries_empty

AGGREGATES = ("sum", "max", "min", "mean", "count")
_names = count()
#: Key ranges that a skipping filter holds at most; more chunks than that share ranges.
MOST_RANGES = 256


def _plan(df: DataFrame, matcher: Matcher, strict_ieee: bool = False) -> Matcher:
    """The tree to run: negations at the leaves, redundant parts gone, rows with nulls treated as SQL does.

    With strict_ieee a NaN is neither below a value nor not below it, as a null is.
    """
    nullable = {f.name for f in df.schema.fields if f.nullable or (strict_ieee and isinstance(f.dataType, (FloatType, DoubleType)))}
    return simplify(push_not(matcher), nullable)


def _single(values: DataFrame) -> tuple[DataFrame, str]:
    name = f"_in_{next(_names)}"
    return values.toDF(name), name


def _flagged(df: DataFrame, m: Matcher, strict_ieee: bool) -> tuple[DataFrame, Column, list[str]]:
    """df with an existence flag for each membership below m, m as a column over it, and the flags' names."""
    if m.is_static:
        return df, m.to_column(df.schema, strict_ieee), []
    if isinstance(m, In):
        values, name = _single(m.values)
        flag = f"{name}_hit"
        marked = values.where(F.col(name).isNotNull()).distinct().withColumn(flag, F.lit(True))
        return df.join(marked, df[m.field] == marked[name], "left").drop(name), F.col(flag).isNotNull(), [flag]
    parts = (m.part,) if isinstance(m, Not) else m.parts
    columns, names = [], []
    for p in parts:
        df, column, own = _flagged(df, p, strict_ieee)
        columns.append(column)
        names += own
    out = ~columns[0] if isinstance(m, Not) else columns[0]
    for c in columns[1:]:
        out = out & c if isinstance(m, And) else out | c
    return df, out, names


def execute(df: DataFrame, matcher: Matcher, strict_ieee: bool = False) -> DataFrame:
    """The rows of df that the predicate accepts.

    Plain conditions become one filter that reaches the scan. A membership that stands
    as a conjunct becomes a semi-join, its negation an anti-join (which keeps keys that
    are null or dangle); elsewhere it becomes an existence flag.
    """
    m = _plan(df, matcher, strict_ieee)
    conjuncts = m.parts if isinstance(m, And) else (m,)
    static = [c for c in conjuncts if c.is_static]
    if static:
        df = df.where(And.from_list(static).to_column(df.schema, strict_ieee))
    for c in conjuncts:
        if c.is_static:
            continue
        inner = c.part if isinstance(c, Not) else c
        if isinstance(inner, In):
            values, name = _single(inner.values)
            df = df.join(values, df[inner.field] == values[name], "left_anti" if isinstance(c, Not) else "left_semi")
        else:
            columns = df.columns
            flagged, condition, _ = _flagged(df, c, strict_ieee)
            df = flagged.where(condition).select(*columns)
    return df


def execute_mask(df: DataFrame, matcher: Matcher, name: str = "match", strict_ieee: bool = False) -> DataFrame:
    """All rows of df with a boolean column that says whether the predicate accepts them."""
    flagged, condition, flags = _flagged(df, _plan(df, matcher, strict_ieee), strict_ieee)
    return flagged.withColumn(name, F.coalesce(condition, F.lit(False))).drop(*flags)


def execute_out(df: DataFrame, matcher: Matcher, sink: str, strict_ieee: bool = False) -> DataFrame:
    """execute into a Parquet table that the caller owns and that each call overwrites; returns what was written."""
    matching = execute(df, matcher, strict_ieee)
    matching.write.mode("overwrite").parquet(sink)
    return df.sparkSession.read.schema(matching.schema).parquet(sink)


def live_ranges(summary: DataFrame | None, bits: int, chunk: int = CHUNK, most: int = MOST_RANGES) -> list[tuple[int, int]] | None:
    """Half-open key ranges that hold every chunk with all of bits; None where nothing is known.

    Chunks are dealt to `most` equal stretches of the key line, and each stretch gives the
    range from its first live chunk to its last, so at most that many rows come back.
    """
    if chunk_summaries_empty(summary) or not bits:
        return None
    bits = signed(bits)
    known = summary.where("chunk_id is not null")
    ends = known.agg(F.min("chunk_id"), F.max("chunk_id")).first()
    if ends[0] is None:
        return []
    width = max(1, -(-(ends[1] - ends[0] + 1) // most))
    live = known.where(F.col("summary").bitwiseAND(F.lit(bits)) == bits)
    stretches = live.groupBy(F.expr(f"(chunk_id - {ends[0]}) div {width}").alias("s")).agg(F.min("chunk_id").alias("low"), F.max("chunk_id").alias("high"))
    out: list[tuple[int, int]] = []
    for r in sorted(stretches.collect()):
        if out and out[-1][1] == r["low"] * chunk:
            out[-1] = (out[-1][0], (r["high"] + 1) * chunk)
        else:
            out.append((r["low"] * chunk, (r["high"] + 1) * chunk))
    return out


def execute_skipping(df: DataFrame, matcher: Matcher, summary: DataFrame | None, chunk: int = CHUNK, key: str = "id", strict_ieee: bool = False) -> DataFrame:
    """As execute, but chunks whose summary lacks a required tag bit are left out first.

    summary is chunk_summary(df), best kept beside the table (store_chunked keeps both).
    Live chunks become key ranges in the filter, which Parquet compares with its own
    statistics, so files and row groups of other chunks are never read where the table is
    ordered by key. The result doesn't depend on it: rows without a key are in no chunk
    and are always evaluated.
    """
    ranges = live_ranges(summary, required_bits(simplify(push_not(matcher))), chunk)
    if ranges is not None:
        within = F.col(key).isNull()
        for low, high in ranges:
            within = within | ((F.col(key) >= low) & (F.col(key) < high))
        df = df.where(within)
    return execute(df, matcher, strict_ieee)


def semi_join(target: DataFrame, query: Matcher, fk_field: str, target_key: str = "id") -> In:
    """A predicate for another table: its fk_field is the key of a target row that query accepts. Lazy."""
    return In(fk_field, execute(target, query).select(target_key))


def aggregate_frame(df: DataFrame, matcher: Matcher, column: str, op: str = "sum", name: str = "v") -> DataFrame:
    """One row, one double: the aggregate over accepted rows, 0.0 where there are none."""
    if op not in AGGREGATES:
        raise ValueError(f"{op!r} is none of {', '.join(AGGREGATES)}")
    value = F.col(column).cast("double")
    folded = F.count(F.lit(1)).cast("double") if op == "count" else {"sum": F.sum, "max": F.max, "min": F.min, "mean": F.avg}[op](value)
    return execute(df, matcher).agg(F.coalesce(folded, F.lit(0.0)).alias(name))


def aggregate(df: DataFrame, matcher: Matcher, column: str, op: str = "sum") -> float:
    return aggregate_frame(df, matcher, column, op).first()[0]
