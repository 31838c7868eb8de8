"""Quality rules whose limits adapt to each language and source. DataFrame operations only.

Each document gets exact counts (words, symbols, repeated lines, repeated five-word
windows) and integer measures. For each language and source a quantile sketch of every
measure is kept: counts by logarithmic-linear bins, 32 to each doubling, so a quantile is
off by one part in 32 at most. The sketches merge by adding counts, which makes them
plain partial aggregations, the same on every run and for any split of the rows.

A limit lies as many spreads from its group's median as `spreads` says, a spread being the
distance from the median to the tail quantile on that side. Quantiles of small groups are
drawn towards those of all documents together: a group of n documents counts n, all
documents together count SHRINK, so there is no size at which the rule changes. Limits
are then joined back. A floor keeps a measure that is 0 in nearly every document of a
group from rejecting a few stray characters.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, let

# Fixed values of the base rules.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: How many documents the quantiles of all documents count for beside a group's own.
SHRINK = 100


class Rule(NamedTuple):
    """Tail quantiles (percent), spreads from the median to a limit, and the least distance of the upper one."""

    high: int
    low: int | None
    spreads: int
    floor: int


#: Shares of symbols, of capitals and of repeated lines in 1/10000, and mean word length in 1/100
#: characters. Repeated windows are left to the base rule.
MEASURES = {
    "symbol_share": Rule(75, None, 4, 100),
    "capital_share": Rule(98, None, 4, 0),
    "dup_line_share": Rule(98, None, 3, 0),
    "word_length": Rule(90, 10, 4, 0),
}
_PERCENTS = sorted({50} | {q for r in MEASURES.values() for q in (r.high, r.low) if q is not None})


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeat_words(words: Column) -> Column:
    """Words of all five-word windows whose words come twice or more.

    Equal windows have equal hashes, so a text without equal hashes needs no more work;
    else the windows themselves are sorted, and neighbours compared.
    """
    n = F.size(words)
    places = F.sequence(F.lit(0), n - WINDOW)
    hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    windows = F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, WINDOW)).alias("w"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        own = F.transform(
            s, lambda x, j: F.when((F.get(s, j - 1)["w"] == x["w"]) | (F.get(s, j + 1)["w"] == x["w"]), x["i"])
        )
        return F.array_sort(F.filter(own, lambda i: i.isNotNull()))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda i, j: F.least(F.coalesce(F.get(at, j + 1) - i, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    exact = let(windows, lambda s: let(repeated(s), covered))
    hashed = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(exact))
    return F.when(n < WINDOW + 1, F.lit(0).cast("long")).otherwise(hashed)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source, the exact counts, and the measures of every document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(text, "[ \t-\r]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: _without(x, BLANKS) != "")
    counted = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))).alias("by_word"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("by_line"),
        F.length(_without(text, BLANKS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(_without(text, CAPITALS))).cast("long").alias("n_capitals"),
    )
    share = lambda a, b, by=10_000: F.expr(f"{a} * {by} div greatest({b}, 1)")
    return counted.select(
        "doc_id", "lang", "source", "by_word.*", "by_line.*", "word_chars", "n_symbols", "n_capitals"
    ).select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words").alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_capitals", "word_chars").alias("capital_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("word_chars", "n_words", 100).alias("word_length"),
    )


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure, bin, n: a mergeable quantile sketch of each measure in each group.

    A bin is named by its least value. Documents that fail a base rule don't count.
    """
    each = measured.where("not base_failed").select(
        "lang", "source", F.explode(F.create_map(*[x for m in MEASURES for x in (F.lit(m), F.col(m))])).alias("measure", "v")
    )
    low = F.greatest(F.length(F.bin("v")) - 6, F.lit(0))
    binned = each.withColumn("k", low).select("lang", "source", "measure", F.expr("shiftleft(shiftright(v, k), k)").alias("bin"))
    return binned.groupBy("lang", "source", "measure", "bin").agg(F.count("*").alias("n"))


def merge(sketched: DataFrame, *keys: str) -> DataFrame:
    """The sketches merged over all columns but keys, measure and bin."""
    return sketched.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))


def quantiles(sketched: DataFrame, *keys: str) -> DataFrame:
    """keys, measure, group_n and the quantiles p10 to p98 of every measure, one row to each of a group's measures."""
    group = Window.partitionBy(*keys, "measure")
    ranked = sketched.select(
        *keys, "measure", "bin", F.sum("n").over(group.orderBy("bin")).alias("upto"), F.sum("n").over(group).alias("total")
    )
    picked = [F.min(F.when(F.expr(f"100 * upto >= {p} * total"), F.col("bin"))).alias(f"p{p}") for p in _PERCENTS]
    return ranked.groupBy(*keys, "measure").agg(F.max("total").alias("group_n"), *picked)


def limits(sketched: DataFrame) -> DataFrame:
    """lang, source, and a lower and upper limit of every measure, one row to a group."""
    own = quantiles(sketched, "lang", "source")
    pooled = quantiles(merge(sketched)).select("measure", *[F.col(f"p{p}").alias(f"all_p{p}") for p in _PERCENTS])
    # broadcast: one row to each measure
    both = own.join(F.broadcast(pooled), "measure")
    drawn = both.select("lang", "source", "measure", *[F.expr(f"(group_n * p{p} + {SHRINK} * all_p{p}) div (group_n + {SHRINK})").alias(f"p{p}") for p in _PERCENTS])
    wide = []
    for m, r in MEASURES.items():
        of = lambda e, m=m: F.max(F.when(F.col("measure") == m, F.expr(e)))
        wide.append(of(f"p50 + greatest({r.spreads} * (p{r.high} - p50), {r.floor}) + p50 div 32 + 1").alias(f"{m}_upper"))
        if r.low is not None:
            wide.append(of(f"p50 - {r.spreads} * (p50 - p{r.low}) - p50 div 32 - 1").alias(f"{m}_lower"))
    return drawn.groupBy("lang", "source").agg(*wide)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of docs: its counts and measures, base_failed, and kept.

    kept is false if a base rule fails or a measure lies beyond its group's limits; a
    measure that equals its limit is within it. Null texts count as empty and fail for
    want of words; a null language or source counts as an empty name; repeated rows each
    get their row; other columns are ignored; an empty table gives no rows.
    """
    measured = cut(measures(docs, id_col, text_col, lang_col, source_col))
    joined = measured.join(limits(cut(sketches(measured))), ["lang", "source"], "left")
    beyond = F.lit(False)
    for m, r in MEASURES.items():
        beyond = beyond | (F.col(m) > F.col(f"{m}_upper"))
        if r.low is not None:
            beyond = beyond | (F.col(m) < F.col(f"{m}_lower"))
    kept = ~F.col("base_failed") & ~F.coalesce(beyond, F.lit(False))
    return joined.select(*measured.columns, kept.alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge keeps, with all their columns; rows of one doc_id and text are kept or go together."""
    hashed = docs.withColumn("_hash", F.xxhash64("text"))
    named = judge(docs.withColumn("_key", F.struct("doc_id", F.xxhash64("text").alias("h"))), "_key")
    kept = named.where("kept").select(F.col("doc_id.doc_id").alias("_id"), F.col("doc_id.h").alias("_own")).distinct()
    return hashed.join(kept, hashed["doc_id"].eqNullSafe(kept["_id"]) & (hashed["_hash"] == kept["_own"]), "left_semi").select(*docs.columns)


def oracle_sql() -> str:
    """DuckDB SQL for the query's rows, from the same parameters."""
    blank = "[ \\t-\\r]"
    shares = {
        "symbol_share": "n_symbols * 10000 // greatest(word_chars, 1)",
        "capital_share": "n_capitals * 10000 // greatest(word_chars, 1)",
        "dup_line_share": "n_dup_lines * 10000 // greatest(n_lines, 1)",
        "word_length": "word_chars * 100 // greatest(n_words, 1)",
    }
    longs = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM measured WHERE NOT base_failed" for m in MEASURES)
    picked = ", ".join(f"min(bin) FILTER (100 * upto >= {p} * total) AS p{p}" for p in _PERCENTS)
    drawn = ", ".join(f"CAST((o.group_n * o.p{p} + {SHRINK} * a.p{p}) // (o.group_n + {SHRINK}) AS BIGINT) AS p{p}" for p in _PERCENTS)
    wide, over = [], []
    for m, r in MEASURES.items():
        wide.append(f"max(p50 + greatest({r.spreads} * (p{r.high} - p50), {r.floor}) + p50 // 32 + 1) FILTER (measure = '{m}') AS {m}_u")
        over.append(f"m.{m} > {m}_u")
        if r.low is not None:
            wide.append(f"max(p50 - {r.spreads} * (p50 - p{r.low}) - p50 // 32 - 1) FILTER (measure = '{m}') AS {m}_l")
            over.append(f"m.{m} < {m}_l")

    def ranked(name: str, by: str, source: str) -> str:
        return f"""
{name}_ranked AS (SELECT {by}, bin, sum(n) OVER (PARTITION BY {by} ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {by}) AS total FROM {source}),
{name} AS (SELECT {by}, max(total) AS group_n, {picked} FROM {name}_ranked GROUP BY {by})"""

    return f"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT r, doc_id, lang, source, list_filter(string_split_regex(text, '{blank}+'), lambda w: w <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{blank}', '', 'g') <> '') AS lines,
    length(regexp_replace(text, '{blank}', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals
  FROM base),
windows AS (
  SELECT r, unnest(range(1, len(words) - 3)) AS i, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) AS w
  FROM split WHERE len(words) > 5),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows),
steps AS (SELECT r, least(5, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 5)) AS step FROM twice WHERE n > 1),
repeats AS (SELECT r, sum(step) AS n_repeat_words FROM steps GROUP BY r),
counted AS (
  SELECT r, doc_id, lang, source, len(words) AS n_words, word_chars, n_symbols, n_capitals, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM split LEFT JOIN repeats USING (r)),
measured AS (
  SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
    {", ".join(f"{e} AS {m}" for m, e in shares.items())}
  FROM counted),
longs AS ({longs}),
sketch AS (
  SELECT lang, source, measure, (v >> k) << k AS bin, count(*) AS n
  FROM (SELECT *, CAST(greatest(length(bin(CAST(v AS BIGINT))) - 6, 0) AS BIGINT) AS k FROM (SELECT lang, source, measure, CAST(v AS BIGINT) AS v FROM longs))
  GROUP BY ALL),
merged AS (SELECT measure, bin, sum(n) AS n FROM sketch GROUP BY ALL),
{ranked("own", "lang, source, measure", "sketch")},
{ranked("pooled", "measure", "merged")},
drawn AS (SELECT lang, source, measure, {drawn} FROM own o JOIN pooled a USING (measure)),
limits AS (SELECT lang, source, {", ".join(wide)} FROM drawn GROUP BY lang, source)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce({" OR ".join(over)}, false) AS kept
FROM measured m LEFT JOIN limits USING (lang, source)
"""
