"""License scans by diagonal voting.

Every five-word window of a document is hashed; windows whose hash is that of a template's
window are joined to the place where it stands there, and their words compared. A match
votes for its diagonal, the offset between the two places. In order of the document, votes
on the same or a neighbouring diagonal merge into a span as long as the place in the
template moves on: words put in or left out move the diagonal a little, while a notice
that begins anew falls back and is a span of its own. A span is verified if it covers
enough of the template's windows, in their order, and isn't longer than the template
allows; of verified spans that overlap, that of the best covered template counts.

Texts are split into words once. What leaves that pass is a few numbers for each document,
and the matching windows; windows that match nothing are dropped where they are made.
Beside it, fixed phrases are found wherever their words stand consecutively.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, let

GRAM = 5
#: Diagonals this far apart still merge; a span covers this share of its template's windows
#: at least, and is at most this many times as long.
DRIFT = 6
COVERAGE = 0.8
STRETCH = 1.5

# Phrases with their labels, and license notices with theirs.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased."""
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), _GAPS), lambda w: w != "")


def template_words(text: str) -> list[str]:
    import re

    return re.sub(_GAPS, " ", "".join(c.lower() if c.isascii() else c for c in text)).split()


def template_table(spark: SparkSession) -> DataFrame:
    """template, label, n_grams, n_words, at, gram, words: one row to each window of each template."""
    rows = []
    for t, (label, text) in enumerate(TEMPLATES):
        w = template_words(text)
        rows += [(t, label, len(w) - GRAM + 1, len(w), at, w[at : at + GRAM]) for at in range(len(w) - GRAM + 1)]
    table = spark.createDataFrame(rows, "template int, label string, n_grams int, n_words int, at int, words array<string>")
    return table.withColumn("gram", _gram(F.col("words"), F.lit(0)))


def _gram(w: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(w, i + k) for k in range(GRAM)])


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, n_words, places (of the phrases), hits: one row per row of docs.

    hits are the windows whose hash some template's window has: place, hash and words.
    """
    table = template_table(docs.sparkSession)
    hashes = [r["gram"] for r in table.select("gram").distinct().collect()]  # a few hundred, fixed by TEMPLATES
    vocabulary = sorted({w for _, text in TEMPLATES for w in template_words(text)})
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def stands(w: Column, phrase: str, label: str) -> Column:
        parts = phrase.split()
        starts = F.filter(F.sequence(F.lit(0), F.size(w) - len(parts)), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(len(parts))]) == phrase)
        return F.transform(starts, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))

    def places(w: Column) -> Column:
        none = F.array().cast("array<struct<at:bigint,label:string>>")
        found = lambda line: F.flatten(F.array(*[F.when(F.contains(line, F.lit(f" {p} ")), stands(w, p, label)).otherwise(none) for p, label in PHRASES.items()]))
        return let(F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" ")), found)

    def hits(w: Column) -> Column:
        # the ends' words are looked up first, which spares most hashes
        likely = lambda i: F.get(w, i).isin(vocabulary) & F.get(w, i + GRAM - 1).isin(vocabulary)
        at = F.filter(F.sequence(F.lit(0), F.size(w) - GRAM), lambda i: likely(i) & _gram(w, i).isin(hashes))
        found = F.transform(at, lambda i: F.struct(i.cast("long").alias("pos"), _gram(w, i).alias("gram"), F.slice(w, i + 1, GRAM).alias("words")))
        return F.when(F.size(w) >= GRAM, found)

    scanned = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), places(w).alias("places"), hits(w).alias("hits")))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), scanned.alias("f")).select("row", "doc_id", "f.*")


def spans(scanned: DataFrame) -> DataFrame:
    """row, template, label, start, end (words, end exclusive), coverage, diagonals of every verified license span of windows()."""
    own = scanned.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    # broadcast: a few hundred rows, fixed by TEMPLATES
    table = F.broadcast(template_table(scanned.sparkSession).withColumnRenamed("words", "own_words"))
    hits = own.join(table, "gram").where(F.col("words") == F.col("own_words")).select("row", "template", "label", "n_grams", "n_words", "pos", "at", (F.col("pos") - F.col("at")).alias("diagonal"))
    order = Window.partitionBy("row", "template").orderBy("pos")
    anew = (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > DRIFT) | (F.col("at") <= F.lag("at").over(order))
    runs = hits.withColumn("anew", F.coalesce(anew.cast("int"), F.lit(0))).withColumn("run", F.sum("anew").over(order))
    merged = runs.groupBy("row", "template", "label", "n_grams", "n_words", "run").agg(
        F.count("*").alias("matched"), F.min("pos").alias("start"), (F.max("pos") + GRAM).alias("end"), F.countDistinct("diagonal").alias("diagonals")
    )
    fits = (F.col("matched") >= COVERAGE * F.col("n_grams")) & (F.col("end") - F.col("start") <= STRETCH * F.col("n_words"))
    verified = merged.where(fits).withColumn("coverage", F.col("matched") / F.col("n_grams"))
    # what may overlap a span begins within the longest span's length of its start, so few are looked at
    longest = math.ceil(STRETCH * max(len(template_words(t)) for _, t in TEMPLATES))
    near = Window.partitionBy("row").orderBy("start").rangeBetween(-longest, longest)
    ranked = verified.withColumn("rank", F.struct("coverage", "n_words", (-F.col("template")).alias("t")))
    around = ranked.withColumn("around", F.collect_list(F.struct("rank", "start", "end")).over(near))
    better = F.exists("around", lambda o: (o["rank"] > F.col("rank")) & (o["start"] < F.col("end")) & (F.col("start") < o["end"]))
    return around.where(~better).select("row", "template", "label", "start", "end", "coverage", "diagonals")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    score is the best coverage of a license span, one half if only a phrase is found,
    else 0. Overlapping spans of equal coverage leave the longer template's, then the one
    listed first. Null texts count as empty. Repeated rows each get their row, null
    identifiers stay, further columns are ignored, an empty table gives no rows.
    """
    base = cut(windows(docs, id_col, text_col))
    found = spans(base.select("row", "hits")).groupBy("row").agg(
        F.collect_set("label").alias("more"), F.max("coverage").alias("best"), F.sort_array(F.collect_list(F.struct("start", "end", "label", "coverage"))).alias("spans")
    )
    both = base.drop("hits").join(found, "row", "left")
    none = F.array().cast("array<string>")
    own = F.transform("places", lambda p: p["label"])
    at = F.transform("places", lambda p: p["at"])
    joined = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    return both.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        joined(own).alias("base_labels"),
        joined(F.concat(own, F.coalesce("more", none))).alias("labels"),
        F.coalesce("best", F.when(F.size("places") > 0, 0.5).otherwise(0.0)).alias("score"),
        "spans",
    )


def oracle_sql() -> str:
    """DuckDB SQL for the query's rows; windows are compared as strings."""
    templates = ", ".join(f"({t}, '{label}', '{' '.join(template_words(text))}')" for t, (label, text) in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    grams = f"list_transform(range(1, len(words) - {GRAM - 2}), lambda i: array_to_string(words[i:i + {GRAM - 1}], ' '))"
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{gap}'), lambda w: w <> '') AS words
  FROM documents),
templates AS (
  SELECT template, label, string_split(line, ' ') AS words FROM (VALUES {templates}) AS t(template, label, line)),
tgrams AS (
  SELECT template, label, len(words) AS n_words, len(words) - {GRAM - 1} AS n_grams, unnest(range(0, len(words) - {GRAM - 1})) AS place, unnest({grams}) AS gram FROM templates),
grams AS (SELECT r, unnest(range(0, len(words) - {GRAM - 1})) AS pos, unnest({grams}) AS gram FROM docs WHERE len(words) >= {GRAM}),
hits AS (SELECT r, template, label, n_words, n_grams, pos, place, pos - place AS diagonal FROM grams JOIN tgrams USING (gram)),
marked AS (
  SELECT *, CASE WHEN abs(diagonal - lag(diagonal) OVER w) > {DRIFT} OR place <= lag(place) OVER w THEN 1 ELSE 0 END AS anew FROM hits WINDOW w AS (PARTITION BY r, template ORDER BY pos)),
runs AS (SELECT *, sum(anew) OVER (PARTITION BY r, template ORDER BY pos) AS run FROM marked),
merged AS (SELECT r, template, label, n_words, n_grams, run, count(*) AS matched, min(pos) AS s, max(pos) + {GRAM} AS e FROM runs GROUP BY ALL),
verified AS (SELECT *, matched / n_grams AS coverage FROM merged WHERE matched >= {COVERAGE} * n_grams AND e - s <= {STRETCH} * n_words),
spans AS (
  SELECT r, label, coverage FROM verified v WHERE NOT EXISTS (
    SELECT 1 FROM verified o WHERE o.r = v.r AND o.s < v.e AND v.s < o.e AND (o.coverage, o.n_words, -o.template) > (v.coverage, v.n_words, -v.template))),
best AS (SELECT r, max(coverage) AS best, list(label) AS more FROM spans GROUP BY r),
phrases AS (SELECT * FROM (VALUES {phrases}) AS p(phrase, label, n)),
places AS (
  SELECT r, label, unnest(list_filter(range(0, CAST(len(words) AS BIGINT) - n + 1), lambda i: array_to_string(words[i + 1:i + n], ' ') = phrase)) AS place
  FROM docs, phrases WHERE contains(' ' || array_to_string(words, ' ') || ' ', ' ' || phrase || ' ')),
base AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(label) AS own FROM places GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(list_distinct(own)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(own, more))), ','), '') AS labels,
  coalesce(best, CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END) AS score
FROM docs LEFT JOIN base USING (r) LEFT JOIN best USING (r)
"""
