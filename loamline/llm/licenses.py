"""License scans by diagonal voting: word k-gram hits on templates, counted by offset diagonal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamline.llm.common import read_table
from loamline.llm.windows import window_rows

# The base phrases and their labels; each is one whole k-gram.
BASE_PHRASES = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]
# Openings of public license notices and their labels, found by votes of 3-grams.
TEMPLATES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("released under the mit license", "mit"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
]
#: Words of a template k-gram; neighbouring diagonals this close are one copy; share of a template that must be met.
GRAM, DRIFT, COVERAGE = 3, 2, 0.6


def template_grams(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(tmpl, label, base, size, length, gram, phrase, tpos): every k-gram of every phrase and template."""
    rows = []
    for i, (text, label) in enumerate([*BASE_PHRASES, *templates]):
        words, base = text.split(), i < len(BASE_PHRASES)
        k = len(words) if base else GRAM
        rows += [(i, label, base, len(words), k, " ".join(words[p : p + k]), p) for p in range(len(words) - k + 1)]
    grams = spark.createDataFrame(rows, "tmpl int, label string, base boolean, size int, length int, phrase string, tpos int")
    return grams.withColumn("gram", F.xxhash64(F.split("phrase", " ")))


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    All k-grams of every whole text are joined to the template positions (a table as long as the templates' words, so
    it is broadcast). A hit votes for its diagonal, the document position less the template position. Votes are counted
    by diagonal; diagonals of one template at most ``DRIFT`` apart, as a word put in or left out makes them, are merged.
    A merged span counts as verified if the exact hits on it cover ``coverage`` of the template's words and it isn't
    longer than one and a half templates. The base phrases are templates of one k-gram: each hit is a place.

    score is 1 with a base phrase, else the largest verified coverage, else 0. Null and empty texts have no words, no
    labels and score 0. Repeated rows and ids are documents of their own; further columns are ignored.
    """
    grams = template_grams(docs.sparkSession, templates).select(
        "tmpl", "label", "base", "size", F.col("length").alias("t_length"), F.col("gram").alias("t_gram"), "phrase", "tpos"
    )
    lengths = sorted({len(p.split()) for p, _ in BASE_PHRASES} | {GRAM})
    rows = window_rows(docs, lengths)
    verified = F.array_join(F.slice("words", F.col("pos") + 1, F.col("length")), " ") == F.col("phrase")
    hits = rows.join(F.broadcast(grams), (F.col("gram") == F.col("t_gram")) & (F.col("length") == F.col("t_length")), "left")
    hits = hits.where((F.col("length") == 0) | verified)

    doc, template = ["uid", "doc_id", "n_words"], ["tmpl", "label", "base", "size"]
    diagonal = F.when(~F.col("base"), F.col("pos") - F.col("tpos"))
    votes = hits.groupBy(*doc, *template, diagonal.alias("diagonal")).agg(
        F.count("tpos").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("tpos").alias("tpos")
    )
    along = Window.partitionBy("uid", "tmpl").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > DRIFT, F.lit(True))
    copies = votes.withColumn("apart", apart.cast("int")).withColumn("copy", F.sum("apart").over(along))
    spans = copies.groupBy(*doc, *template, "copy").agg(
        F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.array_distinct(F.flatten(F.collect_list("tpos"))).alias("tpos"),
    )
    met = F.size(F.array_distinct(F.flatten(F.transform("tpos", lambda p: F.sequence(p, p + GRAM - 1)))))
    share = F.when(F.col("base"), F.lit(1.0)).otherwise(met / F.col("size"))
    spans = spans.withColumn("share", share)
    good = F.col("base") | ((F.col("share") >= coverage) & (F.col("last") + GRAM - F.col("first") <= 1.5 * F.col("size")))
    base = F.coalesce(F.col("base"), F.lit(False))
    label = F.when(good, F.col("label"))
    found = spans.groupBy(*doc).agg(
        F.coalesce(F.sum(F.when(base, F.col("votes"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("last"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"),
        F.coalesce(F.max(F.when(good, F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(good, F.struct("first", "last", "label", "share")))).alias("spans"),
    )
    return found.drop("uid")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of ``license_scan`` over whole ``documents``."""
    return license_scan(read_table(spark, sf_dir, "documents")).drop("spans")


def _template_values() -> str:
    rows = [(i, t, label, i < len(BASE_PHRASES)) for i, (t, label) in enumerate([*BASE_PHRASES, *TEMPLATES])]
    return ", ".join(f"({i}, '{t}', '{label}', {str(base).upper()})" for i, t, label, base in rows)


#: The same rows for DuckDB.
OP3_SQL = f"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS uid,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
p AS (SELECT tmpl, string_split(phrase, ' ') AS w, label, base FROM (VALUES {_template_values()}) v(tmpl, phrase, label, base)),
g AS (
  SELECT tmpl, label, base, len(w) AS size, k, i - 1 AS tpos, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, CASE WHEN base THEN len(w) ELSE {GRAM} END AS k FROM p))),
d AS (
  SELECT uid, k, i - 1 AS pos, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT uid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM t, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)),
h AS (SELECT uid, pos, tmpl, label, base, size, tpos FROM d JOIN g ON d.phrase = g.phrase AND d.k = g.k),
v AS (
  SELECT uid, tmpl, label, base, size, CASE WHEN NOT base THEN pos - tpos END AS diagonal, count(*) AS votes,
         min(pos) AS first, max(pos) AS last, list(DISTINCT tpos) AS tpos
  FROM h GROUP BY ALL),
c AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY uid, tmpl ORDER BY diagonal) <= {DRIFT} THEN 0 ELSE 1 END AS apart FROM v),
e AS (SELECT *, sum(apart) OVER (PARTITION BY uid, tmpl ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS copy FROM c),
f AS (
  SELECT uid, tmpl, label, base, size, copy, sum(votes) AS votes, min(first) AS first, max(last) AS last, flatten(list(tpos)) AS tpos
  FROM e GROUP BY uid, tmpl, label, base, size, copy),
s AS (
  SELECT *, CASE WHEN base THEN 1.0 ELSE CAST(len(list_distinct(list_concat(tpos, list_transform(tpos, lambda x: x + 1), list_transform(tpos, lambda x: x + 2)))) AS DOUBLE) / size END AS share FROM f),
r AS (
  SELECT uid, label, base, votes, first, last, share,
         base OR (share >= {COVERAGE} AND last + {GRAM} - first <= 1.5 * size) AS good FROM s),
a AS (
  SELECT uid, sum(CASE WHEN base THEN votes END) AS n_base, min(CASE WHEN base THEN first END) AS first_word, max(CASE WHEN base THEN last END) AS last_word,
         string_agg(DISTINCT CASE WHEN base THEN label END, ',' ORDER BY CASE WHEN base THEN label END) AS base_labels,
         string_agg(DISTINCT CASE WHEN good THEN label END, ',' ORDER BY CASE WHEN good THEN label END) AS labels,
         max(CASE WHEN good THEN share END) AS score
  FROM r GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM t LEFT JOIN a USING (uid)
"""
