"""Benchmark decontamination: a broadcast hash set of test n-grams against all word windows of the training texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.llm.common import ALNUM_GAP, alnum_words, by_position, checkpoint, limited, read_table, text_hash
from loamline.llm.windows import covered, window_rows, window_text

#: Words of a window.
WINDOW = 10
#: Most benchmark windows that are broadcast (about 100 bytes each); beyond, the same join shuffles.
BROADCAST_WINDOWS = 500_000


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(length, gram, phrase, items): each distinct window with the sorted ids of the items that hold it.

    Items of fewer words than ``window``, but not none, are one window. Items without words have none.
    """
    items = benchmark.select("item_id", alnum_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(window))
    rows = items.select(
        "item_id", "words", size.alias("length"),
        F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("pos"),
    )
    rows = rows.select(
        "item_id", "length",
        F.xxhash64(F.slice("words", F.col("pos") + 1, F.col("length"))).alias("gram"),
        window_text(F.col("words"), F.col("pos"), F.col("length")).alias("phrase"),
    )
    return rows.groupBy("length", "gram", "phrase").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per input row: doc_id, row (a hash of the text), n_words, hits (array of (pos, length)), n_hit, items, contaminated.

    Every window of every text is looked up in the hash set of benchmark windows; a match of hashes counts only if the
    words are equal too. The set is broadcast if it has at most ``broadcast_windows`` windows (they are counted first);
    a larger one is joined by a shuffle of hashes and places, and what is found goes back to the texts to be compared.
    Texts never leave the scanning stage but for that, once.

    Null or empty texts have no words and no hits. Repeated rows and repeated ids are documents of their own. Items
    with a null id mark words but are not listed. An empty benchmark hits nothing. Further columns of either table
    are ignored, whatever their names.
    """
    known = benchmark_windows(benchmark, window)
    sizes = {r["length"]: r["n"] for r in known.groupBy("length").agg(F.count("*").alias("n")).collect()}  # as many rows as lengths: window at most
    few = sum(sizes.values()) <= broadcast_windows
    known = known.select(F.col("length").alias("b_length"), F.col("gram").alias("b_gram"), "phrase", "items")
    rows = window_rows(docs, sorted(sizes) or [window])
    by_doc = _by_broadcast(rows, F.broadcast(known)) if few else _by_shuffle(docs, rows, known)
    return by_doc.select(
        "doc_id", "row", "n_words", "hits", covered(F.col("hits")).alias("n_hit"),
        F.array_sort(F.transform(F.col("items"), lambda x: x.cast("string"))).alias("items"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def _by_broadcast(rows: DataFrame, known: DataFrame) -> DataFrame:
    same = (F.col("gram") == F.col("b_gram")) & (F.col("length") == F.col("b_length"))
    verified = window_text(F.col("words"), F.col("pos"), F.col("length")) == F.col("phrase")  # a filter, not a join key: read only where hashes match
    found = rows.join(known, same, "left").where((F.col("length") == 0) | verified)
    place = F.when(F.col("length") > 0, F.struct(F.col("pos"), F.col("length")))
    return found.groupBy("uid", "doc_id", "row", "n_words").agg(
        F.collect_set(place).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    )


def _by_shuffle(docs: DataFrame, rows: DataFrame, known: DataFrame) -> DataFrame:
    """The same where the benchmark is large: windows are shuffled as hash and place, 40 bytes each."""
    same = (F.col("gram") == F.col("b_gram")) & (F.col("length") == F.col("b_length"))
    found = rows.where("length > 0").select("doc_id", "row", "pos", "length", "gram").join(known, same)
    found = found.groupBy(F.col("doc_id").alias("f_id"), F.col("row").alias("f_row")).agg(F.collect_set(F.struct("pos", "length", "phrase", "items")).alias("found"))
    texts = docs.select("doc_id", text_hash(F.col("text")).alias("row"), alnum_words(F.col("text")).alias("words"))
    joined = texts.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("row") == F.col("f_row")), "left")
    equal = F.filter(F.coalesce("found", F.array().cast(found.schema["found"].dataType)), lambda x: window_text(F.col("words"), x["pos"], x["length"]) == x["phrase"])
    joined = joined.select("doc_id", "row", F.size("words").cast("long").alias("n_words"), equal.alias("found"))
    places = F.array_distinct(F.transform("found", lambda x: F.struct(x["pos"].alias("pos"), x["length"].alias("length"))))
    return joined.select("doc_id", "row", "n_words", places.alias("hits"), F.array_distinct(F.flatten(F.transform("found", lambda x: x["items"]))).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", window: int = WINDOW) -> DataFrame:
    """``docs`` without its contaminated documents, or (``mode="spans"``) without the words that are hit.

    Each row goes, or loses words, by its own text, whatever its doc_id: rows are matched to what was found by doc_id (null
    is one) and text. A removed word goes with the gap before it. All columns stay.
    """
    report = contamination(docs, benchmark, window).where("contaminated")
    plain, doc_id, own_text, named = by_position(docs)
    key = F.col("h_id").eqNullSafe(doc_id) & (F.col("h_row") == text_hash(own_text))
    if mode == "documents":
        bad = limited(checkpoint(report.select(F.col("doc_id").alias("h_id"), F.col("row").alias("h_row")).distinct()))
        return named(plain.join(bad, key, "left_anti"))
    if mode != "spans":
        raise ValueError(f"mode is documents or spans, not {mode!r}")
    hits = report.select(
        F.col("doc_id").alias("h_id"), F.col("row").alias("h_row"),
        F.explode(F.flatten(F.transform("hits", lambda p: F.sequence(p["pos"], p["pos"] + p["length"] - 1)))).alias("i"),
    ).groupBy("h_id", "h_row").agg(F.collect_set("i").alias("h_words"))
    gap = ALNUM_GAP.replace("\\x60", "\\x40\\x5B-\\x60")
    pieces = F.regexp_extract_all(own_text, F.lit(f"(?:{gap})?(?:(?!{gap[:-1]}).)+|{gap}$"), F.lit(0))
    marks = F.map_from_arrays("h_words", F.transform("h_words", lambda i: F.lit(True)))
    kept = F.array_join(F.filter(pieces, lambda x, i: ~F.coalesce(F.element_at(marks, i), F.lit(False))), "")
    text = f"d{docs.columns.index('text')}"
    return named(plain.join(hits, key, "left").withColumn(text, F.when(F.col("h_words").isNotNull(), kept).otherwise(F.col(text))))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of ``contamination`` over whole ``documents`` and ``benchmark``."""
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


#: The same rows for DuckDB.
OP10_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, row_number() OVER () AS uid,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, w, least(len(w), 10) AS k FROM (
    SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
    FROM benchmark) WHERE len(w) > 0),
g AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
ks AS (SELECT DISTINCT k FROM g),
d AS (
  SELECT uid, k, i, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT uid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM t, ks WHERE len(w) >= k)),
h AS (SELECT uid, d.k, i, item_id FROM d JOIN g ON d.phrase = g.phrase AND d.k = g.k),
c AS (SELECT uid, count(DISTINCT p) AS n_hit FROM (SELECT uid, unnest(range(i, i + k)) AS p FROM h) GROUP BY uid),
m AS (SELECT uid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
      FROM (SELECT DISTINCT uid, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM t LEFT JOIN c USING (uid) LEFT JOIN m USING (uid)
"""
