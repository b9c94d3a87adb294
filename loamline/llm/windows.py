"""Word windows of whole texts as rows, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import alnum_words, text_hash


def window_rows(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """Explode each document into its word windows of the given lengths.

    Columns: ``uid`` (a number of the input row), ``doc_id``, ``row`` (a hash of the text), ``words``, ``n_words``, ``length``, ``pos`` (from 0) and
    ``gram`` (64-bit hash of the window's words). Each document also gets one row of length 0 with a null gram, so that
    later left joins and filters keep documents without windows. The rows are made and consumed inside one stage; what
    a caller keeps of them is its own choice.
    """
    base = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col("doc_id"), text_hash(F.col("text")).alias("row"), alnum_words(F.col("text")).alias("words")
    )
    n, kinds = F.size("words"), len(lengths)
    # one number a row says position and length; the hash is made after the explode, where it is compiled code
    rows = base.select("*", F.explode(F.sequence(F.lit(-1), n * kinds - 1)).alias("at"))
    length = F.lit(0)
    for k, of in enumerate(lengths):
        length = F.when((F.col("at") >= 0) & (F.col("at") % kinds == k), F.lit(of)).otherwise(length)
    pos = F.when(F.col("at") >= 0, (F.col("at") / kinds).cast("int")).otherwise(0)
    rows = rows.select("uid", "doc_id", "row", "words", n.cast("long").alias("n_words"), length.alias("length"), pos.alias("pos"))
    gram = F.when(F.col("length") > 0, F.xxhash64(F.slice("words", F.col("pos") + 1, F.col("length"))))
    return rows.where(F.col("pos") + F.col("length") <= F.col("n_words")).withColumn("gram", gram)


def window_text(words: Column, pos: Column, length: Column) -> Column:
    """The words of a window, for exact comparison; words hold no blank."""
    return F.array_join(F.slice(words, pos + 1, length), " ")


def covered(places: Column) -> Column:
    """How many words the (pos, length) places cover together; overlaps count once."""
    step = F.aggregate(
        F.array_sort(places),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, p: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), p["pos"] + p["length"] - F.greatest(acc["end"], p["pos"].cast("long")))).alias("n"),
            F.greatest(acc["end"], (p["pos"] + p["length"]).cast("long")).alias("end"),
        ),
    )
    return step["n"]
