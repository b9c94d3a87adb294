"""Substring search that opens only the files that may have hits: rows in numbered blocks, and which grams each block holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.functions.text import ascii_lower, contains_ignoring_case

#: Characters of a gram.
GRAM = 3
#: Characters of a text whose grams are made at a time.
PIECE = 1 << 16


def pieces(text: Column, gram: int = GRAM, piece: int = PIECE) -> Column:
    """A text in pieces that overlap by all of a gram but one character, so that each gram is whole in one of them."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{piece + gram - 1}}})).{{1,{piece}}}"), F.lit(1))


def grams(text: Column, gram: int = GRAM) -> Column:
    """The distinct runs of ``gram`` characters; of a shorter text itself."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{gram}}}|^.{{1,{gram - 1}}}$))"), F.lit(1)))


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows with their block; an empty table has a schema and no files."""
    schema = spark.read.parquet(f"{path}/schema").schema.add("_block", "integer")
    return spark.read.schema(schema).parquet(f"{path}/rows")


def write_searchable(table: DataFrame, path: str, text: str, blocks: int | None = None, gram: int = GRAM, piece: int = PIECE) -> None:
    """Replace a folder by the rows in blocks and, for each gram of ``text`` with A-Z lower-cased, the blocks that hold it.

    A block is one partition of the table as it comes, or of ``blocks`` even ones; nothing else moves rows. Which grams a
    block holds is put together in the tasks that read it, so what is shuffled is at most its distinct grams, and a gram
    that is in every text is one row for each block. Null and empty texts have no grams. The grams come after the rows:
    a folder whose writing was cut off has none and can't be searched.
    """
    spark = table.sparkSession
    table.limit(0).write.mode("overwrite").parquet(f"{path}/schema")
    dealt = table.repartition(blocks) if blocks else table
    dealt.withColumn("_block", F.spark_partition_id()).write.mode("overwrite").partitionBy("_block").parquet(f"{path}/rows")
    parts = _rows(spark, path).select("_block", F.explode(pieces(ascii_lower(F.col(text)), gram, piece)).alias("piece"))
    held = parts.select("_block", F.explode(grams(F.col("piece"), gram)).alias("gram")).distinct()
    held.repartitionByRange("gram", "_block").sortWithinPartitions("gram", "_block").write.mode("overwrite").parquet(f"{path}/grams")


def blocks_with(spark: SparkSession, path: str, keyword: str, gram: int = GRAM) -> DataFrame:
    """_block of those that may hold the keyword: they hold all its grams, or for a shorter one some gram that it is in."""
    held = spark.read.parquet(f"{path}/grams")
    word = "".join(c.lower() if "A" <= c <= "Z" else c for c in keyword)
    wanted = sorted({word[i : i + gram] for i in range(len(word) - gram + 1)})
    if not wanted:
        return held.where(contains_ignoring_case(F.col("gram"), keyword)).select("_block").distinct()
    return held.where(F.col("gram").isin(wanted)).groupBy("_block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("_block")


def search(spark: SparkSession, path: str, text: str, keyword: str, gram: int = GRAM) -> DataFrame:
    """The rows whose text holds the keyword, A-Z in any case, as a filter of all rows finds them; none for an empty keyword.

    Blocks are picked while the query runs, by partition pruning, and their rows are filtered by the text itself.
    A block is a folder that the driver lists anyway, so the list of them is small enough to broadcast.
    """
    return _rows(spark, path).join(F.broadcast(blocks_with(spark, path, keyword, gram)), "_block", "left_semi").where(contains_ignoring_case(F.col(text), keyword)).drop("_block")
