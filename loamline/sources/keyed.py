"""Tables laid out by a key: files in ranges of it with Bloom filters, or buckets that joins use as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_keyed(table: DataFrame, path: str, key: str = "id", files: int | None = None, keys_of_a_file: int = 1_000_000) -> None:
    """Replace a folder by Parquet files in ranges of the key, each sorted by it and with a Bloom filter of its keys.

    A comparison with one key then opens the files of its range only, and of these reads no row group without the key.
    """
    dealt = table.repartitionByRange(files, key) if files else table.repartitionByRange(key)
    writer = dealt.sortWithinPartitions(key).write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.option(f"parquet.bloom.filter.expected.ndv#{key}", str(keys_of_a_file)).parquet(path)


def save_bucketed(table: DataFrame, name: str, path: str, key: str = "id", buckets: int = 200) -> DataFrame:
    """Save a table in buckets of the key, sorted by it, under a name of the catalog; and read it.

    A join by the key shuffles the other side to the buckets and leaves this one where it is.
    """
    table.repartition(buckets, key).write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return table.sparkSession.table(name)


def forget(spark: SparkSession, name: str) -> None:
    """Take a table's name out of the catalog; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
