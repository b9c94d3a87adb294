"""Keyed tables as JSON files with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamline.functions.text import priority_from_label
from loamline.operators.reports import numbered
from loamline.operators.tables import latest_by_key
from loamline.schemas import PRODUCT, TASK
from loamline.sources.json_arrays import read_array
from loamline.sources.snapshots import Store


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def read_json_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a file that holds one JSON array, or of a folder of JSON lines as ``save_table`` makes it, with ``seq``;
    what is missing is an empty table.

    seq is the one that was saved. Where none was, rows follow the names of their files and their places in them,
    whichever tasks read them. Missing keys and wrong types are null. The path may be in any store that Spark reads.
    """
    hadoop, files = _path(spark, path)
    if not files.exists(hadoop):
        return spark.createDataFrame([], schema).withColumn("seq", F.lit(0).cast("long"))
    if files.getFileStatus(hadoop).isFile():
        return read_array(spark, path, schema)
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("seq", T.LongType())])).json(path)
    if not rows.where("seq is null").isEmpty():
        place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row")]
        rows = numbered(rows.select(*schema.names, *place), "_file", "_start", "_row", name="seq")
    return rows.select(*schema.names, "seq")


def load_products(spark: SparkSession, path: str) -> DataFrame:
    """Products of a file; of equal ids the last counts."""
    return latest_by_key(read_json_table(spark, path, PRODUCT)).drop("seq")


def load_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tasks of a file in list order (``seq``); equal ids all stay, unknown priorities are Medium."""
    return read_json_table(spark, path, TASK).withColumn("priority", priority_from_label(F.col("priority")))


def save_table(table: DataFrame, path: str) -> None:
    """Replace the snapshot at a path, as JSON lines in as many files as there are partitions."""
    table.write.mode("overwrite").json(path)


def save_tasks(tasks: DataFrame, path: str) -> None:
    """Replace the snapshot at a path; list order is kept in ``seq``, so it holds whatever the number of files."""
    save_table(tasks, path)


def save_version(table: DataFrame, folder: str) -> str:
    """Commit a table as the next version of the snapshots in a folder; it may be made from an earlier one.

    A version counts once it is whole. A writer that another one overtakes gets ``Conflict``; ``Store.update`` tries again.
    """
    store = Store(table.sparkSession, folder, form="json")
    return f"{store.folder}/data/{store.commit_of(store.commit(table, store.commit_of().version)).parts[0]}"


def latest_version(spark: SparkSession, folder: str) -> str:
    """The path of the newest version in a folder; where there is none, one that doesn't exist."""
    store = Store(spark, folder, form="json")
    parts = store.commit_of().parts
    return f"{store.folder}/data/{parts[0] if parts else 'none'}"


def json_array(table: DataFrame) -> DataFrame:
    """A whole small table as one JSON array of pretty-printed objects, in one row; for files of the interchange form,
    which one reader takes whole. Larger tables: ``save_table``."""
    return table.agg(F.to_json(F.collect_list(F.struct(*table.columns)), {"pretty": "true"}).alias("value"))


def json_rows(table: DataFrame, *columns: str) -> DataFrame:
    return table.select(F.to_json(F.struct(*(columns or table.columns))).alias("value"))
