"""The order book over a stream of orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from loamline.operators.book import depth
from loamline.operators.totals import LEVELS, level_changes, levels, merge_batch
from loamline.sources.snapshots import Store


def depth_stream(orders: DataFrame, folder: str) -> StreamingQuery:
    """A running query that keeps the depth of each level in ``folder``/levels, for the data available; complete mode.

    folder is one that all executors share: its ``state`` holds progress and running sums, so a restarted query goes on.
    """
    writer = depth(orders).writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    return writer.foreachBatch(lambda levels, _: levels.write.mode("overwrite").parquet(f"{folder}/levels")).start()


def depth_of_files(spark: SparkSession, source: str, pattern: str, prepare: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """Depth of the orders in the files of a folder, read as a stream until all are taken."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(source).schema
    orders = prepare(spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(source))
    depth_stream(orders, folder).awaitTermination()
    return spark.read.parquet(f"{folder}/levels")


def level_store(spark: SparkSession, folder: str) -> Store:
    return Store(spark, f"{folder}/changes", LEVELS)


def change_stream(orders: DataFrame, folder: str) -> StreamingQuery:
    """A running query that merges signed orders (side, price, quantity, sign) into a log of level changes, for the data available.

    A micro-batch writes the levels that it touched and nothing else, and no state is kept besides the log; a batch that
    is run again after a failure is known by its number and changes nothing. ``current_levels`` reads the book.
    """
    spark = orders.sparkSession

    def merge(rows: DataFrame, batch: int) -> None:
        merge_batch(level_store(spark, folder), level_changes(rows), batch)

    return orders.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(merge).start()


def current_levels(spark: SparkSession, folder: str) -> DataFrame:
    return levels(level_store(spark, folder).read())
