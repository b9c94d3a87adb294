"""Line-based message streams: a socket as a source, and a sink that stops at a word."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The line that ends a conversation.
QUIT = "quit"


def receive(spark: SparkSession, host: str = "127.0.0.1", port: int = 8080) -> DataFrame:
    """Messages from a TCP server, one for each line; Spark connects and does not listen."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def show(messages: DataFrame, name: str):
    """A running query that keeps the messages in a table in memory."""
    return messages.writeStream.format("memory").queryName(name).outputMode("append").start()


def until_quit(messages: DataFrame, order: str) -> DataFrame:
    """The messages before the first ``quit`` in an order: one aggregate and a filter."""
    stop = messages.where(F.col("value") == QUIT).agg(F.min(order).alias("_stop"))
    joined = messages.join(F.broadcast(stop))  # one row
    return joined.where(F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_stop")


def limited_files(spark: SparkSession, path: str, schema, files: int) -> DataFrame:
    """A stream of text files, so many a trigger: a bound on what is in work, as a queue's, that delays and drops nothing."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
