"""Conversations as streams that end at a word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loamline.sources.chat import QUIT

SENT = "talk string, seq long, value string"


def send_until_quit(messages: DataFrame) -> DataFrame:
    """The messages (talk, seq, value) of each talk before its first ``quit``, over any number of micro-batches.

    The state of a talk is whether it has ended; what comes later is dropped. Inside a micro-batch messages count in the
    order of seq. This needs custom state, so it is Python, by Arrow batches.
    """

    def send(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists and state.get[0]:
            return
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable", ignore_index=True)
        ends = (rows["value"] == QUIT).to_numpy().nonzero()[0]
        state.update((bool(len(ends)),))
        yield rows[: ends[0]] if len(ends) else rows

    return messages.groupBy("talk").applyInPandasWithState(send, SENT, "ended boolean", "append", GroupStateTimeout.NoTimeout)


def two_way(messages: DataFrame, within: str = "10 minutes", late: str = "0 seconds") -> DataFrame:
    """Each message (talk, side, seq, ts, value) of a stream with the other side's last one before it: heard_seq and heard.

    The two directions of a talk are one stream joined with itself. Of messages at one ts the one of largest seq is the last; what
    is older than ``within`` isn't heard, and heard is null without any. A row comes once, when the watermark, which
    follows ts by ``late``, has passed its ts; what the join and the aggregate hold goes with it, so the state is what
    was said within ``within`` of the watermark. The pairs of the join are bounded by that span too.
    """
    mine = messages.withWatermark("ts", late)
    other = messages.select(*[F.col(c).alias(f"o_{c}") for c in ("talk", "side", "seq", "ts", "value")]).withWatermark("o_ts", late)
    span = (F.col("o_ts") < F.col("ts")) & (F.col("o_ts") >= F.col("ts") - F.expr(f"INTERVAL {within}"))
    pairs = mine.join(other, (F.col("talk") == F.col("o_talk")) & (F.col("side") != F.col("o_side")) & span, "leftOuter")
    last = F.max(F.struct("o_ts", "o_seq", "o_value")).alias("last")
    found = pairs.groupBy("talk", "side", "seq", "ts", "value").agg(last)
    return found.select("talk", "side", "seq", "ts", "value", F.col("last.o_seq").alias("heard_seq"), F.col("last.o_value").alias("heard"))


def _either(path: str) -> str:
    """A pattern for one path. A stream takes a directory by its path and a single file only by a pattern; this takes both."""
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def sent_from_files(spark: SparkSession, source: str, pattern: str, prepare: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """What is sent of the messages in a table of a folder, read as a stream until all is taken; folder is shared.

    pattern names the table, which is a file or a directory of files, or several of them.
    """
    path = _either(f"{source}/{pattern}")
    messages = prepare(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path))
    writer = send_until_quit(messages).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start(f"{folder}/sent").awaitTermination()
    return spark.read.schema(SENT).parquet(f"{folder}/sent")
