"""Messages from connections whose bytes come in chunks, cut anywhere, over any number of micro-batches."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loamline.functions.http import BAD_LENGTH, BODY_BYTES, BODY_TOO_LARGE, HEADER_BYTES, HEADERS_TOO_LARGE, answer, parse_requests, render_response, route
from loamline.functions.text import or_default

RECEIVED = "connection string, raw string, refused string"
#: What a connection's state holds: bytes in order so far, the number of the next chunk, chunks that came too early, and whether it has ended.
STATE = "bytes binary, next long, early binary, ended boolean"
#: Bytes that any message has at most; no later byte of a connection can matter.
MOST = HEADER_BYTES + 4 + BODY_BYTES + 1
_END, _LENGTH = b"\r\n\r\n", re.compile(rb"[ \t\n\x0b\f\r]*([+-]?[0-9]+)")


def declared(head: bytes) -> tuple[int | None, str]:
    """The body's length by the first ``Content-Length:`` in a head, None without one; and what is wrong with it, if anything."""
    at = head.find(b"Content-Length:")
    if at < 0:
        return None, ""
    found = _LENGTH.match(head, at + 15)
    if not found or abs(int(found[1])) >= 10**20:
        return None, BAD_LENGTH
    length = int(found[1])
    return length, BODY_TOO_LARGE if not 0 <= length <= BODY_BYTES else ""


def message(data: bytes, closed: bool) -> tuple[bytes, str | None] | None:
    """(the message, what it is refused for) once the bytes so far, or the connection's end, decide it; else None.

    The answer doesn't hang on where chunks were cut. A head of over ``HEADER_BYTES`` is refused as soon as so many bytes have come
    without its end, a length that is wrong or over ``BODY_BYTES`` as soon as the head is whole. A declared length
    ends the message and cuts off what follows; without one the connection's end does, within ``BODY_BYTES``. A connection that
    ends earlier is refused without a reason.
    """
    at = data.find(_END)
    if at > HEADER_BYTES or (at < 0 and len(data) > HEADER_BYTES + 3):
        return data[: HEADER_BYTES + 1], HEADERS_TOO_LARGE
    if at < 0:
        return (data, HEADERS_TOO_LARGE if len(data) > HEADER_BYTES else "") if closed else None
    length, wrong = declared(data[:at])
    if wrong:
        return data[: at + 4], wrong
    body = len(data) - at - 4
    if length is None:
        return (data[: at + 4], BODY_TOO_LARGE) if body > BODY_BYTES else (data, None) if closed else None
    return (data[: at + 4 + length], None) if body >= length else (data, "") if closed else None


def take(data: bytearray, wanted: int, early: dict[int, bytes]) -> tuple[int, bool]:
    """Move the chunks that are next in order to the bytes; the number of the next one, and whether an empty one ended it all."""
    while wanted in early and len(data) <= MOST:
        chunk = early.pop(wanted)
        if not chunk:
            return wanted, True
        data += chunk
        wanted += 1
    return wanted, False


def trimmed(early: dict[int, bytes], room: int) -> dict[int, bytes]:
    """Without the chunks that have ``room`` bytes of others before them: they are beyond any message's end."""
    kept: dict[int, bytes] = {}
    for seq in sorted(early):
        if room < 0:
            break
        kept[seq] = early[seq]
        room -= max(len(early[seq]), 1)
    return kept


def receive_messages(chunks: DataFrame, idle: str = "10 minutes", late: str = "0 seconds") -> DataFrame:
    """(connection, raw, refused): the one message of each connection of a stream (connection, seq, ts, chunk).

    seq numbers the chunks of a connection from 0, and ts is when one came; an empty or null chunk is the peer's end of
    the connection. Chunks may come out of order and more than once, but one that is behind the watermark, which follows ts by
    ``late``, when its micro-batch begins is dropped. refused is null for a whole message, else the reason,
    empty if the connection was cut. A connection that is silent until the watermark passes its last chunk's ts by ``idle`` is cut.
    After its message a connection's chunks are dropped.

    The state of a connection is at most ``MOST`` bytes and a chunk, and goes when the watermark passes. Rows come as
    batches, of which no more is held than that. Custom state needs Python; all else is built in.
    """
    limit = pd.Timedelta(idle) // pd.Timedelta(milliseconds=1)

    def receive(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        data, wanted, early, ended = (bytearray(state.get[0]), state.get[1], pickle.loads(state.get[2]), state.get[3]) if state.exists else (bytearray(), 0, {}, False)
        if state.hasTimedOut:
            state.remove()
            if not ended:
                found = message(bytes(data), True)
                yield pd.DataFrame({"connection": [key[0]], "raw": [found[0].decode("utf-8", "replace")], "refused": [found[1]]})
            return
        last, found = 0, None
        for frame in frames:
            last = max(last, int(frame["ts"].max().value // 1_000_000))
            if ended:
                continue
            for seq, chunk in zip(frame["seq"].tolist(), frame["chunk"].tolist(), strict=True):
                if seq >= wanted:
                    early.setdefault(seq, bytes(chunk) if chunk is not None else b"")
            wanted, closed = take(data, wanted, early)
            found = message(bytes(data), closed)
            early = trimmed(early, MOST - len(data))
            if found:
                ended, data, early = True, bytearray(), {}
                yield pd.DataFrame({"connection": [key[0]], "raw": [found[0].decode("utf-8", "replace")], "refused": [found[1]]})
        state.update((bytes(data), wanted, pickle.dumps(early), ended))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + limit)

    known = chunks.withWatermark("ts", late).select(F.col("connection").cast("string").alias("connection"), "seq", "ts", "chunk")
    return known.groupBy("connection").applyInPandasWithState(receive, RECEIVED, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def handle_received(received: DataFrame) -> DataFrame:
    """Messages as ``handle`` has them: those refused while they came keep that reason, or the default text; no field of theirs is read."""
    cut = F.col("refused").isNotNull()
    asked = parse_requests(received)
    none = F.create_map().cast("map<string,string>")
    asked = asked.withColumns({
        "error": F.when(cut, or_default(F.col("refused"), "")).otherwise(F.col("error")), "valid": F.col("valid") & ~cut,
        "headers": F.when(cut, none).otherwise(F.col("headers")), "body": F.when(cut, "").otherwise(F.col("body")),
        **{c: F.when(cut, "").otherwise(F.col(c)) for c in ("method", "path", "version")},
    })
    status, text = answer(F.col("valid"), F.col("error"), F.col("method"), F.col("path"), F.col("body"))
    to = F.when(F.col("valid"), route(F.col("method"), F.col("path"))).otherwise("bad request")
    return asked.withColumn("route", to).withColumn("status", status).withColumn("response", render_response(status, text))
