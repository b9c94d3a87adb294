"""Streams over several micro-batches: messages in chunks, talks in two directions, a socket, bounded batches."""

import datetime as dt
import random
import socket
import threading

import pytest

from loamline.functions import http
from loamline.sources.chat import limited_files, receive, show
from loamline.streaming import receive as rc
from loamline.streaming.chat import sent_from_files, two_way

CHUNK = "connection string, seq long, ts timestamp, chunk binary"
NOON = dt.datetime(2020, 1, 1, 12)
LONG = b"POST /message HTTP/1.1\r\nContent-Length: %d\r\n\r\n"


def pieces(data, cuts):
    cuts = [0, *sorted(cuts), len(data)]
    return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


CASES = {
    "open length": (b"GET / HTTP/1.1\r\nA: b\r\n\r\nhello", True, (b"GET / HTTP/1.1\r\nA: b\r\n\r\nhello", None)),
    "declared": (LONG % 5 + b"hello and more", False, (LONG % 5 + b"hello", None)),
    "cut body": (LONG % 50 + b"hello", True, (LONG % 50 + b"hello", "")),
    "cut head": (b"GET / HT", True, (b"GET / HT", "")),
    "nothing": (b"", True, (b"", "")),
    "long head": (b"GET / HTTP/1.1\r\nX: " + b"y" * 9000 + b"\r\n\r\n", True, http.HEADERS_TOO_LARGE),
    "head at the cap": (b"a" * http.HEADER_BYTES + b"\r\n\r\n", True, (b"a" * http.HEADER_BYTES + b"\r\n\r\n", None)),
    "head above the cap": (b"a" * (http.HEADER_BYTES + 1) + b"\r\n\r\n", True, http.HEADERS_TOO_LARGE),
    "no number": (b"GET / HTTP/1.1\r\nContent-Length: x\r\n\r\n", False, http.BAD_LENGTH),
    "negative": (b"GET / HTTP/1.1\r\nContent-Length: -1\r\n\r\n", False, http.BODY_TOO_LARGE),
    "declared too much": (LONG % (http.BODY_BYTES + 1), False, http.BODY_TOO_LARGE),
    "open and too much": (b"GET / HTTP/1.1\r\n\r\n" + b"z" * (http.BODY_BYTES + 1), False, http.BODY_TOO_LARGE),
    "most": (LONG % http.BODY_BYTES + b"z" * http.BODY_BYTES, False, (LONG % http.BODY_BYTES + b"z" * http.BODY_BYTES, None)),
}


def received(chunks):
    """What the state machine makes of chunks (seq, bytes) in an order of arrival; and the most bytes that it held."""
    data, wanted, early, held = bytearray(), 0, {}, 0
    for seq, chunk in chunks:
        if seq >= wanted:
            early.setdefault(seq, chunk)
        wanted, closed = rc.take(data, wanted, early)
        found = rc.message(bytes(data), closed)
        early = rc.trimmed(early, rc.MOST - len(data))
        held = max(held, len(data) + sum(map(len, early.values())))
        if found:
            return found, held
    return None, held


@pytest.mark.parametrize("name", CASES)
def test_the_message_does_not_hang_on_the_cuts_or_the_order(name):
    data, closed, wanted = CASES[name]
    rng = random.Random(name)
    for n in (0, 1, 3, 50):
        parts = pieces(data, [rng.randint(0, len(data)) for _ in range(n)]) + ([b""] if closed else [])
        chunks = list(enumerate(parts))
        for order in (chunks, chunks[::-1], rng.sample(chunks, len(chunks)), chunks + chunks):
            found, held = received(order)
            assert (found[1] if isinstance(wanted, str) else found) == wanted
            assert held <= rc.MOST + max(map(len, parts), default=0)


def test_chunks_that_can_not_matter_are_not_held():
    most = 2 * rc.MOST // 1000
    found, held = received([(k, b"z" * 1000) for k in range(most, 0, -1)] + [(0, LONG % 3 + b"abc")])
    assert found == (LONG % 3 + b"abc", None) and held <= rc.MOST + 2000


def test_lengths_are_read_as_the_batch_form_reads_them(spark):
    for value in ("5", " +5", "12abc", "-1", "", "x", "9" * 20, "1" + "0" * 20, "0" * 30 + "7", "\t8"):
        head = f"GET / HTTP/1.1\r\nX-Content-Length:{value}\r\nContent-Length: 3"
        batch = spark.createDataFrame([(head + "\r\n\r\n",)], "raw string").select(http.request_error("raw"), http.content_length("raw")).first()
        length, wrong = rc.declared(head.encode())
        assert wrong == batch[0] and (wrong or length == batch[1])


def test_connections_over_micro_batches(spark, tmp_path):
    whole = (LONG % 6 + "hé!!".encode() + b"tail") if len("hé!!".encode()) == 6 else LONG % 5 + "hé!!".encode() + b"tail"
    a, b = pieces(whole, [10, 47, 49]), pieces(b"GET / HTTP/1.0\r\n\r\n", [5])
    batches = [
        [("a", 1, a[1]), ("b", 0, b[0]), ("cut", 0, b"GET / HTTP/1.1\r\nHost")],
        [("a", 0, a[0]), ("a", 1, a[1]), ("b", 2, None)],
        [("a", 3, a[3]), ("a", 2, a[2]), ("b", 1, b[1]), ("a", 4, b"more")],
        [("a", 9, b"late"), ("clock", 0, b"")],
    ]
    for k, rows in enumerate(batches):
        at = [(c, s, NOON + dt.timedelta(minutes=k if c != "clock" else 600, seconds=s), x) for c, s, x in rows]
        spark.createDataFrame(at, CHUNK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = rc.receive_messages(spark.readStream.schema(CHUNK).parquet(str(tmp_path / "in")), "1 hour", "1 minute")
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    found = {r["connection"]: r for r in rc.handle_received(spark.read.schema(rc.RECEIVED).parquet(str(tmp_path / "out"))).collect()}
    assert set(found) == {"a", "b", "cut", "clock"}
    assert (found["a"]["body"], found["a"]["status"]) == ("hé!!", "200 OK")
    assert (found["b"]["route"], found["b"]["body"]) == ("home", "")
    assert found["cut"]["response"].endswith("\r\n\r\n" + http.BAD_REQUEST) and found["cut"]["error"] == "" and not found["cut"]["valid"]


def test_two_directions_equal_the_batch_join(spark, tmp_path):
    rng = random.Random(0)
    rows = [(f"t{rng.randint(0, 3)}", rng.choice(["me", "you"]), s, NOON + dt.timedelta(seconds=rng.randint(0, 3000)), f"m{s}") for s in range(120)]
    rows.sort(key=lambda r: r[3])
    schema = "talk string, side string, seq long, ts timestamp, value string"
    clock = [("clock", side, 0, NOON + dt.timedelta(days=1), "") for side in ("me", "you")]
    for k in range(4):
        spark.createDataFrame(rows[30 * k : 30 * k + 30] + (clock if k == 3 else []), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found = two_way(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "5 minutes")
        query = found.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
    kept = sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"])
    assert kept <= 8  # what the end of the watermark leaves, of 120 messages
    wanted = []
    for talk, side, seq, ts, value in rows:
        heard = max(((o[3], o[2], o[4]) for o in rows if o[0] == talk and o[1] != side and ts - dt.timedelta(minutes=5) <= o[3] < ts), default=(None, None, None))
        wanted.append((talk, side, seq, ts, value, *heard[1:]))
    out = [tuple(r) for r in spark.read.schema(found.schema).parquet(str(tmp_path / "out")).where("talk <> 'clock'").collect()]
    assert sorted(out) == sorted(wanted)


def test_lines_from_a_server(spark):
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        client, _ = server.accept()
        client.sendall(b"hello\nworld\n")
        done.wait(60)
        client.close()

    done = threading.Event()
    thread = threading.Thread(target=serve, daemon=True)
    thread.start()
    query = show(receive(spark, port=server.getsockname()[1]), "heard")
    try:
        query.processAllAvailable()
        for _ in range(100):
            if spark.table("heard").count() == 2:
                break
            query.processAllAvailable()
        assert sorted(r["value"] for r in spark.table("heard").collect()) == ["hello", "world"]
    finally:
        query.stop()
        done.set()
        thread.join(10)
        server.close()


def test_a_full_queue_delays_and_drops_nothing(spark, tmp_path):
    for k in range(5):
        spark.createDataFrame([(k,)], "k long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    stream = limited_files(spark, str(tmp_path / "in"), "k long", 2)
    stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda rows, _: seen.append(rows.count())).start().awaitTermination()
    assert sum(seen) == 5 and max(seen) <= 2 and len(seen) == 3


@pytest.mark.parametrize("pattern", ["talks.parquet", "*.parquet"])
def test_a_table_may_be_a_directory_or_a_file(spark, tmp_path, pattern):
    rows = [(str(talk), seq, "quit" if seq == talk else f"{talk} {seq}") for talk in range(6) for seq in range(5)]
    talks = spark.createDataFrame(rows, "talk string, seq long, value string")
    talks.repartition(3).write.parquet(str(tmp_path / "many/talks.parquet"))
    talks.coalesce(1).write.parquet(str(tmp_path / "one.tmp"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "one.tmp").glob("part-*.parquet")).rename(tmp_path / "one/talks.parquet")
    wanted = sorted(r for r in rows if r[1] < int(r[0]))
    for name in ("many", "one"):
        found = sent_from_files(spark, str(tmp_path / name), pattern, lambda x: x, str(tmp_path / f"{name}.out"))
        assert sorted(map(tuple, found.collect())) == wanted
