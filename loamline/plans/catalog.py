"""The registered queries over the shared tables, each with the same rows as SQL.

Tables are mapped onto the record types: part to products, orders to tasks, events to orders of a book, conversations
and pages to messages. All queries run over whole tables.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.functions import http
from loamline.functions.text import double_input, integer_input, priority_from_input, priority_from_label, priority_label, priority_rank, product_verdict, status_mark, task_verdict
from loamline.operators import book, commands, reports, tables, totals
from loamline.plans.lineage import checkpoint, remove, shared_folder
from loamline.schemas import PRODUCT
from loamline.sources import json_arrays, json_tables
from loamline.sources.chat import until_quit
from loamline.sources.keyed import forget, save_bucketed, write_keyed
from loamline.sources.prices import adjusted_history, load_history
from loamline.sources.search_index import search, write_searchable
from loamline.sources.snapshots import Conflict, Store
from loamline.streaming.book import change_stream, current_levels, depth_of_files
from loamline.streaming.chat import sent_from_files, two_way
from loamline.streaming.receive import RECEIVED, handle_received, receive_messages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("quantity"), F.col("p_retailprice").alias("price"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.col("o_orderpriority")
    priority = F.when(level.isin("1-URGENT", "2-HIGH"), "High").when(level == "5-LOW", "Low").otherwise("Medium")
    orders = _table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("id"), priority.alias("priority"), (F.col("o_orderstatus") == "F").alias("completed"))


def as_orders(events: DataFrame) -> DataFrame:
    side = F.when(F.col("event_type").isin("click", "purchase"), "Buy").otherwise("Sell")
    quantity = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.col("event_id").alias("id"), F.col("ts"), side.alias("side"), F.floor("value").cast("long").alias("price"), quantity.alias("quantity")
    )


def _text_request(role: Column, turn: Column, text: Column) -> Column:
    return F.concat(
        F.lit("POST /"), role, F.lit(" HTTP/1.1\r\nHost: first\r\nHost: last\r\nno colon here\r\nX-Turn:  "), turn.cast("string"),
        F.lit("\r\nContent-Length: "), F.octet_length(text).cast("string"), F.lit("\r\n\r\n"), text,
    )


def inventory_value(spark, sf_dir):
    return reports.inventory_value(products(spark, sf_dir))


def low_stock(spark, sf_dir):
    return reports.low_stock(products(spark, sf_dir))


def product_by_id(spark, sf_dir):
    return tables.by_id(products(spark, sf_dir), 5)


def product_list(spark, sf_dir):
    return reports.product_list(products(spark, sf_dir))


def product_verdicts(spark, sf_dir):
    shifted = products(spark, sf_dir).withColumn("quantity", F.col("quantity") - 3).withColumn("price", F.col("price") - 950)
    return shifted.select("id", product_verdict(F.col("name"), F.col("quantity"), F.col("price")).alias("verdict"))


def _product_changes(spark, sf_dir):
    return products(spark, sf_dir).where("id % 5 = 0").withColumn("quantity", F.col("quantity") + 100)


def product_upsert(spark, sf_dir):
    return tables.upsert(products(spark, sf_dir), _product_changes(spark, sf_dir))


def product_edit(spark, sf_dir):
    edits = products(spark, sf_dir).where("id % 3 = 0").withColumn("quantity", F.col("quantity") - 10)
    return tables.edit_products(products(spark, sf_dir), edits)


def product_delete(spark, sf_dir):
    everything = products(spark, sf_dir)
    return tables.delete(everything, everything.where("id % 7 = 0").select("id"))


def product_insert(spark, sf_dir):
    everything = products(spark, sf_dir)
    new = everything.where("id <= 5").select(F.col("id").alias("arrival"), F.concat(F.lit("new "), "name").alias("name"), (F.col("quantity") - 20).alias("quantity"), "price")
    return tables.insert_products(everything, new)


def product_json(spark, sf_dir):
    return json_tables.json_rows(products(spark, sf_dir), "id", "name")


def _scratch(spark):
    return f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"


def _kept(spark, folder, rows):
    """The rows in a checkpoint, and the folder that they were read from gone."""
    rows = checkpoint(rows)
    remove(spark, folder)
    return rows


def product_snapshot(spark, sf_dir):
    """Load from a missing file, save, load, change, save over what is read, load."""
    folder = _scratch(spark)
    load = lambda: json_tables.load_products(spark, json_tables.latest_version(spark, folder))
    json_tables.save_version(tables.upsert(load(), products(spark, sf_dir)), folder)
    json_tables.save_version(tables.delete(load(), load().where("id % 4 = 0").select("id")), folder)
    return _kept(spark, folder, load())


def task_snapshot(spark, sf_dir):
    """Tasks saved in list order, here by descending id, and loaded again with their places in the list."""
    folder = _scratch(spark)
    listed = _titled(spark, sf_dir).withColumn("seq", -F.col("id"))
    json_tables.save_tasks(listed, folder)
    return _kept(spark, folder, reports.numbered(json_tables.load_tasks(spark, folder), "seq").select("id", "title", "priority", "completed", "place"))


def product_lookup(spark, sf_dir):
    everything = products(spark, sf_dir)
    asked = everything.select(F.when(F.col("id") % 3 == 0, F.concat(F.lit("no "), "id")).otherwise((F.col("id") * 2).cast("string")).alias("asked"))
    return tables.lookup(everything, asked)


def product_lookup_bucketed(spark, sf_dir):
    """The lookups of ``product_lookup`` in a table that lies in buckets of its key, which the join doesn't move."""
    folder, name = _scratch(spark), f"products_{uuid.uuid4().hex}"
    table = save_bucketed(products(spark, sf_dir), name, folder, buckets=8)
    asked = products(spark, sf_dir).select(F.when(F.col("id") % 3 == 0, F.concat(F.lit("no "), "id")).otherwise((F.col("id") * 2).cast("string")).alias("asked"))
    found = _kept(spark, folder, tables.lookup(table, asked))
    forget(spark, name)
    return found


def task_keyed(spark, sf_dir):
    """One task by its id out of files in ranges of ids with Bloom filters."""
    folder = _scratch(spark)
    write_keyed(_titled(spark, sf_dir), folder, files=8)
    return _kept(spark, folder, tables.by_id(spark.read.parquet(folder), 777))


def product_lookup_empty(spark, sf_dir):
    everything = products(spark, sf_dir)
    return tables.lookup(tables.cleared(everything), everything.select(F.col("id").cast("string").alias("asked"))).select("asked", "id", "outcome")


def product_clear(spark, sf_dir):
    return tables.cleared(products(spark, sf_dir))


def product_insert_refused(spark, sf_dir):
    everything = products(spark, sf_dir)
    new = everything.where("id <= 11").select(F.col("id").alias("arrival"), "name", "quantity", "price")
    return tables.insert_products(everything, new)


def number_inputs(spark, sf_dir):
    kind = F.col("id") % 5
    text = F.when(kind == 0, F.col("quantity").cast("string")).when(kind == 1, F.concat(F.lit(" "), "quantity", F.lit(" "))).when(kind == 2, "12abc").when(kind == 3, "").otherwise(F.col("price").cast("string"))
    given = products(spark, sf_dir).select("id", text.alias("given"), (kind != 4).alias("whole"))
    whole = lambda *bounds: F.when(F.col("whole"), integer_input(F.col("given"), *bounds)).cast("long")
    return given.select("id", whole().alias("number"), whole(1, 25).alias("bounded"), double_input(F.col("given")).alias("real"))


def next_id(spark, sf_dir):
    return tables.next_id(products(spark, sf_dir))


def task_by_status(spark, sf_dir):
    found = reports.tasks_by_status(tasks(spark, sf_dir), True)
    return found.select("id", status_mark(F.col("completed")).alias("mark"), "priority")


def task_by_priority(spark, sf_dir):
    return reports.tasks_by_priority(tasks(spark, sf_dir), "High")


def task_list(spark, sf_dir):
    return reports.task_list(_titled(spark, sf_dir))


def _titled(spark, sf_dir):
    return tasks(spark, sf_dir).withColumn("title", F.concat(F.lit("order "), F.col("id"))).withColumn("description", F.lit(""))


def task_short_list(spark, sf_dir):
    return reports.task_short_list(_titled(spark, sf_dir))


def task_insert(spark, sf_dir):
    """Ten new tasks, of which those without a title are skipped."""
    level = F.element_at(F.array(*map(F.lit, ["low", "High", "HIGH", "urgent"])), (F.col("id") % 4 + 1).cast("int"))
    title = F.when(F.col("id") % 5 == 0, "").otherwise(F.concat(F.lit("new "), "name"))
    new = products(spark, sf_dir).where("id between 1 and 10").select(F.col("id").alias("arrival"), title.alias("title"), F.lit("").alias("description"), level.alias("priority"))
    return tables.insert_tasks(_titled(spark, sf_dir), new)


def task_verdicts(spark, sf_dir):
    rows = products(spark, sf_dir).withColumn("title", F.when(F.col("id") % 5 == 0, "").otherwise(F.col("name"))).withColumn("description", F.when(F.col("id") % 3 == 0, "").otherwise("d"))
    rows = rows.withColumn("priority", F.when(F.col("id") % 7 == 0, "urgent").otherwise("mEDIUM"))
    verdict = lambda editing: task_verdict(F.col("title"), F.col("description"), F.col("priority"), editing=editing)
    return rows.select("id", verdict(False).alias("inserting"), verdict(True).alias("editing"))


def filter_messages(spark, sf_dir):
    """What filters say: with matches nothing, without a match, and on an empty table."""
    listed = _titled(spark, sf_dir)
    empty = tables.cleared(listed)
    cases = {
        "some": reports.filter_message(listed, reports.tasks_by_priority(listed, "High")),
        "none": reports.filter_message(listed, reports.search_titles(listed, "no such title")),
        "empty keyword": reports.filter_message(listed, reports.search_titles(listed, "")),
        "empty table": reports.filter_message(empty, reports.tasks_by_status(empty, True)),
    }
    said = [rows.select(F.lit(case).alias("case"), "message") for case, rows in cases.items()]
    return said[0].unionByName(said[1]).unionByName(said[2]).unionByName(said[3])


def priority_labels(spark, sf_dir):
    given = F.element_at(F.array(*[F.lit(x) for x in ("low", "Low", "LOW", "High", "hIGH", "urgent", None)]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), given.alias("given"))
    rank = priority_rank(priority_from_label(F.col("given")))
    return rows.select("id", priority_from_label(F.col("given")).alias("stored"), priority_from_input(F.col("given")).alias("edited"), rank.cast("long").alias("rank"), priority_label(F.col("id") % 5).alias("label"))


def task_edit(spark, sf_dir):
    titled = tasks(spark, sf_dir).withColumn("title", F.lit("old")).withColumn("description", F.lit("d"))
    level = F.when(F.col("id") % 2 == 0, "hIGH").otherwise("urgent")
    edits = titled.where("id % 3 = 0").select("id", F.lit("new").alias("title"), F.lit("e").alias("description"), level.alias("priority"))
    return tables.edit_tasks(titled, edits)


def task_sort_id(spark, sf_dir):
    return reports.numbered(tasks(spark, sf_dir), "id")


def task_sort_priority(spark, sf_dir):
    return reports.numbered(tasks(spark, sf_dir), priority_rank(F.col("priority")).desc(), "id")


def task_complete(spark, sf_dir):
    return tables.set_completed(tasks(spark, sf_dir), F.col("id") % 10 == 0, True)


def task_reopen(spark, sf_dir):
    return tables.set_completed(tasks(spark, sf_dir), F.col("id") % 10 == 0, False)


def task_delete_first(spark, sf_dir):
    listed = _lines(spark, sf_dir)
    return tables.delete_first(listed, listed.where("id % 2 = 0").select("id"))


def task_first_by_id(spark, sf_dir):
    return tables.first_by_id(_lines(spark, sf_dir), 7)


def _lines(spark, sf_dir):
    """Order lines as a list in which ids come more than once; seq is line, part and supplier, in this order."""
    seq = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"))
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), seq.alias("seq")).distinct()
    return lines.select("id", F.format_string("%d %010d %010d", "seq.line", "seq.part", "seq.supplier").alias("seq"))


def title_search(spark, sf_dir):
    return reports.search_titles(_table(spark, sf_dir, "documents"), "The", "text").select("doc_id")


#: A frequent word, one shorter than a gram, a rare one over a blank, and one that no text holds.
SEARCHED = ("The", "Q", "ation THE", "no such words")


def title_search_indexed(spark, sf_dir):
    """The hits of several keywords, each in the files alone that hold its grams."""
    folder = _scratch(spark)
    write_searchable(_table(spark, sf_dir, "documents").select("doc_id", "text"), folder, "text", blocks=16)
    hits = [search(spark, folder, "text", k).select(F.lit(k).alias("keyword"), "doc_id") for k in SEARCHED]
    return _kept(spark, folder, functools.reduce(DataFrame.unionAll, hits))


def book_depth(spark, sf_dir):
    return book.depth(as_orders(_table(spark, sf_dir, "events")))


def book_fifo(spark, sf_dir):
    return book.fifo(as_orders(_table(spark, sf_dir, "events")), "ts", "id").select("id", "side", "price", "place")


def book_sides(spark, sf_dir):
    return book.sides(book.depth(as_orders(_table(spark, sf_dir, "events"))))


def book_add(spark, sf_dir):
    """The depth after orders of doubled quantity come in for every tenth one."""
    orders = as_orders(_table(spark, sf_dir, "events"))
    return book.depth(book.add_orders(orders, orders.where("id % 10 = 0").withColumn("quantity", 2 * F.col("quantity"))))


def book_stream(spark, sf_dir):
    folder = _scratch(spark)
    return _kept(spark, folder, depth_of_files(spark, sf_dir, "events.parquet", as_orders, folder))


def _said(talks: DataFrame) -> DataFrame:
    """Messages of which every fifth of a role ends its talk."""
    return talks.select(F.col("conv_id").cast("string").alias("talk"), F.col("turn").alias("seq"), F.when((F.col("conv_id") + F.col("turn")) % 5 == 4, "quit").otherwise(F.col("text")).alias("value"))


def chat_until_quit(spark, sf_dir):
    """All conversations as one talk, in the order of conversation and turn, that a late message ends."""
    talks = _table(spark, sf_dir, "conversations")
    last = F.broadcast(talks.agg(F.floor(F.max("conv_id") / 2).alias("last")))
    said = talks.join(last).select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.when((F.col("conv_id") >= F.col("last")) & (F.col("turn") == 1), "quit").otherwise(F.col("text")).alias("value"))
    return until_quit(said, "seq").select("conv_id", "turn", "value")


def chat_stream(spark, sf_dir):
    folder = _scratch(spark)
    return _kept(spark, folder, sent_from_files(spark, sf_dir, "conversations.parquet", _said, folder))


def history_of_symbol(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey", "o_totalprice", F.col("o_orderpriority").alias("symbol"))
    return load_history(orders, "1995-01-01", "1996-01-01", "o_orderdate", "1-URGENT")


def http_parse(spark, sf_dir):
    talks = _table(spark, sf_dir, "conversations")
    raw = talks.select("conv_id", "turn", _text_request(F.col("role"), F.col("turn"), F.col("text")).alias("raw"))
    asked = http.parse_requests(raw)
    field = lambda k: F.element_at("headers", k)
    return asked.select(
        "conv_id", "turn", "method", "path", "version", field("Host").alias("host"), field("X-Turn").alias("x_turn"),
        F.size("headers").cast("long").alias("n_headers"), http.content_length(F.col("raw")).cast("long").alias("content_length"), "body", "valid", "error",
    )


def http_route(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    method = F.when(F.col("page_id") % 2 == 0, "GET").otherwise("POST")
    path = F.when(F.col("page_id") % 5 == 0, "/").when(F.col("page_id") % 5 == 1, "/message").when(F.col("page_id") % 5 == 2, "/about").otherwise(F.col("url"))
    return pages.select("page_id", method.alias("method"), path.alias("path")).withColumn("route", http.route(F.col("method"), F.col("path")))


def http_errors(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    kind = F.col("page_id") % 5
    line = F.when(kind == 1, "GET / HTTP/2.0").when(kind == 2, "GET /").otherwise("GET /about HTTP/1.0")
    length = F.when(kind == 3, "x").when(kind == 4, "1048577").otherwise("0")
    raw = F.concat(line, F.lit("\r\nContent-Length: "), length, F.lit("\r\n\r\n"))
    return http.handle(pages.select("page_id", raw.alias("raw"))).select("page_id", "valid", "error", "route", "status", "response")


def _case(kind: Column, text: Column) -> Column:
    sent = F.concat(F.lit("\r\n\r\n"), text)
    field = lambda line, *fields: F.concat(F.lit("\r\n".join([line, *fields])), sent)
    long = lambda more: F.concat(F.lit("POST /message HTTP/1.1\r\nContent-Length: "), (F.octet_length(text) + more).cast("string"), sent)
    return (
        F.when(kind == 0, field("GET / HTTP/1.0", "A: 1", "a:2", "A:  3"))
        .when(kind == 1, field("GET /?q=1 HTTP/1.1"))
        .when(kind == 2, field("POST /message HTTP/1.1", "no colon", ": empty name"))
        .when(kind == 3, field("GET / HTTP/1.1", "X: " + "y" * 8200))
        .when(kind == 4, F.lit("GET /about\r\n\r\n"))
        .when(kind == 5, field("GET / HTTP/1.2"))
        .when(kind == 6, field("GET / HTTP/1.1", "Content-Length: -1"))
        .when(kind == 8, long(5))
        .when(kind == 9, F.concat(long(0), F.lit("surplus")))
        .otherwise(field("GET / HTTP/1.1", "Content-Length: abc", "Content-Length: 5"))
    )


def http_received(spark, sf_dir):
    """The messages of ``http_cases``, of which some are cut and some have bytes behind their end, from chunks of a stream:
    each is cut anywhere, its chunks come in three runs, each of which goes on from the state of the one before."""
    folder = _scratch(spark)
    kind = (F.col("conv_id") + F.col("turn")) % 10
    sent = _table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("connection"), kind.alias("kind"), F.encode(_case(kind, F.col("text")), "utf-8").alias("bytes"))
    size = F.pmod(F.xxhash64("connection"), F.lit(1000)).cast("int") + 17
    chunks = sent.withColumn("size", size).withColumn("last", F.ceil(F.octet_length("bytes") / size).cast("int"))
    chunks = chunks.select("connection", "kind", "last", F.explode(F.sequence(F.lit(0), "last")).alias("seq"), "bytes", "size")
    chunk = F.when(F.col("seq") < F.col("last"), F.substring("bytes", F.col("seq") * F.col("size") + 1, F.col("size")))
    run = F.floor(3 * F.col("seq") / (F.col("last") + 1)).cast("int")
    ts = F.lit("2020-01-01").cast("timestamp") + F.make_dt_interval(mins=10 * run, secs=F.col("seq"))
    chunks = chunks.where((F.col("kind") != 8) | (F.col("seq") < F.col("last"))).select("connection", F.col("seq").cast("long").alias("seq"), ts.alias("ts"), chunk.alias("chunk"), run.alias("run"))
    clock = spark.createDataFrame([("clock", 0)], "connection string, seq long").select("*", F.lit("2020-01-02").cast("timestamp").alias("ts"), F.lit(None).cast("binary").alias("chunk"))
    for run in range(3):
        part = chunks.where(F.col("run") == run).drop("run")
        (part if run < 2 else part.unionByName(clock)).write.mode("append").parquet(f"{folder}/in")
        stream = receive_messages(spark.readStream.schema(clock.schema).parquet(f"{folder}/in"), "1 hour")
        writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        writer.start(f"{folder}/out").awaitTermination()
    found = handle_received(spark.read.schema(RECEIVED).parquet(f"{folder}/out").where("connection <> 'clock'"))
    value = lambda k: F.element_at("headers", k)
    return _kept(spark, folder, found.select(
        "connection", "method", "path", "version", value("A").alias("upper"), F.size("headers").cast("long").alias("n_headers"), "body", "valid", "error", "route", "response",
    ))


def http_cases(spark, sf_dir):
    """Messages of eight shapes from raw text to answer: valid ones of three routes, too long a head, a line of two words,
    an unknown version, a negative length, and a first length that is no number."""
    talks = _table(spark, sf_dir, "conversations")
    raw = _case((F.col("conv_id") + F.col("turn")) % 8, F.col("text"))
    found = http.handle(talks.select("conv_id", "turn", raw.alias("raw")))
    value = lambda k: F.element_at("headers", k)
    return found.select(
        "conv_id", "turn", "method", "path", "version", value("A").alias("upper"), value("a").alias("lower"), value("").alias("unnamed"), F.size("headers").cast("long").alias("n_headers"),
        "body", "valid", "error", "route", "response",
    )


def _log(spark, sf_dir):
    """Commands from events: a tenth of them for one task, some for tasks that don't exist, some that break a rule."""
    e = F.col("event_id")
    pick = lambda n, *items: F.element_at(F.array(*map(F.lit, items)), (e % n + 1).cast("int"))
    return _table(spark, sf_dir, "events").select(
        e.alias("seq"), pick(8, "add", "delete", "edit", "complete", "reopen", "complete", "edit", "reopen").alias("command"),
        F.when(e % 10 == 3, 1).otherwise(1 + e * 31 % 700).cast("long").alias("id"), F.when(e % 13 == 0, "").otherwise(F.concat(F.lit("title "), e)).alias("title"),
        F.when(e % 17 == 0, "").otherwise(F.col("event_type")).alias("description"), pick(5, "low", "HIGH", "Medium", "urgent", "High").alias("priority"),
    )


def task_command_log(spark, sf_dir):
    """The outcome of every command of a log, and how many tasks there were before it."""
    return commands.replay(_titled(spark, sf_dir), _log(spark, sf_dir)).outcomes


def task_command_list(spark, sf_dir):
    """The tasks after the log."""
    return commands.replay(_titled(spark, sf_dir), _log(spark, sf_dir)).tasks


def product_array(spark, sf_dir):
    """Products written by many tasks as one JSON array, by descending id, and read from it by many tasks, with their places."""
    folder = _scratch(spark)
    json_arrays.write_array(products(spark, sf_dir).select("id", F.concat("name", F.lit(' }"{ \\ ')).alias("name"), "quantity", "price").withColumn("o", -F.col("id")), folder, "o")
    return _kept(spark, folder, json_arrays.read_array(spark, folder, PRODUCT))


def product_commit_log(spark, sf_dir):
    """Every version of a table after writers have raced: one is refused and tries again from what the other has made,
    old data goes, and the next number is still the next. Rows of the versions that are left."""
    folder = _scratch(spark)
    everything = products(spark, sf_dir)
    store = Store(spark, folder, everything.schema)
    store.commit(everything, 0)
    store.commit(tables.delete(store.read(1), everything.where("id % 4 = 0").select("id")), 1)
    try:
        store.commit(store.read(1).where("id % 3 = 0"), 1)  # made from version 1, which isn't the newest any more
    except Conflict:
        store.update(lambda rows: rows.where("id % 3 = 0"))
    store.retain(2)
    store.commit(everything.where("id % 5 = 0"), 3, append=True)
    kept = [store.read(v).withColumn("version", F.lit(v).cast("long")) for v in store.versions()[1:]]
    return _kept(spark, folder, kept[0].unionByName(kept[1]).unionByName(kept[2]))


def product_totals(spark, sf_dir):
    """Total value, number of rows and highest id, kept through batches: all products come, a fifth is edited, a seventh and all of
    the upper half go; the last batch is sent twice."""
    folder = _scratch(spark)
    everything = products(spark, sf_dir)
    edited = _product_changes(spark, sf_dir)
    half = F.broadcast(everything.agg(F.floor(F.max("id") / 2).alias("half")))  # one row
    after = everything.where("id % 5 <> 0").unionByName(edited)
    gone = after.join(half).where("id % 7 = 0 or id > half").drop("half")
    batches = [totals.signed(None, everything), totals.signed(everything.where("id % 5 = 0"), edited), totals.signed(gone, None)]
    values, ids = Store(spark, f"{folder}/value", totals.VALUE), Store(spark, f"{folder}/ids", totals.IDS)
    found = []
    for step, number in enumerate((0, 1, 2, 2)):
        totals.merge_batch(values, totals.value_changes(batches[number]), number)
        totals.merge_batch(ids, totals.id_changes(batches[number]), number, most_parts=3)
        found.append(totals.total_value(values.read()).join(totals.highest_id(ids.read())).select(F.lit(step).cast("long").alias("step"), "total_value", "n_rows", "max_id"))
    return _kept(spark, folder, found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]))


def book_changes(spark, sf_dir):
    """The depth of a book to which orders come and of which every tenth is cancelled later, as a stream of signed orders in two runs."""
    folder = _scratch(spark)
    orders = as_orders(_table(spark, sf_dir, "events")).select("id", "side", "price", "quantity")
    for rows in (totals.signed(None, orders), totals.signed(orders.where("id % 10 = 0"), None)):
        rows.write.mode("append").parquet(f"{folder}/in")
        change_stream(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), folder).awaitTermination()
    return _kept(spark, folder, current_levels(spark, folder))


def chat_two_way(spark, sf_dir):
    """Each message of a conversation with the other role's last one in the two minutes before it; a turn is a minute."""
    folder = _scratch(spark)
    ts = F.lit("2020-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("turn").cast("int"))
    talks = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("talk"), F.col("role").alias("side"), F.col("turn").alias("seq"), ts.alias("ts"), F.col("text").alias("value"))
    clock = [("clock", role, 0, "") for role in ("a", "b")]
    end = spark.createDataFrame(clock, "talk string, side string, seq long, value string").select("talk", "side", "seq", F.lit("2021-01-01").cast("timestamp").alias("ts"), "value")
    for run in range(2):
        (talks.where("seq < 3") if run == 0 else talks.where("seq >= 3").unionByName(end)).write.mode("append").parquet(f"{folder}/in")
        found = two_way(spark.readStream.schema(end.schema).parquet(f"{folder}/in"), "2 minutes")
        writer = found.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        writer.start(f"{folder}/out").awaitTermination()
    return _kept(spark, folder, spark.read.schema(found.schema).parquet(f"{folder}/out").where("talk <> 'clock'").drop("ts"))


def history_adjusted(spark, sf_dir):
    """Order totals as prices of their customer's symbol, adjusted by splits on some days: a factor a symbol, day and order."""
    orders = _table(spark, sf_dir, "orders")
    symbol = F.when(F.col("o_custkey") % 3 == 0, "all").otherwise(F.concat(F.lit("c"), F.col("o_custkey") % 100))
    prices = orders.select("o_orderkey", symbol.alias("symbol"), F.col("o_orderdate").alias("day"), F.col("o_totalprice").alias("close"))
    splits = prices.where("o_orderkey % 50 = 7").select("symbol", F.col("day").alias("ts"), F.when(F.col("o_orderkey") % 100 == 7, 0.5).otherwise(2.0).alias("factor"))
    return adjusted_history(prices, splits, "day")


def http_response(spark, sf_dir):
    talks = _table(spark, sf_dir, "conversations")
    return talks.select("conv_id", "turn", http.render_response(F.lit("200 OK"), F.concat(F.lit(http.RECEIVED), F.col("text"))).alias("response"))


def range_head(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey", "o_totalprice")
    return reports.head(load_history(orders, "1995-01-01", "1996-01-01", "o_orderdate"), "o_orderdate", "o_orderkey")


QUERIES = {
    f.__name__: f
    for f in (
        inventory_value, low_stock, product_by_id, product_list, product_verdicts, product_upsert, product_edit, product_delete, product_insert,
        product_insert_refused, product_lookup, product_lookup_empty, product_clear, product_snapshot, number_inputs, task_snapshot, task_short_list, task_insert, task_verdicts,
        filter_messages, priority_labels, task_first_by_id, book_sides, book_add, chat_until_quit, chat_stream, history_of_symbol, http_cases, product_json, next_id, task_by_status, task_by_priority, task_list, task_edit, task_sort_id, task_sort_priority, task_complete, task_reopen, task_delete_first,
        product_lookup_bucketed, task_keyed, http_received, task_command_log, task_command_list, product_array, product_commit_log, product_totals, book_changes, chat_two_way, history_adjusted,
        title_search, title_search_indexed, book_depth, book_fifo, book_stream, http_parse, http_route, http_errors, http_response, range_head,
    )
}

_PRODUCT = "SELECT p_partkey AS id, p_name AS name, p_size AS quantity, p_retailprice AS price FROM part"
_PRIORITY = "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'High' WHEN o_orderpriority = '5-LOW' THEN 'Low' ELSE 'Medium' END"
_RANK = "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 3 WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 2 END"
_TASK = f"SELECT o_orderkey AS id, {_PRIORITY} AS priority, o_orderstatus = 'F' AS completed FROM orders"
_ORDER = "SELECT event_id AS id, ts, CASE WHEN event_type IN ('click', 'purchase') THEN 'Buy' ELSE 'Sell' END AS side, CAST(floor(value) AS BIGINT) AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS quantity FROM events"
_DEPTH = f"SELECT side, price, CAST(sum(quantity) AS BIGINT) AS quantity, count(*) AS n_orders FROM ({_ORDER}) GROUP BY side, price"
_TITLED = f"SELECT id, priority, completed, concat('order ', id) AS title, '' AS description FROM ({_TASK})"
_LINES = "SELECT DISTINCT l_orderkey AS id, printf('%d %010d %010d', l_linenumber, l_partkey, l_suppkey) AS seq FROM lineitem"
_NEXT_TASK = "(SELECT max(o_orderkey) FROM orders)"
_ANSWER = "concat('HTTP/1.1 ', status, chr(13), chr(10), 'Content-Type: text/plain', chr(13), chr(10), 'Content-Length: ', strlen(sent), chr(13), chr(10), 'Connection: close', chr(13), chr(10), chr(13), chr(10), sent) AS response"
_SET = "SELECT id, priority, CASE WHEN id % 10 = 0 THEN {to} ELSE completed END AS completed, CASE WHEN id % 10 <> 0 THEN 'untouched' WHEN completed = {to} THEN 'already' ELSE '{done}' END AS outcome FROM ({task})"

_REPLAY = f"""WITH RECURSIVE t AS ({_TITLED}),
e AS (SELECT event_id AS seq, ['add', 'delete', 'edit', 'complete', 'reopen', 'complete', 'edit', 'reopen'][event_id % 8 + 1] AS command, CASE WHEN event_id % 10 = 3 THEN 1 ELSE 1 + event_id * 31 % 700 END AS asked,
  CASE WHEN event_id % 13 = 0 THEN '' ELSE concat('title ', event_id) END AS title, CASE WHEN event_id % 17 = 0 THEN '' ELSE event_type END AS description, ['low', 'HIGH', 'Medium', 'urgent', 'High'][event_id % 5 + 1] AS priority FROM events),
c AS (SELECT *, CASE WHEN command <> 'add' THEN asked WHEN title <> '' THEN (SELECT max(id) FROM t) + sum(CASE WHEN command = 'add' AND title <> '' THEN 1 END) OVER (ORDER BY seq) END AS id FROM e),
s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS k FROM c WHERE id IS NOT NULL),
r AS (SELECT i.id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, t.id IS NOT NULL AS there, t.title, t.description, t.priority, t.completed, '' AS outcome FROM (SELECT DISTINCT id FROM s) i LEFT JOIN t ON t.id = i.id
  UNION ALL
  SELECT r.id, s.k, s.seq, CASE s.command WHEN 'add' THEN TRUE WHEN 'delete' THEN FALSE ELSE there END,
    CASE WHEN s.command = 'add' OR good THEN s.title ELSE r.title END, CASE WHEN s.command = 'add' OR good THEN s.description ELSE r.description END,
    CASE WHEN good THEN ['Low', 'Medium', 'High'][list_position(['low', 'medium', 'high'], lower(s.priority))] WHEN s.command = 'add' THEN CASE WHEN s.priority = 'low' THEN 'Low' WHEN s.priority = 'High' THEN 'High' ELSE 'Medium' END ELSE r.priority END,
    CASE WHEN s.command = 'add' THEN FALSE WHEN there AND s.command = 'complete' THEN TRUE WHEN there AND s.command = 'reopen' THEN FALSE ELSE r.completed END,
    CASE WHEN s.command = 'add' THEN 'Task added successfully.' WHEN NOT there THEN 'Task not found.' WHEN s.command = 'delete' THEN 'Task removed successfully.'
      WHEN s.command = 'edit' THEN CASE WHEN s.title = '' THEN 'Task title cannot be empty.' WHEN s.description = '' THEN 'Task description cannot be empty.' WHEN s.priority = 'urgent' THEN 'Invalid priority.' ELSE 'Task updated successfully.' END
      WHEN s.command = 'complete' THEN CASE WHEN r.completed THEN 'Task is already completed.' ELSE 'Task completed successfully.' END
      WHEN r.completed THEN 'Task reopened successfully.' ELSE 'Task is already incomplete.' END
  FROM (SELECT r.*, s.k AS next, r.there AND s.command = 'edit' AND s.title <> '' AND s.description <> '' AND s.priority <> 'urgent' AS good FROM r JOIN s ON s.id = r.id AND s.k = r.k + 1) r JOIN s ON s.id = r.id AND s.k = r.next)"""
#: http_cases' columns for messages of ten shapes; k is the shape.
_CASES = """CASE WHEN k IN (0, 1, 4, 5) THEN 'GET' WHEN k IN (2, 9) THEN 'POST' ELSE '' END AS method,
  CASE k WHEN 0 THEN '/' WHEN 1 THEN '/?q=1' WHEN 2 THEN '/message' WHEN 4 THEN '/about' WHEN 5 THEN '/' WHEN 9 THEN '/message' ELSE '' END AS path,
  CASE k WHEN 0 THEN 'HTTP/1.0' WHEN 1 THEN 'HTTP/1.1' WHEN 2 THEN 'HTTP/1.1' WHEN 5 THEN 'HTTP/1.2' WHEN 9 THEN 'HTTP/1.1' ELSE '' END AS version"""

ORACLE_SQL = {
    "http_received": f"""WITH c AS (SELECT concat(conv_id, '/', turn) AS connection, text, (conv_id + turn) % 10 AS k FROM conversations),
m AS (SELECT *, k IN (0, 1, 2, 9) AS valid, CASE k WHEN 3 THEN 'Request headers too large' WHEN 4 THEN 'Malformed request line' WHEN 5 THEN 'Unsupported HTTP version' WHEN 6 THEN 'Request body too large' WHEN 7 THEN 'Invalid Content-Length' ELSE '' END AS error,
  CASE k WHEN 0 THEN 'home' WHEN 1 THEN 'not found' WHEN 2 THEN 'message' WHEN 9 THEN 'message' ELSE 'bad request' END AS route FROM c),
a AS (SELECT *, CASE WHEN NOT valid THEN '400 Bad Request' WHEN k = 1 THEN '404 Not Found' ELSE '200 OK' END AS status,
  CASE WHEN k = 8 THEN 'Invalid HTTP request' WHEN NOT valid THEN error WHEN k = 0 THEN 'Hello from C++' WHEN k = 1 THEN 'route not found' ELSE concat('Received: ', text) END AS sent FROM m)
SELECT connection, {_CASES}, CASE WHEN k = 0 THEN ' 3' END AS upper, CAST(CASE k WHEN 0 THEN 2 WHEN 2 THEN 1 WHEN 9 THEN 1 ELSE 0 END AS BIGINT) AS n_headers, CASE WHEN valid THEN text ELSE '' END AS body, valid, error, route, {_ANSWER} FROM a""",
    "task_command_log": _REPLAY + """, o AS (SELECT seq, command, id, 'Task title cannot be empty.' AS outcome FROM c WHERE id IS NULL UNION ALL SELECT r.seq, s.command, r.id, r.outcome FROM r JOIN s ON s.seq = r.seq)
SELECT seq, command, CAST(id AS BIGINT) AS id, outcome, CAST((SELECT count(*) FROM t) + coalesce(sum(CASE outcome WHEN 'Task added successfully.' THEN 1 WHEN 'Task removed successfully.' THEN -1 ELSE 0 END) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_tasks FROM o""",
    "task_command_list": _REPLAY + """ SELECT CAST(id AS BIGINT) AS id, title, description, priority, completed FROM r QUALIFY there AND k = max(k) OVER (PARTITION BY id)
UNION ALL SELECT id, title, description, priority, completed FROM t WHERE id NOT IN (SELECT id FROM s)""",
    "product_array": f"SELECT id, concat(name, ' }}\"{{ \\ ') AS name, CAST(quantity AS BIGINT) AS quantity, price, row_number() OVER (ORDER BY id DESC) - 1 AS seq FROM ({_PRODUCT})",
    "product_commit_log": f"WITH p AS ({_PRODUCT}), b AS (SELECT * FROM p WHERE id % 4 <> 0), c AS (SELECT * FROM b WHERE id % 3 = 0) SELECT *, CAST(2 AS BIGINT) AS version FROM b UNION ALL SELECT *, 3 FROM c UNION ALL SELECT *, 4 FROM c UNION ALL SELECT *, 4 FROM p WHERE id % 5 = 0",
    "product_totals": f"""WITH p AS ({_PRODUCT}), q AS (SELECT id, quantity + CASE WHEN id % 5 = 0 THEN 100 ELSE 0 END AS quantity, price FROM p), z AS (SELECT * FROM q WHERE id % 7 <> 0 AND id <= (SELECT max(id) // 2 FROM p)),
a AS (SELECT 0 AS step, id, quantity, price FROM p UNION ALL SELECT 1, * FROM q UNION ALL SELECT 2, * FROM z UNION ALL SELECT 3, * FROM z)
SELECT CAST(step AS BIGINT) AS step, CAST(sum(quantity * CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS total_value, count(*) AS n_rows, max(id) AS max_id FROM a GROUP BY step""",
    "book_changes": f"SELECT side, price, CAST(sum(quantity) AS BIGINT) AS quantity, count(*) AS n_orders FROM ({_ORDER}) WHERE id % 10 <> 0 GROUP BY side, price",
    "chat_two_way": """SELECT CAST(a.conv_id AS VARCHAR) AS talk, a.role AS side, a.turn AS seq, a.text AS value, max(b.turn) AS heard_seq, arg_max(b.text, b.turn) AS heard
FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.role <> a.role AND b.turn < a.turn AND b.turn >= a.turn - 2 GROUP BY a.conv_id, a.role, a.turn, a.text""",
    "history_adjusted": """WITH p AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'all' ELSE concat('c', o_custkey % 100) END AS symbol, o_orderdate AS day, o_totalprice AS close FROM orders),
f AS (SELECT symbol, day AS ts, CASE WHEN o_orderkey % 100 = 7 THEN 0.5 ELSE 2.0 END AS factor FROM p WHERE o_orderkey % 50 = 7),
a AS (SELECT o_orderkey, coalesce(product(f.factor), 1.0) AS adjustment FROM p LEFT JOIN f ON f.symbol = p.symbol AND f.ts > p.day GROUP BY o_orderkey)
SELECT o_orderkey, symbol, day, close, CAST(adjustment AS DOUBLE) AS adjustment, close * adjustment AS adjusted_close FROM p JOIN a USING (o_orderkey)""",
    "inventory_value": "SELECT CAST(sum(p_size * CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS total_value FROM part",
    "low_stock": "SELECT p_name AS name FROM part WHERE p_size < 10",
    "product_by_id": f"SELECT * FROM ({_PRODUCT}) WHERE id = 5",
    "product_list": _PRODUCT,
    "product_verdicts": f"SELECT id, CASE WHEN name = '' THEN 'empty name' WHEN quantity < 3 THEN 'bad quantity' WHEN price - 950 < 0 THEN 'bad price' ELSE 'ok' END AS verdict FROM ({_PRODUCT})",
    "product_upsert": f"SELECT id, name, CASE WHEN id % 5 = 0 THEN quantity + 100 ELSE quantity END AS quantity, price FROM ({_PRODUCT})",
    "product_edit": f"SELECT id, name, CASE WHEN id % 3 = 0 AND quantity >= 10 THEN quantity - 10 ELSE quantity END AS quantity, price FROM ({_PRODUCT})",
    "product_delete": f"SELECT * FROM ({_PRODUCT}) WHERE id % 7 <> 0",
    "product_insert": f"SELECT * FROM ({_PRODUCT}) UNION ALL SELECT (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY id), concat('new ', name), quantity - 20, price FROM ({_PRODUCT}) WHERE id <= 5 AND name <> '' AND quantity >= 20 AND price >= 0",
    "product_json": "SELECT concat('{\"id\":', p_partkey, ',\"name\":\"', p_name, '\"}') AS value FROM part",
    "next_id": "SELECT greatest(coalesce(max(p_partkey), 0), 0) + 1 AS next_id, count(*) AS n_rows FROM part",
    "task_by_status": f"SELECT id, '[x] ' AS mark, priority FROM ({_TASK}) WHERE completed",
    "task_by_priority": f"SELECT * FROM ({_TASK}) WHERE priority = 'High'",
    "task_list": f"SELECT id, CASE WHEN completed THEN '[x] ' ELSE '[ ] ' END AS mark, concat('order ', id) AS title, '' AS description, priority FROM ({_TASK})",
    "task_edit": f"SELECT id, CASE WHEN id % 6 = 0 THEN 'High' ELSE priority END AS priority, completed, CASE WHEN id % 6 = 0 THEN 'new' ELSE 'old' END AS title, CASE WHEN id % 6 = 0 THEN 'e' ELSE 'd' END AS description FROM ({_TASK})",
    "task_sort_id": f"SELECT *, row_number() OVER (ORDER BY id) AS place FROM ({_TASK})",
    "task_sort_priority": f"SELECT o_orderkey AS id, {_PRIORITY} AS priority, o_orderstatus = 'F' AS completed, row_number() OVER (ORDER BY {_RANK} DESC, o_orderkey) AS place FROM orders",
    "task_complete": _SET.format(to="TRUE", done="completed", task=_TASK),
    "task_reopen": _SET.format(to="FALSE", done="reopened", task=_TASK),
    "task_delete_first": f"SELECT id, seq FROM ({_LINES}) QUALIFY id % 2 = 1 OR row_number() OVER (PARTITION BY id ORDER BY seq) > 1",
    "task_first_by_id": f"SELECT id, min(seq) AS seq FROM ({_LINES}) WHERE id = 7 GROUP BY id",
    "product_snapshot": f"SELECT * FROM ({_PRODUCT}) WHERE id % 4 <> 0",
    "task_snapshot": f"SELECT id, title, priority, completed, row_number() OVER (ORDER BY id DESC) AS place FROM ({_TITLED})",
    "product_lookup": f"WITH p AS ({_PRODUCT}), a AS (SELECT CASE WHEN id % 3 = 0 THEN concat('no ', id) ELSE CAST(id * 2 AS VARCHAR) END AS asked, CASE WHEN id % 3 <> 0 THEN id * 2 END AS k FROM p) SELECT asked, p.*, CASE WHEN k IS NULL THEN 'Please enter a valid number.' WHEN id IS NULL THEN 'Product ID not found.' ELSE 'found' END AS outcome FROM a LEFT JOIN p ON id = k",
    "product_lookup_empty": "SELECT CAST(p_partkey AS VARCHAR) AS asked, CAST(NULL AS BIGINT) AS id, 'No products available.' AS outcome FROM part",
    "product_clear": f"SELECT * FROM ({_PRODUCT}) WHERE FALSE",
    "product_insert_refused": _PRODUCT,
    "number_inputs": f"SELECT id, CASE WHEN id % 5 < 2 THEN CAST(quantity AS BIGINT) END AS number, CASE WHEN id % 5 < 2 AND quantity BETWEEN 1 AND 25 THEN CAST(quantity AS BIGINT) END AS bounded, CASE WHEN id % 5 < 2 THEN CAST(quantity AS DOUBLE) WHEN id % 5 = 4 THEN price END AS real FROM ({_PRODUCT})",
    "task_short_list": f"SELECT id, CASE WHEN completed THEN '[x] ' ELSE '[ ] ' END AS mark, title FROM ({_TITLED})",
    "task_insert": f"SELECT * FROM ({_TITLED}) UNION ALL SELECT {_NEXT_TASK} + row_number() OVER (ORDER BY p_partkey), CASE p_partkey % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'High' ELSE 'Medium' END, FALSE, concat('new ', p_name), '' FROM part WHERE p_partkey <= 10 AND p_partkey % 5 <> 0",
    "task_verdicts": "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'empty title' ELSE 'ok' END AS inserting, CASE WHEN p_partkey % 5 = 0 THEN 'empty title' WHEN p_partkey % 3 = 0 THEN 'empty description' WHEN p_partkey % 7 = 0 THEN 'bad priority' ELSE 'ok' END AS editing FROM part",
    "filter_messages": "SELECT * FROM (VALUES ('none', 'No matching tasks found.'), ('empty keyword', 'No matching tasks found.'), ('empty table', 'No tasks available.')) v(\"case\", message)",
    "priority_labels": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 < 2 THEN 'Low' WHEN o_orderkey % 7 = 3 THEN 'High' ELSE 'Medium' END AS stored, CASE WHEN o_orderkey % 7 < 3 THEN 'Low' WHEN o_orderkey % 7 < 5 THEN 'High' END AS edited, CAST(CASE WHEN o_orderkey % 7 < 2 THEN 1 WHEN o_orderkey % 7 = 3 THEN 3 ELSE 2 END AS BIGINT) AS rank, CASE o_orderkey % 5 WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' WHEN 3 THEN 'High' ELSE 'Unknown' END AS label FROM orders",
    "book_sides": f"SELECT *, row_number() OVER (PARTITION BY side ORDER BY CASE WHEN side = 'Buy' THEN -price ELSE price END) AS place FROM ({_DEPTH})",
    "book_add": f"SELECT side, price, CAST(sum(CASE WHEN id % 10 = 0 THEN 3 ELSE 1 END * quantity) AS BIGINT) AS quantity, count(*) + count(*) FILTER (id % 10 = 0) AS n_orders FROM ({_ORDER}) GROUP BY side, price",
    "chat_until_quit": "WITH l AS (SELECT max(conv_id) // 2 AS last FROM conversations), q AS (SELECT min(conv_id * 1000 + turn) AS q FROM conversations, l WHERE conv_id >= last AND turn = 1) SELECT conv_id, turn, text AS value FROM conversations, q WHERE q IS NULL OR conv_id * 1000 + turn < q",
    "chat_stream": "SELECT CAST(conv_id AS VARCHAR) AS talk, turn AS seq, text AS value FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn <= c.turn AND (d.conv_id + d.turn) % 5 = 4)",
    "history_of_symbol": "SELECT o_orderdate, o_orderkey, o_totalprice, o_orderpriority AS symbol FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' AND o_orderpriority = '1-URGENT'",
    "http_cases": f"""WITH c AS (SELECT conv_id, turn, text, (conv_id + turn) % 8 AS k FROM conversations),
m AS (SELECT *, k < 3 AS valid, CASE k WHEN 3 THEN 'Request headers too large' WHEN 4 THEN 'Malformed request line' WHEN 5 THEN 'Unsupported HTTP version' WHEN 6 THEN 'Request body too large' WHEN 7 THEN 'Invalid Content-Length' ELSE '' END AS error,
  CASE k WHEN 0 THEN 'home' WHEN 1 THEN 'not found' WHEN 2 THEN 'message' ELSE 'bad request' END AS route FROM c),
a AS (SELECT *, CASE WHEN NOT valid THEN '400 Bad Request' WHEN k = 1 THEN '404 Not Found' ELSE '200 OK' END AS status,
  CASE WHEN NOT valid THEN error WHEN k = 0 THEN 'Hello from C++' WHEN k = 1 THEN 'route not found' ELSE concat('Received: ', text) END AS sent FROM m)
SELECT conv_id, turn, CASE WHEN k IN (0, 1, 4, 5) THEN 'GET' WHEN k = 2 THEN 'POST' ELSE '' END AS method,
  CASE k WHEN 0 THEN '/' WHEN 1 THEN '/?q=1' WHEN 2 THEN '/message' WHEN 4 THEN '/about' WHEN 5 THEN '/' ELSE '' END AS path,
  CASE k WHEN 0 THEN 'HTTP/1.0' WHEN 1 THEN 'HTTP/1.1' WHEN 2 THEN 'HTTP/1.1' WHEN 5 THEN 'HTTP/1.2' ELSE '' END AS version,
  CASE WHEN k = 0 THEN ' 3' END AS upper, CASE WHEN k = 0 THEN '2' END AS lower, CASE WHEN k = 2 THEN 'empty name' END AS unnamed,
  CAST(CASE k WHEN 0 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS BIGINT) AS n_headers, CASE WHEN valid THEN text ELSE '' END AS body, valid, error, route, {_ANSWER} FROM a""",
    "title_search": "SELECT doc_id FROM documents WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the')",
    "title_search_indexed": "SELECT keyword, doc_id FROM documents, (SELECT unnest(['The', 'Q', 'ation THE', 'no such words']) AS keyword) WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), lower(keyword))",
    "book_depth": _DEPTH,
    "book_fifo": f"SELECT id, side, price, row_number() OVER (PARTITION BY side, price ORDER BY ts, id) AS place FROM ({_ORDER})",
    "book_stream": _DEPTH,
    "http_parse": "SELECT conv_id, turn, 'POST' AS method, concat('/', role) AS path, 'HTTP/1.1' AS version, 'last' AS host, concat(' ', turn) AS x_turn, CAST(3 AS BIGINT) AS n_headers, CAST(strlen(text) AS BIGINT) AS content_length, text AS body, TRUE AS valid, '' AS error FROM conversations",
    "http_route": "SELECT page_id, method, path, CASE WHEN method = 'GET' AND path = '/' THEN 'home' WHEN method = 'GET' AND path = '/about' THEN 'about' WHEN method = 'POST' AND path = '/message' THEN 'message' ELSE 'not found' END AS route FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, CASE page_id % 5 WHEN 0 THEN '/' WHEN 1 THEN '/message' WHEN 2 THEN '/about' ELSE url END AS path FROM pages)",
    "http_errors": "SELECT * EXCLUDE (sent), concat('HTTP/1.1 ', status, chr(13), chr(10), 'Content-Type: text/plain', chr(13), chr(10), 'Content-Length: ', strlen(sent), chr(13), chr(10), 'Connection: close', chr(13), chr(10), chr(13), chr(10), sent) AS response FROM (SELECT page_id, page_id % 5 = 0 AS valid, error, CASE WHEN page_id % 5 = 0 THEN 'about' ELSE 'bad request' END AS route, CASE WHEN page_id % 5 = 0 THEN '200 OK' ELSE '400 Bad Request' END AS status, CASE WHEN page_id % 5 = 0 THEN 'About page' ELSE error END AS sent FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Unsupported HTTP version' WHEN 2 THEN 'Unsupported HTTP version' WHEN 3 THEN 'Invalid Content-Length' ELSE 'Request body too large' END AS error FROM pages))",
    "http_response": "SELECT conv_id, turn, concat('HTTP/1.1 200 OK', chr(13), chr(10), 'Content-Type: text/plain', chr(13), chr(10), 'Content-Length: ', strlen(concat('Received: ', text)), chr(13), chr(10), 'Connection: close', chr(13), chr(10), chr(13), chr(10), 'Received: ', text) AS response FROM conversations",
    "range_head": "SELECT o_orderdate, o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 5",
}
ORACLE_SQL["product_lookup_bucketed"] = ORACLE_SQL["product_lookup"]
ORACLE_SQL["task_keyed"] = f"SELECT * FROM ({_TITLED}) WHERE id = 777"
