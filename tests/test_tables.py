import json

from pyspark.sql import functions as F

from loamline.operators import book, reports, tables
from loamline.schemas import PRODUCT
from loamline.sources import json_tables
from loamline.sources.chat import until_quit
from loamline.sources.prices import load_history
from loamline.streaming.book import depth_stream
from loamline.streaming.chat import send_until_quit


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def products(spark, *items):
    return spark.createDataFrame(list(items), PRODUCT)


def tasks(spark, *items):
    return spark.createDataFrame(list(items), "seq long, id long, title string, description string, priority string, completed boolean")


def test_next_id_follows_the_highest(spark):
    assert tables.next_id(products(spark)).first()["next_id"] == 1
    assert tables.next_id(products(spark), first_id=0).first()["next_id"] == 0
    assert tables.next_id(products(spark, (7, "a", 1, 1.0), (3, "b", 1, 1.0))).first()["next_id"] == 8


def test_insert_skips_invalid_rows_and_numbers_the_others(spark):
    new = spark.createDataFrame([(1, "x", 1, 1.0), (2, "", 1, 1.0), (3, "y", -1, 1.0), (4, "z", 0, 0.0)], "arrival long, name string, quantity long, price double")
    assert rows(tables.insert_products(products(spark, (5, "a", 1, 1.0)), new), "id") == [(5, "a", 1, 1.0), (6, "x", 1, 1.0), (7, "z", 0, 0.0)]
    assert tables.check_batch(new).first()["accepted"]
    assert not tables.check_batch(spark.range(11)).first()["accepted"]
    many = new.unionByName(new).unionByName(new)
    assert rows(tables.insert_products(products(spark, (5, "a", 1, 1.0)), many)) == [(5, "a", 1, 1.0)]
    assert rows(tables.insert_products(products(spark, (5, "a", 1, 1.0)), new.limit(0))) == [(5, "a", 1, 1.0)]


def test_edits_are_all_or_nothing(spark):
    base = products(spark, (1, "a", 1, 1.0), (2, "b", 2, 2.0))
    edits = products(spark, (1, "new", -1, 1.0), (2, "b2", 3, 2.5), (9, "none", 1, 1.0))
    assert rows(tables.edit_products(base, edits)) == [(1, "a", 1, 1.0), (2, "b2", 3, 2.5)]


def test_task_changes(spark):
    base = tasks(spark, (0, 1, "a", "", "Low", False), (1, 1, "b", "", "High", True), (2, 2, "c", "", "Medium", False))
    assert rows(tables.delete_first(base, spark.createDataFrame([(1,)], "id long")).select("seq")) == [(1,), (2,)]
    assert tables.first_by_id(base, 1).first()["title"] == "a"
    edits = spark.createDataFrame([(2, "c2", "d", "HIGH"), (1, "x", "", "low")], "id long, title string, description string, priority string")
    assert rows(tables.edit_tasks(base, edits).where("id = 2").select("title", "description", "priority")) == [("c2", "d", "High")]
    assert rows(tables.edit_tasks(base, edits).where("id = 1").select("title")) == [("a",), ("b",)]
    done = tables.set_completed(base, F.col("id") == 1, True)
    assert rows(done.select("seq", "completed", "outcome")) == [(0, True, "completed"), (1, True, "already"), (2, False, "untouched")]
    assert tables.cleared(base).isEmpty()


def test_reports(spark):
    base = products(spark, (1, "a", 9, 1.25), (2, "b", 10, 2.0), (3, "a", 0, 4.0))
    assert reports.inventory_value(base).first()[0] == 31.25
    assert reports.inventory_value(products(spark)).first()[0] is None
    assert rows(reports.low_stock(base)) == [("a",), ("a",)]
    assert rows(reports.or_message(base.where("id > 5"))) == [("No matching tasks found.",)]
    assert reports.or_message(base).isEmpty()


def test_sorts_and_places(spark):
    base = tasks(spark, (0, 2, "a", "", "Low", False), (1, 3, "b", "", "High", True), (2, 1, "c", "", "High", False))
    assert [r["id"] for r in reports.sort_by_priority(base, "seq").collect()] == [1, 3, 2]
    assert rows(reports.numbered(base, "id").select("place", "id")) == [(1, 1), (2, 2), (3, 3)]
    assert reports.search_titles(base, "").isEmpty()


def test_json_round_trip(spark, tmp_path):
    missing = json_tables.load_products(spark, str(tmp_path / "none.json"))
    assert missing.isEmpty() and missing.columns == ["id", "name", "quantity", "price"]
    path = tmp_path / "p.json"
    path.write_text(json.dumps([{"id": 1, "name": "a", "quantity": 1, "price": 2.0}, {"id": 1, "name": "b", "quantity": 2}, {"id": 2, "quantity": "x", "name": "c", "price": 1}]))
    assert rows(json_tables.load_products(spark, str(path))) == [(1, "b", 2, None), (2, "c", None, 1.0)]
    base = products(spark, (1, "a", 1, 1.5), (2, "b", 2, 2.5))
    json_tables.save_table(base, str(tmp_path / "saved"))
    assert rows(json_tables.load_products(spark, str(tmp_path / "saved"))) == rows(base)
    assert json.loads(json_tables.json_array(base).first()[0])[1]["name"] == "b"


def test_tasks_keep_repeated_ids_and_order(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps([{"id": 1, "title": "a", "priority": "HIGH"}, {"id": 1, "title": "b", "priority": "low"}]))
    assert [(r["title"], r["priority"]) for r in json_tables.load_tasks(spark, str(path)).orderBy("seq").collect()] == [("a", "Medium"), ("b", "Low")]


def test_list_order_survives_any_number_of_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        base = spark.createDataFrame([(9000 - i, i, f"t{i}" * (i % 50), "", "Low", False) for i in range(3000)], "seq long, id long, title string, description string, priority string, completed boolean")
        json_tables.save_tasks(base.repartition(7), str(tmp_path / "t"))
        loaded = json_tables.load_tasks(spark, str(tmp_path / "t"))
        assert [r["id"] for r in loaded.orderBy("seq").collect()] == list(range(2999, -1, -1))
        json_tables.save_table(base.drop("seq").orderBy("id"), str(tmp_path / "plain"))
        assert [r["id"] for r in json_tables.load_tasks(spark, str(tmp_path / "plain")).orderBy("seq").collect()] == list(range(3000))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_snapshots_replace_what_they_read(spark, tmp_path):
    folder = str(tmp_path / "s")
    load = lambda: json_tables.load_products(spark, json_tables.latest_version(spark, folder))
    assert load().isEmpty()
    json_tables.save_version(products(spark, (1, "a", 1, 1.0), (2, "b", 2, 2.0)), folder)
    json_tables.save_version(load().where("id = 2"), folder)
    (tmp_path / "s" / "00000003").mkdir()  # a version that a lost job left half written
    assert rows(load()) == [(2, "b", 2, 2.0)]


def test_lookups_say_what_they_found(spark):
    asked = spark.createDataFrame([("1",), ("x",), ("7",), (None,)], "asked string")
    found = tables.lookup(products(spark, (1, "a", 1, 1.0)), asked)
    assert sorted((r["asked"] or "", r["name"], r["outcome"]) for r in found.collect()) == [("", None, "Please enter a valid number."), ("1", "a", "found"), ("7", None, "Product ID not found."), ("x", None, "Please enter a valid number.")]


def test_streamed_talks_end_over_micro_batches(spark, tmp_path):
    for k, batch in enumerate([[("a", 1, "hi"), ("b", 1, "x")], [("a", 3, "late"), ("a", 2, "quit"), ("b", 2, "y")], [("a", 4, "later"), ("b", 3, "quit")]]):
        spark.createDataFrame(batch, "talk string, seq long, value string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        files = spark.readStream.schema("talk string, seq long, value string").parquet(str(tmp_path / "in"))
        send_until_quit(files).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        assert k < 3
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [("a", 1, "hi"), ("b", 1, "x"), ("b", 2, "y")]


def test_book(spark):
    orders = spark.createDataFrame([(0, 1, "Buy", 100, 5), (1, 2, "Buy", 101, 3), (2, 3, "Sell", 102, 4), (3, 4, "Buy", 100, 7)], "seq long, id long, side string, price long, quantity long")
    levels = book.depth(book.add_orders(orders, orders.where("seq = 2").withColumn("seq", F.lit(9).cast("long"))))
    assert [tuple(r) for r in book.display_order(levels).collect()] == [("Buy", 101, 3, 1), ("Buy", 100, 12, 2), ("Sell", 102, 8, 2)]
    assert rows(book.fifo(orders).where("price = 100").select("id", "place")) == [(1, 1), (4, 2)]
    assert [x["id"] for x in book.nested_levels(orders).where("price = 100").first()["orders"]] == [1, 4]


def test_stream_equals_batch(spark, tmp_path):
    orders = spark.createDataFrame([(i, i, "Buy" if i % 3 else "Sell", i % 5, i) for i in range(100)], "seq long, id long, side string, price long, quantity long")
    orders.write.parquet(str(tmp_path / "o"))
    query = depth_stream(spark.readStream.schema(orders.schema).parquet(str(tmp_path / "o")), str(tmp_path / "book"))
    query.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "book" / "levels"))) == rows(book.depth(orders))


def test_sources(spark):
    prices = spark.createDataFrame([("A", "2020-01-01", 1.0), ("A", "2020-01-02", 2.0), ("B", "2020-01-01", 3.0)], "symbol string, day string, close double").withColumn("day", F.to_date("day"))
    assert rows(load_history(prices, "2020-01-01", "2020-01-02", "day", "A").select("close")) == [(1.0,)]
    said = spark.createDataFrame([(1, "hi"), (2, "quit"), (3, "late")], "n long, value string")
    assert rows(until_quit(said, "n")) == [(1, "hi")]
