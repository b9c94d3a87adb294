"""JSON arrays read and written in parts, against Spark's reader of whole files and Python's."""

import json
import random

import pytest

from loamline.sources import json_arrays as ja
from loamline.sources import json_tables

SCHEMA = "id long, name string, nested struct<a: string, b: array<string>>, x double"
MARKS = ["{", "}", '"', "\\", "[", "]", ",", " ", "\n", "é", "a", "}{", '"}', '\\"', "\\\\"]


def items(n, seed=0):
    rng = random.Random(seed)
    text = lambda most: "".join(rng.choice(MARKS) for _ in range(rng.randint(0, most)))
    return [{"id": i, "name": text(40), "nested": {"a": text(5), "b": ["}", "{\\"]}, "x": i / 3} for i in range(n)]


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "5000", "spark.sql.files.openCostInBytes": "1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def schema_of(spark):
    return spark.createDataFrame([], SCHEMA).schema


@pytest.mark.parametrize("text", [json.dumps(items(400)), json.dumps(items(200, 1), indent=4), json.dumps(items(150, 2), ensure_ascii=False, separators=(",", ":")), "[]", "", " [ ]\n", json.dumps(items(1)), ' {"id":5} ', '{"id":5}'])
def test_one_array_over_many_tasks_equals_the_whole_reader(spark, tmp_path, small_splits, text):
    path = tmp_path / "a.json"
    path.write_text(text, newline="")
    found = ja.read_array(spark, str(path), schema_of(spark)).orderBy("seq").collect()
    wanted = spark.read.schema(SCHEMA).option("multiLine", True).json(str(path)).collect()
    assert [tuple(r)[:-1] for r in found] == [tuple(r) for r in wanted]
    assert [r["seq"] for r in found] == list(range(len(wanted)))
    if len(text) > 20_000:
        assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 3


def test_an_object_that_is_not_closed_is_none(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('[1, null, {"id":1},{"id":2')
    assert [r["id"] for r in ja.read_array(spark, str(path), schema_of(spark)).collect()] == [1]


def test_parts_together_are_one_array_in_order(spark, tmp_path, small_splits):
    rows = [(r["id"], r["name"], None if r["id"] % 3 else r["x"]) for r in items(2000, 3)]
    table = spark.createDataFrame(rows, "id long, name string, x double").repartition(7)
    ja.write_array(table, str(tmp_path / "w"), "id")
    files = sorted((tmp_path / "w").glob("part-*"))
    text = "".join(f.read_bytes().decode() for f in files)
    assert len(files) > 2 and text.startswith('[\n    {\n        "id": 0,\n        "name": ')
    assert [tuple(x.values()) for x in json.loads(text)] == rows
    assert ja.read_array(spark, str(tmp_path / "w"), table.schema).orderBy("seq").drop("seq").collect() == table.orderBy("id").collect()
    ja.write_array(table.limit(0), str(tmp_path / "none"), "id")
    assert json.loads("".join(f.read_text() for f in sorted((tmp_path / "none").glob("part-*")))) == []
    assert ja.read_array(spark, str(tmp_path / "none"), table.schema).isEmpty()


def test_tables_load_from_an_array_in_its_order(spark, tmp_path, small_splits):
    path = tmp_path / "t.json"
    path.write_text(json.dumps([{"id": i % 900, "title": f"t{i} }}", "description": "", "priority": "low", "completed": False} for i in range(1000)]))
    loaded = json_tables.load_tasks(spark, str(path)).orderBy("seq").collect()
    assert [r["title"] for r in loaded] == [f"t{i} }}" for i in range(1000)]
    path.write_text(json.dumps([{"id": i % 300, "name": f"n{i}", "quantity": i, "price": 1.0} for i in range(1000)]))
    assert {r["id"]: r["quantity"] for r in json_tables.load_products(spark, str(path)).collect()} == {i % 300: i for i in range(1000)}
