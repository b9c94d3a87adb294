import pytest
from pyspark.sql import functions as F

from loamline.functions import text


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "wanted"), [("HELLO", "hello"), ("HeLlO", "hello"), ("", ""), ("ABC123", "abc123"), ("ÄB1", "Äb1")])
def test_ascii_lower(spark, given, wanted):
    assert value(spark, text.ascii_lower(F.lit(given))) == wanted


def test_search_ignores_case_and_empty_keywords_find_nothing(spark):
    assert value(spark, text.contains_ignoring_case(F.lit("Buy MILK"), "milk"))
    assert not value(spark, text.contains_ignoring_case(F.lit("abc"), ""))


@pytest.mark.parametrize(("label", "wanted"), [("low", "Low"), ("High", "High"), ("HIGH", "Medium"), (None, "Medium"), ("x", "Medium")])
def test_priority_from_label(spark, label, wanted):
    assert value(spark, text.priority_from_label(F.lit(label))) == wanted


def test_priorities(spark):
    assert value(spark, text.priority_from_input(F.lit("hIGH"))) == "High"
    assert value(spark, text.priority_from_input(F.lit("urgent"))) is None
    assert [value(spark, text.priority_rank(F.lit(p))) for p in ("Low", "Medium", "High", "x")] == [1, 2, 3, None]
    assert value(spark, text.priority_label(F.lit(7))) == "Unknown"


@pytest.mark.parametrize(("given", "wanted"), [("12", 12), (" 7 ", 7), ("12abc", None), ("", None), ("11", None if False else 11), ("99", None)])
def test_integer_input(spark, given, wanted):
    assert value(spark, text.integer_input(F.lit(given), 1, 50)) == wanted


def test_verdicts(spark):
    verdict = lambda *x: value(spark, text.product_verdict(*map(F.lit, x)))
    assert [verdict("a", 1, 1.0), verdict("", -1, 1.0), verdict("a", -1, -1.0), verdict("a", 0, -0.5)] == ["ok", "empty name", "bad quantity", "bad price"]
    task = lambda *x, editing: value(spark, text.task_verdict(*map(F.lit, x), editing=editing))
    assert task("t", "", "x", editing=False) == "ok"
    assert [task("", "d", "low", editing=True), task("t", "", "low", editing=True), task("t", "d", "x", editing=True)] == ["empty title", "empty description", "bad priority"]
