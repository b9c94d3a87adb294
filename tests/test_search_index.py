"""Substring search by grams: rows as the filter's, files without hits left unopened."""

import random

import pytest

from loamline.operators.reports import search_titles
from loamline.sources.search_index import blocks_with, search, write_searchable

TITLES = [
    None, "", "a", "ab", "aB", "abc", "xABCx", "Fix the LOGIN page", "fix\nthe lo\ngin", "login", "logi", "\U0001f600\U0001f601\U0001f602x", "\U0001f601", "Ärger Ä", "ärger ä",
    "aaaa", "aaa bbb", "100% (a+b) \\ [x]", "$1 ^.{2}$", "page\r\npage", "q" * 200 + "needle" + "q" * 200, "log  in",
]
KEYWORDS = ["", "a", "AB", "abc", "LoGiN", "login page", "log in", "\U0001f601", "\U0001f600\U0001f601\U0001f602", "Ä", "Ärg", "ärg", "aaa", "aaaa", "(a+b)", "\\", "^.{", "\n", "E\nPAGE", "qneedleq", "zzz", " "]


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.mark.parametrize("piece", [4, 1 << 16])
def test_search_finds_what_the_filter_finds(spark, tmp_path, piece):
    table = spark.createDataFrame(list(enumerate(TITLES * 2)), "id long, title string").repartition(3)
    path = str(tmp_path / "s")
    write_searchable(table, path, "title", blocks=4, piece=piece)
    for keyword in KEYWORDS:
        found = search(spark, path, "title", keyword)
        assert found.columns == ["id", "title"]
        wanted = [(i, t) for i, t in enumerate(TITLES * 2) if keyword and t is not None and low(keyword) in low(t)]
        assert sorted(map(tuple, found.collect())) == wanted, repr(keyword)
    assert sorted(search(spark, path, "title", "LoGiN").collect()) == sorted(search_titles(table, "LoGiN").collect())


def test_random_texts(spark, tmp_path):
    draw = random.Random(3)
    texts = ["".join(draw.choice("abAB é\U0001f600") for _ in range(draw.randrange(9))) for _ in range(300)]
    table = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    write_searchable(table, str(tmp_path / "s"), "t", blocks=12, gram=2, piece=3)
    for _ in range(12):
        keyword = "".join(draw.choice("abAB é\U0001f600") for _ in range(draw.randrange(1, 5)))
        wanted = {i for i, t in enumerate(texts) if low(keyword) in low(t)}
        assert {r["id"] for r in search(spark, str(tmp_path / "s"), "t", keyword, gram=2).collect()} == wanted


def test_files_without_hits_are_not_opened(spark, tmp_path):
    path = str(tmp_path / "s")
    texts = [(i, f"common text {'needle' if i == 777 else 'hay'} {i}") for i in range(1600)]
    write_searchable(spark.createDataFrame(texts, "id long, t string").repartitionByRange(16, "id"), path, "t")
    found = search(spark, path, "t", "NEEDLE")
    assert [r["id"] for r in found.collect()] == [777]
    assert files_read(found) == 1
    none = search(spark, path, "t", "nowhere")
    assert none.collect() == [] and files_read(none) == 0
    everywhere = search(spark, path, "t", "mon")
    assert len(everywhere.collect()) == 1600 and files_read(everywhere) == 16
    assert blocks_with(spark, path, "eed").count() == 1


def test_files_are_counted_below_a_long_path(spark, tmp_path):
    """``files_read`` knows the rows by the end of their path, which Spark cuts off beyond 100 characters of a scan's location by default."""
    path = str(tmp_path / ("long" * 30) / "s")
    texts = [(i, f"common text {'needle' if i == 777 else 'hay'} {i}") for i in range(1600)]
    write_searchable(spark.createDataFrame(texts, "id long, t string").repartitionByRange(16, "id"), path, "t")
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    try:
        for keyword, rows, files in (("NEEDLE", 1, 1), ("nowhere", 0, 0), ("mon", 1600, 16)):
            found = search(spark, path, "t", keyword)
            assert len(found.collect()) == rows and files_read(found) == files, keyword
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def files_read(df):
    """Files of the rows that a collected search has opened; none where the plan has dropped their scan."""

    def leaves(plan):
        if "AdaptiveSparkPlan" in plan.nodeName():
            return leaves(plan.executedPlan())
        if "QueryStage" in plan.nodeName():
            return leaves(plan.plan())
        found = plan.collectLeaves()
        found = [found.apply(i) for i in range(found.size())]
        return [x for leaf in found for x in ([leaf] if leaf.nodeName().startswith("Scan") else leaves(leaf) if "QueryStage" in leaf.nodeName() or "Adaptive" in leaf.nodeName() else [])]

    scans = [s for s in leaves(df._jdf.queryExecution().executedPlan()) if "/rows]" in s.simpleString(10_000)]
    return sum(s.metrics().apply("numFiles").value() for s in scans)


def test_an_empty_table(spark, tmp_path):
    write_searchable(spark.createDataFrame([], "id long, t string"), str(tmp_path / "s"), "t")
    assert search(spark, str(tmp_path / "s"), "t", "abc").collect() == []
