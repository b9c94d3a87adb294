"""Layouts by key: what a lookup reads and moves."""

from pyspark.sql import functions as F

from loamline.operators import tables
from loamline.sources.keyed import forget, save_bucketed, write_keyed


def read_by_scan(df):
    """Files and rows that the scan of a collected table has read."""
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    while "AdaptiveSparkPlan" in leaf.nodeName() or "QueryStage" in leaf.nodeName():
        leaf = leaf.executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


def test_a_lookup_reads_the_files_and_groups_of_its_key_only(spark, tmp_path):
    table = spark.range(0, 40_000, 2).select("id", F.concat(F.lit("t"), "id").alias("title"))
    write_keyed(table, str(tmp_path / "k"), files=8, keys_of_a_file=5000)
    kept = spark.read.parquet(str(tmp_path / "k"))
    some, none, outside = (tables.by_id(kept, k) for k in (20_000, 20_001, 99_999))
    assert [r["title"] for r in some.collect()] == ["t20000"]
    assert none.collect() == [] and outside.collect() == []
    assert 0 < read_by_scan(some) <= 5000  # one file of eight
    assert read_by_scan(none) == 0 and read_by_scan(outside) == 0  # a key that is in the range but in no row, and one out of range
    write_keyed(table.limit(0), str(tmp_path / "none"))
    assert tables.by_id(spark.read.parquet(str(tmp_path / "none")), 1).isEmpty()


def test_a_join_leaves_the_buckets_where_they_are(spark, tmp_path):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        table = save_bucketed(spark.range(1000).select("id", (F.col("id") * 2).alias("x")), "keyed_test", str(tmp_path / "b"), buckets=4)
        found = tables.lookup(table, spark.createDataFrame([(str(i),) for i in (5, 999, 1000)] + [("x",)], "asked string"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert len(moved) == 1 and "_asked" in moved[0]
        assert sorted((r["asked"], r["x"], r["outcome"]) for r in found.collect()) == [("1000", None, "Product ID not found."), ("5", 10, "found"), ("999", 1998, "found"), ("x", None, "Please enter a valid number.")]
    finally:
        forget(spark, "keyed_test")
        for k, v in before.items():
            spark.conf.set(k, v)
