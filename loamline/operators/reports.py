"""Projections, filters, sorts and totals over product, task and price tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions.text import contains_ignoring_case, priority_rank, status_mark
from loamline.plans.lineage import checkpoint

#: A product with less is low on stock.
LOW_STOCK = 10


def product_list(products: DataFrame) -> DataFrame:
    return products.select("id", "name", "quantity", "price")


def task_list(tasks: DataFrame) -> DataFrame:
    return tasks.select("id", status_mark(F.col("completed")).alias("mark"), "title", "description", "priority")


def task_short_list(tasks: DataFrame) -> DataFrame:
    return tasks.select("id", status_mark(F.col("completed")).alias("mark"), "title")


def inventory_value(products: DataFrame) -> DataFrame:
    """The sum of quantity times price; null, no value, for an empty table. Decimal inside, so it hangs on no order."""
    value = F.col("quantity") * F.col("price").cast("decimal(18,2)")
    return products.agg(F.sum(value).cast("double").alias("total_value"))


def low_stock(products: DataFrame, below: int = LOW_STOCK) -> DataFrame:
    """Names of products with a quantity strictly below; equal names stay."""
    return products.where(F.col("quantity") < below).select("name")


def tasks_by_status(tasks: DataFrame, completed: bool) -> DataFrame:
    return tasks.where(F.col("completed") == completed)


def tasks_by_priority(tasks: DataFrame, priority: str) -> DataFrame:
    return tasks.where(F.col("priority") == priority)


def search_titles(tasks: DataFrame, keyword: str, title: str = "title") -> DataFrame:
    """Rows whose title holds the keyword, A-Z in any case; none for an empty keyword."""
    return tasks.where(contains_ignoring_case(F.col(title), keyword))


def sort_by_id(tasks: DataFrame, *ties: str) -> DataFrame:
    """By id; the names of ties, such as list order, make the order total where ids repeat."""
    return tasks.orderBy("id", *ties)


def sort_by_priority(tasks: DataFrame, *ties: str) -> DataFrame:
    """High before Medium before Low, then by id. The label itself would sort High, Low, Medium."""
    return tasks.orderBy(priority_rank(F.col("priority")).desc(), "id", *ties)


def numbered(tasks: DataFrame, *order, name: str = "place") -> DataFrame:
    """Places in an order over the whole table, from 1.

    Rows are range-partitioned and sorted as by orderBy, and kept in a checkpoint, since borders drawn anew could
    differ; a place is the row's number in its partition plus the sizes of those before, one count a partition. So no
    task holds the table, as a window without partitions would.
    """
    rows = checkpoint(tasks.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    starts = sizes.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    placed = rows.withColumn("_part", part).join(F.broadcast(starts), "_part")  # one row a partition
    return placed.select(*tasks.columns, (F.col("_at") + F.col("_shift") + 1).alias(name))


def or_message(rows: DataFrame, message: str = "No matching tasks found.") -> DataFrame:
    """One row with the message if there are no rows, else none: the outcome of an empty result as data."""
    return rows.limit(1).agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(message).alias("message"))


def filter_message(table: DataFrame, rows: DataFrame) -> DataFrame:
    """What a filter of tasks says besides its rows: that the table is empty, that nothing matches, or nothing at all."""
    empty = or_message(table, "No tasks available.")
    unmatched = or_message(rows).join(F.broadcast(table.limit(1).select(F.lit(1).alias("_some")))).drop("_some")  # one row at most
    return empty.unionByName(unmatched)


def head(rows: DataFrame, *order: str, n: int = 5) -> DataFrame:
    """The first rows in an order, by partial top lists."""
    return rows.orderBy(*order).limit(n)
