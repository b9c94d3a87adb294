"""Order book over a table of orders (seq, id, side, price, quantity): append, depth by level, places in a level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.operators.reports import numbered


def add_orders(orders: DataFrame, new: DataFrame) -> DataFrame:
    return orders.unionByName(new)


def depth(orders: DataFrame) -> DataFrame:
    """Quantity and number of orders of each side and price: partial sums, one shuffle of levels."""
    return orders.groupBy("side", "price").agg(F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("n_orders"))


def display_order(levels: DataFrame) -> DataFrame:
    """Bids from the highest price, then asks from the lowest."""
    bid = F.col("side") == "Buy"
    return levels.orderBy(F.when(bid, 0).otherwise(1), F.when(bid, -F.col("price")).otherwise(F.col("price")))


def bids(levels: DataFrame) -> DataFrame:
    return levels.where("side = 'Buy'").orderBy(F.desc("price"))


def asks(levels: DataFrame) -> DataFrame:
    return levels.where("side = 'Sell'").orderBy("price")


def sides(levels: DataFrame) -> DataFrame:
    """All levels with their place on their side: bids from the highest price, asks from the lowest."""
    bid = F.col("side") == "Buy"
    return _places(levels, F.when(bid, -F.col("price")).otherwise(F.col("price")), by=["side"])


def _places(rows: DataFrame, *order, by: list[str]) -> DataFrame:
    """Places from 1 inside groups, by places in the whole table less the group's first: a group of any size is spread
    over tasks, and its first place comes from partial minimums."""
    placed = numbered(rows, *by, *order, name="_all")
    first = placed.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min("_all").alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return placed.join(first, same).select(*rows.columns, (F.col("_all") - F.col("_first") + 1).alias("place"))


def fifo(orders: DataFrame, *arrival: str) -> DataFrame:
    """The place of each order in its level, first come first."""
    return _places(orders, *(arrival or ("seq",)), by=["side", "price"])


def nested_levels(orders: DataFrame) -> DataFrame:
    """Each level with its orders in order of arrival, as an array; for levels that fit a row."""
    queue = F.array_sort(F.collect_list(F.struct("seq", "id", "quantity")))
    return orders.groupBy("side", "price").agg(queue.alias("orders"))
