"""Running sums, products and last values by key, in blocks: a key of any number of rows is spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.plans.lineage import checkpoint

#: What a running value is: over rows in order, over a block in any order (``_at`` is the order), and of two neighbours.
KINDS = {
    "sum": (F.sum, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "product": (F.product, F.product, lambda a, b: F.coalesce(a, F.lit(1.0)) * F.coalesce(b, F.lit(1.0))),
    "last": (
        lambda c: F.last(c, ignorenulls=True),
        lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))),
        lambda earlier, later: F.coalesce(later, earlier),
    ),
}


def in_order(rows: DataFrame, *order: str | Column) -> DataFrame:
    """The rows sorted into ranges and kept so, with their place ``_at``, which rises through the table, and their range ``_part``.

    Ranges are borders in the whole order, so one key's rows may lie in several. They are checkpointed, since borders
    drawn anew could differ.
    """
    placed = checkpoint(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    return placed.withColumn("_part", F.shiftright("_at", 33))


def running(rows: DataFrame, by: list[str], values: dict[str, tuple[str, str]]) -> DataFrame:
    """``in_order`` rows, sorted by the columns ``by`` first, with a running value of the rows before each one of its key.

    values: new column -> (kind, column). Kinds: sum (0 before the first row), product (1), last (the last that isn't
    null, or null). Without ``by`` the whole table is one key. A range and key is a window of its own; what a key's earlier
    ranges come to is one row for each range that goes on with a key of the range before, at most one a range, and is
    broadcast; nothing else is sent out.
    """
    before = Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumns({f"_in_{out}": KINDS[kind][0](column).over(before) for out, (kind, column) in values.items()})
    totals = rows.groupBy("_part", *by).agg(*[KINDS[kind][1](column).alias(out) for out, (kind, column) in values.items()])
    earlier = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_k_{c}") for c in by], F.count(F.lit(1)).over(earlier).alias("_n"), *[KINDS[kind][0](out).over(earlier).alias(f"_out_{out}") for out, (kind, _) in values.items()])
    carried = F.broadcast(carried.where("_n > 0").drop("_n"))  # one row a range at most
    same = (F.col("_part") == F.col("_p")) & F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    joined = inner.join(carried, same, "left")
    return joined.select(*rows.columns, *[KINDS[kind][2](F.col(f"_out_{out}"), F.col(f"_in_{out}")).alias(out) for out, (kind, _) in values.items()])
