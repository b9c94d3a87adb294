"""Totals kept under inserts, edits and deletes by signed rows, without counting the table again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamline.sources.snapshots import Store

#: Ids of a bucket; the highest id is looked for in the highest bucket that has any.
BUCKET = 1 << 16
#: Batches after which a log of changes is summed up into one.
MOST_PARTS = 16

VALUE = T.StructType([T.StructField("value", T.DecimalType(38, 2)), T.StructField("n", T.LongType())])
IDS = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("id", T.LongType()), T.StructField("n", T.LongType())])
LEVELS = T.StructType(
    [T.StructField("side", T.StringType()), T.StructField("price", T.LongType()), T.StructField("quantity", T.LongType()), T.StructField("n", T.LongType())]
)


def signed(gone: DataFrame | None, new: DataFrame | None) -> DataFrame:
    """Rows that leave with sign -1 and rows that come with 1; an edited row does both."""
    rows = [df.withColumn("sign", F.lit(sign).cast("long")) for df, sign in ((gone, -1), (new, 1)) if df is not None]
    return rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])


def value_changes(rows: DataFrame) -> DataFrame:
    """What signed products (quantity, price) change in the total value, exact to the cent, and in the number of rows."""
    value = F.col("sign") * F.col("quantity") * F.col("price").cast("decimal(18,2)")
    return _fit(rows.agg(F.coalesce(F.sum(value), F.lit(0)).alias("value"), F.coalesce(F.sum("sign"), F.lit(0)).alias("n")), VALUE)


def id_changes(rows: DataFrame) -> DataFrame:
    """By how much signed rows change the number of rows of each id that they name."""
    changed = rows.groupBy(F.floor(F.col("id") / BUCKET).alias("bucket"), "id").agg(F.sum("sign").alias("n"))
    return _fit(changed.where("n <> 0"), IDS)


def level_changes(rows: DataFrame) -> DataFrame:
    """By how much signed orders change the levels that they are of."""
    changed = rows.groupBy("side", "price").agg(F.sum(F.col("sign") * F.col("quantity")).alias("quantity"), F.sum("sign").alias("n"))
    return _fit(changed.where("quantity <> 0 or n <> 0"), LEVELS)


def _fit(rows: DataFrame, schema: T.StructType) -> DataFrame:
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def summed(changes: DataFrame) -> DataFrame:
    """One row for each key of a log of changes: its columns but for the numbers that change."""
    numbers = [c for c in ("value", "quantity", "n") if c in changes.columns]
    by = [c for c in changes.columns if c not in numbers]
    return _fit(changes.groupBy(*by).agg(*[F.sum(c).alias(c) for c in numbers]), changes.schema)


def total_value(changes: DataFrame) -> DataFrame:
    """(total_value, n_rows); the value of no rows is null."""
    kept = changes.agg(F.sum("value").alias("value"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    return kept.select(F.when(F.col("n_rows") > 0, F.col("value").cast("double")).alias("total_value"), "n_rows")


def highest_id(changes: DataFrame) -> DataFrame:
    """(max_id) of the ids that have rows left, null without any. A delete can lower it, so ids are counted, first by bucket:
    only the ids of the highest bucket with rows are added up one by one."""
    buckets = changes.groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 0").agg(F.max("bucket").alias("top"))
    top = changes.join(F.broadcast(buckets), F.col("bucket") == F.col("top"))  # one row
    return top.groupBy("id").agg(F.sum("n").alias("n")).where("n > 0").agg(F.max("id").alias("max_id"))


def levels(changes: DataFrame) -> DataFrame:
    """Depth (side, price, quantity, n_orders) of the levels that have orders left."""
    return summed(changes).where("n > 0").select("side", "price", "quantity", F.col("n").alias("n_orders"))


def merge_batch(store: Store, changes: DataFrame, batch: int, most_parts: int = MOST_PARTS) -> int:
    """Add the changes of a numbered batch to a log, once: a batch that is there already, or is older, changes nothing.

    Only the keys that the batch touched are written. After ``most_parts`` batches the log is summed up into one part, as a version of its
    own, and data that no version needs any more but the last two goes. The batch's number is in the version's commit,
    so it counts with its rows or not at all. Returns the newest version.
    """
    newest = store.commit_of()
    if newest.note.get("batch", -1) >= batch:
        return newest.version
    version = store.commit(changes, newest.version, append=True, note={"batch": batch})
    if len(newest.parts) + 1 >= most_parts:
        version = store.commit(summed(store.read(version)), version, note={"batch": batch})
        store.retain(2)
    return version
