"""Keyed tables as snapshots: every change takes a DataFrame and returns the next one.

A table's list order, where it has one, is an explicit ``seq`` column. Nothing here triggers a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions.text import integer_input, priority_from_input, priority_from_label, product_verdict, task_verdict

#: Rows of one insert at most.
BATCH_ROWS = 10


def next_id(table: DataFrame, key: str = "id", first_id: int = 1) -> DataFrame:
    """One row: the id after the highest, ``first_id`` for an empty table, and the number of rows."""
    after = F.greatest(F.coalesce(F.max(key), F.lit(first_id - 1)), F.lit(first_id - 1)) + 1
    return table.agg(after.alias("next_id"), F.count(F.lit(1)).alias("n_rows"))


def by_id(table: DataFrame, value, key: str = "id") -> DataFrame:
    """The rows of an id; the comparison reaches the scan."""
    return table.where(F.col(key) == value)


def first_by_id(table: DataFrame, value, key: str = "id", seq: str = "seq") -> DataFrame:
    """The first row, in list order, of an id that may come more than once."""
    return by_id(table, value, key).orderBy(seq).limit(1)


def lookup(table: DataFrame, asked: DataFrame, what: str = "Product", key: str = "id") -> DataFrame:
    """Each row of ``asked`` (a text column ``asked``) with the rows of its id and an outcome.

    Outcomes in order: the table is empty, the text is no whole number, no row has that id, found. Without a row the
    table's columns are null.
    """
    some = F.broadcast(table.limit(1).agg((F.count(F.lit(1)) > 0).alias("_some")))  # one row
    rows = table.withColumn("_id", F.col(key)).withColumn("_found", F.lit(True))
    joined = asked.select("asked").withColumn("_asked", integer_input(F.col("asked")).cast("long")).join(some).join(rows, F.col("_asked") == F.col("_id"), "left")
    outcome = F.when(~F.col("_some"), f"No {what.lower()}s available.").when(F.col("_asked").isNull(), "Please enter a valid number.")
    outcome = outcome.when(F.col("_found").isNull(), f"{what} ID not found.").otherwise("found")
    return joined.select("asked", *table.columns, outcome.alias("outcome"))


def latest_by_key(rows: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """Of each key the row of largest seq: a map's insert-or-replace over a log of changes.

    ``max_by`` combines on the map side, so a key with very many changes is no hot spot, unlike a window over the key.
    """
    others = [c for c in rows.columns if c != key]
    picked = F.max_by(F.struct(*others), F.col(seq)).alias("row")
    return rows.groupBy(key).agg(picked).select(*[F.col(key) if c == key else F.col(f"row.{c}") for c in rows.columns])


def upsert(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """The table with ``changes`` in place of the rows of their keys, or added. Changes of one key: pass them through
    ``latest_by_key`` first. Columns by name."""
    columns = table.columns
    base, new = table.withColumn("_seq", F.lit(0)), changes.select(*columns).withColumn("_seq", F.lit(1))
    return latest_by_key(base.unionByName(new), key, "_seq").select(*columns)


def check_batch(rows: DataFrame, limit: int = BATCH_ROWS) -> DataFrame:
    """Whether an insert has 1 to ``limit`` rows: (n_rows, accepted). Counts no further than one row over the limit."""
    return rows.limit(limit + 1).agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.col("n_rows").between(1, limit).alias("accepted"))


def insert(table: DataFrame, rows: DataFrame, verdict: Column, arrival: str, key: str = "id", first_id: int = 1) -> DataFrame:
    """The table with the rows whose verdict is ok, given the next ids in order of ``arrival``.

    An insert is a batch of 1 to ``BATCH_ROWS`` rows; a larger one is refused whole and changes nothing. So numbering a
    batch in one task is bounded.
    """
    accepted = F.broadcast(check_batch(rows).where("accepted").select("accepted"))  # one row, or none
    good = rows.limit(BATCH_ROWS + 1).where(verdict == "ok").join(accepted).drop("accepted")
    start = F.broadcast(next_id(table, key, first_id).select("next_id"))  # one row
    numbered = good.withColumn("_n", F.row_number().over(Window.orderBy(arrival)) - 1).join(start)
    numbered = numbered.withColumn(key, (F.col("next_id") + F.col("_n")).cast(table.schema[key].dataType))
    return table.unionByName(numbered.select(*table.columns))


def insert_products(table: DataFrame, rows: DataFrame, arrival: str = "arrival") -> DataFrame:
    verdict = product_verdict(F.col("name"), F.col("quantity"), F.col("price"))
    return insert(table, rows, verdict, arrival)


def insert_tasks(table: DataFrame, rows: DataFrame, arrival: str = "arrival") -> DataFrame:
    """New tasks are not completed; an empty description is allowed here, an unknown priority is Medium."""
    rows = rows.withColumn("priority", priority_from_label(F.col("priority"))).withColumn("completed", F.lit(False))
    verdict = task_verdict(F.col("title"), F.col("description"), F.col("priority"), editing=False)
    return insert(table, rows, verdict, arrival)


def delete(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """The table without the rows of the keys."""
    return table.join(keys.select(key).distinct(), key, "left_anti").select(*table.columns)


def delete_first(table: DataFrame, keys: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The table without the first row, in list order, of each of the keys; later rows of a key stay."""
    first = table.join(keys.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.min(seq).alias(seq))
    return table.join(first, [key, seq], "left_anti").select(*table.columns)


def edit_products(table: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (id, name, quantity, price) that pass all rules replace rows of their id; others change nothing."""
    good = edits.where(product_verdict(F.col("name"), F.col("quantity"), F.col("price")) == "ok")
    return upsert(table, good.join(table.select("id"), "id", "left_semi"))


def edit_tasks(table: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (id, title, description, priority) that pass all rules change their row, all three fields together."""
    good = edits.where(task_verdict(F.col("title"), F.col("description"), F.col("priority"), editing=True) == "ok")
    good = good.select("id", F.struct("title", "description", priority_from_input(F.col("priority")).alias("priority")).alias("_edit"))
    joined = table.join(good, "id", "left")
    changed = ["title", "description", "priority"]
    return joined.select(*[F.coalesce(F.col(f"_edit.{c}"), F.col(c)).alias(c) if c in changed else F.col(c) for c in table.columns])


def set_completed(table: DataFrame, chosen: Column, to: bool) -> DataFrame:
    """Complete (or reopen) the chosen tasks; ``outcome`` says untouched, already, or what was done."""
    done = "completed" if to else "reopened"
    outcome = F.when(~chosen, "untouched").when(F.col("completed") == to, "already").otherwise(done)
    return table.withColumn("outcome", outcome).withColumn("completed", F.when(chosen, F.lit(to)).otherwise(F.col("completed")))


def cleared(table: DataFrame) -> DataFrame:
    return table.where(F.lit(False))
