"""One JSON array of objects, read by many tasks and written by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamline.operators.reports import numbered
from loamline.plans.lineage import checkpoint

#: Spaces of an object, and of its fields, in a written array.
INDENT = 4


def _quotes(text: Column) -> Column:
    """How many quotes begin or end a string in valid JSON: those behind no backslash, or behind an escaped one."""
    plain = F.regexp_replace(text, r"\\.", "")
    return F.char_length(plain) - F.char_length(F.translate(plain, '"', ""))


def _nesting(text: Column, inside: bool) -> Column:
    """Opened less closed braces outside of strings, if the text begins outside or inside of one."""
    plain = F.regexp_replace(text, r"(?s)\\.", "")
    if inside:
        plain = F.regexp_replace(plain, '(?s)^[^"]*("|$)', "")
    plain = F.regexp_replace(plain, '(?s)"[^"]*("|$)', "")
    count = lambda c: F.char_length(plain) - F.char_length(F.translate(plain, c, ""))
    return count("{") - count("}")


def array_objects(spark: SparkSession, path: str) -> DataFrame:
    """(seq, value): the objects of a JSON array as texts, with their places from 0; path is a file, or a folder of files
    that one after the other, by name, are one array.

    The text is read in pieces that end at a ``}``, so the scan splits a file by size wherever it is. What a piece does
    follows from two numbers, its quotes and its nesting, the latter once for either case of beginning outside or inside a
    string. A split sums them up for both cases; the cases that hold come from running sums over the splits, one row each; a piece that
    ends outside of strings at depth 0 ends an object. So only the scan sees the file in order, and objects are put
    together by their places in parallel. Text of an element before its first brace, as of a number or null, is dropped;
    a last object that isn't closed is none. Objects must fit a row, as in any reader.
    """
    meta = F.col("_metadata")
    source = spark.read.option("lineSep", "}").text(path)
    pieces = checkpoint(source.select("value", meta.file_path.alias("file"), meta.file_block_start.alias("start"), meta.file_size.alias("size"), F.monotonically_increasing_id().alias("row")))
    files = pieces.groupBy(F.col("file").alias("l_file")).agg(F.max(F.struct("start", "row")).alias("l_last"), (F.sum(F.octet_length("value") + 1) - F.max("size")).alias("l_over"))
    files = F.broadcast(files.where(~F.col("l_over").isin(0, -3)))  # files that don't end at a brace, one row each; three bytes may mark the encoding
    pieces = pieces.join(files, (F.col("file") == F.col("l_file")) & (F.struct("start", "row") == F.col("l_last")), "left")
    pieces = pieces.select("file", "start", "row", F.when(F.col("l_file").isNull(), F.concat("value", F.lit("}"))).otherwise(F.col("value")).alias("text"))
    split = ["file", "start"]
    so_far = Window.partitionBy(*split).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    rows = pieces.withColumns({"q": _quotes(F.col("text")), "outside": _nesting(F.col("text"), False), "inside": _nesting(F.col("text"), True)})
    rows = rows.withColumn("quotes", F.sum("q").over(so_far))
    begins_inside = (F.col("quotes") - F.col("q")) % 2 == 1  # if the split began outside
    rows = rows.withColumns({"d0": F.when(begins_inside, F.col("inside")).otherwise(F.col("outside")), "d1": F.when(begins_inside, F.col("outside")).otherwise(F.col("inside"))})
    rows = rows.withColumns({"depth0": F.sum("d0").over(so_far), "depth1": F.sum("d1").over(so_far)})

    earlier = Window.partitionBy(F.lit(0)).orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)  # over splits, one row each
    sums = rows.groupBy(*split).agg(F.sum("q").alias("q"), F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
    sums = sums.withColumn("in_string", F.coalesce(F.sum("q").over(earlier), F.lit(0)) % 2)
    sums = sums.withColumn("depth", F.coalesce(F.sum(F.when(F.col("in_string") == 1, F.col("d1")).otherwise(F.col("d0"))).over(earlier), F.lit(0)))
    begin = F.broadcast(checkpoint(sums.select(F.col("file").alias("b_file"), F.col("start").alias("b_start"), "in_string", "depth")))  # one row a split
    rows = rows.join(begin, (F.col("file") == F.col("b_file")) & (F.col("start") == F.col("b_start")))
    outside = (F.col("in_string") + F.col("quotes")) % 2 == 0
    depth = F.col("depth") + F.when(F.col("in_string") == 1, F.col("depth1")).otherwise(F.col("depth0"))
    rows = rows.select("file", "start", "row", "text", (outside & (depth == 0) & F.endswith("text", F.lit("}"))).cast("int").alias("ends"))

    ended = rows.groupBy(*split).agg(F.sum("ends").alias("n"))
    ended = ended.select(F.col("file").alias("e_file"), F.col("start").alias("e_start"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ended"))
    rows = rows.join(F.broadcast(checkpoint(ended)), (F.col("file") == F.col("e_file")) & (F.col("start") == F.col("e_start")))  # one row a split
    place = F.col("ended") + F.sum("ends").over(so_far) - F.col("ends")
    rows = rows.select(place.alias("seq"), "ends", F.struct("file", "start", "row", "text").alias("piece"))
    whole = rows.groupBy("seq").agg(F.sum("ends").alias("ends"), F.array_sort(F.collect_list("piece")).alias("pieces")).where("ends > 0")
    joined = F.array_join(F.transform("pieces", lambda p: p["text"]), "")
    return whole.select(F.col("seq").cast("long").alias("seq"), F.substr(joined, F.instr(joined, F.lit("{"))).alias("value"))


def read_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a JSON array with ``seq``, their place in it. Missing keys and wrong types are null."""
    return array_objects(spark, path).select(F.from_json("value", schema).alias("r"), "seq").select("r.*", "seq")


def _object(table: DataFrame) -> Column:
    """A row as an object, one field a line; nulls are written."""
    field = lambda c: F.concat(F.lit(f"{' ' * 2 * INDENT}{_name(c)}: "), F.regexp_extract(F.to_json(F.struct(F.col(f"`{c}`").alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', 1))
    fields = [x for c in table.columns for x in (F.lit(",\n"), field(c))][1:]
    return F.concat(F.lit(" " * INDENT + "{\n"), *fields, F.lit("\n" + " " * INDENT + "}"))


def _name(column: str) -> str:
    import json

    return json.dumps(column, ensure_ascii=False)


def array_lines(table: DataFrame, *order: str) -> DataFrame:
    """(value): the table as a pretty JSON array in an order, an object a row; the first row opens the array, the last closes it.

    Rows are sorted into ranges, as many as tasks, and stay in them, so files written from it in their order are one
    array, whatever its size; an empty table is ``[]``. All columns are written.
    """
    rows = numbered(table.select(_object(table).alias("value"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]), *[f"_o{i}" for i in range(len(order))], name="_n")
    last = F.broadcast(table.agg(F.count(F.lit(1)).alias("_last")))  # one row
    rows = rows.join(last).select("_n", F.concat(F.when(F.col("_n") == 1, "[\n").otherwise(""), "value", F.when(F.col("_n") == F.col("_last"), "\n]").otherwise(",")).alias("value"))
    empty = last.where("_last = 0").select(F.lit("[]").alias("value"))
    return rows.select("value").unionByName(empty)


def write_array(table: DataFrame, path: str, *order: str) -> None:
    """Replace a folder by text files that, one after the other by name, are one JSON array of the rows in their order.

    Each file is written by its own task; the folder has its ``_SUCCESS`` once all are there. ``read_array`` reads it, as
    does any JSON reader that gets the files one after the other.
    """
    array_lines(table, *order).write.mode("overwrite").text(path)
