"""Mixing sources to target weights by pivotal dependent rounding in a reduction tree."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamline.llm.common import checkpoint, count_space_words, read_table

#: Weights of the sources in order, repeated; share of all sizes that the mix takes; most copies of a source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Documents in a leaf of the tree, and residuals in an inner node.
FAN_IN = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, times: Column | None = None) -> DataFrame:
    """(source, source_size, n_docs, target) of a table (source, size), each row of which stands for ``times`` documents or one.

    Sources by code point, null last, weigh ``weights``, repeating. Together they get ``share`` of all sizes; a target
    stops at ``most`` times its source's size and the excess goes to the others by weight until none is above: target =
    min(most * size, level * weight), and the level follows from sorting the sources by the level at which they stop.
    The windows run over the table of sources, one row each, not over documents.
    """
    times = F.lit(1) if times is None else times
    by_source = sizes.groupBy("source").agg(F.sum(F.col("size") * times).alias("source_size"), F.sum(times).alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    table = by_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * share
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)  # if all earlier ones stop and no later one
    table = table.withColumn("level", level).withColumn("stops", F.col("level") * F.col("weight") > F.col("cap"))
    level = F.min(F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), "level"))).over(every)
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(F.least(level["level"] * F.col("weight"), F.col("cap").cast("double")))
    return table.select("source", "source_size", "n_docs", target.alias("target"))


def pivot(size: np.ndarray, share: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Round the copy probabilities ``share`` of one group; returns them and the index of the one left over, or -1.

    Of two fractional documents one gives words and the other takes them, size times probability in sum unchanged,
    until one of the two is 0 or 1. The direction is drawn so that each probability keeps its mean.
    """
    out, left = share.copy(), -1
    for i in np.flatnonzero((share > 0) & (share < 1)):
        if left < 0:
            left = i
            continue
        a, b = left, i
        up = min((1 - out[a]) * size[a], out[b] * size[b])  # words that a may take from b
        down = min(out[a] * size[a], (1 - out[b]) * size[b])
        takes = draw[i] * (up + down) < down
        moved = up if takes else -down
        pa, pb = out[a] + moved / size[a], out[b] - moved / size[b]
        if takes:
            full_a, full_b = (1 - out[a]) * size[a] <= out[b] * size[b], out[b] * size[b] <= (1 - out[a]) * size[a]
            out[a], out[b] = 1.0 if full_a else pa, 0.0 if full_b else pb
        else:
            full_a, full_b = out[a] * size[a] <= (1 - out[b]) * size[b], (1 - out[b]) * size[b] <= out[a] * size[a]
            out[a], out[b] = 0.0 if full_a else pa, 1.0 if full_b else pb
        left = a if 0 < out[a] < 1 else b if 0 < out[b] < 1 else -1
    return out, left


def _round_group(last: bool):
    def of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["draw", "row"], kind="stable", ignore_index=True)
        size, share = rows["size"].to_numpy(np.float64), rows["share"].to_numpy(np.float64)
        draw = (rows["draw"].to_numpy(np.int64).view(np.uint64) >> np.uint64(11)).astype(np.float64) / 2.0**53
        share, left = pivot(size, share, draw)
        if last and left >= 0:
            share[left], left = float(draw[left] < share[left]), -1
        rows["share"], rows["open"] = share, np.arange(len(rows)) == left
        return rows

    return of


def dealt(rows: DataFrame, rates: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """The documents of rows (doc_id, source, size, row, times) with their probability, draw and leaf (``node``).

    A row that stands for many equal documents becomes blocks of up to ``fan_in`` of them, which are spread over tasks,
    and then the documents, each with its place among the equal ones; the place goes into the hashes for leaf and draw. So
    equal documents are spread over the leaves as others are.
    """
    blocks = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / fan_in)))).repartition("row", "block")
    end = F.least(F.col("times"), (F.col("block") + 1) * fan_in) - 1
    placed = blocks.withColumn("place", F.explode(F.sequence(F.col("block") * fan_in, end)))
    placed = placed.join(rates, F.col("source").eqNullSafe(F.col("t_source")), "left")
    whole, leaves = F.floor("rate").cast("int"), F.ceil(F.col("n_docs") / fan_in).cast("long")
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", "row", whole.alias("whole"),
        F.when(F.col("size") > 0, F.col("rate") - whole).otherwise(0.0).alias("share"),
        F.xxhash64("row", "place", F.lit("draw")).alias("draw"),
        F.pmod(F.xxhash64("row", "place", F.lit("leaf")), F.greatest(leaves, F.lit(1))).alias("node"), F.lit(False).alias("open"),
    )


def mix(docs: DataFrame, size: Column, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, fan_in: int = FAN_IN) -> DataFrame:
    """Copies of each document for a mix: doc_id, source, size, source_size, target, copies, taken, row.

    A source's documents share the expected number of copies target / source_size. Its whole part is given to each;
    the fractions are rounded by pivotal pairing: in leaves of about ``fan_in`` documents of one source, whatever the
    source's size, then the one document that each leaf leaves over in nodes of up to ``fan_in`` leaves, up to one node
    a source. So a source's words differ from its target by less than its largest document, and a document has at most
    one copy more than the whole part. Leaves and draws hang on hashes of the rows and, of equal rows, their number, so
    reruns agree and no leaf gets all equal rows.

    Null texts have size 0; documents of size 0 are taken 0 times. A null source is a source. Repeated rows are
    documents of their own; equal ones are interchangeable. Empty input gives no rows. Other columns are ignored.
    """
    text = docs["text"]
    rows = docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", text).alias("row"))
    rows = checkpoint(rows.groupBy("doc_id", "source", "size", "row").agg(F.count(F.lit(1)).alias("times")))
    targets = checkpoint(source_targets(rows, weights, share, most, F.col("times")))
    rates = targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rows = dealt(rows, rates.select(F.col("source").alias("t_source"), "source_size", "target", "n_docs", "rate"), fan_in)
    most_docs = targets.agg(F.max("n_docs")).first()[0] or 0  # one number
    width, done = max(1, -(-most_docs // fan_in)), []
    while True:
        last = width == 1
        rows = checkpoint(rows.groupBy("source", "node").applyInPandas(_round_group(last), rows.schema))
        done.append(rows.where(~F.col("open")))
        if last:
            break
        width = -(-width // fan_in)
        rows = rows.where("open").withColumn("node", F.floor(F.col("node") / fan_in)).withColumn("draw", F.xxhash64("draw"))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.round("share").cast("int")).otherwise(0)
    made = reduce(DataFrame.unionByName, done).withColumn("copies", copies)
    return made.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "row"
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with all their columns and source_size, target, copies and taken.

    Rows that share doc_id and text are one document here, with the copies of all of them.
    """
    made = mix(docs, count_space_words(F.col("text")), **options).groupBy(F.col("row").alias("m_row"))
    made = made.agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("copies").cast("int").alias("copies"), F.sum("taken").alias("taken"))
    once = docs.withColumn("m_row", F.xxhash64("doc_id", "text")).dropDuplicates(["m_row"])
    new = ["source_size", "target", "copies", "taken"]
    return once.join(made.where("copies > 0"), "m_row").select(*[once[c] for c in docs.columns if c not in new], *[made[c] for c in new])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of ``mix`` over whole ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    return mix(docs, count_space_words(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")
