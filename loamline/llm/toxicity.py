"""Toxicity by class-conditional Kneser-Ney models of words, letter by letter, with shared backoff counts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamline.llm.common import ALNUM_TABLE, checkpoint, read_table, slices
from loamline.plans.lineage import remove, shared_folder

#: Telling beginnings of words that are broadcast at most, 48 bytes each; beyond, texts' words are joined to them by shuffle.
BROADCAST_NODES = 500_000
#: Parts of the training texts; each part's calibration rows are scored by models of the other parts.
PARTS = 4
#: A letter counts as evidence where the classes differ by this likelihood ratio statistic (chi-squared of 1 degree: 1 in
#: 1,000 by chance); else both classes take the shared backoff.
SIGNIFICANT = 10.83
#: The calibration is fitted on the labelled rows of at most so many ids, those of smallest hash.
CALIBRATION_ROWS = 20_000
#: From this score on a document is predicted toxic.
THRESHOLD = 0.7
#: Log ratios are whole numbers in this unit, so sums are exact.
UNIT = 1e-6
COUNTS = [f"n{c}_{k}" for c in range(2) for k in range(PARTS)]


def fold(doc_id: Column) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3).cast("int")


def words_of(text: str | None) -> set[bytes]:
    """The distinct words: a word counts once in a text, so one text's favourite words don't pass for its class's."""
    return set((text or "").encode("utf-8", "surrogatepass").translate(ALNUM_TABLE).split())


def path(word: bytes) -> list[int]:
    """64-bit hashes of the beginnings of a word, from none of it to its end."""
    import xxhash

    return [xxhash.xxh3_64_intdigest(word[:k]) - (1 << 63) for k in range(len(word) + 1)] + [xxhash.xxh3_64_intdigest(word + b" ") - (1 << 63)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct word of a slice of texts: in how many ordinary and toxic texts of each part it comes."""
    for batch in slices(batches):
        index: dict[bytes, int] = {}
        at = [np.array([index.setdefault(w, len(index)) for w in words_of(t)], np.int64) for t in batch.column("text").to_pylist()]
        cell = np.array([PARTS * t + k for t, k in zip(batch.column("toxic").to_pylist(), batch.column("model").to_pylist(), strict=True)], np.int64)
        cell = np.repeat(cell, [len(x) for x in at])
        counts = np.bincount(np.concatenate(at) * len(COUNTS) + cell, minlength=len(index) * len(COUNTS)).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays([pa.array(list(index), pa.binary()), *map(pa.array, counts.T)], names=["word", *COUNTS])


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The beginnings of the words of a batch, each with the beginning before it and the words' counts."""
    for batch in batches:
        paths = [path(w) for w in batch.column("word").to_pylist()]
        if not paths:
            continue
        sizes = np.array([len(p) - 1 for p in paths])
        node, parent = (np.concatenate([np.array(p[s], np.int64) for p in paths]) for s in (slice(1, None), slice(None, -1)))
        node, first, at = np.unique(node, return_index=True, return_inverse=True)
        word = np.repeat(np.arange(len(paths)), sizes)
        counts = [pa.array(np.bincount(at, weights=batch.column(c).to_numpy()[word]).astype(np.int64)) for c in COUNTS]
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(parent[first]), *counts], names=["node", "parent", *COUNTS])


def probability(n: np.ndarray, total: np.ndarray, kinds: np.ndarray, shared: np.ndarray, discount: float) -> np.ndarray:
    """Kneser and Ney's of letters after beginnings, in one class: the count less the discount, and what the discounts of
    all ``kinds`` of letters left, spread by the probability that both classes share. A class that never has the
    beginning takes the shared one alone."""
    own = (np.maximum(n - discount, 0) + discount * kinds * shared) / np.maximum(total, 1)
    return np.where(total > 0, own, shared)


def statistic(n: list[np.ndarray], totals: list[np.ndarray]) -> np.ndarray:
    """Twice the log likelihood ratio of a letter's shares of the two classes being different against being one."""
    share = (n[0] + n[1]) / np.maximum(totals[0] + totals[1], 1)
    term = lambda a, expected: np.where(a > 0, a * np.log(np.maximum(a, 1) / np.maximum(expected, 1e-300)), 0)
    return 2 * sum(term(a, t * share) + term(t - a, t * (1 - share)) for a, t in zip(n, totals, strict=True))


def discounts(counts: DataFrame) -> list[float]:
    """Kneser and Ney's n1 / (n1 + 2 n2) of either class, by the numbers of beginnings that come in one and in two texts
    (1 is added to each; 0.5 where there are none)."""
    n = [sum((F.col(f"n{c}_{k}") for k in range(PARTS)), F.lit(0)) for c in range(2)]
    once = counts.agg(*[F.count_if(x == i) for x in n for i in (1, 2)]).first()
    return [(a + 1) / (a + 1 + 2 * (b + 1)) if a + b else 0.5 for a, b in (once[:2], once[2:])]


def with_beginnings(counts: DataFrame) -> DataFrame:
    """Each letter's counts with those of the beginning that it follows (t), and the number of letters there (k); at most
    257 letters follow one, so a window of one beginning is small."""
    whole = [sum((F.col(f"n{c}_{k}") for k in range(PARTS)), F.lit(0)) for c in range(2)]
    rest = {f"k{c}_{k}": whole[c] - F.col(f"n{c}_{k}") for c in range(2) for k in range(PARTS)} | {f"k{c}": whole[c] for c in range(2)}
    family = Window.partitionBy("parent")
    return counts.select("*", *[F.sum(c).over(family).alias(f"t{c[1:]}") for c in COUNTS], *[F.count_if(x > 0).over(family).alias(k) for k, x in rest.items()])


EVIDENCE = [*(f"e_{k}" for k in range(PARTS)), "e"]


def _increments(d: list[float]):
    """node, e_0 ... and e: log P(letter | toxic) - log P(letter | ordinary) where the classes differ significantly, by the
    models without part 0 ... and by the models of all parts; in units of ``UNIT``, rows with a difference only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = {c: batch.column(c).to_numpy().astype(float) for c in batch.schema.names if c not in ("node", "parent")}
            found = []
            for out in [*range(PARTS), None]:
                n, totals = ([sum(of[f"{x}{c}_{k}"] for k in range(PARTS) if k != out) for c in range(2)] for x in "nt")
                kinds = [of[f"k{c}" if out is None else f"k{c}_{out}"] for c in range(2)]
                known = (n[0] + n[1] > 0) & (n[0] + n[1] < totals[0] + totals[1])
                shared = np.where(known, (n[0] + n[1]) / np.maximum(totals[0] + totals[1], 1), 1.0)
                p = [probability(n[c], totals[c], kinds[c], shared, d[c]) for c in range(2)]
                found.append(np.where(known & (statistic(n, totals) > SIGNIFICANT), np.rint((np.log(p[1]) - np.log(p[0])) / UNIT), 0).astype(np.int64))
            some = np.flatnonzero(np.any(found, axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (batch.column("node").to_numpy(), *found)], names=["node", *EVIDENCE])

    return run


def increments(families: DataFrame, d: list[float]) -> DataFrame:
    return families.mapInArrow(_increments(d), "node long, " + ", ".join(f"{c} long" for c in EVIDENCE))


def summary(ratios: np.ndarray) -> tuple[float, float, int]:
    """Mean and (lower) median of the words' log ratios, and their number."""
    n = len(ratios)
    return (ratios.sum() / n * UNIT, np.partition(ratios, (n - 1) // 2)[(n - 1) // 2] * UNIT, n) if n else (0.0, 0.0, 0)


def _summaries(held, most: int = 300_000):
    """held: sorted nodes, and for each the evidence by each model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, evidence = held.value
        known: dict[bytes, int] = {}
        ratios = np.zeros((0, PARTS + 1), np.int64)
        for batch in slices(batches):
            texts = [words_of(t) for t in batch.column("text").to_pylist()]
            if len(known) > most:
                known, ratios = {}, ratios[:0]
            new = list(set().union(*texts).difference(known)) if texts else []
            if new:
                paths = [path(w) for w in new]
                flat, of = np.array([x for p in paths for x in p], np.int64), np.repeat(np.arange(len(new)), [len(p) for p in paths])
                at = np.minimum(np.searchsorted(nodes, flat), max(len(nodes) - 1, 0))
                hit = np.flatnonzero(nodes[at] == flat) if len(nodes) else at[:0]
                found = np.zeros((len(new), PARTS + 1), np.int64)
                np.add.at(found, of[hit], evidence[at[hit]])
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                ratios = np.concatenate([ratios, found])
            rows = [summary(ratios[np.array([known[w] for w in t], np.int64), m]) for t, m in zip(texts, batch.column("model").to_pylist(), strict=True)]
            mean, median, n = zip(*rows, strict=True)
            own = [batch.column(c) for c in ("doc_id", "toxic")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(mean, pa.float64()), pa.array(median, pa.float64()), pa.array(n, pa.int64())], names=["doc_id", "toxic", "mean", "median", "n"])

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each beginning of each distinct word of a text; a text without words has one row without a word."""
    for batch in slices(batches, most_bytes=250_000):
        for i, t in enumerate(batch.column("text").to_pylist()):
            paths = [path(w) for w in words_of(t)] or [[None]]
            sizes = [len(p) for p in paths]
            word = np.repeat(np.arange(len(paths)), sizes)
            same = [batch.column(c).take(pa.array(np.full(len(word), i))) for c in ("uid", "doc_id", "toxic", "model")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(word, pa.int64()), pa.array([x for p in paths for x in p], pa.int64())], names=["uid", "doc_id", "toxic", "model", "word", "node"])


def summaries(texts: DataFrame, telling: DataFrame, broadcast_nodes: int) -> DataFrame:
    """doc_id, toxic, mean, median, n of each row of (doc_id, text, toxic, model); model: the part left out, or ``PARTS``."""
    if telling.count() <= broadcast_nodes:
        table = telling.toArrow()  # broadcast_nodes rows at most
        nodes = table.column("node").to_numpy()
        evidence = np.stack([table.column(c).to_numpy() for c in table.column_names[1:]], axis=1) if len(nodes) else np.zeros((0, PARTS + 1), np.int64)
        order = np.argsort(nodes)
        held = texts.sparkSession.sparkContext.broadcast((nodes[order], evidence[order]))
        return texts.mapInArrow(_summaries(held), "doc_id long, toxic int, mean double, median double, n long")
    rows = texts.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(_listed, "uid long, doc_id long, toxic int, model int, word long, node long")
    one = F.get(F.array(*[F.col(c) for c in telling.columns[1:]]), F.col("model"))
    words = rows.join(telling, "node", "left").groupBy("uid", "doc_id", "toxic", "word").agg(F.coalesce(F.sum(one), F.lit(0)).alias("ratio"), F.count("node").alias("some"))
    by_text = words.groupBy("uid", "doc_id", "toxic").agg(F.array_sort(F.collect_list(F.when(F.col("some") > 0, F.col("ratio")))).alias("r"))
    total = F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + x)
    n = F.size("r")
    return by_text.select(
        "doc_id", "toxic", F.when(n > 0, total / n * UNIT).otherwise(0.0).alias("mean"),
        F.coalesce(F.get("r", F.floor((n - 1) / 2).cast("int")) * F.lit(UNIT), F.lit(0.0)).alias("median"), n.cast("long").alias("n"),
    )


def features(mean, median, n, log, greatest) -> list:
    """What the calibration weighs: the logarithms of the mean less the median, and of the number of words, with their
    squares and product, and the median. A median text's words all differ alike by class if the class prefers its
    language, so that is taken off."""
    excess, size = log(greatest(mean - median, 0.0) + 0.01), log(greatest(n, 1))
    return [excess, excess * excess, excess * size, size, size * size, median]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Newton steps for a penalised logistic regression; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(x) * np.eye(len(w)) * 0.01 + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * 0.01 * len(x) * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(
    docs: DataFrame, labels: DataFrame, calibration_rows: int = CALIBRATION_ROWS, threshold: float = THRESHOLD, broadcast_nodes: int = BROADCAST_NODES
) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``.

    Each class has a Kneser-Ney model of words: the probability of a letter after the beginning of a word, by the class's
    counts less an absolute discount, backing off to counts that both classes share; so a rare word tells as much as
    its beginnings do. A count is a number of texts' distinct words. A text's log likelihoods by both models are
    compared by its words' mean difference, length-normalised so, and their median, which holds what a class's share of a
    language makes differ in every word. A logistic calibration turns these into a probability.

    Only labelled rows outside the held-out fold (crc32 of the id as text, modulo 3, is 1) are learned from. All of them
    are counted. Those of the ``calibration_rows`` ids of smallest hash fit the calibration, scored by models of the
    other three of four parts of the training texts. Beginnings that tell the classes apart are broadcast if they are
    few enough; else the texts' words are shuffled to them. Only words are read; labels, lang, source and doc_id
    aren't inputs of a score.

    Empty and null texts have no words and ratio 0, a null id is held in. An id with several labels counts as toxic if
    any is; of the rows of one id the calibration takes the one of largest mean. With no labels, or of one class only, the score is the share of
    toxic labels. Repeated rows are scored alike; other columns are ignored.
    """
    spark = docs.sparkSession
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("l_id")).agg((F.max("toxic") == 1).cast("int").alias("toxic"))
    marks = checkpoint(marks.where(fold(F.col("l_id")) != 1).withColumn("model", F.pmod(F.xxhash64("l_id", F.lit("part")), F.lit(PARTS)).cast("int")))
    few = marks.count() <= 2_000_000  # id, label, part: 32 MB at most are broadcast, else the join shuffles
    known = docs.select("doc_id", "text").join(F.broadcast(marks) if few else marks, F.col("doc_id") == F.col("l_id"))

    sums = [F.sum(c).alias(c) for c in COUNTS]
    kinds = ", ".join(f"{c} long" for c in COUNTS)
    words = known.select("text", "toxic", "model").mapInArrow(_count, f"word binary, {kinds}").groupBy("word").agg(*sums)
    counts = words.mapInArrow(_nodes, f"node long, parent long, {kinds}").groupBy("node").agg(F.min("parent").alias("parent"), *sums)
    folder = f"{shared_folder(spark)}/letters-{uuid.uuid4().hex}"
    counts.write.parquet(folder)  # columns of small numbers, which a checkpoint would keep as eight bytes each
    counts = spark.read.parquet(folder)
    telling = checkpoint(increments(with_beginnings(counts), discounts(counts)))
    remove(spark, folder)

    some = marks.orderBy(F.xxhash64("l_id"), "l_id").limit(calibration_rows)
    fitted = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "toxic", "model")
    fitted = summaries(fitted, telling, broadcast_nodes).groupBy("doc_id", "toxic").agg(F.max(F.struct("mean", "median", "n")).alias("s"))
    fitted = fitted.select("toxic", "s.*").toArrow()  # a row an id
    y = fitted.column("toxic").to_numpy().astype(float)
    rows = summaries(docs.select("doc_id", "text", F.lit(None).cast("int").alias("toxic"), F.lit(PARTS).alias("model")), telling, broadcast_nodes)
    if len(y) and 0 < y.mean() < 1:
        columns = [fitted.column(c).to_numpy() for c in ("mean", "median", "n")]
        weights = fit_logistic(np.column_stack(features(*columns, np.log, np.maximum)), y)
        most = lambda a, b: F.greatest(a, F.lit(b))
        columns = features(F.col("mean"), F.col("median"), F.col("n"), F.log, most)
        odds = sum((F.lit(float(w)) * c for w, c in zip(weights[:-1], columns, strict=True)), F.lit(float(weights[-1])))
        score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds))))
    else:
        score = F.lit(float(y.mean()) if len(y) else 0.0)
    rows = rows.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), F.round(score, 6).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of ``score_toxicity`` over whole ``documents``, learned from ``labels``."""
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
