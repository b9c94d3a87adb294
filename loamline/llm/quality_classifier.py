"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates
(McMahan and others, 2013) and scored as sparse dot products."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.llm.common import checkpoint, limited, mix, read_table, slices

#: Slots that n-grams are hashed to; one more holds the constant.
SLOTS = 1 << 18
#: Labelled rows that the model is fitted on, in expectation at most: those of smallest hash of id and text.
TRAINING_ROWS = 50_000
#: The rows are dealt to so many shards; a pass updates each shard's copy of the model row by row and takes their mean.
SHARDS, PASSES = 8, 3
#: Step size and its offset, and the penalties, of the updates.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 1.0
#: From this score on a document is predicted to be of good quality.
THRESHOLD = 0.3
#: Changes of a shard are whole numbers in this unit, so their sums are exact and reruns agree.
UNIT = 2.0**-30

#: Classes of bytes in a word's shape: capital, small letter, digit; other ASCII stays, bytes beyond it go.
_SHAPE = bytes(ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 else ord("0") if 48 <= c <= 57 else c for c in range(256))
_BEYOND = bytes(range(128, 256))
_RUN = re.compile(rb"(.)\1\1+", re.DOTALL)
#: The shape of a word equal to the one before it.
_AGAIN = np.uint64(0x632BE59BD9B4E019)
_STEP = np.uint64(0xD1342543DE82EF95)


def shape(word: bytes) -> bytes:
    """Its classes of bytes, runs cut to two: ``Word.`` is ``Aaa.``, ``ALL!!!`` is ``AA!!``."""
    return _RUN.sub(rb"\1\1", word.translate(_SHAPE, _BEYOND))


class Words(dict):
    """word -> its number among the words seen lately, from 1, with hashes of the word and of its shape; 0 is a text's border."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most, self.word, self.shape = most, np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)

    def __missing__(self, word: bytes) -> int:
        import xxhash

        n = len(self) + 1
        if n >= len(self.word):
            self.word, self.shape = (np.concatenate([x, np.zeros(len(x), np.uint64)]) for x in (self.word, self.shape))
        self.word[n], self.shape[n] = xxhash.xxh3_64_intdigest(word.lower()), xxhash.xxh3_64_intdigest(b"\0" + shape(word))
        self[word] = n
        return n

    def numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self) > self.most:
            self.clear()
        return [np.array([self[w] for w in (t or "").encode("utf-8", "surrogatepass").split()], np.int64) for t in texts]


def n_grams(texts: list[np.ndarray], words: Words) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Slots of the n-grams of some texts, by kind, each with which of them count; where each text begins; and how many it has.

    Kinds are words and pairs of words (A-Z lower-cased), and shapes, pairs and triples of shapes. Texts have a border
    at both ends, which n-grams of two and three hold as a word, so an empty text has the pair of borders.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    at = np.concatenate([x for t in texts for x in ([0], t)] + [[0, 0]]).astype(np.int64)
    n = len(at) - 2
    word, form = words.word[at], words.shape[at]
    form[1:][(at[1:] == at[:-1]) & (at[1:] > 0)] = _AGAIN
    pair = lambda x, y, k: mix(x * _STEP + y + np.uint64(k))
    forms = pair(form[:-1], form[1:], 2)
    some, inside = at[:n] > 0, at[1 : n + 1] > 0
    every = np.ones(n, bool)
    kinds = [(mix(word[:n]), some), (pair(word[:n], word[1 : n + 1], 1), every), (mix(form[:n]), some), (forms[:n], every), (pair(forms[:n], form[2:], 3), inside)]
    shift = np.uint64(64 - SLOTS.bit_length() + 1)
    begins = np.cumsum(sizes + 1) - sizes - 1
    return [((h >> shift).astype(np.int64), of) for h, of in kinds], begins, 5 * sizes + 2


def dots(weights: np.ndarray, texts: list[np.ndarray], words: Words) -> np.ndarray:
    """The dot product of each text: weights of its n-grams, each as often as it comes, over the root of their number."""
    if not texts:
        return np.zeros(0)
    kinds, begins, n = n_grams(texts, words)
    total = sum(np.where(of, weights[slot], 0.0) for slot, of in kinds)
    return np.add.reduceat(total, begins) / np.sqrt(n) + weights[SLOTS]


def probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


class Leader:
    """The state of the updates: z and n of each slot, from which its weight follows. The constant has no L1 penalty."""

    def __init__(self, z: np.ndarray, n: np.ndarray):
        self.z, self.n = z.copy(), n.copy()

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.arange(SLOTS + 1)[at] == SLOTS, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, x: np.ndarray, label: float) -> None:
        """One row: the slots that it has, each once, and their values."""
        w = self.weights(at)
        g = (float(probability(w @ x)) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _trained(held):
    """The changes of z and n that each shard's rows make, one row a slot. Rows come by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, words = held.value, Words()
        now, leader = None, None

        def changes() -> pa.RecordBatch:
            dz, dn = leader.z - start[0], leader.n - start[1]
            at = np.flatnonzero(dn)
            return pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(np.rint(d[at] / UNIT).astype(np.int64)) for d in (dz, dn)]], names=["slot", "dz", "dn"])

        for batch in slices(batches):
            shards, labels = batch.column("shard").to_pylist(), batch.column("quality").to_pylist()
            for shard, label, text in zip(shards, labels, words.numbers(batch.column("text").to_pylist()), strict=True):
                if shard != now:
                    if leader:
                        yield changes()
                    now, leader = shard, Leader(*start)
                kinds, _, n = n_grams([text], words)
                at, times = np.unique(np.concatenate([slot[of] for slot, of in kinds]), return_counts=True)
                leader.update(np.append(at, SLOTS), np.append(times / np.sqrt(n[0]), 1.0), float(label))
        if leader:
            yield changes()

    return run


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """(shard, key, text, quality): about ``rows`` labelled rows at most, outside the held-out fold, each (id, text) once."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("l_id")).agg(F.max("quality").alias("quality"))
    marks = limited(checkpoint(marks.where(~held_out(F.col("l_id")))), 2_000_000)  # id and label: 32 MB at most, else the join shuffles
    known = docs.select("doc_id", "text").join(marks, F.col("doc_id") == F.col("l_id"))
    share = min(1.0, rows / max(known.count(), 1))
    key = F.xxhash64("doc_id", "text", F.lit("row"))
    some = known.withColumn("key", key).where(F.shiftrightunsigned("key", 11) < F.lit(int(share * 2**53)).cast("long"))
    some = some.groupBy("key").agg(F.first("text").alias("text"), F.first("quality").alias("quality"))
    some = some.withColumn("shard", F.pmod("key", F.lit(SHARDS)).cast("int"))
    return some.repartition(SHARDS, "shard").sortWithinPartitions("shard", "key")


def train(rows: DataFrame, passes: int = PASSES) -> np.ndarray:
    """The weights after some passes over a checkpointed table (shard, text, quality) whose partitions hold whole shards.

    In a pass each shard starts from the common state; a slot's state moves by the mean of the changes of those shards
    that have it. What comes to the driver has a row a slot at most.
    """
    context = rows.sparkSession.sparkContext
    z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    for _ in range(passes):
        held = context.broadcast((z, n))
        moved = rows.mapInArrow(_trained(held), "slot long, dz long, dn long").groupBy("slot")
        moved = moved.agg(F.sum("dz").alias("dz"), F.sum("dn").alias("dn"), F.count(F.lit(1)).alias("shards")).toArrow()
        at, dz, dn, shards = (moved.column(c).to_numpy() for c in ("slot", "dz", "dn", "shards"))
        z[at] += dz * UNIT / shards
        n[at] += dn * UNIT / shards
        held.unpersist()
    return Leader(z, n).weights()


def _scored(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, words = held.value, Words()
        for batch in slices(batches):
            odds = dots(weights, words.numbers(batch.column("text").to_pylist()), words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(probability(odds), 6))], names=["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, training: int = TRAINING_ROWS, passes: int = PASSES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``.

    A text is its n-grams of words and of word shapes (capitals, small letters, digits, punctuation), hashed to ``SLOTS``
    slots; a slot's value is its number of n-grams over the root of the number of all. The weights are those of a logistic
    regression with per-slot step sizes and an L1 penalty, learned row by row from about ``training`` labelled rows
    at most, in ``SHARDS`` shards whatever the cluster, whose models are averaged after each pass. Only labelled rows
    outside the held-out fold (crc32 of the id as text, modulo 5, is 0) are learned from; labels, lang, source and doc_id
    aren't inputs of a score. Scoring is one scan; the weights that are broadcast have a fixed size.

    Empty and null texts are scored by the pair of borders that they consist of. Of several labels of an id the largest
    counts; null ids have no label and are held in or out as the empty text is. Equal rows are learned from once and
    scored alike. Without labelled rows all scores are 0.5. Other columns are ignored; ids may have any type.
    """
    rows = checkpoint(training_rows(docs, labels, training))
    held = docs.sparkSession.sparkContext.broadcast(train(rows, passes))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(_scored(held), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of ``score_quality`` over whole ``documents``, learned from ``labels``."""
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
