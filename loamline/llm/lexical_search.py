"""Ranked lexical search: windows of doc_ids, postings added up in arrays that fit a cache, the best kept in heaps."""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamline.llm.common import ALNUM_TABLE, checkpoint, read_table, slices
from loamline.plans.lineage import remove, shared_folder

#: Results of a query.
TOP = 10
#: doc_ids of a window: its scores take 256 KB.
WINDOW = 1 << 15
#: Distinct terms that the queries of one round over the documents have at most, unless one query alone has more.
TERMS = 100_000
#: Bytes of postings to a task.
TASK_BYTES = 64_000_000


def terms(text: str | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII; A-Z lower-cased. A null text has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(ALNUM_TABLE).split()


def _postings(index: dict[bytes, int]):
    """Of each text with a term: its number of terms, and how often it has each of the terms asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in slices(batches):
            found = [terms(t) for t in batch.column("text").to_pylist()]
            n = np.array([len(x) for x in found], np.int64)
            at = np.array([known.get(w, -1) for x in found for w in x], np.int64)
            text = np.repeat(np.arange(len(n)), n)[at >= 0]
            pair, tf = np.unique(text * max(len(known), 1) + at[at >= 0], return_counts=True)
            row = pair // max(len(known), 1)
            some = np.flatnonzero(n)
            ends = np.searchsorted(row, np.append(some, len(n))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (pair % max(len(known), 1), tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(some)), pa.array(n[some]), *lists], names=["doc_id", "n", "terms", "tf"])

    return run


class Scores:
    """Scores of one window's documents: an array of sums, and a bitset of those that any term has touched."""

    def __init__(self, size: int):
        self.sums, self.size = np.zeros(size, np.int64), size
        self.touched = np.zeros(-(-size // 8), np.uint8)

    def add(self, at: np.ndarray, part: np.ndarray, bits: np.ndarray) -> None:
        """Scatter one term's parts; a document comes once in it. bits: the same documents as a bitset."""
        self.sums[at] += part
        self.touched[: len(bits)] |= bits

    def harvest(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The touched documents of at least that score, with scores; all is cleared."""
        at = np.flatnonzero(np.unpackbits(self.touched, count=self.size))
        score = self.sums[at]
        self.sums[at] = 0
        self.touched[:] = 0
        good = score >= least
        return at[good], score[good]


class Heap:
    """The best ``top`` of what is offered in ascending order of ids: a later one needs a larger score."""

    def __init__(self, top: int):
        self.top, self.held, self.offered = top, [], 0

    def least(self) -> int:
        return self.held[0][0] + 1 if len(self.held) == self.top else 1

    def offer(self, ids: list, scores: np.ndarray) -> None:
        order = np.lexsort((np.arange(len(scores)), -scores))[: self.top]
        for i in np.sort(order).tolist():
            self.offered += 1
            heapq.heappush(self.held, (int(scores[i]), -self.offered, ids[i]))
            if len(self.held) > self.top:
                heapq.heappop(self.held)


def parts(weight: int, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to documents' scores, in 64-bit integers."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def lengths(n: np.ndarray, texts: int, total: int) -> np.ndarray:
    """A document's m, by its number of terms, the number of texts and of all their terms."""
    if 90 * int(n.max(initial=0)) * texts < 1 << 63:
        return 10 + 90 * n * texts // total
    return np.array([10 + 90 * x * texts // total for x in n.tolist()], np.int64)


def _windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents of one window of ids at a time, in ascending order: ids, n, and postings (term, place, tf).

    A window with more rows than ids, by repeated ids, comes in pieces of ``size`` rows; so do ids that are no whole numbers.
    """
    held: list[tuple] = []
    now, n_held = None, 0

    def joined() -> tuple:
        ids = [i for x in held for i in x[0]]
        offset = np.cumsum([0, *(len(x[0]) for x in held[:-1])])
        place = np.concatenate([x[3] + o for x, o in zip(held, offset, strict=True)])
        return ids, np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held]), place, np.concatenate([x[4] for x in held])

    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        key = np.array([i // size if isinstance(i, int) else -1 for i in ids], object)
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(ids)] if ids else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            while a < b:
                if held and (key[a] != now or n_held >= size):
                    yield joined()
                    held, n_held = [], 0
                end = min(b, a + size - n_held)
                part = batch.slice(a, end - a)
                sizes = np.diff(part.column("terms").offsets.to_numpy())
                flat = [part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "tf")]
                held.append((ids[a:end], part.column("n").to_numpy(), flat[0], np.repeat(np.arange(end - a), sizes), flat[1]))
                now, n_held, a = key[a], n_held + end - a, end
    if held:
        yield joined()


def _ranked(held, id_type: pa.DataType, top: int, size: int):
    """The best documents of a task's windows for each query: query, doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, texts, total = held.value
        heaps = [Heap(top) for _ in queries]
        scores = Scores(size)
        for ids, n, term, place, tf in _windows(batches, size):
            order = np.argsort(term, kind="stable")
            term, place, tf = term[order], place[order], tf[order]
            part = parts(weights[term], tf, lengths(n, texts, total)[place])
            begin, end = (np.searchsorted(term, np.arange(len(weights)), side) for side in ("left", "right"))
            bits: dict[int, np.ndarray] = {}
            for query, heap in zip(queries, heaps, strict=True):
                for t in query:
                    a, b = begin[t], end[t]
                    if a == b:
                        continue
                    if t not in bits:
                        mask = np.zeros(len(n), bool)
                        mask[place[a:b]] = True
                        bits[t] = np.packbits(mask)
                    scores.add(place[a:b], part[a:b], bits[t])
                at, score = scores.harvest(heap.least())
                if len(at):
                    best = np.sort(np.lexsort((at, -score))[:top])
                    heap.offer([ids[i] for i in at[best]], score[best])
        rows = [(q, i, s) for q, heap in enumerate(heaps) for s, _, i in heap.held]
        q, i, s = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(i, id_type), pa.array(s, pa.int64())], names=["query", "doc_id", "score"])

    return run


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, window: int = WINDOW, most_terms: int = TERMS, task_bytes: int = TASK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of highest score above 0 for each query (item_id, text).

    Scores are those of the contract in the README: whole numbers from document frequencies and term counts of all texts.

    The texts are read once to postings of the terms asked for, a row a document, written to the shared folder in order
    of doc_id: ranges for the tasks, in which a range of very many equal ids is split. A task takes its documents by
    windows of ``window`` doc_ids; in a window it adds each query's term parts into an array with a bitset of the
    documents touched, and keeps the best in a heap a query. So it sends ``top`` rows a query, which meet by query.
    Queries are taken in rounds of at most ``most_terms`` distinct terms, or one query; their terms are what is sent
    out, and each round reads the documents anew.

    Null and empty texts have no terms and are in no result; a query without terms has no rows. Equal scores go by ascending
    doc_id, null last; repeated rows are documents of their own, and repeated queries, or ones of equal ids, queries of
    their own. A doc_id of another type than a whole number is taken in its order. Other columns are ignored.
    """
    spark = docs.sparkSession
    doc_type = docs.schema["doc_id"].dataType
    answers = [_answer(docs, asked, top, window, task_bytes) for asked in _rounds(queries, most_terms)]
    if answers:
        found = answers[0]
        for other in answers[1:]:
            found = found.unionByName(other)
        return found
    return spark.createDataFrame([], f"item_id {queries.schema['item_id'].dataType.simpleString()}, rank int, doc_id {doc_type.simpleString()}, score long")


def _rounds(queries: DataFrame, most_terms: int) -> Iterator[tuple[list, list[list[bytes]], object]]:
    """(ids, terms once each, type of ids) of the queries of a round; what a round holds is bounded by its terms."""
    kind = queries.schema["item_id"].dataType
    ids, asked, seen = [], [], set()
    for row in queries.select("item_id", "text").toLocalIterator():
        own = list(dict.fromkeys(terms(row["text"])))
        if not own:
            continue
        if ids and (len(seen.union(own)) > most_terms or len(ids) >= most_terms):
            yield ids, asked, kind
            ids, asked, seen = [], [], set()
        ids.append(row["item_id"])
        asked.append(own)
        seen.update(own)
    if ids:
        yield ids, asked, kind


def _answer(docs: DataFrame, asked: tuple, top: int, window: int, task_bytes: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    context = spark.sparkContext
    ids, queries, kind = asked
    index: dict[bytes, int] = {}
    numbered = [[index.setdefault(t, len(index)) for t in q] for q in queries]
    doc_type = docs.schema["doc_id"].dataType
    folder = f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}"
    docs.select("doc_id", "text").mapInArrow(_postings(context.broadcast(index)), f"doc_id {doc_type.simpleString()}, n long, terms array<int>, tf array<int>").write.parquet(folder)
    held = spark.read.parquet(folder)

    texts, total, postings = held.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.size("terms"))).first()
    df = np.zeros(len(index), np.int64)
    for row in held.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toLocalIterator():  # a row a term of the round
        df[row["t"]] = row["df"]
    weights = np.array([math.floor(1000 * math.log((2 * texts + 2) / (2 * int(n) + 1))) for n in df], np.int64)

    tasks = max(context.defaultParallelism, (8 * (postings or 0) + 24 * texts) // task_bytes + 1)
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("n", "terms", "tf")]
    dealt = held.where(F.size("terms") > 0).repartitionByRange(tasks, *order, F.rand(0)).sortWithinPartitions(*order)
    best = dealt.mapInArrow(_ranked(context.broadcast((numbered, weights, texts, total)), to_arrow_type(doc_type), top, window), f"query int, doc_id {doc_type.simpleString()}, score long")
    by_query = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = checkpoint(best.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= top))
    remove(spark, folder)
    names = spark.createDataFrame(list(enumerate(ids)), f"q int, item_id {kind.simpleString()}")  # the queries of a round
    return ranked.join(F.broadcast(names), F.col("query") == F.col("q")).select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rows of ``search``: the best of all ``documents`` for each item of ``benchmark``."""
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: The same rows for DuckDB.
OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS total FROM d WHERE len(t) > 0),
q AS MATERIALIZED (SELECT q, item_id, unnest(t) AS term FROM b),
p AS MATERIALIZED (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, n_docs),
c AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // total))) AS part FROM p JOIN w USING (term), s),
x AS (SELECT q, item_id, r, doc_id, CAST(sum(part) AS BIGINT) AS score FROM q JOIN c USING (term) GROUP BY q, item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0
QUALIFY rank <= 10
"""
