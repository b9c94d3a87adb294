"""Suffix-array dedup: longest-previous-factor arrays tell which byte strings come elsewhere."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.llm.common import read_table, slices
from loamline.llm.repeats import CONTEXTS, Shape, covered, repeated_spans, spans_of

#: Bytes of a repeated string, and of an anchor; bytes of contexts that are sorted at once.
LENGTH, ANCHOR, AT_ONCE = 400, 32, 800_000
#: Most windows of a run that is split once, and twice, for very common stretches.
WIDTHS = (20, 3)


def suffix_order(symbols: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Ranks of the suffixes that start ``at`` by their first ``depth`` bytes (all inside the array), equal ones sharing a
    rank; and, to compare suffixes by, values that are equal where the next 1, 2, 4 ... bytes are.

    Prefix doubling: values of 8 bytes are the bytes themselves, longer ones are ranks of pairs.
    """
    dense = lambda x: np.unique(x, return_inverse=True)[1].astype(np.int64)
    pad = lambda x, by: np.concatenate([x[by:], np.zeros(min(by, len(x)), x.dtype)])
    value, done = symbols.astype(np.uint64), 1
    levels = [(1, value)]
    while 2 * done <= min(depth, 8):
        value, done = (value << np.uint64(8 * done)) | pad(value, done), 2 * done
        levels.append((done, value))
    rank = dense(value)
    while 2 * done <= depth:
        rank, done = dense(rank * (len(rank) + 1) + pad(rank, done)), 2 * done
        levels.append((done, rank))
    return (rank[at] if done == depth else dense(rank[at] * (len(rank) + 1) + rank[at + depth - done])), levels


def common_prefixes(levels: list[tuple[int, np.ndarray]], at: np.ndarray, depth: int) -> np.ndarray:
    """Of suffixes in order: the length, ``depth`` at most, that each has in common with the one before; 0 for the first."""
    a, b, off = at[:-1], at[1:], np.zeros(max(len(at) - 1, 0), np.int64)
    for size, value in reversed(levels):
        most = len(value) - 1
        off += size * ((off + size <= depth) & (value[np.minimum(a + off, most)] == value[np.minimum(b + off, most)]))
    return np.concatenate([[0], off])[: len(at)]


def previous_smaller(place: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the nearest before it of a smaller place (-1 for none), and the least of ``lcp`` on the way, lcp[i]
    being that of the entries i - 1 and i.

    Minima over 1, 2, 4 ... entries are skipped while all places there are larger: in growing steps, then in shrinking
    ones. Most entries stop within a few.
    """
    n = len(place)
    tables = [(place, lcp)]
    while 2 ** len(tables) <= n:
        by = 2 ** (len(tables) - 1)
        tables.append(tuple(np.concatenate([x[:by], np.minimum(x[by:], x[:-by])]) for x in tables[-1]))
    found, least = np.arange(n) - 1, lcp.copy()
    stopped = np.zeros(n, np.int64)

    def skip(who: np.ndarray, k: int) -> np.ndarray:
        cur = found[who]
        can = (cur >= 2**k - 1) & (tables[k][0][np.maximum(cur, 0)] > place[who])
        who = who[can]
        least[who] = np.minimum(least[who], tables[k][1][found[who]])
        found[who] -= 2**k
        return can

    active = np.arange(n)
    for k in range(len(tables)):
        can = skip(active, k)
        stopped[active[~can]] = k
        active = active[can]
    stopped[active] = len(tables)
    order = np.argsort(-stopped, kind="stable")
    above = np.searchsorted(-stopped[order], -np.arange(len(tables)))  # how many stopped above level k
    for k in reversed(range(len(tables))):
        if above[k]:
            skip(order[: above[k]], k)
    return found, np.where(found >= 0, least, 0)


def longest_previous_factors(order: np.ndarray, lcp: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By suffix: the length of the longest match that starts at a smaller place, and the suffix of that match (-1: none).

    Of the suffixes in order, the nearest of a smaller place on either side have the longest common prefixes with it of
    all that have smaller places. order: suffixes in order; lcp: as of ``common_prefixes``; place: by suffix, no two equal.
    """
    n, p = len(order), place[order]
    left, by_left = previous_smaller(p, lcp)
    right, by_right = previous_smaller(p[::-1], np.concatenate([[0], lcp[:0:-1]])[:n])
    right, by_right = np.where(right >= 0, n - 1 - right, -1)[::-1], by_right[::-1]
    nearer = by_left >= by_right
    match, length = np.where(nearer, left, right), np.where(nearer, by_left, by_right)
    factors, source = np.zeros(n, np.int64), np.full(n, -1)
    factors[order] = length
    source[order] = np.where(length > 0, order[match], -1)
    return factors, source


def repeated_starts(symbols: np.ndarray, at: np.ndarray, place: np.ndarray, length: int, first: bool) -> np.ndarray:
    """Which of the suffixes ``at`` have an earlier match of ``length`` bytes, or, unless the first copy stays, are one."""
    rank, levels = suffix_order(symbols, at, length)
    order = np.lexsort((place, rank))
    factors, source = longest_previous_factors(order, common_prefixes(levels, at[order], length), place)
    chosen = factors >= length
    if not first:
        chosen[source[chosen]] = True
    return chosen


def _solve(length: int, first: bool, most: int):
    """Contexts, sorted by key, are taken about ``most`` bytes at a time and never half a key."""

    def spans(held: list[tuple]) -> pa.RecordBatch:
        _, doc, tid, size, begin, end, raw = zip(*held, strict=True)
        parts = [np.frombuffer(r, np.uint8) for r in raw]
        begins = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
        count = np.array(end) - np.array(begin) + 1
        of = np.repeat(np.arange(len(parts)), count)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        doc, tid, size, start = np.array(doc), np.array(tid), np.array(size), np.array(begin)[of] + inside
        place = np.empty(len(of), np.int64)
        place[np.lexsort((start, tid[of], doc[of]))] = np.arange(len(of))
        chosen = repeated_starts(np.concatenate(parts), begins[of] + inside, place, length, first)
        return spans_of(of[chosen], start[chosen], tid, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= most and row[0] != last:
                    yield spans(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
                last = row[0]
        if held:
            yield spans(held)

    return run


def to_characters(spans: list[tuple[int, int]], raw: bytes) -> list[tuple[int, int]]:
    """Ascending spans of UTF-8 bytes, widened to whole characters; those that then touch or overlap become one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        while a > 0 and raw[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(raw) and raw[b] & 0xC0 == 0x80:
            b += 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(length: int, first: bool, characters: bool = False):
    """n_bytes, spans (begin, end), kept text as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            columns = (batch.column(c).to_pylist() for c in ("text", "copy", "later", "spans"))
            for text, copy, later, spans in zip(*columns, strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                whole = len(raw) >= length and (later if first else copy)
                parts = [(0, len(raw))] if whole else covered(spans, length, len(raw))
                parts = to_characters(parts, raw) if characters else parts
                at, kept = 0, []
                for a, b in parts:
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                out.append((len(raw), [{"begin": a, "end": b} for a, b in parts], hashlib.sha256(kept).hexdigest(), kept if parts else None))
            n, spans, digest, kept = zip(*out, strict=True)
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            carried = [c for c in batch.schema.names if c.startswith("c_")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(digest), pa.array(kept, pa.binary()), *(batch.column(c) for c in carried)],
                names=["doc_id", "n_bytes", "cuts", "kept_sha256", "kept", *carried],
            )

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, keep_first: bool = False, carry: tuple[str, ...] = (), characters: bool = False) -> DataFrame:
    """doc_id, n_bytes, cuts, kept_sha256 and kept of each row: the bytes left without repeated strings of ``length``.

    Texts are UTF-8 bytes. A byte goes if a string of ``length`` bytes that covers it also starts elsewhere, in any
    document or the same; with ``keep_first`` only if it also starts earlier (by doc_id, null last, then position).
    Matches never cross documents, and are judged on the input. ``kept`` is null where nothing is cut; it may end inside
    a character, so it is binary. With ``characters`` a character of which a byte goes goes whole.

    Null texts are empty. Rows of equal text are each other's copies. Other columns are ignored but for those of
    ``carry``, which come along as c_name.
    """
    shape = Shape(length, anchor, words=False, first=keep_first, widths=WIDTHS)
    solve = lambda asked, contexts, _: asked.mapInArrow(contexts, CONTEXTS).repartition("key").sortWithinPartitions("key").mapInArrow(_solve(length, keep_first, AT_ONCE), "tid long, size long, first long, last long")
    found = repeated_spans(docs, shape, solve, carry)
    kinds = "doc_id long, n_bytes long, cuts array<struct<begin:long,end:long>>, kept_sha256 string, kept binary"
    kinds = ", ".join([kinds, *[f"`c_{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]])
    return found.mapInArrow(_cut(length, keep_first, characters), kinds)


def cut_later_copies(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the first copy of each repeated string left and the later ones cut out of their texts.

    Characters at the edges of a cut, of which some bytes are copied, go whole; documents of which only blanks are left go. ``n_chars``, where
    there is such a column, is counted anew for cut texts. All other columns stay as they are.
    """
    carry = tuple(c for c in docs.columns if c != "doc_id")
    found = remove_repeats(docs, length, keep_first=True, carry=carry, characters=True)
    cut = F.size("cuts") > 0
    text = F.when(cut, F.make_valid_utf8(F.col("kept").cast("string"))).otherwise(F.col("c_text"))
    found = found.withColumn("new_text", text).where(~cut | F.col("new_text").rlike(r"[^\x20\x09-\x0D]"))
    columns = []
    for c in docs.columns:
        kind = docs.schema[c].dataType
        new = {"doc_id": F.col("doc_id"), "text": F.col("new_text")}.get(c, F.col(f"c_{c}"))
        columns.append((F.when(cut, F.char_length("new_text").cast(kind)).otherwise(new) if c == "n_chars" else new).alias(c))
    return found.select(*columns)


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of ``remove_repeats`` over whole ``documents``."""
    removed = F.aggregate("cuts", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["begin"])
    return remove_repeats(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("cuts").cast("long").alias("n_spans"), "kept_sha256"
    )


#: The same rows for DuckDB: all windows by their MD5, runs of those that come twice, and what lies between.
OP7_SQL = """
WITH t AS (SELECT doc_id, row_number() OVER () AS uid, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT uid, i, md5_number(b[i:i + 399]) AS h FROM (SELECT uid, b, unnest(range(1, octet_length(b) - 398)) AS i FROM t WHERE octet_length(b) >= 400)),
m AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
r AS (SELECT uid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY uid ORDER BY i) + 400 THEN 0 ELSE 1 END AS apart FROM w SEMI JOIN m USING (h)),
g AS (SELECT uid, i, sum(apart) OVER (PARTITION BY uid ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM r),
s AS (SELECT uid, run, min(i) AS a, max(i) + 399 AS z FROM g GROUP BY uid, run),
k AS (SELECT uid, a, z, coalesce(lag(z) OVER (PARTITION BY uid ORDER BY a), 0) AS before FROM s),
c AS (
  SELECT uid, sum(z - a + 1) AS n_removed, count(*) AS n_spans, max(z) AS z,
         string_agg(CASE WHEN a > before + 1 THEN hex(b[before + 1:a - 1]) ELSE '' END, '' ORDER BY a) AS kept
  FROM k JOIN t USING (uid) GROUP BY uid)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(CASE WHEN z IS NULL THEN b WHEN z < octet_length(b) THEN unhex(kept || hex(b[z + 1:octet_length(b)])) ELSE unhex(kept) END) AS kept_sha256
FROM t LEFT JOIN c USING (uid)
"""
