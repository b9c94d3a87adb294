"""Substring dedup by prefix-partitioned suffix trees over words."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.llm.common import checkpoint, limited, read_table, slices
from loamline.llm.repeats import Shape, change, covered, repeated_spans, spans_of

#: Words of a window, and of an anchor.
WINDOW, ANCHOR = 20, 4
#: Most windows of a run that is split once, and twice, for very common stretches.
WIDTHS = (4, 1)
#: Suffixes of a group at most, unless they share the whole window: a prefix that more of them have is made longer.
SUBTREE = 4096


def prefix_lengths(window: int) -> list[int]:
    """1, 2, 4 ... words, then the whole window."""
    return [1 << k for k in range(window.bit_length()) if 1 << k < window] + [window]


def _suffixes(window: int):
    """Of contexts: a row for each window start, with its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                texts = [np.frombuffer(x, np.uint64) for x in part.column("symbols").to_pylist()]
                count = np.array([len(t) - window + 1 for t in texts])
                of = np.repeat(np.arange(len(texts)), count)
                begins = np.cumsum([0, *(len(t) for t in texts[:-1])])
                inside = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                symbols, at = np.concatenate(texts), begins[of] + inside
                words = np.lib.stride_tricks.sliding_window_view(symbols, window)[at]
                raw = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * 8 * window).astype(np.int32)), pa.py_buffer(words.tobytes())])
                own = [pa.array(part.column(c).to_numpy()[of]) for c in ("doc", "tid", "size")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(part.column("first").to_numpy()[of] + inside), raw], names=["doc", "tid", "size", "start", "words"])

    return run


def prefix_groups(suffixes: DataFrame, window: int, most: int) -> DataFrame:
    """The suffixes with ``group``: the shortest prefix, by its hash, that ``most`` of them or fewer have, or the whole window.

    Prefixes are counted with partial sums before the shuffle; those that more suffixes have are few, and are what the
    suffixes are looked up in.
    """
    prefixes = {n: F.xxhash64(F.substring("words", 1, 8 * n), F.lit(n)) for n in prefix_lengths(window)}
    counts = suffixes.select(F.explode(F.array(*list(prefixes.values())[:-1])).alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    large = limited(checkpoint(counts.where(F.col("n") > most).select("prefix")))
    grouped, group = suffixes, prefixes[window]
    for n in sorted(prefixes)[-2::-1]:
        grouped = grouped.join(large.select(F.col("prefix").alias(f"large_{n}")), prefixes[n] == F.col(f"large_{n}"), "left")
        group = F.when(F.col(f"large_{n}").isNull(), prefixes[n]).otherwise(group)
    return grouped.select("doc", "tid", "size", "start", "words", group.alias("group"))


def shared_words(words: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Of suffixes in order, as rows of words: how many first words each shares with the one before it, ``before`` coming
    before the first. These depths tell the subtree: a node of depth d is a stretch in which none is under d."""
    same = words == np.concatenate([before[None], words[:-1]])
    return np.where(same.all(axis=1), words.shape[1], np.argmin(same, axis=1))


def _subtrees(window: int):
    """Suffixes in order of group, words and place come as spans of those that aren't the earliest of a deep node.

    A node as deep as the window is a repeat; its suffixes come in order of place, so all but the first have an earlier
    one. Neighbouring starts make maximal repeats. Only the last suffix is held from batch to batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_words, last_group = np.zeros(window, np.uint64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            words = np.frombuffer(b"".join(batch.column("words").to_pylist()), np.uint64).reshape(-1, window)
            group = batch.column("group").to_numpy()
            depth = shared_words(words, last_words)
            inside = np.concatenate([[group[0] == last_group], group[1:] == group[:-1]])
            last_words, last_group = words[-1], group[-1]
            later = np.flatnonzero(inside & (depth >= window))
            if not len(later):
                continue
            tid, size, start = (batch.column(c).to_numpy()[later] for c in ("tid", "size", "start"))
            order = np.lexsort((start, size, tid))
            _, of = np.unique(np.stack([tid[order], size[order]]), axis=1, return_inverse=True)
            firsts = np.flatnonzero(change(of))
            yield spans_of(of, start[order], tid[order][firsts], size[order][firsts])

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            columns = (batch.column(c).to_pylist() for c in ("text", "later", "spans"))
            for text, later, spans in zip(*columns, strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                parts = [(0, len(words))] if later and len(words) >= length else covered(spans, length, len(words))
                at, kept = 0, []
                for a, b in parts:
                    kept += words[at:a]
                    at = b
                kept = b" ".join(kept + words[at:])
                out.append((len(words), sum(b - a for a, b in parts), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if parts else None))
            n, removed, digest, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return run


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, subtree: int = SUBTREE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept of each row: the words left without later copies of windows.

    Words stand between ASCII whitespace. A word goes if a window of ``window`` words that covers it also starts earlier:
    in a document of smaller doc_id (null last; then by the text's hash), or before it in its own. Windows never cross
    documents and are judged on the input. ``kept`` joins the words left by blanks, and is null where none goes.

    Stretches that may repeat are found by ``repeated_spans``. Their suffixes are dealt to groups by prefixes, each as long
    as it takes to leave at most ``subtree`` suffixes in a group, and sorted there; the depths that neighbours share
    make the group's subtree, whose nodes as deep as a window are the repeats.
    Words are told apart by 64-bit hashes. Null texts have no words. Rows of equal text and id are one document.
    """
    shape = Shape(window, anchor, words=True, first=True, widths=WIDTHS)

    def solve(asked: DataFrame, contexts: Callable, folder: str) -> DataFrame:
        cut = _suffixes(window)
        asked.mapInArrow(lambda batches: cut(contexts(batches)), "doc long, tid long, size long, start long, words binary").write.parquet(folder)  # both steps in one worker
        suffixes = asked.sparkSession.read.parquet(folder)  # neighbours share most words, so it compresses well, unlike a checkpoint
        grouped = prefix_groups(suffixes, window, subtree).repartition("group").sortWithinPartitions("group", "words", "doc", "tid", "start")
        return grouped.mapInArrow(_subtrees(window), "tid long, size long, first long, last long")

    found = repeated_spans(docs, shape, solve)
    return found.mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of ``remove_repeated_windows`` over whole ``documents``."""
    return remove_repeated_windows(read_table(spark, sf_dir, "documents")).drop("kept")


#: The same rows for DuckDB.
OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS uid, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
v AS (SELECT uid, doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT uid, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM t WHERE len(w) >= 20)),
later AS (SELECT uid, i FROM (SELECT uid, i, rank() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, i) AS r FROM v) WHERE r > 1),
gone AS (SELECT DISTINCT uid, unnest(range(i, i + 20)) AS p FROM later),
words AS (SELECT uid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM t),
kept AS (SELECT uid, string_agg(word, ' ' ORDER BY p) AS k FROM words ANTI JOIN gone USING (uid, p) GROUP BY uid),
n AS (SELECT uid, count(*) AS n FROM gone GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (uid) LEFT JOIN n USING (uid)
"""
