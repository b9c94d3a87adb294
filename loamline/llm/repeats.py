"""Repeated substrings of a whole corpus: anchors chosen by content, and the stretches around equal anchors.

Both substring operators start with this. A text is an array of symbols (bytes or words) and a window is ``length``
consecutive symbols. The windows of a text are dealt to runs: each belongs to the anchor of least hash in it (a
minimiser, so equal windows have equal anchors at equal places), and to a key, the hash of the anchor with the symbols
on its longer side. Equal windows have equal keys. Only keys that come twice need the text. Of runs whose whole
contexts are equal one stands for all; contexts that differ are shipped, and solved by suffix order.

A key that very many texts have in different contexts, as a notice has inside different pages, would gather in one task.
So a sample of the texts, chosen by hash, is looked through for such keys first; their runs are split by the place of
the anchor into shorter ones, whose keys are longer, twice if need be. Windows that are equal are split alike, so that
changes no result, only which task solves what.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import WordHashes, checkpoint, limited, mix, slices
from loamline.plans.lineage import remove, shared_folder

MASK = np.uint64((1 << 24) - 1)
BASE = 0xD1342543DE82EF95
#: Symbols that are handled at once; a longer text is handled in overlapping pieces.
PIECE = 400_000
#: Bytes of span lists that are broadcast at most; beyond, that join shuffles.
BROADCAST_BYTES = 32 << 20
#: One text in so many is looked through for keys to split: those with at least ``HOT`` contexts there, and one in
#: ``MOST_HOT`` of all contexts there, so there are ``MOST_HOT`` (8 bytes each) at most. No result depends on it.
SAMPLE, HOT, MOST_HOT = 16, 16, 500_000
#: Words whose hashes a task remembers.
MEMORY = 200_000
#: Rows of sorted runs that are grouped at once.
ROWS_AT_ONCE = 1_000_000


@dataclass(frozen=True)
class Shape:
    """length of a window, symbols of an anchor; first: the earliest copy stays; widths: most windows of a run that was split
    once, and twice."""

    length: int
    anchor: int
    words: bool
    first: bool
    widths: tuple[int, int]

    @property
    def wing(self) -> int:
        return (self.length - self.anchor + 1) // 2

    def symbols(self, hashes: WordHashes, text: str | None) -> np.ndarray:
        raw = (text or "").encode("utf-8", "surrogatepass")
        return hashes.of(raw.split()) if self.words else np.frombuffer(raw, np.uint8)


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n + 1, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class Rolling:
    """64-bit hashes of any stretches of an array of symbols."""

    def __init__(self, symbols: np.ndarray):
        weight = mix(symbols.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        self.up, down = powers(len(symbols))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weight * down[:-1], dtype=np.uint64)])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.up[start])


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    m = len(v)
    rows = np.full(-(-m // w) * w, np.iinfo(np.uint64).max, np.uint64)
    rows[:m] = v
    rows = rows.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: m - w + 1], ahead[w - 1 : m])


def runs(symbols: np.ndarray, ends: np.ndarray, shape: Shape, hot: tuple[np.ndarray, ...] = ()) -> tuple[np.ndarray, ...]:
    """Of concatenated texts that end at ``ends``: key, context hash, first and last window start of each run; those of
    ``hot`` keys (sorted, unsigned; of whole runs, and of runs split once) are split."""
    n, length, k, wing = len(symbols), shape.length, shape.anchor, shape.wing
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    rolling = Rolling(symbols)
    grams = rolling.of(np.arange(n - k + 1), k)
    least = sliding_min((grams & ~MASK) | np.arange(len(grams), dtype=np.uint64), length - k + 1)
    anchor = (least & MASK).astype(np.int64)
    valid = np.ones(len(anchor), np.int64)
    for e in ends[:-1].tolist():  # windows over a border
        valid[max(0, e - length + 1) : e] = 0
    start = np.flatnonzero(valid)
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    anchor = anchor[start]
    left = anchor - start >= wing
    new = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(left.astype(np.int8)) != 0) | (np.diff(start) != 1)]))
    first, last = start[new], start[np.concatenate([new[1:] - 1, [len(start) - 1]])]
    anchor, left = anchor[new], left[new]
    key = rolling.of(np.where(left, anchor - wing, anchor), k + wing)
    key = mix(key + left.astype(np.uint64))
    for width, known in zip(shape.widths, hot, strict=False):
        split = np.flatnonzero(np.isin(key, known)) if len(known) else anchor[:0]
        if len(split):
            parts = _split(rolling, first[split], last[split], anchor[split], length, width)
            keep = np.ones(len(key), bool)
            keep[split] = False
            key, first, last, anchor = (np.concatenate([c[keep], p]) for c, p in zip((key, first, last, anchor), parts, strict=True))
    context = mix(rolling.of(first, last - first + length) + mix((anchor - first).astype(np.uint64)))
    return key.view(np.int64), context.view(np.int64), first, last


def _split(rolling: Rolling, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, length: int, width: int) -> tuple[np.ndarray, ...]:
    """Runs by classes of ``width`` places of the anchor in the window; their key is all that the windows of a class share."""
    low, high = (anchor - last) // width, (anchor - first) // width
    times = high - low + 1
    of = np.repeat(np.arange(len(first)), times)
    kind = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
    start = anchor[of] - kind * width  # of the last window that the class may have
    key = mix(rolling.of(start, length - width + 1) + mix(kind.astype(np.uint64) * np.uint64(1024) + np.uint64(width)))
    return key, np.maximum(first[of], start - width + 1), np.minimum(last[of], start), anchor[of]


def _pieces(texts: list[np.ndarray], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]]:
    """Concatenations of about PIECE symbols: symbols, ends, and (text, start in the piece, offset in the text)."""
    held, where, size = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), PIECE):
            part = t[at : at + PIECE + length - 1]
            where.append((i, size, at))
            held.append(part)
            size += len(part)
            if size >= PIECE:
                yield np.concatenate(held), np.cumsum([len(x) for x in held]), where
                held, where, size = [], [], 0
    if held:
        yield np.concatenate(held), np.cumsum([len(x) for x in held]), where


def change(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    if not len(columns[0]):
        return np.zeros(0, bool)
    return np.concatenate([[True], np.any([np.diff(c) != 0 for c in columns], axis=0)])


def combine(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Of the runs (key, context, doc, tid, size, first, last) of a piece, with a column copies added: one row stands for
    all equal contexts, with their number; the others are settled, so they get 0 and a key of their own.

    A passage that very many texts share so sends one row from each piece to its key, and the rest anywhere.
    """
    key, context, doc, tid, _, start, _ = rows
    order = np.lexsort((start, tid, doc, context, key))
    rows = [c[order] for c in rows]
    keep = change(rows[0], rows[1], rows[3], rows[5])  # repeated rows of one document
    rows = [c[keep] for c in rows]
    new = change(rows[0], rows[1])
    copies = np.where(new, np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] if len(new) else 0, 0)
    own = mix(rows[3].view(np.uint64) + mix(rows[5].astype(np.uint64))).view(np.int64)
    by_text = np.lexsort((rows[5], rows[3]))  # neighbours that are alike compress well
    return [c[by_text] for c in (np.where(new, rows[0], own), *rows[1:], copies)]


def _scan(shape: Shape, hot) -> Callable:
    """hot: a broadcast of the keys to split."""
    names = ["key", "context", "doc", "tid", "size", "first", "last", "copies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(MEMORY)
        for batch in slices(batches, most_bytes=1_000_000):
            texts = [shape.symbols(hashes, t) for t in batch.column("text").to_pylist()]
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tid", "size")]
            for symbols, ends, where in _pieces(texts, shape.length):
                key, context, first, last = runs(symbols, ends, shape, hot.value)
                begins = np.array([w[1] for w in where])
                piece = np.searchsorted(begins, first, side="right") - 1
                text = np.array([w[0] for w in where])[piece]
                shift = np.array([w[2] for w in where])[piece] - begins[piece]
                columns = combine([key, context, *(c[text] for c in own), first + shift, last + shift])
                for i in range(0, len(columns[0]), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 200_000]) for c in columns], names=names)

    return run


def _groups(shape: Shape) -> Callable:
    """Of runs sorted by key: those whose windows are settled by equal contexts, and one run of each context of a key that
    has several."""

    def out(rows: list[np.ndarray], settled: np.ndarray, ask: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*(pa.array(rows[i]) for i in (0, 2, 3, 4, 5, 6)), pa.array(settled), pa.array(ask)],
            names=["key", "doc", "tid", "size", "first", "last", "settled", "ask"],
        )

    def solve(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        before = rows[7] == 0
        yield out([c[before] for c in rows], np.ones(before.sum(), bool), np.zeros(before.sum(), bool))
        rows = [c[~before] for c in rows]
        same = np.diff(rows[0]) == 0  # most keys come once and go before anything else is sorted
        several = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(rows[0]) else np.zeros(0, bool)
        several |= rows[7] > 1
        rows = [c[several] for c in rows]
        key, context, doc, tid, _, first, _, _ = rows
        order = np.lexsort((first, tid, doc, context, key))
        if not len(order):
            return
        rows = [c[order] for c in rows]
        new = change(rows[0], rows[1], rows[3], rows[5])  # repeated rows of one document
        counts = np.maximum.reduceat(rows[7], np.flatnonzero(new))
        rows = [c[new] for c in rows]
        new_key, new_context = change(rows[0]), change(rows[0], rows[1])
        of_context = np.cumsum(new_context) - 1
        copies = np.bincount(of_context, weights=counts)[of_context]
        of_key = np.cumsum(new_key) - 1
        contexts = np.bincount(of_key, weights=new_context)[of_key]
        settled = (copies > 1) & (~new_context if shape.first else True)
        ask = new_context & (contexts > 1)
        yield out([c[settled | ask] for c in rows], settled[settled | ask], ask[settled | ask])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            size += batch.num_rows
            if size >= ROWS_AT_ONCE:
                rows = [np.concatenate(c) for c in zip(*held, strict=True)]
                whole = int(np.searchsorted(rows[0], rows[0][-1]))  # the last key may go on
                if whole:
                    yield from solve([c[:whole] for c in rows])
                held, size = [[c[whole:] for c in rows]], len(rows[0]) - whole
        if held:
            yield from solve([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def _sampled(shape: Shape, hot) -> Callable:
    """(key, context) of the runs, split by the keys that are known so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(MEMORY)
        for batch in slices(batches, most_bytes=1_000_000):
            texts = [shape.symbols(hashes, t) for t in batch.column("text").to_pylist()]
            for symbols, ends, _ in _pieces(texts, shape.length):
                key, context, _, _ = runs(symbols, ends, shape, hot.value)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(context)], names=["key", "context"])

    return run


def hot_keys(texts: DataFrame, shape: Shape):
    """A broadcast of the keys that runs are split by, from a sample of the texts: for each split a sorted array."""
    context = texts.sparkSession.sparkContext
    sample = checkpoint(texts.where(F.pmod(F.xxhash64("tid", "size"), F.lit(SAMPLE)) == 0).select("text"))
    found: tuple[np.ndarray, ...] = ()
    for _ in shape.widths:
        runs_of = sample.mapInArrow(_sampled(shape, context.broadcast(found)), "key long, context long")
        counts = checkpoint(runs_of.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")))
        total = counts.agg(F.sum("n")).first()[0] or 0
        keys = counts.where(F.col("n") >= max(HOT, total // MOST_HOT)).select("key").toArrow()  # MOST_HOT at most
        keys = keys.column("key").to_numpy().view(np.uint64)
        if not len(keys):
            break
        found = (*found, np.sort(keys))
    return context.broadcast(found)


CONTEXTS = "key long, doc long, tid long, size long, first long, last long, symbols binary"


def _contexts(shape: Shape) -> Callable:
    """The symbols of each asked run: (key, doc, tid, size, first, last, symbols)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(MEMORY)
        for batch in slices(batches, most_bytes=1_000_000):
            out = []
            columns = (batch.column(c).to_pylist() for c in ("text", "doc", "tid", "size", "asked"))
            for text, doc, tid, size, asked in zip(*columns, strict=True):
                symbols = shape.symbols(hashes, text)
                out += [(r["key"], doc, tid, size, r["first"], r["last"], symbols[r["first"] : r["last"] + shape.length].tobytes()) for r in asked]
            for i in range(0, len(out), 4000):
                part = list(zip(*out[i : i + 4000], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in part[:6]), pa.array(part[6], pa.binary())], names=["key", "doc", "tid", "size", "first", "last", "symbols"]
                )

    return run


def _merge(length: int) -> Callable:
    """Each text's runs as few, covering the same symbols."""
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = []
            for spans in batch.column("spans").to_pylist():
                out: list[dict] = []
                for first, last in sorted((s["first"], s["last"]) for s in spans):
                    if out and first <= out[-1]["last"] + length:
                        out[-1]["last"] = max(out[-1]["last"], last)
                    else:
                        out.append({"first": first, "last": last})
                merged.append(out)
            yield pa.RecordBatch.from_arrays([batch.column("tid"), batch.column("size"), pa.array(merged, kind)], names=["tid", "size", "spans"])

    return run


def repeated_spans(docs: DataFrame, shape: Shape, solve: Callable, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, copy (of an equal text of another row), later (than the first equal text), spans of each row, and
    the columns of ``carry`` as c_name.

    spans are the (first, last) starts of repeated windows in the text, as ``shape.first`` counts them. Equal texts are
    one text with the smallest doc_id (null comes last), of whose rows one alone is scanned. ``solve`` takes texts with the
    runs that are asked of them, the function of Arrow batches that makes contexts (``CONTEXTS``) of these, and a shared
    folder, which may hold a table until its result is kept, and gives spans (tid, size, first, last) of their windows.
    """
    last = F.lit((1 << 63) - 1)
    texts = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", last).alias("doc"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("tid"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"),
        *[F.col(c).alias(f"c_{c}") for c in carry],
    )
    equal = texts.where(F.col("size") >= shape.length).groupBy("tid", "size", "doc").agg(F.count(F.lit(1)).alias("rows"))
    equal = equal.groupBy("tid", "size").agg(F.min(F.struct("doc", "rows")).alias("least"), F.sum("rows").alias("rows")).where("rows > 1")
    equal = checkpoint(equal.select("tid", "size", F.col("least.doc").alias("least"), (F.col("least.rows") > 1).alias("again")))
    repeated = not equal.where("again").isEmpty()
    texts = texts.join(limited(equal), ["tid", "size"], "left")
    once = texts.where("size >= %d and (least is null or least = doc)" % shape.length).select("doc", "tid", "size", "text", "again")
    if repeated:  # only texts whose smallest id comes in several rows are shuffled for it
        once = once.where("again is null or not again").unionByName(once.where("again").dropDuplicates(["doc", "tid", "size"]))
    once = once.drop("again")

    found = once.mapInArrow(_scan(shape, hot_keys(once, shape)), "key long, context long, doc long, tid long, size long, first long, last long, copies long")
    found = found.repartition("key").sortWithinPartitions("key")
    folder = f"{shared_folder(docs.sparkSession)}/repeats-{uuid.uuid4().hex}"
    found = found.mapInArrow(_groups(shape), "key long, doc long, tid long, size long, first long, last long, settled boolean, ask boolean")
    found.write.parquet(f"{folder}/groups")  # neighbours are alike, so columns compress well, unlike a checkpoint
    groups = docs.sparkSession.read.parquet(f"{folder}/groups")
    asked = groups.where("ask").groupBy("doc", "tid", "size").agg(F.collect_list(F.struct("key", "first", "last")).alias("asked"))
    asked = once.hint("shuffle_merge").join(asked, ["doc", "tid", "size"])

    spans = groups.where("settled").select("tid", "size", "first", "last").unionByName(solve(asked, _contexts(shape), f"{folder}/contexts"))
    spans = spans.groupBy("tid", "size").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    spans = checkpoint(spans.mapInArrow(_merge(shape.length), "tid long, size long, spans array<struct<first:long,last:long>>"))
    remove(docs.sparkSession, folder)
    held = spans.agg(F.sum(F.size("spans") * 16 + 48)).first()[0] or 0
    spans = F.broadcast(spans) if held <= BROADCAST_BYTES else spans
    return texts.join(spans, ["tid", "size"], "left").select(
        "doc_id", "text", F.col("least").isNotNull().alias("copy"), F.coalesce(F.col("least") < F.col("doc"), F.lit(False)).alias("later"), "spans",
        *[f"c_{c}" for c in carry],
    )


def spans_of(of: np.ndarray, start: np.ndarray, tid: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """Windows of contexts (``of``, ascending, and their starts) as runs of neighbours; tid and size by context."""
    new = np.flatnonzero(np.concatenate([[True], (np.diff(of) != 0) | (np.diff(start) != 1)])) if len(of) else of
    ends = np.concatenate([new[1:] - 1, [len(of) - 1]]) if len(of) else of
    columns = [tid[of[new]], size[of[new]], start[new], start[ends]]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["tid", "size", "first", "last"])


def covered(spans: list[dict] | None, length: int, n: int) -> list[tuple[int, int]]:
    """Maximal covered stretches [begin, end) of n symbols."""
    out: list[tuple[int, int]] = []
    for first, last in sorted((s["first"], s["last"]) for s in spans or []):
        end = min(last + length, n)
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out
