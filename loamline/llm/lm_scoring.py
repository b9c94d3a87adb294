"""LM scoring: cross-entropy difference of two matched bigram models over one vocabulary (Moore and Lewis, 2010)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.llm.common import WordHashes, checkpoint, mix, read_table, slices

#: Bytes of text whose counts are asked for together, and bytes of text to each range of words and pairs.
CHUNK, BUCKET = 6_000_000, 24_000_000
#: Pseudo-counts by which a bigram's unigram probability is mixed in, and a word's uniform one.
BIGRAM_PRIOR, WORD_PRIOR = 4.0, 1.0
#: What comes before the first word of a text.
START = np.uint64(0x9E3779B97F4A7C15)
ROWS = "bucket int, chunk long, part int, keys binary, n binary, n_target binary"


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII whitespace, A-Z lower-cased; none for a null text."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Chunk:
    """The tokens of some texts, their distinct words and pairs (a text's first pair is of START), and counts of both."""

    def __init__(self, texts: list[np.ndarray], wanted: np.ndarray):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        ids = np.concatenate([*texts, np.zeros(0, np.uint64)])
        begins = (np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]
        before = np.concatenate([[START], ids[:-1]])[: len(ids)]
        before[begins] = START
        chosen = np.repeat(wanted, self.sizes)
        self.words, self.word = np.unique(ids, return_inverse=True)
        self.pairs, self.pair = np.unique(mix(before * np.uint64(0xD1342543DE82EF95) + ids), return_inverse=True)
        self.counts = [(keys, np.bincount(at, minlength=len(keys)), np.bincount(at[chosen], minlength=len(keys))) for keys, at in ((self.words, self.word), (self.pairs, self.pair))]


def _read(batch: pa.RecordBatch, hashes: WordHashes) -> tuple[list[np.ndarray], np.ndarray]:
    texts = [mix(hashes.of(tokens(t))) for t in batch.column("text").to_pylist()]
    return texts, np.array([bool(w) for w in batch.column("target").to_pylist()], bool)


def mark(keys: np.ndarray) -> bytes:
    """What tells sets of sorted keys apart."""
    import xxhash

    return xxhash.xxh3_128_digest(np.ascontiguousarray(keys).tobytes())


def pack(x: np.ndarray) -> bytes:
    """An array by planes of bytes, compressed."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(raw: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    planes = pa.decompress(memoryview(raw)[8:], decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(width, n).T.copy().view(kind).ravel()


def _asked(chunk: int, kind: int, counts: tuple[np.ndarray, ...], buckets: int) -> Iterator[tuple]:
    """Rows of one range of hashes each: the keys of it, as steps, and how often the chunk has them."""
    keys, n, n_target = counts
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)  # ascending, as the keys are
    cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        at = slice(cuts[b], cuts[b + 1])
        yield 2 * b + kind, chunk, 2 * b + kind, pack(np.diff(keys[at], prepend=np.uint64(0))), pack(n[at].astype(np.uint32)), pack(n_target[at].astype(np.uint32))


def _batches(rows: Iterator[tuple], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = ["bucket", "chunk", "part", "keys", "n", "n_target"]
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x or b"") for x in row[3:])
        if size >= most or len(held) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def _chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The texts of a task in chunks, numbered; the same each time they are read."""
    for i, batch in enumerate(slices(batches, most_bytes=chunk_bytes)):
        yield batch.column("task")[0].as_py() << 32 | i, batch


def _ask(chunk_bytes: int, buckets: int):
    """The words and pairs of each chunk by range."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        hashes = WordHashes()
        for chunk, batch in _chunks(batches, chunk_bytes):
            for kind, counts in enumerate(Chunk(*_read(batch, hashes)).counts):
                yield from _asked(chunk, kind, counts, buckets)

    return lambda batches: _batches(rows(batches))


def _whole(chunk_bytes: int):
    """The chunks themselves, as part -1."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for chunk, batch in _chunks(batches, chunk_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(batch)
            yield -1, chunk, -1, sink.getvalue().to_pybytes(), None, None

    return lambda batches: _batches(rows(batches))


def _groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[tuple]]:
    """Neighbouring rows that agree in column ``by``."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][by] != row[by]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a chunk's keys with their counts over all chunks instead.

    Of each range of words, part -2 has the number of distinct ones, and of tokens in all texts and in the target's.
    """

    def rows() -> Iterator[tuple]:
        for held in _groups(batches, 0):
            asked = [np.cumsum(unpack(r[3], np.uint64), dtype=np.uint64) for r in held]
            keys, at = np.unique(np.concatenate(asked), return_inverse=True)
            n, n_target = (np.bincount(at, weights=np.concatenate([unpack(r[k], np.uint32) for r in held]), minlength=len(keys)).astype(np.uint64) for k in (4, 5))
            if held[0][2] % 2 == 0:
                yield held[0][0], -1, -2, np.array([len(keys), n.sum(), n_target.sum()], np.int64).tobytes(), None, None
            begin = 0
            for r, own in zip(held, asked, strict=True):
                own = at[begin : begin + len(own)]
                begin += len(own)
                yield r[0], r[1], r[2], mark(keys[own]), pack(n[own]), pack(n_target[own])

    return _batches(rows())


class Model:
    """Interpolated bigram model: (c(v, w) + a P(w)) / (c(v) + a), P(w) = (c(w) + b / V) / (N + b).

    words and bigrams are counts of those that are looked up; where these aren't all, total is N and distinct is V.
    """

    def __init__(self, words: np.ndarray, bigrams: np.ndarray, scale: float = 1.0, total: float | None = None, distinct: int | None = None):
        self.scale, self.words, self.bigrams = scale, words * scale, bigrams * scale
        self.total, self.distinct = (self.words.sum() if total is None else total * scale), distinct or len(words)
        self.word = (self.words + WORD_PRIOR / self.distinct) / (self.total + WORD_PRIOR)

    def losses(self, word: np.ndarray, pair: np.ndarray, follows: np.ndarray, own: tuple[np.ndarray, ...]) -> np.ndarray:
        """Natural log losses of tokens, given the unscaled counts of what is before each. own: how often the token's word,
        pair, what is before it, and all tokens come in its text, where the model was counted on that; these go out."""
        own_word, own_pair, own_follows, own_total = (self.scale * x for x in own)
        p = (np.maximum(self.words[word] - own_word, 0) + WORD_PRIOR / self.distinct) / (np.maximum(self.total - own_total, 0) + WORD_PRIOR)
        top = np.maximum(self.bigrams[pair] - own_pair, 0) + BIGRAM_PRIOR * p
        return -np.log(top / np.maximum(np.maximum(self.scale * follows - own_follows, 0) + BIGRAM_PRIOR, top))


def _times(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often each token's ``at`` comes in its text."""
    _, where, n = np.unique(text * (int(at.max(initial=0)) + 1) + at, return_inverse=True, return_counts=True)
    return n[where].astype(np.float64)


def _check(parts: list[tuple], counts: list[tuple[np.ndarray, ...]], buckets: int) -> None:
    """That the answers (by bucket and kind) are to this chunk's own words and pairs, else the texts were read in another order."""
    got = {r[2]: r[3] for r in parts}
    for kind, (keys, *_) in enumerate(counts):
        bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            if got.pop(2 * b + kind, None) != mark(keys[cuts[b] : cuts[b + 1]]):
                raise ValueError("the texts came in another order when they were read again")
    if got:
        raise ValueError("the texts came in another order when they were read again")


def _score(distinct: int, total: int, total_target: int, starts: tuple[int, int], buckets: int):
    """starts: how many texts with words there are, and how many of them are the target's."""

    def of(held: list[tuple], hashes: WordHashes) -> pa.RecordBatch:
        whole, *parts = sorted(held, key=lambda r: r[2])
        if whole[2] != -1:
            raise ValueError("the texts came in another order when they were read again")
        batch = pa.ipc.open_stream(whole[3]).read_next_batch()
        texts, wanted = _read(batch, hashes)
        chunk = Chunk(texts, wanted)
        sizes, word, pair = chunk.sizes, chunk.word, chunk.pair
        # counts of words and of pairs, in the order of the chunk's own
        (words, words_target), (pairs, pairs_target) = (
            [np.concatenate([np.zeros(0), *(unpack(r[k], np.uint64) for r in parts if r[2] % 2 == kind)]) for k in (4, 5)] for kind in (0, 1)
        )
        _check(parts, chunk.counts, buckets)
        text = np.repeat(np.arange(len(sizes)), sizes)
        first = np.zeros(len(word), bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        before = np.concatenate([[0], word[:-1]])[: len(word)]
        own_word = _times(text, word)
        own = (own_word, _times(text, pair), np.where(first, 1.0, np.concatenate([[0.0], own_word[:-1]])[: len(word)]), sizes[text].astype(float))
        follows = [np.where(first, n, c[before]) for n, c in zip(starts, (words, words_target), strict=True)] if len(word) else [np.zeros(0)] * 2
        background = Model(words, pairs, total_target / total if total and total_target else 1.0, total, distinct)
        b = background.losses(word, pair, follows[0], own)
        a = Model(words_target, pairs_target, 1.0, total_target, distinct).losses(word, pair, follows[1], tuple(x * wanted[text] for x in own)) if total_target else b
        none = sizes == 0
        means = [np.bincount(text, weights=x, minlength=len(sizes)) / np.maximum(sizes, 1) for x in (a, b, b - a)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes), *[pa.array(x, pa.float64(), mask=none) for x in means]],
            names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for held in _groups(batches, 1):
            yield of(held, hashes)

    return run


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, chunk_bytes: int = CHUNK, bucket_bytes: int = BUCKET) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of each row of ``docs``.

    The background model is counted over all texts, the target model over the texts whose doc_id is in ``target_ids``.
    They are matched: one vocabulary (all words of all texts), one order, one smoothing, and background counts scaled to
    the target's number of tokens, so that smoothing weighs equally in both. A text's own words and pairs are left out of
    the counts that score it, so target texts gain nothing from having been counted. score is the mean over tokens of
    background loss less target loss: higher is more like the target.

    All words and pairs are counted, whatever their number. Texts are taken in chunks; a chunk sends its distinct words
    and pairs to the ranges of their hashes, each of ``bucket_bytes`` of the texts, and gets back their counts over all
    chunks; the texts are read a second time for it, and ``docs`` must then come in the same order, as files do. An answer names
    the keys that it is for, by a 128-bit hash, so a chunk of other words or pairs raises an error. So nothing that grows with the vocabulary is broadcast or reaches the driver. Words and pairs are told apart
    by 64-bit hashes. Empty and null texts have 0 tokens and null losses and score. With no target texts both models are
    the background and all scores are 0. Null ids are never targets; repeated rows count and score as often as they come,
    each without its own counts only; ids may have any type; other columns are ignored.
    """
    wanted = target_ids.select(F.col("doc_id").alias("w_id"), F.lit(True).alias("target")).where("w_id is not null").distinct()
    flags = checkpoint(docs.select("doc_id").join(wanted, F.col("doc_id") == F.col("w_id"), "left_semi").distinct())
    few = flags.count() <= 2_000_000  # ids only: 16 MB at most are broadcast, else the join shuffles
    flags = flags.select(F.col("doc_id").alias("w_id"), F.lit(True).alias("target"))
    texts = docs.select("doc_id", "text").join(F.broadcast(flags) if few else flags, F.col("doc_id") == F.col("w_id"), "left").select("doc_id", "text", "target", F.spark_partition_id().alias("task"))
    if not few:  # rows of a shuffle come in another order each time, and chunks are read twice
        texts = checkpoint(texts)

    some = F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), 1).otherwise(0)
    size, starts, starts_target = texts.agg(F.sum(F.octet_length("text")), F.sum(some), F.sum(F.when(F.col("target"), some))).first()
    buckets = max(1, (size or 0) // bucket_bytes)
    asked = texts.mapInArrow(_ask(chunk_bytes, buckets), ROWS).repartition(2 * buckets, "bucket").sortWithinPartitions("bucket")
    answered = checkpoint(asked.mapInArrow(_answer, ROWS))
    sums = [np.frombuffer(r["keys"], np.int64) for r in answered.where("part = -2").select("keys").collect()]  # a row for each range
    distinct, total, total_target = np.sum([np.zeros(3, np.int64), *sums], axis=0).tolist()
    answered = answered.where("part >= 0").unionByName(texts.mapInArrow(_whole(chunk_bytes), ROWS)).repartition(2 * buckets, "chunk").sortWithinPartitions("chunk")
    return answered.mapInArrow(
        _score(max(distinct, 1), total, total_target, (starts or 0, starts_target or 0), buckets),
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, target_loss double, background_loss double, score double",
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` scored against those that ``labels`` marks as of good quality."""
    good = read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return cross_entropy_difference(read_table(spark, sf_dir, "documents"), good)
