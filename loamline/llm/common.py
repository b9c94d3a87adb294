"""Helpers shared by the operators of this subpackage: checkpoints, words in SQL and words in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.plans.lineage import checkpoint

__all__ = [
    "ALNUM_GAP", "ALNUM_TABLE", "SPACE_CLASS", "SPACE_WORD", "WordHashes", "alnum_words", "ascii_lower", "checkpoint",
    "count_space_words", "by_position", "limited", "mix", "read_table", "slices", "space_words", "text_hash",
]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: What separates words of letters and digits: ASCII that is neither; all beyond ASCII belongs to words.
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The same for bytes: A-Z become a-z, ASCII that is no letter or digit becomes a blank.
ALNUM_TABLE = bytes(
    c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256)
)


def limited(rows: DataFrame, most: int = 600_000) -> DataFrame:
    """A broadcast hint for a checkpointed table of narrow rows if it has at most ``most`` of them; else joins shuffle."""
    return F.broadcast(rows) if rows.count() <= most else rows


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; the built-in lower() is the same, and faster, on pure ASCII."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def alnum_words(text: Column) -> Column:
    """Lower-cased words of letters, digits and all characters beyond ASCII; a null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), ALNUM_GAP), "")


def space_words(text: Column) -> Column:
    """Words between blanks, tabs, line ends; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def count_space_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def by_position(docs: DataFrame) -> tuple[DataFrame, Column, Column, Callable[[DataFrame], DataFrame]]:
    """docs with its columns named d0, d1 ..., so that no name clashes with others; its id and text; and what names rows back."""
    names = docs.columns
    own = lambda c: F.col(f"d{names.index(c)}")
    return docs.toDF(*[f"d{i}" for i in range(len(names))]), own("doc_id"), own("text"), lambda rows: rows.select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(names)])


def text_hash(text: Column) -> Column:
    """Tells rows of one id apart by their text; a null text is an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class WordHashes(dict):
    """word -> 64-bit hash, remembered for the words seen last."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: Iterable[bytes]) -> np.ndarray:
        return np.array([self[w] for w in words], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def slices(batches: Iterable, text: str = "text", most_bytes: int = 4_000_000) -> Iterable:
    """Slices of Arrow batches whose texts hold about ``most_bytes`` at most, or one row."""
    for batch in batches:
        start, total = 0, 0
        for i, size in enumerate(_sizes(batch.column(text))):
            if i > start and total + size > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)


def _sizes(column) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_pylist()
