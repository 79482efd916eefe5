"""What several of these operators share: words, hashes of words, staged tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import write_stage

# A word is a run of letters, digits and their marks, in lower case.  In scripts written
# without spaces every character is a word.  Both forms below give the same words.
UNSPACED_SCRIPTS = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")
SEPARATOR = r"[^\p{L}\p{N}\p{M}]+"
ASCII_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UNSPACED = "[" + "".join(rf"\p{{Is{name}}}" for name in UNSPACED_SCRIPTS) + "]"
SHINGLE_WORDS = 5
SIMILARITY = 0.8


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for null and for wordless texts."""
    low = F.lower(F.coalesce(text, F.lit("")))
    apart = F.when(low.rlike(_UNSPACED), F.regexp_replace(low, _UNSPACED, " $0 ")).otherwise(low)
    # Most texts are ASCII, where a plain class tells the same signs apart much faster.
    ascii_only = F.octet_length(low) == F.char_length(low)
    found = F.when(ascii_only, F.split(low, ASCII_SEPARATOR)).otherwise(F.split(apart, SEPARATOR))
    return F.filter(found, lambda w: w != "")


def word_hashes(text: Column) -> Column:
    """One 64-bit hash per word."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def shingle_at(hashes: Column, value: Column, index: Column, size: int = SHINGLE_WORDS) -> Column:
    """Hash of the `size` words from `index` on, whose first hash is `value`."""
    return F.xxhash64(value, *[F.get(hashes, index + k) for k in range(1, size)])


def shingles(hashes: Column, size: int = SHINGLE_WORDS) -> Column:
    """Hash of every run of `size` words; a shorter text is one shingle of all its words.

    `hashes` should be a plain column: it is read several times per shingle.
    """
    run = F.transform(hashes, lambda value, i: shingle_at(hashes, value, i, size))
    return F.slice(run, 1, F.greatest(F.lit(1), F.size(hashes) - (size - 1)))


def fits(df: DataFrame, max_bytes: int) -> bool:
    """Whether Spark's own estimate of a staged table's size is within the bound."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return int(str(plan.stats().sizeInBytes())) <= max_bytes


def bounded_broadcast(df: DataFrame, max_bytes: int = 8 << 20) -> DataFrame:
    """Broadcast a staged table that its files prove small; else let Spark shuffle it."""
    return F.broadcast(df) if fits(df, max_bytes) else df


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: later steps survive lost executors."""
    return write_stage(df, f"llm-{name}")


def splits_for(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# ---- the same words and hashes over Arrow batches, in numpy ----

SLICE_ROWS, SLICE_BYTES = 500, 2 << 20


def slices(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows and bytes, so that a task's memory is bounded by
    them or by its longest text, however large Spark makes its batches."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            until = int(np.searchsorted(ends, before + SLICE_BYTES, "right"))
            until = max(at + 1, min(until, at + SLICE_ROWS))
            yield batch.slice(at, until - at)
            at = until

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[48:58] = _WORD_BYTE[97:123] = _WORD_BYTE[128:] = True
_SCRIPTS = "[" + "".join(rf"\p{{Script={name}}}" for name in UNSPACED_SCRIPTS) + "]"
_UNSPACED_CHAR = regex.compile(_SCRIPTS)
_OTHER_SIGNS = regex.compile(r"[^\x00-\x7F\p{L}\p{N}\p{M}]+")


def word_text(text: str) -> str:
    """The text in lower case, with words apart by ASCII signs only."""
    low = text.lower()
    if low.isascii():
        return low
    if _OTHER_SIGNS.search(low):
        low = _OTHER_SIGNS.sub(" ", low)
    try:
        low.encode("latin-1")  # quickly tells most texts without such scripts
    except UnicodeEncodeError:
        low = _UNSPACED_CHAR.sub(r" \g<0> ", low)
    return low


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values (the splitmix64 finalizer)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64))
_BASE = 0xD6E8FEB86659FD93
_SLICE = 1 << 20


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n + 1, base, dtype=np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash, modulo 2**64 and then mixed, of the words that lie in `data`."""
    n = 1 << max(16, int(len(data)).bit_length())  # few sizes, so that powers are found again
    powers, inverses = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_HASH[data] * powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def batch_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, and the offset of each text's first word.

    Bytes are hashed in slices of about a megabyte that end with a word, so that a very
    long text needs little more memory than itself and its words' hashes.
    """
    parts = [word_text(t).encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join([*parts, b""]), dtype=np.uint8)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _WORD_BYTE[data]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    hashes = np.empty(len(starts), dtype=np.uint64)
    a = 0
    while a < len(starts):
        low = starts[a]
        b = max(a + 1, int(np.searchsorted(ends, low + _SLICE, "right")))
        hashes[a:b] = _word_hashes(data[low : ends[b - 1]], starts[a:b] - low, ends[a:b] - low)
        a = b
    text_starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=text_starts[1:])
    return hashes, np.searchsorted(starts, text_starts)


def text_shingles(hashes: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Shingle hashes of one text's words, as `shingles` counts them."""
    n = len(hashes)
    if n == 0:
        return hashes
    if n < size:
        hashes = np.concatenate([hashes, np.zeros(size - n, dtype=np.uint64)])
    last = len(hashes) - size + 1
    total = np.zeros(last, dtype=np.uint64)
    for k in range(size):
        total = mix(total * _MULTIPLIER + hashes[k : k + last])
    return total
