"""Shared plumbing of the corpus operators: folders, row keys, size-checked broadcasts, numpy views of Arrow text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import saved, shared_dir  # noqa: F401  the operators take them from here

#: Rows per Arrow batch; texts are long, so the default of 10,000 would hold too much at once.
ARROW_ROWS = 1000
#: Bytes of text that one numpy step looks at; its temporaries are some tens of times larger.
STEP_BYTES = 2_000_000
#: A side is broadcast only while its estimated bytes stay under this; beyond it the join shuffles.
BROADCAST_BYTES = 32_000_000


def arrow(df: DataFrame) -> DataFrame:
    """Before mapInArrow: keep the batches small enough for long texts."""
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return df


def checked_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if df, which must be cheap to count, is small; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df.hint("merge")


def row_key() -> F.Column:
    """128-bit identity of a document row: the MD5 of its id and its text. Rows equal in both share it; at 64 bits, rows
    would vanish by chance from 10^9 keys on."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text")]
    null = F.when(F.col("doc_id").isNull(), "n").otherwise("i"), F.when(F.col("text").isNull(), "n").otherwise("t")
    return F.unhex(F.md5(F.concat(null[0], part[0], F.lit(" "), null[1], part[1])))


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs without the rows whose row_key is in keys(_key)."""
    at = fresh(docs)
    return docs.withColumn(at, row_key()).join(checked_broadcast(keys.select(F.col("_key").alias(at)), 64), at, "left_anti").drop(at)


def fresh(df: DataFrame) -> str:
    """A column name that df doesn't have."""
    return "_" * (1 + max((len(c) for c in df.columns), default=0))


def text_buffer(arr: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array and the offsets of its values; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    if lower:
        arr = pc.utf8_lower(arr)
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES):
    """Ranges (lo, hi) of whole documents holding at most so many bytes, or one document."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_MIX = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
_MIX ^= _MIX >> np.uint64(29)
_PRIME = np.uint64(0x100000001B3)
_POWERS = np.cumprod(np.full(4096, _PRIME, np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of lower-case letters, digits and non-ASCII bytes) of the documents in buf[offsets[0]:offsets[-1]].

    Returns starts and ends in buf, 64-bit hashes, and the bounds: words bounds[d]:bounds[d+1] are those of document d.
    """
    base, part = int(offsets[0]), buf[offsets[0] : offsets[-1]]
    n = len(part)
    inside = np.zeros(n + 1, bool)
    inside[:n] = WORD[part]
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: n - 1]
    cut = offsets[1:-1] - base
    cut = cut[(cut > 0) & (cut < n)]
    begins[cut] = inside[cut]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts, starts, starts.astype(np.uint64), np.zeros(len(offsets), np.int64)
    finish = inside[:n] & ~inside[1:]
    inner = cut[(inside[cut - 1]) & inside[cut]] - 1
    finish[inner] = True
    ends = np.flatnonzero(finish) + 1
    # hash: sum of mixed bytes times powers of a prime by place in the word, taken only over word bytes
    at = np.flatnonzero(inside[:n])
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(at)) - np.repeat(first, lengths)
    h = np.add.reduceat(_MIX[part[at]] * _POWERS[place & 4095], first)
    return starts + base, ends + base, mix(h + lengths.astype(np.uint64)), np.searchsorted(starts + base, offsets)


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """The words' hashes of each text, for small sides and tests."""
    buf, off = text_buffer(pa.array(texts, pa.string()))
    _, _, h, bounds = words(buf, off)
    return [h[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def shingles(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words within each document, and the index of each run's first word."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * _PRIME + h[k : len(h) - n + 1 + k]
    ok = np.ones(len(out), bool)
    for k in range(1, n):
        at = bounds[1:-1] - k
        ok[at[(at >= 0) & (at < len(ok))]] = False
    first = np.flatnonzero(ok)
    return mix(out[first]), first


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[d]:bounds[d+1]] for each d; empty ranges give zero."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full], axis=0)
    return out
