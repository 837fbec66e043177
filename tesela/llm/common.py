"""What the operators of this subpackage share: scratch tables, bounded batches and vectorised word hashes.

Words are maximal runs of bytes other than space and 0x09-0x0D, A-Z folded to lower case. A word is known by a 64-bit
hash of its bytes: two given words share one with a chance of 2**-64, so among a hundred million words a clash of any
two is expected once in about 3,700 corpora. All functions here treat null text as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import path as scratch_path
from ..scratch import saved

__all__ = ["scratch_path", "saved"]  # for the operators

#: Bytes of text that one numpy step works on; a longer text is a step of its own.
STEP_BYTES = 2_000_000


def fold(key: Column, of: int) -> Column:
    """The remainder that says which rows are held out; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(of))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- vectorised words

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_BASE = np.uint64(0x5851F42D4C957F2D)
_UNBASE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64))
_BYTE[65:91] = _BYTE[97:123]
_INK = np.ones(256, dtype=bool)
_INK[[9, 10, 11, 12, 13, 32]] = False
_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            _powers = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, _UNBASE))
    return _powers


def raw_text(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the len+1 offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def steps(column: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0), at most about `most` bytes or a single row each."""
    data, at = raw_text(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets of the rows' words) for rows of bytes data[at[i]:at[i+1]]."""
    start, end = bounds(data, at)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    power, undo = _grown(len(data))
    total = np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64)
    before = np.where(start > 0, total[start - 1], np.uint64(0))
    return mix((total[end - 1] - before) * undo[start] + (end - start).astype(np.uint64)), np.searchsorted(start, at)


def bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and ends."""
    ink = _INK[data]
    cut = at[(at > 0) & (at < len(data))]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    first[cut] = ink[cut]
    last[cut - 1] = ink[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def chained(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k consecutive hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = mix(h[:n])
    for j in range(1, k):
        out = mix(out * _M2 + h[j : j + n])
    return out


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; with fewer words, of the whole sequence."""
    h, w = words(data, at)
    runs = chained(h, k)
    for a, b in zip(w[:-1].tolist(), w[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(runs[a : b - k + 1])
        elif b > a:
            yield chained(h[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield runs[:0]


def arrow_batches(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)
