"""What the training-data operators share: input tables, shared storage, word hashing on Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adtflow.sources.shared import discard, materialize, shared_dir  # noqa: F401 - what operators take from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------------------------------------------
# Words of an Arrow string column, hashed without a Python loop over them
# --------------------------------------------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _S33)
    h = h * _M1
    h ^= h >> _S33
    h *= _M2
    h ^= h >> _S33
    return h


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_VALUE = _BYTE_VALUE[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n; kept between batches."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        up = np.full(size, _BASE, dtype=np.uint64)
        down = np.full(size, _INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers[size]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the n+1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words(raw: np.ndarray, at: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document row of every maximal run of bytes that ``breaks`` doesn't mark (ASCII white space)."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~breaks[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    first = at[:-1][(at[:-1] < at[1:])]
    begins[first] = solid[first]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    last = at[1:][(at[:-1] < at[1:])] - 1
    ends[last] = solid[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(at, start, side="right") - 1


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of every word; ASCII capitals count as small letters if ``lower``."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((_LOWER_VALUE if lower else _BYTE_VALUE)[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of every run of ``n`` words of one document; a shorter document counts as one run."""
    rows = int(row[-1]) + 1 if len(row) else 0
    count = np.bincount(row, minlength=rows)
    first = np.cumsum(count) - count
    out, where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(h) >= n:
        m = len(h) - n + 1
        out = np.zeros(m, np.uint64)
        for k in range(n):
            out = mix(out + h[k : k + m] + np.uint64(k + 1))
        whole = row[:m] == row[n - 1 :]
        out, where = out[whole], row[:m][whole]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        few = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = count[short] > k
            few[has] = mix(few[has] + h[first[short[has]] + k] + np.uint64(k + 1))
        few = mix(few + count[short].astype(np.uint64) * _M1)
        out, where = np.concatenate([out, few]), np.concatenate([where, short])
        order = np.argsort(where, kind="stable")
        out, where = out[order], where[order]
    return out, where


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def batches(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow, with every Arrow batch bounded in bytes as well as rows by the session's settings."""
    return df.mapInArrow(function, schema)


def sub_batches(batch: pa.RecordBatch, column: str, limit: int = (1 << 21) - 64):
    """Slices of a batch with at most ``limit`` bytes of text each (one document at least)."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    total, begin = np.cumsum(lengths), 0
    while begin < batch.num_rows:
        base = total[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(begin, stop - begin)
        begin = stop


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
