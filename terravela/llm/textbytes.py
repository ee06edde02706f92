"""numpy helpers over the UTF-8 buffers of Arrow string columns: words, their hashes, and word shingles.

All functions work on bounded slices of a batch, so that memory follows the slice and not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that one numpy pass works on (a single longer text makes a slice of its own).
SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_powers: dict[str, np.ndarray] = {}


def short_batches(df: DataFrame, rows: int = 2000) -> DataFrame:
    """df, with the session's Arrow batches held to so many rows, so that batches of long texts stay small on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= rows:
        df.sparkSession.conf.set(name, str(rows))
    return df


def type_of(df: DataFrame, column: str) -> str:
    """The type of a column as it stands in a schema text."""
    return df.schema[column].dataType.simpleString()


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts have about `most` bytes together."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
    block = (np.cumsum(sizes) - 1).clip(0) // most
    edges = np.flatnonzero(np.diff(block)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
        yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) one after another, and their n + 1 offsets."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes that aren't separators, never across rows."""
    inside = ~separator[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(21, (n - 1).bit_length())
        have = np.full(size, _U(base), _U)
        have[0] = 1
        have = _powers[name] = np.multiply.accumulate(have)
    return have[:n]


class SpanHash:
    """Polynomial hashes (mod 2**64, then mixed) of any spans of a code sequence after one pass."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        inverse = pow(_BASE, -1, 1 << 64)
        value = mix(codes.astype(_U) + _U(0x51ED270B))
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(value * _power("down", inverse, n + 1)[:n], out=self.sums[1:])
        self.up = _power("up", _BASE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(_U))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return SpanHash(data).of(start, end)


def shingles(hashes: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row as (row, hash), sorted; a row of 1 to k-1 words is one shingle."""
    factor = [mix(np.array([i + 1], _U))[0] | _U(1) for i in range(k)]
    count = np.bincount(row, minlength=n_rows)
    begin = np.cumsum(count) - count
    rows, values = [], []
    if len(hashes) >= k:
        whole = row[: len(row) - k + 1] == row[k - 1 :]
        n = len(hashes) - k + 1
        total = np.zeros(n, _U)
        for i in range(k):
            total += hashes[i : i + n] * factor[i]
        rows.append(row[:n][whole])
        values.append(mix(total[whole]))
    for length in range(1, k):
        short = np.flatnonzero(count == length)
        if len(short):
            total = np.full(len(short), _U(length * 0x632BE59BD9B4E019 % (1 << 64)), _U)
            for i in range(length):
                total += hashes[begin[short] + i] * factor[i]
            rows.append(short)
            values.append(mix(total))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    r, v = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((v, r))
    r, v = r[order], v[order]
    keep = np.ones(len(r), bool)
    keep[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return r[keep], v[keep]
