"""Vectorised words, shingles and their hashes over Arrow string batches.

A word is a maximal run of ASCII letters, digits and non-ASCII code points of the
lower-cased text; everything else separates. Hashes are polynomial prefix sums
modulo 2**64 over random byte codes, finished by a mixing step, so a batch costs a
few numpy passes over its bytes and never a Python object per word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from brackwater.sources.shared import bound_batches

SLICE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random uint64 values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


BASE = 0x5851F42D4C957F2D
BASE_INVERSE = pow(BASE, -1, 1 << 64)
STEP = [np.uint64(pow(0xD6E8FEB86659FD93, j, 1 << 64)) for j in range(64)]
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = True
WORD_BYTE[128:] = True
CODE = stream(11, 256)
CODE[65:91] = CODE[97:123]
RAW_CODES = (stream(23, 256), stream(37, 256))

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, at least n of them."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((BASE, BASE_INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def utf8(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the len + 1 offsets into them; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    _, offsets, data = array.buffers()
    if len(array) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(array: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer text is a range of its own, whole."""
    _, at = utf8(array)
    row, n = 0, len(array)
    while row < n:
        end = min(n, max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1))
        yield row, end
        row = end


def folded(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As utf8(), lower-cased where the hash codes don't fold case themselves."""
    raw, at = utf8(array)
    if raw.size and raw.max() > 127:
        return utf8(pc.utf8_lower(array))
    return raw, at


def spans(raw: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of bytes in the class, cut at row ends, and each row's offset among them."""
    n = raw.size
    hit = np.zeros(n + 2, bool)
    hit[1:-1] = inside[raw]
    first = np.zeros(n + 1, bool)
    first[at] = True
    cut = hit[1:] & (~hit[:-1] | first)
    starts = np.flatnonzero(cut[:-1])
    ends = np.flatnonzero(hit[1:-1] & (~hit[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = CODE) -> np.ndarray:
    """A 64-bit hash of raw[start:end] for each span."""
    up, down = powers(raw.size + 1)
    sums = np.zeros(raw.size + 1, np.uint64)
    np.cumsum(codes[raw] * up[: raw.size], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, and the len + 1 offsets of the rows among them."""
    raw, at = folded(array)
    starts, ends, rows = spans(raw, at, WORD_BYTE)
    return span_hashes(raw, starts, ends), rows


def shingles(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words, and row offsets. A row of 1 to n - 1 words has one shingle of them all."""
    count = len(words)
    if not count:
        return words, rows
    lengths = np.diff(rows)
    end = np.repeat(rows[1:], lengths)
    place = np.arange(count)
    total = words.copy()
    for j in range(1, n):
        part = words[j:] * STEP[j]
        part[place[j:] >= end[: count - j]] = 0
        total[: count - j] += part
    keep = place + n <= end
    keep[rows[:-1][(lengths > 0) & (lengths < n)]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return mix(total[keep]), kept[rows]


def pair_hashes(words: np.ndarray, rows: np.ndarray, gap: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word pairs (i, i + gap) within rows, and the row of each."""
    count = len(words)
    if count <= gap:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    same = row[:-gap] == row[gap:]
    return mix(words[:-gap][same] * STEP[1] + words[gap:][same] * STEP[2] + np.uint64(salt)), row[:-gap][same]


def through(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], columns: int | None = None) -> DataFrame:
    """rows.mapInArrow(run) with the first ``columns`` columns for a result, whatever they are called."""
    bound_batches(rows.sparkSession)
    own = rows.schema.fields[:columns]
    plain = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(own)])
    return rows.toDF(*(f"c{k}" for k in range(len(rows.columns)))).mapInArrow(run, plain).toDF(*(f.name for f in own))
