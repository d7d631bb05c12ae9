"""Vector arithmetic: Column expressions for single pairs, numpy for blocks of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 127


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter length, in double."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length; 0 where either vector is empty or zero."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm).otherwise(F.when(a.isNotNull() & b.isNotNull(), F.lit(0.0)))


def unit(v: Column) -> Column:
    """v of length 1, in double; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def codes(v: Column) -> Column:
    """The unit vector in steps of 1/127, halves rounded away from zero."""
    step = F.transform(unit(v), lambda x: F.round(x * SCALE))
    return F.transform(step, lambda x: F.greatest(F.least(x, F.lit(127.0)), F.lit(-127.0)).cast("tinyint"))


def matrix(array: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, doubles) of the vectors that have this dimension and no null part."""
    size = pc.fill_null(pc.list_value_length(array), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size == dim)
    flat = array.take(pa.array(rows)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), dim)
    good = ~np.isnan(x).any(axis=1)
    return rows[good], x[good]


def normalise_rows(x: np.ndarray) -> np.ndarray:
    """Each row of length 1; zero rows stay."""
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def quantise_rows(x: np.ndarray) -> np.ndarray:
    """The codes of each row."""
    y = normalise_rows(x) * SCALE
    return np.clip(np.sign(y) * np.floor(np.abs(y) + 0.5), -SCALE, SCALE).astype(np.int8)
