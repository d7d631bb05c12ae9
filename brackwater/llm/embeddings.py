"""Near-duplicate embeddings by random-hyperplane sign hashing.

Each table signs a vector against its own hyperplanes. The bits of a table grow with
the logarithm of the number of vectors, so that strangers share a bucket about as
rarely at any size, and the number of tables follows from the bits: as many as find a
pair at the threshold with the wanted recall. What shares a bucket is judged there by a
sketch of more signs, three standard deviations to either side; pairs that may hold are
verified by their exact cosine and closed to groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackwater.llm import words as W
from brackwater.llm.buckets import bucket_pairs
from brackwater.llm.components import connected
from brackwater.llm.scratch import Scratch
from brackwater.sources.shared import spread

COSINE = 0.95
RECALL = 0.97
SPARE_BITS = 2
SKETCH = 256


def layout(count: int, cosine: float, recall: float) -> tuple[int, int]:
    """(bits, tables) for so many vectors."""
    bits = max(8, math.ceil(math.log2(max(2, count))) - SPARE_BITS)
    same = (1 - math.acos(min(1.0, cosine)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-same))) if same < 1 else 1


def planes(dim: int, count: int, first: int) -> np.ndarray:
    """dim x count standard normal hyperplanes, the same in every task."""
    u = (W.stream((31 + dim + 1000 * first) % (1 << 62), 2 * dim * count) >> np.uint64(11)).astype(float) / 2**53
    u = u.reshape(2, dim, count)
    return np.sqrt(-2 * np.log(1 - u[0])) * np.cos(2 * np.pi * u[1])


def matrices(array: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) by dimension, of the rows that have a direction."""
    size = pa.compute.fill_null(pa.compute.list_value_length(array), 0).to_numpy(zero_copy_only=False)
    for dim in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == dim)
        flat = array.take(pa.array(rows)).flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), dim)
        with np.errstate(all="ignore"):
            norm = np.sqrt((x * x).sum(axis=1))
        good = np.isfinite(norm) & (norm > 0)
        if good.any():
            yield rows[good], x[good] / norm[good, None]


def groups(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, scratch: Scratch | None = None) -> DataFrame:
    """(vec_id, group_id, kept) of each vector with another of at least this cosine to it, closed to groups.

    group_id is the least vec_id of the group, which is the one kept; a null vec_id
    comes last. Only vectors of one dimension are compared. Null, empty and zero
    vectors and those with null or infinite parts have no near copies. Rows that repeat
    vector and vec_id are one; equal vectors of different ids are near copies. An empty
    table gives an empty result; other columns are not read.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "embeddings")
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("v is not null")
    rows = rows.withColumn("node", F.xxhash64("v"))
    bits, tables = layout(rows.count(), cosine, recall)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, np.ndarray] = {}
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for at, x in matrices(batch.column(1)):
                for t in range(tables):
                    if (x.shape[1], t) not in known:
                        known[x.shape[1], t] = planes(x.shape[1], bits, t)
                    sign = (x @ known[x.shape[1], t] > 0).astype(np.uint64)
                    key = np.full(len(at), t * 131 + x.shape[1], np.uint64)
                    for b in range(0, bits, 32):
                        key = W.mix(key + (sign[:, b : b + 32] << np.arange(min(32, bits - b), dtype=np.uint64)).sum(axis=1, dtype=np.uint64) + W.STEP[1])
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(nodes[at])], ["key", "node"])

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector with a direction, with its dimension and SKETCH more signs."""
        for batch in batches:
            for at, x in matrices(batch.column(1)):
                sign = np.packbits(x @ planes(x.shape[1], SKETCH, -1) > 0, axis=1)
                own = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(len(at), x.shape[1], np.int32)), pa.array([r.tobytes() for r in sign], pa.binary())], ["node", "v", "dim", "sketch"])

    def judge_of(part: pa.RecordBatch):
        dim = part.column(2).to_numpy()
        words = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint64).reshape(part.num_rows, -1)
        differ = math.acos(min(1.0, cosine)) / math.pi
        mean, slack = SKETCH * differ, 3 * math.sqrt(SKETCH * differ * (1 - differ))

        def judge(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            apart = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64)
            return (dim[i] == dim[j]) & (apart <= mean + slack), (dim[i] == dim[j]) & (apart <= mean - slack)

        return judge

    def close_enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k).flatten().to_numpy() for k in (2, 3))
            size = pa.compute.list_value_length(batch.column(2)).to_numpy()
            cut = np.concatenate([[0], np.cumsum(size)])[:-1]
            dot, xx, yy = (np.add.reduceat(v, cut) for v in (x * y, x * x, y * y))
            yield batch.select(["a", "b"]).filter(pa.array(dot >= (cosine - 1e-9) * np.sqrt(xx * yy)))

    distinct = scratch.save(rows.groupBy("node").agg(F.first("v").alias("v")).mapInArrow(sketched, "node long, v array<double>, dim int, sketch binary"), "vectors")
    bucket = Window.partitionBy("key")
    keys = distinct.select("node", "v").mapInArrow(keyed, "key long, node long")
    near = scratch.save(keys.withColumn("lo", F.min("node").over(bucket)).withColumn("hi", F.max("node").over(bucket)).where("lo < hi").select("key", "node"), "near")
    sorted_near = near.join(distinct.select("node", "dim", "sketch"), "node").select("key", "node", "dim", "sketch").repartition("key").sortWithinPartitions("key", F.xxhash64("node"))
    pairs = scratch.save(sorted_near.mapInArrow(lambda batches: bucket_pairs(batches, judge_of), "a long, b long").distinct(), "pairs")
    both = (
        pairs.join(distinct.select(F.col("node").alias("a"), F.col("v").alias("x")), "a")
        .join(distinct.select(F.col("node").alias("b"), F.col("v").alias("y")), "b").select("a", "b", "x", "y")
    )
    component = connected(scratch.save(both.mapInArrow(close_enough, "a long, b long"), "edges"), scratch)
    # equal vectors are copies if they have a direction, which their keys tell
    directed = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    placed = (
        rows.where(directed.isNotNull() & (directed > 0) & (directed < float("inf"))).select("vec_id", "node").distinct()
        .join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
        .withColumn("n", F.count("*").over(Window.partitionBy("component"))).where("n > 1")
    )
    w = Window.partitionBy("component").orderBy(F.col("vec_id").asc_nulls_last(), "node")
    return placed.select("vec_id", F.first("vec_id").over(w).alias("group_id"), (F.row_number().over(w) == 1).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies in the whole embeddings table."""
    return groups(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id"))


#: The same by comparing every pair of vectors.
SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, len(e) AS dim, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v WHERE list_dot_product(e, e) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.dim = b.dim AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) >= 0.95 - 1e-9),
reached AS (SELECT a AS root, a AS vec_id FROM pairs UNION SELECT r.root, p.b FROM reached r JOIN pairs p ON p.a = r.vec_id)
SELECT vec_id, min(root) AS group_id, min(root) = vec_id AS kept FROM reached GROUP BY vec_id
"""
