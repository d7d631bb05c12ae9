"""Vector search: exact, over int8 codes, and over the nearest cells of a clustering.

Exact search multiplies blocks of vectors by all queries and keeps each block's best
k for each query, so what is shuffled is k rows a block and query, not a row a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackwater.functions import vectors as V
from brackwater.operators.lexical import FOUND, best, ranked
from brackwater.schema import SCORE_DIGITS
from brackwater.sources.shared import stored

QUERY_BYTES = 32 << 20
#: Scores of a batch of vectors for some of the queries, which a worker holds a few times.
SCORE_BYTES = 8 << 20
#: Recall that approximate search aims at, and how many queries it is measured on.
RECALL = 0.9
HELD = 256


def query_blocks(queries: DataFrame, block_bytes: int = QUERY_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the queries, by dimension and in blocks of bounded size."""
    shape = queries.where("vector is not null").groupBy(F.size("vector").alias("dim")).count().where("dim > 0").orderBy("dim").collect()
    for dim, count in shape:
        blocks = max(1, -(-count * dim * 8 // block_bytes))
        own = queries.where(F.size("vector") == dim).select("query_id", "vector")
        for b in range(blocks):
            got = own.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
            if got.num_rows:
                rows, x = V.matrix(got["vector"].combine_chunks(), dim)
                yield got["query_id"].to_numpy()[rows], x


def scan(corpus: DataFrame, queries: DataFrame, k: int, quantised: bool = False) -> DataFrame:
    """(domain_id, query_id, chunk_id, score, rank): the k vectors of each domain of highest cosine for each query.

    corpus has domain_id, chunk_id and embedding, queries query_id and vector. Zero
    vectors score 0. Vectors of another dimension than the query's are passed over.
    ``quantised`` compares the query with the int8 codes of the corpus. A block of
    queries beyond QUERY_BYTES is a scan of its own.
    """
    spark = corpus.sparkSession
    out = None
    for ids, x in query_blocks(queries):
        sent = spark.sparkContext.broadcast((ids, V.normalise_rows(x)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            for batch in batches:
                domain, chunk = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                rows, x = V.matrix(batch.column(2), q.shape[1])
                x = V.quantise_rows(x).astype(float) / V.SCALE if quantised else V.normalise_rows(x)
                for d in np.unique(domain[rows]):
                    own = np.flatnonzero(domain[rows] == d)
                    for query, found, score in nearest_of(x[own], chunk[rows[own]], q, k):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), d)), pa.array(names[query]), pa.array(found), pa.array(score)], ["domain_id", "query_id", "chunk_id", "score"])

        found = corpus.select(F.col("domain_id").cast("long"), F.col("chunk_id").cast("long"), "embedding").where("embedding is not null").mapInArrow(run, FOUND)
        out = found if out is None else out.unionAll(found)
    if out is None:
        out = spark.createDataFrame([], FOUND)
    return ranked(out, k, ("domain_id", "query_id"))


def nearest_of(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, id, score) of the k rows of x nearest to each row of q, for as many of them at a time as SCORE_BYTES hold."""
    step = max(1, SCORE_BYTES // (8 * len(x)))
    for a in range(0, len(q), step):
        score = np.round(x @ q[a : a + step].T, SCORE_DIGITS) + 0.0
        r, c = best(score, ids, k)
        yield a + c, ids[r], score[r, c]


def approximate(corpus: DataFrame, queries: DataFrame, k: int, allowed=None) -> DataFrame:
    """As scan(), by the cells of each domain; a predicate filters inside the cells that are read."""
    out = None
    for (domain_id,) in corpus.select("domain_id").distinct().orderBy("domain_id").collect():
        found = Cells.build(corpus.where(F.col("domain_id") == domain_id)).search(queries, k, allowed=allowed)
        found = found.select(F.lit(domain_id).cast("long").alias("domain_id"), "query_id", "chunk_id", "score", "rank")
        out = found if out is None else out.unionByName(found)
    return corpus.sparkSession.createDataFrame([], FOUND + ", rank int") if out is None else out


class Cells:
    """Approximate search: unit vectors by their nearest centroid, of which as many cells are read for a query as the recall needs."""

    def __init__(self, centroids: np.ndarray, rows: DataFrame):
        self.centroids, self.rows = centroids, rows

    @classmethod
    def build(cls, corpus: DataFrame, cells: int | None = None, seed: int = 1, max_cells: int = 4096) -> Cells:
        """Cluster the unit vectors of corpus; about the root of their number of cells if none is given."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        unit = corpus.where("embedding is not null").withColumn("unit", V.unit(F.col("embedding")))
        count = unit.count()
        cells = max(1, min(cells or math.isqrt(count), max_cells, count))
        if cells == 1:
            return cls(np.zeros((1, 1)), unit.drop("unit").withColumn("cell", F.lit(0)))
        fitted = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="v", predictionCol="cell").fit(unit.withColumn("v", array_to_vector("unit")))
        centers = np.array(fitted.clusterCenters())
        return cls(centers, stored(fitted.transform(unit.withColumn("v", array_to_vector("unit"))).drop("v", "unit"), "cells"))

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n cells nearest to each of the unit vectors x."""
        if len(self.centroids) == 1:
            return np.zeros((len(x), 1), np.int64)
        d = (self.centroids**2).sum(axis=1) - 2 * x @ self.centroids.T
        return np.argsort(d, axis=1, kind="stable")[:, :n]

    def fits(self, dim: int) -> bool:
        """Whether vectors of this dimension can be asked for; a single cell takes any."""
        return len(self.centroids) == 1 or dim == self.centroids.shape[1]

    def probes_for(self, rows: DataFrame, queries: DataFrame, k: int, recall: float = RECALL) -> int:
        """The fewest cells that give the recall@k against the exact scan, measured on HELD of the queries.

        Where there are more queries than that, two standard errors above it.
        """
        total = len(self.centroids)
        if total == 1:
            return 1
        held = queries.where("vector is not null").orderBy(F.xxhash64("query_id"), "query_id").limit(HELD + 1).select("query_id", "vector")
        held = stored(held, "held")
        all_held = held.count() <= HELD
        exact = scan(rows.withColumn("domain_id", F.lit(0)), held, k).select("query_id", "chunk_id")
        cells: dict[int, list] = {}
        for query, cell in rows.select("chunk_id", "cell").join(F.broadcast(exact), "chunk_id").select("query_id", "cell").collect():
            cells.setdefault(query, []).append(cell)
        shares = []
        for ids, x in query_blocks(held):
            if not self.fits(x.shape[1]):
                continue
            place = np.argsort(self.nearest(V.normalise_rows(x), total), axis=1)
            for row, query in enumerate(ids.tolist()):
                if query in cells:
                    # share of this query's hits that each number of cells gives
                    shares.append(np.bincount(place[row, cells[query]], minlength=total).cumsum() / len(cells[query]))
        if not shares:
            return 1
        shares = np.array(shares)
        least = shares.mean(axis=0) - (0 if all_held else 2 * shares.std(axis=0) / math.sqrt(len(shares)))
        return int(np.argmax(least >= recall - 1e-9)) + 1

    def search(self, queries: DataFrame, k: int, probes: int | None = None, allowed=None) -> DataFrame:
        """(query_id, chunk_id, score, rank) of the k best in the cells nearest to each query.

        As many cells as probes_for() measures, if no number is given. While a query has
        fewer than k hits its cells are doubled, up to all of them, when the result is
        exact. ``allowed`` is a predicate on the corpus columns. Vectors of another
        dimension than the query's are passed over.
        """
        rows = self.rows if allowed is None else self.rows.where(allowed)
        total, done, pending = len(self.centroids), None, queries.where("vector is not null")
        probes = self.probes_for(rows, pending, k) if probes is None else probes
        while True:
            probes = min(probes, total)
            found = ranked(self._scored(rows, pending, k, probes), k)
            if probes == total:
                return found if done is None else done.unionByName(found)
            found = stored(found, "hits")
            full = found.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
            settled = found.join(full, "query_id", "left_semi")
            done = settled if done is None else done.unionByName(settled)
            pending = pending.join(full, "query_id", "left_anti")
            if pending.isEmpty():
                return done
            probes *= 2

    def _scored(self, rows: DataFrame, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """(query_id, chunk_id, score) of the k best that each batch of rows has for each query in its cells."""
        spark, out = rows.sparkSession, None
        kind = "query_id long, chunk_id long, score double"
        for ids, x in query_blocks(queries):
            if not self.fits(x.shape[1]):
                continue
            x = V.normalise_rows(x)
            reads = np.zeros((len(self.centroids), -(-len(x) // 8)), np.uint8)  # a bit for each cell and query
            for a in range(0, len(x), 1024):
                some = np.zeros((len(x[a : a + 1024]), len(self.centroids)), bool)
                np.put_along_axis(some, self.nearest(x[a : a + 1024], probes), True, axis=1)
                reads[:, a // 8 : a // 8 + 128] = np.packbits(some.T, axis=1)
            sent = spark.sparkContext.broadcast((ids, x, reads))

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                names, q, reads = sent.value
                for batch in batches:
                    row, x = V.matrix(batch.column(1), q.shape[1])
                    if not len(row):
                        continue
                    chunk, cell = batch.column(0).to_numpy(zero_copy_only=False)[row], batch.column(2).to_numpy(zero_copy_only=False)[row]
                    order = np.argsort(cell, kind="stable")
                    chunk, cell, x = chunk[order], cell[order], V.normalise_rows(x[order])
                    own, first = np.unique(cell, return_index=True)
                    step = max(8, (32 << 20) // (8 * len(row)) // 8 * 8)
                    for a in range(0, len(q), step):
                        part = q[a : a + step]
                        read = np.unpackbits(reads[own, a // 8 : (a + step) // 8], axis=1, count=len(part)).astype(bool)
                        score = np.full((len(row), len(part)), -np.inf)
                        for c, b, e in zip(read, first, np.append(first[1:], len(row))):
                            asked = np.flatnonzero(c)
                            score[b:e, asked] = np.round(x[b:e] @ part[asked].T, SCORE_DIGITS) + 0.0
                        r, c = best(score, chunk, k)
                        real = np.isfinite(score[r, c])
                        r, c = r[real], c[real]
                        yield pa.RecordBatch.from_arrays([pa.array(names[a : a + step][c]), pa.array(chunk[r]), pa.array(score[r, c])], ["query_id", "chunk_id", "score"])

            found = rows.select(F.col("chunk_id").cast("long"), "embedding", "cell").mapInArrow(run, kind)
            out = found if out is None else out.unionAll(found)
        return spark.createDataFrame([], kind) if out is None else out
