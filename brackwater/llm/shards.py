"""Sharding: a minimax contiguous partition of ordered atomic groups.

Copies of one text are a group and never parted; groups come in the order of their
least doc_id. The smallest capacity for which greedy filling needs at most the wanted
number of shards is found by binary search, and the groups are cut there. The sorted
group sizes stay in a shared table; the driver holds one total for each block of
groups and a bounded number of blocks, which a greedy step looks up. Blocks are read
many at a time: with one that is missing those that the later shards will end in, if
each is filled.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brackwater.llm.scratch import Scratch

SHARDS = 64
BLOCK = 1 << 14
BLOCKS_HELD = 256


class Sizes:
    """Group sizes in order, read by blocks."""

    def __init__(self, totals: np.ndarray, counts: np.ndarray, fetch: Callable[[list[int]], dict[int, np.ndarray]]):
        self.before = np.concatenate([[0], np.cumsum(totals)])
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.fetch = fetch
        self.held: OrderedDict[int, np.ndarray] = OrderedDict()

    def block(self, b: int, later: list[int]) -> np.ndarray:
        """The running totals in a block; if it has to be read, so are those of the others that aren't held."""
        if b not in self.held:
            wanted = list(dict.fromkeys([b, *(k for k in later if k not in self.held)]))[:BLOCKS_HELD]
            found = self.fetch(wanted)
            for k in reversed(wanted):
                self.held[k] = np.cumsum(found[k])
            while len(self.held) > BLOCKS_HELD:
                self.held.popitem(last=False)
        self.held.move_to_end(b)
        return self.held[b]

    def at(self, limit: int) -> int:
        """The block that a running total falls in; one more than there are beyond them all."""
        return int(np.searchsorted(self.before, limit, "right")) - 1

    def reach(self, limit: int, capacity: int, left: int) -> tuple[int, int]:
        """(groups, their total) of the longest prefix whose total is at most the limit; so many shards of this capacity may follow."""
        b, last = self.at(limit), len(self.before) - 1
        if b >= last:
            return int(self.first[-1]), int(self.before[-1])
        run = self.block(b, [k for j in range(1, left) if (k := self.at(limit + j * capacity)) < last])
        k = int(np.searchsorted(run, limit - self.before[b], "right"))
        return int(self.first[b]) + k, int(self.before[b]) + (int(run[k - 1]) if k else 0)


def cuts(sizes: Sizes, capacity: int, most: int) -> list[int] | None:
    """The group at which each shard but the first begins, filled greedily; none if it takes more than most shards."""
    out, total, groups = [], 0, int(sizes.first[-1])
    for n in range(most):
        at, total = sizes.reach(total + capacity, capacity, most - n)
        if at >= groups:
            return out
        out.append(at)
    return None


def smallest_capacity(sizes: Sizes, largest: int, shards: int) -> int:
    """The least capacity that is enough; the mean plus the largest group always is."""
    total = int(sizes.before[-1])
    low = max(largest, -(-total // shards))
    high = -(-total // shards) + largest
    while low < high:
        middle = (low + high) // 2
        if cuts(sizes, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def assign(docs: DataFrame, shards: int = SHARDS, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, first_id, group_bytes, shard, capacity) of each row.

    first_id is the least doc_id of the row's group, group_bytes the bytes of all its
    texts, capacity the most bytes that a shard may hold. Null texts are one group of
    no bytes, empty texts another. A null doc_id orders first, groups of equal least
    doc_id by the hash of their text. Repeated rows each count and get the same shard;
    with fewer groups than shards, shards stay unused. A text of any length counts
    whole. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "shards")
    key = F.coalesce(F.unhex(F.md5(F.col("text").cast("binary"))), F.lit(b""))
    rows = scratch.save(docs.select("doc_id", key.alias("g"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")), "rows")
    groups = rows.groupBy("g").agg(F.min("doc_id").alias("first_id"), F.sum("size").alias("size"), F.max(F.col("doc_id").isNull()).alias("void"))
    groups = groups.withColumn("first_id", F.when(~F.col("void"), F.col("first_id"))).drop("void")
    out = T.StructType([*groups.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], out.names)
            at += n

    order = scratch.save(groups.repartitionByRange(F.col("first_id").asc_nulls_first(), "g").sortWithinPartitions(F.col("first_id").asc_nulls_first(), "g").mapInArrow(number, out), "groups")
    blocks = (
        order.groupBy("part", F.floor(F.col("at") / BLOCK).alias("b"))
        .agg(F.sum("size").alias("total"), F.count("*").alias("n"), F.max("size").alias("largest"))
        .orderBy("part", "b").toArrow()
    )  # fmt: skip - one row for each BLOCK groups
    block_part, block, total, many, largest = (blocks[c].to_numpy() for c in ("part", "b", "total", "n", "largest"))

    def fetch(wanted: list[int]) -> dict[int, np.ndarray]:
        places = {(int(block_part[k]), int(block[k])): k for k in wanted}
        one_of = reduce(lambda a, b: a | b, ((F.col("part") == p) & F.col("at").between(b * BLOCK, (b + 1) * BLOCK - 1) for p, b in places))
        own = order.where(one_of).select("part", "at", "size").toArrow()
        part, at, size = (own[c].to_numpy() for c in ("part", "at", "size"))
        out = {}
        for (p, b), k in places.items():
            mine = np.flatnonzero((part == p) & (at // BLOCK == b))
            out[k] = size[mine[np.argsort(at[mine])]]
        return out

    sizes = Sizes(total, many, fetch)
    capacity = smallest_capacity(sizes, int(largest.max(initial=0)), shards)
    starts = np.array(cuts(sizes, capacity, shards) or [], np.int64)
    offset: dict[int, int] = {}
    for part, at in zip(*np.unique(block_part, return_index=True)):
        offset[int(part)] = int(sizes.first[at])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, at = batch.column("part").to_numpy(), batch.column("at").to_numpy()
            index = at + np.array([offset[p] for p in part.tolist()], np.int64)
            shard = np.searchsorted(starts, index, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("first_id"), batch.column("size"), pa.array(shard)], ["g", "first_id", "group_bytes", "shard"])

    placed = T.StructType([order.schema["g"], order.schema["first_id"], T.StructField("group_bytes", T.LongType()), T.StructField("shard", T.IntegerType())])
    return rows.select("doc_id", "g").join(order.mapInArrow(place, placed), "g").select("doc_id", "first_id", "group_bytes", "shard", F.lit(capacity).cast("long").alias("capacity"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of each row of the whole documents table."""
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same for the 64 shards of query().
SQL = r"""
WITH RECURSIVE g AS (SELECT text, min(doc_id) FILTER (WHERE true) AS low, bool_or(doc_id IS NULL) AS void, sum(coalesce(strlen(text), 0)) AS size FROM documents GROUP BY text),
o AS (SELECT text, CASE WHEN NOT void THEN low END AS first_id, size, sum(size) OVER w AS upto, sum(size) OVER w - size AS before, row_number() OVER w AS n
  FROM g WINDOW w AS (ORDER BY CASE WHEN NOT void THEN low END NULLS FIRST, coalesce(md5(text), '') ROWS UNBOUNDED PRECEDING)),
l AS (SELECT list(CAST(upto AS BIGINT) ORDER BY n) AS ends, CAST(sum(size) AS BIGINT) AS total, CAST(max(size) AS BIGINT) AS largest FROM o),
-- the search for the least capacity: one step fills one shard of the capacity (lo + hi) // 2
s AS (
  SELECT greatest(largest, (total + 63) // 64) AS lo, (total + 63) // 64 + largest AS hi, 0::BIGINT AS reached, 0 AS used FROM l
  UNION ALL
  SELECT CASE WHEN reach < total AND used = 63 THEN c + 1 ELSE lo END, CASE WHEN reach >= total THEN c ELSE hi END,
    CASE WHEN reach >= total OR used = 63 THEN 0 ELSE reach END, CASE WHEN reach >= total OR used = 63 THEN 0 ELSE used + 1 END
  FROM (SELECT *, coalesce(list_max(list_filter(ends, lambda x: x <= reached + c)), 0) AS reach FROM (SELECT *, (lo + hi) // 2 AS c FROM s WHERE lo < hi) t, l)),
best AS (SELECT min(hi) AS capacity FROM s),
f AS (
  SELECT 0::BIGINT AS reached, 0 AS shard, 0::BIGINT AS start FROM l
  UNION ALL
  SELECT reach, shard + 1, reach FROM (SELECT shard, coalesce(list_max(list_filter(ends, lambda x: x <= reached + capacity)), 0) AS reach FROM f, l, best) t, l WHERE reach < total),
cut AS (SELECT o.*, (SELECT max(shard) FROM f WHERE f.start <= o.before) AS shard FROM o)
SELECT d.doc_id, c.first_id, CAST(c.size AS BIGINT) AS group_bytes, CAST(c.shard AS INTEGER) AS shard, CAST(capacity AS BIGINT) AS capacity
FROM documents d JOIN cut c ON d.text IS NOT DISTINCT FROM c.text, best
"""
