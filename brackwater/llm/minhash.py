"""Near-duplicate documents by a MinHash containment ensemble and an exact join of what it leaves.

Two documents are near copies when the smaller shingle set is contained in the
larger to at least ``containment``, however much larger that is. The near copies are
closed to groups. Documents of one shingle set are one node.

The first pass is by MinHash: bands of three hashes, as many as find two nodes of one
size partition with the wanted recall, sketches of four bits a hash inside the buckets
(buckets.py), and each node against one other on the exact sets. It ties most of a
cluster without its pairs, and nothing depends on what it misses.

The second pass loses nothing. However the shingles of the smaller set of a pair are
ordered, a common one is among its first ``n - containment * n + 1``; the order here is
by the number of documents that have a shingle, the rarest first, so that most are had
by no other. Every shingle of a node is matched with those early ones of all nodes. Of
m - 1 more of them each pair has m in common, which few strangers have; such pairs that
aren't tied yet are verified. Shingles go through the shuffles in six
bytes, packed by bins of their hash: to be counted, back to their documents if several
have them, and to be matched. Each of these steps is written before the next, and the
first two take a part of the bins or documents at a time, so that their shuffles don't
lie on the disks side by side.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackwater.llm import words as W
from brackwater.llm.buckets import bucket_pairs
from brackwater.llm.components import connected
from brackwater.llm.scratch import Scratch
from brackwater.sources.shared import spread

BROADCAST_IDS = 2_000_000
ROWS = 3
#: Nodes of a bucket that one task judges; of more, each pair of blocks of half as many is a bucket of its own.
CROWD = 8192
#: Shingles that one bin has in the mean, and those that a task packs at a time.
BIN_KEYS, PACK_KEYS = 1 << 20, 1 << 20
#: Parts in which shingles are counted, each by a scan of the texts, and in which they go back to their documents.
PASSES = 2
#: Nodes that meet one other in the mean, where many are to be verified against it.
MEET = 256
#: Shingles of the small sets that a larger one meets first, besides the smallest; the others follow if they are still apart.
FIRST = 64


@dataclass(frozen=True)
class Params:
    """Shingle length and threshold; of the first pass, up to which ratio of sizes bands are tuned, the growth of sizes from one partition to the next, hashes and recall."""

    shingle: int = 3
    containment: float = 0.7
    max_ratio: float = 2.0
    growth: float = 2**0.25
    hashes: int = 128
    recall: float = 0.95


def jaccard_threshold(containment: float, size_ratio: float) -> float:
    """The least Jaccard similarity of a set and one size_ratio times as large that contains so much of it."""
    return containment / (size_ratio + 1 - containment)


@lru_cache(8)
def triples(hashes: int, rounds: int = 8) -> np.ndarray:
    """The hashes of each band: rounds of all hashes in threes, each round in an order of its own."""
    each = hashes // ROWS
    return np.concatenate([np.argsort(W.stream(600 + r, hashes))[: each * ROWS].reshape(each, ROWS) for r in range(rounds)])


@lru_cache(64)
def tune(jaccard: float, hashes: int, recall: float) -> int:
    """The fewest bands that find a pair of this similarity with this probability, by simulated pairs, as later bands use hashes again."""
    equal = np.random.default_rng(1).random((4000, hashes)) < jaccard
    hit = np.column_stack([equal[:, t].all(axis=1) for t in triples(hashes)])
    found = np.maximum.accumulate(hit, axis=1).mean(axis=0)
    if found[-1] < recall:
        raise ValueError(f"{hashes} hashes don't find a similarity of {jaccard:.2f} with probability {recall}")
    return int(np.argmax(found >= recall)) + 1


def banding(p: Params) -> list[int]:
    """The number of bands by the number of partitions between the two documents."""
    steps = math.ceil(math.log(p.max_ratio) / math.log(p.growth) - 1e-9)
    return [tune(jaccard_threshold(p.containment, min(p.growth ** (d + 1), p.max_ratio)), p.hashes, p.recall) for d in range(steps + 1)]


def partition_of(size: np.ndarray, growth: float) -> np.ndarray:
    """The partition of a set size; the bounds are whole powers of the growth."""
    return np.floor(np.log(np.maximum(size, 1)) / math.log(growth) + 1e-9).astype(np.int32)


def shingle_sets(array: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of the rows that have words."""
    for a, b in W.slices(array):
        hashes, rows = W.shingles(*W.word_hashes(array.slice(a, b - a)), n)
        for k in range(b - a):
            if rows[k + 1] > rows[k]:
                yield a + k, np.unique(hashes[rows[k] : rows[k + 1]])


def node_id(s: np.ndarray) -> int:
    """A hash of a shingle set."""
    whole = np.add.reduce(W.mix(s), keepdims=True)
    return int(W.mix(whole + W.STEP[1] * np.array([len(s)], np.uint64))[0] >> np.uint64(1))


def signature(values: np.ndarray, multipliers: np.ndarray, adders: np.ndarray) -> np.ndarray:
    """The least value of each hash function over one set."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(multipliers), 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 1024):
        np.minimum(out, (x[a : a + 1024, None] * multipliers + adders).min(axis=0), out=out)
    return out


def sketch(sig: np.ndarray) -> np.ndarray:
    """Four bits of each value of signatures, packed into words."""
    low = (sig & np.uint32(15)).astype(np.uint8)
    return (low[:, ::2] | low[:, 1::2] << 4).view(np.uint64)


def signed(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """(dk, node, n, sig, sketch) of each document with words; its node is a hash of its shingle set."""
    multipliers = (W.stream(101, p.hashes) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    adders = (W.stream(202, p.hashes) >> np.uint64(32)).astype(np.uint32)

    def out(found: list) -> pa.RecordBatch:
        dk, n, node, sig = (np.array([f[k] for f in found]) for k in range(4))
        short = sketch(sig)
        columns = [pa.array(dk), pa.array(node), pa.array(n), pa.array([r.tobytes() for r in sig], pa.binary()), pa.array([r.tobytes() for r in short], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["dk", "node", "n", "sig", "sketch"])

    for batch in batches:
        ids, found = batch.column(0).to_numpy(zero_copy_only=False), []
        for row, s in shingle_sets(batch.column(1), p.shingle):
            found.append((ids[row], np.int32(len(s)), node_id(s), signature(s, multipliers, adders)))
            if len(found) == 1024:
                yield out(found)
                found = []
        if found:
            yield out(found)


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Binary values of one length as the rows of a matrix."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(column), -1)


def keyed(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """(key, node) for each band of rows (node, sig), a node once a task; the low byte of a key says which band it is of."""
    layout = triples(p.hashes)[: banding(p)[0]]
    seen: set[int] = set()
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            part = batch.slice(a, 1024)
            node, first = np.unique(part.column(0).to_numpy(), return_index=True)
            new = np.array([n not in seen for n in node.tolist()], bool)
            seen.update(node[new].tolist())
            node, sig = node[new], matrix(part.column(1).take(pa.array(first[new])), np.uint32)
            if not len(node):
                continue
            keys = np.empty((len(node), len(layout)), np.uint64)
            for code, columns in enumerate(layout):
                h = np.full(len(node), code, np.uint64)
                for j, column in enumerate(columns):
                    h = W.mix(h + sig[:, column].astype(np.uint64) + W.STEP[j + 1])
                keys[:, code] = h & np.uint64(0xFFFFFFFFFFFFFF00) | np.uint64(code & 255)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(node, len(layout)))], ["key", "node"])


def judge_of(part: pa.RecordBatch, p: Params) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Which pairs of rows (key, node, n, sketch) may be near copies, and which are by their sketches beyond doubt.

    The Jaccard similarity that the sketches tell is held against the one that the
    sizes ask for, three standard deviations to either side. This is for the first pass:
    a pair that it leaves out is found by the second.
    """
    n, words = part.column(2).to_numpy().astype(np.int64), matrix(part.column(3), np.uint64)

    def judge(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = words[i] ^ words[j]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        differ = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64)
        got = (1 - differ / p.hashes) * 16 / 15 - 1 / 15
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        want = p.containment / (large / small + 1 - p.containment)
        chance = want + (1 - want) / 16
        slack = 3 * np.sqrt(chance * (1 - chance) / p.hashes) * 16 / 15
        return got >= want - slack, got >= want + slack

    return judge


def document_key(docs: DataFrame) -> Column:
    """A 64-bit key of (doc_id, text): rows that repeat both are one document, null ids are told apart by text."""
    return F.xxhash64(docs["doc_id"], docs["text"])


def near_copies(docs: DataFrame, p: Params, scratch: Scratch) -> DataFrame:
    """(dk, component) of the keys of documents that have a near copy."""
    texts = docs.select(document_key(docs).alias("dk"), docs["text"]).where(F.col("text").isNotNull())
    signatures = scratch.save(texts.mapInArrow(lambda batches: signed(batches, p), "dk long, node long, n int, sig binary, sketch binary"), "signatures")
    members = scratch.save(signatures.select("dk", "node").distinct(), "members")
    keys = signatures.select("node", "sig").mapInArrow(lambda batches: keyed(batches, p), "key long, node long")
    bucket = Window.partitionBy("key")
    # what a bucket holds, told by its size, its ends and two sums of hashes
    low = F.lit(0x7FFFFFFF).cast("long")
    held = [F.count("*"), F.min("node"), F.max("node"), F.sum(F.xxhash64("node").bitwiseAND(low)), F.sum(F.xxhash64("node", F.lit(1)).bitwiseAND(low))]
    names = ["many", "lo", "hi", "s1", "s2"]
    near = keys.select("key", "node", *(h.over(bucket).alias(c) for h, c in zip(held, names))).where("lo < hi")
    kept_near = scratch.save(near.groupBy(*names, "node").agg(F.min("key").alias("key")).select("key", "node", "many"), "near")
    node_of = scratch.save(signatures.groupBy("node").agg(F.min("dk").alias("dk"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "nodes")
    scratch.drop(signatures)
    near = in_blocks(kept_near).join(node_of.select("node", "n", "sketch"), "node").select("key", "node", "n", "sketch")
    sorted_near = near.repartition("key").sortWithinPartitions("key", F.xxhash64("node"))
    pairs = sorted_near.mapInArrow(lambda batches: bucket_pairs(batches, lambda part: judge_of(part, p)), "a long, b long")
    hub = F.min(F.struct(F.xxhash64("a"), "a"))
    first = scratch.save(pairs.groupBy("b").agg(hub.getField("a").alias("a")).select("a", "b"), "first")
    scratch.drop(kept_near)
    edges = verified(first, texts, node_of, p, scratch)
    tied = scratch.save(connected(edges, scratch), "tied")
    rest = apart(texts, members, node_of, tied, p, scratch)
    # each larger set against the smallest that it may hold, then what is still apart
    small = Window.partitionBy("a").orderBy("n", "b")
    first = rest.select("a", "b", F.row_number().over(small).alias("at"), F.sum(F.col("n").cast("long")).over(small.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    first = scratch.save(first.where((F.col("at") == 1) | (F.col("upto") <= FIRST)).select("a", "b"), "first")
    edges = scratch.save(edges.union(verified(first, texts, node_of, p, scratch)), "edges")
    tied = scratch.save(connected(edges, scratch), "tied")
    rest = (
        rest.select("a", "b").join(first, ["a", "b"], "left_anti")
        .join(tied.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
        .join(tied.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        .where(~F.coalesce(F.col("ca") == F.col("cb"), F.lit(False))).select("a", "b")
    )
    component = connected(edges.union(verified(scratch.save(rest, "apart"), texts, node_of, p, scratch)), scratch)
    placed = members.join(component, "node", "left").select("dk", F.coalesce("component", "node").alias("component"))
    return placed.withColumn("__n", F.count("*").over(Window.partitionBy("component"))).where("__n > 1").drop("__n")


def apart(texts: DataFrame, members: DataFrame, node_of: DataFrame, tied: DataFrame, p: Params, scratch: Scratch) -> DataFrame:
    """(a, b, n): every pair of nodes of different components whose exact sets may contain each other enough; a is the larger, n the size of b."""
    total = node_of.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    bins = min(max(total // BIN_KEYS, 16), 1 << 16)
    again = scratch.save(members.join(node_of.select("dk"), "dk", "left_anti").select("dk").distinct(), "again")
    small = again.count() <= BROADCAST_IDS  # 8 bytes each; beyond that a shuffled join
    if small:
        once = texts.join(F.broadcast(again), "dk", "left_anti")
    else:  # each pass must find the same documents in the same order
        parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        once = texts.repartition(parts, "dk").join(again, "dk", "left_anti").sortWithinPartitions("dk")
    kind = "bin int, chunk long, keys binary, places binary, many binary"

    def counts(k: int, passes: int) -> DataFrame:
        packs = once.mapInArrow(lambda batches: packed(batches, p, bins, k, passes), kind).repartition("bin").sortWithinPartitions("bin")
        return scratch.save(packs.mapInArrow(counted, kind), "counted")

    several = [counts(k, PASSES) for k in range(PASSES)]
    if not agreed(several):  # rows come in another order each time they are read
        scratch.drop(*several)
        several = [counts(0, 1)]
    back, ranks = reduce(DataFrame.unionAll, several), []
    for k in range(PASSES):
        part = back.where(F.pmod(F.xxhash64("chunk"), F.lit(PASSES)) == k).repartition("chunk").sortWithinPartitions("chunk")
        ranks.append(scratch.save(part.mapInArrow(lambda batches: ranked(batches, p), kind), "ranked"))
    scratch.drop(*several)
    binned = reduce(DataFrame.unionAll, ranks).repartition("bin").sortWithinPartitions("bin")
    found = scratch.save(binned.mapInArrow(matched, "key long, place long, early boolean, node long, n int"), "matched")
    scratch.drop(*ranks)
    places = found.where("node is not null").select("place", "node", "n").join(tied, "node", "left")
    places = places.select("place", "node", "n", F.coalesce("component", "node").alias("component"))
    rows = found.where("node is null").select("key", "place", "early").join(places, "place", "left").drop("place").repartition("key").distinct()
    # a task that ran twice over rows in another order would give other places: better no result than one with links lost
    rows = rows.withColumn("node", F.coalesce("node", F.raise_error(F.lit("the places of documents changed between two runs of a task"))))
    bucket = Window.partitionBy("key")
    rows = rows.select("*", F.min("component").over(bucket).alias("lo"), F.max("component").over(bucket).alias("hi"), F.count("*").over(bucket).alias("many"))
    rows = in_blocks(rows.where("lo < hi").select("key", "node", "many", "n", "early", "component"))
    rows = rows.repartition("key").sortWithinPartitions("key", F.xxhash64("node"))
    pairs = rows.mapInArrow(lambda batches: bucket_pairs(batches, across, 2), "a long, b long, n int, many long")
    least = 1 + F.floor(F.ceil(p.containment * F.col("n") - 1e-9) / 4)
    rest = scratch.save(pairs.groupBy("a", "b", "n").agg(F.sum("many").alias("many")).where(F.col("many") >= least).select("a", "b", "n"), "apart")
    scratch.drop(found)
    return rest


def agreed(several: list[DataFrame]) -> bool:
    """Whether the passes of packed() gave the same places to the same nodes."""
    own = reduce(DataFrame.unionAll, several).where("bin < 0").groupBy("chunk").agg(F.count("*").alias("many"), F.min(F.xxhash64("keys")).alias("lo"), F.max(F.xxhash64("keys")).alias("hi"))
    return own.where((F.col("many") != len(several)) | (F.col("lo") != F.col("hi"))).isEmpty()


def across(part: pa.RecordBatch) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Which pairs of rows (key, node, n, early, component) are still apart, with the shingle among the early ones of the smaller; none is beyond doubt."""
    n, component = part.column(2).to_numpy(), part.column(4).to_numpy()
    early = part.column(3).to_numpy(zero_copy_only=False)

    def judge(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        may = (component[i] != component[j]) & ((early[i] & (n[i] <= n[j])) | (early[j] & (n[j] <= n[i])))
        return may, np.zeros(len(may), bool)

    return judge


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The values between bounds that follow each other, as binary values."""
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


PACKED = ["bin", "chunk", "keys", "places", "many"]


def runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and the end."""
    return np.append(np.flatnonzero(np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]])), len(x))


def by_bin(chunk: int, slot: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Packed rows of a chunk, a row for each bin, of slots (bin << 32 | key) and places."""
    order = np.argsort(slot)
    slot, place = slot[order], place[order]
    of = (slot >> np.uint64(32)).astype(np.int32)
    bounds = runs(of)
    many = len(bounds) - 1
    columns = [pa.array(of[bounds[:-1]]), pa.array(np.full(many, chunk)), binaries(slot.astype(np.uint32), bounds), binaries(place, bounds), pa.nulls(many, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, PACKED)


def packed(batches: Iterator[pa.RecordBatch], p: Params, bins: int, turn: int = 0, passes: int = 1) -> Iterator[pa.RecordBatch]:
    """(bin, chunk, keys, places, many) of the shingles of rows (dk, text), of passes over them those whose bin has its turn.

    Keys are 32 bits of shingles, sorted in each row, places 15 bits for the node in
    its chunk and one that tells the early shingles, once they are known. A negative
    bin has a chunk's nodes for keys and their sizes for places.
    """
    task = TaskContext.get()
    chunk = (task.partitionId() if task else 0) << 24
    sets: list[np.ndarray] = []

    def out() -> Iterator[pa.RecordBatch]:
        n = np.array([len(s) for s in sets], np.int32)
        x = np.concatenate(sets)
        slot = (x & np.uint64(0xFFFF)) % np.uint64(bins) << np.uint64(32) | x >> np.uint64(16) & np.uint64(0xFFFFFFFF)
        mine = (slot >> np.uint64(32)) % np.uint64(passes) == turn
        yield by_bin(chunk, slot[mine], np.repeat(np.arange(len(n), dtype=np.uint16), n)[mine])
        nodes, whole = np.array([node_id(s) for s in sets], np.int64), np.array([0, len(n)])
        columns = [pa.array([-1 - chunk % bins], pa.int32()), pa.array([chunk], pa.int64()), binaries(nodes, whole), binaries(n, whole), pa.nulls(1, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, PACKED)

    held = 0
    for batch in batches:
        for _, s in shingle_sets(batch.column(1), p.shingle):
            if sets and (held + len(s) > PACK_KEYS or len(sets) == 1 << 15):
                yield from out()
                chunk, held = chunk + 1, 0
                sets.clear()
            sets.append(s)
            held += len(s)
    if sets:
        yield from out()


def gathered(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[tuple]]:
    """The packed rows that have one bin (by = 0) or chunk (by = 1), which follow each other; rows of nodes alone if by bin."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if not by and row[0] < 0:
                yield [row]
                continue
            if held and held[0][by] != row[by]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def keys_of(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, low, row) of the packed rows of one bin: each key and place, by key, and the row it is in."""
    key = np.concatenate([np.frombuffer(r[2], np.uint32) for r in rows])
    order = np.argsort(key, kind="stable")
    row = np.repeat(np.arange(len(rows)), [len(r[2]) // 4 for r in rows])
    return key[order], np.concatenate([np.frombuffer(r[3], np.uint16) for r in rows])[order], row[order]


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packed rows sorted by bin those keys that occur several times, with how often, up to what two bytes hold."""
    for rows in gathered(batches, 0):
        if rows[0][0] >= 0:
            key, low, row = keys_of(rows)
            bounds = runs(key)
            many = np.repeat(np.diff(bounds), np.diff(bounds))
            order = np.flatnonzero(many > 1)
            order = order[np.argsort(row[order], kind="stable")]
            bounds = runs(row[order])
            if len(bounds) == 1:
                continue
            of = row[order][bounds[:-1]]
            columns = [pa.array(np.full(len(of), rows[0][0], np.int32)), pa.array(np.array([r[1] for r in rows])[of])]
            yield pa.RecordBatch.from_arrays([*columns, *(binaries(v, bounds) for v in (key[order], low[order], np.minimum(many[order], 0xFFFF).astype(np.uint16)))], PACKED)
        else:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(rows[0], (pa.int32(), pa.int64(), *[pa.binary()] * 3))], PACKED)


def ranked(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Of rows of counted() sorted by chunk the packed rows, by bin, with the early shingles told.

    What a node has alone comes first, and needs no row. Where that is enough of it, no
    other set contains enough of this one, which is left to hold others.
    """
    for rows in gathered(batches, 1):
        own = next(r for r in rows if r[0] < 0)
        rows = [r for r in rows if r[0] >= 0]
        if rows:
            n = np.frombuffer(own[3], np.int32).astype(np.int64)
            place = np.concatenate([np.frombuffer(r[3], np.uint16) for r in rows])
            many = np.concatenate([np.frombuffer(r[4], np.uint16) for r in rows])
            slot = np.concatenate([np.frombuffer(r[2], np.uint32).astype(np.uint64) | np.uint64(r[0]) << np.uint64(32) for r in rows])
            order = np.lexsort((slot, many, place))
            place, slot = place[order], slot[order]
            shared = np.bincount(place, minlength=len(n))
            at = np.arange(len(place)) - (np.cumsum(shared) - shared)[place]
            need = np.ceil(p.containment * n - 1e-9).astype(np.int64)
            few = shared - need + 1
            # shingles of one node that share a key are matched once: so many more are early
            again = (place[1:] == place[:-1]) & (slot[1:] == slot[:-1])
            more = need // 4 + np.bincount(place[1:][again], minlength=len(n))
            few[few > 0] += more[few > 0]
            yield by_bin(own[1], slot, place | (at < few[place]).astype(np.uint16) << np.uint16(15))
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(own, (pa.int32(), pa.int64(), *[pa.binary()] * 3))], PACKED)


def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows of ranked() sorted by bin: (key, place, early) where several places share a key that is early in one, and (place, node, n)."""
    names = ["key", "place", "early", "node", "n"]
    for rows in gathered(batches, 0):
        number, chunk, keys, sizes, _ = rows[0]
        if number < 0:
            node = np.frombuffer(keys, np.int64)
            columns = [pa.nulls(len(node), pa.int64()), pa.array((chunk << 15) + np.arange(len(node))), pa.nulls(len(node), pa.bool_()), pa.array(node), pa.array(np.frombuffer(sizes, np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names)
            continue
        key, low, row = keys_of(rows)
        bounds = runs(key)
        many, early = np.diff(bounds), low >> np.uint16(15) > 0
        live = np.flatnonzero(np.repeat((many > 1) & np.logical_or.reduceat(early, bounds[:-1]), many))
        first = np.array([r[1] for r in rows], np.int64) << 15
        for a in range(0, len(live), 1 << 16):
            k = live[a : a + (1 << 16)]
            columns = [pa.array((number << 32) + key[k].astype(np.int64)), pa.array(first[row[k]] + (low[k] & np.uint16(0x7FFF))), pa.array(early[k])]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(k), pa.int64()), pa.nulls(len(k), pa.int32())], names)


def in_blocks(near: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(key, node, ...) of buckets (key, node, many, ...): of one with more than crowd nodes a bucket for each pair of its blocks."""
    blocks = F.ceil(F.col("many") * 2 / crowd)
    own = F.pmod(F.xxhash64("node", F.lit(2)), blocks)
    others = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j)))
    return near.select(F.explode(F.when(F.col("many") <= crowd, F.array("key")).otherwise(others)).alias("key"), *(c for c in near.columns if c not in ("key", "many")))


def verified(pairs: DataFrame, texts: DataFrame, node_of: DataFrame, p: Params, scratch: Scratch) -> DataFrame:
    """The pairs whose exact shingle sets contain each other enough; the text of one document for each node is read again and goes to where a is.

    Texts are sent, not their sets, which are larger. Nodes that many others are paired with
    are met by so many at a time.
    """
    times = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEET).alias("times"))
    parts = scratch.save(pairs.join(times, "a").select("a", F.pmod(F.xxhash64("b"), "times").alias("part"), "b"), "parts")
    wanted = parts.select("a", "part", F.col("b").alias("node")).union(parts.select("a", "part", "a").distinct()).join(node_of.select("node", "dk"), "node")
    wanted = scratch.save(wanted, "wanted")
    if wanted.count() <= BROADCAST_IDS:  # 32 bytes each; beyond that the texts are shuffled to the ids
        wanted = F.broadcast(wanted)
    found = texts.join(wanted, "dk").select("a", "part", (F.col("a") != F.col("node")).alias("other"), "node", "text")
    found = found.repartition("a", "part").sortWithinPartitions("a", "part", "other")
    edges = scratch.save(found.mapInArrow(lambda batches: contained(batches, p), "a long, b long").distinct(), "edges")
    return edges


def contained(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """The pairs (a, node) that hold, of rows (a, part, other, node, text) sorted so that the text of a comes before the others."""
    at, hub = None, np.zeros(0, np.uint64)
    for batch in batches:
        a, part, other, node = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        found = []
        for k, s in shingle_sets(batch.column(4), p.shingle):
            if not other[k]:
                at, hub = (a[k], part[k]), s
                continue
            if at != (a[k], part[k]):
                raise ValueError("a text of a pair is missing")
            small, large = (s, hub) if len(s) <= len(hub) else (hub, s)
            place = np.minimum(np.searchsorted(large, small), len(large) - 1)
            if np.count_nonzero(large[place] == small) >= p.containment * len(small) - 1e-9:
                found.append(k)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(a[found]), pa.array(node[found])], ["a", "b"])


def groups(docs: DataFrame, p: Params = Params(), scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, dk, group_id, kept) of each document that has a near copy.

    group_id is the least doc_id of the group and kept marks the one document that
    stays: the one of the least doc_id, of several the one of the least key. A null
    doc_id comes last. Null texts and texts without words have no copies. Rows that
    repeat both doc_id and text are one document, found in one row here. An empty
    table gives an empty result. Other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "minhash", tidy=True)
    member = near_copies(docs, p, scratch)
    found = (
        docs.select(document_key(docs).alias("dk"), docs["doc_id"])
        .join(member, "dk").distinct()
    )
    w = Window.partitionBy("component").orderBy(F.col("doc_id").asc_nulls_last(), "dk")
    return (
        found.withColumn("group_id", F.first("doc_id").over(w)).withColumn("kept", F.row_number().over(w) == 1)
        .select("doc_id", "dk", "group_id", "kept")
    )


def dedup(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """docs with one document of each group of near copies, all columns kept.

    The cases of groups() hold; of rows that repeat both doc_id and text, one stays.
    """
    scratch = Scratch(docs.sparkSession, "minhash", tidy=True)
    gone = scratch.save(groups(docs, p, scratch).where("not kept").select(F.col("dk").alias("__gone")), "gone")
    small = gone.count() <= BROADCAST_IDS  # 8 bytes each; beyond that a shuffled join
    left = docs.join(F.broadcast(gone) if small else gone, document_key(docs) == F.col("__gone"), "left_anti")
    repeated = docs.groupBy(document_key(docs).alias("__dk")).count().where("count > 1").select("__dk")
    repeated = scratch.save(repeated, "repeated")
    if repeated.isEmpty():
        return left
    key = document_key(left)
    once = left.where(F.col("text").isNull()).unionAll(left.where(F.col("text").isNotNull()).join(repeated, key == F.col("__dk"), "left_anti"))
    twice = left.where(F.col("text").isNotNull()).join(repeated, key == F.col("__dk"), "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionAll(twice)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies in the whole documents table."""
    return groups(spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")).drop("dk")


#: The same by comparing the shingles of every pair of documents.
SQL = r"""
WITH RECURSIVE docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
words AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9\x{80}-\x{10FFFF}]+'), lambda x: x <> '') AS w FROM docs),
sets AS (SELECT doc_id, CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words WHERE len(w) > 0),
each_shingle AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common FROM each_shingle a JOIN each_shingle b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
near AS (SELECT a, b FROM shared WHERE common >= 0.7 * least(na, nb) - 1e-9),
pairs AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
-- the least id of each group, by steps along the pairs
reached AS (SELECT a AS doc_id, a AS root FROM pairs UNION SELECT p.b, r.root FROM reached r JOIN pairs p ON p.a = r.doc_id WHERE r.root < p.b),
least AS (SELECT doc_id, min(root) AS group_id FROM reached GROUP BY doc_id)
SELECT doc_id, group_id, doc_id = group_id AS kept FROM least
"""
