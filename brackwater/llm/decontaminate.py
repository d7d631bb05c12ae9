"""Benchmark decontamination: edit-tolerant search for items inside documents.

An item of n words is in a document when some passage is within
``floor(edits * n)`` word edits of it. Such a passage keeps, by the q-gram lemma, at
least n - q + 1 - q * edits of the item's q-grams, so one vectorised pass over every
word of every document leaves exactly the windows that can match. Those windows, of
the item's size, go through CGK random walks, which map edit distance to Hamming
distance; keys of sampled positions of many walks meet the items' keys, with as many
walks as simulated pairs at the largest distance need for the wanted recall; where
MOST_WALKS are too few, every window that the bound leaves is verified instead. Every
match is verified by exact semi-global edit distance.

Documents are scanned where they lie, without a shuffle. Items go to all tasks, in
blocks of bounded size, each block a scan of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brackwater.llm import words as W
from brackwater.sources.shared import spread

EDITS = 0.2
RECALL = 0.95
SAMPLES = 3
MOST_WALKS = 96
BLOCK_BYTES = 32 << 20
FILTER_BITS = 22


def allowed(n: int, edits: float) -> int:
    """Word edits that an item of n words allows."""
    return int(edits * n + 1e-9)


def gram_of(n: int, k: int) -> tuple[int, int]:
    """(q, least number of the item's q-grams that a match keeps), with the longest q that keeps any."""
    for q in (3, 2):
        if n >= q and n - q + 1 - q * k >= 1:
            return q, n - q + 1 - q * k
    return 1, max(1, n - k)


@lru_cache(512)
def sampled(n: int, walks: int) -> np.ndarray:
    """The embedded positions that each walk over n words samples, walks x SAMPLES; a walk passes n words in about 2n steps."""
    draw = W.stream(7000 + n, walks * SAMPLES).reshape(walks, SAMPLES)
    return (draw % np.uint64(max(1, 2 * n))).astype(np.int64)


def walk_keys(tokens: np.ndarray, starts: np.ndarray, n: int, walks: int) -> np.ndarray:
    """The key of each walk over each window of n tokens, len(starts) x walks.

    Step j of walk l stays or moves on by a random bit of (l, j, token); the token seen
    at a sampled step goes into the key. Past the end of the window the token is 0.
    """
    at = sampled(n, walks)
    seeds = W.stream(9000, walks * 2 * max(1, n)).reshape(walks, -1)
    pointer = np.zeros((len(starts), walks), np.int64)
    seen = np.zeros((SAMPLES, len(starts), walks), np.uint64)
    begin = starts[:, None]
    for j in range(int(at.max()) + 1):
        inside = pointer < n
        token = np.where(inside, tokens[np.minimum(begin + np.minimum(pointer, n - 1), len(tokens) - 1)], np.uint64(0))
        walk, slot = np.nonzero(at == j)
        if len(walk):
            seen[slot, :, walk] = token[:, walk].T
        pointer += ((token ^ seeds[:, j]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(63)).astype(np.int64)
    key = np.broadcast_to(W.stream(555, walks), pointer.shape)
    for slot in seen:
        key = W.mix(key + slot)
    return key


def edited(tokens: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    """tokens after k random substitutions, insertions and deletions."""
    out = tokens.tolist()
    for _ in range(k):
        kind, place = draw.integers(3), int(draw.integers(max(1, len(out))))
        fresh = int(draw.integers(1, 1 << 62))
        if kind == 0:
            out[place] = fresh
        elif kind == 1:
            out.insert(place, fresh)
        elif len(out) > 1:
            del out[place]
    return np.array(out, np.uint64)


@lru_cache(64)
def walks_for(size: int, edits: float, recall: float) -> int:
    """How many walks find simulated pairs of a size at the largest distance with this probability, a power of two times 6.

    0 where MOST_WALKS do not, as for long items: the hamming distance of walks grows
    faster than the edits. Where half the size is beyond them, so is the size.
    """
    if size > 64 and not walks_for(size // 2, edits, recall):
        return 0
    draw, k, pairs = np.random.default_rng(size), allowed(size, edits), 60
    base = [draw.integers(1, 1 << 62, size).astype(np.uint64) for _ in range(pairs)]
    other = [np.concatenate([edited(b, k, draw), draw.integers(1, 1 << 62, size).astype(np.uint64)])[:size] for b in base]
    starts = np.arange(pairs) * size
    x, y = (walk_keys(np.concatenate(t), starts, size, MOST_WALKS) for t in (base, other))
    walks = 6
    while walks <= MOST_WALKS:
        if (x[:, :walks] == y[:, :walks]).any(axis=1).mean() >= recall:
            return walks
        walks *= 2
    return 0


@dataclass(frozen=True)
class Items:
    """A block of items: the words of each, and the index of its grams by q."""

    tokens: tuple
    allowed: np.ndarray
    least: np.ndarray
    walks: dict
    grams: dict  # q -> (sorted gram hashes, offsets, items)
    tables: dict  # n -> (sorted keys, items)


def prepare(texts: list[str | None], edits: float = EDITS, recall: float = RECALL) -> Items:
    """The index of items; those without a word are in no gram and never match."""
    tokens = []
    for a, b in W.slices(array := pa.array(texts, pa.string())):
        h, rows = W.word_hashes(array.slice(a, b - a))
        tokens += [h[rows[k] : rows[k + 1]] for k in range(b - a)]
    k = np.array([allowed(len(t), edits) for t in tokens], np.int64)
    least = np.zeros(len(tokens), np.int64)
    by_q: dict[int, list] = {}
    sizes: dict[int, list] = {}
    for i, t in enumerate(tokens):
        if len(t):
            q, least[i] = gram_of(len(t), k[i])
            grams, _ = W.shingles(t, np.array([0, len(t)]), q)
            by_q.setdefault(q, []).append((np.unique(grams), i))
            sizes.setdefault(len(t), []).append(i)
    index = {}
    for q, found in by_q.items():
        grams, items = np.concatenate([g for g, _ in found]), np.repeat([i for _, i in found], [len(g) for g, _ in found])
        order = np.argsort(grams, kind="stable")
        distinct, first = np.unique(grams[order], return_index=True)
        index[q] = (distinct, np.append(first, len(grams)), items[order])
    walks, tables = {}, {}
    for n, members in sizes.items():
        # simulated once for each size class, at its upper end
        walks[n] = walks_for(1 << max(2, int(np.ceil(np.log2(n)))), edits, recall)
        if not walks[n]:
            continue
        keys = walk_keys(np.concatenate([tokens[i] for i in members]), np.arange(len(members)) * n, n, walks[n])
        order = np.argsort(keys.ravel(), kind="stable")
        tables[n] = (keys.ravel()[order], np.repeat(members, walks[n])[order])
    return Items(tuple(tokens), k, least, walks, index, tables)


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least edit distance of the item to any passage of text, the end of the first such passage)."""
    row, ramp = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1)
    for token in item:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (text != token))
        row = np.minimum.accumulate(new - ramp) + ramp
    return int(row.min()), int(row.argmin())


def matches(words: np.ndarray, rows: np.ndarray, items: Items, filters: dict) -> list[tuple[int, int, int, int]]:
    """(row, item, distance, end word) of the items found in rows of words, the best place of each."""
    n_of = np.array([len(t) for t in items.tokens])
    candidates: dict[int, list] = {}  # n -> [(row, item, starts)]
    for q, (grams, first, of_item) in items.grams.items():
        if len(words) < q:
            continue
        h = words.copy()
        for j in range(1, q):
            h[:-j] += words[j:] * W.STEP[j]
        h = W.mix(h[: len(words) - q + 1])
        at = np.flatnonzero(filters[q][h >> np.uint64(64 - FILTER_BITS)])
        place = np.searchsorted(grams, h[at])
        place[place == len(grams)] = 0
        real = grams[place] == h[at]
        at, place = at[real], place[real]
        row = np.searchsorted(rows, at, "right") - 1
        real = at + q <= rows[row + 1]
        at, place, row = at[real], place[real], row[real]
        many = first[place + 1] - first[place]
        item = of_item[np.repeat(first[place], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        at, row = np.repeat(at, many), np.repeat(row, many)
        order = np.lexsort((at, item, row))
        at, row, item = at[order], row[order], item[order]
        group = np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1])]) if len(at) else np.zeros(0, bool)
        bounds = np.append(np.flatnonzero(group), len(at))
        for a, b in zip(bounds[:-1], bounds[1:]):
            i = item[a]
            least, n, k = items.least[i], n_of[i], items.allowed[i]
            if b - a < least:
                continue
            p = at[a:b]
            # a match spans n + k words at most: its first gram has the least number within that reach
            dense = p[least - 1 :] - p[: b - a - least + 1] <= n + k - q
            if dense.any():
                # an aligned window may begin before its first kept gram
                marks = p[: b - a - least + 1][dense]
                last = p[least - 1 :][dense]
                lo = np.maximum(last + q - n - k, rows[row[a]])
                starts = np.unique(np.concatenate([np.arange(x, y + 1) for x, y in zip(lo, marks)]))
                candidates.setdefault(int(n), []).append((row[a], i, starts))
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for n, found in candidates.items():
        hits: dict[tuple[int, int], list[int]] = {}
        if not items.walks[n]:
            # no number of walks reaches the recall: every window that is left is verified
            for row, i, s in found:
                hits.setdefault((row, i), []).extend(s.tolist())
            found = []
        starts = np.concatenate([s for *_, s in found]) if found else np.zeros(0, np.int64)
        owner = np.repeat([row for row, *_ in found], [len(s) for *_, s in found])
        keys, members = items.tables.get(n, (None, None))
        for a in range(0, len(starts), 2048):
            near = walk_keys(words, starts[a : a + 2048], n, items.walks[n])
            lo, hi = np.searchsorted(keys, near), np.searchsorted(keys, near, "right")
            window, walk = np.nonzero(hi > lo)
            many = hi[window, walk] - lo[window, walk]
            at = np.repeat(lo[window, walk], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            window = a + np.repeat(window, many)
            for row, i, s in np.unique(np.stack([owner[window], members[at], starts[window]]), axis=1).T.tolist():
                hits.setdefault((row, i), []).append(s)
        for (row, i), at in hits.items():
            k, begin_of, end_of = int(items.allowed[i]), int(rows[row]), int(rows[row + 1])
            at = np.unique(at)
            # windows that overlap are verified as one passage
            cuts = np.flatnonzero(np.diff(at) > n + 2 * k) + 1
            for part in np.split(at, cuts):
                begin, end = max(begin_of, int(part[0]) - k), min(end_of, int(part[-1]) + n + 2 * k)
                distance, stop = best_match(items.tokens[i], words[begin:end])
                old = best.get((row, i))
                if distance <= k and (old is None or distance < old[0]):
                    best[row, i] = (distance, begin + stop)
    return [(row, i, d, stop - int(rows[row])) for (row, i), (d, stop) in sorted(best.items())]


def _filters(items: Items) -> dict:
    out = {}
    for q, (grams, *_) in items.grams.items():
        out[q] = np.zeros(1 << FILTER_BITS, bool)
        out[q][grams >> np.uint64(64 - FILTER_BITS)] = True
    return out


def blocks(benchmark: DataFrame, edits: float, recall: float, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list, Items]]:
    """(item ids, index) of each block of about block_bytes of item text; repeated items count once."""
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    for b in range(count):
        own = items if count == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b)
        found = own.orderBy("item_id", "text").collect()  # at most about a block
        if found:
            yield [r.item_id for r in found], prepare([r.text for r in found], edits, recall)


def find(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, recall: float = RECALL) -> DataFrame:
    """(doc_id, item_id, distance, end_word) of each item found in each document, at its closest place.

    Null and empty texts and items hold nothing and are held by nothing. Null ids are
    carried along. Repeated rows each give their own result, items that repeat both
    columns count once. An empty table on either side gives an empty result. Other
    columns are not read.
    """
    spark = docs.sparkSession
    W.bound_batches(spark)
    ids = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", benchmark.schema["item_id"].dataType)]
    out = T.StructType(ids + [T.StructField("distance", T.IntegerType()), T.StructField("end_word", T.LongType())])
    result = spark.createDataFrame([], out)
    for names, items in blocks(benchmark, edits, recall):
        sent = spark.sparkContext.broadcast((names, items))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, items = sent.value
            filters = _filters(items)
            for batch in batches:
                for a, b in W.slices(batch.column(1)):
                    found = matches(*W.word_hashes(batch.column(1).slice(a, b - a)), items, filters)
                    if found:
                        row, item, distance, end = zip(*found)
                        own = batch.column(0).slice(a, b - a).take(pa.array(row))
                        yield pa.RecordBatch.from_arrays([own, pa.array([names[i] for i in item]), pa.array(distance, pa.int32()), pa.array(end, pa.int64())], ["doc_id", "item_id", "distance", "end_word"])

        result = result.unionAll(docs.select("doc_id", "text").mapInArrow(run, out))
    return result


def reject(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, recall: float = RECALL) -> DataFrame:
    """docs without those that hold an item, all columns kept; the cases of find() hold."""
    text = docs.columns.index("text")
    left = docs
    for _, items in blocks(benchmark, edits, recall):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            filters = _filters(sent.value)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for a, b in W.slices(batch.column(text)):
                    for row, *_ in matches(*W.word_hashes(batch.column(text).slice(a, b - a)), sent.value, filters):
                        keep[a + row] = False
                yield batch.filter(pa.array(keep))

        left = W.through(left, run)
    return left


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the benchmark table in the whole documents table."""
    return find(spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The same by the textbook's table of edits for every pair that shares enough words.
SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9\x{80}-\x{10FFFF}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
items AS (SELECT row_number() OVER () AS t, item_id, w, len(w) AS n, CAST(floor(0.2 * len(w) + 1e-9) AS INTEGER) AS k FROM (SELECT item_id, list_filter(string_split_regex(lower(text), '[^a-z0-9\x{80}-\x{10FFFF}]+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)) WHERE len(w) > 0),
-- a match keeps enough of the item's words: what has fewer can't be one
item_words AS (SELECT t, n, k, unnest(list_distinct(w)) AS x FROM items),
doc_words AS (SELECT r, unnest(list_distinct(w)) AS x FROM d),
may AS (SELECT r, t FROM item_words JOIN doc_words USING (x) GROUP BY r, t HAVING count(*) >= (SELECT len(list_distinct(w)) - k FROM items i WHERE i.t = item_words.t)),
texts AS (SELECT r, t, j, w[j] AS x FROM (SELECT r, t, w, unnest(range(1, len(w) + 1)) AS j FROM may JOIN d USING (r))),
-- the textbook's table of least edits of the first i words of the item to any passage that ends at word j, a row at a time
dp AS (
  SELECT 0 AS i, r, t, 0::BIGINT AS j, NULL::VARCHAR AS x, 0 AS v FROM may
  UNION ALL
  SELECT 0, r, t, j, x, 0 FROM texts
  UNION ALL
  SELECT i, r, t, j, x, CAST(min(u - j) OVER (PARTITION BY r, t ORDER BY j ROWS UNBOUNDED PRECEDING) + j AS INTEGER)
  FROM (SELECT i + 1 AS i, r, t, j, x, least(v + 1, coalesce(lag(v) OVER (PARTITION BY r, t ORDER BY j) + CASE WHEN x = word THEN 0 ELSE 1 END, v + 1)) AS u
        FROM (SELECT dp.*, w[i + 1] AS word FROM dp JOIN items USING (t) WHERE i < n) s) q
),
last AS (SELECT r, t, min(v) AS distance, arg_min(j, (v, j)) AS end_word FROM dp JOIN items USING (t) WHERE i = n GROUP BY r, t)
SELECT doc_id, item_id, CAST(distance AS INTEGER) AS distance, CAST(end_word AS BIGINT) AS end_word FROM last JOIN d USING (r) JOIN items USING (t) WHERE distance <= k
"""
