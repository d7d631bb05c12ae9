"""Repeated line runs by a suffix array over line-ID sequences.

A corpus is one sequence of line hashes, document after document by (doc_id, key of
the text), each document and each line that occurs once ending in a symbol of its
own. Only lines that occur again take part; lines without a word are passed over.
Prefix doubling refines the rank of each suffix: a rank is (hash of its first line,
offset among the suffixes that begin with it), and a round orders each group of equal
ranks by the rank 2**k lines further on, so no round sorts the whole corpus and settled
suffixes drop out. What a round orders are the different ranks further on, counted
where they lie, so a line that very many places share is no more work than others.

The longest common prefix of neighbours in the suffix array is compared line by line
only where the lines before them differ; elsewhere it is one less than that of the
suffix before. Those comparisons add up to O(n log n) lines whatever the input
repeats. A stack over the common-prefix intervals then gives, for each suffix, the
longest run that also begins earlier in the corpus. The array lies in ranges, each a
task's; of the ranges around it a task needs only the suffixes that begin earlier than
all between, which are few. Runs of at least ``min_words`` words are repeated
passages; their first copy stays and later ones are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from brackwater.llm import words as W
from brackwater.llm.minhash import document_key
from brackwater.llm.scratch import Scratch
from brackwater.sources.shared import spread

MIN_WORDS = 50
BROADCAST_BYTES = 64 << 20
BROADCAST_ROWS = 200_000
#: Rows that are few even as one group of one task.
FEW_ROWS = 1_000_000
SOLID = np.ones(256, bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False


def line_table(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, ordinal, line number, hash, words) of the lines of all rows that hold a word.

    A line ends at a newline; white space at its ends doesn't count for the hash.
    """
    raw, at = W.utf8(array)
    starts, ends, first = W.spans(raw, at, SOLID)  # the words
    if not len(starts):
        return (np.zeros(0, np.int64),) * 5
    newlines = np.concatenate([[0], np.cumsum(raw == 10)])
    row = np.repeat(np.arange(len(array)), np.diff(first))
    line = newlines[starts] - newlines[at[row]]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (line[1:] != line[:-1])]))
    last = np.concatenate([new[1:], [len(starts)]]) - 1
    row, line = row[new], line[new]
    ordinal = np.arange(len(new)) - np.searchsorted(row, row)
    h = W.span_hashes(raw, starts[new], ends[last], W.RAW_CODES[0])
    return row, ordinal, line, h.view(np.int64), last - new + 1


def lines(docs: DataFrame) -> DataFrame:
    """(doc, d, i, line, h, words): doc_id, the key of the document, and its lines that hold a word."""
    names = ["doc", "d", "i", "line", "h", "words"]
    out = T.StructType([T.StructField("doc", docs.schema["doc_id"].dataType)] + [T.StructField(c, T.LongType()) for c in names[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in W.slices(batch.column(2)):
                part = batch.slice(a, b - a)
                row, *rest = line_table(part.column(2))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *map(pa.array, rest)], names)

    return docs.select(docs["doc_id"], document_key(docs).alias("d"), docs["text"]).mapInArrow(run, out)


def ranked(active: DataFrame, scratch: Scratch) -> DataFrame:
    """active with off and cap: suffixes that begin with line h are in the order of (off, d, i), and no common prefix reaches cap lines.

    Several have one off only where they end alike: each is alone, in the order of its
    end. A round writes only the suffixes that it moves; those that are alone in their
    group stay where they were written last.
    """
    now = active.withColumns({"off": F.lit(0).cast("long"), "cap": F.lit(1), "open": F.lit(True), "ends": F.lit(False), "round": F.lit(0)})
    now = scratch.save(now, "rank")
    paths, k = [now._scratch_path], 0
    while left := now.where("open").count():
        tied = now.where("open").drop("open", "ends", "cap", "round")
        # every suffix as it was moved last, in one scan of all rounds
        ahead = scratch.spark.read.schema(now.schema).parquet(*paths).where(~F.col("open") | (F.col("round") == k)).select("d", "i", "h", "off", "ends")
        if left <= BROADCAST_ROWS:  # 16 bytes each: only the places that are looked up go through the shuffle
            ahead = ahead.join(F.broadcast(tied.select("d", (F.col("i") + (1 << k)).alias("i"))), ["d", "i"], "left_semi")
        end = F.when(F.col("ends"), F.struct("d", "i"))
        ahead = ahead.select("d", (F.col("i") - (1 << k)).alias("i"), F.col("h").alias("h2"), F.col("off").alias("off2"), end.alias("end2"))
        seen = tied.join(ahead, ["d", "i"], "left")
        further = ["h", "off", "h2", "off2", "end2"]
        upto = Window.partitionBy("h", "off").orderBy(*(F.col(c).asc_nulls_first() for c in further[2:]))
        if left <= FEW_ROWS:
            placed = seen.withColumns({"begin": F.rank().over(upto) - 1, "n": F.count("*").over(Window.partitionBy(*further))})
        else:
            seen = scratch.save(seen, "seen")
            counts = seen.groupBy(*further).agg(F.count("*").alias("n"))
            counts = counts.withColumn("begin", F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
            counts = scratch.save(counts.where("h2 is not null").toDF(*("c" + c for c in further), "n", "begin"), "counts")
            if counts.count() <= BROADCAST_ROWS:
                counts = F.broadcast(counts)
            same = reduce(lambda x, y: x & y, (F.col(c) == F.col("c" + c) for c in further[:4])) & F.col("end2").eqNullSafe(F.col("cend2"))
            placed = seen.join(counts, same, "left")
        over = F.col("h2").isNull()
        moved = placed.withColumns({"off": F.col("off") + F.when(over, 0).otherwise(F.col("begin")), "open": ~over & (F.col("n") > 1), "ends": over, "cap": F.lit(2 << k), "round": F.lit(k + 1)})
        now, k = scratch.save(moved.select(now.columns), "rank"), k + 1
        paths.append(now._scratch_path)
    return scratch.spark.read.schema(now.schema).parquet(*paths).where("not open").drop("open", "ends", "round")


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, d, i, prev, ...) in the order of the suffix array with what lies before each in this range: its range, its place there, and qh, qd, qi, qprev."""
    part, at, last = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k) for k in range(4)]
        before = [pa.concat_arrays([pa.array([last[k] if last else None], c.type), c.slice(0, n - 1)]) for k, c in enumerate(columns)]
        last = [c[n - 1].as_py() for c in columns]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), *before], [*batch.schema.names, "part", "pos", "qh", "qd", "qi", "qprev"])
        at += n


def common_prefixes(suffixes: DataFrame, scratch: Scratch, ranges: int | None = None) -> DataFrame:
    """suffixes by range and place of the array, with lcp: the lines shared with the suffix before it, 0 for the first of its h."""
    first = ["h", "d", "i", "prev"]
    suffixes = suffixes.select(*first, *(c for c in suffixes.columns if c not in first))
    order = [F.col(c) for c in ("h", "off", "d", "i")]
    apart = suffixes.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order)
    more = [T.StructField("part", T.IntegerType()), T.StructField("pos", T.LongType()), *(T.StructField("q" + c, T.LongType()) for c in first)]
    near = scratch.save(apart.mapInArrow(neighbours, T.StructType([*suffixes.schema.fields, *more])), "array")
    # the last row of a range lies before the first of the next: a row for each range goes through the driver
    lasts = {r.part: r.q for r in near.groupBy("part").agg(F.max_by(F.struct(*first), "pos").alias("q")).collect()}
    rows = [(part, *lasts[before]) for before, part in zip(sorted(lasts), sorted(lasts)[1:])]
    edge = scratch.spark.createDataFrame(rows, "part int, lh long, ld long, li long, lprev long")
    near = near.join(F.broadcast(edge), "part", "left")
    for c in first:
        near = near.withColumn("q" + c, F.when(F.col("pos") == 0, F.col("l" + c)).otherwise(F.col("q" + c)))
    # where the lines before both are equal it is one less than for the suffix before
    fresh, reducible = ~F.col("qh").eqNullSafe(F.col("h")), F.coalesce(F.col("prev") == F.col("qprev"), F.lit(False))
    near = near.withColumn("known", F.when(fresh, 0).when(~reducible, -1)).select("doc", "d", "i", "part", "pos", "cap", "known", "qd", "qi")
    near = scratch.save(near, "near")
    # the lines of each segment without a gap
    segment = Window.partitionBy("d").orderBy("i")
    body = (
        suffixes.select("d", "i", "h").withColumn("seg", F.col("i") - F.row_number().over(segment)).groupBy("d", "seg")
        .agg(F.min("i").alias("first"), F.array_sort(F.collect_list(F.struct("i", "h"))).alias("hs"))
        .select("d", "first", F.col("hs.h").alias("hs"))
    )
    body = scratch.save(body, "segments")

    def tails(p: DataFrame, d: str, i: str, name: str) -> DataFrame:
        own = body.select(F.col("d").alias(d), "first", "hs")
        inside = (F.col(i) >= F.col("first")) & (F.col(i) < F.col("first") + F.size("hs"))
        return p.join(own, d).where(inside).withColumn(name, F.expr(f"slice(hs, cast({i} - first as int) + 1, cap)")).drop("first", "hs")

    pairs = tails(tails(near.where("known = -1").select("d", "i", "qd", "qi", "cap"), "d", "i", "x"), "qd", "qi", "y")
    both = F.least(F.size("x"), F.size("y"))
    differ = F.expr("array_position(zip_with(slice(x, 1, n), slice(y, 1, n), (u, v) -> u = v), false)").cast("int")
    counted = pairs.withColumn("n", both).withColumn("at", differ).select("d", "i", F.when(F.col("at") > 0, F.col("at") - 1).otherwise(F.col("n")).alias("got"))
    along = segment.rowsBetween(Window.unboundedPreceding, 0)
    known = near.join(counted, ["d", "i"], "left").withColumn("known", F.coalesce("got", "known"))
    reach = F.last(F.col("i") + F.col("known"), ignorenulls=True).over(along)
    return known.select("part", "pos", "doc", "d", "i", (reach - F.col("i")).alias("lcp"))


END = 1 << 62
Place = tuple  # (whether there is a doc_id, doc_id, d, i): the order of the corpus
Chain = list  # [(place, lines shared with all up to the edge of a range)], the nearest to the edge first, each earlier than those nearer


def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[Place], np.ndarray]]:
    """(range, places, lcp) of rows (part, pos, doc, d, i, lcp) ordered by (part, pos)."""
    held: list[pa.RecordBatch] = []

    def settle() -> tuple[int, list[Place], np.ndarray]:
        table = pa.Table.from_batches(held)
        doc, d, i = (table[k].to_pylist() for k in (2, 3, 4))
        return table[0][0].as_py(), [(x is not None, 0 if x is None else x, y, z) for x, y, z in zip(doc, d, i)], table[5].to_numpy()

    for batch in batches:
        while batch.num_rows:
            part = batch.column(0).to_numpy()
            cut = int(np.searchsorted(part, part[0], "right"))
            if held and held[0].column(0)[0].as_py() != part[0]:
                yield settle()
                held.clear()
            held.append(batch.slice(0, cut))
            batch = batch.slice(cut)
    if held:
        yield settle()


def edges(places: list[Place], lcp: np.ndarray) -> tuple[Chain, Chain, Place, int]:
    """Of a range: the chain from its start on, the chain from its end back, its earliest place and the least lcp."""
    n = len(places)
    rank = np.empty(n, np.int64)
    rank[sorted(range(n), key=places.__getitem__)] = np.arange(n)
    from_start, to_end = np.minimum.accumulate(lcp), np.append(np.minimum.accumulate(lcp[::-1])[::-1][1:], END)
    starts = np.flatnonzero(rank == np.minimum.accumulate(rank))
    ends = np.flatnonzero(rank == np.minimum.accumulate(rank[::-1])[::-1])[::-1]
    return [(places[k], int(from_start[k])) for k in starts if from_start[k]], [(places[k], int(to_end[k])) for k in ends if to_end[k]], places[int(rank.argmin())], int(lcp.min())


def chains(found: list[tuple[int, Chain, Chain, Place, int]]) -> dict[int, tuple[Chain, Chain]]:
    """(chain before, chain after) of each range, of edges() of all, in their order."""
    before: list[Chain] = [[]]
    for _, _, end, low, least in found[:-1]:
        before.append(end + [(p, min(m, least)) for p, m in before[-1] if p < low and least])
    after: list[Chain] = [[]]
    for _, start, _, low, least in found[:0:-1]:
        after.append(start + [(p, min(m, least)) for p, m in after[-1] if p < low and least])
    return {part: (x, y) for (part, *_), x, y in zip(found, before, reversed(after))}


def longest_previous(places: list[Place], lcp: np.ndarray, before: Chain, after: Chain) -> np.ndarray:
    """For each suffix of a range the longest run that begins earlier in the corpus too.

    On the stack lie suffixes of rising place, each with what it shares with the one
    below; the chains of other ranges come first and last.
    """
    run = np.zeros(len(places), np.int64)
    stack: list[tuple[Place, int, int]] = []  # (place, shared with the one below, index here or -1)
    edge = 0
    for p, m in reversed(before):
        stack.append((p, edge, -1))
        edge = m
    own = [(p, int(m), k) for k, (p, m) in enumerate(zip(places, lcp.tolist()))]
    if own:
        own[0] = (own[0][0], min(own[0][1], edge), 0)
    for place, shared, k in [*own, *((p, m, -1) for p, m in after)]:
        if not shared:
            for _, below, j in stack:
                if j >= 0:
                    run[j] = below
            stack = []
        while stack and stack[-1][0] > place:
            _, below, j = stack.pop()
            if j >= 0:
                run[j] = max(below, shared)
            shared = min(below, shared)
        stack.append((place, shared if stack else 0, k))
    for _, below, j in stack:
        if j >= 0:
            run[j] = below
    return run


def previous_runs(prefixes: DataFrame, scratch: Scratch) -> DataFrame:
    """(d, i, run) of the suffixes (part, pos, doc, d, i, lcp) of which a run begins earlier too, the longest such run."""
    ranges = prefixes.repartition("part").sortWithinPartitions("part", "pos")
    doc = prefixes.schema["doc"].dataType
    link = T.StructType([T.StructField(c, k) for c, k in (("part", T.IntegerType()), ("kind", T.StringType()), ("k", T.IntegerType()), ("doc", doc), ("d", T.LongType()), ("i", T.LongType()), ("m", T.LongType()))])
    doc_type = to_arrow_type(doc)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, places, lcp in by_range(batches):
            start, end, low, least = edges(places, lcp)
            rows = [("start", *x) for x in start] + [("end", *x) for x in end] + [("low", low, least)]
            values = [[part] * len(rows), [r[0] for r in rows], range(len(rows)), [r[1][1] if r[1][0] else None for r in rows], [r[1][2] for r in rows], [r[1][3] for r in rows], [r[2] for r in rows]]
            kinds = (pa.int32(), pa.string(), pa.int32(), doc_type, pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], link.names)

    held: dict[int, dict[str, list]] = {}
    for r in ranges.mapInArrow(summed, link).orderBy("part", "k").collect():  # some rows for each range
        held.setdefault(r.part, {"start": [], "end": [], "low": []})[r.kind].append(((r.doc is not None, 0 if r.doc is None else r.doc, r.d, r.i), r.m))
    known = chains([(part, x["start"], x["end"], *x["low"][0]) for part, x in sorted(held.items())])
    sent = scratch.spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, places, lcp in by_range(batches):
            runs = longest_previous(places, lcp, *sent.value[part])
            at = np.flatnonzero(runs)
            yield pa.RecordBatch.from_arrays([pa.array([places[k][2] for k in at], pa.int64()), pa.array([places[k][3] for k in at], pa.int64()), pa.array(runs[at])], ["d", "i", "run"])

    return scratch.save(ranges.mapInArrow(run, "d long, i long, run long"), "runs")


def covered(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """The rows of (doc, d, i, line, words, run), ordered by (d, i), that lie in a run of enough words; some documents at a time."""
    held: list[pa.RecordBatch] = []

    def settle() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        words, run = (table[c].to_numpy() for c in ("words", "run"))
        total = np.concatenate([[0], np.cumsum(words)])
        start = np.flatnonzero(run)
        end = start + run[start]
        long = total[end] - total[start] >= min_words
        change = np.zeros(table.num_rows + 1, np.int64)
        np.add.at(change, start[long], 1)
        np.add.at(change, end[long], -1)
        yield from table.select(["doc", "d", "i", "line", "words"]).filter(pa.array(np.cumsum(change[:-1]) > 0)).to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        d = batch.column(1).to_numpy()
        new = np.flatnonzero(d[1:] != d[:-1])
        cut = int(new[-1]) + 1 if len(new) else 0  # where the last document of the batch begins
        if cut:
            held.append(batch.slice(0, cut))
        if held and (cut or held[-1].column(1)[-1].as_py() != d[0]):
            yield from settle()
            held.clear()
        held.append(batch.slice(cut))
    if held:
        yield from settle()


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, scratch: Scratch | None = None, ranges: int | None = None) -> DataFrame:
    """(doc_id, d, lines, words) of each document that holds later copies: their line numbers from 0, and their words.

    A copy is later than another by (doc_id, key of the text, line), a null doc_id
    first. Rows that repeat both doc_id and text are one document. Copies within one
    document count, overlapping ones too. Null and empty texts have no lines, an empty
    table gives an empty result, other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "linededup")
    every = scratch.save(lines(docs), "lines")
    again = every.groupBy("h").count().where("count > 1").select("h")
    active = every.join(again, "h", "left_semi").dropDuplicates(["d", "i"])
    before = Window.partitionBy("d").orderBy("i")
    active = active.withColumn("prev", F.when(F.lag("i").over(before) == F.col("i") - 1, F.lag("h").over(before)))
    active = scratch.save(active, "active")
    scratch.drop(every)
    suffixes = ranked(active.drop("line", "words"), scratch)
    runs = previous_runs(scratch.save(common_prefixes(suffixes, scratch, ranges), "prefixes"), scratch)
    marked = (
        active.select("doc", "d", "i", "line", "words").join(runs, ["d", "i"], "left")
        .select("doc", "d", "i", "line", "words", F.coalesce("run", F.lit(0).cast("long")).alias("run"))
        .repartition("d").sortWithinPartitions("d", "i")
    )
    out = T.StructType([f for f in active.schema.fields if f.name in ("doc",)] + [T.StructField(c, T.LongType()) for c in ("d", "i", "line", "words")])
    return (
        marked.mapInArrow(lambda batches: covered(batches, min_words), out)
        .groupBy("d").agg(F.first("doc").alias("doc_id"), F.array_sort(F.collect_list(F.col("line").cast("int"))).alias("lines"), F.sum("words").alias("words"))
        .select("doc_id", "d", "lines", "words")
    )


def without(text: str, drop: list[int]) -> str:
    """text without those lines, nor blank lines between two of them."""
    parts, gone = text.split("\n"), set(drop)
    kept, blank = [], []
    inside = False
    for k, part in enumerate(parts):
        if k in gone:
            if not inside:
                kept += blank
            blank, inside = [], True
        elif part.strip(" \t\v\f\r"):
            kept += [*blank, part]
            blank, inside = [], False
        else:
            blank.append(part)
    return "\n".join(kept + blank)


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without later copies of repeated passages, all columns kept.

    A document that has no word left goes; one that had none stays. n_chars, where it
    is a column, follows the text. The cases of repeated_lines() hold.
    """
    scratch = Scratch(docs.sparkSession, "linededup")
    found = repeated_lines(docs, min_words, scratch).select(F.col("d").alias("__d"), F.col("lines").alias("__lines"))
    found = scratch.save(found, "found")
    size = found.agg(F.sum(16 + 4 * F.size("__lines"))).first()[0] or 0
    text, columns = docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drop = batch.column(batch.num_columns - 1)
            at = np.flatnonzero(~drop.is_null().to_numpy(zero_copy_only=False))
            batch = batch.select(range(batch.num_columns - 1))
            if not len(at):
                yield batch
                continue
            old = batch.column(text).to_pylist()
            keep = np.ones(batch.num_rows, bool)
            for k in at:
                old[k] = without(old[k], drop[int(k)].as_py())
                keep[k] = bool(old[k].strip())
            arrays = list(batch.columns)
            arrays[text] = pa.array(old, batch.schema.field(text).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema).filter(pa.array(keep))

    joined = docs.withColumn("__d", document_key(docs)).join(F.broadcast(found) if size <= BROADCAST_BYTES else found.hint("shuffle_hash"), "__d", "left")
    left = W.through(joined.drop("__d"), run, len(docs.columns))  # the columns of docs, then the lines
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(columns["n_chars"].dataType))
    return left


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later copies of repeated passages in the whole documents table."""
    return repeated_lines(spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")).select("doc_id", "lines", "words")


#: The same by comparing every pair of places of one line.
SQL = r"""
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
split AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM docs),
solid AS (SELECT doc_id, text, line, regexp_replace(l, '^[ \t\x0b\f\r]+|[ \t\x0b\f\r]+$', '', 'g') AS l FROM split),
placed AS (SELECT doc_id, line, l, len(string_split_regex(l, '[ \t\x0b\f\r]+')) AS words,
    row_number() OVER (PARTITION BY doc_id, text ORDER BY line) AS i, row_number() OVER (ORDER BY doc_id NULLS FIRST, text, line) AS place, dense_rank() OVER (ORDER BY doc_id NULLS FIRST, text) AS d
  FROM solid WHERE l <> ''),
pairs AS (SELECT a.d AS first_d, b.d, b.i - a.i AS apart, b.i, b.words FROM placed a JOIN placed b ON a.l = b.l AND a.place < b.place),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY first_d, d, apart ORDER BY i) AS run FROM pairs),
long AS (SELECT d, min(i) AS lo, max(i) AS hi FROM runs GROUP BY first_d, d, apart, run HAVING sum(words) >= 50),
gone AS (SELECT DISTINCT d, p.i, p.doc_id, p.line, p.words FROM placed p JOIN long USING (d) WHERE p.i BETWEEN lo AND hi)
SELECT doc_id, list_sort(list(CAST(line AS INTEGER))) AS lines, CAST(sum(words) AS BIGINT) AS words FROM gone GROUP BY d, doc_id
"""
