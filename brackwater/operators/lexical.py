"""BM25 over chunks, for many queries at once.

Statistics (chunk count, mean length, document frequency) are those of the whole
domain and never of what a filter leaves. Only the words that some query asks for are
counted, and they are counted where the chunk lies before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from brackwater.functions.text import tokens
from brackwater.operators.sizes import broadcast_if_small
from brackwater.schema import SCORE_DIGITS
from brackwater.sources.shared import bound_batches

K1, B = 1.2, 0.75
QUERY_BLOCK = 256
#: What is sent to the tasks of one scan, about.
SENT_BYTES = 64 << 20
#: What a worker holds of the scores of a block of rows, and of what their terms add to them.
SCORE_BYTES, ADDED_BYTES = 16 << 20, 8 << 20
FOUND = "domain_id long, query_id long, chunk_id long, score double"


def postings(chunks: DataFrame) -> DataFrame:
    """(domain_id, chunk_id, term, tf, length): each term of each chunk, as a table to keep. A chunk is one row, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                size = pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                found = batch.column(2).flatten().dictionary_encode()
                many = max(1, len(found.dictionary))
                code, tf = np.unique(np.repeat(np.arange(batch.num_rows), size) * many + found.indices.to_numpy(zero_copy_only=False), return_counts=True)
                row = pa.array(code // many)
                columns = [batch.column(0).take(row), batch.column(1).take(row), found.dictionary.take(pa.array(code % many)), pa.array(tf, pa.int64()), pa.array(size[code // many], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["domain_id", "chunk_id", "term", "tf", "length"])

    bound_batches(chunks.sparkSession)
    rows = chunks.select("domain_id", "chunk_id", tokens(F.col("text")).alias("t"))
    kind = T.StructType([*rows.schema.fields[:2], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("length", T.IntegerType())])
    return rows.mapInArrow(run, kind)


def statistics(chunks: DataFrame) -> DataFrame:
    """(domain_id, n, avgdl) over all chunks, those without a term too."""
    length = F.size(tokens(F.coalesce("text", F.lit(""))))
    return chunks.groupBy("domain_id").agg(F.count("*").alias("n"), F.avg(length).alias("avgdl"))


def document_frequency(chunks: DataFrame) -> DataFrame:
    """(domain_id, term, df): in how many chunks each term is."""
    return (
        chunks.select("domain_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
        .groupBy("domain_id", "term").agg(F.count("*").alias("df"))
    )


def idf(n: Column, df: Column) -> Column:
    """The weight of a term that df of n chunks have."""
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def scores(chunks: DataFrame, queries: DataFrame, allowed: Column | None = None) -> DataFrame:
    """(domain_id, query_id, chunk_id, score) of the chunks that share a term with a query.

    chunks has chunk_id, domain_id and text, queries query_id and text. ``allowed``
    restricts the chunks that are scored, not the statistics. A null text has no terms.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    wanted = broadcast_if_small(asked.select("term").distinct())
    may = F.coalesce(allowed, F.lit(False)) if allowed is not None else F.lit(True)
    read = chunks.select("domain_id", "chunk_id", tokens(F.col("text")).alias("t"), may.alias("may"))
    each = read.select("domain_id", "chunk_id", "may", F.size("t").alias("length"), F.explode("t").alias("term"))
    counted = each.join(wanted, "term").groupBy("domain_id", "chunk_id", "may", "length", "term").agg(F.count("*").alias("tf"))
    df = counted.groupBy("domain_id", "term").agg(F.count("*").alias("df"))
    weights = df.join(broadcast_if_small(statistics(chunks)), "domain_id").select("domain_id", "term", "avgdl", idf(F.col("n"), F.col("df")).alias("idf"))
    tf, length = F.col("tf").cast("double"), F.col("length")
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("avgdl")))
    return (
        counted.where("may").join(weights, ["domain_id", "term"]).join(broadcast_if_small(asked), "term")
        .groupBy("domain_id", "query_id", "chunk_id").agg(F.round(F.sum(part), SCORE_DIGITS).alias("score"))
    )


def ranked(scored: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k best of each group with their rank from 1; ties go to the smaller chunk_id."""
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best rows of each column, ties by id."""
    if len(ids) > 4 * k:
        bar = np.partition(scores, len(ids) - k, axis=0)[len(ids) - k]
        row, column = np.nonzero(scores >= bar)
    else:
        row, column = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((ids[row], -scores[row, column], column))
    row, column = row[order], column[order]
    place = np.arange(len(column)) - np.searchsorted(column, column)
    return row[place < k], column[place < k]


def query_blocks(queries: DataFrame, block: int = QUERY_BLOCK, most_bytes: int = SENT_BYTES) -> Iterator[list[tuple[np.ndarray, list[str], np.ndarray]]]:
    """Groups of blocks of (query ids, their terms, terms x queries), of the queries that have a term.

    A group is what one scan of the chunks is scored against, of about most_bytes.
    """
    asked = queries.select("query_id", F.array_distinct(_terms(queries)).alias("t")).where(F.size("t") > 0)
    total, size = asked.agg(F.count("*"), F.sum(F.size("t"))).first()
    groups = max(1, -(-(size or 0) * block // most_bytes))
    for g in range(groups if total else 0):
        got = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g).collect()
        blocks = []
        for a in range(0, len(got), block):
            part = got[a : a + block]
            place: dict[str, int] = {}
            cells = [(place.setdefault(t, len(place)), q) for q, r in enumerate(part) for t in r.t]
            table = np.zeros((len(place), len(part)), bool)
            table[tuple(np.array(cells).T)] = True
            blocks.append((np.array([r.query_id for r in part]), list(place), table))
        if blocks:
            yield blocks


def _terms(rows: DataFrame) -> Column:
    """The terms of each row: those of a column ``terms``, if it has been counted already, else of its text."""
    return F.col("terms") if "terms" in rows.columns else tokens(F.col("text"))


def domain_counts(read: DataFrame, terms: list[str]) -> dict[int, tuple[int, float, np.ndarray]]:
    """domain -> (chunks, mean length, in how many chunks each term is), counted where the chunks lie in one scan."""
    sent = read.sparkSession.sparkContext.broadcast(pa.array(terms, pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_set, seen = sent.value, {}
        for batch in batches:
            domain = batch.column(0).to_numpy(zero_copy_only=False)
            size = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            term = pc.fill_null(pc.index_in(batch.column(1).flatten(), value_set=value_set), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), size)
            cells = np.unique(row[term >= 0] * len(value_set) + term[term >= 0])
            for d in np.unique(domain):
                own = seen.setdefault(int(d), [0, 0, np.zeros(len(value_set), np.int64)])
                mine = domain == d
                own[0] += int(mine.sum())
                own[1] += int(size[mine].sum())
                own[2] += np.bincount(cells[mine[cells // len(value_set)]] % len(value_set), minlength=len(value_set))
        for d, (n, length, df) in seen.items():
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some) + 1, d)), pa.array(np.append(some, -1)), pa.array(np.append(df[some], n)), pa.array(np.append(np.zeros(len(some), np.int64), length))], ["domain_id", "term", "n", "length"])

    counted = read.select("domain_id", "t").mapInArrow(run, "domain_id long, term long, n long, length long")
    out: dict[int, tuple[int, float, np.ndarray]] = {}
    found = counted.groupBy("domain_id", "term").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).toArrow()  # a row for each domain and term asked for
    domain, term, n, length = (found[c].to_numpy() for c in ("domain_id", "term", "n", "length"))
    for k in np.flatnonzero(term < 0):
        own = np.flatnonzero((domain == domain[k]) & (term >= 0))
        df = np.zeros(len(terms), np.int64)
        df[term[own]] = n[own]
        out[int(domain[k])] = (int(n[k]), length[k] / max(1, n[k]), df)
    return out


def search(chunks: DataFrame, queries: DataFrame, k: int, allowed: Column | None = None) -> DataFrame:
    """(domain_id, query_id, chunk_id, score, rank) of the k best chunks of each domain for each query.

    As scores(), but batches of chunks are scored by arrays against blocks of QUERY_BLOCK
    queries, and each batch's best k are all that is shuffled: one scan counts what the
    queries ask for, one scores, whatever the number of blocks that fit SENT_BYTES. The
    driver holds the document frequency of the queries' terms in each domain. A column
    ``terms`` of chunks is taken for the tokens of the text.
    """
    spark = chunks.sparkSession
    may = F.coalesce(allowed, F.lit(False)) if allowed is not None else F.lit(True)
    read = chunks.select(F.col("domain_id").cast("long"), F.col("chunk_id").cast("long"), _terms(chunks).alias("t"), may.alias("may"))
    out = None
    for blocks in query_blocks(queries):
        every = list(dict.fromkeys(t for _, terms, _ in blocks for t in terms))
        place = {t: i for i, t in enumerate(every)}
        counts = domain_counts(read, every)
        weight = {d: np.log((n - df + 0.5) / (df + 0.5) + 1) for d, (n, _, df) in counts.items()}
        mean = {d: max(length, 1e-9) for d, (_, length, _) in counts.items()}
        ready = []
        for names, terms, table in blocks:
            here = np.full(len(every), -1, np.int32)
            here[[place[t] for t in terms]] = np.arange(len(terms))
            ready.append((names, here, table))
        sent = spark.sparkContext.broadcast((pa.array(every, pa.string()), ready, weight, mean))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            every, ready, weight, mean = sent.value
            for batch in batches:
                domain, chunk = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                size = pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                term = pc.fill_null(pc.index_in(batch.column(2).flatten(), value_set=every), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(batch.num_rows), size)
                hit = (term >= 0) & batch.column(3).to_numpy(zero_copy_only=False)[row]
                code, tf = np.unique(row[hit] * len(every) + term[hit], return_counts=True)
                row, term = code // len(every), code % len(every)
                for d in np.unique(domain[row]):
                    own = np.flatnonzero(domain[row] == d)
                    r, t, n = row[own], term[own], tf[own]
                    part = weight[d][t] * n * (K1 + 1) / (n + K1 * (1 - B + B * size[r] / mean[d]))
                    for names, here, table in ready:
                        mine = np.flatnonzero(here[t] >= 0)
                        yield from _scored(r[mine], here[t[mine]], part[mine], chunk, names, table, int(d), k)

        found = read.where(F.size("t") > 0).mapInArrow(run, FOUND)
        out = found if out is None else out.unionAll(found)
    if out is None:
        out = spark.createDataFrame([], FOUND)
    return ranked(out, k, ("domain_id", "query_id"))


def _scored(row: np.ndarray, term: np.ndarray, part: np.ndarray, chunk: np.ndarray, names: np.ndarray, table: np.ndarray, domain: int, k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows for each query of a block, from what each (row, term) adds to a score, in the order of the rows."""
    cells, most = max(1, SCORE_BYTES // (8 * len(names))), max(1, ADDED_BYTES // (8 * len(names)))
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    a = 0
    while a < len(first):
        b = min(a + cells, len(first))
        end = first[b] if b < len(first) else len(row)
        score, c = np.empty((b - a, len(names))), a
        while c < b:  # rows of so many terms at a time
            d = min(b, max(c + 1, int(np.searchsorted(first, first[c] + most, "right")) - 1)) if end > first[c] + most else b
            at = slice(first[c], first[d] if d < b else end)
            score[c - a : d - a] = np.add.reduceat(table[term[at]] * part[at, None], first[c:d] - first[c], axis=0)
            c = d
        shared = score > 0  # a shared term always adds something, however little is left of it by rounding
        score = np.round(score, SCORE_DIGITS)
        ids = chunk[row[first[a:b]]]
        i, j = best(np.where(shared, score, -1.0), ids, k)
        keep = shared[i, j]
        i, j = i[keep], j[keep]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), domain)), pa.array(names[j]), pa.array(ids[i]), pa.array(score[i, j])], ["domain_id", "query_id", "chunk_id", "score"])
        a = b
