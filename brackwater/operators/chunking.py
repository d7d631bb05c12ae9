"""Cutting texts into overlapping chunks that end where a sentence or a word ends.

A chunk carries its neighbours' ids, which follow from the document and the place in
it, so linking chunks takes neither a window nor a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brackwater.schema import CHUNK_BITS
from brackwater.sources.shared import bound_batches

SIZE, OVERLAP = 1000, 200
ENDS = ".!?\n。！？"
WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def chunk_text(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """The chunks of one text.

    A window that isn't the last is cut after the last sentence end of its last
    quarter, else after the last white space there, else where it ends. The next one
    begins ``overlap`` characters before the cut. Blank chunks are dropped.
    """
    size = max(1, size)
    overlap = min(overlap, size - 1)
    out, start, n = [], 0, len(text)
    while start < n:
        end = min(start + size, n)
        if end < n:
            floor = max(end - size // 4, start + 1)
            at = max(text.rfind(c, floor, end) for c in ENDS)
            if at < 0:
                at = max(text.rfind(c, floor, end) for c in WHITE)
            end = at + 1 if at >= 0 else end
        piece = text[start:end].strip(WHITE)
        if piece:
            out.append(piece)
        if end == n:
            break
        start = max(end - overlap, start + 1)
    return out


def chunks(docs: DataFrame, id_col: str = "id", text_col: str = "text", splitter: Callable[[str], list[str]] = chunk_text) -> DataFrame:
    """docs with a row for each chunk: (chunk_id, document_id, ordinal, text, prev, next), and the other columns.

    A document without text has none. ``splitter`` may be any function from a text to
    its chunks.
    """
    rest = [f for f in docs.schema.fields if f.name not in (id_col, text_col, "chunk_id", "document_id", "ordinal", "prev", "next")]
    out = T.StructType([
        T.StructField("chunk_id", T.LongType()), T.StructField("document_id", T.LongType()), T.StructField("ordinal", T.IntegerType()),
        T.StructField("text", T.StringType()), T.StructField("prev", T.LongType()), T.StructField("next", T.LongType()), *rest,
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, rest_of = batch.column(0).to_pylist(), batch.column(1), batch.columns[2:]
            for at in range(0, batch.num_rows, 64):  # as many documents at a time
                rows, base, ordinal, text, last = [], [], [], [], []
                for k in range(at, min(at + 64, batch.num_rows)):
                    t = texts[k].as_py()
                    found = splitter(t) if t else []
                    if len(found) >> CHUNK_BITS:
                        raise ValueError(f"document {ids[k]} has more than {1 << CHUNK_BITS} chunks")
                    rows += [k] * len(found)
                    base += [ids[k]] * len(found)
                    ordinal += range(len(found))
                    last += [False] * (len(found) - 1) + [True] * bool(found)
                    text += found
                here = [(b << CHUNK_BITS) + o for b, o in zip(base, ordinal)]
                at_rows = pa.array(rows, pa.int64())
                columns = [
                    pa.array(here, pa.int64()), pa.array(base, pa.int64()), pa.array(ordinal, pa.int32()), pa.array(text, pa.string()),
                    pa.array([i - 1 if o else None for i, o in zip(here, ordinal)], pa.int64()),
                    pa.array([None if e else i + 1 for i, e in zip(here, last)], pa.int64()), *(c.take(at_rows) for c in rest_of),
                ]
                yield pa.RecordBatch.from_arrays(columns, out.names)

    bound_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long"), text_col, *(f.name for f in rest))
    return narrow.where(narrow[id_col].isNotNull()).mapInArrow(cut, out)


def presplit(rows: DataFrame, document: str, ordinal: str, text: str) -> DataFrame:
    """Chunks given as such, taken verbatim: nothing is trimmed or dropped, order is by ``ordinal``."""
    packed = rows.groupBy(F.col(document).cast("long").alias("document_id")).agg(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(text).alias("t")))).alias("c"))
    each = packed.select("document_id", F.size("c").alias("n"), F.posexplode("c").alias("ordinal", "c"))
    here = chunk_id(F.col("document_id"), F.col("ordinal"))
    return each.select(
        here.alias("chunk_id"), "document_id", "ordinal", F.col("c.t").alias("text"),
        F.when(F.col("ordinal") > 0, here - 1).alias("prev"), F.when(F.col("ordinal") < F.col("n") - 1, here + 1).alias("next"),
    )


def chunk_id(document: Column, ordinal: Column) -> Column:
    """The id of a chunk."""
    return F.shiftleft(document.cast("long"), CHUNK_BITS) + ordinal.cast("long")


def context(chunk_table: DataFrame, wanted: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """(center, ...chunk columns) of the chunks around each wanted chunk_id, in document order.

    Ids are contiguous within a document, so it is an equi-join on the ids around, cut
    at the ends of the document by the chunks that exist.
    """
    around = wanted.select(F.col("chunk_id").alias("center"), F.explode(F.sequence(F.col("chunk_id") - before, F.col("chunk_id") + after)).alias("chunk_id"))
    around = around.where(F.shiftright("center", CHUNK_BITS) == F.shiftright("chunk_id", CHUNK_BITS))
    return chunk_table.join(around, "chunk_id").orderBy("center", "chunk_id")
