import random

import pytest
from pyspark.sql import functions as F

from brackwater.operators import chunking


def plain(text, size=1000, overlap=200):
    """The rule by a loop over characters."""
    size, out, start = max(size, 1), [], 0
    overlap = min(overlap, size - 1)
    while start < len(text):
        hard = min(start + size, len(text))
        end = hard
        if hard < len(text):
            floor = max(hard - size // 4, start + 1)
            marks = [i for i in range(floor, hard) if text[i] in chunking.ENDS] or [i for i in range(floor, hard) if text[i] in chunking.WHITE]
            end = marks[-1] + 1 if marks else hard
        if text[start:end].strip(chunking.WHITE):
            out.append(text[start:end].strip(chunking.WHITE))
        if end == len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def test_empty_and_blank_texts_have_no_chunks():
    assert chunking.chunk_text("") == chunking.chunk_text(" \n ") == []


def test_windows_overlap():
    assert chunking.chunk_text("ABCDEFGH", 4, 2)[:3] == ["ABCD", "CDEF", "EFGH"]


def test_short_text_is_one_chunk():
    assert chunking.chunk_text("good morning") == ["good morning"]


def test_sentence_end_before_white_space_before_hard_cut():
    assert chunking.chunk_text("A first short sentence. Then more of it.", 26, 4)[0] == "A first short sentence."
    assert all(c == c.strip() for c in chunking.chunk_text("one three seven eleven", 12, 2))
    assert set("".join(chunking.chunk_text("z" * 50, 4, 2))) == {"z"}


@pytest.mark.parametrize("size,overlap", [(1, 0), (1, 5), (4, 3), (10, 2), (40, 39), (100, 20)])
def test_any_text_as_by_the_loop(size, overlap):
    d = random.Random(size)
    for _ in range(60):
        text = "".join(d.choice("ab c.\n!?  。é") for _ in range(d.randint(0, 300)))
        assert chunking.chunk_text(text, size, overlap) == plain(text, size, overlap)


def test_links_and_ids(spark):
    docs = spark.createDataFrame([(3, "x" * 2500, "k"), (4, None, "k"), (5, "", "k"), (6, "short", "k"), (None, "lost", "k")], "id long, text string, extra string")
    rows = chunking.chunks(docs).orderBy("chunk_id").collect()
    assert [(r.document_id, r.ordinal, r.extra) for r in rows] == [(3, 0, "k"), (3, 1, "k"), (3, 2, "k"), (6, 0, "k")]
    three = [r.chunk_id for r in rows[:3]]
    assert [r.prev for r in rows] == [None, *three[:2], None] and [r.next for r in rows] == [*three[1:], None, None]
    around = chunking.context(chunking.chunks(docs), chunking.chunks(docs).select("chunk_id").where(F.col("chunk_id") == three[0]), 1, 1)
    assert [r.chunk_id for r in around.collect()] == three[:2]


def test_given_chunks_stay_as_they_are(spark):
    rows = spark.createDataFrame([(1, 1, " b "), (1, 0, ""), (2, 0, "c")], "doc long, turn long, t string")
    got = [(r.document_id, r.ordinal, r.text) for r in chunking.presplit(rows, "doc", "turn", "t").orderBy("chunk_id").collect()]
    assert got == [(1, 0, ""), (1, 1, " b "), (2, 0, "c")]
