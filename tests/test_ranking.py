import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from brackwater.functions import text as X
from brackwater.functions import vectors as V
from brackwater.functions.text import fnv1a
from brackwater.operators import dense, fusion, lexical
from brackwater.operators.search import merge_domains, search

VEC = "domain_id long, chunk_id long, embedding array<float>"


def corpus(spark, rows):
    return spark.createDataFrame([(1, i, None if v is None else list(map(float, v))) for i, v in rows], VEC)


def asked(spark, vectors):
    return spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(vectors)], "query_id long, vector array<float>")


def test_exact_search_orders_by_cosine_and_id(spark):
    rows = [(1, [2, 0]), (2, [1, 1]), (3, [0, 5]), (4, [0, 0]), (5, [1, 0]), (6, None), (7, [1, 0, 0])]
    got = [(r.chunk_id, r.score) for r in dense.scan(corpus(spark, rows), asked(spark, [[1, 0]]), 4).orderBy("rank").collect()]
    assert got == [(1, 1.0), (5, 1.0), (2, round(math.sqrt(0.5), 6)), (3, 0.0)]
    assert dense.scan(corpus(spark, rows), asked(spark, [[0, 0]]), 2).where("score <> 0").count() == 0
    assert dense.scan(corpus(spark, rows).where("false"), asked(spark, [[1, 0]]), 2).count() == 0
    assert dense.scan(corpus(spark, rows), asked(spark, [[1, 0]]).where("false"), 2).count() == 0


def test_many_batches_and_blocks_give_what_one_gives(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(700, 8)), rng.normal(size=(30, 8))
    c = corpus(spark, enumerate(x)).repartition(7)
    u, w = (a.astype(np.float32).astype(float) for a in (x, q))
    s = np.round((u / np.linalg.norm(u, axis=1, keepdims=True)) @ (w / np.linalg.norm(w, axis=1, keepdims=True)).T, 6)
    want = {(k, int(i)) for k in range(30) for i in np.lexsort((np.arange(700), -s[:, k]))[:10]}
    monkeypatch.setattr(dense, "query_blocks", lambda queries, f=dense.query_blocks: f(queries, 500))
    assert {(r.query_id, r.chunk_id) for r in dense.scan(c, asked(spark, q), 10).collect()} == want


def test_codes_round_halves_away_from_zero(spark):
    df = spark.createDataFrame([([3.0, -4.0],), ([0.0, 0.0],), ([1.0, 0.0],)], "v array<float>")
    assert [r.c for r in df.select(V.codes(F.col("v")).alias("c")).collect()] == [[76, -102], [0, 0], [127, 0]]
    assert V.quantise_rows(np.array([[3.0, -4.0], [0, 0], [1, 0]])).tolist() == [[76, -102], [0, 0], [127, 0]]


def test_quantised_search_is_close(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 32))
    c, q = corpus(spark, enumerate(x)), asked(spark, x[:20])
    a, b = ({(r.query_id, r.chunk_id): r.score for r in dense.scan(c, q, 10, quantised=z).collect()} for z in (False, True))
    assert len(a.keys() & b.keys()) >= 180
    assert max(abs(a[k] - b[k]) for k in a.keys() & b.keys()) < 0.01


def test_cells_find_most_and_a_filter_all_that_it_leaves(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(20, 16))
    x = centers[rng.integers(0, 20, 900)] + rng.normal(scale=0.3, size=(900, 16))
    c, q = corpus(spark, enumerate(x)), asked(spark, x[:40])
    cells = dense.Cells.build(c)
    exact, near = ({(r.query_id, r.chunk_id) for r in d.collect()} for d in (dense.scan(c, q, 10), cells.search(q, 10)))
    assert len(near) == 400 and len(exact & near) >= 360
    few = cells.search(q, 10, probes=1, allowed=F.col("chunk_id") < 12).collect()
    assert len(few) == 400 and all(r.chunk_id < 12 for r in few)
    assert len(cells.search(q, 10, probes=1, allowed=F.col("chunk_id") < 5).collect()) == 200


def test_cells_reach_the_recall_on_the_embeddings_table(spark, data):
    from brackwater.plans import catalogue

    exact, near = ({(r.query_id, r.chunk_id) for r in q(spark, data).select("query_id", "chunk_id").collect()} for q in (catalogue.cosine_topk, catalogue.ann_cells))
    assert len(near) == len(exact) and len(exact & near) >= 0.9 * len(exact)


def test_cells_read_grow_with_the_cells(spark):
    x = np.random.default_rng(4).normal(size=(2500, 24))
    c, q = corpus(spark, enumerate(x)), asked(spark, x[::2])
    exact, near = ({(r.query_id, r.chunk_id) for r in d.collect()} for d in (dense.scan(c, q, 10), dense.Cells.build(c).search(q, 10)))
    assert len(near) == len(exact) and len(exact & near) >= 0.9 * len(exact)


TEXTS = [(1, 1, "The cat sat on the mat"), (1, 2, "a dog and a cat"), (1, 3, "nothing of note"), (2, 4, "cat cat cat"), (1, 5, ""), (1, 6, None), (1, 7, "Zürich X y")]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "domain_id long, chunk_id long, text string")


def queries(spark, *words):
    return spark.createDataFrame([(k, w) for k, w in enumerate(words)], "query_id long, text string")


def bm25(rows, query):
    bags = {i: [w.lower() for w in "".join(c if c.isalnum() else " " for c in (t or "")).split() if len(w) >= 2] for i, t in rows}
    n, avg = len(bags), sum(map(len, bags.values())) / len(bags)
    out = {}
    for i, bag in bags.items():
        s = 0
        for term in set(query.lower().split()):
            tf, df = bag.count(term), sum(term in b for b in bags.values())
            if tf:
                s += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(bag) / avg))
        if s:
            out[i] = round(s, 6)
    return out


def test_bm25_is_the_formula(spark, texts):
    got = {r.chunk_id: r.score for r in lexical.scores(texts, queries(spark, "cat mat cat")).where("domain_id = 1").collect()}
    assert got == bm25([(i, t) for d, i, t in TEXTS if d == 1], "cat mat")
    assert [r.chunk_id for r in lexical.search(texts, queries(spark, "CAT"), 1).orderBy("chunk_id").collect()] == [2, 4]


def test_a_filter_leaves_the_statistics_alone(spark, texts):
    every = {r.chunk_id: r.score for r in lexical.scores(texts, queries(spark, "cat")).collect()}
    some = {r.chunk_id: r.score for r in lexical.scores(texts, queries(spark, "cat"), F.col("chunk_id") != 1).collect()}
    assert some == {k: v for k, v in every.items() if k != 1}


def test_words(spark, texts):
    got = [r.t for r in texts.orderBy("chunk_id").select(X.tokens(F.col("text")).alias("t")).collect()]
    assert got[0] == ["the", "cat", "sat", "on", "the", "mat"] and got[5] is None and got[6] == ["zürich"]


def test_fusion_and_the_fallback(spark):
    kind = "domain_id long, query_id long, chunk_id long, score double, rank int"
    d = spark.createDataFrame([(1, 0, 5, 0.9, 1), (1, 0, 6, 0.8, 2), (1, 1, 5, 0.7, 1)], kind)
    w = spark.createDataFrame([(1, 0, 6, 3.0, 1), (1, 0, 7, 2.0, 2)], kind)
    got = {(r.query_id, r.chunk_id): (r.rank, r.score) for r in fusion.hybrid(d, w, 10).collect()}
    assert got[0, 6] == (1, round(1 / 62 + 1 / 61, 9)) and got[0, 5][0] == 2 and got[0, 7][0] == 3
    assert got[1, 5] == (1, 0.7)


def test_diversity_passes_over_copies():
    v = [[1, 0], [1, 0], [0, 1], None]
    assert fusion.mmr_order(np.array([1.0, 0.99, 0.5, 0.4]), v, 0.5, 3) == [0, 2, 3]
    assert fusion.mmr_order(np.array([1.0, 0.99, 0.5, 0.4]), v, 0.0, 3) == [0, 1, 2]
    assert fusion.mmr_order(np.array([]), [], 0.5, 3) == []


def test_diversity_in_a_search(spark):
    rows = [(1, k, "same words here", [1.0, 0.0]) for k in range(4)] + [(1, 9, "same other words", [0.6, 0.8])]
    c = spark.createDataFrame(rows, "domain_id long, chunk_id long, text string, embedding array<float>")
    q = spark.createDataFrame([(0, "same words", [1.0, 0.1])], "query_id long, text string, vector array<float>")
    plain, varied = (search(c, q, 2, diversity=d).orderBy("rank").collect() for d in (0.0, 0.9))
    assert [r.chunk_id for r in plain] == [0, 1] and [r.chunk_id for r in varied] == [0, 9]
    assert varied[0].snippet == "same words here"


def test_reranking_replaces_scores(spark):
    rows = [(1, 1, "alpha", [1.0, 0.0]), (1, 2, "alpha beta", [0.0, 1.0])]
    c = spark.createDataFrame(rows, "domain_id long, chunk_id long, text string, embedding array<float>")
    q = spark.createDataFrame([(0, "alpha beta", [1.0, 0.0]), (1, None, [1.0, 0.0])], "query_id long, text string, vector array<float>")
    got = [(r.query_id, r.chunk_id, r.score) for r in search(c, q, 2, reranker=X.overlap_score).orderBy("query_id", "rank").collect()]
    assert got == [(0, 2, 2.0), (0, 1, 1.0), (1, 1, 1.0), (1, 2, 0.0)]


def test_merging_domains(spark):
    hits = spark.createDataFrame([(1, 0, 1, 5, 0.9), (2, 0, 1, 6, 0.95), (2, 0, 2, 7, 0.1)], "domain_id long, query_id long, rank int, chunk_id long, score double")
    assert [(r.chunk_id, r.rank) for r in merge_domains(hits, 2).orderBy("rank").collect()] == [(6, 1), (5, 2)]


def test_snippets(spark):
    text = "x" * 200 + " Needle " + "y" * 200
    df = spark.createDataFrame([(text, "the needle"), ("short Needle", "needle"), ("none", "needle"), ("a b", "a"), (None, "a")], "t string, q string")
    got = [r.s for r in df.select(X.snippet(F.col("t"), F.col("q")).alias("s")).collect()]
    assert got[0] == "…" + text[81:321] + "…" and got[1:] == ["short Needle", None, None, None]


def test_small_functions(spark):
    assert [X.parse_duration(t) for t in ("90", "30s", "15m", "6h", " 1d ", "2w", "", "x", "1y", "-1s")] == [90, 30, 900, 21600, 86400, 1209600, None, None, None, None]
    row = spark.range(1).select(X.format_utc(F.lit(1_700_000_000_123)).alias("u"), X.content_hash(F.lit("abc")).alias("h"), X.normalised(F.lit(" a \t b\r\n\n\n\nc ")).alias("n")).first()
    assert (row.u, row.n) == ("2023-11-14_22-13-20", "a b\n\nc") and row.h.startswith("ba7816bf")
    assert X.fnv1a([b"", b"a", b"foobar"]).tolist() == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]
    assert X.embed_counts(["a a b", "", None], 4)[0].sum() == 3 and X.embed_counts(["", None], 4)[1] is None


def test_sealed_columns(spark):
    from brackwater.functions import crypto

    key, other = crypto.derive_key("a", b"s", 10), crypto.derive_key("b", b"s", 10)
    df = spark.createDataFrame([("secret ü",), ("",), (None,)], "t string").withColumn("c", crypto.sealed(F.col("t"), key, "x"))
    assert [r.o for r in df.select(crypto.opened("c", key, "x").alias("o")).collect()] == ["secret ü", "", None]
    for wrong in (crypto.opened("c", other, "x"), crypto.opened("c", key, "y")):
        with pytest.raises(Exception, match="AES"):
            df.select(wrong).collect()
    assert crypto.blind_name("n", key) == crypto.blind_name("n", key) != crypto.blind_name("n", other)


def test_index_kinds_agree(spark):
    rng = np.random.default_rng(9)
    rows = [(1 + k % 2, k, f"word{k % 5}", list(map(float, v))) for k, v in enumerate(rng.normal(size=(120, 8)))]
    c = spark.createDataFrame(rows, "domain_id long, chunk_id long, text string, embedding array<float>")
    q = spark.createDataFrame([(0, "word1", rows[3][3])], "query_id long, text string, vector array<float>")
    best = {i: search(c, q, 3, index=i, with_text=False).where("rank = 1").orderBy("domain_id").collect() for i in ("flat", "scalar", "hnsw")}
    assert best["flat"] == best["hnsw"] and [r.chunk_id for r in best["flat"]] == [r.chunk_id for r in best["scalar"]]
    with pytest.raises(ValueError):
        search(c, q, 3, index="tree")


def peak(work):
    """Bytes that a call holds at most, besides what was there."""
    tracemalloc.start()
    try:
        out = work()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_postings_count_each_chunk_where_it_lies(spark):
    rows = [(1, 10, "b a b ab ab AB cd"), (2, 11, None), (1, 12, "  "), (2, 13, "ab zz")]
    found = lexical.postings(spark.createDataFrame(rows, "domain_id long, chunk_id long, text string"))
    assert sorted(map(tuple, found.collect())) == [(1, 10, "ab", 3, 4), (1, 10, "cd", 1, 4), (2, 13, "ab", 1, 2), (2, 13, "zz", 1, 2)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_scoring_a_batch_of_chunks_takes_little_memory_and_gives_k_rows_a_query():
    rng, rows, hits, queries, terms = np.random.default_rng(3), 4000, 50, 200, 300
    row, term = np.repeat(np.arange(rows), hits), rng.integers(0, terms, rows * hits)
    part, table = rng.random(rows * hits), rng.random((terms, queries)) < 0.2
    got, most = peak(lambda: list(lexical._scored(row, term, part, np.arange(rows), np.arange(queries), table, 1, 5)))
    assert most < 60 << 20  # what the terms add is 320 MB
    assert sum(b.num_rows for b in got) == 5 * queries  # not for each part of the batch
    for q in (0, 77, 199):
        score = np.round(np.bincount(row, np.where(table[term, q], part, 0)), 6)
        want = sorted(range(rows), key=lambda r: (-score[r], r))[:5]
        found = sorted((-s, c) for b in got for query, c, s in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))) if query == q)[:5]
        assert [c for _, c in found] == want


def test_scanning_a_batch_of_vectors_takes_little_memory_and_gives_k_rows_a_query():
    rng = np.random.default_rng(4)
    x, q = rng.standard_normal((5000, 16)), rng.standard_normal((1500, 16))
    got, most = peak(lambda: list(dense.nearest_of(x, np.arange(5000), q, 3)))
    assert most < 60 << 20  # all scores are 60 MB, and were held several times
    query, found, score = (np.concatenate([g[k] for g in got]) for k in range(3))
    assert np.bincount(query).tolist() == [3] * 1500
    for k in (0, 700, 1499):
        assert found[query == k].tolist() == np.lexsort((np.arange(5000), -np.round(x @ q[k], 6)))[:3].tolist()


def test_a_long_word_widens_no_table_of_short_ones():
    words = [b"%d" % k for k in range(20000)] + [b"x" * 20000, b""]
    got, most = peak(lambda: fnv1a(words))
    assert most < 40 << 20  # one table was 400 MB

    def one(word):
        h = 0xCBF29CE484222325
        for c in word:
            h = (h ^ c) * 0x100000001B3 % (1 << 64)
        return h

    assert [int(got[k]) for k in (0, 7, 19999, 20000, 20001)] == [one(words[k]) for k in (0, 7, 19999, 20000, 20001)]
