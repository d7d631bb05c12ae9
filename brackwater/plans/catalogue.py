"""The registered queries of the engine's operators, each over whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackwater.auth import allows
from brackwater.functions import text as X
from brackwater.functions import vectors as V
from brackwater.functions.crypto import derive_key, opened, rekeyed, sealed
from brackwater.operators import chunking, dense, lexical
from brackwater.operators.filters import compile_filter, request_filter
from brackwater.operators.search import merge_domains, search
from brackwater.plans import corpus as C
from brackwater.sources import extract as E
from brackwater.sources.shared import spread
from brackwater.sources.snapshots import prune_plan
from brackwater.streaming.jobs import lifecycle, retained

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# --- SQL building blocks -------------------------------------------------------------

_DOMAIN = "CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'es' THEN 3 WHEN 'fr' THEN 4 ELSE 5 END"
_CUT = r"""
SELECT document_id, domain_id, text, n, s,
  CASE WHEN s + 1000 >= n THEN n WHEN length(a) > 0 THEN f + length(a) WHEN length(b) > 0 THEN f + length(b) ELSE s + 1000 END AS e
FROM (SELECT *, regexp_extract(t, '^(.*[.!?\n。！？])', 1, 's') AS a, regexp_extract(t, '^(.*[\s\x0b\x85\p{Z}])', 1, 's') AS b
      FROM (SELECT *, s + 750 AS f, substr(text, s + 751, 250) AS t FROM (%s)))"""
_CHUNKS = (
    "docs AS (SELECT doc_id AS document_id, CAST(" + _DOMAIN + " AS BIGINT) AS domain_id, text, length(text) AS n FROM documents WHERE doc_id IS NOT NULL AND length(text) > 0),\n"
    "cut AS (" + _CUT % "SELECT *, 0 AS s FROM docs" + "\nUNION ALL\n"
    + _CUT % "SELECT document_id, domain_id, text, n, greatest(e - 200, s + 1) AS s FROM cut WHERE e < n" + "),\n"
    r"piece AS (SELECT document_id, domain_id, s, regexp_replace(substr(text, s + 1, e - s), '^[\s\x0b\x85\p{Z}]+|[\s\x0b\x85\p{Z}]+$', '', 'g') AS text FROM cut),"
    "\nplaced AS (SELECT document_id, domain_id, text, CAST(row_number() OVER (PARTITION BY document_id ORDER BY s) - 1 AS INTEGER) AS ordinal FROM piece WHERE text <> ''),\n"
    "chunks AS (SELECT *, document_id * 1048576 + ordinal AS chunk_id FROM placed)"
)
_TOKENS = r"list_transform(list_filter(string_split_regex(%s, '[^\p{L}\p{N}]+'), lambda x: length(x) >= 2), lambda x: lower(x))"
_TERMS = (
    "bags AS (SELECT domain_id, chunk_id, " + _TOKENS % "text" + " AS t FROM chunks),\n"
    "stats AS (SELECT domain_id, count(*) AS n, avg(len(t)) AS avgdl FROM bags GROUP BY 1),\n"
    "tf AS (SELECT domain_id, chunk_id, length, term, count(*) AS tf FROM (SELECT domain_id, chunk_id, len(t) AS length, unnest(t) AS term FROM bags) GROUP BY ALL),\n"
    "df AS (SELECT domain_id, term, count(*) AS df FROM tf GROUP BY ALL),\n"
    "asked AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest(" + _TOKENS % "text" + ") AS term FROM benchmark))"
)
_BM25 = (
    "lex_scores AS (SELECT domain_id, query_id, chunk_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avgdl))), 6) AS score\n"
    "  FROM tf JOIN df USING (domain_id, term) JOIN stats USING (domain_id) JOIN asked USING (term) %s GROUP BY ALL),\n"
    "lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain_id, query_id ORDER BY score DESC, chunk_id) AS rank FROM lex_scores) WHERE rank <= 50)"
)
_BUCKETS = (
    r"SELECT %s, list_reduce(list_transform(range(0, octet_length(encode(w))), lambda i: CAST('0x' || substr(hex(encode(w)), i * 2 + 1, 2) AS INTEGER)), lambda h, b: (xor(h, b) * 435) & 63, 37) AS bucket"
    r" FROM (SELECT %s, unnest(list_filter(string_split_regex(lower(text), '[\s\x0b\x85\p{Z}]+'), lambda x: x <> '')) AS w FROM %s)"
)
_DENSE = (
    "c_words AS (" + _BUCKETS % ("domain_id, chunk_id", "domain_id, chunk_id", "chunks") + "),\n"
    "c_count AS (SELECT domain_id, chunk_id, bucket, count(*)::DOUBLE AS x FROM c_words GROUP BY ALL),\n"
    "c_unit AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY chunk_id)) AS u FROM c_count),\n"
    "q_words AS (" + _BUCKETS % ("query_id", "query_id", "(SELECT item_id AS query_id, text FROM benchmark)") + "),\n"
    "q_count AS (SELECT query_id, bucket, count(*)::DOUBLE AS x FROM q_words GROUP BY ALL),\n"
    "q_unit AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY query_id)) AS u FROM q_count),\n"
    "sims AS (SELECT domain_id, query_id, chunk_id, round(sum(c.u * q.u), 6) AS score FROM c_unit c JOIN q_unit q USING (bucket) GROUP BY ALL),\n"
    "dense_all AS (SELECT q.query_id, c.domain_id, c.chunk_id, coalesce(score, 0.0) AS score FROM chunks c CROSS JOIN (SELECT item_id AS query_id FROM benchmark) q LEFT JOIN sims s ON s.query_id = q.query_id AND s.chunk_id = c.chunk_id),\n"
    "dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain_id, query_id ORDER BY score DESC, chunk_id) AS rank FROM dense_all) WHERE rank <= 50)"
)
_FUSED = (
    "said AS (SELECT DISTINCT domain_id, query_id FROM lex),\n"
    "both_lists AS (SELECT domain_id, query_id, chunk_id, rank FROM dense SEMI JOIN said USING (domain_id, query_id) UNION ALL SELECT domain_id, query_id, chunk_id, rank FROM lex),\n"
    "fused_scores AS (SELECT domain_id, query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM both_lists GROUP BY ALL\n"
    "  UNION ALL SELECT domain_id, query_id, chunk_id, score FROM dense ANTI JOIN said USING (domain_id, query_id)),\n"
    "fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY domain_id, query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM fused_scores)"
)
_HYBRID = "WITH RECURSIVE " + ",\n".join([_CHUNKS, _TERMS, _BM25 % "", _DENSE, _FUSED])
_TAGS = "tags AS (SELECT doc_id AS document_id, max(quality) = 1 AS quality, max(toxic) = 1 AS toxic FROM labels GROUP BY 1)"
_TAGGED = "WITH RECURSIVE " + _CHUNKS + ",\n" + _TAGS + ",\nfull_chunks AS (SELECT c.*, d.lang, d.source, coalesce(quality, false) AS quality, coalesce(toxic, false) AS toxic, t.document_id IS NOT NULL AS labelled FROM chunks c JOIN documents d ON d.doc_id = c.document_id LEFT JOIN tags t USING (document_id))\n"
_COSINE = "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),\nu AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),\n"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Make a function a query of that name, with the SQL for its rows."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


# --- cutting and linking -------------------------------------------------------------


@register("chunk_documents", "WITH RECURSIVE " + _CHUNKS + " SELECT document_id, ordinal, chunk_id, text FROM chunks")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.plain_chunks(spark, sf_dir).select("document_id", "ordinal", "chunk_id", "text")


@register("chunk_counts", "WITH RECURSIVE " + _CHUNKS + " SELECT domain_id, count(*) AS n_chunks, count(DISTINCT document_id) AS n_docs, sum(length(text)) AS n_chars FROM chunks GROUP BY 1")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.plain_chunks(spark, sf_dir).groupBy("domain_id").agg(F.count("*").alias("n_chunks"), F.countDistinct("document_id").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


@register("chunk_links", "WITH RECURSIVE " + _CHUNKS + " SELECT chunk_id, lag(chunk_id) OVER w AS prev, lead(chunk_id) OVER w AS next FROM chunks WINDOW w AS (PARTITION BY document_id ORDER BY ordinal)")
def chunk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.plain_chunks(spark, sf_dir).select("chunk_id", "prev", "next")


@register("chunk_context", "WITH RECURSIVE " + _CHUNKS + " SELECT a.chunk_id AS center, b.chunk_id, b.ordinal FROM chunks a JOIN chunks b ON a.document_id = b.document_id AND b.ordinal BETWEEN a.ordinal - 1 AND a.ordinal + 1")
def chunk_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = C.plain_chunks(spark, sf_dir).select("chunk_id", "ordinal")
    return chunking.context(table, table).select("center", "chunk_id", "ordinal")


@register("ingest_chunks_verbatim", """
SELECT conv_id * 1048576 + o AS chunk_id, conv_id AS document_id, CAST(o AS INTEGER) AS ordinal, text,
  CASE WHEN o > 0 THEN conv_id * 1048576 + o - 1 END AS prev, CASE WHEN o + 1 < n THEN conv_id * 1048576 + o + 1 END AS next
FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS o, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)""")  # fmt: skip
def ingest_chunks_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.presplit(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "text")


# --- words and statistics ------------------------------------------------------------


@register("tokenise_terms", "SELECT doc_id, " + _TOKENS % "text" + " AS terms FROM documents")
def tokenise_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", X.tokens(F.col("text")).alias("terms"))


@register("term_freq", "WITH RECURSIVE " + _CHUNKS + ",\n" + _TERMS + " SELECT domain_id, chunk_id, term, tf, length FROM tf")
def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(C.plain_chunks(spark, sf_dir))


@register("doc_freq", "WITH RECURSIVE " + _CHUNKS + ",\n" + _TERMS + " SELECT domain_id, term, df FROM df")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.document_frequency(C.plain_chunks(spark, sf_dir))


@register("bm25_stats", "WITH RECURSIVE " + _CHUNKS + ",\n" + _TERMS + " SELECT domain_id, n, round(avgdl, 6) AS avgdl FROM stats")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.statistics(C.plain_chunks(spark, sf_dir)).withColumn("avgdl", F.round("avgdl", 6))


@register("normalise_text", r"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '[\t\x0b\f\r\x85\p{Z}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS text FROM pages""")
def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", X.normalised(F.col("html")).alias("text"))


@register("mock_embedding", "WITH words AS (" + _BUCKETS % ("doc_id", "doc_id", "documents") + ") SELECT doc_id, CAST(bucket AS INTEGER) AS bucket, count(*) AS n FROM words GROUP BY ALL")
def mock_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(X.mock_embedding(C.DIM)(F.col("text"))).alias("bucket", "x"))
    return rows.where("x > 0").select("doc_id", "bucket", F.col("x").cast("long").alias("n"))


@register("format_utc", "SELECT event_id, strftime(ts, '%Y-%m-%d_%H-%M-%S') AS stamp FROM events")
def format_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp_ntz")
    millis = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts0)") / 1000
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts0", ts).select("event_id", X.format_utc(F.floor(millis)).alias("stamp"))


@register("model_prefixes", "SELECT item_id, 'query: ' || text AS as_query, 'passage: ' || text AS as_passage FROM benchmark")
def model_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = "multilingual-e5-small"
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", X.with_prefix(F.col("text"), model, True).alias("as_query"), X.with_prefix(F.col("text"), model, False).alias("as_passage"))


@register("sealed_texts", "SELECT doc_id, text FROM documents")
def sealed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts encrypted, put under another key, and opened again."""
    old, new = derive_key("one", b"salt", 1000), derive_key("two", b"salt", 1000)
    text = opened(rekeyed(sealed(F.col("text"), old, "documents"), old, new, "documents"), new, "documents")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.alias("text"))


# --- ranking -------------------------------------------------------------------------


def _bm25(where: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([_CHUNKS, _TERMS, _BM25 % where]) + " SELECT domain_id, query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM lex WHERE rank <= 10"


@register("bm25_topk", _bm25(""))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(C.indexed_chunks(spark, sf_dir), C.queries(spark, sf_dir), 10)


@register("bm25_filtered", _bm25("JOIN (SELECT doc_id FROM labels GROUP BY 1 HAVING max(quality) = 1) l ON l.doc_id = chunk_id // 1048576"))
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(C.indexed_chunks(spark, sf_dir), C.queries(spark, sf_dir), 10, compile_filter("tag:quality", C.TAGS))


def _cosine(where: str, score: str = "list_dot_product(q.e, c.e)") -> str:
    return (
        _COSINE + f"s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round({score}, 6) + 0.0 AS score FROM (SELECT * FROM u WHERE vec_id % 50 = 0) q CROSS JOIN u c {where})\n"
        "SELECT 1::BIGINT AS domain_id, query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10"
    )


@register("cosine_topk", _cosine(""))
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.scan(C.vectors(spark, sf_dir), C.vector_queries(spark, sf_dir), 10)


@register("cosine_filtered", _cosine("WHERE c.label IN (3, 5)"))
def cosine_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = compile_filter("tag:three OR tag:five", {"three": 3, "five": 5})
    return dense.scan(C.vectors(spark, sf_dir).where(allowed), C.vector_queries(spark, sf_dir), 10)


_STEPS = "list_transform(c.e, lambda x: greatest(least(round(x * 127), 127), -127))"


@register("sq_codes", _COSINE + "w AS (SELECT 1) SELECT vec_id, list_transform(e, lambda x: CAST(greatest(least(round(x * 127), 127), -127) AS INTEGER)) AS codes FROM u")
def sq_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", V.codes(F.col("embedding")).cast("array<int>").alias("codes"))


@register("sq_topk", _cosine("", f"list_dot_product(q.e, {_STEPS}) / 127"))
def sq_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.scan(C.vectors(spark, sf_dir), C.vector_queries(spark, sf_dir), 10, quantised=True)


@register("ann_cells")
def ann_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.Cells.build(C.vectors(spark, sf_dir)).search(C.vector_queries(spark, sf_dir), 10)


_HITS = "domain_id, query_id, CAST(rank AS INTEGER) AS rank, chunk_id, score"


@register("dense_topk", "WITH RECURSIVE " + _CHUNKS + ",\n" + _DENSE + f" SELECT {_HITS} FROM dense WHERE rank <= 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.scan(C.indexed_chunks(spark, sf_dir), C.queries(spark, sf_dir), 10)


@register("rrf_hybrid", _HYBRID + f" SELECT {_HITS} FROM fused WHERE rank <= 10")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(C.indexed_chunks(spark, sf_dir), C.queries(spark, sf_dir), 10, with_text=False)


@register("search_multi", _HYBRID + " SELECT domain_id, query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, chunk_id, score FROM fused WHERE rank <= 10 QUALIFY rank() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10")
def search_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_domains(search(C.indexed_chunks(spark, sf_dir), C.queries(spark, sf_dir), 10, with_text=False), 10)


_NOWHERE = "zzqx"


@register("hybrid_no_lexical_fallback", "WITH RECURSIVE " + _CHUNKS + ",\n" + _DENSE + f" SELECT {_HITS} FROM dense WHERE rank <= 10")
def hybrid_no_lexical_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries' vectors with a word that no chunk has: scores stay cosines."""
    asked = C.queries(spark, sf_dir).withColumn("text", F.lit(_NOWHERE))
    return search(C.indexed_chunks(spark, sf_dir), asked, 10, with_text=False)


@register("rerank_overlap", _HYBRID + ", pool AS (SELECT f.domain_id, f.query_id, f.chunk_id, f.rank AS old, len(list_intersect(" + _TOKENS % "c.text" + ", " + _TOKENS % "b.text" + "))::DOUBLE AS score FROM fused f JOIN chunks c USING (chunk_id) JOIN benchmark b ON b.item_id = f.query_id WHERE f.rank <= 20)\n"
          "SELECT domain_id, query_id, CAST(rank AS INTEGER) AS rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY domain_id, query_id ORDER BY score DESC, old) AS rank FROM pool) WHERE rank <= 10")  # fmt: skip
def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(C.indexed_chunks(spark, sf_dir), C.queries(spark, sf_dir), 10, reranker=X.overlap_score, with_text=False)


@register("search_snippets", _HYBRID + r""",
hit AS (SELECT f.*, c.text, list_min(list_filter(list_transform(list_filter(string_split_regex(lower(b.text), '[\s\x0b\x85\p{Z}]+'), lambda w: length(w) >= 2), lambda w: instr(lower(c.text), w)), lambda p: p > 0)) - 1 AS p
  FROM fused f JOIN chunks c USING (chunk_id) JOIN benchmark b ON b.item_id = f.query_id WHERE f.rank <= 10)
SELECT query_id, chunk_id, CASE WHEN p IS NOT NULL THEN CASE WHEN p > 120 THEN '…' ELSE '' END || substr(text, greatest(p - 120, 0) + 1, least(p + 120, length(text)) - greatest(p - 120, 0)) || CASE WHEN p + 120 < length(text) THEN '…' ELSE '' END END AS snippet FROM hit""")
def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(C.indexed_chunks(spark, sf_dir), C.queries(spark, sf_dir), 10).select("query_id", "chunk_id", "snippet")


@register("mmr_diverse", _HYBRID + """,
unit AS (SELECT chunk_id, list_transform(range(64), lambda b: coalesce(m[b], 0.0)) AS e FROM (SELECT chunk_id, map(list(bucket), list(u)) AS m FROM c_unit GROUP BY 1)),
pool AS (SELECT domain_id, query_id, list(chunk_id ORDER BY rank) AS ids, list(score ORDER BY rank) AS scores, list(e ORDER BY rank) AS es,
    list_transform(list(score ORDER BY rank), lambda s: (s - min(score)) / greatest(max(score) - min(score), 1.1920928955078125e-07)) AS rel
  FROM fused JOIN unit USING (chunk_id) WHERE rank <= 50 GROUP BY ALL),
step AS (
  SELECT domain_id, query_id, 0 AS rank, 0::BIGINT AS pick, []::BIGINT[] AS chosen, list_transform(ids, lambda i: 0.0::DOUBLE) AS alike FROM pool
  UNION ALL
  SELECT domain_id, query_id, rank + 1, pick, list_append(chosen, pick), list_transform(range(1, len(ids) + 1), lambda i: greatest(alike[i], list_dot_product(es[i], es[pick])))
  FROM (SELECT *, CAST(list_position(worth, list_max(worth)) AS BIGINT) AS pick FROM (
    SELECT p.*, s.rank, s.chosen, s.alike, list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN list_contains(s.chosen, i) THEN -1e9 ELSE round(0.5 * rel[i] - 0.5 * s.alike[i], 12) END) AS worth
    FROM step s JOIN pool p USING (domain_id, query_id) WHERE s.rank < least(10, len(ids)))))
SELECT s.domain_id, s.query_id, CAST(rank AS INTEGER) AS rank, ids[pick] AS chunk_id, scores[pick] AS score FROM step s JOIN pool USING (domain_id, query_id) WHERE rank > 0""")
def mmr_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(C.indexed_chunks(spark, sf_dir), C.queries(spark, sf_dir), 10, diversity=0.5, with_text=False)


# --- filters -------------------------------------------------------------------------


def _filter(name: str, text: str, where: str) -> None:
    @register(name, _TAGGED + f"SELECT domain_id, chunk_id FROM full_chunks WHERE {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return C.allowed_chunks(spark, sf_dir, compile_filter(text, C.TAGS)).select("domain_id", "chunk_id")


_filter("filter_tag", "tag:toxic", "toxic")
_filter("filter_doc", "doc:7 OR doc:21", "document_id IN (7, 21)")
_filter("filter_meta", 'meta.source:"src1" and META.lang:en', "source = 'src1' AND lang = 'en'")
_filter("filter_not", "NOT tag:quality", "NOT quality")
_filter("filter_nested", "(tag:quality OR tag:toxic) AND NOT (meta.lang:en OR meta.nowhere:x) OR tag:unknown", "(quality OR toxic) AND lang <> 'en'")


@register("filter_tags_any", _TAGGED + "SELECT chunk_id FROM full_chunks WHERE quality OR toxic")
def filter_tags_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.allowed_chunks(spark, sf_dir, request_filter(["quality", "toxic", "unknown"], tag_ids=C.TAGS)).select("chunk_id")


@register("filter_tags_all", _TAGGED + "SELECT chunk_id FROM full_chunks WHERE quality AND toxic")
def filter_tags_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.allowed_chunks(spark, sf_dir, request_filter(["quality", "toxic"], match_all=True, tag_ids=C.TAGS)).select("chunk_id")


@register("filter_subdomain", _TAGGED + "SELECT chunk_id FROM full_chunks WHERE source = 'src3' AND NOT quality")
def filter_subdomain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir).withColumns({"document_id": F.col("id"), "subdomain_id": F.regexp_extract("subdomain", "(\\d+)$", 1).try_cast("long")})
    return chunking.chunks(docs.where(request_filter(subdomain_id=3, filter_text="NOT tag:quality", tag_ids=C.TAGS))).select("chunk_id")


# --- the state of the tables ---------------------------------------------------------


@register("dedup_sha256", f"SELECT domain_id, sha256, doc_id, copies FROM (SELECT {_DOMAIN}::BIGINT AS domain_id, sha256(text) AS sha256, doc_id, row_number() OVER w AS r, count(*) OVER (PARTITION BY {_DOMAIN}, text) AS copies FROM documents WINDOW w AS (PARTITION BY {_DOMAIN}, text ORDER BY doc_id)) WHERE r = 1")
def dedup_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each content: min and count, which combine before the shuffle."""
    docs = C.documents(spark, sf_dir)
    return docs.groupBy("domain_id", X.content_hash(F.col("text")).alias("sha256")).agg(F.min("id").alias("doc_id"), F.count("*").alias("copies"))


@register("delete_tag", "WITH " + _TAGS + " SELECT document_id, CASE WHEN quality THEN [1::BIGINT] ELSE [] END AS tags FROM tags")
def delete_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir).where("tags is not null")
    return docs.select(F.col("id").alias("document_id"), F.array_remove("tags", F.lit(C.TAGS["toxic"]).cast("long")).alias("tags"))


@register("delete_subdomain", "WITH RECURSIVE " + _CHUNKS + " SELECT chunk_id FROM chunks JOIN documents ON doc_id = document_id WHERE source IS DISTINCT FROM 'src0'")
def delete_subdomain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the chunks when a topic goes with its documents."""
    return C.allowed_chunks(spark, sf_dir, ~F.col("subdomain").eqNullSafe("src0")).select("chunk_id")


@register("update_document", "WITH " + _TAGS + " SELECT doc_id AS document_id, CASE WHEN source = 'src1' THEN 'moved' ELSE source END AS subdomain FROM documents")
def update_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    return docs.select(F.col("id").alias("document_id"), F.when(F.col("subdomain") == "src1", "moved").otherwise(F.col("subdomain")).alias("subdomain"))


@register("scan_page", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100")
def scan_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the document listing: the limit is the feature."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source").orderBy("doc_id").offset(100).limit(50)


@register("is_supported", r"SELECT page_id, regexp_extract(lower(url), '[^./]*$') IN ('txt','text','md','markdown','csv','tsv','log','html','htm','xhtml','pdf','xlsx','xlsm','xlsb','xls','ods','docx') AS supported FROM pages")
def is_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", E.is_supported(F.col("url")).alias("supported"))


_BREAK = "(p|div|br|li|ul|ol|table|tr|h[1-6]|section|article|header|footer|main|nav|aside|pre|blockquote|hr|dt|dd|figure|form|title)"
_SHOWN = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(html, chr(10), ' '), '<!--.*?-->', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs'), '<![^>]*>', '', 'g'), '</?"
    + _BREAK + r"( [^>]*)?/?>', chr(10), 'g'), '<[^>]*>', '', 'g')"
)
_DECODED = "replace(replace(replace(replace(replace(replace(" + _SHOWN + ", '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_EVEN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(%s, '[\t\x0b\f\r\x85\p{Z}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"


@register("extract_html", "SELECT page_id, " + _EVEN % _DECODED + " AS text, CAST(NULL AS VARCHAR) AS error FROM pages")
def extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id").select("page_id", F.lit("page.html").alias("path"), F.encode("html", "UTF-8").alias("content"))
    return E.extract(pages).select("page_id", "text", "error")


_JOB_EVENTS = "SELECT user_id AS job_id, ts, CASE event_type WHEN 'view' THEN 'claim' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'fail' END AS event_type FROM events WHERE event_type IN ('view', 'purchase', 'error')"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "claim").when(F.col("event_type") == "purchase", "done").otherwise("fail")
    return spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type").isin("view", "purchase", "error")).select(F.col("user_id").alias("job_id"), "ts", kind.alias("event_type"))


@register("job_lifecycle", f"""WITH e AS ({_JOB_EVENTS}), s AS (SELECT job_id, count(*) FILTER (WHERE event_type = 'claim') AS attempts, arg_max(event_type, (ts, event_type)) AS last FROM e GROUP BY 1)
SELECT job_id, CASE WHEN last = 'done' THEN 'Done' WHEN last = 'claim' THEN 'Running' WHEN attempts >= 3 THEN 'Failed' ELSE 'Pending' END AS status, attempts FROM s""")
def job_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle(_jobs(spark, sf_dir))


@register("job_retention", "WITH j AS (SELECT event_id AS id, CASE event_type WHEN 'purchase' THEN 'Done' WHEN 'error' THEN 'Failed' ELSE 'Pending' END AS status, ts, max(ts) OVER () AS now FROM events) SELECT id, status FROM j WHERE status = 'Pending' OR epoch_ms(ts) >= epoch_ms(now) - 86400000")
def job_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ms = F.floor(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))") / 1000)
    status = F.when(F.col("event_type") == "purchase", "Done").when(F.col("event_type") == "error", "Failed").otherwise("Pending")
    jobs = events.select(F.col("event_id").alias("id"), status.alias("status"), ms.alias("updated_at"))
    return retained(jobs, jobs.agg(F.max("updated_at")).first()[0]).select("id", "status")


@register("backup_prune", """
WITH r AS (SELECT event_id AS id, CASE WHEN event_type = 'purchase' THEN 'full' ELSE 'differential' END AS kind, ts FROM events),
p AS (SELECT *, CASE WHEN kind = 'differential' THEN last_value(CASE WHEN kind = 'full' THEN id END IGNORE NULLS) OVER (PARTITION BY id // 1000 ORDER BY ts, id) END AS parent FROM r),
f AS (SELECT id FROM p WHERE kind = 'full' ORDER BY ts DESC, id DESC LIMIT 7)
SELECT id, kind, parent, coalesce(CASE WHEN kind = 'full' THEN id ELSE parent END IN (SELECT id FROM f), false) AS kept FROM p""")
def backup_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of many backups stay; a differential's parent is the full before it in its series."""
    kind = F.when(F.col("event_type") == "purchase", "full").otherwise("differential")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), kind.alias("kind"), F.col("ts").alias("created_at"))
    w = Window.partitionBy(F.floor(F.col("id") / 1000)).orderBy("created_at", "id")
    parent = F.last(F.when(F.col("kind") == "full", F.col("id")), ignorenulls=True).over(w)
    return prune_plan(rows.withColumn("parent", F.when(F.col("kind") == "differential", parent)), 7)


@register("permission_check", """
SELECT event_id, CASE event_type WHEN 'error' THEN false WHEN 'view' THEN false WHEN 'click' THEN user_id % 4 + 1 = 2 WHEN 'signup' THEN true ELSE true END AND ts >= TIMESTAMP '2024-01-10' AS allowed FROM events""")
def permission_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write permission on domain 2 for tokens of several scopes, some of which are expired."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    own = (F.col("user_id") % 4 + 1).cast("long")

    def scope(domain, perm: str):
        return F.array(F.struct((F.lit(None).cast("long") if domain is None else domain).alias("domain"), F.lit(perm).alias("perm")))

    kind = F.col("event_type")
    scopes = (
        F.when(kind == "error", F.array().cast("array<struct<domain:bigint,perm:string>>")).when(kind == "view", scope(None, "read"))
        .when(kind == "click", scope(own, "write")).when(kind == "signup", scope(None, "write")).otherwise(scope(None, "admin"))
    )
    expiry = F.col("ts").cast("timestamp_ntz") + F.expr("INTERVAL 1 MICROSECOND")
    return rows.select("event_id", allows(scopes, F.lit(2), "write", F.expr("timestamp_ntz'2024-01-10 00:00:00'"), expiry).alias("allowed"))
