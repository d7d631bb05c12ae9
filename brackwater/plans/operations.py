"""The registered queries of the engine's own calls, each on a store of its own, with their SQL.

The documents are ingested once in an application, a domain for each language; every
query forks that store, which copies no table, and works on the fork.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brackwater.engine import Engine, NotFound
from brackwater.functions.crypto import derive_key
from brackwater.functions.text import MODELS, duration_seconds, mock_embedding
from brackwater.operators import dense
from brackwater.operators.counters import counted
from brackwater.operators.filters import FilterError, compile_filter, request_filter
from brackwater.operators.search import INDEXES, index_of, search, with_chunks
from brackwater.plans import corpus as C
from brackwater.plans.catalogue import _BM25, _CHUNKS, _DENSE, _DOMAIN, _FUSED, _HITS, _HYBRID, _TAGGED, _TERMS, register
from brackwater.sources.shared import kept, shared_path
from brackwater.sources.snapshots import Snapshots, kind_of_backup
from brackwater.streaming.jobs import ingest_stream

NOW = 1_700_000_000_000
LANGUAGES = ("de", "en", "es", "fr")

# --- SQL: documents as the engine numbers them ------------------------------------------

_NAMED = (
    f"named AS (SELECT doc_id, coalesce(text, '') AS text, source, lang, CAST({_DOMAIN} AS BIGINT) AS domain_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS m,\n"
    "  row_number() OVER (PARTITION BY lang, coalesce(text, '') ORDER BY doc_id) AS copy FROM documents WHERE lang IN ('de', 'en', 'es', 'fr')),\n"
    "begun AS (SELECT domain_id, 1 + coalesce(sum(width) OVER (ORDER BY domain_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM (SELECT domain_id, max(m) FILTER (WHERE copy = 1) + 1 AS width FROM named GROUP BY 1)),\n"
    "answers AS (SELECT n.*, CAST(min(begin + m) OVER (PARTITION BY n.domain_id, text) AS BIGINT) AS document_id, copy > 1 AS duplicate FROM named n JOIN begun USING (domain_id)),\n"
    "stored AS (SELECT a.*, list_sort(list_filter([CASE WHEN q = 1 THEN 'quality' END, CASE WHEN x = 1 THEN 'toxic' END], lambda l: l IS NOT NULL)) AS labels\n"
    "  FROM answers a LEFT JOIN (SELECT doc_id, max(quality) AS q, max(toxic) AS x FROM labels GROUP BY 1) USING (doc_id) WHERE copy = 1)"
)
_OWN_CHUNKS = "docs AS (SELECT document_id, domain_id, text, length(text) AS n FROM stored WHERE length(text) > 0),\n" + _CHUNKS.split(",\n", 1)[1]
_STORE = "WITH RECURSIVE " + _NAMED + ",\n" + _OWN_CHUNKS + "\n"
_FIRST = "(SELECT min(document_id) FROM stored WHERE domain_id = %d)"


def _asked(texts: str, more: str = "", allowed: str | None = None) -> str:
    """SQL of hybrid search over the store for queries (item_id, text), whose words are those of the text and of more; in the documents that a condition allows."""
    dense_part, lexical = _DENSE, ""
    pieces = [_NAMED, _OWN_CHUNKS, f"asked_for AS ({texts})", f"asked_words AS (SELECT item_id, text || '{more}' AS text FROM asked_for)"]
    if allowed:
        pieces.append(f"allowed AS (SELECT document_id FROM stored WHERE {allowed})")
        lexical = "SEMI JOIN allowed a ON a.document_id = chunk_id // 1048576"
        dense_part = dense_part.replace("FROM chunks c CROSS JOIN", "FROM (SELECT * FROM chunks SEMI JOIN allowed USING (document_id)) c CROSS JOIN")
    pieces += [_TERMS.replace("FROM benchmark", "FROM asked_words"), _BM25 % lexical, dense_part.replace("FROM benchmark", "FROM asked_for"), _FUSED]
    return "WITH RECURSIVE " + ",\n".join(pieces) + "\n"


# --- the store --------------------------------------------------------------------------


def _build(spark: SparkSession, sf_dir: str, path: str) -> None:
    engine = Engine(spark, f"{path}/store", clock=lambda: NOW)
    docs = C.documents(spark, sf_dir)
    labels = F.array_compact(F.array(*(F.when(F.array_contains("tags", F.lit(i).cast("long")), F.lit(name)) for name, i in C.TAGS.items())))
    rows = docs.select("domain_id", F.col("id").alias("n"), F.concat(F.lit("doc "), "id").alias("title"), "subdomain", labels.alias("labels"), "metadata", "text")
    for lang in LANGUAGES:
        d = engine.create_domain(lang)
        own = rows.where(F.col("metadata")["lang"] == lang).drop("domain_id")
        engine.ingest(d, own).withColumn("domain_id", F.lit(d).cast("long")).write.mode("append").parquet(f"{path}/answers")


def _base(spark: SparkSession, sf_dir: str) -> str:
    return kept(spark, (sf_dir, "engine"), lambda path: _build(spark, sf_dir, path))


def _engine(spark: SparkSession, sf_dir: str, **settings) -> Engine:
    """An engine on a fork of the store."""
    return Engine(spark, _base(spark, sf_dir) + "/store", clock=lambda: NOW, **settings).fork(shared_path(spark, "fork"))


def _named(engine: Engine, domain_id: int) -> DataFrame:
    """(document_id, subdomain, labels) with names for ids."""
    docs = engine.table("documents", [domain_id])
    subs = engine.table("subdomains", [domain_id]).select(F.col("id").alias("subdomain_id"), F.col("name").alias("subdomain"))
    tags = engine.table("tags", [domain_id]).select(F.col("id").alias("tag"), F.col("name").alias("label"))
    each = docs.select("id", "subdomain_id", F.explode_outer("tags").alias("tag")).join(tags, "tag", "left").join(subs, "subdomain_id", "left")
    return each.groupBy(F.col("id").alias("document_id"), "subdomain").agg(F.array_sort(F.collect_list("label")).alias("labels"))


def _left(engine: Engine) -> DataFrame:
    """The chunks that have a vector."""
    return engine.corpus([r.id for r in engine.table("domains").select("id").collect()]).where("embedding is not null").select("domain_id", "chunk_id")


def _first(engine: Engine, domain_id: int) -> int:
    return engine.page("documents", domain_id, 0, 1).first().id


# --- ingest, listings, lookups ----------------------------------------------------------


@register("engine_ingest", _STORE + """SELECT a.domain_id, doc_id, document_id, CAST(CASE WHEN duplicate THEN 0 ELSE coalesce(c.n, 0) END AS INTEGER) AS chunk_count, duplicate
FROM answers a LEFT JOIN (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1) c USING (document_id)""")  # fmt: skip
def engine_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ingesting gave for each document: the first of each content is stored."""
    return spark.read.parquet(_base(spark, sf_dir) + "/answers").withColumnRenamed("n", "doc_id")


@register("engine_documents", _STORE + "SELECT document_id, domain_id, 'doc ' || doc_id AS title, source AS subdomain, lang, labels FROM stored")
def engine_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored documents, with names for the ids of labels and topics, which were made on ingest."""
    engine = _engine(spark, sf_dir)
    names = reduce(DataFrame.unionByName, (_named(engine, d) for d in range(1, 5)))
    return engine.table("documents").select(F.col("id").alias("document_id"), "domain_id", "title", F.col("metadata")["lang"].alias("lang")).join(names, "document_id")


@register("engine_chunks", _STORE + "SELECT domain_id, document_id, chunk_id, ordinal, text, lag(chunk_id) OVER w AS prev, lead(chunk_id) OVER w AS next FROM chunks WINDOW w AS (PARTITION BY document_id ORDER BY ordinal)")
def engine_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).table("chunks").select("domain_id", "document_id", F.col("id").alias("chunk_id"), "ordinal", "text", "prev", "next")


@register("engine_hashes", _STORE + "SELECT domain_id, sha256(text) AS sha256, document_id FROM stored")
def engine_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).table("document_hashes")


@register("engine_domains", "SELECT * FROM (VALUES (1::BIGINT, 'de', 'mock', 64), (2, 'en', 'mock', 64), (3, 'es', 'mock', 64), (4, 'fr', 'mock', 64)) t(id, name, model, dim)")
def engine_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of all domains."""
    return _engine(spark, sf_dir).table("domains").select("id", "name", "model", "dim")


@register("engine_page", _STORE + "SELECT document_id, 'doc ' || doc_id AS title FROM stored WHERE domain_id = 2 ORDER BY document_id LIMIT 20 OFFSET 10")
def engine_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a domain's documents: the limit is the feature."""
    return _engine(spark, sf_dir).page("documents", 2, 10, 20).select(F.col("id").alias("document_id"), "title")


@register("engine_page_most", _STORE + "SELECT chunk_id FROM chunks WHERE domain_id = 2 ORDER BY chunk_id LIMIT 500")
def engine_page_most(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page that asks for more rows than a page may have."""
    return _engine(spark, sf_dir).page("chunks", 2, 0, 100_000).select(F.col("id").alias("chunk_id"))


@register("engine_lookup", _STORE + "SELECT 'domains' AS kind, 2::BIGINT AS id, 'en' AS found UNION ALL SELECT 'documents', document_id, 'doc ' || doc_id FROM stored WHERE document_id = " + _FIRST % 2
          + " UNION ALL SELECT 'chunks', chunk_id, text FROM chunks WHERE document_id = " + _FIRST % 2 + " AND ordinal = 0 UNION ALL SELECT 'documents', -1, NULL")
def engine_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by their ids, and an id that isn't there."""
    engine, rows = _engine(spark, sf_dir), []
    first = _first(engine, 2)
    for kind, row_id, field in (("domains", 2, "name"), ("documents", first, "title"), ("chunks", first << 20, "text"), ("documents", -1, "title")):
        try:
            rows.append((kind, row_id, engine.get(kind, row_id)[field]))
        except NotFound:
            rows.append((kind, row_id, None))
    return spark.createDataFrame(rows, "kind string, id long, found string")


@register("engine_counts", _STORE + "SELECT 'documents' AS name, count(*) AS n FROM stored UNION ALL SELECT 'chunks', count(*) FROM chunks UNION ALL SELECT 'tokens', 0 UNION ALL SELECT 'persisted indexes', 0")
def engine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of rows, and of the indexes that had to be written: none, as tables are the index."""
    engine = _engine(spark, sf_dir)
    rows = [(name, engine.count(name)) for name in ("documents", "chunks", "tokens")] + [("persisted indexes", engine.persist_indexes())]
    return spark.createDataFrame(rows, "name string, n long")


@register("engine_context", _STORE + "SELECT chunk_id, ordinal FROM chunks WHERE document_id = (SELECT min(document_id) FROM chunks WHERE domain_id = 2 AND ordinal = 2) AND ordinal BETWEEN 1 AND 4")
def engine_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    third = engine.table("chunks", [2]).where("ordinal = 2").agg(F.min("id")).first()[0]
    return engine.chunk_context(third, 1, 2).select(F.col("id").alias("chunk_id"), "ordinal")


# --- edits ------------------------------------------------------------------------------


@register("engine_delete_document", _STORE + "SELECT domain_id, chunk_id FROM chunks WHERE document_id <> " + _FIRST % 1)
def engine_delete_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    engine.delete_document(_first(engine, 1))
    return _left(engine)


@register("engine_compact", _STORE + "SELECT domain_id, chunk_id FROM chunks WHERE document_id <> " + _FIRST % 1)
def engine_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A domain written anew after a deletion: one part, and nothing noted as deleted."""
    engine = _engine(spark, sf_dir)
    engine.delete_document(_first(engine, 1))
    engine.compact(1)
    raw = engine.store.table("chunks")
    parts = [p for p in engine.store.manifest()["chunks"] if p[1] == 1]
    return raw.where(F.lit(len(parts) == 1) & F.lit(engine.count("deletions") == 0)).select("domain_id", F.col("id").alias("chunk_id"))


@register("engine_rekey", _STORE + "SELECT chunk_id, text, false AS plain FROM chunks WHERE domain_id = 4")
def engine_rekey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store whose texts are sealed under one key, then under another: what it gives, and whether a text lies there as such."""
    engine = _engine(spark, sf_dir)
    for passphrase in ("one", "two"):
        engine.store.rekey(derive_key(passphrase, b"salt", 1000))
    path = [p for p, domain in engine.store.manifest()["chunks"] if domain == 4]
    raw = spark.read.parquet(*path).select(F.col("id").alias("raw_id"), F.col("text").alias("raw"))
    chunks = Engine(spark, engine.store.root, key=derive_key("two", b"salt", 1000)).table("chunks", [4])
    return chunks.join(raw, chunks["id"] == raw["raw_id"]).select(F.col("id").alias("chunk_id"), "text", F.col("raw").contains(F.col("text")).alias("plain"))


@register("engine_delete_subdomain", _STORE + "SELECT domain_id, chunk_id FROM chunks JOIN stored USING (domain_id, document_id) WHERE domain_id <> 1 OR source <> 'src0'")
def engine_delete_subdomain(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    engine.delete_subdomain(engine.subdomain_ids(1)["src0"])
    return _left(engine)


@register("engine_delete_domain", _STORE + "SELECT domain_id, chunk_id FROM chunks WHERE domain_id <> 3")
def engine_delete_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    engine.delete_domain(3)
    return _left(engine)


@register("engine_delete_tag", _STORE + "SELECT document_id, source AS subdomain, list_filter(labels, lambda l: l <> 'toxic') AS labels FROM stored WHERE domain_id = 2")
def engine_delete_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    engine.delete_tag(engine.tag_ids(2)["toxic"])
    return _named(engine, 2)


@register("engine_update_document", _STORE + "SELECT document_id, CASE WHEN document_id = f THEN 'moved' ELSE source END AS subdomain, CASE WHEN document_id = f THEN ['fresh', 'toxic'] ELSE labels END AS labels FROM stored, (SELECT "
          + _FIRST % 2 + " AS f) WHERE domain_id = 2")
def engine_update_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other labels, one of them new, and a new topic for one document."""
    engine = _engine(spark, sf_dir)
    engine.update_document(_first(engine, 2), labels=["toxic", "fresh"], subdomain="moved")
    return _named(engine, 2)


@register("engine_rename", "SELECT * FROM (VALUES ('domain', 'german', NULL), ('domain', 'en', NULL), ('domain', 'es', NULL), ('domain', 'fr', NULL), ('tag', 'quality', 'Good'), ('tag', 'toxic', 'toxic')) t(kind, name, display_name)")
def engine_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A domain with another name, a label with another display name; the label's name stays."""
    engine = _engine(spark, sf_dir)
    engine.rename_domain(1, "german")
    engine.update_tag(engine.tag_ids(1)["quality"], display_name="Good")
    domains = engine.table("domains").select(F.lit("domain").alias("kind"), "name", F.lit(None).cast("string").alias("display_name"))
    return domains.unionByName(engine.table("tags", [1]).select(F.lit("tag").alias("kind"), "name", "display_name"))


@register("engine_create_tag", "SELECT * FROM (VALUES ('child', true, 'a label'), ('quality', false, NULL), ('toxic', false, NULL)) t(name, has_parent, description)")
def engine_create_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    engine.create_tag(2, "child", description="a label", parent=engine.tag_ids(2)["toxic"])
    return engine.table("tags", [2]).select("name", F.col("parent").isNotNull().alias("has_parent"), "description")


@register("engine_reindex", _STORE + f"SELECT chunk_id, {MODELS['all-minilm-l6-v2'][0]} AS size, CAST(length(text) AS DOUBLE) AS value FROM chunks WHERE domain_id = 4")
def engine_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of a domain embedded again by another embedder, a function that is passed in."""
    dim = MODELS["all-minilm-l6-v2"][0]
    by_length = {"mock": mock_embedding(C.DIM), "all-minilm-l6-v2": lambda text: F.array_repeat(F.length(text).cast("float"), dim)}
    engine = _engine(spark, sf_dir, embedders=by_length)
    engine.reindex_domain(4, "all-minilm-l6-v2")
    return engine.table("embeddings", [4]).select("chunk_id", F.size("embedding").alias("size"), F.col("embedding")[383].cast("double").alias("value"))


@register("engine_chunker", "SELECT item_id AS document, CAST(i - 1 AS INTEGER) AS ordinal, p[i] AS text FROM (SELECT item_id, string_split(text, ' ')[1:1] || [array_to_string(string_split(text, ' ')[2:], ' ')] AS p, unnest(range(1, 3)) AS i FROM benchmark)")
def engine_chunker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut by a chunker that is passed in: the first word, and the rest."""
    engine = Engine(spark, shared_path(spark, "own"), clock=lambda: NOW, chunker=lambda text: text.split(" ", 1))
    d = engine.create_domain("items")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    engine.ingest(d, items.select(F.col("item_id").alias("n"), F.col("item_id").cast("string").alias("title"), "text"), dedup=False)
    titles = engine.table("documents", [d]).select(F.col("id").alias("document_id"), F.col("title").cast("long").alias("document"))
    return engine.table("chunks", [d]).join(titles, "document_id").select("document", "ordinal", "text")


@register("engine_restore", _STORE + "SELECT domain_id, count(*) AS n FROM chunks GROUP BY 1")
def engine_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full and a differential snapshot around a deletion, then the full one restored and folders that nothing names deleted."""
    engine = _engine(spark, sf_dir)
    snapshots = Snapshots(engine.store, shared_path(spark, "backups"))
    full = snapshots.full(1)
    engine.delete_domain(1)
    snapshots.differential(2)
    snapshots.restore(full["id"])
    engine.store.vacuum(1, list(snapshots.manifests()))
    return engine.table("chunks").groupBy("domain_id").agg(F.count("*").alias("n"))


# --- search -----------------------------------------------------------------------------

_ITEM = "SELECT item_id, text FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)"


def _item(spark: SparkSession, sf_dir: str) -> str:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text


@register("engine_search", _asked(_ITEM) + "SELECT CAST(rank AS INTEGER) AS rank, chunk_id, score, c.text FROM fused JOIN chunks c USING (domain_id, chunk_id) WHERE domain_id = 2 AND rank <= 10")
def engine_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of one text."""
    return _engine(spark, sf_dir).search(2, _item(spark, sf_dir)).select("rank", "chunk_id", "score", "text")


@register("engine_search_vector", _asked(_ITEM) + "SELECT CAST(rank AS INTEGER) AS rank, chunk_id, score FROM dense WHERE domain_id = 2 AND rank <= 10")
def engine_search_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of one vector, which no words take part in."""
    engine = _engine(spark, sf_dir)
    vector = engine.queries("mock", [_item(spark, sf_dir)]).first().vector
    return engine.search(2, vector=vector).select("rank", "chunk_id", "score")


@register("engine_search_both", _asked(_ITEM, " the") + "SELECT CAST(rank AS INTEGER) AS rank, chunk_id, score FROM fused WHERE domain_id = 2 AND rank <= 10")
def engine_search_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector and a text that isn't its own."""
    engine, text = _engine(spark, sf_dir), _item(spark, sf_dir)
    vector = engine.queries("mock", [text]).first().vector
    return engine.search(2, text=text + " the", vector=vector).select("rank", "chunk_id", "score")


@register("engine_search_multi", _asked(_ITEM) + "SELECT domain_id, CAST(row_number() OVER (ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, chunk_id, score FROM fused WHERE rank <= 10 AND domain_id IN (1, 2, 4) QUALIFY row_number() OVER (ORDER BY score DESC, chunk_id) <= 10")
def engine_search_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several domains, one of them named twice, by raw score."""
    return _engine(spark, sf_dir).search_multi([2, 1, 2, 4], _item(spark, sf_dir)).select("domain_id", "rank", "chunk_id", "score")


@register("engine_search_filtered", _asked(_ITEM, allowed="source = 'src1' AND list_contains(labels, 'quality') AND lang = 'en'") + "SELECT CAST(rank AS INTEGER) AS rank, chunk_id, score FROM fused WHERE domain_id = 2 AND rank <= 10")
def engine_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, a topic and a filter at once."""
    hits = _engine(spark, sf_dir).search(2, _item(spark, sf_dir), labels=["quality", "nowhere"], subdomain="src1", filter="meta.lang:en")
    return hits.select("rank", "chunk_id", "score")


@register("engine_search_unknown", "SELECT * FROM (VALUES ('all labels', 0::BIGINT), ('one label', 0), ('topic', 0), ('document', 0)) t(name, hits)")
def engine_search_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that the domain doesn't have: no hits, and no error."""
    engine, text = _engine(spark, sf_dir), _item(spark, sf_dir)
    asks = {"all labels": {"labels": ["quality", "nowhere"], "match_all": True}, "one label": {"labels": ["nowhere"]}, "topic": {"subdomain": "nowhere"}, "document": {"document_ids": [1 << 40]}}
    return spark.createDataFrame([(name, engine.search(2, text, **ask).count()) for name, ask in asks.items()], "name string, hits long")


@register("engine_search_errors", "SELECT * FROM (VALUES ('neither'), ('dimension'), ('domain'), ('models')) t(name)")
def engine_search_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that are refused: neither text nor vector, a vector of another size, no such domain, domains of several models."""
    engine = _engine(spark, sf_dir, embedders={"mock": mock_embedding(C.DIM), "all-minilm-l6-v2": mock_embedding(C.DIM)})
    other = engine.create_domain("other", "all-minilm-l6-v2")
    refused = []
    for name, ask in {"neither": lambda: engine.search(2), "dimension": lambda: engine.search(2, vector=[1.0]), "domain": lambda: engine.search(99, "x"), "models": lambda: engine.search_multi([1, other], "x")}.items():
        try:
            ask()
        except (ValueError, NotFound):
            refused.append((name,))
    return spark.createDataFrame(refused, "name string")


@register("engine_scalar_index", _asked(_ITEM).replace("sum(c.u * q.u)", "sum(greatest(least(round(c.u * 127), 127), -127) / 127 * q.u)") + "SELECT CAST(rank AS INTEGER) AS rank, chunk_id, score FROM dense WHERE domain_id = 2 AND rank <= 10")
def engine_scalar_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index kind is a name: int8 codes."""
    engine = _engine(spark, sf_dir, index_kind="Scalar")
    vector = engine.queries("mock", [_item(spark, sf_dir)]).first().vector
    return engine.search(2, vector=vector).select("rank", "chunk_id", "score")


@register("engine_own_index", _STORE + "SELECT CAST(row_number() OVER (ORDER BY chunk_id) AS INTEGER) AS rank, chunk_id FROM chunks WHERE domain_id = 2 ORDER BY chunk_id LIMIT 10")
def engine_own_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that is passed in: here one that finds all chunks alike, so that ids decide."""

    def alike(corpus: DataFrame, queries: DataFrame, k: int, allowed=None) -> DataFrame:
        one = F.lit(0).cast("long").alias("query_id")  # an engine numbers its queries from 0
        return dense.ranked(corpus.select("domain_id", one, "chunk_id", F.lit(0.5).alias("score")), k, ("domain_id", "query_id"))

    engine = _engine(spark, sf_dir, index_kind=alike)
    return engine.search(2, vector=[1.0] * C.DIM).select("rank", "chunk_id")


@register("index_kinds", "SELECT * FROM (VALUES ('flat', 'flat'), ('FLAT', 'flat'), ('sq', 'scalar'), ('Scalar', 'scalar'), ('hnsw', 'approximate'), ('graph', NULL)) t(name, kind)")
def index_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index kinds by name."""

    def kind(name: str) -> str | None:
        return index_of(name).__name__ if name.lower() in INDEXES else None

    return spark.createDataFrame([(n, kind(n)) for n in ("flat", "FLAT", "sq", "Scalar", "hnsw", "graph")], "name string, kind string")


@register("hit_projection", _HYBRID + ", linked AS (SELECT *, lag(chunk_id) OVER w AS prev, lead(chunk_id) OVER w AS next FROM chunks WINDOW w AS (PARTITION BY document_id ORDER BY ordinal))\n"
          f"SELECT {_HITS.replace('domain_id', 'f.domain_id').replace(', score', ', f.score')}, document_id, ordinal, text, prev, next FROM fused f JOIN linked USING (chunk_id) WHERE rank <= 10")  # fmt: skip
def hit_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with all that their chunks have."""
    chunks = C.indexed_chunks(spark, sf_dir)
    hits = search(chunks, C.queries(spark, sf_dir), 10, with_text=False)
    return with_chunks(hits, chunks).select("domain_id", "query_id", "rank", "chunk_id", "score", "document_id", "ordinal", "text", "prev", "next")


# --- filters by their edges -------------------------------------------------------------

#: Filters that are read in an unusual way, with what they mean.
QUIRKS = {
    'tag:quality "and" NOT tag:toxic': "quality AND NOT toxic",
    "tag:": "false",
    "not not tag:toxic": "toxic",
    'meta.source:"src1"': "source = 'src1'",
    'me"ta.source":src1': "source = 'src1'",
    "tag:toxic or tag:quality and tag:toxic": "toxic",
    "((doc:+3))": "document_id = 3",
    "doc:18446744073709551615": "false",
    "NOT meta.nowhere:a:b": "true",
}
REFUSED = ("", "tag:a tag:b", "NOT", "(tag:a", "tag:a)", "plain", 'tag:"open', "doc:x", "meta.:x", "AND tag:a", "where:x")


@register("filter_quirks", _TAGGED + "\nUNION ALL ".join("SELECT '" + text.replace("'", "''") + f"' AS filter, count(*) AS n, CAST(sum(chunk_id) AS BIGINT) AS ids FROM full_chunks WHERE {where}" for text, where in QUIRKS.items()))
def filter_quirks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords after unquoting, the first colon, empty values, long numbers: what each filter leaves."""
    chunks = C.indexed_chunks(spark, sf_dir)
    flags = [F.struct(F.lit(text).alias("filter"), compile_filter(text, C.TAGS).alias("holds")) for text in QUIRKS]
    each = chunks.select("chunk_id", F.explode(F.array(*flags)).alias("f"))
    return each.groupBy("f.filter").agg(F.count_if(F.col("f.holds")).alias("n"), F.sum(F.when(F.col("f.holds"), F.col("chunk_id"))).alias("ids"))


@register("filter_errors", "SELECT unnest([" + ", ".join("'" + t.replace("'", "''") + "'" for t in REFUSED) + "]) AS filter")
def filter_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters that can't be read."""
    refused = []
    for text in REFUSED:
        try:
            compile_filter(text, C.TAGS)
        except FilterError:
            refused.append((text,))
    return spark.createDataFrame(refused, "filter string")


@register("filter_unknown_label", _TAGGED + "SELECT chunk_id, 'any' AS name FROM full_chunks WHERE quality")
def filter_unknown_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label that isn't known: with all labels asked for there is nothing, else what the known ones give."""
    chunks = C.indexed_chunks(spark, sf_dir)
    kinds = {"any": request_filter(["quality", "nowhere"], tag_ids=C.TAGS), "all": request_filter(["quality", "nowhere"], match_all=True, tag_ids=C.TAGS), "alone": request_filter(["nowhere"], tag_ids=C.TAGS), "topic": request_filter(subdomain_known=False)}
    return reduce(DataFrame.unionByName, (chunks.where(allowed).select("chunk_id", F.lit(name).alias("name")) for name, allowed in kinds.items()))


# --- approximate search -----------------------------------------------------------------


@register("ann_recall", "SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 50 = 0")
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the ten that approximate search finds for each query are the exact ten to at least the recall it aims at."""
    corpus, queries = C.vectors(spark, sf_dir), C.vector_queries(spark, sf_dir)
    exact = dense.scan(corpus, queries, 10).select("query_id", "chunk_id", F.lit(1).alias("exact"))
    found = dense.Cells.build(corpus).search(queries, 10).select("query_id", "chunk_id", F.lit(1).alias("found"))
    return exact.join(found, ["query_id", "chunk_id"], "left").agg(F.countDistinct("query_id").alias("queries"), (F.sum(F.coalesce("found", F.lit(0))) >= dense.RECALL * F.sum("exact")).alias("reached"))


# --- jobs, counters, small functions ----------------------------------------------------


@register("queue_jobs", "SELECT item_id AS job_id, CASE WHEN item_id % 7 = 3 THEN 'Failed' ELSE 'Done' END AS status, CASE WHEN item_id % 7 = 3 THEN 3 ELSE 1 END AS attempts FROM benchmark")
def queue_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest requests as a stream, some of them for a domain that isn't there; a second run finds nothing left."""
    engine, folder = Engine(spark, shared_path(spark, "queue"), clock=lambda: NOW), shared_path(spark, "inbox")
    d = engine.create_domain("items")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    wanted = F.when(F.col("item_id") % 7 == 3, F.lit(d + 1)).otherwise(F.lit(d))
    items.select(F.col("item_id").alias("job_id"), wanted.alias("domain_id"), "text").coalesce(1).write.json(f"{folder}/requests")
    for _ in range(2):
        ingest_stream(engine, f"{folder}/requests", f"{folder}/checkpoint").awaitTermination()
    return engine.table("jobs").select(F.col("id").alias("job_id"), "status", "attempts")


@register("purge_jobs", """WITH j AS (SELECT event_type IN ('purchase', 'error') AS finished, epoch_ms(ts) AS ms, max(epoch_ms(ts)) OVER () AS latest FROM events)
SELECT count(*) FILTER (WHERE finished AND ms < latest - 86400000) AS gone, count(*) FILTER (WHERE NOT (finished AND ms < latest - 86400000)) AS kept FROM j""")
def purge_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many jobs the retention removes, and what is left in the store."""
    ms = F.floor(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))") / 1000)
    status = F.when(F.col("event_type") == "purchase", "Done").when(F.col("event_type") == "error", "Failed").otherwise("Pending")
    jobs = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.lit("ingest").alias("kind"), F.lit(None).cast("long").alias("document_id"), F.lit(1).alias("domain_id"),
        status.alias("status"), F.lit(1).alias("attempts"), F.lit(None).cast("string").alias("error"), ms.alias("created_at"), ms.alias("updated_at"))
    engine = Engine(spark, shared_path(spark, "jobs"))
    engine.store.commit({"jobs": jobs})
    now = engine.table("jobs").agg(F.max("updated_at")).first()[0]
    gone = engine.purge_jobs(now, 86_400_000)
    return spark.createDataFrame([(gone, engine.count("jobs"))], "gone long, kept long")


@register("service_counters", """SELECT count(*) FILTER (WHERE event_type = 'view') AS searches, CAST(sum(CASE WHEN event_type = 'view' THEN event_id % 97 END) AS BIGINT) AS latency_ms, count(*) FILTER (WHERE event_type = 'error') AS rejected,
count(*) FILTER (WHERE event_type = 'purchase') AS ingested, count(*) FILTER (WHERE event_type = 'click') AS duplicates FROM events""")
def service_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters over a log of requests."""
    kinds = {"view": "search", "error": "reject", "purchase": "ingest", "click": "duplicate"}
    kind = F.coalesce(*(F.when(F.col("event_type") == a, F.lit(b)) for a, b in kinds.items()))
    return counted(spark.read.parquet(f"{sf_dir}/events.parquet").select(kind.alias("kind"), (F.col("event_id") % 97).alias("ms")))


@register("engine_counters", _STORE + "SELECT count(*) FILTER (WHERE NOT duplicate) AS ingested, count(*) FILTER (WHERE duplicate) AS duplicates, 2::BIGINT AS searches FROM answers WHERE domain_id = 2")
def engine_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one engine counted while it took one language and answered two queries."""
    engine = Engine(spark, shared_path(spark, "counted"), clock=lambda: NOW)
    d = engine.create_domain("en")
    engine.ingest(d, C.documents(spark, sf_dir).where("domain_id = 2").select(F.col("id").alias("n"), "text"))
    for _ in range(2):
        engine.search(d, "the word")
    return spark.createDataFrame([tuple(engine.counts[c] for c in ("ingested", "duplicates", "searches"))], "ingested long, duplicates long, searches long")


@register("parse_duration", """SELECT event_id, CASE event_type WHEN 'view' THEN user_id WHEN 'click' THEN user_id WHEN 'purchase' THEN user_id * 3600 WHEN 'signup' THEN user_id * 604800 END AS seconds FROM events""")
def parse_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of durations as they are written."""
    unit = F.when(F.col("event_type") == "view", "").when(F.col("event_type") == "click", " s ").when(F.col("event_type") == "purchase", "h").when(F.col("event_type") == "signup", "w").otherwise("x")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", duration_seconds(F.concat(F.col("user_id").cast("string"), unit)).alias("seconds"))


@register("backup_schedule", "SELECT event_id, CASE WHEN event_id % 7 = 1 THEN 'full' ELSE 'differential' END AS kind FROM events")
def backup_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of numbered backups are full ones."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", kind_of_backup(F.col("event_id"), 7).alias("kind"))
