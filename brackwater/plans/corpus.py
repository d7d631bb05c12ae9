"""The tables as the engine's data model: documents by language, labels as tags, sources as topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brackwater.functions.text import mock_embedding, tokens
from brackwater.operators.chunking import chunks
from brackwater.operators.sizes import build_side
from brackwater.sources.shared import kept, spread

DOMAINS = {"de": 1, "en": 2, "es": 3, "fr": 4}
OTHER_DOMAIN = 5
TAGS = {"quality": 1, "toxic": 2}
DIM = 64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, domain_id, subdomain, text, metadata, tags) of each document; one without labels has null tags."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    labels = build_side(spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("x")))
    domain = F.coalesce(*(F.when(F.col("lang") == k, F.lit(v)) for k, v in DOMAINS.items()), F.lit(OTHER_DOMAIN)).cast("long")
    tags = F.array_compact(F.array(F.when(F.col("q") == 1, F.lit(1).cast("long")), F.when(F.col("x") == 1, F.lit(2).cast("long"))))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), domain.alias("domain_id"), F.col("source").alias("subdomain"), "text",
        F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata"), F.when(F.col("q").isNotNull() | F.col("x").isNotNull(), tags).alias("tags"),
    )


def plain_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(domain_id, chunk_id, document_id, ordinal, text, prev, next) of each document: one narrow scan."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    domain = F.coalesce(*(F.when(F.col("lang") == k, F.lit(v)) for k, v in DOMAINS.items()), F.lit(OTHER_DOMAIN)).cast("long")
    return chunks(docs.select(F.col("doc_id").alias("id"), "text", domain.alias("domain_id")))


def tagged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plain_chunks() with subdomain, metadata and tags."""
    return chunks(documents(spark, sf_dir))


def allowed_chunks(spark: SparkSession, sf_dir: str, allowed: Column) -> DataFrame:
    """tagged_chunks() that a predicate on documents allows; only allowed documents are cut."""
    docs = documents(spark, sf_dir).withColumn("document_id", F.col("id"))
    return chunks(docs.where(allowed))


def indexed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tagged_chunks() with embedding and terms, as a table: texts are cut, embedded and split into terms once, however many queries read them."""

    def make(path: str) -> None:
        text = F.col("text")
        tagged_chunks(spark, sf_dir).withColumns({"embedding": mock_embedding(DIM)(text), "terms": tokens(text)}).write.parquet(path)

    return spark.read.parquet(kept(spark, (sf_dir, "chunks"), make))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item as a query (query_id, text, vector)."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return items.select(F.col("item_id").alias("query_id"), "text", mock_embedding(DIM)(F.col("text")).alias("vector"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table as a corpus of one domain, its labels as tags."""
    rows = spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id")
    return rows.select(F.lit(1).cast("long").alias("domain_id"), F.col("vec_id").alias("chunk_id"), "embedding", F.array(F.col("label").cast("long")).alias("tags"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding whose id is divisible by 50, as a query against all."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 50 = 0")
    return rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
