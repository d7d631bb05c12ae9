"""Hybrid search: dense and lexical lists, fused, reranked, diversified, with snippets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackwater.functions.text import snippet
from brackwater.operators import dense, fusion, lexical
from brackwater.operators.sizes import broadcast_if_small, build_side
from brackwater.schema import MAX_K, fetch_size
from brackwater.sources.shared import stored

RERANK_CANDIDATES = 20
#: A kind of index: what gives the k nearest of the corpus for each query, among the chunks that are allowed.
Index = Callable[[DataFrame, DataFrame, int, Column | None], DataFrame]


def flat(corpus: DataFrame, queries: DataFrame, k: int, allowed: Column | None = None) -> DataFrame:
    """Exact cosines."""
    return dense.scan(corpus if allowed is None else corpus.where(allowed), queries, k)


def scalar(corpus: DataFrame, queries: DataFrame, k: int, allowed: Column | None = None) -> DataFrame:
    """Cosines with int8 codes."""
    return dense.scan(corpus if allowed is None else corpus.where(allowed), queries, k, quantised=True)


#: Index kinds by name: exact, int8 codes, and approximate by cells, which stands in for any graph index.
INDEXES: dict[str, Index] = {"flat": flat, "sq": scalar, "scalar": scalar, "cells": dense.approximate, "hnsw": dense.approximate}


def index_of(kind: str | Index) -> Index:
    """The index of a name, in letters of any size, or the index itself."""
    if not isinstance(kind, str):
        return kind
    if kind.lower() not in INDEXES:
        raise ValueError(f"no index kind {kind!r}")
    return INDEXES[kind.lower()]


def search(
    corpus: DataFrame, queries: DataFrame, k: int = 10, allowed: Column | None = None, diversity: float = 0.0, reranker: Callable[[Column, Column], Column] | None = None,
    rerank_candidates: int = RERANK_CANDIDATES, index: str | Index = "flat", with_text: bool = True, vectors: DataFrame | None = None,
) -> DataFrame:
    """(domain_id, query_id, rank, chunk_id, score[, text, snippet]): the k best chunks of each domain for each query.

    corpus has domain_id, chunk_id, text and embedding, and what ``allowed`` reads;
    queries has query_id, text and vector. A query without text is answered by vectors
    alone, one without a vector by words alone. Results are ranked before any text is
    fetched. Where a step reads texts or vectors the pool is written first and sent to
    the corpus, if it is as small as pools are, so that no text is shuffled. Where the
    embeddings are a table of their own, ``vectors`` (domain_id, chunk_id, embedding), a
    scan reads that alone, of the chunks that are allowed, and the corpus needs none.
    """
    nearest = index_of(index)
    k, diversity = min(k, MAX_K), min(max(diversity, 0.0), 1.0)
    fetch = fetch_size(k)
    pool_size = min(max(rerank_candidates, k), fetch) if reranker else fetch if diversity else k
    if vectors is None:
        near, held = nearest(corpus, queries, fetch, allowed), corpus
    elif nearest in (flat, scalar):
        held = vectors
        some = vectors if allowed is None else vectors.join(build_side(corpus.where(allowed).select("chunk_id")), "chunk_id", "left_semi")
        near = nearest(some, queries, fetch, None)
    else:
        near, held = nearest(with_vectors(corpus, vectors), queries, fetch, allowed), vectors
    words = lexical.search(corpus, queries.where("text is not null"), fetch, allowed)
    pool = fusion.hybrid(near, words, pool_size)
    if reranker:
        read = _with(pool, corpus, "text").join(_texts(queries), "query_id", "left")
        scored = fusion.rerank(read.where("query_text is not null"), "query_text", "text", reranker)
        pool = scored.unionByName(read.where("query_text is null")).select(*fusion.KEYS, "chunk_id", "score", "rank")
    if diversity:
        pool = fusion.diversify(_with(pool, held, "embedding"), k, diversity)
    pool = pool.where(F.col("rank") <= k).select(*fusion.KEYS, "rank", "chunk_id", "score")
    if not with_text:
        return pool
    read = _with(pool, corpus, "text").join(_texts(queries), "query_id", "left")
    return read.select(*fusion.KEYS, "rank", "chunk_id", "score", "text", snippet(F.col("text"), F.col("query_text")).alias("snippet"))


def with_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with an embedding from a table of their own."""
    return chunks.join(vectors.select("chunk_id", "embedding"), "chunk_id", "left")


def _with(pool: DataFrame, corpus: DataFrame, column: str) -> DataFrame:
    """The pool, of chunks of the corpus, with a column of theirs."""
    pool = broadcast_if_small(stored(pool, "pool"))
    return corpus.select("chunk_id", column).join(pool, "chunk_id")


def _texts(queries: DataFrame) -> DataFrame:
    return broadcast_if_small(queries.select("query_id", F.col("text").alias("query_text")))


def merge_domains(hits: DataFrame, k: int) -> DataFrame:
    """The k best of all domains for each query, by raw score: those of a domain without a shared word are cosines."""
    return lexical.ranked(hits.drop("rank"), min(k, MAX_K))


def with_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with all columns of their chunks; the hits are sent to the chunks, if they are few."""
    hits = broadcast_if_small(stored(hits, "hits"))
    return chunks.drop("domain_id", *(c for c in hits.columns if c != "chunk_id")).join(hits, "chunk_id")
