"""The queries of this subpackage, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brackwater.llm import chat, decontaminate, embeddings, html, licences, linededup, minhash, pieces, shards, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licence_scan": licences.query,
    "op2_minhash_near_dedup": minhash.query,
    "op3_toxicity": toxicity.query,
    "op4_embedding_near_dedup": embeddings.query,
    "op5_sentencepiece": pieces.query,
    "op6_chat_formatting": chat.query,
    "op7_benchmark_decontamination": decontaminate.query,
    "op8_line_dedup": linededup.query,
    "op9_sharding": shards.query,
    "op10_html_extraction": html.query,
}
ORACLE_SQL: dict[str, str] = {
    "op2_minhash_near_dedup": minhash.SQL,
    "op4_embedding_near_dedup": embeddings.SQL,
    "op6_chat_formatting": chat.SQL,
    "op7_benchmark_decontamination": decontaminate.SQL,
    "op8_line_dedup": linededup.SQL,
    "op9_sharding": shards.SQL,
}
