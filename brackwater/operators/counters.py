"""Counters over a log of requests, as one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counted(log: DataFrame) -> DataFrame:
    """(searches, latency_ms, rejected, ingested, duplicates) of a log (kind, ms); other kinds and null ones count for nothing."""
    kind = F.col("kind")
    return log.agg(
        F.count_if(kind == "search").alias("searches"), F.sum(F.when(kind == "search", F.col("ms"))).alias("latency_ms"),
        F.count_if(kind == "reject").alias("rejected"), F.count_if(kind == "ingest").alias("ingested"), F.count_if(kind == "duplicate").alias("duplicates"),
    )
