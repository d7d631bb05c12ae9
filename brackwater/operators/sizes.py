"""When a side of a join may be sent to every task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it is counted to have few rows; else as it is, for a shuffled join."""
    few = df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if few else df


def build_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df for the side of a join that is looked up: sent to every task if it has few rows, else hashed, so that the rows of the other side, which may be texts, are shuffled but not sorted."""
    few = df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if few else df.hint("shuffle_hash")
