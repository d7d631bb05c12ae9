"""Putting ranked lists together, reranking them, and choosing for diversity."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackwater.operators.lexical import ranked

RRF_K = 60
KEYS = ("domain_id", "query_id")


def reciprocal_rank(*lists: DataFrame) -> DataFrame:
    """(domain_id, query_id, chunk_id, score): the sum of 1 / (60 + rank) over the lists a chunk is in."""
    every = None
    for one in lists:
        part = one.select(*KEYS, "chunk_id", (1 / (RRF_K + F.col("rank"))).alias("s"))
        every = part if every is None else every.unionAll(part)
    return every.groupBy(*KEYS, "chunk_id").agg(F.round(F.sum("s"), 9).alias("score"))


def hybrid(dense: DataFrame, lexical: DataFrame, window: int) -> DataFrame:
    """The ``window`` best by reciprocal rank; a query that no chunk shares a word with keeps the cosine scores."""
    said = lexical.select(*KEYS).distinct()
    plain = dense.join(said, list(KEYS), "left_anti").select(*KEYS, "chunk_id", "score")
    fused = reciprocal_rank(dense.join(said, list(KEYS), "left_semi"), lexical)
    return ranked(fused.unionByName(plain), window, KEYS)


def rerank(pool: DataFrame, query_text: str, chunk_text: str, scorer: Callable[[Column, Column], Column]) -> DataFrame:
    """pool with the scorer's scores of (query, text) in place of its own, and ranks by them; equal ones keep their order."""
    scored = pool.withColumn("score", scorer(F.col(query_text), F.col(chunk_text)))
    w = Window.partitionBy(*KEYS).orderBy(F.col("score").desc(), F.col("rank"), F.col("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(w))


def mmr_order(score: np.ndarray, vectors: list, diversity: float, k: int) -> list[int]:
    """Places of the k chosen, in order: relevance from 0 to 1, less the likeness to what is chosen already.

    The input is in order of relevance, which settles ties. A missing vector is like
    nothing; likeness counts from 0 up.
    """
    n = len(score)
    if not n:
        return []
    span = max(float(score.max() - score.min()), float(np.finfo(np.float32).eps))
    relevance = (score - score.min()) / span
    dim = max((len(v) for v in vectors if v is not None), default=1)
    x = np.zeros((n, dim))
    for i, v in enumerate(vectors):
        if v is not None:
            x[i, : len(v)] = v
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    like, left, chosen = np.zeros(n), np.ones(n, bool), []
    for _ in range(min(k, n)):
        value = np.where(left, np.round((1 - diversity) * relevance - diversity * like, 12), -np.inf)
        best = int(value.argmax())
        chosen.append(best)
        left[best] = False
        like = np.maximum(like, x @ x[best])
    return chosen


def diversify(pool: DataFrame, k: int, diversity: float) -> DataFrame:
    """(domain_id, query_id, chunk_id, score, rank) of the k chosen of each query's pool, which has embedding.

    A pool is what fusion leaves, at most 5000 rows; each is one task's.
    """
    diversity = min(max(diversity, 0.0), 1.0)

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["score", "chunk_id"], ascending=[False, True]).reset_index(drop=True)
        order = mmr_order(part["score"].to_numpy(float), list(part["embedding"]), diversity, k)
        got = part.iloc[order][[*KEYS, "chunk_id", "score"]].copy()
        got["rank"] = np.arange(1, len(got) + 1, dtype=np.int32)
        return got

    return pool.select(*KEYS, "chunk_id", "score", "embedding").groupBy(*KEYS).applyInPandas(choose, "domain_id long, query_id long, chunk_id long, score double, rank int")
