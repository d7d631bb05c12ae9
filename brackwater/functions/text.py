"""Scalar text functions as Column expressions, and the few that need Arrow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

GAP = r"[\s\p{Z}\x{85}]+"
SNIPPET_RADIUS = 120
MODELS = {"multilingual-e5-small": (384, True), "bge-small-en-v1.5": (384, False), "all-minilm-l6-v2": (384, False), "mock": (64, False)}


def tokens(text: Column) -> Column:
    """Lower-cased alphanumeric runs of two characters or more (before folding); null for null."""
    runs = F.split(text, r"[^\p{IsAlphabetic}\p{N}]+")
    return F.transform(F.filter(runs, lambda x: F.length(x) >= 2), F.lower)


def trimmed(text: Column) -> Column:
    """Without white space at either end, of any script."""
    return F.regexp_replace(text, r"^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$", "")


def normalised(text: Column) -> Column:
    """One space between words, at most one blank line between lines, none at the ends."""
    flat = F.regexp_replace(text, r"[\t\x0B\f\r\p{Z}\x{85}]+", " ")
    lines = F.regexp_replace(flat, " ?\n ?", "\n")
    return trimmed(F.regexp_replace(lines, "\n{3,}", "\n\n"))


def snippet(text: Column, query: Column, radius: int = SNIPPET_RADIUS) -> Column:
    """What lies around the earliest place of any query word of two characters or more; null if none occurs."""
    words = F.filter(F.split(F.lower(query), GAP), lambda x: F.length(x) >= 2)
    low = F.lower(text)
    at = F.array_min(F.filter(F.transform(words, lambda w: F.instr(low, w)), lambda p: p > 0))
    start = F.greatest(at - 1 - radius, F.lit(0))
    end = F.least(at - 1 + radius, F.length(text))
    mark = F.lit("…")
    body = F.substring(text, start + 1, end - start)
    return F.when(
        at.isNotNull(),
        F.concat(F.when(start > 0, mark).otherwise(""), body, F.when(end < F.length(text), mark).otherwise("")),
    )


def overlap_score(query: Column, text: Column) -> Column:
    """How many distinct words of the query the text has: the deterministic reranker."""
    return F.size(F.array_intersect(tokens(query), tokens(text))).cast("double")


def content_hash(text: Column) -> Column:
    """SHA-256 of the text in hexadecimal."""
    return F.sha2(text, 256)


def format_utc(millis: Column) -> Column:
    """A file-name-safe rendering of epoch milliseconds, independent of the session's time zone."""
    seconds = F.floor(millis / 1000)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    rest = F.pmod(seconds, F.lit(86400))
    parts = [F.lpad((F.floor(rest / d) % m).cast("string"), 2, "0") for d, m in ((3600, 24), (60, 60), (1, 60))]
    return F.concat(day.cast("string"), F.lit("_"), F.concat_ws("-", *parts))


def parse_duration(text: str) -> int | None:
    """Seconds of ``90``, ``30s``, ``15m``, ``6h``, ``1d`` or ``2w``; none if it is something else."""
    text = text.strip()
    scale = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
    number, factor = (text[:-1].strip(), scale[text[-1]]) if text[-1:] in scale else (text, 1)
    return int(number) * factor if number.isascii() and number.isdigit() else None


def duration_seconds(text: Column) -> Column:
    """parse_duration() of a column; null where it is no duration."""
    trim = F.trim(text)
    number = F.regexp_extract(trim, r"^([0-9]+)\s*[smhdw]?$", 1)
    unit = F.regexp_extract(trim, r"([smhdw])$", 1)
    factor = F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).when(unit == "w", 604800).otherwise(1)
    return F.when(number != "", number.cast("long") * factor)


def with_prefix(text: Column, model: str, query: bool) -> Column:
    """The text as the model wants it: some tell queries and passages apart by a prefix."""
    if not MODELS[model][1]:
        return text
    return F.concat(F.lit("query: " if query else "passage: "), text)


#: Bytes of the table of words that are hashed at a time, and their number.
TABLE_BYTES, TABLE_WORDS = 4 << 20, 8192


def fnv1a(words: list[bytes]) -> np.ndarray:
    """FNV-1a over 64 bits of each word; words of about one length go together, so that a long one widens no table of short ones."""
    every = np.array([len(w) for w in words], np.int64)
    order, out, a = np.argsort(every, kind="stable"), np.empty(len(words), np.uint64), 0
    while a < len(words):
        b = min(a + TABLE_WORDS, len(words))
        while b - a > 1 and (b - a) * every[order[b - 1]] > TABLE_BYTES:
            b = a + (b - a) // 2
        own = order[a:b]
        sizes, width = every[own], int(every[own[-1]])
        table = np.zeros((b - a, width), np.uint8)
        table[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(words[k] for k in own), np.uint8)
        h = np.full(b - a, 0xCBF29CE484222325, np.uint64)
        for j in range(width):
            first = np.searchsorted(sizes, j, "right")
            h[first:] = (h[first:] ^ table[first:, j]) * np.uint64(0x100000001B3)
        out[own] = h
        a = b
    return out


def embed_counts(texts: list[str | None], dim: int) -> list[np.ndarray | None]:
    """Of each text the number of its words in each hash bucket: the deterministic embedder."""
    words: dict[str, int] = {}
    rows = [None if t is None else [words.setdefault(w, len(words)) for w in t.lower().split()] for t in texts]
    bucket = (fnv1a([w.encode() for w in words]) % np.uint64(dim)).astype(np.int64)
    return [None if r is None else np.bincount(bucket[r] if r else [], minlength=dim).astype(np.float32) for r in rows]


def mock_embedding(dim: int = 64):
    """A vectorised function from text to its embedding by embed_counts(); null for null."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(embed_counts([None if not isinstance(t, str) else t for t in s], dim), dtype=object)

    return embed
