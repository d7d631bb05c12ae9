import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    """A maker of pseudo-random prose."""
    draw = random.Random(3)
    vocabulary = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyzäé") for _ in range(draw.randint(3, 8))) for _ in range(4000)]

    def make(n, seed):
        d = random.Random(seed)
        return [d.choice(vocabulary) for _ in range(n)]

    return make


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of texts, or of (doc_id, text)."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (k, r) for k, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def clash():
    """The same table with more columns, of names that operators use inside."""

    def make(df):
        for name in ("key", "node", "component", "dk", "d", "h", "n", "g", "shard", "row", "size", "count", "lines", "group_id", "kept", "label", "a.b"):
            df = df.withColumn(name, F.lit("x"))
        return df

    return make
