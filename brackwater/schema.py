"""The tables of the engine, and how their rows are identified and ordered."""

from __future__ import annotations

from pyspark.sql import types as T

STRINGS = T.MapType(T.StringType(), T.StringType())


def _table(text: str, **special: T.DataType) -> T.StructType:
    """Fields of ``name type`` pairs; a name in ``special`` has the type given there."""
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "longs": T.ArrayType(T.LongType()), "map": STRINGS, "binary": T.BinaryType()}
    pairs = [p.strip().split(" ") for p in text.split(",")]
    return T.StructType([T.StructField(p[0], special[p[0]] if p[0] in special else kinds[p[1]]) for p in pairs])


TABLES: dict[str, T.StructType] = {
    "domains": _table("id long, name string, model string, dim int, created_at long"),
    "subdomains": _table("id long, domain_id long, name string, description string, created_at long"),
    "tags": _table("id long, domain_id long, name string, display_name string, description string, parent long, created_at long"),
    "documents": _table("id long, domain_id long, subdomain_id long, title string, source string, metadata map, tags longs, created_at long"),
    "chunks": _table("id long, document_id long, domain_id long, subdomain_id long, ordinal int, text string, tags longs, metadata map, prev long, next long"),
    "embeddings": _table("chunk_id long, document_id long, domain_id long, embedding", embedding=T.ArrayType(T.FloatType())),
    "deletions": _table("domain_id long, document_id long"),
    "document_hashes": _table("domain_id long, sha256 string, document_id long"),
    "jobs": _table("id long, kind string, document_id long, domain_id long, status string, attempts int, error string, created_at long, updated_at long"),
    "tokens": _table("id long, name string, hash binary, scopes, created_at long, expires_at long", scopes=T.ArrayType(T.StructType([T.StructField("domain", T.LongType()), T.StructField("perm", T.StringType())]))),
}

#: What a store with a key keeps sealed.
SEALED = {"domains": ("name",), "subdomains": ("name", "description"), "tags": ("name", "display_name", "description"), "documents": ("title", "source"), "chunks": ("text",)}

#: A chunk's id holds its document and its place there, so no sequence is needed and order is kept.
CHUNK_BITS = 20
MAX_K = 1000
SCORE_DIGITS = 6


def fetch_size(k: int) -> int:
    """How much of each list is fused for k results."""
    return max(5 * k, 50)
