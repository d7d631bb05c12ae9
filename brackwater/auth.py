"""Tokens and what they allow: pure functions and predicates."""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "bw_"
RANK = {"read": 0, "write": 1, "admin": 2}


def new_token() -> tuple[str, bytes]:
    """A fresh token and the hash to keep of it."""
    token = PREFIX + secrets.token_hex(32)
    return token, token_hash(token)


def token_hash(token: str) -> bytes:
    """SHA-256 of a token."""
    return hashlib.sha256(token.encode()).digest()


def rank(perm: Column) -> Column:
    """The order of permissions; null for one that isn't known."""
    return F.when(perm == "read", 0).when(perm == "write", 1).when(perm == "admin", 2)


def allows(scopes: Column, domain: Column, need: str, now: Column, expires_at: Column) -> Column:
    """Whether scopes of (domain, perm) grant ``need`` on a domain; a scope without a domain holds for all."""
    grant = F.exists(scopes, lambda s: (s["domain"].isNull() | (s["domain"] == domain)) & (rank(s["perm"]) >= RANK[need]))
    return F.coalesce(grant, F.lit(False)) & (expires_at.isNull() | (expires_at > now))


def is_admin(scopes: Column) -> Column:
    """Whether a scope gives administration of everything."""
    return F.coalesce(F.exists(scopes, lambda s: s["domain"].isNull() & (s["perm"] == "admin")), F.lit(False))
