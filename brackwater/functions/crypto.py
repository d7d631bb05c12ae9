"""Columns at rest under a key: AES-256-GCM by Spark's own functions, keys by PBKDF2."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 600_000


def derive_key(passphrase: str, salt: bytes, rounds: int = ROUNDS) -> bytes:
    """A key of 32 bytes from a passphrase."""
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, rounds, 32)


def sealed(value: Column, key: bytes, bound_to: str = "") -> Column:
    """The value encrypted and authenticated, with a fresh nonce for each row; null for null. ``bound_to`` must be given again to open it."""
    return F.aes_encrypt(value, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.lit(bound_to.encode()))


def opened(value: Column, key: bytes, bound_to: str = "") -> Column:
    """The text that was sealed; an error where the key is another or a byte was changed."""
    return F.aes_decrypt(value, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(bound_to.encode())).cast("string")


def rekeyed(value: Column, old: bytes, new: bytes, bound_to: str = "") -> Column:
    """Sealed under another key."""
    return sealed(opened(value, old, bound_to), new, bound_to)


def blind_name(name: str, key: bytes) -> str:
    """A name for an index entry that tells nothing without the key."""
    return hmac.new(key, name.encode(), hashlib.sha256).hexdigest()
