"""All registered queries of the engine, and their SQL."""

from __future__ import annotations

from brackwater.plans import operations  # noqa: F401 - registers its queries
from brackwater.plans.catalogue import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
