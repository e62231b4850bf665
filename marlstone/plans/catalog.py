"""The registered relational queries and their SQL counterparts."""

from marlstone.plans import documents, listings, rollups, states, texts  # noqa: F401
from marlstone.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
