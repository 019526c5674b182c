"""The registered queries and, where SQL can say the same, their DuckDB counterparts."""

from catalog import ingest, metrics, predicates, rollups, sqlaccess, tail, transforms  # noqa: F401
from catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
