"""All registered queries of the engine and their DuckDB SQL."""

from __future__ import annotations

from recollect.queries import evaluate, fusion, graph, identity, ledger, memory, retrieval, services, text  # noqa: F401
from recollect.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
