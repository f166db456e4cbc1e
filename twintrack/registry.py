"""Queries of the pose-track operators and their DuckDB SQL, by name."""

from __future__ import annotations

from .oracles import ORACLE_SQL
from .queries import QUERIES

FLAGSHIP = "contact_windows"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
