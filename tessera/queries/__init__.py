"""All queries of the library with their DuckDB counterparts, on count matrices of the test tables."""

from __future__ import annotations

from tessera.queries import access, matrix, more

QUERIES: dict = matrix.QUERIES | more.QUERIES | access.QUERIES
ORACLES: dict = matrix.ORACLES | more.ORACLES | access.ORACLES
