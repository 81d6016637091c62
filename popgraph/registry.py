"""All registered queries of the library and their DuckDB twins."""

from __future__ import annotations

from popgraph.queries import base, behaviour, entities, features, networks, panels, quality, samples, streams  # noqa: F401  the modules register on import


def queries() -> dict:
    return base.QUERIES


def oracle_sql() -> dict:
    return base.ORACLE_SQL
