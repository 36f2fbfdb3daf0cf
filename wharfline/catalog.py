"""All queries of the engine by name, each beside its SQL twin."""

from __future__ import annotations

from wharfline.plans import connectors, graph, learning, relational, streams, textual

MODULES = (relational, textual, graph, learning, streams, connectors)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
