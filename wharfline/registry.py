"""Collects a module's queries, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None) -> Callable:
        """Decorator: registers a function (spark, sf_dir) -> DataFrame."""

        def add(f: Callable) -> Callable:
            key = name or f.__name__
            self.queries[key] = f
            if sql:
                self.sql[key] = sql
            return f

        return add
