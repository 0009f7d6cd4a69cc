"""Queries with the SQL that gives their rows."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """queries by name, and their SQL where SQL can say what they give."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def put(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return put
