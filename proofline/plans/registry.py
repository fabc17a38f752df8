"""Small helper that keeps a query and its SQL twin side by side."""

from __future__ import annotations

from proofline.plans import Query


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(query: Query) -> Query:
            self.queries[name] = query
            if sql:
                self.oracle[name] = sql
            return query

        return keep
