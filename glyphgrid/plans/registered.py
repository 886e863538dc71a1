"""Tables of queries and their SQL, filled by a decorator."""

from __future__ import annotations

from collections.abc import Callable


def registrar() -> tuple[dict, dict, Callable]:
    queries, sql = {}, {}

    def query(text: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, query
