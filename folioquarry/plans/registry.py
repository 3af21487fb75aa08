"""Registration of queries with their oracle SQL."""

from __future__ import annotations


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracle: dict[str, str] = {}

    def query(self, oracle: str | None = None, name: str | None = None):
        def add(f):
            self.queries[name or f.__name__] = f
            if oracle:
                self.oracle[name or f.__name__] = oracle
            return f

        return add
