"""Every query of the library by name, with the SQL that says the same."""

from __future__ import annotations

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    """Decorator: files a query builder under a name, beside its SQL."""

    def add(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return add
