"""The registered queries: name -> (builder over a Ledger, SQL that must give the same rows)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from .views import VIEWS, Ledger

QUERIES: dict[str, Callable[[Ledger], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(body: str) -> str:
    """The SQL text with the definitions of the views it needs, directly or through other views."""
    needed: set[str] = set()

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                need(VIEWS[name])

    need(body)
    ctes = ",\n".join(f"{n} AS ({sql.strip()})" for n, sql in VIEWS.items() if n in needed)
    return f"WITH {ctes}\n{body.strip()}" if ctes else body.strip()


def query(sql: str | None = None, name: str | None = None):
    """Register a builder; without SQL the query is checked for its rows only."""

    def add(build: Callable[[Ledger], DataFrame]):
        key = name or build.__name__
        assert key not in QUERIES, key
        QUERIES[key] = build
        if sql is not None:
            ORACLES[key] = with_views(sql)
        return build

    return add
