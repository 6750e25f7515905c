"""The register of queries and of the SQL that checks them."""

from __future__ import annotations

from corvane.sources.tables import table as t

__all__ = ["ORACLES", "QUERIES", "query", "t"]

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with SQL for the same rows if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
