"""Queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *ctes: str):
    """Registers fn(spark, sf_dir); ctes are put before sql, which begins at SELECT."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + sql
        return fn

    return add
