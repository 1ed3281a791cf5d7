"""All queries over the engine's own operators."""

from __future__ import annotations

from . import chains, events, indexes, more, recalls, searches, stores, values, works, writes  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
