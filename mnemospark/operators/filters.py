"""Predicates: filter maps, scopes, validity in time and sessions, as columns that reach the scan."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUFFIXES = {"__in": lambda c, v: c.isin(list(v)), "__gte": lambda c, v: c >= v, "__lte": lambda c, v: c <= v}


def compiled(filters: dict[str, Any] | None, metadata: str = "metadata") -> Column:
    """All of: session_id equal; created_after and created_before inclusive; metadata.key equal, __in, __gte or __lte.

    A value of None and an unknown key are ignored; a missing metadata key fails ranges.
    """
    found = []
    for key, want in (filters or {}).items():
        if want is None:
            continue
        if key == "session_id":
            found.append(F.col("session_id") == want)
        elif key == "created_after":
            found.append(F.col("created_at") >= F.lit(want))
        elif key == "created_before":
            found.append(F.col("created_at") <= F.lit(want))
        elif key.startswith("metadata."):
            name = key[len("metadata.") :]
            ending = next((s for s in SUFFIXES if name.endswith(s)), None)
            value = F.try_element_at(F.col(metadata), F.lit(name.removesuffix(ending or "")))
            found.append(F.coalesce(SUFFIXES[ending](value, want) if ending else value == want, F.lit(False)))
    return reduce(lambda a, b: a & b, found, F.lit(True))


def in_scope(scope: dict[str, str | None]) -> Column:
    """A null in the scope matches anything; the namespace must be equal."""
    return reduce(lambda a, b: a & b, [F.col(k) == v for k, v in scope.items() if v is not None or k == "namespace"], F.lit(True))


def same_scope(a: str, b: str, cols=("user_id", "namespace", "session_id")) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols])


def valid_at(when: Column | str, start: str = "effective_from", end: str = "effective_until") -> Column:
    when = F.lit(when).cast("timestamp_ntz") if isinstance(when, str) else when
    return (F.col(start) <= when) & (F.col(end).isNull() | (F.col(end) > when))


def visible_at(when: Column | str, superseded: bool = False) -> Column:
    """Not deleted and valid; superseded rows only if asked for, and then only while they were open."""
    out = valid_at(when) & (F.col("status") != "deleted")
    return out if superseded else out & (F.col("status") != "superseded")


def evidence_ok(refs: str, scheme: str = "mem://") -> Column:
    return (F.size(refs) > 0) & F.forall(refs, lambda r: F.startswith(r, F.lit(scheme)))


def must_intercept(text: str, chars: int = 8000, tokens: int = 2000) -> Column:
    return (F.length(text) >= chars) | (F.floor(F.octet_length(F.col(text)) / 4) >= tokens)


def instant(text: str) -> dt.datetime:
    """An ISO time of a request, in UTC; Z is accepted."""
    value = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    return value.astimezone(dt.UTC).replace(tzinfo=None) if value.tzinfo else value


def typed_rows(rows: DataFrame, created: str, metadata: str) -> DataFrame:
    """Rows of texts as the filters need them: created_at, the least time if it can't be read, and metadata as a map."""
    at = F.try_to_timestamp(F.regexp_replace(F.col(created), "Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")
    least = F.lit("0001-01-01").cast("timestamp_ntz")
    return rows.withColumn("metadata", F.from_json(metadata, "map<string,string>")).withColumn("created_at", F.coalesce(at, least))


def health(disabled: Column, missing: Column, blocked: Column, stale: Column, parts: dict[str, Column]) -> Column:
    """struct(status, reason): the first of the conditions that holds; missing and blocked are texts or null, parts say what is there."""
    lost = F.concat_ws(", ", *[F.when(~there, F.lit(name)) for name, there in parts.items()])
    said = lambda status, reason: F.struct(F.lit(status).alias("status"), reason.cast("string").alias("reason"))
    return (
        F.when(disabled, said("disabled", F.lit("adapter disabled by config"))).when(missing.isNotNull(), said("missing_dependency", F.concat(F.lit("missing optional dependency: "), missing)))
        .when(blocked.isNotNull(), said("policy_blocked", blocked)).when(stale, said("stale_index", F.lit("index is stale; re-index required")))
        .when(lost != "", said("degraded", F.concat(F.lit("unavailable: "), lost))).otherwise(said("healthy", F.lit(None)))
    )
