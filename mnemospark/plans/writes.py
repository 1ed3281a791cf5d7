"""Queries over what is written: memories as they are added, candidates as they are committed, work graphs as they are patched."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from ..operators import graphs as GR
from ..operators import memory as ME
from .registry import query
from .stores import SCRUBBED
from .tables import MEMORIES, memories, table

_INCOMING = """incoming AS (SELECT memory_id, namespace, text, CASE WHEN memory_id % 2 = 0 THEN left(text, 24) END AS summary, CASE WHEN memory_id % 3 = 0 THEN 'Seen by a' || user_id || '@example.org, a' || user_id || '@example.org and 555-867-53' || lpad((memory_id % 100)::VARCHAR, 2, '0') END AS detail,
  CASE WHEN memory_id % 5 = 0 THEN 'run with secret-' || lpad(memory_id::VARCHAR, 16, '0') END AS action, CASE WHEN memory_id % 4 = 0 THEN supersedes END AS replaced, coalesce(CASE WHEN memory_id % 6 = 0 THEN TIMESTAMP '2023-06-01' END, effective_from) AS since FROM memories),
bodies AS (SELECT memory_id || ':text' AS id, text AS x FROM incoming UNION ALL SELECT memory_id || ':summary', summary FROM incoming WHERE summary IS NOT NULL UNION ALL SELECT memory_id || ':detail', detail FROM incoming WHERE detail IS NOT NULL UNION ALL SELECT memory_id || ':action', action FROM incoming WHERE action IS NOT NULL)"""
_CLEAN = """clean AS (SELECT split_part(id, ':', 1)::BIGINT AS memory_id, max(y) FILTER (id LIKE '%:text') AS text, max(y) FILTER (id LIKE '%:summary') AS summary, max(y) FILTER (id LIKE '%:detail') AS detail, max(y) FILTER (id LIKE '%:action') AS action,
  array_to_string(list_sort(list_distinct(flatten(list(string_split(types, ',')) FILTER (types <> '')))), ',') AS flags FROM scrubbed GROUP BY 1),
adding AS (SELECT c.*, namespace, replaced, since, min(memory_id) OVER (PARTITION BY namespace, c.text) AS lowest FROM clean c JOIN incoming i USING (memory_id))"""


@query(
    "me_add",
    """SELECT memory_id, CASE WHEN lowest = memory_id OR replaced IS NOT NULL THEN 'add' ELSE 'confirm' END AS op, CASE WHEN lowest = memory_id OR replaced IS NOT NULL THEN memory_id ELSE lowest END AS target, CASE WHEN lowest <> memory_id THEN lowest END AS duplicate_of,
    coalesce(flags, '') AS flags, since AS effective_from, sha256(concat_ws('|', text, coalesce(summary, '-'), coalesce(detail, '-'), coalesce(action, '-'))) AS h FROM adding""",
    MEMORIES, _INCOMING, *SCRUBBED, _CLEAN,
)
def me_add(s, d):
    """ME1, ME3, SF1, SF16: four texts of a memory scrubbed, with flags; valid from its event's date; a twin in its namespace confirms the first."""
    m, k = memories(s, d), F.col("memory_id")
    mail = F.concat(F.lit("a"), "user_id", F.lit("@example.org"))
    incoming = m.select(
        "memory_id", "namespace", "text", F.when(k % 2 == 0, F.left("text", F.lit(24))).alias("summary"), F.when(k % 3 == 0, F.concat(F.lit("Seen by "), mail, F.lit(", "), mail, F.lit(" and 555-867-53"), F.lpad((k % 100).cast("string"), 2, "0"))).alias("detail"),
        F.when(k % 5 == 0, F.concat(F.lit("run with secret-"), F.lpad(k.cast("string"), 16, "0"))).alias("action"), F.when((k % 4 == 0) & F.col("supersedes").isNotNull(), F.array("supersedes")).otherwise(F.array().cast("array<long>")).alias("supersedes"),
        F.when(k % 6 == 0, F.lit("2023-06-01").cast("timestamp_ntz")).alias("event_date"), F.col("effective_from").cast("timestamp_ntz").alias("at"),
    )
    texts = F.concat_ws("|", "text", *[F.coalesce(f, F.lit("-")) for f in ("summary", "detail", "action")])
    return ME.additions(incoming, ["namespace"]).select("memory_id", "op", "target", "duplicate_of", F.array_join("flags", ",").alias("flags"), "effective_from", F.sha2(texts, 256).alias("h"))


_SETTINGS = {"min_confidence": 0.6, "scope": ["namespace", "user_id"]}
_CANDIDATES = """candidates AS (SELECT memory_id, namespace, user_id, confidence, CASE WHEN memory_id % 13 = 0 THEN '  ' ELSE text END AS text, memory_id % 17 <> 0 AS cited FROM memories),
bodies AS (SELECT memory_id::VARCHAR AS id, text AS x FROM candidates)"""
_DECIDED = """judged AS (SELECT c.*, y, types, confidence < 0.6 AS below, CASE WHEN trim(text) = '' THEN 'empty text' WHEN NOT cited THEN 'no source reference' END AS problem FROM candidates c JOIN scrubbed ON id = memory_id::VARCHAR),
lowest AS (SELECT namespace, user_id, y, min(memory_id) AS first FROM judged WHERE NOT below AND problem IS NULL GROUP BY ALL),
decided AS (SELECT memory_id, CASE WHEN below THEN 'below_threshold' WHEN problem IS NOT NULL THEN 'validation_error' WHEN first < memory_id THEN 'duplicate' ELSE 'accepted' END AS reason, CASE WHEN NOT below THEN problem END AS error, CASE WHEN NOT below AND problem IS NULL AND first < memory_id THEN first END AS duplicate_of, types FROM judged LEFT JOIN lowest USING (namespace, user_id, y))"""
_COMMIT = (MEMORIES, _CANDIDATES, *SCRUBBED, _DECIDED)


def _committed(s, d):
    k = F.col("memory_id")
    text = F.when(k % 13 == 0, "  ").otherwise(F.col("text"))
    refs = F.when(k % 17 != 0, F.array(F.concat(F.lit("mem://"), k))).otherwise(F.array().cast("array<string>"))
    c = memories(s, d).select("memory_id", "namespace", "user_id", text.alias("text"), "confidence", refs.alias("source_refs"), F.col("effective_from").cast("timestamp_ntz").alias("at"))
    return ME.committed(c, _SETTINGS["scope"], _SETTINGS["min_confidence"])


@query("ex_commit_decisions", "SELECT memory_id, reason, error, duplicate_of FROM decided", *_COMMIT)
def ex_commit_decisions(s, d):
    """EX3, FI14: each candidate's outcome: below the threshold, invalid and why, a duplicate and of what, or accepted."""
    return _committed(s, d).select("memory_id", "reason", "error", "duplicate_of")


@query("ex_commit_report", "SELECT reason, count(*) AS n FROM decided GROUP BY 1", *_COMMIT)
def ex_commit_report(s, d):
    """EX3: candidates by outcome; what was not stored is duplicated by none."""
    return _committed(s, d).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "ex_commit_stats",
    f"""SELECT count(*) AS candidates, {", ".join(f"count(*) FILTER (reason = '{r}') AS {r}" for r in ("accepted", "below_threshold", "validation_error", "duplicate"))},
    array_to_string(list_sort(list_distinct(flatten(list(string_split(types, ',')) FILTER (reason = 'accepted' AND types <> '')))), ',') AS pii_flags, '{hashlib.sha256(json.dumps(_SETTINGS, sort_keys=True).encode()).hexdigest()}' AS fingerprint FROM decided""",
    *_COMMIT,
)
def ex_commit_stats(s, d):
    """EX3, AG16: the report of all candidates, with the types of sensitive data in what was accepted and a digest of the settings."""
    return ME.commit_report(_committed(s, d), _SETTINGS)


_PATCHES = """patches AS (SELECT conv_id AS graph_id, turn AS seq, TIMESTAMP '2024-01-01' + to_minutes(conv_id::BIGINT) + to_hours(turn::BIGINT) AS moment, CASE turn % 4 WHEN 1 THEN 'blocked' WHEN 3 THEN 'done' WHEN 0 THEN 'active' END AS status, CASE WHEN turn % 2 = 0 THEN left(text, 30) END AS title FROM conversations WHERE conv_id IS NOT NULL),
graphs AS (SELECT graph_id, min(moment) AS created_at, max(moment) AS updated_at, arg_max(status, seq) FILTER (status IS NOT NULL) AS status, arg_max(title, seq) FILTER (title IS NOT NULL) AS title FROM patches GROUP BY 1)"""
_THEN = "2024-01-01 04:00:00"


def _patches(s, d):
    t = F.col("turn").cast("int")
    status = F.when(t % 4 == 1, "blocked").when(t % 4 == 3, "done").when(t % 4 == 0, "active")
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, turn, conv_id)")
    return table(s, d, "conversations").where("conv_id is not null").select(F.col("conv_id").alias("graph_id"), F.col("turn").alias("seq"), at.alias("at"), status.alias("status"), F.when(t % 2 == 0, F.left("text", F.lit(30))).alias("title"))


@query("wg_graphs", "SELECT * FROM graphs", _PATCHES)
def wg_graphs(s, d):
    """WG1: graphs created and updated by patches."""
    return GR.graphs(_patches(s, d), ["status", "title"])


@query("wg_graphs_as_of", f"SELECT g.graph_id, g.status, g.title, t.status AS status_then, t.title AS title_then FROM graphs g JOIN (SELECT graph_id, arg_max(status, seq) FILTER (status IS NOT NULL) AS status, arg_max(title, seq) FILTER (title IS NOT NULL) AS title FROM patches WHERE moment <= TIMESTAMP '{_THEN}' GROUP BY 1) t USING (graph_id) WHERE created_at <= TIMESTAMP '{_THEN}'", _PATCHES)
def wg_graphs_as_of(s, d):
    """WG1: graphs that existed at a time, as they are and as they were then."""
    p, fields = _patches(s, d), ["status", "title"]
    then = GR.graphs(p, fields, _THEN).select("graph_id", F.col("status").alias("status_then"), F.col("title").alias("title_then"))
    return GR.existing(GR.graphs(p, fields), _THEN).join(then, "graph_id").select("graph_id", "status", "title", "status_then", "title_then")


@query("wg_list_graphs", "SELECT namespace, graph_id, place::INT AS place FROM (SELECT *, graph_id % 4 AS namespace, row_number() OVER (PARTITION BY graph_id % 4 ORDER BY created_at, graph_id) AS place FROM graphs WHERE status = 'active') WHERE place <= 50", _PATCHES)
def wg_list_graphs(s, d):
    """WG1: each namespace's fifty oldest active graphs."""
    g = GR.graphs(_patches(s, d), ["status"]).where("status = 'active'").withColumn("namespace", F.col("graph_id") % 4)
    return GR.listed(g, "namespace").select("namespace", "graph_id", "place")
