"""Queries over references, JSON, typed memories, degraded search, renderings and call graphs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import objects as OB
from ..functions import rules as R
from ..functions import text as T
from ..operators import retrieval as RE
from .registry import query
from .tables import ARTIFACTS, MEMORIES, artifacts, chunks, memories, questions, table


@query("me_typed_writers", "SELECT memory_id, CASE kind WHEN 'decision' THEN 'outcome' WHEN 'instruction' THEN 'procedure' ELSE 'context' END AS type, user_id::VARCHAR AS anchor FROM memories", MEMORIES)
def me_typed_writers(s, d):
    """ME8: outcomes, procedures and contexts with their anchors as metadata."""
    kind = F.when(F.col("kind") == "decision", "outcome").when(F.col("kind") == "instruction", "procedure").otherwise("context")
    m = memories(s, d).select("memory_id", kind.alias("type"), F.create_map(F.lit("anchor"), F.col("user_id").cast("string")).alias("metadata"))
    return m.select("memory_id", "type", F.col("metadata")["anchor"].alias("anchor"))


@query("me_queried_audit", "SELECT memory_id, count(*) AS hits FROM memories, (VALUES (1, ['never', 'step']), (2, ['mail', 'step'])) q(qid, terms) WHERE len(list_intersect(terms, regexp_extract_all(lower(text), '[a-z0-9_]+'))) > 0 GROUP BY memory_id", MEMORIES)
def me_queried_audit(s, d):
    """ME7: which memories a batch of queries touched, as rows rather than a change."""
    index = RE.postings(memories(s, d).select("memory_id", "text"), "memory_id")
    asked = s.createDataFrame([(1, ["never", "step"]), (2, ["mail", "step"])], "qid long, terms array<string>")
    return RE.keyword_scores(index, asked, "memory_id").groupBy("memory_id").agg(F.count("*").alias("hits"))


@query("me_update_metadata", "SELECT memory_id, CASE WHEN memory_id % 3 = 0 THEN 'new' ELSE 'old' END AS tag, namespace FROM memories", MEMORIES)
def me_update_metadata(s, d):
    """ME5: a patch's entries win over those before."""
    base = F.create_map(F.lit("tag"), F.lit("old"), F.lit("ns"), F.col("namespace"))
    patch = F.when(F.col("memory_id") % 3 == 0, F.create_map(F.lit("tag"), F.lit("new"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(patch, k)), patch)
    return memories(s, d).select("memory_id", merged["tag"].alias("tag"), merged["ns"].alias("namespace"))


@query("tg_facts", r"SELECT artifact_id, count(*) AS facts FROM (SELECT artifact_id, unnest(string_split(regexp_replace(trim(content, ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS x FROM artifacts) WHERE length(x) BETWEEN 20 AND 200 GROUP BY artifact_id", ARTIFACTS)
def tg_facts(s, d):
    """TG3, TG6: sentences of a fact's length."""
    x = artifacts(s, d).select("artifact_id", F.explode(T.sentences("content")).alias("x")).where(F.length("x").between(20, 200))
    return x.groupBy("artifact_id").agg(F.count("*").alias("facts"))


@query("tg_rule_units", "SELECT memory_id, regexp_replace(text, '^never', 'Never') AS unit FROM memories WHERE event_type IN ('error', 'purchase', 'signup', 'click')", MEMORIES)
def tg_rule_units(s, d):
    """TG5: lines without list markers that a rule of a rule kind matches."""
    line = F.concat(F.lit("- "), "text")
    unit = F.trim(F.regexp_replace(line, r"^[\s\-*#>`]+", ""))
    return memories(s, d).where((F.length(unit) <= 400) & R.best_kind(unit)["kind"].isin("pitfall", "decision", "preference", "instruction")).select("memory_id", unit.alias("unit"))


@query("ex_chains", "SELECT user_id, event_type, count(*) AS n, count(*) FILTER (supersedes IS NOT NULL) AS closed FROM memories GROUP BY ALL", MEMORIES)
def ex_chains(s, d):
    """EX5, AG10: slots and how many of their memories close another."""
    return memories(s, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count("supersedes").alias("closed"))


@query("wg_render", "SELECT l_orderkey, 'graph TD' || chr(10) || string_agg('n' || a || ' --> n' || b, chr(10) ORDER BY a, b) AS mermaid FROM (SELECT DISTINCT l_orderkey, l_linenumber AS a, l_linenumber + 1 AS b FROM lineitem) GROUP BY 1")
def wg_render(s, d):
    """WG5: a graph as text."""
    return _rendered(table(s, d, "lineitem"))


def _rendered(edges):
    e = edges.select("l_orderkey", F.col("l_linenumber").alias("a")).distinct()
    lines = F.transform(F.array_sort(F.collect_list("a")), lambda a: F.concat(F.lit("n"), a.cast("string"), F.lit(" --> n"), (a + 1).cast("string")))
    return e.groupBy("l_orderkey").agg(F.concat(F.lit("graph TD\n"), F.array_join(lines, "\n")).alias("mermaid"))


@query("bm_asof_views", "SELECT view, count(*) AS n FROM memories JOIN (VALUES ('early', TIMESTAMP '2024-01-08'), ('mid', TIMESTAMP '2024-01-16'), ('now', TIMESTAMP '2024-02-01')) v(view, day) ON effective_from <= day AND (effective_until IS NULL OR effective_until > day) GROUP BY view", MEMORIES)
def bm_asof_views(s, d):
    """BM7: three views of one chain."""
    from ..operators.filters import valid_at

    views = s.sql("select * from values ('early', timestamp_ntz'2024-01-08'), ('mid', timestamp_ntz'2024-01-16'), ('now', timestamp_ntz'2024-02-01') v(view, day)")
    return memories(s, d).join(F.broadcast(views), valid_at(F.col("day"))).groupBy("view").agg(F.count("*").alias("n"))  # three rows


@query("st_latest_status", "SELECT user_id, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def st_latest_status(s, d):
    """ST3: the last state of each queued task."""
    n = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("event_id")))
    return table(s, d, "events").withColumn("n", n).where("n = 1").select("user_id", F.col("event_type").alias("status"))
