"""Queries over sessions, graphs, bundles, policies and extraction: folds, transitions, captures, reach and candidates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import pii as PI
from ..functions import rules as R
from ..functions import text as T
from ..operators import sessions as SE
from ..sources import bundles as BU
from ..sources.chunk_store import shared_dir
from .registry import query
from .stores import SCRUBBED
from .tables import ARTIFACTS, MEMORIES, artifacts, memories, table


@query(
    "st_scheduler",
    """SELECT user_id AS session, event_id AS n, due FROM r""",
    """seq AS (SELECT user_id, event_id, epoch(ts) AS secs, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)""",
    """steps AS (SELECT *, k IN (1, 2, 4, 8) AS warm FROM seq)""",
    """r AS (WITH RECURSIVE f AS (SELECT user_id, event_id, k, true AS due, 0 AS queued, secs AS last FROM steps WHERE k = 1
  UNION ALL SELECT s.user_id, s.event_id, s.k, s.warm OR f.queued + 1 >= 5 OR s.secs - f.last >= 36000, CASE WHEN s.warm OR f.queued + 1 >= 5 OR s.secs - f.last >= 36000 THEN 0 ELSE f.queued + 1 END, CASE WHEN s.warm OR f.queued + 1 >= 5 OR s.secs - f.last >= 36000 THEN s.secs ELSE f.last END FROM f JOIN steps s ON s.user_id = f.user_id AND s.k = f.k + 1) SELECT * FROM f)""",
)
def st_scheduler(s, d):
    """ST2: turns at which a session is processed: its first ones, when five are queued, or after ten hours."""
    e = table(s, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("n"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return SE.scheduled(e, 5, 36_000.0)


_FLUSHED = """turns AS (SELECT r.*, secs, warm, lag(last) OVER (PARTITION BY r.user_id ORDER BY r.k) AS before, coalesce(sum(due::INT) OVER (PARTITION BY r.user_id ORDER BY r.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM r JOIN steps USING (user_id, event_id)),
marked AS (SELECT *, coalesce(secs - before >= 36000, false) AS paused, bool_or(due) OVER w AS closed, bool_or(due AND coalesce(secs - before >= 36000, false)) OVER w AS idle_first, count(*) OVER w AS size FROM turns WINDOW w AS (PARTITION BY user_id, g)),
placed AS (SELECT user_id, g, CASE WHEN NOT closed OR idle_first AND NOT due THEN 1 ELSE 2 END AS part, event_id, due, secs, last, k, warm, idle_first, size FROM marked)"""


@query(
    "st_scheduler_flushes",
    """SELECT user_id AS session, CASE WHEN part = 2 THEN max(event_id) FILTER (due) END AS n, round(CASE WHEN part = 2 THEN max(secs) FILTER (due) ELSE max(last) + 36000 END, 3) AS "at",
    CASE WHEN part = 1 THEN 'idle' WHEN bool_or(warm AND due) THEN 'warm-up' WHEN count(*) >= 5 THEN 'queue' ELSE 'pause' END AS reason, string_agg(event_id::VARCHAR, ',' ORDER BY k) AS items FROM placed GROUP BY user_id, g, part""",
    """seq AS (SELECT user_id, event_id, epoch(ts) AS secs, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)""",
    """steps AS (SELECT *, k IN (1, 2, 4, 8) AS warm FROM seq)""",
    """r AS (WITH RECURSIVE f AS (SELECT user_id, event_id, k, true AS due, 0 AS queued, secs AS last FROM steps WHERE k = 1
  UNION ALL SELECT s.user_id, s.event_id, s.k, s.warm OR f.queued + 1 >= 5 OR s.secs - f.last >= 36000, CASE WHEN s.warm OR f.queued + 1 >= 5 OR s.secs - f.last >= 36000 THEN 0 ELSE f.queued + 1 END, CASE WHEN s.warm OR f.queued + 1 >= 5 OR s.secs - f.last >= 36000 THEN s.secs ELSE f.last END FROM f JOIN steps s ON s.user_id = f.user_id AND s.k = f.k + 1) SELECT * FROM f)""",
    _FLUSHED,
)
def st_scheduler_flushes(s, d):
    """ST2: what each processing takes from its session's queue and why; a queue that waits ten hours is flushed without a further turn."""
    from ..streaming.scheduler import flushes

    e = table(s, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("n"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return flushes(e, 5, 36_000.0).select("session", "n", F.round("at", 3).alias("at"), "reason", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


_LINES = "transcript AS (SELECT conv_id, turn, turn % 5 = 3 AS failed, CASE WHEN turn % 5 = 3 THEN '[RESULT ERROR] ' ELSE '[' || upper(role) || '] ' END || text AS line FROM conversations), numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM transcript)"


@query(
    "wi_transcript_windows",
    "SELECT conv_id AS session, place AS \"window\", length(text)::BIGINT AS chars, failed, sha256(text) AS h FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY failed DESC, length(text) DESC, place) AS n FROM (SELECT conv_id, w AS place, bool_or(failed) AS failed, string_agg(line, chr(10) ORDER BY k) AS text FROM filled GROUP BY ALL)) WHERE n <= 3",
    _LINES,
    """filled AS (WITH RECURSIVE f AS (SELECT conv_id, k, line, failed, 0::BIGINT AS w, length(line) AS size FROM numbered WHERE k = 1
  UNION ALL SELECT n.conv_id, n.k, n.line, n.failed, CASE WHEN f.size >= 600 THEN f.w + 1 ELSE f.w END, CASE WHEN f.size >= 600 THEN length(n.line) ELSE f.size + length(n.line) END FROM f JOIN numbered n ON n.conv_id = f.conv_id AND n.k = f.k + 1) SELECT * FROM f)""",
)
def wi_transcript_windows(s, d):
    """WI5, TG11: each transcript's three windows of 600 characters or more, those with failures first, in their order."""
    c = table(s, d, "conversations")
    failed = F.col("turn") % 5 == 3
    line = F.concat(F.when(failed, "[RESULT ERROR] ").otherwise(F.concat(F.lit("["), F.upper("role"), F.lit("] "))), "text")
    w = SE.transcript_windows(c.select(F.col("conv_id").alias("session"), F.col("turn").alias("n"), line.alias("line"), failed.alias("failed")), 600, 3)
    return w.select("session", "window", "chars", "failed", F.sha2("text", 256).alias("h"))


def scenarios(s, d):
    """A grid over nations: when dimensions drift, the period of noise, hidden drifts and how late mistakes show."""
    k = F.col("n_nationkey")
    return table(s, d, "nation").select(
        k.cast("long").alias("scenario"), F.lit(120).alias("tasks"), (20 + k % 5).alias("drift1"), (30 + 3 * (k % 4)).alias("drift2"), F.when(k % 6 == 5, 500).otherwise(40 + k).alias("drift3"),
        F.element_at(F.array(F.lit(10), F.lit(0), F.lit(3)), (k % 3 + 1).cast("int")).alias("noise"), F.when(k % 4 == 3, 60 + k).alias("hidden"), (k % 3 + 1).alias("lag"),
    )


@query("ru_simulation", None)
def ru_simulation(s, d):
    """RU5, BM9: seven policies over 25 scenarios of 120 tasks."""
    return SE.simulated(scenarios(s, d))


_NODES = "nodes AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'blocked' WHEN l_linestatus = 'O' AND l_quantity < 10 THEN 'pending' WHEN l_linestatus = 'O' THEN 'active' WHEN l_quantity > 45 THEN 'failed' ELSE 'done' END AS st, l_partkey, l_suppkey, l_quantity FROM lineitem)"


def _nodes(s, d):
    st = F.when(F.col("l_returnflag") == "R", "blocked").when((F.col("l_linestatus") == "O") & (F.col("l_quantity") < 10), "pending").when(F.col("l_linestatus") == "O", "active").when(F.col("l_quantity") > 45, "failed").otherwise("done")
    return table(s, d, "lineitem").withColumn("st", st)


@query(
    "wg_transitions",
    "SELECT old, new, old = new OR (old = 'pending' AND new IN ('active', 'blocked', 'abandoned')) OR (old = 'active' AND new IN ('done', 'blocked', 'failed', 'abandoned')) OR (old = 'blocked' AND new IN ('active', 'abandoned')) AS allowed, count(*) AS n FROM (SELECT st AS new, lag(st) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS old FROM nodes) WHERE old IS NOT NULL GROUP BY ALL",
    _NODES,
)
def wg_transitions(s, d):
    """WG2: steps between states along a graph, and whether they are allowed."""
    old = F.lag("st").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    steps = _nodes(s, d).select(old.alias("old"), F.col("st").alias("new")).where("old is not null")
    return steps.groupBy("old", "new", SE.may_follow(F.col("old"), F.col("new")).alias("allowed")).agg(F.count("*").alias("n"))


_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query("wg_capture", f"SELECT conv_id AS graph_id, turn, 'tool_result' AS event_kind, 'search: ' || CASE WHEN length({_FLAT}) <= 480 THEN {_FLAT} ELSE left({_FLAT}, 479) || '…' END AS summary, length(text)::BIGINT AS chars, length(text) > 512 AS above_threshold FROM conversations WHERE role = 'assistant'")
def wg_capture(s, d):
    """WG4, SF38: tool results as events that keep a short summary and the size, never the text."""
    flat = F.btrim(F.regexp_replace("text", r"\s+", " "))
    short = F.when(F.length(flat) <= 480, flat).otherwise(F.concat(F.left(flat, F.lit(479)), F.lit("…")))
    return table(s, d, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("graph_id"), "turn", F.lit("tool_result").alias("event_kind"), F.concat(F.lit("search: "), short).alias("summary"), F.length("text").cast("long").alias("chars"), (F.length("text") > 512).alias("above_threshold"))


@query("wg_close_session", "SELECT o_custkey % 50 AS session, count(*) FILTER (o_orderstatus = 'O') AS closed, count(*) FILTER (o_orderstatus = 'P') AS left_active FROM orders GROUP BY 1")
def wg_close_session(s, d):
    """WG4: graphs that closing each session completes; those of another state stay, so closing again changes nothing."""
    o = table(s, d, "orders").select((F.col("o_custkey") % 50).alias("session"), F.col("o_orderstatus").alias("before"))
    after = o.withColumn("after", F.when(F.col("before") == "O", "C").otherwise(F.col("before")))
    return after.groupBy("session").agg(F.count(F.when(F.col("before") != F.col("after"), 1)).alias("closed"), F.count(F.when(F.col("after") == "P", 1)).alias("left_active"))


@query("wg_markdown", "SELECT l_orderkey, '# Graph ' || l_orderkey || chr(10) || string_agg('- [' || st || '] line ' || l_linenumber, chr(10) ORDER BY l_linenumber, st) AS markdown, count(*) AS nodes FROM (SELECT DISTINCT l_orderkey, l_linenumber, st FROM nodes) GROUP BY l_orderkey", _NODES)
def wg_markdown(s, d):
    """WG5: graphs through JSON and back, as Markdown."""
    n = _nodes(s, d).select("l_orderkey", "l_linenumber", "st").distinct()
    text = n.groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct("l_linenumber", "st")))).alias("json"))
    back = text.select("l_orderkey", F.from_json("json", "array<struct<l_linenumber:int,st:string>>").alias("x"))
    lines = F.transform("x", lambda v: F.concat(F.lit("- ["), v["st"], F.lit("] line "), v["l_linenumber"]))
    return back.select("l_orderkey", F.concat(F.lit("# Graph "), F.col("l_orderkey").cast("string"), F.lit("\n"), F.array_join(lines, "\n")).alias("markdown"), F.size("x").cast("long").alias("nodes"))


_CALLS = "calls AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_quantity = 50 AND l_partkey <> l_suppkey)"


@query("wg_impact", "SELECT node, min(depth)::INT AS depth FROM (WITH RECURSIVE r(node, depth) AS (SELECT DISTINCT a, 0 FROM calls WHERE a <= 20 UNION SELECT c.b, depth + 1 FROM r JOIN calls c ON c.a = r.node WHERE depth < 4) SELECT * FROM r) GROUP BY node HAVING min(depth) > 0", _CALLS)
def wg_impact(s, d):
    """CI1: what some nodes reach within four calls."""
    calls = table(s, d, "lineitem").where("l_quantity = 50 and l_partkey <> l_suppkey").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    return SE.reachable(calls, calls.where("a <= 20").select(F.col("a").alias("node")).distinct(), 4)


@query(
    "bm_call_graph",
    """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN d.file IS NOT NULL THEN 'in_file' WHEN u.files = 1 THEN 'cross_file' ELSE 'external' END AS kind FROM uses c LEFT JOIN defs d ON d.file = c.file AND d.name = c.name LEFT JOIN (SELECT name, count(*) AS files FROM defs GROUP BY name) u ON u.name = c.name) GROUP BY kind""",
    "defs AS (SELECT DISTINCT p_size AS file, p_brand || p_type AS name FROM part WHERE p_partkey % 7 = 0), uses AS (SELECT p_partkey, p_size AS file, p_brand || p_type AS name FROM part)",
)
def bm_call_graph(s, d):
    """BM8: calls resolved in their file, else in the only file that defines the name, else external."""
    p = table(s, d, "part").select("p_partkey", F.col("p_size").alias("file"), F.concat("p_brand", "p_type").alias("name"))
    defs = p.where("p_partkey % 7 = 0").select("file", "name").distinct()
    own, only = defs.withColumn("here", F.lit(True)), defs.groupBy("name").agg(F.count("*").alias("files"))
    out = p.join(own, ["file", "name"], "left").join(only, "name", "left")
    return out.groupBy(F.when(F.col("here"), "in_file").when(F.col("files") == 1, "cross_file").otherwise("external").alias("kind")).agg(F.count("*").alias("n"))


@query("sc_bundle_roundtrip", "SELECT 'artifact' AS kind, artifact_id AS id, namespace, sha256(content) AS digest, NULL::BIGINT AS confirmations FROM artifacts UNION ALL SELECT 'memory', memory_id::VARCHAR, namespace, sha256(text), memory_id % 5 FROM memories", ARTIFACTS, MEMORIES)
def sc_bundle_roundtrip(s, d):
    """SC12, SC13: artifacts and memories to files of JSON lines and back, with what confirmed them."""
    path = f"{shared_dir(s)}/bundle-{uuid.uuid4().hex}"
    BU.export_bundle(artifacts(s, d), memories(s, d).withColumn("confirmations", F.col("memory_id") % 5), path)
    return BU.import_bundle(s, path).select("kind", "id", "namespace", F.sha2("content", 256).alias("digest"), "confirmations")


@query("sc_fetch_policy", "SELECT b.id, CASE WHEN doc_id % 4 = 0 THEN 'blocked' WHEN doc_id % 4 = 1 THEN 'raw' ELSE 'scrubbed' END AS outcome, CASE WHEN doc_id % 4 = 1 THEN sha256(x) WHEN doc_id % 4 > 1 THEN sha256(y) END AS h FROM bodies b JOIN scrubbed s USING (id) JOIN artifacts a ON a.artifact_id = b.id", ARTIFACTS, "bodies AS (SELECT artifact_id AS id, content AS x FROM artifacts)", *SCRUBBED)
def sc_fetch_policy(s, d):
    """SC17: raw content only where it is allowed, blocked where it is asked for and not, else scrubbed."""
    k = F.col("doc_id") % 4
    a = artifacts(s, d).select(F.col("artifact_id").alias("id"), k.alias("k"), "content")
    given = F.when(F.col("k") == 1, F.col("content")).when(F.col("k") > 1, PI.scrub(F.col("content"))["text"])
    return a.select("id", F.when(F.col("k") == 0, "blocked").when(F.col("k") == 1, "raw").otherwise("scrubbed").alias("outcome"), F.sha2(given, 256).alias("h"))


@query("sc_directory_scan", None)
def sc_directory_scan(s, d):
    """SC16: the files of the tables' folder."""
    return BU.directory(s, d).select("path", "length")


def _matches(text: str) -> str:
    ordered = sorted(range(len(R.KINDS)), key=lambda i: (-R.KINDS[i][1], i))
    any_of = lambda ps: " OR ".join("regexp_matches(" + text + ", '" + p.replace("'", "''") + "')" for p in ps)
    return "CASE " + " ".join(f"WHEN {any_of(R.KINDS[i][2])} THEN '{R.KINDS[i][0]}'" for i in ordered) + " END"


#: A note for each user: its memories as a list, and plain sentences between them.
_NOTES = """notes AS (SELECT user_id, string_agg(CASE memory_id % 3 WHEN 0 THEN '- **' || text || '**' WHEN 1 THEN '> ' || text || '. It rained ' || memory_id % 13 || ' days.' ELSE '# ' || text END, chr(10) ORDER BY memory_id) AS note FROM memories GROUP BY user_id),
lines AS (SELECT user_id, unnest(string_split(note, chr(10))) AS l, unnest(range(1, len(string_split(note, chr(10))) + 1)) AS line_no FROM notes),
cleaned AS (SELECT user_id, line_no, trim(trim(trim(regexp_replace(l, '^[\\s\\-*#>`]+', '')), '*`')) AS l FROM lines),
units AS (SELECT user_id, line_no, unnest(x) AS unit, unnest(range(1, len(x) + 1)) AS unit_no FROM (SELECT user_id, line_no, string_split(regexp_replace(l, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS x FROM cleaned))"""
_CANDIDATES = f"""kinds AS (SELECT *, {_matches("unit")} AS kind FROM units WHERE unit <> '' AND length(unit) <= 400),
ruled AS (SELECT user_id, 1 AS pass, line_no, unit_no, unit, kind FROM kinds WHERE kind IN ('pitfall', 'decision', 'preference', 'instruction', 'workaround') UNION ALL SELECT user_id, 2, line_no, unit_no, unit, CASE WHEN kind IS NOT NULL AND kind <> 'issue' THEN kind ELSE 'fact' END FROM kinds),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, lower(trim(unit)) ORDER BY pass, line_no, unit_no) AS again FROM ruled) WHERE again = 1),
chosen AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pass, line_no, unit_no) AS place FROM once)"""


@query(
    "ex_candidates",
    "SELECT user_id, place, kind, sha256(y) AS h, types FROM chosen JOIN scrubbed ON id = user_id || ':' || place WHERE place <= 50",
    MEMORIES, _NOTES, _CANDIDATES, "bodies AS (SELECT user_id || ':' || place AS id, unit AS x FROM chosen WHERE place <= 50)", *SCRUBBED,
)
def ex_candidates(s, d):
    """EX2, EX4, TG5, TG6, SE1: a note's lines that match a rule, then its sentences as facts; each text once, 50 at most, scrubbed and classified."""
    m = memories(s, d)
    line = F.expr("case memory_id % 3 when 0 then concat('- **', text, '**') when 1 then concat('> ', text, '. It rained ', memory_id % 13, ' days.') else concat('# ', text) end")
    notes = m.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("memory_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("note"))
    return R.candidates(notes, "user_id", "note", 50).select("user_id", "place", "kind", F.sha2("text", 256).alias("h"), "types")
