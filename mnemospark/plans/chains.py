"""Queries over memories, sessions, graphs and streams: folds, chains, aggregation, reuse, clustering and audits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import rules as R
from ..functions import text as T
from ..operators import aggregates as AG
from ..operators import clusters as CL
from ..operators import context as C
from ..operators import memory as ME
from .registry import query
from .tables import ARTIFACTS, MEMORIES, artifacts, memories, table


def _ops(s, d):
    """The operation log: an addition for each event, then confirmations, retractions and deletions by id."""
    m = memories(s, d)
    add = m.select((F.col("memory_id") * 10).alias("seq"), F.lit("add").alias("op"), "memory_id", "text", F.col("effective_from").alias("at"), F.when(F.col("supersedes").isNotNull(), F.array("supersedes")).otherwise(F.array().cast("array<long>")).alias("supersedes"), "confidence")
    late = lambda op, k, r: m.where(f"memory_id % {k} = 0").select((F.col("memory_id") * 10 + r).alias("seq"), F.lit(op).alias("op"), "memory_id", F.lit(None).cast("string").alias("text"), F.expr("effective_from + interval 1 hour").alias("at"), F.array().cast("array<long>").alias("supersedes"), F.lit(None).cast("double").alias("confidence"))
    return add.unionByName(late("confirm", 7, 1)).unionByName(late("retract", 17, 2)).unionByName(late("delete", 23, 3))


_OPS = """ops AS (SELECT memory_id * 10 AS seq, 'add' AS op, memory_id, effective_from AS moment FROM memories UNION ALL SELECT memory_id * 10 + 1, 'confirm', memory_id, effective_from + INTERVAL 1 HOUR FROM memories WHERE memory_id % 7 = 0
  UNION ALL SELECT memory_id * 10 + 2, 'retract', memory_id, effective_from + INTERVAL 1 HOUR FROM memories WHERE memory_id % 17 = 0 UNION ALL SELECT memory_id * 10 + 3, 'delete', memory_id, effective_from + INTERVAL 1 HOUR FROM memories WHERE memory_id % 23 = 0
  UNION ALL SELECT memory_id * 10, 'supersede', supersedes, effective_from FROM memories WHERE supersedes IS NOT NULL),
st AS (SELECT memory_id, max((seq, op)) FILTER (op IN ('supersede', 'retract', 'delete')) AS s, arg_max(op, seq) FILTER (op IN ('supersede', 'retract')) AS cop, arg_max(moment, seq) FILTER (op IN ('supersede', 'retract')) AS cat, count(*) FILTER (op = 'confirm') AS n FROM ops GROUP BY memory_id)"""


@query("me_fold", "SELECT m.memory_id, CASE arg_max WHEN 'supersede' THEN 'superseded' WHEN 'retract' THEN 'retracted' WHEN 'delete' THEN 'deleted' ELSE 'active' END AS status, CASE WHEN cop = 'supersede' THEN greatest(cat, m.effective_from) ELSE cat END AS effective_until, 1 + n AS confirmations FROM memories m JOIN (SELECT st.*, s[2] AS arg_max FROM st) q USING (memory_id)", MEMORIES, _OPS)
def me_fold(s, d):
    """ME1, ME2, ME4, ME5, JO7: the log folded; the last closing wins, deletes keep the validity."""
    return ME.folded(_ops(s, d)).select("memory_id", "status", "effective_until", F.col("confirmations").cast("long").alias("confirmations"))


@query("me_supersede_tiling", "SELECT memory_id, greatest(effective_from, coalesce(lead(effective_from) OVER (PARTITION BY user_id, event_type ORDER BY memory_id), effective_from)) AS ends FROM memories", MEMORIES)
def me_supersede_tiling(s, d):
    """ME4, WI8, AG10: chains tile."""
    return ME.tiled(memories(s, d).drop("effective_until"), ["user_id", "event_type"], "memory_id").select("memory_id", F.coalesce("effective_until", "effective_from").alias("ends"))


@query("me_add_confirm", "SELECT min(memory_id) AS memory_id, text, user_id, count(*) AS confirmations FROM memories GROUP BY text, user_id", MEMORIES)
def me_add_confirm(s, d):
    """ME1, ME3, ST5: the first of equal facts is inserted, later ones confirm it."""
    return ME.insert_or_confirm(memories(s, d), "memory_id", ["text", "user_id"]).select("memory_id", "text", "user_id", "confirmations")


@query("me_retract_delete", "SELECT CASE arg_max WHEN 'retract' THEN 'retracted' ELSE 'deleted' END AS status, count(*) AS n FROM (SELECT s[2] AS arg_max FROM st) WHERE arg_max IN ('retract', 'delete') GROUP BY 1", MEMORIES, _OPS)
def me_retract_delete(s, d):
    """ME5."""
    return ME.folded(_ops(s, d)).where("status in ('retracted', 'deleted')").groupBy("status").agg(F.count("*").alias("n"))


@query("me_transaction_time", "SELECT m.memory_id, CASE s[2] WHEN 'supersede' THEN 'superseded' WHEN 'retract' THEN 'retracted' WHEN 'delete' THEN 'deleted' ELSE 'active' END AS status, (1 + coalesce(n, 0))::BIGINT AS confirmations FROM memories m LEFT JOIN st USING (memory_id) WHERE m.memory_id * 10 <= 40000", MEMORIES, _OPS.replace("FROM ops GROUP BY memory_id", "FROM ops WHERE seq <= 40000 GROUP BY memory_id"))
def me_transaction_time(s, d):
    """ME5: the state as a prefix of the log has it."""
    return ME.folded(_ops(s, d), 40_000).select("memory_id", "status", F.col("confirmations").cast("long").alias("confirmations"))


@query("me_purge", "SELECT memory_id FROM memories WHERE NOT (status = 'superseded' AND effective_until < TIMESTAMP '2024-01-20')", MEMORIES)
def me_purge(s, d):
    """ME6."""
    return ME.purged(memories(s, d), "2024-01-20 00:00:00").select("memory_id")


@query("ag_group_kind", "SELECT kind, status, count(*) AS n, round(avg(confidence), 6) AS c FROM memories GROUP BY ALL", MEMORIES)
def ag_group_kind(s, d):
    """AG1."""
    return memories(s, d).groupBy("kind", "status").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("c"))


@query("ag_episode", "SELECT session_id, count(*) AS n, count(*) FILTER (kind = 'decision') AS decisions, count(*) FILTER (kind = 'pitfall') AS pitfalls, string_agg(CASE WHEN kind = 'decision' THEN memory_id::VARCHAR END, ',' ORDER BY memory_id) AS refs FROM memories GROUP BY session_id", MEMORIES)
def ag_episode(s, d):
    """AG2, DI4: a session's decisions, pitfalls and references to all decisions, in order."""
    return _episodes(memories(s, d))


def _episodes(found):
    refs = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "decision", F.col("memory_id")))), lambda x: x.cast("string")), ",")
    return found.groupBy("session_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("kind") == "decision", 1)).alias("decisions"), F.count(F.when(F.col("kind") == "pitfall", 1)).alias("pitfalls"), refs.alias("refs"))


@query("ag_span_bounds", "SELECT 'span-' || left(sha1(user_id::VARCHAR), 12) AS span, min(effective_from) AS started, max(effective_from) AS ended, count(*) AS n FROM memories GROUP BY user_id", MEMORIES)
def ag_span_bounds(s, d):
    """AG3."""
    return memories(s, d).groupBy("user_id").agg(F.min("effective_from").alias("started"), F.max("effective_from").alias("ended"), F.count("*").alias("n")).select(F.concat(F.lit("span-"), F.left(F.sha1(F.col("user_id").cast("string")), F.lit(12))).alias("span"), "started", "ended", "n")


@query("ag_dedup_norm", "SELECT lower(trim(text)) AS k, min(memory_id) AS first, count(DISTINCT session_id) AS refs FROM memories WHERE kind = 'preference' GROUP BY 1", MEMORIES)
def ag_dedup_norm(s, d):
    """AG4, AG5, SE4, DI2."""
    return memories(s, d).where("kind = 'preference'").groupBy(F.lower(F.trim("text")).alias("k")).agg(F.min("memory_id").alias("first"), F.countDistinct("session_id").alias("refs"))


@query("ag_state_latest", "SELECT user_id, arg_max(kind, memory_id) AS kind, max(memory_id) AS memory_id FROM memories GROUP BY user_id", MEMORIES)
def ag_state_latest(s, d):
    """AG6, AG7, DI3: the newest wins."""
    return memories(s, d).groupBy("user_id").agg(F.max(F.struct("memory_id", "kind")).alias("x")).select("user_id", "x.kind", "x.memory_id")


@query("ag_overlap", "SELECT user_id, count(DISTINCT event_type) AS aspects FROM memories GROUP BY user_id HAVING count(DISTINCT event_type) > 1", MEMORIES)
def ag_overlap(s, d):
    """AG9: subjects with several aspects."""
    return memories(s, d).groupBy("user_id").agg(F.countDistinct("event_type").alias("aspects")).where("aspects > 1")


@query("ag_rollup_cube", "SELECT coalesce(kind, '*') AS kind, coalesce(status, '*') AS status, count(*) AS n, round(sum(value), 2) AS v FROM memories GROUP BY CUBE (kind, status)", MEMORIES)
def ag_rollup_cube(s, d):
    """AG11, AG14: all groupings in one pass."""
    return memories(s, d).cube("kind", "status").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("v")).select(F.coalesce("kind", F.lit("*")).alias("kind"), F.coalesce("status", F.lit("*")).alias("status"), "n", "v")


@query("ag_percentile", "SELECT event_type, value AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i = floor(0.95 * n)")
def ag_percentile(s, d):
    """AG12: nearest rank by index, by a histogram of each type rather than its rows in one window."""
    return AG.ranked_values(table(s, d, "events").select("event_type", "value", "event_id"), "event_type", "value", 0.95).select("event_type", F.col("ranked").alias("p95"))


@query("wi_newest_per_cluster", "SELECT memory_id, n > 1 AS retracted FROM (SELECT memory_id, row_number() OVER (PARTITION BY kind, user_id ORDER BY effective_from DESC, memory_id DESC) AS n FROM memories)", MEMORIES)
def wi_newest_per_cluster(s, d):
    """WI6."""
    n = F.row_number().over(W.partitionBy("kind", "user_id").orderBy(F.desc("effective_from"), F.desc("memory_id")))
    return memories(s, d).select("memory_id", (n > 1).alias("retracted"))


@query("tk_sort", "SELECT memory_id FROM memories ORDER BY confidence DESC, effective_from DESC, memory_id LIMIT 100", MEMORIES)
def tk_sort(s, d):
    """TK1, TK3."""
    return memories(s, d).orderBy(F.desc("confidence"), F.desc("effective_from"), "memory_id").limit(100).select("memory_id")


@query("tk_per_group", "SELECT kind, memory_id FROM (SELECT kind, memory_id, row_number() OVER (PARTITION BY kind ORDER BY value DESC, memory_id) AS n FROM memories) WHERE n <= 5", MEMORIES)
def tk_per_group(s, d):
    """TK2."""
    return memories(s, d).withColumn("n", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("value"), "memory_id"))).where("n <= 5").select("kind", "memory_id")


_ENV = "env AS (SELECT o_orderkey AS id, o_orderdate, o_totalprice, o_orderkey % 5 = 0 AS expired, o_orderkey % 3 <> 0 AS same, o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AS narrow, o_totalprice > 50000 AS worth FROM orders)"
_VERDICT = "CASE WHEN expired THEN 'expired' WHEN same THEN CASE WHEN worth THEN 'match' ELSE 'not_worth' END WHEN {n} THEN CASE WHEN worth THEN 'reused_noise' ELSE 'not_worth' END ELSE 'drift' END"


def _env(s, d):
    """Outcomes: environments at derivation and now, whose dimensions drift by key."""
    o = table(s, d, "orders").withColumn("then", F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority"))
    drift = F.when(F.col("o_orderkey") % 3 == 0, F.when(F.col("o_orderkey") % 2 == 0, F.lit("priority")).otherwise(F.lit("status"))).otherwise(F.lit(""))
    now = F.transform_values("then", lambda k, v: F.when(k == F.col("drift"), F.concat(v, F.lit("!"))).otherwise(v))
    return o.withColumn("drift", drift).withColumn("now", now).withColumn("declared", F.array(F.lit("status")))


def _verdict(tiered: bool):
    entries = lambda c: F.array_sort(F.map_entries(c))
    same = entries("then") == entries("now")
    narrow = ~F.exists("declared", lambda k: F.col("then")[k] != F.col("now")[k]) if tiered else F.lit(False)
    return C.reuse_verdict(F.col("o_orderkey") % 5 == 0, same, narrow, F.col("o_totalprice") > 50000)


@query("ru_canary", f"SELECT verdict, count(*) AS n FROM (SELECT {_VERDICT.format(n='false')} AS verdict FROM env) GROUP BY 1", _ENV)
def ru_canary(s, d):
    """RU1, SF28, SF29."""
    return _env(s, d).groupBy(_verdict(False).alias("verdict")).agg(F.count("*").alias("n"))


@query("ru_tiered", f"SELECT verdict, count(*) AS n FROM (SELECT {_VERDICT.format(n='narrow')} AS verdict FROM env) GROUP BY 1", _ENV)
def ru_tiered(s, d):
    """RU2: declared dimensions decide whether drift matters."""
    return _env(s, d).groupBy(_verdict(True).alias("verdict")).agg(F.count("*").alias("n"))


_TRIED = f"""tried AS (SELECT o_custkey, id, {_VERDICT.format(n='narrow')} AS verdict, row_number() OVER (PARTITION BY o_custkey ORDER BY env.o_totalprice DESC, id) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY env.o_orderdate DESC, id DESC) AS newest FROM orders JOIN env ON id = o_orderkey),
hits AS (SELECT o_custkey, coalesce(min(n) FILTER (verdict IN ('match', 'reused_noise')), max(n)) AS n FROM tried GROUP BY o_custkey)"""


def _outcomes(s, d):
    return _env(s, d).select("o_custkey", F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderdate", _verdict(True).alias("verdict"))


@query("ru_best_first", "SELECT o_custkey, id AS outcome, verdict IN ('match', 'reused_noise') AS reuse, verdict AS reason FROM tried JOIN hits USING (o_custkey, n)", _ENV, _TRIED)
def ru_best_first(s, d):
    """RU3: a customer's outcomes by score: the first that can be reused, else the last one's reason."""
    return C.best_first(_outcomes(s, d), "o_custkey", [F.desc("o_totalprice"), F.col("id")]).select("o_custkey", F.col("id").alias("outcome"), "reuse", "reason")


@query("ru_latest", "SELECT o_custkey, id AS outcome, verdict IN ('match', 'reused_noise') AS reuse, verdict AS reason FROM tried WHERE newest = 1", _ENV, _TRIED)
def ru_latest(s, d):
    """RU3: without an intent only the newest outcome is tried."""
    return C.best_first(_outcomes(s, d), "o_custkey", [F.desc("o_orderdate"), F.desc("id")], 1).select("o_custkey", F.col("id").alias("outcome"), "reuse", "reason")


@query("ru_learn", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'status,priority' ELSE 'status' END AS declared FROM orders")
def ru_learn(s, d):
    """RU4: undeclared dimensions that drifted are declared from now on."""
    drifted = F.filter(F.map_keys("then"), lambda k: F.col("then")[k] != F.col("now")[k])
    return _env(s, d).select("o_orderkey", F.array_join(F.array_union("declared", drifted), ",").alias("declared"))


@query("di_facts", "SELECT lower(text) AS k, min(memory_id) AS first FROM memories WHERE status = 'active' AND kind = 'fact' GROUP BY 1", MEMORIES)
def di_facts(s, d):
    """DI1."""
    return memories(s, d).where("status = 'active' and kind = 'fact'").groupBy(F.lower("text").alias("k")).agg(F.min("memory_id").alias("first"))


@query("di_timeline", "SELECT session_id, min(effective_from) AS started FROM memories WHERE len(list_intersect(regexp_extract_all(lower(text), '[a-z0-9_]+'), ['decided', 'plan'])) >= 1 GROUP BY session_id ORDER BY started, session_id", MEMORIES)
def di_timeline(s, d):
    """DI4, DI5: sessions that hold half of the query's words, oldest first."""
    hits = memories(s, d).where(T.overlap_score(F.array(F.lit("decided"), F.lit("plan")), "text") >= 0.5)
    return hits.groupBy("session_id").agg(F.min("effective_from").alias("started")).orderBy("started", "session_id")


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("label").cast("long").alias("grp"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def _refs(s, d):
    """The sources of each vector: one for itself in its label, one that several share."""
    v = _vectors(s, d)
    return v.select("grp", "id", F.explode(F.array(F.concat_ws("/", F.lit("mem:/"), "grp", F.col("id") % 50), F.concat_ws("/", F.lit("mem:/shared"), F.col("id") % 3))).alias("ref"))


@query("di_spans", None)
def di_spans(s, d):
    """DI6, AG3: greedy clusters of episodes at 0.65 and their bounds."""
    c = CL.greedy_clusters(_vectors(s, d), "grp", "id", 0.65)
    return c.groupBy("grp", "seed").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


@query("sd_semantic_dedup", None)
def sd_semantic_dedup(s, d):
    """SD1: the first of each cluster at 0.82 represents it."""
    return CL.greedy_clusters(_vectors(s, d), "grp", "id", 0.82).withColumn("kept", F.col("id") == F.col("seed"))


@query("sd_merged_refs", None)
def sd_merged_refs(s, d):
    """SD1: the references that each representative takes over from its cluster, each once, in the order in which they came."""
    return CL.merged_refs(CL.greedy_clusters(_vectors(s, d), "grp", "id", 0.82), _refs(s, d))


@query("sd_consolidate", None)
def sd_consolidate(s, d):
    """SD2: of each cluster at 0.82 all but the newest are retracted, with the one that replaces them; newest goes by a session's time, then id."""
    c = CL.greedy_clusters(_vectors(s, d), "grp", "id", 0.82).withColumn("recency", F.col("id") * 7919 % 10007)
    newest = c.groupBy("grp", "seed").agg(F.max(F.struct("recency", "id"))["id"].alias("newest"))
    return c.join(newest, ["grp", "seed"]).select("grp", "id", "seed", (F.col("id") != F.col("newest")).alias("retracted"), F.when(F.col("id") != F.col("newest"), F.col("newest")).alias("replaced_by"))


@query("wg_query", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' AND l_linestatus = 'O' AND l_returnflag LIKE '%N%'")
def wg_query(s, d):
    """WG1, WG3: nodes by label in open graphs."""
    n = table(s, d, "lineitem").where((F.col("l_linestatus") == "O") & F.contains("l_returnflag", F.lit("N")))
    return table(s, d, "orders").where("o_orderstatus = 'O'").join(n, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber")


@query("in_payload", "SELECT artifact_id, 'Stored ' || reference || ' (' || token_estimate || ' tokens)' AS payload FROM artifacts WHERE length(content) >= 8000 OR octet_length(encode(content)) // 4 >= 2000", ARTIFACTS)
def in_payload(s, d):
    """IN1, SF12."""
    from ..operators.filters import must_intercept

    return artifacts(s, d).where(must_intercept("content")).select("artifact_id", F.concat(F.lit("Stored "), "reference", F.lit(" ("), F.col("token_estimate").cast("string"), F.lit(" tokens)")).alias("payload"))


@query("bm_staleness", "SELECT kind, round(avg((status = 'superseded' AND effective_until > TIMESTAMP '2024-01-25')::INT), 6) AS stale FROM memories GROUP BY kind", MEMORIES)
def bm_staleness(s, d):
    """BM1, BM2: share of outdated values that were still in force late."""
    late = (F.col("status") == "superseded") & F.coalesce(F.col("effective_until") > F.expr("timestamp_ntz'2024-01-25'"), F.lit(False))
    return memories(s, d).groupBy("kind").agg(F.round(F.avg(late.cast("int")), 6).alias("stale"))


@query("bm_over_merge", "SELECT round(1 - count(*) FILTER (status = 'active') / count(DISTINCT (user_id, event_type))::DOUBLE, 6) AS lost FROM memories", MEMORIES)
def bm_over_merge(s, d):
    """BM2: slots whose current value can't be retrieved."""
    return memories(s, d).agg(F.round(1 - F.count(F.when(F.col("status") == "active", 1)) / F.countDistinct("user_id", "event_type"), 6).alias("lost"))


@query("bm_truth_at", "SELECT user_id, event_type, arg_max(memory_id, (effective_from, memory_id)) AS memory_id FROM memories WHERE effective_from <= TIMESTAMP '2024-01-15' GROUP BY ALL", MEMORIES)
def bm_truth_at(s, d):
    """BM3, BM4: the last change up to a day."""
    return memories(s, d).where("effective_from <= timestamp_ntz'2024-01-15'").groupBy("user_id", "event_type").agg(F.max(F.struct("effective_from", "memory_id"))["memory_id"].alias("memory_id"))


@query("bm_rolling_window", "SELECT conv_id, turn, least(n, 600 - before)::BIGINT AS kept FROM (SELECT conv_id, turn, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations) WHERE before < 600")
def bm_rolling_window(s, d):
    """BM5: the last 600 characters of each transcript; the oldest kept turn is cut."""
    before = F.coalesce(F.sum(F.length("text")).over(W.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return table(s, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"), before.alias("before")).where("before < 600").select("conv_id", "turn", F.least(F.col("n"), 600 - F.col("before")).cast("long").alias("kept"))


@query("bm_latest_mention", "SELECT conv_id, turn, CASE WHEN p = 0 AND q = 0 THEN 'none' WHEN p > q THEN 'the' ELSE 'of' END AS word FROM (SELECT conv_id, turn, CASE WHEN contains(text, 'the') THEN length(text) - instr(reverse(text), 'eht') - 1 ELSE 0 END AS p, CASE WHEN contains(text, 'of') THEN length(text) - instr(reverse(text), 'fo') ELSE 0 END AS q FROM conversations)")
def bm_latest_mention(s, d):
    """BM6: the word whose last place is greatest."""
    last = lambda w: F.when(F.contains("text", F.lit(w)), F.length("text") - F.instr(F.reverse("text"), w[::-1]) - len(w) + 2).otherwise(0)
    p, q = last("the"), last("of")
    return table(s, d, "conversations").select("conv_id", "turn", F.when((p == 0) & (q == 0), "none").when(p > q, "the").otherwise("of").alias("word"))


_PANE = "SELECT pane, event_type, count(*) AS n, round(sum(value), 4) AS v FROM ({0}) GROUP BY ALL"


@query("st_tumbling", _PANE.format("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS pane, * FROM events"))
def st_tumbling(s, d):
    """ST7 (extension): hourly panes; the batch twin of streaming.windows.panes."""
    from ..streaming.windows import panes

    return panes(table(s, d, "events"), "1 hour")


@query("st_sliding", _PANE.format("SELECT time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * k AS pane, * FROM events, (SELECT unnest(range(0, 4)) AS k)"))
def st_sliding(s, d):
    """ST8 (extension): an hour every quarter."""
    from ..streaming.windows import panes

    return panes(table(s, d, "events"), "1 hour", "15 minutes")


@query("st_session", "SELECT user_id, min(ts) AS started, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, sid")
def st_session(s, d):
    """ST9 (extension): sessions by a gap of two hours."""
    from ..streaming.windows import sessions

    return sessions(table(s, d, "events"), "2 hours")


@query("st_dedup_confirm", "SELECT user_id, event_type, min(event_id) AS first, count(*) - 1 AS confirmations FROM events GROUP BY ALL")
def st_dedup_confirm(s, d):
    """ST5: batch twin of the confirming sink."""
    return table(s, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"), (F.count("*") - 1).alias("confirmations"))


@query("tg_outline", None)
def tg_outline(s, d):
    """TG8, JO14: symbols of Python sources made from names of nations."""
    from ..sources.python_code import symbols

    code = table(s, d, "nation").select(F.col("n_nationkey").alias("path"), F.concat(F.lit("import os\n\ndef f_"), F.col("n_nationkey").cast("string"), F.lit("(a, b):\n    return os.path.join(a, b)\n\nclass C:\n    def m(self):\n        return f_"), F.col("n_nationkey").cast("string"), F.lit("(1, 2)\n")).alias("code"))
    return symbols(code)
