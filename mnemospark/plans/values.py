"""Queries of single values over varied rows: names, JSON, references, dates, labels, commands, health and filters of raw rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import names as NA
from ..functions import objects as OB
from ..functions import rules as R
from ..functions import text as T
from ..operators import filters as FI
from ..operators import recall as RC
from .recalls import prefix_sql
from .registry import query
from .tables import ARTIFACTS, MEMORIES, artifacts, memories, table

#: Labels with marks, digits next to letters, and mixed case.
_LABEL = "CASE event_id % 4 WHEN 0 THEN event_type || (event_id % 9) || '-' || upper(substr(event_type, 1, 2)) || ' x' WHEN 1 THEN '  Node#' || (event_id % 30) || '/' || event_type || '  ' WHEN 2 THEN 'The ' || upper(event_type) || ' (v' || (event_id % 5) || ')' ELSE 'me' END"


@query("sf_subject_norm", rf"SELECT event_id, trim(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '([A-Za-z])(\d)', '\1 \2', 'g'), '(\d)([A-Za-z])', '\1 \2', 'g'), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS subject, trim(lower(x)) IN ('i', 'me', 'my', 'myself', 'mine', 'the user', 'current user') AS self FROM (SELECT event_id, {_LABEL} AS x FROM events)")
def sf_subject_norm(s, d):
    """SF13, SF15: subject keys, and whether a label means the speaker."""
    e = table(s, d, "events").withColumn("x", F.expr(_LABEL))
    return e.select("event_id", NA.subject("x").alias("subject"), NA.is_self(F.col("x")).alias("self"))


_RAW = ["Engine", "Health!", "replica count", "Own  name", "VER", "settings.", "Tech", " path ", "free text", "assignee"]
_ASPECTS = "aspects(k, v) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in T.ASPECTS.items()) + ")"


@query("sf_aspect_norm", rf"SELECT event_id, coalesce(v, p) AS aspect FROM (SELECT event_id, replace(trim(regexp_replace(regexp_replace(lower(x), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ', '_') AS p FROM (SELECT event_id, ({_RAW})[(event_id % {len(_RAW)})::INT + 1] || CASE WHEN event_id % 7 = 0 THEN ' ' || event_type ELSE '' END AS x FROM events)) LEFT JOIN aspects ON k = p", _ASPECTS)
def sf_aspect_norm(s, d):
    """SF14: synonyms fold, others stay."""
    raw = F.element_at(F.array(*map(F.lit, _RAW)), (F.col("event_id") % len(_RAW) + 1).cast("int"))
    return table(s, d, "events").select("event_id", NA.aspect(F.concat(raw, F.when(F.col("event_id") % 7 == 0, F.concat(F.lit(" "), "event_type")).otherwise(""))).alias("aspect"))


#: JSON of five shapes, spaced out; the last two are no containers.
_SPACED = "case event_id % 5 when 0 then concat('{ \"kind\" : \"', event_type, '\",\\n \"id\": ', event_id, ' , \"tags\" : [ 1, \"a b\" ,{ } ] }') when 1 then concat('[ ', event_id, ', null , true,\\t\"', event_type, '\" ]') when 2 then concat('{\"z\":{ \"b\" :', user_id, ',\"a\": [ ] } }') when 3 then concat(' ', event_id) else concat('{ not json ', event_id) end"
_TIGHT = """CASE event_id % 5 WHEN 0 THEN '{"kind":"' || event_type || '","id":' || event_id || ',"tags":[1,"a b",{}]}' WHEN 1 THEN '[' || event_id || ',null,true,"' || event_type || '"]' WHEN 2 THEN '{"z":{"b":' || user_id || ',"a":[]}}' WHEN 3 THEN ' ' || event_id ELSE '{ not json ' || event_id END"""


@query("sf_json_compact", f"SELECT event_id, {_TIGHT} AS j FROM events")
def sf_json_compact(s, d):
    """SF9: white space between values goes, keys keep their order, what is no container stays."""
    return table(s, d, "events").select("event_id", OB.compact(F.expr(_SPACED)).alias("j"))


_LISTED = """listed AS (SELECT user_id, count(*) AS n, string_agg('"k' || event_id || '":"' || event_type || '"', ',' ORDER BY event_id) AS members, string_agg('{"id":' || event_id || ',"kind":"' || event_type || '"}', ',' ORDER BY event_id) AS entries, min(event_id) AS lowest, arg_min(event_type, event_id) AS its_type,
  string_agg('  k' || event_id || ': str', chr(10) ORDER BY event_id) FILTER (k <= 40) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) GROUP BY user_id),
shown AS (SELECT user_id, CASE WHEN is_object THEN '{' || members || '}' ELSE '[' || entries || ']' END AS tight, CASE WHEN is_object THEN '{' || members || '}' ELSE '[{"id":' || lowest || ',"kind":"' || its_type || '"}]' END AS sample,
  CASE WHEN is_object THEN 'JSON object, ' || n || ' keys:' || chr(10) || lines || CASE WHEN n > 40 THEN chr(10) || '  (+' || (n - 40) || ' more keys)' ELSE '' END ELSE 'JSON array, ' || n || ' elements' || chr(10) || '  element keys: id, kind' END AS listing FROM (SELECT *, n <= 4 OR user_id % 2 = 0 AS is_object FROM listed))"""


@query(
    "sf_json_digest",
    """SELECT user_id, CASE WHEN length(tight) <= 100 THEN tight ELSE listing END AS head, CASE WHEN length(tight) <= 700 THEN tight WHEN room <= 8 THEN noted WHEN length(sample) <= room THEN noted || chr(10) || 'sample: ' || sample
    ELSE noted || chr(10) || 'sample: ' || substr(sample, 1, room - 3) || '...' END AS digest FROM (SELECT *, 700 - length(noted) - 9 AS room FROM (SELECT *, listing || chr(10) || '[outline; fetch the reference for the whole]' AS noted FROM shown))""",
    _LISTED,
)
def sf_json_digest(s, d):
    """SF10: a user's events as one JSON text; those too long become their keys and types, or their number and first entry's keys, a note and a sample."""
    e = table(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("x"))
    pairs = F.array_join(F.transform("x", lambda v: F.concat(F.lit('"k'), v["event_id"], F.lit('": "'), v["event_type"], F.lit('"'))), ", ")
    rows = F.array_join(F.transform("x", lambda v: F.concat(F.lit('{"id": '), v["event_id"], F.lit(', "kind": "'), v["event_type"], F.lit('"}'))), ", ")
    small = F.size("x") <= 4
    text = F.when(small | (F.col("user_id") % 2 == 0), F.concat(F.lit("{"), pairs, F.lit("}"))).otherwise(F.concat(F.lit("["), rows, F.lit("]")))
    return e.select("user_id", text.alias("text")).select("user_id", F.split_part(OB.outline(F.col("text"), 100), F.lit("\n[outline"), F.lit(1)).alias("head"), OB.outline(F.col("text"), 700).alias("digest"))


def _hmac_sql(key: str, message: str) -> str:
    """SQL of HMAC-SHA256 as hex digits: two SHA-256 over the padded key."""
    pad = lambda x: bytes(k ^ x for k in key.encode().ljust(64, b"\0")).hex()
    return f"sha256(unhex('{pad(0x5C)}') || unhex(sha256(unhex('{pad(0x36)}') || encode({message}))))"


@query("sf_uri", f"SELECT artifact_id, path || '?exp=2000000000&sig=' || {_hmac_sql('key', chr(112) + 'ath || ' + repr('|2000000000'))} AS uri FROM (SELECT artifact_id, 'mem://' || namespace || '%20x/' || artifact_id AS path FROM artifacts)", ARTIFACTS)
def sf_uri(s, d):
    """SF26, SC17: references with encoded segments, an expiry and the HMAC of both."""
    return artifacts(s, d).select("artifact_id", OB.reference(F.concat("namespace", F.lit(" x")), F.col("artifact_id"), 2_000_000_000, "key").alias("uri"))


_VENDOR = "['use Gemma 2', 'LLAMA 3 on ', 'none', 'gpt-4 or claude', 'Claude, not GPT', 'o3 mini', 'Qwen', 'mistral 7b', 'openai o1', 'deepseek']"
_FAMILIES = "CASE " + " ".join(f"WHEN contains(x, '{p}') THEN '{v}'" for p, v in R.FAMILIES) + " END"


@query("sf_vendor", f"SELECT event_id, {_FAMILIES} AS family FROM (SELECT event_id, lower(({_VENDOR})[(event_id % 10)::INT + 1] || event_type) AS x FROM events)")
def sf_vendor(s, d):
    """SF31: the first name part that a text holds, in order, decides the family."""
    return table(s, d, "events").select("event_id", R.family(F.expr("element_at(array" + _VENDOR.replace("[", "(").replace("]", ")") + ", cast(event_id % 10 + 1 as int)) || event_type")).alias("family"))


_COMMANDS = ["cd /x/{} &&  make   test", "git  commit -m {}", "ls -la {}", "cd a; rm -rf {}", "  cat {}  | sort", "sed -i s/a/{}/ f", "pip install p{}", "echo {} > out"]
_MUTATES = r"(>>?|\bsed -i|\btee |\brm |\bmv |\bcp |\bmkdir|\btouch |\bgit (add|commit|checkout|reset|merge|rebase|stash|restore)|\b(pip|uv|npm|pnpm|yarn|cargo|maturin) )"  # fixed value
_CLASSES = (("log/output", ("output", "log")), ("source", ("py", "js", "ts", "tsx", "jsx", "go", "rs", "java", "rb", "c", "cpp", "cc", "h", "hpp", "sh", "sql", "vue", "svelte", "css", "html")), ("doc", ("md", "rst", "txt")), ("config", ("json", "yaml", "yml", "toml", "cfg", "ini", "env", "lock")), ("data", ("csv", "jsonl", "tsv", "parquet")), ("image", ("png", "jpg", "jpeg", "svg", "gif", "webp", "pdf")))  # fixed values
_EXTENSIONS = ["py", "md", "json", "csv", "PNG", "log", "weird", "ts", "output.1", "tsx", "HPP", "html", "outputs", "sql"]


@query(
    "sf_command",
    rf"SELECT event_id, n AS command, regexp_matches(n, '{_MUTATES}') AS mutates, CASE WHEN contains('.' || ext, '.output') THEN 'log/output' " + " ".join(f"WHEN ext IN ({', '.join(repr(x) for x in xs)}) THEN '{c}'" for c, xs in _CLASSES) + rf" ELSE 'other' END AS file_class FROM (SELECT event_id, trim(regexp_replace(regexp_replace(replace(({_COMMANDS})[(event_id % {len(_COMMANDS)})::INT + 1], '{{}}', event_id::VARCHAR), '^\s*cd\s+\S+\s*&&', ''), '\s+', ' ', 'g')) AS n, lower(({_EXTENSIONS})[(event_id // 8 % {len(_EXTENSIONS)})::INT + 1]) AS ext FROM events)",
)
def sf_command(s, d):
    """SF33: commands without their directory change, whether they change files, and the class of a file by its ending."""
    pick = lambda xs, by: F.element_at(F.array(*map(F.lit, xs)), (by % len(xs) + 1).cast("int"))
    command = F.replace(pick(_COMMANDS, F.col("event_id")), F.lit("{}"), F.col("event_id").cast("string"))
    norm = F.trim(F.regexp_replace(F.regexp_replace(command, r"^\s*cd\s+\S+\s*&&", ""), r"\s+", " "))
    path = F.concat(F.lit("src/f."), pick(_EXTENSIONS, F.floor(F.col("event_id") / 8)))
    ext = F.lower(F.element_at(F.split(path, r"\."), -1))
    # What a command wrote may be numbered or have a further ending.
    found = F.when(F.contains(F.lower(path), F.lit(".output")), "log/output")
    for name, endings in _CLASSES:
        found = found.when(ext.isin(*endings), name)
    return table(s, d, "events").select("event_id", norm.alias("command"), norm.rlike(_MUTATES).alias("mutates"), found.otherwise("other").alias("file_class"))


@query("sf_flatten", r"SELECT artifact_id, sha256(trim(regexp_replace(content, '\s+', ' ', 'g'))) AS h, left(regexp_replace(regexp_replace(chr(27) || '[1;31m' || content || chr(27) || '[0m', '\x1b\[[0-9;?]*[A-Za-z]', '', 'g'), '[\x00-\x1f\x7f]', '', 'g'), 256) AS label, CASE WHEN length(content) <= 120 THEN content WHEN instr(reverse(left(content, 120)), ' ') = 0 OR instr(reverse(left(content, 120)), ' ') = 120 THEN rtrim(left(content, 120)) ELSE rtrim(left(content, 120 - instr(reverse(left(content, 120)), ' '))) END AS capped FROM artifacts", ARTIFACTS)
def sf_flatten(s, d):
    """SF34, SF36, SF38: one line; a label without colours and control characters; a text cut at a word's end."""
    colored = F.concat(F.lit("\x1b[1;31m"), "content", F.lit("\x1b[0m"))
    return artifacts(s, d).select("artifact_id", F.sha2(F.trim(F.regexp_replace("content", r"\s+", " ")), 256).alias("h"), T.clean_label(colored).alias("label"), T.capped(F.col("content"), 120).alias("capped"))


_DATES = r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b|\b(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\b|\b\d{4}\b|\b\d{1,2}(?:st|nd|rd|th)\b|\b(?:yesterday|today|tomorrow|last|next|ago|week|weekend|month|year)\b"


@query("sf_density", rf"SELECT artifact_id, (4 * len(regexp_extract_all(content, '{_DATES}')) + 2 * len(regexp_extract_all(content, '\b\d+\b')) + len(regexp_extract_all(regexp_replace(content, '(^|[.!?]\s+)[A-Z][a-z]+', '', 'g'), '\b[A-Z][a-z]+')))::BIGINT AS score FROM (SELECT artifact_id, regexp_replace(content, '[^\x00-\x7F]', '_', 'g') AS content FROM artifacts)", ARTIFACTS)
def sf_density(s, d):
    """SF35: how many answers a text may hold: dates count four times, numbers twice, capitalised words that begin no sentence once."""
    n = lambda text, p: F.size(F.regexp_extract_all(text, F.lit(p), 0))
    inner = F.regexp_replace("content", r"(^|[.!?]\s+)[A-Z][a-z]+", "")
    return artifacts(s, d).select("artifact_id", (4 * n("content", _DATES) + 2 * n("content", r"\b\d+\b") + n(inner, r"\b[A-Z][a-z]+")).cast("long").alias("score"))


@query("sf_date_lift", r"SELECT event_id, nullif(regexp_extract(x, '\[date: (\d{4}(?:-\d{2}-\d{2})?)\]', 1), '') AS fact_date FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'seen [date: ' || strftime(ts, '%Y-%m-%d') || '] by ' || event_type WHEN 1 THEN '[date: ' || strftime(ts, '%Y') || ']' ELSE 'on ' || strftime(ts, '%Y-%m-%d') END AS x FROM events)")
def sf_date_lift(s, d):
    """SF20: a date that a text states in brackets, as a field."""
    text = F.expr("case event_id % 3 when 0 then concat('seen [date: ', date_format(ts, 'yyyy-MM-dd'), '] by ', event_type) when 1 then concat('[date: ', date_format(ts, 'yyyy'), ']') else concat('on ', date_format(ts, 'yyyy-MM-dd')) end")
    return table(s, d, "events").select("event_id", F.nullif(F.regexp_extract(text, r"\[date: (\d{4}(?:-\d{2}-\d{2})?)\]", 1), F.lit("")).alias("fact_date"))


_STATUSES, _KINDS = ["blocked", "failed", "active", "pending", "done", "superseded", "abandoned", "unknown"], ["task", "blocker", "decision"]


@query("sf_node_rank", f"SELECT event_id, CASE WHEN st IN ('done', 'superseded', 'abandoned') THEN 9 WHEN k IN ('blocker', 'decision') OR st IN ('blocked', 'failed') THEN 0 WHEN st = 'active' THEN 1 WHEN st = 'pending' THEN 2 ELSE 5 END AS rank FROM (SELECT event_id, ({_STATUSES})[(event_id % 8)::INT + 1] AS st, ({_KINDS})[(user_id % 3)::INT + 1] AS k FROM events)")
def sf_node_rank(s, d):
    """SF32: how urgent a node is."""
    pick = lambda xs, by: F.element_at(F.array(*map(F.lit, xs)), (by % len(xs) + 1).cast("int"))
    return table(s, d, "events").select("event_id", RC.urgency(pick(_STATUSES, F.col("event_id")), pick(_KINDS, F.col("user_id"))).alias("rank"))


@query("sf_prefix_summary", f"SELECT artifact_id, {prefix_sql('content', 400)} AS summary FROM artifacts", ARTIFACTS)
def sf_prefix_summary(s, d):
    """SF8, SF12, IN1."""
    return artifacts(s, d).select("artifact_id", T.prefix_summary("content", 400).alias("summary"))


@query("sc_token_savings", f"SELECT artifact_id, greatest(0, token_estimate - greatest(1, octet_length(encode({prefix_sql('content', 160)})) // 4) - greatest(1, octet_length(encode(reference)) // 4))::BIGINT AS saved, round(greatest(0, token_estimate - greatest(1, octet_length(encode({prefix_sql('content', 160)})) // 4) - greatest(1, octet_length(encode(reference)) // 4)) / token_estimate::DOUBLE, 6) AS share FROM artifacts", ARTIFACTS)
def sc_token_savings(s, d):
    """SC6: tokens that a summary of 160 characters and a reference save, and their share."""
    a = artifacts(s, d).withColumn("kept", T.token_estimate(T.prefix_summary("content", 160)) + T.token_estimate("reference"))
    saved = F.greatest(F.lit(0), F.col("token_estimate") - F.col("kept")).cast("long")
    return a.select("artifact_id", saved.alias("saved"), F.round(saved / F.col("token_estimate"), 6).alias("share"))


@query("fi_row_shim", "SELECT event_id FROM (SELECT event_id, coalesce(try_strptime(x, '%Y-%m-%dT%H:%M:%S'), TIMESTAMP '0001-01-01') AS created_at, props->>'$.k' AS k FROM (SELECT event_id, props, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'soon' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS x FROM events)) WHERE created_at <= TIMESTAMP '2024-01-10' AND k >= '4'")
def fi_row_shim(s, d):
    """FI2, FI3: texts of times and JSON metadata become typed before the filters; a time that can't be read is before all others, Z is UTC."""
    raw = F.expr("case event_id % 4 when 0 then null when 1 then 'soon' else concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), if(event_id % 4 = 2, 'Z', '')) end")
    rows = table(s, d, "events").select("event_id", raw.alias("created_at"), "props")
    return FI.typed_rows(rows, "created_at", "props").where(FI.compiled({"created_before": FI.instant("2024-01-10T00:00:00Z"), "metadata.k__gte": "4"})).select("event_id")


@query(
    "hl_health",
    """SELECT s_suppkey, CASE WHEN off THEN 'disabled' WHEN missing IS NOT NULL THEN 'missing_dependency' WHEN blocked IS NOT NULL THEN 'policy_blocked' WHEN stale THEN 'stale_index' WHEN lost <> '' THEN 'degraded' ELSE 'healthy' END AS status,
    CASE WHEN off THEN 'adapter disabled by config' WHEN missing IS NOT NULL THEN 'missing optional dependency: ' || missing WHEN blocked IS NOT NULL THEN blocked WHEN stale THEN 'index is stale; re-index required' WHEN lost <> '' THEN 'unavailable: ' || lost END AS reason
    FROM (SELECT s_suppkey, s_acctbal < -500 AS off, CASE WHEN s_nationkey % 6 = 0 THEN s_name END AS missing, CASE WHEN s_acctbal > 8500 THEN 'blocked for ' || s_nationkey END AS blocked, s_suppkey % 4 = 0 AS stale,
    concat_ws(', ', CASE WHEN s_suppkey % 3 = 0 THEN 'exact_store' END, CASE WHEN s_suppkey % 5 = 0 THEN 'memory_store' END, CASE WHEN s_nationkey % 4 = 1 THEN 'recall' END) AS lost FROM supplier)""",
)
def hl_health(s, d):
    """HL1: the first condition that holds, with its reason."""
    x = table(s, d, "supplier")
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    ladder = FI.health(
        F.col("s_acctbal") < -500, F.when(nation % 6 == 0, F.col("s_name")), F.when(F.col("s_acctbal") > 8500, F.concat(F.lit("blocked for "), nation)), key % 4 == 0,
        {"exact_store": key % 3 != 0, "memory_store": key % 5 != 0, "recall": nation % 4 != 1},
    )
    return x.select("s_suppkey", ladder.alias("h")).select("s_suppkey", "h.status", "h.reason")


_WORDS = ["Dropped plan", "shipped it", "still open", "we cancelled", "Deployed and done", "merging soon", "completely new", "retraction due"]
_STATE = "CASE WHEN regexp_matches(x, '" + R.STATES[0][1] + "') THEN 'abandoned' WHEN regexp_matches(x, '" + R.STATES[1][1] + "') THEN 'done' ELSE 'in_progress' END"


@query("di_state", f"SELECT user_id, {_STATE} AS state, memory_id FROM (SELECT user_id, memory_id, lower(({_WORDS})[(memory_id % 8)::INT + 1] || ' ' || text) AS x, row_number() OVER (PARTITION BY user_id ORDER BY memory_id DESC) AS n FROM memories) WHERE n = 1", MEMORIES)
def di_state(s, d):
    """DI3, AG6: the state that each user's newest memory tells."""
    said = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("memory_id") % 8 + 1).cast("int")), "text")
    newest = memories(s, d).groupBy("user_id").agg(F.max(F.struct("memory_id", said.alias("said"))).alias("x"))
    return newest.select("user_id", R.state(F.col("x.said")).alias("state"), "x.memory_id")


@query("sf_state", f"SELECT memory_id, {_STATE} AS state FROM (SELECT memory_id, lower(({_WORDS})[(memory_id % 8)::INT + 1] || ' ' || text) AS x FROM memories)", MEMORIES)
def sf_state(s, d):
    """SF30: the first stem that a text holds decides."""
    said = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("memory_id") % 8 + 1).cast("int")), "text")
    return memories(s, d).select("memory_id", R.state(said).alias("state"))


_DONT = "['never use gpt-4', 'never use Gemma', 'never use rm', 'never use claude']"
_DO = "['use o3 instead', 'use LLAMA instead', 'use trash instead', 'use gemini instead', '']"


@query("di_rules", f"SELECT memory_id, dont || ' ' || memory_id AS dont, nullif(CASE WHEN {_FAMILIES.replace('x,', 'lower(dont),')} <> {_FAMILIES.replace('x,', 'lower(do_),')} THEN '' ELSE do_ END, '') AS do_instead FROM (SELECT memory_id, ({_DONT})[(memory_id % 4)::INT + 1] AS dont, ({_DO})[(memory_id // 4 % 5)::INT + 1] AS do_ FROM memories WHERE status = 'active' AND kind = 'pitfall')", MEMORIES)
def di_rules(s, d):
    """DI2, SF31: pitfalls with their alternative, which is left out if the two are of different families."""
    pick = lambda xs, by: F.expr(f"element_at(array{xs.replace('[', '(').replace(']', ')')}, cast({by} as int))")
    m = memories(s, d).where("status = 'active' and kind = 'pitfall'").select("memory_id", pick(_DONT, "memory_id % 4 + 1").alias("dont"), pick(_DO, "floor(memory_id / 4) % 5 + 1").alias("do"))
    apart = F.coalesce(R.family(F.col("dont")) != R.family(F.col("do")), F.lit(False))
    return m.select("memory_id", F.concat_ws(" ", "dont", F.col("memory_id").cast("string")).alias("dont"), F.when(~apart & (F.col("do") != ""), F.col("do")).alias("do_instead"))


#: Subjects are nations by the first letter of their region and their name; two aliases; labels of events name nations, regions' letters, or nothing known.
_REGISTRY = """subjects AS (SELECT 'entity:' || lower(n_name) AS subject_id, lower(n_name) AS key FROM nation UNION ALL SELECT 'entity:' || lower(n_name) || '-' || n_regionkey, lower(left(n_name, 1)) FROM nation),
labels AS (SELECT event_id, user_id, CASE event_id % 6 WHEN 0 THEN 'Me' WHEN 1 THEN n_name WHEN 2 THEN 'The  Shop' WHEN 3 THEN left(n_name, 1) WHEN 4 THEN 'new ' || (event_id % 40) ELSE 'odd one' END AS label, CASE event_id % 6 WHEN 5 THEN 'entity:' || lower(n_name) WHEN 4 THEN 'entity:nowhere' END AS proposed FROM events JOIN nation ON n_nationkey = event_id % 25),
keyed AS (SELECT *, trim(lower(regexp_replace(regexp_replace(label, '([a-z])(\\d)', '\\1 \\2', 'g'), '\\s+', ' ', 'g'))) AS key FROM labels)"""


@query(
    "ex_resolve_subject",
    "SELECT event_id, CASE WHEN key = 'me' THEN 'user:' || user_id WHEN key = 'the shop' THEN 'entity:store' WHEN proposed IN (SELECT subject_id FROM subjects) THEN proposed WHEN n = 1 THEN only_one WHEN n > 1 THEN NULL ELSE 'entity:' || key END AS subject_id FROM keyed LEFT JOIN (SELECT key, count(*) AS n, min(subject_id) AS only_one FROM subjects GROUP BY key) USING (key)",
    _REGISTRY,
)
def ex_resolve_subject(s, d):
    """EX6, EX7: the speaker, an alias, a proposal that exists, the only exact match, else a new subject; none if several match."""
    n = table(s, d, "nation")
    known = n.select(F.concat(F.lit("entity:"), F.lower("n_name")).alias("subject_id"), F.lower("n_name").alias("key")).unionByName(n.select(F.concat(F.lit("entity:"), F.lower("n_name"), F.lit("-"), "n_regionkey").alias("subject_id"), F.lower(F.left("n_name", F.lit(1))).alias("key")))
    by_key = known.groupBy("key").agg(F.array_sort(F.collect_set("subject_id")).alias("matches"))
    aliases = s.createDataFrame([("the shop", "entity:store")], "key string, alias string")
    e = table(s, d, "events").join(n.select("n_nationkey", "n_name"), F.col("event_id") % 25 == F.col("n_nationkey"))
    label = F.expr("case event_id % 6 when 0 then 'Me' when 1 then n_name when 2 then 'The  Shop' when 3 then left(n_name, 1) when 4 then concat('new ', event_id % 40) else 'odd one' end")
    proposed = F.expr("case event_id % 6 when 5 then concat('entity:', lower(n_name)) when 4 then 'entity:nowhere' end")
    e = e.select("event_id", F.col("user_id").cast("string").alias("user"), label.alias("label"), proposed.alias("proposed")).withColumn("key", NA.subject("label"))
    e = e.join(by_key, "key", "left").join(F.broadcast(aliases), "key", "left")  # one alias
    e = e.join(known.select(F.col("subject_id").alias("proposed"), F.lit(True).alias("known")).distinct(), "proposed", "left")
    return e.select("event_id", NA.resolved(F.col("label"), F.lit("entity"), F.col("user"), F.col("alias"), F.col("proposed"), F.coalesce("known", F.lit(False)), F.coalesce("matches", F.array().cast("array<string>"))).alias("subject_id"))


@query("ag_reuse_audit", "SELECT user_id, count(*) AS reads, count(*) FILTER (seen) AS reused, sum(CASE WHEN seen THEN tokens ELSE 0 END)::BIGINT AS reused_tokens, count(*) FILTER (other AND NOT seen) AS across FROM (SELECT e.*, coalesce(lag(sha) OVER (PARTITION BY user_id, path ORDER BY event_id) = sha, false) AS seen, coalesce(lag(sha) OVER (PARTITION BY path ORDER BY event_id) = sha, false) AS other FROM (SELECT event_id, user_id, event_type || (event_id % 11) AS path, sha1((event_id // 3000)::VARCHAR || event_type) AS sha, (value * 10)::INT AS tokens FROM events) e) GROUP BY user_id")
def ag_reuse_audit(s, d):
    """AG13: reads that repeat what the same agent, or another, has last seen of a path, with their tokens."""
    e = table(s, d, "events").select("event_id", "user_id", F.concat("event_type", (F.col("event_id") % 11).cast("string")).alias("path"), F.sha1(F.concat(F.floor(F.col("event_id") / 3000).cast("string"), "event_type")).alias("sha"), F.rint(F.col("value") * 10).cast("int").alias("tokens"))
    last = lambda *by: F.coalesce(F.lag("sha").over(W.partitionBy(*by).orderBy("event_id")) == F.col("sha"), F.lit(False))
    e = e.select("user_id", "tokens", last("user_id", "path").alias("seen"), last("path").alias("other"))
    return e.groupBy("user_id").agg(F.count("*").alias("reads"), F.count(F.when(F.col("seen"), 1)).alias("reused"), F.sum(F.when(F.col("seen"), F.col("tokens")).otherwise(0)).alias("reused_tokens"), F.count(F.when(F.col("other") & ~F.col("seen"), 1)).alias("across"))


@query("bm_role_alias", "SELECT role, count(*) AS events, count(DISTINCT value) AS names FROM (SELECT CASE WHEN event_type IN ('click', 'view', 'error') THEN 'role:' || event_type ELSE 'value:' || event_type || user_id % 3 END AS role, event_type || user_id % 3 AS value FROM events) GROUP BY role")
def bm_role_alias(s, d):
    """BM4: every value of an entity named by its value maps to one role; entities that exist side by side keep their own."""
    e = table(s, d, "events").select("event_type", F.concat("event_type", F.col("user_id") % 3).alias("value"))
    roles = e.where("event_type in ('click', 'view', 'error')").select("value", F.concat(F.lit("role:"), "event_type").alias("role")).distinct()
    return e.join(roles, "value", "left").select(F.coalesce("role", F.concat(F.lit("value:"), "value")).alias("role"), "value").groupBy("role").agg(F.count("*").alias("events"), F.countDistinct("value").alias("names"))
