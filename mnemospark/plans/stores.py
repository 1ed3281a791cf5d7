"""Queries over stored artifacts: derivation, versions, pages, expiry, purge, bundles, filters and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pii as PI
from ..functions import rules as R
from ..functions import text as T
from ..functions.temporal import WEEKDAYS
from ..operators import filters as FI
from .registry import query
from .tables import ARTIFACTS, BUCKET, CHUNKS, MEMORIES, artifacts, chunks, memories, table


@query("sc_fetch", "SELECT artifact_id, byte_size FROM artifacts WHERE namespace = 'src1' AND reference = 'mem://src1/' || artifact_id", ARTIFACTS)
def sc_fetch(s, d):
    """SC1: by reference, with its namespace pruned first."""
    return artifacts(s, d).where((F.col("namespace") == "src1") & (F.col("reference") == F.concat(F.lit("mem://src1/"), "artifact_id"))).select("artifact_id", "byte_size")


@query("sc_list_page", "SELECT artifact_id, created_at FROM artifacts WHERE namespace = 'src2' AND created_at > TIMESTAMP '2024-01-02' ORDER BY created_at, doc_id LIMIT 20", ARTIFACTS)
def sc_list_page(s, d):
    """SC2: a page after a key, oldest first."""
    return artifacts(s, d).where("namespace = 'src2' and created_at > timestamp_ntz'2024-01-02'").orderBy("created_at", "doc_id").limit(20).select("artifact_id", "created_at")


@query(
    "sc_latest_version",
    "SELECT artifact_id, version, content_len FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY version DESC) n FROM (SELECT artifact_id, 1 AS version, length(content)::BIGINT AS content_len FROM artifacts UNION ALL SELECT artifact_id, 2, length(content)::BIGINT + 1 FROM artifacts WHERE doc_id % 5 = 0)) WHERE n = 1",
    ARTIFACTS,
)
def sc_latest_version(s, d):
    """SC3, SC4: versions are appended; reads take the latest by one aggregation."""
    a = artifacts(s, d).select("artifact_id", "doc_id", F.length("content").cast("long").alias("content_len"))
    versions = a.select("artifact_id", F.lit(1).alias("version"), "content_len").unionByName(a.where("doc_id % 5 = 0").select("artifact_id", F.lit(2).alias("version"), (F.col("content_len") + 1).alias("content_len")))
    return versions.groupBy("artifact_id").agg(F.max(F.struct("version", "content_len")).alias("v")).select("artifact_id", "v.version", "v.content_len")


@query("sc_derive_artifacts", "SELECT artifact_id, reference, sha256(content) AS digest, byte_size, token_estimate, expires_at FROM artifacts", ARTIFACTS)
def sc_derive_artifacts(s, d):
    """SC5: derived columns of stored content."""
    return artifacts(s, d).select("artifact_id", "reference", F.sha2("content", 256).alias("digest"), "byte_size", "token_estimate", "expires_at")


@query("sc_delete", "SELECT artifact_id FROM artifacts WHERE doc_id % 11 <> 0 AND namespace <> 'src3'", ARTIFACTS)
def sc_delete(s, d):
    """SC7, SC8: tombstones of single artifacts and of a namespace, by anti join."""
    a = artifacts(s, d)
    stones = a.where("doc_id % 11 = 0").select("artifact_id")
    return a.where("namespace <> 'src3'").join(stones, "artifact_id", "left_anti").select("artifact_id")


@query("sc_ttl_expired", "SELECT namespace, count(*) AS n, sum(byte_size)::BIGINT AS bytes FROM artifacts WHERE expires_at <= TIMESTAMP '2024-02-10' GROUP BY namespace", ARTIFACTS)
def sc_ttl_expired(s, d):
    """SC9: expired at a time, inclusive."""
    return artifacts(s, d).where("expires_at <= timestamp_ntz'2024-02-10'").groupBy("namespace").agg(F.count("*").alias("n"), F.sum("byte_size").alias("bytes"))


@query(
    "sc_cleanup",
    "SELECT (SELECT count(*) FROM artifacts WHERE expires_at <= TIMESTAMP '2024-02-10') AS artifacts, (SELECT count(*) FROM memories WHERE status = 'superseded' AND effective_until < TIMESTAMP '2024-01-15') AS memories",
    ARTIFACTS, MEMORIES,
)
def sc_cleanup(s, d):
    """SC10: expired artifacts and superseded memories before a horizon."""
    a = artifacts(s, d).where("expires_at <= timestamp_ntz'2024-02-10'").agg(F.count("*").alias("artifacts"))
    m = memories(s, d).where("status = 'superseded' and effective_until < timestamp_ntz'2024-01-15'").agg(F.count("*").alias("memories"))
    return a.crossJoin(m)  # one row each


@query(
    "sc_purge_report",
    "SELECT 'artifacts' AS part, namespace, count(*) AS n FROM artifacts GROUP BY 2 UNION ALL SELECT 'memories', namespace, count(*) FROM memories GROUP BY 2 UNION ALL SELECT 'chunks', namespace, count(DISTINCT artifact_id) FROM chunks GROUP BY 2",
    ARTIFACTS, MEMORIES, CHUNKS,
)
def sc_purge_report(s, d):
    """SC11, AG16: what a purge of each namespace would remove."""
    count = lambda df, part, what: df.groupBy("namespace").agg(what.alias("n")).select(F.lit(part).alias("part"), "namespace", "n")
    return count(artifacts(s, d), "artifacts", F.count("*")).unionByName(count(memories(s, d), "memories", F.count("*"))).unionByName(count(chunks(s, d), "chunks", F.countDistinct("artifact_id")))


@query("sc_session_ingest", "SELECT conv_id, string_agg('[' || upper(role) || '] ' || text, chr(10) ORDER BY turn) AS body, count(*) AS turns FROM conversations GROUP BY conv_id")
def sc_session_ingest(s, d):
    """SC15, TG9, TG10: a session's turns as one artifact."""
    line = F.concat(F.lit("["), F.upper("role"), F.lit("] "), "text")
    return table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"), F.count("*").alias("turns"))


@query("fi_metadata_eq", "SELECT artifact_id FROM artifacts WHERE lang = 'fr' AND session_id = '3'", ARTIFACTS)
def fi_metadata_eq(s, d):
    """FI1: equality."""
    return _with_metadata(s, d).where(FI.compiled({"metadata.lang": "fr", "session_id": "3"})).select("artifact_id")


@query("fi_metadata_in", "SELECT artifact_id FROM artifacts WHERE lang IN ('de', 'es')", ARTIFACTS)
def fi_metadata_in(s, d):
    """FI1: one of several."""
    return _with_metadata(s, d).where(FI.compiled({"metadata.lang__in": ["de", "es"], "metadata.other": None})).select("artifact_id")


@query("fi_metadata_range", "SELECT artifact_id FROM artifacts WHERE strftime(created_at, '%Y-%m-%d') BETWEEN '2024-01-03' AND '2024-01-09'", ARTIFACTS)
def fi_metadata_range(s, d):
    """FI1: a range of a date kept as metadata."""
    return _with_metadata(s, d).where(FI.compiled({"metadata.day__gte": "2024-01-03", "metadata.day__lte": "2024-01-09"})).select("artifact_id")


def _with_metadata(s, d):
    return artifacts(s, d).withColumn("metadata", F.create_map(F.lit("lang"), "lang", F.lit("day"), F.date_format("created_at", "yyyy-MM-dd")))


@query("fi_created_window", "SELECT artifact_id FROM artifacts WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at <= TIMESTAMP '2024-01-06'", ARTIFACTS)
def fi_created_window(s, d):
    """FI1, FI3, FI18: inclusive bounds."""
    import datetime as dt

    return artifacts(s, d).where(FI.compiled({"created_after": dt.datetime(2024, 1, 5), "created_before": dt.datetime(2024, 1, 6)}, "session_id")).select("artifact_id")


@query("fi_scope_wildcard", "SELECT memory_id FROM memories WHERE namespace = 'ns1' AND session_id = '2'", MEMORIES)
def fi_scope_wildcard(s, d):
    """FI4: nulls of the scope match anything."""
    return memories(s, d).where(FI.in_scope({"namespace": "ns1", "session_id": "2", "user_id": None})).select("memory_id")


@query(
    "fi_scope_nullsafe",
    "SELECT text, user_id, namespace, session_id, count(*) AS n FROM (SELECT text, user_id, namespace, CASE WHEN session_id = '0' THEN NULL ELSE session_id END AS session_id FROM memories) GROUP BY ALL HAVING count(*) > 1",
    MEMORIES,
)
def fi_scope_nullsafe(s, d):
    """FI5, JO12: twins in one scope, nulls equal."""
    m = memories(s, d).withColumn("session_id", F.when(F.col("session_id") != "0", F.col("session_id")))
    return m.groupBy("text", "user_id", "namespace", "session_id").agg(F.count("*").alias("n")).where("n > 1")


_VALID = "effective_from <= {t} AND (effective_until IS NULL OR effective_until > {t})"


@query("fi_valid_at", "SELECT memory_id FROM memories WHERE status <> 'superseded' AND " + _VALID.format(t="TIMESTAMP '2024-01-20'"), MEMORIES)
def fi_valid_at(s, d):
    """FI6, FI7."""
    return memories(s, d).where(FI.visible_at("2024-01-20 00:00:00")).select("memory_id")


@query("fi_list_as_of", "SELECT memory_id, effective_from FROM memories WHERE " + _VALID.format(t="TIMESTAMP '2024-01-12'") + " ORDER BY effective_from DESC, memory_id LIMIT 50", MEMORIES)
def fi_list_as_of(s, d):
    """FI8: as of a time, whatever the status is now."""
    return memories(s, d).where(FI.visible_at("2024-01-12 00:00:00", True)).orderBy(F.desc("effective_from"), "memory_id").limit(50).select("memory_id", "effective_from")


@query("fi_by_source_ref", "SELECT memory_id FROM memories WHERE memory_id % 20 = 4 OR user_id = 4", MEMORIES)
def fi_by_source_ref(s, d):
    """FI9, FI15: membership in an array of references."""
    refs = F.array(F.concat(F.lit("mem://s/"), F.col("memory_id") % 20), F.concat(F.lit("mem://u/"), "user_id"))
    m = memories(s, d).withColumn("source_refs", refs).where(FI.evidence_ok("source_refs"))
    return m.where(F.array_contains("source_refs", "mem://s/4") | F.array_contains("source_refs", "mem://u/4")).select("memory_id")


@query("fi_precedent", "SELECT memory_id FROM memories WHERE status = 'active' AND kind = 'decision' AND namespace = 'ns2'", MEMORIES)
def fi_precedent(s, d):
    """FI10, FI11: active rows whose metadata hold a map."""
    m = memories(s, d).withColumn("metadata", F.create_map(F.lit("ns"), "namespace", F.lit("type"), "event_type"))
    want = {"ns": "ns2", "type": "purchase"}
    ok = F.lit(True)
    for k, v in want.items():
        ok = ok & F.col("metadata")[k].eqNullSafe(F.lit(v))
    return m.where((F.col("status") == "active") & (F.col("kind") == "decision") & ok).select("memory_id")


@query("fi_ledger_schema", "SELECT kind, count(*) AS n FROM memories WHERE kind <> 'decision' OR trim(text) <> '' AND value IS NOT NULL GROUP BY kind", MEMORIES)
def fi_ledger_schema(s, d):
    """FI16: required fields by kind."""
    need = F.when(F.col("kind") == "decision", (F.trim("text") != "") & F.col("value").isNotNull()).otherwise(True)
    return memories(s, d).where(need).groupBy("kind").agg(F.count("*").alias("n"))


@query("fi_intercept_threshold", "SELECT artifact_id FROM artifacts WHERE length(content) >= 8000 OR octet_length(encode(content)) // 4 >= 2000", ARTIFACTS)
def fi_intercept_threshold(s, d):
    """FI17."""
    return artifacts(s, d).where(FI.must_intercept("content")).select("artifact_id")


_PII = "len(regexp_extract_all({x}, '{p}'))::BIGINT AS {k}"
_BODIES = "bodies AS (SELECT 'd' || doc_id AS id, content AS x FROM artifacts UNION ALL SELECT 'm' || memory_id, text FROM memories)"


@query("sf_pii_counts", "SELECT id, " + ", ".join(_PII.format(x="x", p=p, k=k.lower()) for k, p in T.SENSITIVE) + " FROM bodies", ARTIFACTS, MEMORIES, _BODIES)
def sf_pii_counts(s, d):
    """SF2, SF3, AG8: sensitive matches by type."""
    return _bodies(s, d).select("id", *[c.alias(k.lower()) for k, c in T.sensitive_counts("x").items()])


def _bodies(s, d):
    return artifacts(s, d).select(F.concat(F.lit("d"), "artifact_id").alias("id"), F.col("content").alias("x")).unionByName(memories(s, d).select(F.concat(F.lit("m"), "memory_id").alias("id"), F.col("text").alias("x")))


_SCRUB = "x"
for _k, _p in T.SENSITIVE:
    _SCRUB = f"regexp_replace({_SCRUB}, '{_p}', '[{_k}]', 'g')"


@query("sf_pii_scrub", f"SELECT id, sha256({_SCRUB}) AS h FROM bodies", ARTIFACTS, MEMORIES, _BODIES)
def sf_pii_scrub(s, d):
    """SF1: scrubbed texts, by digest."""
    return _bodies(s, d).select("id", F.sha2(T.scrubbed("x"), 256).alias("h"))


def _numbered() -> tuple[str, ...]:
    """SQL: spans(id, a, z, kind, number) as accepted, type after type, and scrubbed(id, y): each type's matches are found between the pieces that split by it leaves."""
    out = []
    for i, (kind, p) in enumerate(T.SENSITIVE):
        earlier = " UNION ALL ".join(f"SELECT * FROM taken{j}" for j in range(i))
        free = f" WHERE NOT EXISTS (SELECT 1 FROM ({earlier}) t WHERE t.id = f.id AND t.a < f.z AND f.a < t.z)" if i else ""
        out.append(f"""found{i} AS (SELECT id, sum(length(gap)) OVER w + coalesce(sum(length(hit)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, length(hit) AS n
  FROM (SELECT id, unnest(string_split_regex(x, '{p}')[1 : len(regexp_extract_all(x, '{p}'))]) AS gap, unnest(regexp_extract_all(x, '{p}')) AS hit, unnest(range(0, len(regexp_extract_all(x, '{p}')))) AS k FROM bodies) WINDOW w AS (PARTITION BY id ORDER BY k)),
taken{i} AS (SELECT id, a, z, '{kind}' AS kind, row_number() OVER (PARTITION BY id ORDER BY a) AS number FROM (SELECT id, a, a + n AS z FROM found{i}) f{free})""")
    every = " UNION ALL ".join(f"SELECT * FROM taken{j}" for j in range(len(T.SENSITIVE)))
    out.append(f"spans AS ({every})")
    out.append("""scrubbed AS (SELECT b.id, coalesce(string_agg(substr(b.x, (before + 1)::BIGINT, (a - before)::BIGINT) || '[' || kind || '_' || number || ']', '' ORDER BY a), '') || substr(any_value(b.x), (coalesce(max(z), 0) + 1)::BIGINT) AS y,
  coalesce(string_agg(DISTINCT kind, ',' ORDER BY kind), '') AS types, count(kind) AS n FROM bodies b LEFT JOIN (SELECT *, coalesce(lag(z) OVER (PARTITION BY id ORDER BY a), 0) AS before FROM spans) s USING (id) GROUP BY b.id)""")
    return tuple(out)


SCRUBBED = _numbered()


@query("sf_pii_numbered", "SELECT id, sha256(y) AS h, types, n FROM scrubbed", ARTIFACTS, MEMORIES, _BODIES, *SCRUBBED)
def sf_pii_numbered(s, d):
    """SF1, SF2, AG8: numbered tokens, later types only where earlier ones left room, with the types found."""
    x = _bodies(s, d).select("id", PI.scrub(F.col("x")).alias("s"))
    return x.select("id", F.sha2("s.text", 256).alias("h"), F.array_join("s.types", ",").alias("types"), "s.n")


@query("sf_tokens", "SELECT t AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(content), '[a-z0-9_]+')) AS t FROM artifacts) GROUP BY t", ARTIFACTS)
def sf_tokens(s, d):
    """SF4, SF5."""
    return artifacts(s, d).select(F.explode(T.tokens("content")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


_SENT = r"list_filter(string_split(regexp_replace(trim(content, ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


@query("sf_sentences", f"SELECT artifact_id, len({_SENT})::INT AS n, {_SENT}[1] AS first FROM artifacts", ARTIFACTS)
def sf_sentences(s, d):
    """SF7."""
    return artifacts(s, d).select("artifact_id", F.size(T.sentences("content")).alias("n"), F.get(T.sentences("content"), F.lit(0)).alias("first"))


@query(
    "sf_content_type",
    """SELECT artifact_id, CASE WHEN (ltrim(b) LIKE '{%' OR ltrim(b) LIKE '[%') AND json_valid(b) THEN 'json' WHEN contains(b, chr(10) || '+++') OR contains(b, chr(10) || '---') OR ltrim(b) LIKE 'diff --git%' THEN 'code_diff'
    WHEN contains(b, 'Traceback ') OR contains(b, ' ERROR ') OR ltrim(b) LIKE '[ERROR]%' THEN 'log' WHEN ltrim(b) LIKE '<!DOCTYPE html%' OR ltrim(b) LIKE '<html%' THEN 'html' ELSE 'text' END AS kind FROM
    (SELECT artifact_id, CASE doc_id % 5 WHEN 0 THEN '{"a":' || doc_id || '}' WHEN 1 THEN 'diff --git a' WHEN 2 THEN '<html>' WHEN 3 THEN 'x ERROR y' ELSE content END AS b FROM artifacts)""",
    ARTIFACTS,
)
def sf_content_type(s, d):
    """SF9, SF10, SF11: kind of a tool's output."""
    body = F.expr("case doc_id % 5 when 0 then concat('{\"a\":', doc_id, '}') when 1 then 'diff --git a' when 2 then '<html>' when 3 then 'x ERROR y' else content end")
    return artifacts(s, d).select("artifact_id", R.content_type(body).alias("kind"))


@query("sf_event_date", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('year', ts) WHEN 1 THEN date_trunc('month', ts) WHEN 2 THEN date_trunc('day', ts) END::TIMESTAMP AS at FROM events")
def sf_event_date(s, d):
    """SF16, SF20: year, month or day texts as times, null for others."""
    text = F.expr("case event_id % 4 when 0 then date_format(ts, 'yyyy') when 1 then date_format(ts, 'yyyy-MM') when 2 then date_format(ts, 'yyyy-MM-dd') else 'soon' end")
    return table(s, d, "events").select("event_id", T.event_date(text).cast("timestamp_ntz").alias("at"))


#: Phrases for events, one of every kind, numbers and weekdays by id.
_ASKED = ("'bug ' || n || ' days ago'", "'what broke yesterday'", "'in the last ' || n || ' weeks'", "'since ' || n || ' months'", "'since last week'", "'last ' || wd", "'last week'", "'last month'", "'last year'", "'this week'", "'this month'", "'this year'", "'on ' || wd", "'today''s bug'", "'seen recently'", "'no date at all'")
_WEEKDAYS = "['monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday']"
_MEANT = (("day - n", "day - n"), ("day - 1", "day - 1"), ("day - 7 * n", "day"), ("day - 30 * n", "day"), ("day - 7", "day"), ("day - CASE (isodow(day) - 1 - k + 7) % 7 WHEN 0 THEN 7 ELSE (isodow(day) - 1 - k + 7) % 7 END::INT", None),
  ("date_trunc('week', day)::DATE - 7", "date_trunc('week', day)::DATE - 1"), ("date_trunc('month', day) - INTERVAL 1 MONTH", "date_trunc('month', day)::DATE - 1"), ("date_trunc('year', day) - INTERVAL 1 YEAR", "date_trunc('year', day)::DATE - 1"),
  ("date_trunc('week', day)", "day"), ("date_trunc('month', day)", "day"), ("date_trunc('year', day)", "day"), ("day - ((isodow(day) - 1 - k + 7) % 7)::INT", None), ("day", "day"), ("day - 7", "day"), ("NULL", "NULL"))
_LEFT = ("'bug'", "'what broke'", "phrase", "phrase", "phrase", "phrase", "phrase", "phrase", "phrase", "phrase", "phrase", "phrase", "'on'", "'bug'", "'seen'", "phrase")


def _by_kind(cases) -> str:
    return "CASE event_id % 16 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(cases)) + " END"


@query(
    "sf_relative_date",
    f"SELECT event_id, {_by_kind([f'({a})::DATE::VARCHAR' for a, _ in _MEANT])} AS after, {_by_kind([f'({b or a})::DATE::VARCHAR' for a, b in _MEANT])} AS before, {_by_kind(_LEFT)} AS cleaned FROM asked",
    f"dated AS (SELECT event_id, ts::DATE AS day, (event_id % 9 + 1)::INT AS n, (event_id // 16 % 7)::INT AS k, {_WEEKDAYS}[(event_id // 16 % 7)::INT + 1] AS wd FROM events), asked AS (SELECT *, {_by_kind(_ASKED)} AS phrase FROM dated)",
)
def sf_relative_date(s, d):
    """SF17, SF18, SF19: the window that a phrase means at an anchor day, and the query without it."""
    from ..functions.temporal import date_window, without_phrase

    e = table(s, d, "events").select("event_id", F.to_date("ts").alias("day"), (F.col("event_id") % 9 + 1).cast("string").alias("n"), F.element_at(F.array(*map(F.lit, WEEKDAYS)), (F.floor(F.col("event_id") / 16) % 7 + 1).cast("int")).alias("wd"))
    e = e.withColumn("phrase", F.expr(_by_kind(_ASKED).replace("''s", "\\'s")))
    w = e.withColumn("w", date_window(F.col("phrase"), F.col("day")))
    return w.select("event_id", F.col("w.after").cast("string").alias("after"), F.col("w.before").cast("string").alias("before"), without_phrase(F.col("phrase")).alias("cleaned"))


@query(
    "sf_hash_embed",
    f"SELECT token, {BUCKET.format('token')} AS bucket FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM benchmark)",
)
def sf_hash_embed(s, d):
    """SF21: a token's dimension."""
    return table(s, d, "benchmark").select(F.explode(T.tokens("text")).alias("token")).distinct().select("token", T.hash_bucket(F.col("token"), 384).alias("bucket"))


@query("sf_confidence", "SELECT memory_id, round(CASE WHEN n <= 1 THEN least(1.0, confidence) ELSE least(1.0, confidence + (1 - confidence) * (1 - 1.0::DOUBLE / n)) END, 9) AS c FROM (SELECT *, memory_id % 6 AS n FROM memories)", MEMORIES)
def sf_confidence(s, d):
    """SF23."""
    return memories(s, d).select("memory_id", F.round(T.evolved_confidence(F.col("confidence"), F.col("memory_id") % 6), 9).alias("c"))


@query("sf_text_hash", """SELECT memory_id, sha256(text || '|{"namespace":"' || namespace || '","session_id":"' || session_id || '","user_id":' || user_id || '}') AS h FROM memories""", MEMORIES)
def sf_text_hash(s, d):
    """SF24: a digest of text and scope, keys in order."""
    return memories(s, d).select("memory_id", F.sha2(F.concat("text", F.lit('|{"namespace":"'), "namespace", F.lit('","session_id":"'), "session_id", F.lit('","user_id":'), F.col("user_id").cast("string"), F.lit("}")), 256).alias("h"))


@query("sf_fingerprint", "SELECT o_orderkey, sha256('priority=' || o_orderpriority || ';status=' || o_orderstatus) AS f FROM orders")
def sf_fingerprint(s, d):
    """SF27: sorted entries of an environment."""
    env = F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority")
    return table(s, d, "orders").select("o_orderkey", F.sha2(F.array_join(F.transform(F.array_sort(F.map_entries(env)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"), 256).alias("f"))


@query("sf_chunk_id", "SELECT artifact_id || ':' || ordinal AS chunk_id, artifact_id AS artifact, ordinal::BIGINT AS place FROM chunks", ARTIFACTS, CHUNKS)
def sf_chunk_id(s, d):
    """SF37: chunk ids split at the last colon."""
    return chunks(s, d).select("chunk_id", F.regexp_extract("chunk_id", r"^(.+):(\d+)$", 1).alias("artifact"), F.regexp_extract("chunk_id", r"^(.+):(\d+)$", 2).cast("long").alias("place"))


@query("tg_word_chunks", "SELECT chunk_id, ordinal, sha256(text) AS h FROM chunks", ARTIFACTS, CHUNKS)
def tg_word_chunks(s, d):
    """TG1, WI4."""
    return chunks(s, d).select("chunk_id", "ordinal", F.sha2("text", 256).alias("h"))


_SENTENCES = f"sentence_rows AS (SELECT artifact_id, unnest(x) AS centre, unnest(range(1, len(x) + 1)) AS n FROM (SELECT artifact_id, {_SENT} AS x FROM artifacts))"


@query("tg_sentence_chunks", "SELECT artifact_id, n::INT AS n, sha256(centre) AS centre, sha256(concat_ws(' ', lag(centre) OVER w, centre, lead(centre) OVER w)) AS window FROM sentence_rows WINDOW w AS (PARTITION BY artifact_id ORDER BY n)", ARTIFACTS, _SENTENCES)
def tg_sentence_chunks(s, d):
    """TG2: every sentence with a neighbour on each side, by digest."""
    x = artifacts(s, d).select("artifact_id", F.inline(T.with_neighbours(T.sentences("content"))))
    return x.select("artifact_id", "n", F.sha2("centre", 256).alias("centre"), F.sha2("window", 256).alias("window"))


@query("tg_packed_sentences", None)
def tg_packed_sentences(s, d):
    """TG2: sentences of every artifact, whatever its length, packed into chunks with a neighbour on each side."""
    x = artifacts(s, d).select("artifact_id", T.packed_sentences("content").alias("x"))
    return x.select("artifact_id", F.inline(T.with_neighbours("x")))


@query("tg_reduce_events", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '[RESULT error] ' || left(text, 220) ELSE '[' || upper(role) || '] ' || left(text, 120) END AS line FROM conversations WHERE role IN ('user', 'assistant') AND NOT (role = 'user' AND text LIKE '<%')")
def tg_reduce_events(s, d):
    """TG4, SC14, ST1: transcript events to lines."""
    from ..streaming.transcripts import as_events, reduced

    return reduced(as_events(table(s, d, "conversations")))


@query("tg_verbatim", "SELECT conv_id, turn, text, 1.0::DOUBLE AS confidence FROM conversations WHERE length(trim(text)) >= 8")
def tg_verbatim(s, d):
    """TG7."""
    return table(s, d, "conversations").where(F.length(F.trim("text")) >= 8).select("conv_id", "turn", "text", F.lit(1.0).alias("confidence"))


_KIND = "CASE event_type WHEN 'error' THEN 'pitfall' WHEN 'purchase' THEN 'decision' WHEN 'signup' THEN 'preference' WHEN 'click' THEN 'instruction' WHEN 'view' THEN 'commitment' ELSE 'fact' END"


@query("ex_classify", f"SELECT memory_id, {_KIND} AS kind, CASE event_type WHEN 'error' THEN 0.86 WHEN 'purchase' THEN 0.85 WHEN 'signup' THEN 0.85 WHEN 'click' THEN 0.75 WHEN 'view' THEN 0.75 ELSE 0.7 END::DOUBLE AS confidence FROM memories", MEMORIES)
def ex_classify(s, d):
    """EX1, TG5: the heaviest rule decides the kind."""
    return memories(s, d).select("memory_id", R.classified(F.col("text"), "key_fact").alias("c")).select("memory_id", "c.kind", "c.confidence")
