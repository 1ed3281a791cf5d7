"""The engine's record tables, derived from the driver's, and the same in the oracle's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..sources.built import built
from ..sources.chunk_store import ChunkStore, hash_buckets, opened
from ..sources.gram_index import GramIndex


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("content", F.coalesce("text", F.lit("")))
    created = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, doc_id)")
    return d.select(
        F.col("doc_id").cast("string").alias("artifact_id"), "doc_id", F.concat(F.lit("mem://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("reference"), F.col("source").alias("namespace"),
        (F.col("doc_id") % 10).cast("string").alias("session_id"), "content", "lang", F.octet_length("content").cast("long").alias("byte_size"), T.token_estimate("content").alias("token_estimate"),
        created.alias("created_at"), F.when(F.col("doc_id") % 3 == 0, created + F.expr("interval 30 days")).alias("expires_at"),
    )


ARTIFACTS = """artifacts AS (SELECT doc_id::VARCHAR AS artifact_id, doc_id, 'mem://' || source || '/' || doc_id AS reference, source AS namespace, (doc_id % 10)::VARCHAR AS session_id, coalesce(text, '') AS content, lang,
  octet_length(encode(coalesce(text, '')))::BIGINT AS byte_size, greatest(1, octet_length(encode(coalesce(text, ''))) // 4)::BIGINT AS token_estimate,
  TIMESTAMP '2024-01-01' + to_hours(doc_id::INT) AS created_at, CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2024-01-01' + to_hours(doc_id::INT) + INTERVAL 30 DAY END AS expires_at FROM documents)"""

#: Text of a memory by event type; three carry sensitive data.
_TEMPLATES = {
    "error": ("'Never use step '", "' again; ssn 123-45-'", "lpad((event_id % 10000)::VARCHAR, 4, '0')"), "purchase": ("'We decided to use plan '", "'. Mail user'", "event_id::VARCHAR || '@example.com'"),
    "signup": ("'I prefer option '", "''", "''"), "click": ("'Always run check '", "' with api_key_abcdef'", "lpad((event_id % 1000000)::VARCHAR, 10, '0')"), "view": ("'TODO: review page '", "' by Friday'", "''"),
}
_TEXT = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {a} || (event_id % 50)::VARCHAR || {b} || {c}" for k, (a, b, c) in _TEMPLATES.items()) + " ELSE 'Fact ' || (event_id % 50)::VARCHAR END"


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One memory for each event; a slot (user, type) is a chain in which each closes the one before."""
    e = table(spark, sf_dir, "events")
    slot = W.partitionBy("user_id", "event_type").orderBy("event_id")
    after = F.lead("ts").over(slot)
    return e.select(
        F.col("event_id").alias("memory_id"), "user_id", "event_type", F.expr(_TEXT.replace("::VARCHAR", "").replace("(event_id % 10000)", "cast(event_id % 10000 as string)").replace("(event_id % 1000000)", "cast(event_id % 1000000 as string)")).alias("text"),
        F.expr("case event_type when 'error' then 'pitfall' when 'purchase' then 'decision' when 'signup' then 'preference' when 'click' then 'instruction' else 'fact' end").alias("kind"),
        F.concat(F.lit("ns"), (F.col("user_id") % 4).cast("string")).alias("namespace"), (F.col("event_id") % 7).cast("string").alias("session_id"), ((F.col("event_id") % 50) / 100 + 0.5).alias("confidence"),
        F.col("ts").alias("effective_from"), F.when(after.isNotNull(), F.greatest(after, F.col("ts"))).alias("effective_until"), F.when(after.isNull(), "active").otherwise("superseded").alias("status"), F.lag("event_id").over(slot).alias("supersedes"), "value",
    )


MEMORIES = f"""memories AS (SELECT event_id AS memory_id, user_id, event_type, {_TEXT} AS text,
  CASE event_type WHEN 'error' THEN 'pitfall' WHEN 'purchase' THEN 'decision' WHEN 'signup' THEN 'preference' WHEN 'click' THEN 'instruction' ELSE 'fact' END AS kind,
  'ns' || (user_id % 4) AS namespace, (event_id % 7)::VARCHAR AS session_id, (event_id % 50) / 100::DOUBLE + 0.5::DOUBLE AS confidence, ts AS effective_from, greatest(lead(ts) OVER s, CASE WHEN lead(ts) OVER s IS NOT NULL THEN ts END) AS effective_until,
  CASE WHEN lead(ts) OVER s IS NULL THEN 'active' ELSE 'superseded' END AS status, lag(event_id) OVER s AS supersedes, value FROM events WINDOW s AS (PARTITION BY user_id, event_type ORDER BY event_id))"""


def chunks(spark: SparkSession, sf_dir: str, window: int = 80, overlap: int = 20) -> DataFrame:
    a = artifacts(spark, sf_dir)
    return a.select("artifact_id", "doc_id", "namespace", F.posexplode(T.word_chunks("content", window, overlap)).alias("ordinal", "text")).withColumn("chunk_id", F.concat_ws(":", "artifact_id", "ordinal"))


CHUNKS = r"""chunk_words AS (SELECT artifact_id, doc_id, namespace, content, list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> '') AS w FROM artifacts),
chunk_at AS (SELECT *, unnest(range(0, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(0, ceil((len(w) - 80) / 60.0))::BIGINT + 1 END)) AS ordinal FROM chunk_words),
chunks AS (SELECT artifact_id, doc_id, namespace, ordinal::INT AS ordinal, CASE WHEN len(w) = 0 THEN content ELSE array_to_string(w[ordinal * 60 + 1 : ordinal * 60 + 80], ' ') END AS text, artifact_id || ':' || ordinal AS chunk_id FROM chunk_at)"""


def store(spark: SparkSession, sf_dir: str) -> ChunkStore:
    """The chunk store over all documents, written once a session."""
    return opened(spark, f"{sf_dir}/documents.parquet", lambda: chunks(spark, sf_dir))


def memory_grams(spark: SparkSession, sf_dir: str) -> GramIndex:
    """The gram index over all memories by namespace, written once a session."""
    make = lambda path: GramIndex.build(memories(spark, sf_dir).select(F.col("namespace").alias("ns"), "memory_id", "text"), path)
    return GramIndex(spark, built(spark, f"{sf_dir}/events.parquet", "memory-grams", make))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for each benchmark item: its text, its content terms and the buckets of its hash vector."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text", T.content_terms("text").alias("terms"), hash_buckets(F.col("text")).alias("buckets"))


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
# list_distinct has no order: the first places of terms give it.
QUESTIONS = f"""question_tokens AS (SELECT item_id AS qid, text, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM benchmark),
question_words AS (SELECT qid, text, list_filter(w, lambda x, i: list_position(w, x) = i) AS w FROM question_tokens),
questions AS (SELECT qid, text, CASE WHEN len(list_filter(w, lambda x: NOT list_contains({_STOP}, x))) > 0 THEN list_filter(w, lambda x: NOT list_contains({_STOP}, x)) ELSE w END AS terms FROM question_words)"""
TOKENS = "regexp_extract_all(lower({}), '[a-z0-9_]+')"
BUCKET = "list_reduce(list_concat([0::BIGINT], list_transform(range(0, 16), lambda i: ('0x' || substr(sha256({}), (i * 4 + 1)::INT, 4))::BIGINT)), lambda a, b: (a * 65536 + b) % 384)"


def bags(name: str, source: str, key: str, text: str = "text") -> str:
    """SQL: {name}(key, b, c) counts of a source's tokens by bucket and {name}_norm(key, n), the sum of their squares."""
    return f"""{name}_words AS (SELECT {key}, unnest(list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda w: w <> '')) AS w FROM {source}),
{name}_buckets AS (SELECT w, {BUCKET.format("w")} AS b FROM (SELECT DISTINCT w FROM {name}_words)),
{name} AS (SELECT {key}, b, count(*) AS c FROM {name}_words JOIN {name}_buckets USING (w) GROUP BY ALL), {name}_norm AS (SELECT {key}, sum(c * c) AS n FROM {name} GROUP BY ALL)"""
