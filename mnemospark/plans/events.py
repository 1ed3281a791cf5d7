"""Queries over transcripts that are written as files and read back through their data source."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import consolidation as CO
from ..sources import agent_transcripts as AT
from ..sources.chunk_store import shared_dir
from .registry import query
from .tables import table


def nested_events(s, d):
    """(conv_id, turn, value): each turn of the conversations as an event with content blocks, and a cut-off line a conversation."""
    c = table(s, d, "conversations")
    struct = lambda **fields: F.struct(*(v.alias(k) for k, v in fields.items()))
    text, t = F.col("text"), F.col("turn")
    variant = lambda x: F.parse_json(F.to_json(x))
    said = variant(struct(type=F.lit("text"), text=text))
    thought = variant(struct(type=F.lit("thinking"), thinking=F.left(text, F.lit(50)), signature=F.md5(text)))
    call = variant(struct(type=F.lit("tool_use"), name=F.when(t % 2 == 1, "grep"), input=struct(depth=t, pattern=F.left(text, F.lit(250)))))
    parts = F.array(struct(type=F.lit("text"), text=F.left(text, F.lit(300))), struct(type=F.lit("image"), text=F.lit("no")), struct(type=F.lit("text"), text=F.lit("end")))
    result = variant(struct(type=F.lit("tool_result"), is_error=t % 3 == 0, content=parts))
    event = lambda content: F.to_json(struct(type=F.col("role"), message=struct(content=content)))
    value = F.when((F.col("role") == "user") & (t % 4 == 0), event(text)).when(F.col("role") == "user", event(F.array(said, result))).otherwise(event(F.array(thought, said, call)))
    return c.select("conv_id", "turn", value.alias("value")).unionByName(c.select("conv_id", "turn", F.lit('{"type": "user", "mess').alias("value")).where("turn = 0"))


_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_EVENTS = f"""said AS (SELECT conv_id, turn, role, text, {_TRIM.format("text")} AS t FROM conversations WHERE role IN ('user', 'assistant')),
turns AS (SELECT conv_id, turn, 0 AS block, role, false AS is_error, t AS x FROM said WHERE role = 'user' AND (turn % 4 <> 0 OR NOT starts_with(t, '<'))
  UNION ALL SELECT conv_id, turn, 1, 'result', turn % 3 = 0, substr(substr(text, 1, 300) || ' end', 1, CASE WHEN turn % 3 = 0 THEN 220 ELSE 120 END) FROM said WHERE role = 'user' AND turn % 4 <> 0
  UNION ALL SELECT conv_id, turn, 0, role, false, {_TRIM.format("substr(text, 1, 50)")} FROM said WHERE role = 'assistant' UNION ALL SELECT conv_id, turn, 1, role, false, t FROM said WHERE role = 'assistant'
  UNION ALL SELECT conv_id, turn, 2, 'tool', false, CASE WHEN turn % 2 = 1 THEN 'grep' ELSE 'tool' END || '(' || substr('{{"depth":' || turn || ',"pattern":' || to_json(substr(text, 1, 250))::VARCHAR || '}}', 1, 200) || ')' FROM said WHERE role = 'assistant')"""


def _written(s, d) -> str:
    """A folder of transcript files, each with whole conversations in the order of their turns."""
    path = f"{shared_dir(s)}/transcripts-{uuid.uuid4().hex}"
    tagged = nested_events(s, d).select("conv_id", "turn", F.when(F.endswith("value", F.lit("}")), F.concat(F.expr("substr(value, 1, length(value) - 1)"), F.lit(',"conv":'), "conv_id", F.lit(',"turn":'), "turn", F.lit("}"))).otherwise(F.col("value")).alias("value"))
    tagged.repartition(4, "conv_id").sortWithinPartitions("conv_id", "turn").select("value").write.option("compression", "none").text(path)
    return path


def _read(s, path):
    s.dataSource.register(AT.Transcripts)
    return AT.parsed(s.read.format("agent_transcripts").option("suffix", ".txt").load(path))


@query("tg_event_turns", "SELECT conv_id, turn, block::INT AS block, role, is_error, sha256('[' || CASE role WHEN 'tool' THEN 'TOOL' WHEN 'result' THEN CASE WHEN is_error THEN 'RESULT ERROR' ELSE 'RESULT ok' END ELSE upper(role) END || '] ' || x) AS h FROM turns WHERE x <> '' OR role = 'result'", _EVENTS)
def tg_event_turns(s, d):
    """TG4, SC14, ST1: events with content blocks, written as files and read by their data source, reduced to lines."""
    events, _ = _read(s, _written(s, d))
    named = events.select("file", "at", F.try_variant_get("event", "$.conv", "long").alias("conv_id"), F.try_variant_get("event", "$.turn", "long").alias("turn"))
    got = AT.turns(events).join(named, ["file", "at"])
    return got.select("conv_id", "turn", "block", "role", "is_error", F.sha2(AT.line(F.col("role"), F.col("is_error"), F.col("text")), 256).alias("h"))


@query("sc_bad_lines", "SELECT count(*) AS bad, (SELECT count(*) FROM conversations) AS good FROM conversations WHERE turn = 0")
def sc_bad_lines(s, d):
    """SC14: lines of the written transcripts that are no JSON, kept apart from the events."""
    events, bad = _read(s, _written(s, d))
    return bad.agg(F.count("*").alias("bad")).crossJoin(events.agg(F.count("*").alias("good")))  # one row each


#: What each turn adds to its text, by number, and the day or year that it means from 2023-05-08 and so on, as SQL over the anchor a.
_SAYINGS = ((" yesterday.", "a - 1"), (" 3 days ago.", "a - 3"), (" 2 months ago.", "a - 60"), (" last week.", "a - 7"), (" a month ago.", "a - 30"), (" last year.", None), (" on friday.", "a - (CASE WHEN isodow(a) > 5 THEN isodow(a) - 5 ELSE isodow(a) + 2 END)::INT"), ("", None))
_SAID = "CASE (conv_id + turn) % 8 " + " ".join(f"WHEN {i} THEN '{p}'" for i, (p, _) in enumerate(_SAYINGS)) + " END"
_MEANT = "CASE (conv_id + turn) % 8 " + " ".join(f"WHEN {i} THEN ({x})::DATE::VARCHAR" for i, (_, x) in enumerate(_SAYINGS) if x) + " WHEN 5 THEN (year(a) - 1)::VARCHAR END"


def anchored_turns(s, d):
    """(conv_id, turn, speaker, text): the conversations' turns, each with an expression of time, after a row that dates the session; every fifth isn't dated."""
    c = table(s, d, "conversations").where("text is not null")
    day = F.date_add(F.lit("2023-05-08").cast("date"), (F.col("conv_id") % 300).cast("int"))
    marks = c.where("conv_id % 5 <> 4").select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit(None).cast("string").alias("speaker"), F.concat(F.lit("[Session date: 1:56 pm on "), F.date_format(day, "d MMMM, yyyy"), F.lit("]")).alias("text")).distinct()
    return marks.unionByName(c.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").alias("speaker"), F.concat(F.btrim(F.translate("text", "\t\n\r", "   ")), F.expr(_SAID)).alias("text")))


@query(
    "tg_dated_turns",
    """SELECT conv_id, turn, role AS subject, sha256(CASE WHEN a IS NULL THEN '' ELSE '(around ' || a || ') ' END || '[' || role || '] ' || t || CASE WHEN m IS NULL THEN '' ELSE ' [date: ' || m || ']' END) AS h, a::VARCHAR AS said_on, m AS refers_to
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(t) ORDER BY turn) AS again, CASE WHEN a IS NOT NULL THEN {m} END AS m FROM (SELECT conv_id, turn, role, trim(trim(translate(text, chr(9) || chr(10) || chr(13), '   ')) || {s}) AS t, CASE WHEN conv_id % 5 <> 4 THEN DATE '2023-05-08' + (conv_id % 300)::INT END AS a FROM conversations WHERE text IS NOT NULL)) WHERE again = 1 AND t <> ''""".format(m=_MEANT, s=_SAID),
)
def tg_dated_turns(s, d):
    """TG3, SF19: every turn as a fact with its session's date and the day that it speaks of, by a table function over each conversation."""
    got = CO.dated_facts(anchored_turns(s, d), "turns")
    return got.select("conv_id", "turn", "subject", F.sha2("span", 256).alias("h"), F.col("said_on").cast("string").alias("said_on"), "refers_to")


@query("tg_dense_facts", None)
def tg_dense_facts(s, d):
    """TG3, SF35: the twelve sentences of each conversation that hold most dates, numbers and names."""
    return CO.dated_facts(anchored_turns(s, d), "sentences")
