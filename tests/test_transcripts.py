"""Transcripts as a data source: ranges of files, a stream over files that grow, and the reducer against plain Python."""

import json

import pytest
from pyspark.sql import functions as F

from mnemospark.sources import agent_transcripts as AT

CONTENTS = (
    " hello \n", "<reminder>no</reminder>", "", "  ", None, 5, {"type": "text", "text": "no list"},
    [{"type": "text", "text": " a "}, {"type": "text", "text": ""}, {"type": "thinking", "thinking": "deep", "signature": "c2ln"}, {"type": "text"}, "loose", 7, None],
    [{"type": "tool_use", "name": "ls", "input": {"a": [1, 2.5, "é\n\"x\""], "b": {"c": None, "d": True}}}, {"type": "tool_use", "input": {"q": "z" * 400}}, {"type": "tool_use", "name": "none"}],
    [{"type": "tool_result", "content": "x" * 500}, {"type": "tool_result", "is_error": True, "content": [{"type": "text", "text": "y" * 300}, {"type": "image", "text": "no"}, {"type": "text", "text": "end"}]}, {"type": "tool_result"}, {"type": "unknown", "text": "?"}],
)
EVENTS = [{"type": kind, "message": {"content": c}} for kind in ("user", "assistant", "system") for c in CONTENTS] + [{"type": "user"}, {"type": "user", "message": "text"}, [1], "word", 3, {}]
BAD = ['{"type": "user"', "not json", "{'a': 1}"]


def block_text(content):
    if isinstance(content, str):
        return content
    return " ".join(b.get("text", "") for b in content if isinstance(b, dict) and b.get("type") == "text") if isinstance(content, list) else ""


def reduced(event, tool=200, ok=120, error=220, drop=False):
    """(block, role, is_error, text) of an event."""
    if not isinstance(event, dict) or event.get("type") not in ("user", "assistant") or not isinstance(event.get("message"), dict):
        return []
    kind, content = event["type"], event["message"].get("content")
    if isinstance(content, str):
        t = content.strip()
        return [(0, kind, False, t)] if kind == "user" and t and not t.startswith("<") else []
    out = []
    for i, b in enumerate(content if isinstance(content, list) else ()):
        if not isinstance(b, dict):
            continue
        if b.get("type") in ("text", "thinking"):
            t = (b.get("text") or b.get("thinking") or "").strip()
            out += [(i, kind, False, t)] if t else []
        elif b.get("type") == "tool_use":
            args = json.dumps(b.get("input", {}), separators=(",", ":"), sort_keys=True, ensure_ascii=False)
            out.append((i, "tool", False, f"{b.get('name', 'tool')}({args[:tool]})"))
        elif b.get("type") == "tool_result":
            if b.get("is_error"):
                out.append((i, "result", True, block_text(b.get("content"))[:error]))
            elif not drop:
                out.append((i, "result", False, block_text(b.get("content"))[:ok]))
    return out


def encoded(events):
    return [json.dumps(e, ensure_ascii=i % 2 == 0) for i, e in enumerate(events)]


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "sessions"
    (at / "deep").mkdir(parents=True)
    (at / "one.jsonl").write_text("\n".join([*encoded(EVENTS), *BAD, "", "  "]))
    (at / "deep" / "two.jsonl").write_text("\n".join(encoded(EVENTS[:5])) + "\n")
    (at / "empty.jsonl").write_text("")
    (at / "other.txt").write_text("not read\n")
    return at


def places(path):
    out, at = {}, 0
    for line in path.read_bytes().split(b"\n"):
        out[at] = line.decode()
        at += len(line) + 1
    return out


@pytest.mark.parametrize("size", [AT.RANGE, 37])
def test_reads_every_line_once_and_reduces_it(spark, folder, monkeypatch, size):
    monkeypatch.setattr(AT, "RANGE", size)
    spark.dataSource.register(AT.Transcripts)
    lines = spark.read.format("agent_transcripts").load(str(folder))
    got = sorted((r.file.rsplit("/", 1)[1], r["at"], r.value) for r in lines.collect())
    want = sorted((p.name, at, value) for p in (folder / "one.jsonl", folder / "deep" / "two.jsonl") for at, value in places(p).items() if at < p.stat().st_size)
    assert got == want
    events, bad = AT.parsed(lines)
    assert sorted(r.value for r in bad.collect()) == sorted(BAD)
    for how in ({}, {"tool": None, "ok": None, "error": None}, {"tool": 3, "ok": 4, "error": 5, "drop": True}):
        named = dict(zip(("tool_chars", "result_chars", "error_chars", "drop_results"), (how.get("tool", 200), how.get("ok", 120), how.get("error", 220), how.get("drop", False)), strict=True))
        rows = sorted((r.file.rsplit("/", 1)[1], r["at"], r.block, r.role, r.is_error, r.text) for r in AT.turns(events, **named).collect())
        want_rows = sorted((name, at, *t) for name, at, value in want if value.strip() and value not in BAD for t in reduced(json.loads(value), **how))
        assert rows == want_rows


def test_a_stream_follows_files_that_grow(spark, tmp_path):
    spark.dataSource.register(AT.Transcripts)
    lines, at = encoded(EVENTS), tmp_path / "live"
    at.mkdir()
    stream = AT.turns(AT.parsed(spark.readStream.format("agent_transcripts").load(str(at)))[0])

    def step():
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    whole = "\n".join(lines) + "\n"
    first, second = len(whole) // 3, 2 * len(whole) // 3  # amid lines: the rest of one is read when it is there
    (at / "a.jsonl").write_text(whole[:first])
    step()
    (at / "a.jsonl").write_text(whole[:second])
    (at / "b.jsonl").write_text(whole)
    step()
    (at / "a.jsonl").write_text(whole)
    step()
    got = spark.read.parquet(str(tmp_path / "out")).select("file", "at", "block", "role", "is_error", "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, AT.transcript(spark, str(at)).collect())) and got.count() > 0


def test_formats(spark, folder, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps([{"role": "user", "content": " hi "}, {"content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}, {"role": "x", "content": " "}, 5]))
    got = AT.transcript(spark, str(tmp_path / "list.json")).orderBy("at").collect()
    assert [(r["at"], r.role, r.text) for r in got] == [(0, "user", "hi"), (1, "assistant", "a b")]
    (tmp_path / "object.json").write_text(json.dumps({"messages": [{"role": "user", "content": "x"}]}))
    assert AT.transcript(spark, str(tmp_path / "object.json")).count() == 1
    AT.register("words", lambda s, path: s.createDataFrame([("f", 0, 0, "user", False, path)], "file string, at long, block int, role string, is_error boolean, text string"))
    assert AT.transcript(spark, "anything", "words").first().text == "anything"
    with pytest.raises(ValueError):
        AT.transcript(spark, "x", "unknown")
    assert [r[0] for r in AT.transcript(spark, str(folder)).where("role = 'tool'").select(AT.line(F.col("role"), F.col("is_error"), F.lit("t"))).distinct().collect()] == ["[TOOL] t"]
