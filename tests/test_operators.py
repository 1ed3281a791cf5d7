import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.functions import rules as R
from mnemospark.functions import temporal
from mnemospark.functions import text as T
from mnemospark.operators import clusters as CL
from mnemospark.operators import context as C
from mnemospark.operators import filters as FI
from mnemospark.operators import memory as ME
from mnemospark.operators import retrieval as RE


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


D = lambda m, d, y=2026: dt.date(y, m, d)


@pytest.mark.parametrize(
    "phrase, after, before",
    [
        ("bug 3 days ago", D(5, 26), D(5, 26)), ("what broke yesterday", D(5, 28), D(5, 28)), ("in the last 2 weeks", D(5, 15), D(5, 29)), ("since 2 months", D(3, 30), D(5, 29)), ("since last week", D(5, 22), D(5, 29)),
        ("last friday", D(5, 22), D(5, 22)), ("last week", D(5, 18), D(5, 24)), ("last month", D(4, 1), D(4, 30)), ("last year", D(1, 1, 2025), D(12, 31, 2025)), ("last day", D(5, 22), D(5, 29)), ("this week", D(5, 25), D(5, 29)),
        ("this month", D(5, 1), D(5, 29)), ("this year", D(1, 1), D(5, 29)), ("this day", D(5, 29), D(5, 29)), ("on monday", D(5, 25), D(5, 25)), ("this friday", D(5, 29), D(5, 29)), ("today", D(5, 29), D(5, 29)), ("recently seen", D(5, 22), D(5, 29)), ("nothing", None, None),
    ],
)
def test_relative_dates(spark, phrase, after, before):
    got = one(spark, temporal.date_window(F.lit(phrase), F.lit(D(5, 29))))
    assert got is None if after is None else (got.after, got.before) == (after, before)


@pytest.mark.parametrize(
    "query, left",
    [
        ("show today's bug in the parser", "show bug in the parser"), ("the bug", "the bug"), ("yesterday", "yesterday"), ("what broke, over the past 3 days.", "what broke"), ("since last week  the  build", "the build"),
        ("Last Monday's plan, please", "plan, please"), ("monday and tuesday", "and tuesday"),
    ],
)
def test_phrase_is_removed(spark, query, left):
    assert one(spark, temporal.without_phrase(F.lit(query))) == left


def test_content_terms_keep_function_words_if_there_is_nothing_else(spark):
    assert one(spark, T.content_terms(F.lit("The cat and the HAT"))) == ["cat", "hat"]
    assert one(spark, T.content_terms(F.lit("who are they"))) == ["who", "are", "they"]


def test_prefix_summary(spark):
    text = F.lit("One two. Three four. Five six seven.")
    assert one(spark, T.prefix_summary(text, 20)) == "One two. Three four."
    assert one(spark, T.prefix_summary(text, 6)) == "One..."


def test_snippet(spark):
    text = "x" * 300 + " needle " + "y" * 300
    got = one(spark, T.snippet(F.lit(text), F.array(F.lit("needle")), 200, 60))
    assert got.startswith("...") and got.endswith("...") and "needle" in got
    assert one(spark, T.snippet(F.lit("short"), F.array(F.lit("s")))) == "short"


@pytest.mark.parametrize("n", [0, 1, 80, 81, 140, 141, 500])
def test_word_chunks(spark, n):
    words = [f"w{i}" for i in range(n)]
    want, at = [], 0
    while True:
        want.append(" ".join(words[at : at + 80]))
        if at + 80 >= n:
            break
        at += 60
    assert one(spark, T.word_chunks(F.lit(" ".join(words)), 80, 20)) == want


def test_hash_bucket(spark):
    import hashlib

    for token in ("a", "vector", "ünï"):
        assert one(spark, T.hash_bucket(F.lit(token), 384)) == int(hashlib.sha256(token.encode()).hexdigest(), 16) % 384


def test_sensitive_data(spark):
    text = "mail a.b@example.com, call 555-123-4567, ssn 123-45-6789, key sk_abcdefghijklmnop"
    assert one(spark, T.scrubbed(F.lit(text))) == "mail [EMAIL], call [PHONE], ssn [SSN], key [SECRET]"
    assert one(spark, T.scrubbed(F.lit("clean text"))) == "clean text"


@pytest.mark.parametrize("text, kind", [("I prefer tabs", "preference"), ("Never use eval", "pitfall"), ("always lint", "instruction"), ("the sky is blue", "fact"), ("we have decided to wait", "decision")])
def test_kinds(spark, text, kind):
    assert one(spark, R.classified(F.lit(text), "key_fact"))["kind"] == kind


def test_filters(spark):
    df = spark.sql("select '1' session_id, map('branch', 'main', 'day', '2024-02-01') metadata union all select '2', map('branch', 'dev')")
    count = lambda f: df.where(FI.compiled(f)).count()
    assert [count(f) for f in ({}, {"metadata.branch": "main"}, {"metadata.day__gte": "2024-01-01"}, {"metadata.branch__in": ["main", "dev"]}, {"session_id": "2", "unknown": 1}, {"metadata.branch": None})] == [2, 1, 1, 2, 1, 2]


OPS = "seq long, op string, memory_id long, text string, at timestamp_ntz, supersedes array<long>, confidence double"


def test_three_versions_tile(spark):
    day = lambda m: dt.datetime(2024, m, 10)
    ops = spark.createDataFrame([(1, "add", 1, "a", day(1), [], 0.5), (2, "add", 2, "b", day(3), [1], 0.5), (3, "add", 3, "c", day(6), [2], 0.5)], OPS)
    state = ME.folded(ops)
    at = lambda t: [r.text for r in state.where(FI.valid_at(t)).collect()]
    assert [at(t) for t in ("2024-02-01 00:00:00", "2024-04-01 00:00:00", "2024-07-01 00:00:00", "2023-01-01 00:00:00")] == [["a"], ["b"], ["c"], []]


def test_last_closing_wins_and_delete_keeps_validity(spark):
    t = [dt.datetime(2024, 1, d) for d in range(1, 9)]
    ops = spark.createDataFrame(
        [(1, "add", 1, "a", t[2], [], 0.5), (2, "retract", 1, None, t[4], [], None), (3, "add", 2, "b", t[0], [1], 0.5), (4, "delete", 2, None, t[5], [], None), (5, "confirm", 2, None, t[6], [], None), (6, "add", 3, "x", t[1], [99], 0.5)], OPS
    )
    got = {r.memory_id: r for r in ME.folded(ops).collect()}
    assert set(got) == {1, 2}  # what supersedes an unknown memory is rejected
    assert (got[1].status, got[1].effective_until) == ("superseded", t[2])
    assert (got[2].status, got[2].effective_until, got[2].confirmations) == ("deleted", None, 2)


def test_fusion_and_normalisation(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "qid long, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1)], "qid long, chunk_id string, rank int")
    got = {r.chunk_id: r.score for r in RE.reciprocal_rank_fusion([a, b]).collect()}
    assert got == {"x": round(1 / 61, 9), "y": round(1 / 62 + 1 / 61, 9)}


def test_packing_skips_and_goes_on(spark):
    items = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(n).cast("long").alias("tokens")) for i, n in (("a", 5), ("b", 8), ("c", 4))])
    assert one(spark, C.packed(items, 10))["ids"] == ["a", "c"]


def test_greedy_clusters_follow_the_order_of_rows(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, 3))
    df = spark.createDataFrame([(0, i, x.tolist()) for i, x in enumerate(v)], "grp long, id long, v array<double>")
    u, seeds, want = v / np.linalg.norm(v, axis=1, keepdims=True), [], {}
    for i in range(40):
        want[i] = next((s for s in seeds if u[s] @ u[i] >= 0.8), i)
        if want[i] == i:
            seeds.append(i)
    assert {r.id: r.seed for r in CL.greedy_clusters(df, "grp", "id", 0.8).collect()} == want


def packed(text, most, least):
    done, now = [], ""
    for s in [x for x in re.split(r"(?<=[.!?])\s+", text.strip(" ")) if x]:
        longer = f"{now} {s}" if now else s
        if len(now) >= least and len(longer) > most:
            done, now = [*done, now], s
        else:
            now = longer
    if now and done and len(now) < least:
        done[-1] += " " + now
        now = ""
    return [*done, now] if now else done


def test_sentences_are_packed_with_neighbours(spark):
    texts = ["", "One.", "x" * 3000 + ". End.", " ".join(f"Sentence {i} {'y' * (i * 37 % 400)}." for i in range(300)), "A. B! C? " * 40]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.packed_sentences("t", 500, 100).alias("x")).select("i", "x", T.with_neighbours("x").alias("w")).collect()
    for r in rows:
        want = packed(texts[r.i], 500, 100)
        assert r.x == want and " ".join(want) == texts[r.i].strip()
        assert [(w.n, w.centre, w.window) for w in r.w] == [(k + 1, c, " ".join(want[max(0, k - 1) : k + 2])) for k, c in enumerate(want)]


def test_packed_sentences_hold_the_longest_documents(spark):
    from mnemospark.plans import catalogue
    from mnemospark.plans.tables import artifacts

    sf = "/root/testdata/sf0.001"
    got = {r.artifact_id: r.t for r in catalogue.queries()["tg_packed_sentences"](spark, sf).groupBy("artifact_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "centre"))), lambda x: x["centre"]), " ").alias("t")).collect()}
    want = {r.artifact_id: r.t for r in artifacts(spark, sf).select("artifact_id", F.array_join(T.sentences("content"), " ").alias("t")).where("t <> ''").collect()}
    assert got == want and max(map(len, got.values())) >= 2000


def test_numbered_scrubbing_leaves_overlaps_out():
    from mnemospark.functions.pii import spans

    text = "a@b.co 555-123-4567 x@y.org 123-45-6789 and 4111 1111 1111 1111 sk_abcdefghijklmn 5551234567"
    got = spans(text)
    assert [(k, n) for _, _, k, n in got] == [("EMAIL", 1), ("PHONE", 1), ("EMAIL", 2), ("SSN", 1), ("CREDIT_CARD", 1), ("SECRET", 1), ("PHONE", 2)]
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))
    assert spans("clean text") == []


def test_names_are_folded(spark):
    from mnemospark.functions import names

    values = ["Node７", "ＡＢＣ-12x", "Straße", "  I ", None, "replica count", "HEALTH!"]
    rows = spark.createDataFrame([(x,) for x in values], "x string").select(names.subject("x").alias("s"), names.aspect("x").alias("a")).collect()
    assert [r.s for r in rows] == ["node 7", "abc 12 x", "strasse", "i", "", "replica count", "health"]
    assert rows[5].a == "replicas" and rows[6].a == "status"


def test_outlines(spark):
    from mnemospark.functions import objects

    long = '{"a": ' + "[1, 2, 3], " * 1 + '"b": "' + "x" * 200 + '", "c": {"d": null}, "e": true, "f": 1.5}'
    got = one(spark, objects.outline(F.lit(long), 160))
    assert got.startswith("JSON object, 5 keys:\n  a: array[3]\n  b: str\n  c: object(1 keys)\n  e: bool\n  f: float\n") and "sample: " not in got or len(got) <= 200
    assert one(spark, objects.outline(F.lit('[{"k": 1, "l": 2}]'), 5)).startswith("JSON array, 1 elements\n  element keys: k, l")
    assert one(spark, objects.outline(F.lit("[ 1 , 2 ]"), 100)) == "[1,2]" and one(spark, objects.outline(F.lit("plain"), 9)) is None


def test_outlines_of_odd_texts(spark):
    from mnemospark.functions import objects

    tight = {
        r'{ "a\\" : "b \" c" , "b": [ 1.50 , "\\\\" ] }': r'{"a\\":"b \" c","b":[1.50,"\\\\"]}',
        '{"a": 1} x': '{"a": 1} x', '{"a": 1} {"b": 2}': '{"a": 1} {"b": 2}', '{"a": 1}, "x": 2': '{"a": 1}, "x": 2', "[1 ]]": "[1 ]]", ' "text" ': ' "text" ', "": "", "[ ]": "[]", "{ }": "{}",
        '{"k": "' + r"\" " * 20_000 + '" }': '{"k":"' + r"\" " * 20_000 + '"}',
    }
    frame = spark.createDataFrame([*((k,) for k in tight), (None,)], "x string")
    got = {r.x: (r.c, r.o) for r in frame.select("x", objects.compact(F.col("x")).alias("c"), objects.outline(F.col("x"), 60).alias("o")).collect()}
    assert got.pop(None) == (None, None) and {k: v[0] for k, v in got.items()} == tight
    assert all((v[1] is None) == (k == v[0] and k != "[]") or v[1] == v[0] or len(k) > 60 for k, v in got.items())
    shown = lambda text, most=90: one(spark, objects.outline(F.lit(text), most, 2, "[note]"))
    assert shown('[[1, 2], "' + "y" * 90 + '"]') == "JSON array, 2 elements\n  element type: array[2]\n[note]\nsample: [[1,2]]"
    assert shown('[null, "' + "y" * 90 + '"]') == "JSON array, 2 elements\n  element type: null\n[note]\nsample: [null]"
    assert shown('["' + "y" * 90 + '"]') == "JSON array, 1 elements\n  element type: str\n[note]\nsample: [" + '"' + "y" * 27 + "..."
    assert shown('[{"a": 1, "b": 2, "c": 12345678901234567890}, "' + "y" * 90 + '"]') == 'JSON array, 2 elements\n  element keys: a, b (+1 more)\n[note]\nsample: [{"a":1,"b":2,"c":...'
    assert shown('{"a": 12345678901234567890, "b": 1e300, "c": "' + "z" * 90 + '"}', 80).startswith("JSON object, 3 keys:\n  a: int\n  b: float\n  (+1 more keys)\n[note]")


def test_windows_equal_a_walk(spark):
    import random

    from mnemospark.operators.sessions import transcript_windows

    rng = random.Random(3)
    data = [(s, rng.randrange(30), "x" * rng.choice([0, 3, 40, 90]), rng.random() < 0.1) for s in range(20) for _ in range(s * 3)]
    data += [(99, 1, None, None), (99, 1, None, None)]
    want = []
    for s in {r[0] for r in data}:
        found, size = [[]], 0
        for _, n, line, bad in sorted(((s, n, t or "", bool(b)) for k, n, t, b in data if k == s), key=lambda r: r[1:]):
            if size >= 100:
                found, size = [*found, []], 0
            found[-1].append((line, bad))
            size += len(line)
        texts = [("\n".join(t for t, _ in w), any(b for _, b in w), i) for i, w in enumerate(found)]
        want += [(s, i, len(t), b, t) for t, b, i in sorted(texts, key=lambda x: (not x[1], -len(x[0]), x[2]))[:3]]
    got = transcript_windows(spark.createDataFrame(data, "session long, n long, line string, failed boolean"), 100, 3)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_policies_of_reuse():
    from mnemospark.operators.sessions import ARMS, World, simulate

    world = World(120, {"version": 20, "workload": 30, "volume": 40}, 10, None, 2)
    got = {arm: simulate(arm, world, "version") for arm in ARMS}
    assert got["no-memory"] == {"turns": 1200, "reuses": 0, "derived": 120, "checks": 0, "false_valid": 0}
    # A cache by version derives twice and is wrong from the next drift on.
    assert got["naive-cache"]["derived"] == 2 and got["naive-cache"]["false_valid"] == 90
    # All dimensions declared: an outcome for each state of the world, three checks a reuse.
    assert got["ledger-v1"] == {"turns": 4 * 10 + 116 * 4, "reuses": 116, "derived": 4, "checks": 348, "false_valid": 0}
    assert got["ledger-underdecl"]["false_valid"] == 80 and got["ledger-canary"]["false_valid"] == 0
    assert 0 < got["ledger-learn"]["false_valid"] <= 3 and 0 < got["ledger-tiered"]["false_valid"] <= 3
    assert got["ledger-tiered"]["turns"] < got["ledger-canary"]["turns"] < got["no-memory"]["turns"]
    hidden = World(60, {"version": 70}, 0, 30, 2)
    assert all(simulate(arm, hidden, "version")["false_valid"] == 30 for arm in ARMS if arm != "no-memory")


def test_context_is_packed_as_by_hand(spark):
    from mnemospark.plans import catalogue, recalls

    sf = "/root/testdata/sf0.001"
    cited, nodes = (df.collect() for df in recalls.pack_inputs(spark, sf))
    rank = {"blocked": 0, "active": 1, "done": 9}
    for r in catalogue.queries()["pk_context"](spark, sf).collect():
        lines = [(f"citation:{c.id}", c.line) for c in sorted((c for c in cited if c.qid == r.qid), key=lambda c: (-c.score, c.id))[:50]]
        own = sorted((n for n in nodes if n.qid == r.qid and n.line), key=lambda n: n.id)
        own = sorted(own, key=lambda n: n.at, reverse=True)
        own = sorted(own, key=lambda n: rank[n.status] if n.status == "done" or n.kind != "decision" else 0)
        lines += [(f"node:{n.id}", n.line) for n in own[:10]]
        used, kept = 0, []
        for name, line in lines:
            cost = max(1, len(line.encode()) // 4)
            if used + cost <= 600:
                used, kept = used + cost, [*kept, name]
        assert (r.used, r.ids) == (used, ",".join(kept))
        assert sorted(r.omitted.split(",")) == sorted({n for n, _ in lines} - set(kept)) or not r.omitted
