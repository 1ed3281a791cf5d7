"""Additions, commits, reuse and graph patches against walks in their order."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from mnemospark.functions.pii import spans
from mnemospark.operators import context, graphs, memory

ADDED = "memory_id long, ns string, text string, summary string, detail string, action string, supersedes array<long>, event_date timestamp_ntz, at timestamp_ntz"
DAY = datetime(2024, 1, 1)


def clean(text):
    if text is None:
        return None, set()
    out, at, kinds = "", 0, set()
    for start, end, kind, number in spans(text):
        out, at = out + text[at:start] + f"[{kind}_{number}]", end
        kinds.add(kind)
    return out + text[at:], kinds


def test_additions_equal_a_walk(spark):
    rng = random.Random(5)
    texts = ["mail a@b.org", "mail c@d.org", "ssn 123-45-6789 and 987-65-4321", "plain", "", None]
    rows = [(i, rng.choice(["x", "y", None]), rng.choice(texts), None, rng.choice(texts), rng.choice(texts), [1] if rng.random() < 0.2 else rng.choice([[], None]), DAY if i % 3 == 0 else None, datetime(2024, 2, 1)) for i in range(10, 80)]
    known = [(1, "x", "plain"), (2, "x", "mail [EMAIL_1]"), (3, "x", "plain")]
    first, want = {}, []
    for i, ns, text in known:
        first.setdefault((ns, text), i)
    for i, ns, text, summary, detail, action, supersedes, event, at in rows:
        fields = [clean(t) for t in (text, summary, detail, action)]
        twin = first.setdefault((ns, fields[0][0]), i)
        add = twin == i or bool(supersedes)
        want.append((i, "add" if add else "confirm", i if add else twin, None if twin == i else twin, event or at, tuple(sorted(set().union(*(k for _, k in fields)))), *(t for t, _ in fields)))
    got = memory.additions(spark.createDataFrame(rows, ADDED), ["ns"], spark.createDataFrame(known, "memory_id long, ns string, text string"))
    assert sorted((r.memory_id, r.op, r.target, r.duplicate_of, r.effective_from, tuple(r.flags), r.text, r.summary, r.detail, r.action) for r in got.collect()) == sorted(want)
    assert memory.additions(spark.createDataFrame([], ADDED), ["ns"]).count() == 0


def test_commits_keep_what_was_refused_out_of_duplicates(spark):
    rows = [
        (1, "same", "x", 0.2, ["r"]), (2, "same", "x", 0.9, []), (3, "same", "x", 0.9, ["r"]), (4, "same", "x", 0.9, ["r"]), (5, "  ", "x", 0.9, ["r"]), (6, None, "x", 0.9, ["r"]),
        (7, "same", "y", 0.9, ["r"]), (8, "to a@b.org", "y", 0.6, ["r"]), (9, "to c@d.org", "y", None, ["r"]), (10, "key", "y", 0.9, None),
    ]
    frame = spark.createDataFrame(rows, "memory_id long, text string, ns string, confidence double, source_refs array<string>").withColumn("at", F.lit(DAY).cast("timestamp_ntz"))
    decided = memory.committed(frame, ["ns"], 0.6)
    assert {r.memory_id: (r.reason, r.error, r.duplicate_of) for r in decided.collect()} == {
        1: ("below_threshold", None, None), 2: ("validation_error", "no source reference", None), 3: ("accepted", None, None), 4: ("duplicate", None, 3), 5: ("validation_error", "empty text", None),
        6: ("validation_error", "empty text", None), 7: ("accepted", None, None), 8: ("accepted", None, None), 9: ("below_threshold", None, None), 10: ("validation_error", "no source reference", None),
    }
    report = memory.commit_report(decided, {"least": 0.6}).collect()[0]
    assert (report.candidates, report.accepted, report.below_threshold, report.validation_error, report.duplicate, report.pii_flags) == (10, 3, 2, 4, 1, "EMAIL")
    empty = memory.commit_report(memory.committed(frame.limit(0), ["ns"], 0.6), {}).collect()[0]
    assert (empty.candidates, empty.pii_flags) == (0, "")


def test_first_that_reuses_else_the_last_reason(spark):
    rows = [(1, 10, 9.0, "drift"), (1, 11, 8.0, "reused_noise"), (1, 12, 7.0, "match"), (2, 20, 5.0, "expired"), (2, 21, 5.0, "drift"), (3, 30, 1.0, "expired"), (3, 31, 0.5, "not_worth"), (3, 32, 0.1, "match")]
    frame = spark.createDataFrame(rows, "who long, id long, score double, verdict string")
    got = context.best_first(frame, "who", [F.desc("score"), F.col("id")], 2)
    assert sorted(map(tuple, got.collect())) == [(1, 11, True, "reused_noise"), (2, 21, False, "drift"), (3, 31, False, "not_worth")]


def test_graphs_as_their_patches_make_them(spark):
    day = lambda n: datetime(2024, 1, n)
    rows = [(1, 0, day(1), "active", "a"), (1, 1, day(3), None, "b"), (1, 2, day(5), "done", None), (2, 0, day(4), "active", None), (3, 0, day(2), None, None)]
    frame = spark.createDataFrame(rows, "graph_id long, seq long, at timestamp_ntz, status string, title string")
    assert sorted(map(tuple, graphs.graphs(frame, ["status", "title"]).collect())) == [(1, day(1), day(5), "done", "b"), (2, day(4), day(4), "active", None), (3, day(2), day(2), None, None)]
    assert sorted(map(tuple, graphs.graphs(frame, ["status", "title"], day(3)).collect())) == [(1, day(1), day(3), "active", "b"), (3, day(2), day(2), None, None)]
    assert sorted(r.graph_id for r in graphs.existing(graphs.graphs(frame, ["status"]), day(3)).collect()) == [1, 3]
    assert [(r.graph_id, r.place) for r in graphs.listed(graphs.graphs(frame, ["status"]).withColumn("ns", F.lit(0)), "ns", 2).orderBy("place").collect()] == [(1, 1), (3, 2)]


def test_tiers_pass_over_requests_that_may_not_use_them(spark):
    from mnemospark.operators import recall

    requests = spark.createDataFrame([(1, True), (2, False), (3, False), (4, None)], "qid long, past boolean")
    tier = lambda rows: spark.createDataFrame([(q, "m", i, x, i) for q, i, x in rows], "qid long, kind string, id string, score double, snippet string")
    graph, memory_, raw = tier([(1, "g", 1.0), (2, "h", 1.0)]), tier([(1, "a", 1.0), (2, "b", 1.0), (3, "c", 0.1)]), tier([(2, "r", 0.9), (3, "s", 1.0)])
    tiers = [("graph", graph, F.col("past")), ("memory", memory_, ~F.col("past")), ("raw", raw, ~F.col("past"))]
    got = {r.qid: (r.strategy, r.escalations, r.hits, r.context) for r in recall.adaptive(requests, tiers).collect()}
    assert got == {1: ("graph", "graph:tier_complete", 1, "g"), 2: ("memory", "memory:tier_complete", 1, "b"), 3: ("raw", "memory:below_floor,raw:tier_complete", 2, "s\n\nc"), 4: ("abstain", "abstain:exhausted", 0, "")}
    got = {r.qid: (r.strategy, r.escalations, r.hits) for r in recall.adaptive(requests, tiers, sufficient=lambda n: n >= 2).collect()}
    assert got == {1: ("abstain", "graph:not_sufficient,abstain:exhausted", 1), 2: ("raw", "memory:not_sufficient,raw:tier_complete", 2), 3: ("raw", "memory:below_floor,raw:tier_complete", 2), 4: ("abstain", "abstain:exhausted", 0)}


def test_precedents_may_return_fewer_than_there_are(spark):
    from mnemospark.operators import recall

    rows = [(1, 1, 9.0, "fact", "a"), (1, 2, 8.0, "decision", " B "), (1, 3, 7.0, "decision", "b"), (1, 4, 6.0, "decision", "c"), (2, 5, 1.0, "fact", "d")]
    hits = spark.createDataFrame(rows, "qid long, id long, score double, kind string, text string")
    assert [(r.qid, r.id, r.place) for r in recall.precedents(hits, 3).collect()] == [(1, 2, 2)]
    assert sorted(r.id for r in recall.precedents(hits).collect()) == [2, 4]
