"""Queries on small tables that are made like larger ones: against their SQL."""

import os

import pandas as pd

from mnemospark.plans import catalogue
from oracle import DATA, compare


def tables(path, texts, asked):
    """documents and benchmark of these texts and questions; gives their folder as compare() wants it."""
    docs = pd.DataFrame({"doc_id": list(texts), "text": list(texts.values()), "lang": "en", "source": [f"src{i % 5}" for i in texts]})
    docs.assign(n_chars=docs.text.str.len()).to_parquet(path / "documents.parquet")
    pd.DataFrame({"item_id": range(len(asked)), "text": asked}).to_parquet(path / "benchmark.parquet")
    return os.path.relpath(path, DATA)


def equal(spark, name, sf):
    compare(spark, catalogue.queries()[name], catalogue.oracle_sql()[name], sf)


def test_recall_where_a_question_has_no_relevant_hit(spark, tmp_path):
    # 25 documents tie with the one that holds the first question literally, and their ids go before its own.
    texts = {10 + i: "beta alpha" for i in range(25)} | {99: "alpha beta", 100: "gamma delta epsilon"}
    equal(spark, "re_recall_mrr", tables(tmp_path, texts, ["alpha beta", "gamma delta"]))


def test_short_phrases_are_sought_without_the_vocabulary(spark, tmp_path):
    from mnemospark.operators import retrieval as RE

    texts = [(0, "the cat  sat"), (1, "a b he"), (2, ""), (3, None), (4, " he"), (5, "he "), (6, "mañana The_end. x\ny"), (7, "   "), (8, "athe cathe"), (9, "he he")] + [(10 + i, f"w{i} v{i}") for i in range(50)]
    phrases = ["he", "he ", " he", "e c", "", " ", "  ", "   ", "ñan", "a b", "x\ny", "zz", "he he", "w1", "1 v", "at  s", "the cat  sat", "he", None, "t "]
    df, asked = spark.createDataFrame(texts, "k long, text string").repartition(2), spark.createDataFrame(list(enumerate(phrases)), "qid long, phrase string")
    want = sorted((q, k) for q, p in enumerate(phrases) if p is not None for k, t in texts if t is not None and p in t)
    assert sorted(map(tuple, RE.scanned_phrases(df, asked, "k").collect())) == want
    assert sorted(map(tuple, RE.scanned_phrases(df, asked, "k", 3).collect())) == want
    assert RE.scanned_phrases(df, asked.limit(0), "k").count() == 0


def test_short_phrases_in_a_larger_vocabulary(spark, tmp_path):
    texts = {i: " ".join(f"x{i * 40 + k}he{k} Ab" for k in range(40)) for i in range(60)} | {100: "", 101: None, 102: "the Abbey"}
    equal(spark, "re_short_phrases", tables(tmp_path, texts, ["the abbey", "xhe0 ab", "x", "", "zzz yyy", "AAb  xb"]))


def test_chunks_are_scored_where_they_are(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from mnemospark.operators import retrieval as RE
    from mnemospark.sources.chunk_store import ChunkStore

    monkeypatch.setattr(RE, "CELLS", 64)
    rows = [(str(i // 9), f"{i // 9}:{i % 9}", f"src{i % 2}", " ".join(f"w{(i * k) % 17}" for k in range(i % 12))) for i in range(200)]
    st = ChunkStore.build(spark.createDataFrame(rows, "artifact_id string, chunk_id string, namespace string, text string").coalesce(3), str(tmp_path / "store"))
    asked = [(q, [f"w{t}" for t in range(q % 7, 17, 1 + q % 4)], f"src{q % 2}") for q in range(70)] + [(70, ["none"], "src0"), (71, [], "src0")]
    questions = spark.createDataFrame(asked, "qid long, terms array<string>, source string")
    want = {(r.qid, r.chunk_id): (r.keyword, r.bm25) for r in RE.posted_scores(st, questions).collect()}
    got = {(r.qid, r.chunk_id): (r.keyword, r.bm25) for r in RE.lexical_scores(st, questions).collect()}
    assert len(want) > 1000 and got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)
    for score, n in (("keyword", 0), ("bm25", 1)):
        best = RE.top_k(spark.createDataFrame([(q, c, x[n]) for (q, c), x in got.items()], "qid long, chunk_id string, score double"), 4)
        found = RE.lexical_top_k(st, questions, score, 4)
        assert sorted(map(tuple, found.select(*best.columns).collect())) == sorted(map(tuple, best.collect()))
        assert "groupBy" not in found._jdf.queryExecution().toString() and found._jdf.queryExecution().toString().count("HashAggregate") == 0
    own = {(q, c) for q, c in want if {r[1]: r[2] for r in rows}[c] == f"src{q % 2}"}
    assert {(r.qid, r.chunk_id) for r in RE.lexical_scores(st, questions, same=("namespace", "source")).collect()} == own
    assert {(r.qid, r.chunk_id) for r in RE.lexical_scores(st, questions, least=0.5).collect()} == {k for k, x in want.items() if x[0] >= 0.5}
    documents = {}
    for (q, c), x in want.items():
        best, qids = documents.get(c.split(":")[0], (0, set()))
        documents[c.split(":")[0]] = max(best, x[0]), qids | {q}
    counted = {r.artifact_id: (r.score, r.asked) for r in RE.document_scores(st, questions).collect()}
    assert {k: v for k, v in counted.items() if v[1]} == {a: (x, len(q)) for a, (x, q) in documents.items()}
    assert st.terms.agg(F.sum("df")).first()[0] == st.postings.count()


def test_contexts_are_packed_from_the_asked_customers_orders(spark):
    from mnemospark.plans import recalls

    sf = f"{DATA}/sf0.001"
    asked = spark.createDataFrame([(1,), (4,), (1 << 40,)], "qid long")
    every, some = recalls.pack_inputs(spark, sf)[1], recalls.pack_inputs(spark, sf, asked)[1]
    assert sorted(map(tuple, some.collect()), key=str) == sorted(map(tuple, every.where("qid in (1, 4)").collect()), key=str) and some.count() > 0
    # Line items are not dealt by order: they meet the few orders that are left.
    assert "SortMergeJoin" not in some._jdf.queryExecution().executedPlan().toString()


def test_costs_search_each_leg_once(spark):
    plan = catalogue.queries()["bm_runtime_loop"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "MapInPandas" not in plan


def test_the_fit_of_an_index_is_bounded_whatever_its_vectors_are(spark, tmp_path, monkeypatch):
    import numpy as np

    from mnemospark.sources import vector_index as V

    fitted = []
    means = V.spherical_means
    monkeypatch.setattr(V, "NUMBERS", 4000)
    monkeypatch.setattr(V, "spherical_means", lambda x, lists: fitted.append(x.shape) or means(x, lists))
    x = np.random.default_rng(3).normal(size=(2500, 20))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    index = V.VectorIndex.build(df, str(tmp_path / "index"))
    assert fitted[0][0] <= 2 * 4000 // 20 and index.sizes.sum() == 2500 and index.recall >= 0.95


def test_covers_read_the_chunks_of_the_rarest_stems(spark, tmp_path):
    # Common stems stand in every text, so only the rare ones say which texts are read.
    texts = {i: " ".join(["common words here often"] * 3 + [f"rare{i % 10}s tests{i % 7}"]) for i in range(60)} | {90: "rare1 test1", 91: None}
    asked = ["common words rare3 test3", "commons word", "common rare1 test1 tested", "rare4 missing", "often here common word rare5s tests5", ""]
    sf = tables(tmp_path, texts, asked)
    equal(spark, "re_ranked_covers", sf)
    from mnemospark.plans import searches

    plan = catalogue.queries()["re_ranked_covers"](spark, f"{DATA}/{sf}")._jdf.queryExecution().optimizedPlan().toString()
    assert "count(distinct stem" not in plan and "kept-" not in searches.store(spark, f"{DATA}/{sf}").path and "Generate explode" not in plan


def test_facts_are_joined_without_the_driver(spark):
    # Far fewer rows than a broadcast allows: the plan must not depend on an estimate of how many keys there are.
    out = catalogue.queries()["ex_commit_report"](spark, f"{DATA}/sf0.001")
    assert {r.reason: r.n for r in out.collect()}["accepted"] > 0
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_best_memories_and_texts_by_one_pass(spark, tmp_path, monkeypatch):
    import random

    from mnemospark.operators import retrieval as RE
    from mnemospark.sources.chunk_store import ChunkStore

    monkeypatch.setattr(RE, "CELLS", 50)
    rng = random.Random(5)
    texts = [(f"ns{i % 3}", i, "".join(rng.choices("abAB 1é", k=rng.randrange(30)))) for i in range(300)] + [("ns0", 500, None), ("ns0", 501, ""), (None, 502, "ab")]
    asked = [(0, "ns0", "ab"), (1, "ns1", "AAAA a"), (2, "ns2", "é1 ab ab"), (3, "ns0", "  "), (4, "ns1", "zzz"), (5, None, "ab"), (6, "ns2", None)]
    want = []
    for q, ns, text in asked:
        scored = [(-sum((t or "").lower().count(w) for w in (text or "").lower().split()), i) for n, i, t in texts if n is not None and n == ns]
        want += [(q, i, -s) for s, i in sorted(scored)[:4] if s]
    df, requests = spark.createDataFrame(texts, "ns string, memory_id long, text string"), spark.createDataFrame(asked, "qid long, ns string, text string")
    for block in (4096, 2):
        got = RE.scanned_substrings(df, requests, 4, block=block).select("qid", "memory_id", "score").collect()
        assert sorted(map(tuple, got)) == sorted(want)
    rows = [(f"d:{i}", f"src{i % 2}", " ".join(f"w{(i % 13 * k) % 7}" for k in range(i % 5))) for i in range(150)]
    st = ChunkStore.build(spark.createDataFrame(rows, "chunk_id string, namespace string, text string").repartition(3), str(tmp_path / "store"))
    asked = [(q, [f"w{t}" for t in range(q % 5, 7, 2)], f"src{q % 2}") for q in range(9)]
    want = []
    for q, terms, source in asked:
        first = {}
        for c, n, t in sorted(rows):
            if n == source and set(terms) & set(t.split()):
                first.setdefault(t, (-len(set(terms) & set(t.split())) / len(terms), c))
        want += [(q, c, -x) for x, c in sorted(first.values())[:3]]
    got = RE.distinct_top_k(st, spark.createDataFrame(asked, "qid long, terms array<string>, source string"), 3, ("namespace", "source"))
    assert sorted(map(tuple, got.select("qid", "chunk_id", "score").collect())) == sorted(want)
