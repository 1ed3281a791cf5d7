"""Indexes and operators that stand for a scan or a sort of everything: against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators import aggregates, clusters
from mnemospark.operators import retrieval as RE
from mnemospark.plans import indexes, searches
from mnemospark.sources.gram_index import GramIndex
from mnemospark.sources.vector_index import VectorIndex, recall
from oracle import DATA


def clustered(rng, n, dim=16, centres=30):
    return rng.normal(size=(centres, dim))[rng.integers(centres, size=n)] + 0.3 * rng.normal(size=(n, dim))


def test_vector_index_finds_the_nearest_in_few_lists(spark, tmp_path):
    x = clustered(np.random.default_rng(1), 3000)
    rows = [(i, v.tolist(), i % 7) for i, v in enumerate(x)] + [(3000, [0.0] * 16, 0), (3001, None, 0), (3002, [float("nan")] * 16, 0), (3003, x[5].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>, label long")
    index = VectorIndex.build(df.select("vec_id", "v"), str(tmp_path / "index"))
    assert index.n == 3003 and index.sizes.sum() == 3003 and index.recall >= 0.95
    queries = df.where("vec_id % 50 = 5").select(F.col("vec_id").alias("qid"), F.col("v").alias("q"))
    got, report = index.search(queries, 10)
    truth = RE.vector_top_k(df.where("vec_id < 3000 or vec_id = 3003").select("vec_id", "v"), queries, 10)
    assert recall(got, truth) >= 0.9
    rows = report.collect()
    assert len(rows) == queries.count() and sum(r.scanned for r in rows) < 0.3 * len(rows) * index.n and not any(r.shortfall for r in rows)
    assert {r.vec_id: r.score for r in got.where("qid = 5").collect()}[3003] == 1.0
    # All lists make it exact; scores are those of the exact search.
    plain = lambda d: sorted((r.qid, r.rank, r.score) for r in d.collect())
    assert plain(index.search(queries, 10, len(index.centroids))[0]) == plain(truth)
    # A filter that leaves few rows in the lists that are read: the report says so, and widening mends it.
    own = df.where("label = 3").select("vec_id")
    few, short = index.search(queries, 200, 1, own)
    assert short.where("shortfall").count() == queries.count() and few.groupBy("qid").count().agg(F.max("count")).first()[0] < 200
    exact = RE.vector_top_k(df.where("label = 3").select("vec_id", "v"), queries, 200)
    assert plain(index.widened(queries, 200, own, 1)) == plain(exact)


def test_vector_index_of_nothing_and_of_one(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, v array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, q array<double>")
    assert VectorIndex.build(none, str(tmp_path / "none")).search(queries, 3)[0].count() == 0
    one = spark.createDataFrame([(7, [2.0, 0.0])], none.schema)
    assert [tuple(r) for r in VectorIndex.build(one, str(tmp_path / "one")).search(queries, 3)[0].collect()] == [(1, 7, 1.0, 1)]


@pytest.mark.parametrize("name, exact, key", [("re_ann_topk", "re_vector", "vec_id"), ("re_ann_chunks", "chunks", "chunk_id")])
def test_recall_of_the_queries(spark, name, exact, key):
    sf = f"{DATA}/sf0.01"
    truth = searches._vectors(spark, sf, 10) if exact == "re_vector" else searches._vector(spark, sf, 10)
    assert recall(getattr(indexes, name)(spark, sf), truth, key) >= 0.9


def test_substrings_through_grams(spark, tmp_path):
    rng = np.random.default_rng(2)
    texts = [(f"ns{i % 3}", i, "".join(rng.choice(list("abAB 1é"), int(rng.integers(0, 30))))) for i in range(400)] + [("ns0", 500, None), ("ns0", 501, ""), ("ns1", 502, "aaaa" * 20)]
    asked = [(0, "ns0", "ab"), (1, "ns1", "AAAA a"), (2, "ns2", "é1 ab ab"), (3, "ns0", "  "), (4, "ns1", "zzz"), (5, "ns2", "abab ab1"), (6, None, "ab"), (7, "ns0", "a\\1 %_")]
    df, requests = spark.createDataFrame(texts, "ns string, memory_id long, text string"), spark.createDataFrame(asked, "qid long, ns string, text string")
    index = GramIndex.build(df, str(tmp_path / "grams"))
    got = sorted(map(tuple, RE.substring_scores(index, df, requests).collect()))
    want = []
    for q, ns, text in asked:
        for n, i, t in texts:
            score = sum((t or "").lower().count(w) for w in text.lower().split())
            if n == ns and score:
                want.append((q, i, score))
    assert got == sorted(want)
    terms = spark.createDataFrame([(1, "ns1", "aaaa"), (2, "ns2", "abab")], "qid long, ns string, term string")
    assert index.candidates(terms, RE.if_small).count() < df.count() / 8


@pytest.mark.parametrize("theta, block", [(0.82, 16), (0.65, 40), (0.82, 2048)])
def test_greedy_clusters_of_groups_over_a_block(spark, theta, block):
    rng = np.random.default_rng(3)
    base, rows = rng.normal(size=(12, 6)), []
    for g, n in enumerate((150, 45, 5)):
        rows += [(g, i, (base[rng.integers(12)] + rng.normal(size=6) * rng.choice([0, 0.2, 0.5])).tolist()) for i in range(n)]
    rows += [(0, 1000, [0.0] * 6), (0, 1001, [0.0] * 6), (0, 1002, None)]
    # A chain, in which each is near the next only: seeds are found one after another.
    rows += [(9, i, [float(np.cos(i * 0.5)), float(np.sin(i * 0.5)), 0.0, 0.0, 0.0, 0.0]) for i in range(6)]
    want = {}
    for g in {r[0] for r in rows}:
        seeds = []
        for _, i, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            x = np.array(v or [0] * 6, float)
            x = x / np.linalg.norm(x) if x.any() else x
            near = next((s for s, y in seeds if x @ y >= theta - 1e-12), None)
            want[g, i] = i if near is None else near
            if near is None:
                seeds.append((i, x))
    df = spark.createDataFrame(rows, "g long, o long, v array<double>")
    got = clusters.greedy_clusters(df, "g", "o", theta, block=block)
    assert {(r.grp, r.id): r.seed for r in got.collect()} == want
    assert clusters.greedy_clusters(df.limit(0), "g", "o", theta).count() == 0
    refs = df.select(F.col("g").alias("grp"), F.col("o").alias("id"), F.explode(F.array(F.lit("all"), (F.col("o") % 4).cast("string"))).alias("ref"))
    merged = {}
    for r in sorted(clusters.merged_refs(got, refs).collect(), key=lambda r: r.place):
        merged.setdefault((r.grp, r.seed), []).append(r.ref)
    for (g, seed), found in merged.items():
        members = sorted(i for (h, i), s in want.items() if (h, s) == (g, seed))
        assert found == list(dict.fromkeys(ref for i in members for ref in sorted((str(i % 4), "all"))))


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_ranked_values(spark, q):
    rng = np.random.default_rng(4)
    rows = [("a", float(v)) for v in rng.integers(0, 50, 3000)] + [("b", float(v)) for v in np.exp(rng.normal(size=2000) * 8)] + [("c", 5.0)] * 7 + [("d", -1.5), (None, 2.0), ("a", None), ("e", None)]
    got = {r.g: r.ranked for r in aggregates.ranked_values(spark.createDataFrame(rows, "g string, v double"), "g", "v", q).collect()}
    want = {}
    for g in {"a", "b", "c", "d", None}:
        values = sorted(v for h, v in rows if h == g and v is not None)
        want[g] = values[min(int(np.floor(q * len(values))), len(values) - 1)]
    assert got == want


def brute_density(words, terms):
    """By trying all stretches: those that hold all terms and have none within that does."""
    good = [(i, j) for i in range(len(words)) for j in range(i, len(words)) if set(terms) <= set(words[i : j + 1])]
    return sum(1 / (j - i + 1) for i, j in good if not any((a, b) != (i, j) and i <= a and b <= j for a, b in good)) if terms else 0.0


def test_cover_density(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [f"w{k}" for k in rng.integers(0, 6, int(rng.integers(0, 30)))], [f"w{k}" for k in range(int(rng.integers(0, 4)))]) for i in range(60)]
    df = spark.createDataFrame(rows, "i long, words array<string>, terms array<string>")
    got = {r.i: r.d for r in df.select("i", RE.cover_density(F.col("words"), F.col("terms")).alias("d")).collect()}
    assert all(abs(got[i] - brute_density(w, t)) < 1e-9 for i, w, t in rows) and any(got.values())


def test_phrases_of_any_length(spark):
    sf = f"{DATA}/sf0.001"
    st = searches.store(spark, sf)
    texts = [(r.chunk_id, r.text.lower()) for r in st.chunks.collect()]
    some = next(t for _, t in texts if len(t.split()) > 20)
    phrases = [some[3:9], some[2:40], some[5:14], "e", " t", ". ", "zzqqzz", "the the the", some[:200], "?", "e t"]
    got = RE.phrase_hits(st, spark.createDataFrame(list(enumerate(phrases)), "qid long, phrase string")).collect()
    assert sorted(map(tuple, got)) == sorted((i, c) for i, p in enumerate(phrases) for c, t in texts if p in t)


def brute_chunks(words, phrase):
    """Ordinals of the chunks of 80 words, 60 apart, that have a word of an occurrence of the phrase."""
    text, starts, hit, at = " ".join(words), [], set(), 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    p = text.find(phrase)
    while p >= 0:
        own = [k for k, b in enumerate(starts) if b < p + len(phrase) and b + len(words[k]) > p]
        hit |= {o for o in range(max(0, -(-(len(words) - 80) // 60)) + 1) if any(60 * o <= k < 60 * o + 80 for k in own)}
        p = text.find(phrase, p + 1)
    return hit


def test_phrases_are_found_across_the_ends_of_chunks(spark):
    from mnemospark.sources.chunk_store import ChunkStore, shared_dir

    rng = np.random.default_rng(8)
    words = [[f"w{k}" for k in rng.integers(0, 300, n)] for n in (500, 75, 81, 260)]
    words[3][70:110] = words[0][30:70]
    contents = ["\n".join(" ".join(w[i : i + 7]) for i in range(0, len(w), 7)) for w in words] + ["", None]
    texts = spark.createDataFrame(list(enumerate(contents)), "a long, content string").select(F.col("a").cast("string").alias("artifact_id"), F.coalesce("content", F.lit("")).alias("content"))
    chunks = texts.select("artifact_id", F.posexplode(T.word_chunks("content", 80, 20)).alias("ordinal", "text")).withColumn("chunk_id", F.concat_ws(":", "artifact_id", "ordinal"))
    st = ChunkStore.build(chunks, f"{shared_dir(spark)}/across")
    phrases = [" ".join(words[0][30:70]).upper(), "\n".join(words[0][50:95]), " ".join(words[0][20:280]), "  ".join(words[2][75:81]), words[0][79] + " " + words[0][80], words[0][7][1:], "zzq", "w1 w2 zzq", ".", None]
    got = RE.whole_text_hits(st, texts, spark.createDataFrame(list(enumerate(phrases)), "qid long, phrase string")).collect()
    want = {(q, f"{a}:{o}") for q, p in enumerate(phrases) if p for a, w in enumerate(words) for o in brute_chunks(w, " ".join(p.lower().split()))}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert {c for q, c in want if q == 0} == {"0:0", "0:1", "3:0", "3:1"} and len([c for q, c in want if q == 2]) == 5


def test_questions_are_found_in_whole_texts(spark):
    sf = f"{DATA}/sf0.01"
    flat = lambda t: " ".join((t or "").lower().split())
    texts = [(str(r.doc_id), flat(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    asked = [(r.item_id, flat(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {(q, a) for q, p in asked for a, t in texts if p in t}
    got = {(r.qid, r.chunk_id.split(":")[0]) for r in searches.re_substring_scan(spark, sf).collect()}
    assert got == want and len(want) == 26


@pytest.mark.parametrize("word, want", [("studies", "study"), ("classes", "class"), ("cats", "cat"), ("bus", "bus"), ("this", "this"), ("running", "runn"), ("sing", "sing"), ("tested", "test"), ("quickly", "quick"), ("is", "is"), ("", "")])
def test_stem(spark, word, want):
    from mnemospark.functions import text as T

    assert spark.range(1).select(T.stem(F.lit(word))).first()[0] == want
