"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mnemospark.llm import op1_mix, op2_warc, op3_grid_join, op4_preferences, op5_toxicity, op6_images, op7_superminhash, op8_lengths, op9_licenses, op10_pack
from mnemospark.llm.common import components, scratch_path
from mnemospark.llm.tokens import Encoder, default_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")
BASE = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark wood again today"


def documents(spark):
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [
        (1, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (3, BASE.upper() + "\n", "en", "b", 1), (4, BASE + " indeed", "en", "b", 1), (5, None, "en", "a", None), (6, "", None, None, 0), (7, "  \t\n", "en", "b", 4),
        (8, "one two", "en", None, 7), (9, "ONE  two", "en", "é", 8), (10, long, "en", "a", 1), (None, BASE, "en", "a", 1), (11, "x\x00y naïve ﬁ Σίσυφος 漢字 \U0001f600 <|endoftext|>", "en", "é", 1), (12, "same", "en", "a", 4), (12, "same", "en", "a", 4),
    ]
    return spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("x")).withColumn("target", F.lit(1)).withColumn("position", F.lit(None).cast("string")).withColumn("sig", F.lit(0)).withColumn("id", F.lit("i"))


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    up = list(range(2000))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = {r.id: r.component for r in components(spark, spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: top(x) for p in pairs if p[0] != p[1] for x in p}
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_mix(spark):
    docs = documents(spark)
    got = op1_mix.mix(docs).collect()
    assert len(got) == docs.count()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r["size"]
    for rows in by.values():
        assert sum(r.taken for r in rows) == round(rows[0].target) and rows[0].target <= 2 * rows[0].source_size
    total = sum(r["size"] for r in got)
    assert abs(sum(rows[0].target for rows in by.values()) - 1.5 * total) < 0.01
    assert sorted(map(str, op1_mix.mix(docs).collect())) == sorted(map(str, got))
    placed = [r.position for r in got if r.position is not None]
    assert placed == sorted(placed)
    out = op1_mix.mixed_documents(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.source] += len(WORD.findall(r.text or ""))
    assert all(words[k] == sum(r.taken for r in rows) for k, rows in by.items())
    assert op1_mix.mix(empty(spark)).count() == 0


def test_mixing_gives_clashing_columns_back(spark):
    names = ["kind", "size", "source_size", "target", "taken", "position", "words_before", "weight", "with space", "a.b"]
    docs = spark.createDataFrame([(i if i % 3 else None, "a" if i % 2 else None, f"w{i} " * (i % 5), *([f"own{i}"] * len(names))) for i in range(40)], ["doc_id", "source", "text", *names])
    out = op1_mix.mixed_documents(docs, positions=True)
    assert out.columns == [*docs.columns, "__position"]
    own = {r.text.strip().split(" ")[0][1:]: r for r in docs.collect() if r.text.strip()}
    rows = out.collect()
    for r in rows:
        if r.text.strip():
            whole = own[r.text.strip().split(" ")[0][1:]]
            assert tuple(r)[:2] == tuple(whole)[:2] and tuple(r)[3:-1] == tuple(whole)[3:]
    assert rows and [r[-1] for r in rows] == sorted(r[-1] for r in rows)
    assert {"kind", "taken"} <= set(op1_mix.mix(docs).columns)


def test_each_pass_has_its_own_place(spark):
    docs = spark.createDataFrame([(i, "a", " ".join(f"w{i}_{k}" for k in range(1 + i % 7))) for i in range(60)] + [(100 + i, "b", "x " * 30) for i in range(40)], "doc_id long, source string, text string")
    plan = {r.source: r for r in op1_mix.mix(docs).collect()}
    out = op1_mix.mixed_documents(docs, positions=True).collect()
    assert [r[-1] for r in out] == sorted(r[-1] for r in out)
    assert plan["a"].target == 2 * plan["a"].source_size
    # Brute force: the source's words end to end, twice, and the schedule's integral summed over small steps.
    rows = sorted((r for r in op1_mix.mix(docs).collect() if r.source == "a"), key=lambda r: r.words_before)
    knots = op1_mix.SCHEDULES[0]
    grid = np.linspace(0, 1, 200_001)
    rate = np.interp(grid, *zip(*knots, strict=True))
    asked = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2)])
    asked /= asked[-1]
    want, at = [], 0
    for _ in range(2):
        for r in rows:
            want.append((np.interp((at + r["size"] / 2) / plan["a"].target, asked, grid), r.doc_id))
            at += r["size"]
    got = [(r[-1], r.doc_id) for r in out if r.source == "a"]
    assert [i for _, i in got] == [i for _, i in want]
    assert np.allclose([x for x, _ in got], [x for x, _ in want], atol=1e-4)
    assert [r.doc_id for r in op1_mix.mixed_documents(docs).collect()] == [r.doc_id for r in out]


def test_targets_stop_at_twice_the_source(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), ("d", 0)], "source string, size long")
    got = {r.source: r.target for r in op1_mix.source_plan(sized).collect()}
    assert got["a"] == 20 and got["d"] == 0 and got["c"] == 1000
    assert got["b"] == pytest.approx(1.5 * 1510 - 1020)


def test_warc(spark):
    rows = [(3, "http://a/", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "http://b/\r\nX: y", None), (4, "", ""), (None, "u", "solo"), (None, "u", "<p>é</p>"), (5, "u", "x" * 3_000_000), (6, "v", "other"), (6, "v", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("first", F.lit("f"))
    folder = scratch_path(spark, "warc")
    made = op2_warc.write_archives(op2_warc.with_decisions(pages), folder, 1 << 20)
    made.write.parquet(folder + "-m")
    got = op2_warc.read_archives(spark.read.parquet(folder + "-m")).collect()
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        first = least.get(h or "")
        revisit = first is not None and i != first
        want.append((i, len(body), op2_warc.base32_digest(body), "revisit" if revisit else "response", first if revisit else None))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert op2_warc.with_decisions(pages.limit(0)).count() == 0


def test_archive_records_are_read_alone():
    import struct

    import zstandard

    raw = [op2_warc.record(i, f"http://x/{i}", (f"<html>{BASE} {i}</html>" * 20).encode(), "D", None, False) for i in range(200)]
    data, offsets = op2_warc.archive(raw)
    assert list(op2_warc.read_archive(data)) == raw
    magic, size = struct.unpack_from("<II", data)
    assert magic == op2_warc.SKIPPABLE
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    assert unpack.decompressobj().decompress(data[offsets[77] : offsets[78]]) == raw[77]
    assert list(op2_warc.read_archive(op2_warc.archive(raw[:1])[0])) == raw[:1]
    with pytest.raises(ValueError):
        op2_warc.parse(raw[0][:-3])


def test_grid_join(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 8))
    rows = [(i, (base[i % 60] + rng.normal(size=8) * (0.15 if i >= 60 else 0)).tolist()) for i in range(240)]
    rows += [(300, rows[0][1]), (301, [2 * x for x in rows[0][1]]), (302, None), (303, [0.0] * 8), (304, [float("nan")] + [1.0] * 7), (305, [None] + [1.0] * 7), (306, [1.0, 2.0]), (307, [1.0, 2.0]), (308, []), (None, rows[0][1]), (309, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("id", F.lit("q"))
    good = {i: np.array(v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    link = {i: {j for j in unit if j != i and len(unit[j]) == len(unit[i]) and unit[i] @ unit[j] >= 0.95} for i in unit}
    comp = {}
    for i in sorted(unit):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in comp:
                comp[j] = i
                todo += link[j]
    got = {r.vec_id: (r.n_links, r.component_id) for r in op3_grid_join.grid_join(df, tile=32, leaf=8, fan=2).collect()}
    assert got == {i: (len(link.get(i, ())), comp.get(i, i)) for i, _ in rows}
    assert sum(map(len, link.values())) > 50
    assert op3_grid_join.grid_join(df.limit(0)).count() == 0


def test_preferences(spark):
    schema = "pair_id long, turn long, role string, text string, part string"
    a = spark.createDataFrame([(1, 0, "user", "hi", "x"), (1, 1, "assistant", "good", "x"), (2, 0, "user", None, "x"), (3, 0, "user", "only", "x"), (None, 0, None, "<|im_end|>", "x"), (4, None, "user", "n", "x"), (4, 0, "user", "t", "x"), (4, 0, "user", "t", "x")], schema)
    b = spark.createDataFrame([(1, 0, "user", "hi", "y"), (1, 1, "assistant", "bad", "y"), (2, 0, "user", None, "y"), (None, 0, None, "<|im_end|>", "y"), (4, None, "user", "n", "y"), (4, 0, "user", "t", "y")], schema)
    parts = op4_preferences.preference_parts(a, b)
    got = {r.pair_id: (r.prompt, r.chosen, r.rejected) for r in op4_preferences.assembled(parts).collect()}
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert got[1] == (turn("user", "hi"), turn("assistant", "good"), turn("assistant", "bad"))
    pair = {r.pair_id: r for r in op4_preferences.assembled(parts).collect()}
    assert [pair[1].chosen[a : a + n] for a, n in pair[1].chosen_loss] == ["good<|im_end|>"] and [pair[1].rejected[a : a + n] for a, n in pair[1].rejected_loss] == ["bad<|im_end|>"]
    assert pair[4].chosen_loss == [] and pair[2].rejected_loss == []
    assert got[2] == (turn("user", ""), "", "") and got[3] == ("", turn("user", "only"), "")
    assert got[None] == (turn("", "<im_end>"), "", "")
    assert got[4] == (turn("user", "n"), turn("user", "t") * 2, turn("user", "t"))
    for r in parts.collect():
        lost = r.rendered[r.loss_start : r.loss_start + r.loss_length]
        assert lost == (r.rendered.split("\n", 1)[1][:-1] if r.part != "prompt" and r.role == "assistant" else "")
    assert op4_preferences.preference_parts(a.limit(0), b.limit(0)).count() == 0


def test_pairs_mask_every_answer(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"{s}{t}") for s in "ab" for t in range(6)]
    a, b = (spark.createDataFrame([r for r in rows if r[3][0] == s], "pair_id long, turn long, role string, text string") for s in "ab")
    r = op4_preferences.assembled(op4_preferences.preference_parts(a, b)).first()
    assert r.prompt == "" and [r.chosen[x.start : x.start + x.length] for x in r.chosen_loss] == [f"a{t}<|im_end|>" for t in (1, 3, 5)]


def test_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    chain = op5_toxicity.fit_chain(docs, labels.where("doc_id % 5 <> 0"), sample_rows=3000)
    held = op5_toxicity.score(docs.join(labels.where("doc_id % 5 = 0"), "doc_id", "left_semi"), chain).join(labels, "doc_id").toPandas()
    toxic = held.toxic == 1
    assert (held.rejected & toxic).sum() >= 0.85 * toxic.sum()
    assert (held.rejected & ~toxic).sum() <= 0.01 * (~toxic).sum()
    odd = documents(spark).withColumn("has", F.lit(1))
    assert op5_toxicity.score(odd, chain).count() == odd.count()
    assert op5_toxicity.without_toxic(odd, chain).columns == odd.columns
    none = op5_toxicity.fit_chain(docs, labels.limit(0))
    assert op5_toxicity.score(odd, none).where("p_toxic <> 0.5").count() == 0
    assert op5_toxicity.score(empty(spark), none).count() == 0


def test_nothing_is_rejected_without_labels_of_both_kinds(spark):
    docs = documents(spark)
    labels = docs.select("doc_id").where("doc_id is not null").distinct().select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    for some in (labels.limit(0), labels, labels.withColumn("toxic", F.lit(1)), labels.withColumn("doc_id", F.col("doc_id") + 10**9)):
        chain = op5_toxicity.fit_chain(docs, some)
        assert op5_toxicity.without_toxic(docs, chain).count() == docs.count()
        assert op5_toxicity.score(docs, chain).where("rejected").count() == 0


def test_chain_feeds_out_of_fold_probabilities_forward(spark):
    """On invented rows whose second category is the first one plus a word, the chain beats models that know words only."""
    rng = np.random.default_rng(8)
    rows, marks = [], []
    for i in range(1200):
        junk, cue = bool(rng.integers(2)), bool(rng.integers(2))
        words = [f"plain{rng.integers(60)}" for _ in range(12)] + ([f"junk{rng.integers(12)}"] if junk else []) + (["trigger"] if cue else [])
        rows.append((i, " ".join(rng.permutation(words))))
        marks.append((i, int(not junk), int(junk and cue)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    chain = op5_toxicity.fit_chain(docs, labels.where("doc_id < 800"))
    held = {r.doc_id: r for r in op5_toxicity.score(docs.where("doc_id >= 800"), chain).collect()}
    right = np.mean([held[i].rejected == bool(t) for i, _, t in marks[800:]])
    alone = op5_toxicity.fit_chain(docs, labels.where("doc_id < 800"), (("toxic", 1),))
    other = np.mean([r.rejected == bool(marks[r.doc_id][2]) for r in op5_toxicity.score(docs.where("doc_id >= 800"), alone).collect()])
    assert right >= other and right >= 0.97
    assert chain.weights[1][len(chain.features)] > 0.5 and chain.weights[0][len(chain.features)] == 0


def test_repeated_ids_stay_within_the_sample(spark):
    docs = spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text number "), F.col("id")).alias("text")).unionByName(spark.range(2, 40).select(F.col("id").alias("doc_id"), F.lit("other words").alias("text")))
    labels = docs.select("doc_id").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    assert op5_toxicity.score(docs, op5_toxicity.fit_chain(docs, labels, sample_rows=20)).count() == docs.count()


def test_pipeline_stages_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    chain = op5_toxicity.fit_chain(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    place, size, hasher, want = {int(f): i for i, f in enumerate(chain.features)}, len(chain.features), op5_toxicity.SpanHasher(), set()
    for r in rows:
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        found = {int(x) for h, _ in op5_toxicity.text_features(raw, np.array([0, len(raw)]), hasher, op5_toxicity.byte_class("alnum")) for x in h}
        p = []
        for w in chain.weights:
            z = w[-1] + sum(w[place[f]] for f in found if f in place) + sum(w[size + k] * q for k, q in enumerate(p))
            p.append(1 / (1 + np.exp(-z)))
        if p[-1] < 0.5:
            want.add(r.doc_id)
    stages = dict(corpus_pipeline.STAGES)
    assert {r.doc_id for r in stages["toxicity"](spark, docs, sf).collect()} == want and len(want) < len(rows)
    groups = brute_components([(r.doc_id, r.text) for r in rows])
    assert sorted(r.doc_id for r in stages["near_duplicates"](spark, docs, sf).collect()) == sorted(i for i, (_, top) in groups.items() if top == i)
    plan = {(r.doc_id): r for r in op1_mix.mix(docs).collect()}
    words = Counter()
    for r in stages["mixing"](spark, docs, sf).collect():
        words[r.doc_id] += len(WORD.findall(r.text or ""))
    assert {i: n for i, n in words.items() if n} == {i: r.taken for i, r in plan.items() if r.taken}


def test_images(spark):
    vectors = spark.range(40).select(F.col("id").alias("vec_id"), F.array(F.lit(0.3)).cast("array<float>").alias("embedding"))
    media = op6_images.rendered_media(vectors).toPandas()
    rows = [(int(r.image_id), bytes(r.media)) for r in media.itertuples()] + [(100, bytes(media.media[0])), (101, None), (102, b"junk"), (103, b"P5\n3 3\n255\n" + b"\x01" * 9), (None, bytes(media.media[0])), (104, b"P5\n9 9\n255\n\x00")]
    df = spark.createDataFrame(rows, "image_id long, media binary").withColumn("bits", F.lit(1)).withColumn("id", F.lit("q"))
    got = op6_images.image_copies(df).collect()
    comp = {r.image_id: r.component_id for r in got}
    assert len(got) == len(rows) and comp[100] == comp[0] and comp[None] is None
    assert all(comp[i] == i for i in (101, 102, 103, 104))
    assert all(comp[i] // 4 == i // 4 for i in range(40))
    assert sum(comp[i] == i // 4 * 4 for i in range(40)) >= 38
    assert op6_images.image_copies(df.limit(0)).count() == 0


def turned(x, degrees):
    h, w = x.shape
    t, (y, z) = np.deg2rad(degrees), np.mgrid[:h, :w] - np.array([h / 2, w / 2])[:, None, None]
    sy, sx = -np.sin(t) * z + np.cos(t) * y + h / 2, np.cos(t) * z + np.sin(t) * y + w / 2
    i, j = sy.clip(0, h - 2).astype(int), sx.clip(0, w - 2).astype(int)
    u, v = (sy - i).clip(0, 1), (sx - j).clip(0, 1)
    return (1 - u) * ((1 - v) * x[i, j] + v * x[i, j + 1]) + u * ((1 - v) * x[i + 1, j] + v * x[i + 1, j + 1])


def test_large_pictures_cropped_rescaled_turned_and_noisy(spark):
    def scene(seed, side=360):
        rng, x = np.random.default_rng(seed), np.full((side, side), 100.0)
        for cells, height in ((26, 30.0), (52, 25.0), (110, 22.0), (180, 18.0)):
            x = x + height * op6_images.resize(rng.standard_normal((cells, cells)), side / cells + 1e-9)[:side, :side]
        return x.clip(0, 200)

    x, rng = scene(1), np.random.default_rng(9)
    copies = [x, x[150:330, 20:200], op6_images.resize(x, 0.5), op6_images.resize(x, 0.85), turned(x, 7), turned(x, 30), x + rng.normal(0, 8, x.shape), (turned(x, 12) + rng.normal(0, 3, x.shape))[80:280, 80:280]]
    pictures = [np.rint(p).clip(0, 255).astype(np.uint8) for p in [*copies, scene(2), scene(3)]]
    media = spark.createDataFrame([(i, b"P5\n%d %d\n255\n" % p.shape[::-1] + p.tobytes()) for i, p in enumerate(pictures)], "image_id long, media binary")
    got = {r.image_id: r for r in op6_images.image_copies(media).collect()}
    assert [got[i].component_id for i in range(len(pictures))] == [0] * len(copies) + [8, 9]
    assert got[0].n_corners > 3 * got[1].n_corners > 1000


def blurred(x):
    return op6_images.box(x, 1)


def test_recall_by_edit():
    rng, found = np.random.default_rng(1), defaultdict(list)
    whole = lambda x: op6_images.describe(np.rint(x).clip(0, 255)[None].astype(np.float32))[0]
    for k in range(60):
        x = op6_images.draw_scene(k, 72)
        edits = {"crop": x[8:66, 10:68], "brightness": x * 0.8 + 35, "blur": blurred(x), "noise": x + rng.normal(0, 4, x.shape), **{f: op6_images.resize(x, f) for f in (0.8, 0.9, 1.1, 1.2)}}
        places, bits, _ = whole(x)
        for name, y in edits.items():
            there, other, _ = whole(y)
            met = len(np.intersect1d(op6_images.keys(bits.tobytes()), op6_images.keys(other.tobytes())))
            found[name].append(met >= op6_images.VOTES and op6_images.consensus(places, bits, there, other) > 0)
    assert {name: np.mean(x) >= 0.9 for name, x in found.items()} == dict.fromkeys(found, True)


def brute_images(raws):
    """Components by comparison of all pairs: entries in common, then consensus."""
    parts = {i: op6_images.describe(op6_images.read_media(raw)[None].astype(np.float32))[0] for i, raw in raws}
    keys = {i: np.unique(op6_images.keys(p[1].tobytes())) for i, p in parts.items()}
    places = {i: op6_images.unpacked(op6_images.packed(p[0])) for i, p in parts.items()}
    up = {i: i for i in parts}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in parts:
        for j in parts:
            if i < j and len(np.intersect1d(keys[i], keys[j])) >= op6_images.VOTES and op6_images.consensus(places[i], parts[i][1], places[j], parts[j][1]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in parts}


def test_images_equal_the_comparison_of_all_pairs(spark):
    vectors = spark.range(96).select(F.col("id").alias("vec_id"), F.array((F.col("id") % 7 / 7).cast("float")).alias("embedding"))
    raws = [(r.image_id, bytes(r.media)) for r in op6_images.rendered_media(vectors).collect()]
    media = spark.createDataFrame(raws, "image_id long, media binary")
    want = brute_images(raws)
    assert sum(c != i for i, c in want.items()) >= 68 and all(c // 4 == i // 4 for i, c in want.items())
    whole = {r.image_id: r.component_id for r in op6_images.image_copies(media, hot=1 << 20).collect()}
    assert whole == want
    for hot, block, least in ((6, 256, 0.95), (2, 16, 0.7), (1, 8, 0.5)):  # entries split by neighbours, and families
        got = {r.image_id: r.component_id for r in op6_images.image_copies(media, hot=hot, block=block).collect()}
        assert all(want[c] == want[i] for i, c in got.items())
        share = sum(got[i] == want[i] for i in want) / len(want)
        assert share >= least, (hot, share)


def test_full_entries_lose_no_link(spark):
    vectors = spark.range(96).select(F.col("id").alias("vec_id"), F.array((F.col("id") % 7 / 7).cast("float")).alias("embedding"))
    raws = [(r.image_id, bytes(r.media)) for r in op6_images.rendered_media(vectors).collect()]
    want = brute_images(raws)
    media = spark.createDataFrame(raws, "image_id long, media binary")
    for hot, block in ((1, 40), (2, 1024)):
        assert {r.image_id: r.component_id for r in op6_images.image_copies(media, hot=hot, block=block).collect()} == want


def test_agreeing_leaves_out_nothing_that_is_confirmed():
    rng = np.random.default_rng(2)
    whole = lambda x: op6_images.describe(np.rint(x).clip(0, 255)[None].astype(np.float32))[0][:2]
    scenes = [op6_images.draw_scene(k, 72) for k in range(24)]
    left, right = [whole(x) for x in scenes], [whole(op6_images.resize(x, (0.8, 0.9, 1.1)[k % 3]) + rng.normal(0, 3 * (k % 2))) for k, x in enumerate(scenes)]
    left[5] = right[6] = (np.zeros((0, 4)), np.zeros((0, op6_images.BITS // 8), np.uint8))
    pairs = np.array([(i, j) for i in range(24) for j in range(24)])
    kept = set(map(tuple, op6_images.agreeing(left, right, pairs).tolist()))
    true = {(i, j) for i, j in pairs.tolist() if i != 5 and j != 6 and op6_images.consensus(*left[i], *right[j])}
    assert len(true) >= 15 and true <= kept and len(kept) < 100
    assert len(op6_images.agreeing(left, right, pairs[:0])) == 0


def test_agreeing_counts_corners_by_their_turn():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 256, (12, op6_images.BITS // 8), dtype=np.uint8)
    places = np.column_stack([rng.uniform(10, 60, (12, 2)), rng.uniform(-3, 3, 12), np.ones(12)])
    turn = lambda angles: np.column_stack([places[:, :2], places[:, 2] + angles, places[:, 3]])
    # Twelve matches, of which five at most have like turns; then all of them, across the end of the circle too.
    spread, like = turn(np.arange(12) % 3 * 2.0), turn(np.full(12, 1.0))
    like[:, 2] = (like[:, 2] + np.pi) % (2 * np.pi) - np.pi
    shifted = (like[:, 0] + 1j * like[:, 1]) * np.exp(1j)
    like[:, :2] = np.column_stack([shifted.real, shifted.imag])
    # Eight corners near one place match one corner of the other; its five others match at other turns.
    crowd = np.concatenate([np.column_stack([30 + rng.uniform(0, 0.5, (8, 2)), np.zeros(8), np.ones(8)]), np.column_stack([places[1:6, :2], np.arange(1, 6) * 1.2, np.ones(5)])]), bits[[0] * 8 + [1, 2, 3, 4, 5]]
    single = np.column_stack([places[:6, :2], np.zeros(6), np.ones(6)]), bits[:6]
    unlike, few = (places, ~bits), (places[:5], bits[:5])
    left, right = [(places, bits), crowd], [(spread, bits), (like, bits), single, unlike, few]
    pairs = np.array([(i, j) for i in range(2) for j in range(5)])
    assert op6_images.agreeing(left, right, pairs).tolist() == [[0, 1]]
    assert [(i, j) for i, j in pairs.tolist() if op6_images.consensus(*left[i], *right[j])] == [(0, 1)]
    many = np.zeros((1100, 4)), rng.integers(0, 256, (1100, op6_images.BITS // 8), dtype=np.uint8)  # left to consensus
    assert op6_images.agreeing([many], [many], np.array([(0, 0)])).tolist() == [[0, 0]]


def test_parts_of_entries_are_the_same_wherever_they_lie(spark):
    from mnemospark.llm.common import Kept

    vectors = spark.range(40).select(F.col("id").alias("vec_id"), F.array(F.lit(0.5).cast("float")).alias("embedding"))
    raws = [(r.image_id, bytes(r.media)) for r in op6_images.rendered_media(vectors).collect()]
    classes = op6_images.descriptors(spark.createDataFrame(raws, "image_id long, media binary"), "image_id", "media").select("id", "places", "bits", "near")
    found = [[sorted(map(tuple, df.collect())) for df in op6_images.image_votes(Kept(spark), classes, 2, large)] for large in (1 << 16, 6, 0)]
    assert found[0] == found[1] == found[2] and len(found[0][0]) > 20


def test_sized_parts_by_hand(spark):
    rows = [(1, 5, 10, 0, 0), (1, 5, 10, 0, 0), (1, 5, 11, 0, 0), (1, 5, 11, 2, 0), (1, 6, 10, 0, 0), (1, 6, 10, 1, 0), (2, 5, 9, 0, 0), (2, 5, 8, 0, 0)]
    got = op6_images.sized(spark.createDataFrame(rows, "entry long, p int, id long, n2 int, n34 int"))
    assert sorted((r.id, r.n2, r.n, r.centre) for r in got.collect()) == [(8, 0, 2, 8), (9, 0, 2, 8), (10, 0, 3, 10), (11, 0, 3, 10), (11, 2, 3, 10)]


def test_full_entries_make_few_rows(spark):
    rows = spark.range(400).select(F.lit(7).cast("long").alias("entry"), "id", (F.col("id") % 40 + 1).cast("int").alias("n1"), (F.col("id") % 50 + 1).cast("int").alias("n2"))
    assert op6_images.meetings(op6_images.shared(rows), 6).count() == 0
    few = rows.where("id < 5").unionByName(rows.where("id < 2"))
    assert sorted(map(tuple, op6_images.meetings(op6_images.shared(few), 7).collect())) == [(a, b) for a in range(5) for b in range(a + 1, 5)]
    raw = bytes(op6_images.rendered_media(spark.range(1).select(F.col("id").alias("vec_id"), F.array(F.lit(0.5)).cast("array<float>").alias("embedding"))).first().media)
    places, bits, near = op6_images.describe(op6_images.read_media(raw)[None])[0]
    inside = spark.createDataFrame([(7, i, 50, i, op6_images.packed(places), bits.tobytes(), near.tobytes()) for i in range(50)], "family long, id long, n long, label long, places binary, bits binary, near binary")
    assert op6_images.confirmed_within(inside).count() == 49  # of 1,225 pairs


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = list(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_near_duplicates(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"v{i}" for i in range(500)]
    texts = []
    for g in range(6):
        words = list(rng.choice(vocabulary, 120))
        for k in range(25):
            own = list(words)
            for at in rng.choice(120, rng.integers(0, 7), replace=False):
                own[at] = vocabulary[rng.integers(500)]
            texts.append((1000 + 25 * g + k, " ".join(own)))
    docs = documents(spark)
    texts += [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None and r.doc_id != 12]
    more = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts if i >= 1000], DOCS)
    both = docs.select("doc_id", "text").unionByName(more.select("doc_id", "text")).withColumn("sig", F.lit(1)).withColumn("d1", F.lit("d"))
    want = brute_components(texts)
    for block in (8, 512):
        got = op7_superminhash.near_duplicates(both, block=block).collect()
        assert len(got) == both.count()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None and r.doc_id != 12} == want
        assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    one = op7_superminhash.one_of_each(both)
    assert one.columns == both.columns
    kept = Counter(r.doc_id for r in one.collect())
    assert kept[12] == 1 and kept[None] == 1 and {i for i in kept if i} == {i for i, (_, c) in want.items() if c == i} | {12}
    assert op7_superminhash.near_duplicates(empty(spark)).count() == 0


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    error = []
    for n in (10, 100, 2000):
        for share in (0.3, 0.75):
            common = int(2 * n * share / (1 + share))
            h = rng.integers(0, 2**64, 2 * n - common, dtype=np.uint64)
            a, b = h[:n], h[n - common :]
            sig = op7_superminhash.superminhash(np.concatenate([a, b]), np.repeat([0, 1], n), 2, 256)
            error.append(abs((sig[0] == sig[1]).mean() - common / (2 * n - common)))
    assert max(error) < 0.12 and np.mean(error) < 0.05


def test_lengths(spark):
    docs = documents(spark)
    enc = Encoder(default_path())
    sizes = sorted(len(enc.encode(r.text or "")) // 2 for r in docs.collect())
    hist = op8_lengths.length_histogram(op8_lengths.encoded_lengths(docs, default_path()), block=4).orderBy("length")
    rows = hist.collect()
    assert [(r.length, r.n_docs) for r in rows] == sorted(Counter(sizes).items())
    for r in rows:
        assert r.docs_from == sum(s >= r.length for s in sizes) and r.tokens_from == sum(s for s in sizes if s >= r.length)
        assert r.tokens_kept == sum(min(s, r.length) for s in sizes) and r.tokens_cut == sum(sizes) - r.tokens_kept
    cut = op8_lengths.at_limit(hist, 30).first()
    assert cut.tokens_kept == sum(min(s, 30) for s in sizes) and cut.docs_fit == sum(s <= 30 for s in sizes)
    assert hist.agg(op8_lengths.length_quantile(hist, 0.5)).first()[0] == sizes[(len(sizes) + 1) // 2 - 1]
    assert op8_lengths.length_histogram(op8_lengths.encoded_lengths(empty(spark), default_path())).count() == 0


def test_licenses(spark):
    rows = [(1, "Under the MIT license. under the  mit\nLICENSE"), (2, "Licensed under the Apache License, Version 2.0."), (3, "CC BY-NC"), (4, None), (5, ""), (6, "undér the mit license"), (7, "a\nReleased  under the MIT License.\nb"), (8, "licensed version of the public general thing"), (None, "cc by nc"), (1, "x"), (9, "cc by\x00nc")]
    got = op9_licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit(1)).withColumn("score", F.lit("s"))).collect()
    assert [(r.doc_id, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got[:3]] == [(1, 2, 1 - 1, 4, "mit"), (2, 1, 3, 3, "apache-2"), (3, 1, 0, 0, "cc-by-nc")]
    assert [r.n_words for r in got] == [8, 8, 3, 0, 0, 4, 7, 7, 3, 1, 3]
    assert (got[3].base_labels, got[3].labels, got[3].score, got[3].first_word) == ("", "", 0.0, None)
    assert got[5].n_base == 0 and "mit" in got[6].labels.split(",") and got[7].labels == "" and got[10].n_base == 1
    assert op9_licenses.scan(empty(spark)).count() == 0


def test_wrapped_license_notices(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\n modification, are permitted provided that"
    apache = "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n"
    texts = ["a b c " * 50 + bsd, bsd.replace(" ", "\n"), apache, "\n".join(f"{w} x y z" for w in bsd.split()), bsd[: bsd.index("\n")], "modification, are permitted\nor without\nRedistribution and use in"]
    texts += ["Redistribution and use in source and", "binary forms, with or without modification, are permitted", " ".join(f"{w} {'x ' * 20}" for w in bsd.split())]
    got = {r.doc_id: (r.labels, r.score) for r in op9_licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()}
    assert [got[i][0] for i in range(9)] == ["bsd", "bsd", "apache-2", "", "", "", "", "", ""]
    assert got[0][1] == got[1][1] == 1.0 and got[4][1] == 0.0


def test_whole_license_texts_in_paragraphs(spark):
    rng = np.random.default_rng(4)
    texts = {label: text for label, text in op9_licenses.TEMPLATES if len(text.split()) > 60}
    wrap = lambda text, n: "\n * ".join(" ".join(text.split()[i : i + n]) for i in range(0, len(text.split()), n))
    rows = [(k, f"/*\n * Some file.\n * {wrap(text, 9)}\n */\nint main;") for k, text in enumerate(texts.values())]
    rows += [(100 + k, " ".join(rng.permutation(text.split()[: len(text.split()) // 3]))) for k, text in enumerate(texts.values())]
    got = {r.doc_id: r for r in op9_licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, label in enumerate(texts):
        assert label in got[k].labels.split(",") and got[k].score == 1.0
        assert label not in got[100 + k].base_labels


def test_lines_equal_the_comparison_of_all_pairs(spark):
    """Blocks that are lines, against all templates one by one."""
    rng = np.random.default_rng(5)
    lines = []
    for _ in range(300):
        words = op9_licenses.TEMPLATES[rng.integers(len(op9_licenses.TEMPLATES))][1].split()[:30]
        own = [w for w in words if rng.random() < rng.choice([0.7, 0.85, 1.0])]
        lines.append(" ".join(rng.permutation(own + ["other"] * int(rng.integers(3)))))
    order = {w: i for i, w in enumerate(sorted({w for _, t in op9_licenses.TEMPLATES for w in t.split()}))}
    vocabulary = np.unique(np.concatenate(op9_licenses.hashed_words(list(order))))
    templates = [(v, x) for (v, _), x in zip(op9_licenses.TEMPLATES, op9_licenses.hashed_words([x for _, x in op9_licenses.TEMPLATES]), strict=True)]
    join = op9_licenses.Templates(templates, 0.8, vocabulary, rng.integers(0, 50, len(vocabulary)))
    hashes = op9_licenses.hashed_words(lines)
    block, h = np.repeat(np.arange(len(lines)), [len(h) for h in hashes]), np.concatenate(hashes)
    known = np.isin(h, vocabulary)
    block, t, share = join.matches(block[known], join.rank[np.searchsorted(vocabulary, h[known])])
    want = {}
    for b, line in enumerate(lines):
        for k, (_, text) in enumerate(op9_licenses.TEMPLATES):
            whole = set(text.split())
            if len(whole & set(line.split())) >= np.ceil(0.8 * len(whole) - 1e-9):
                want[b, k] = len(whole & set(line.split())) / len(whole)
    assert dict(zip(zip(block.tolist(), t.tolist(), strict=True), share.tolist(), strict=True)) == pytest.approx(want) and len(want) > 30


def test_runs_equal_the_comparison_of_all_runs(spark):
    """Every run of SPREAD times a template's words, one by one; lines and filling words between make no difference."""
    rng = np.random.default_rng(6)
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(int(rng.integers(1, 4))):
            words = op9_licenses.TEMPLATES[rng.integers(len(op9_licenses.TEMPLATES))][1].split()
            words = [w for w in words if rng.random() < rng.choice([0.8, 0.9, 1.0])]
            if rng.random() < 0.4:
                words = rng.permutation(words).tolist()
            gap = rng.choice([0.0, 0.3, 1.2])
            parts += [x for w in words for x in [w, *["filler"] * int(rng.poisson(gap))]] + ["the", "other"] * int(rng.integers(40))
        texts.append("".join(w + rng.choice([" ", "\n"], p=[0.9, 0.1]) for w in parts))
    texts += ["mit " * 5000, "released under the license " * 3000, "", None]
    want = []
    for text in texts:
        words, labels, score = (text or "").split(), set(), 0.0
        for label, template in op9_licenses.TEMPLATES:
            whole, length = set(template.split()), op9_licenses.SPREAD * len(template.split())
            places = [i for i, w in enumerate(words) if w in whole][:2000]
            best = max((len(whole & set(words[i : i + length])) for i in places), default=0)
            if best >= np.ceil(0.8 * len(whole) - 1e-9):
                labels.add(label)
                score = max(score, best / len(whole))
        want.append((",".join(sorted(labels)), score))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    got = {r.doc_id: (r.labels, r.score) for r in op9_licenses.scan(docs, phrases={}).collect()}
    assert [got[i][0] for i in range(len(texts))] == [x for x, _ in want] and len({x for x, _ in want}) > 8
    assert [got[i][1] for i in range(len(texts))] == pytest.approx([x for _, x in want])


def test_a_statement_is_found_whatever_stands_on_its_line(spark):
    words = op9_licenses.TEMPLATES[8][1].split()
    line = " ".join(x for k, w in enumerate(words) for x in ([w, "so"] if k % 2 else [w]))
    rows = [(1, line), (2, line + " filler" * 60), (3, "filler " * 60 + line), (4, "filler " * 100_000 + line + " filler" * 100_000), (5, (" filler" * 7).join(words))]
    got = {r.doc_id: (r.labels, r.score) for r in op9_licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(1, 5)] == [("mit", 1.0)] * 4 and got[5] == ("", 0.0)


def pieces_hold(docs, rows, window):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_path())
    want = Counter()
    for r in docs.collect():
        want[r.doc_id, tuple([*whole.encode(r.text or "", add_special_tokens=False).ids, 1])] += 1
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for (name, ids), n in want.items():
        own = sorted((r for r in by[name] if r.doc_tokens == len(ids)), key=lambda r: r.start)
        assert sum(r.length for r in own) == n * len(ids)
        for r in own:
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window and (at == window or at & (at - 1) == 0)


def test_shards_equal_postings_by_document(spark):
    rng = np.random.default_rng(11)
    docs = [rng.integers(0, 60, int(n)).astype("<u2") for n in [*rng.integers(1, 40, 50), 0, 1]]
    idf = rng.random(61)
    shard = op10_pack.Shard(docs, idf, 20.0, 1)
    want = [(t, i, int((ids == t).sum())) for t in range(60) for i, ids in enumerate(docs) if t != 1 and t in ids]
    assert [(int(t), int(i)) for t, i in zip(shard.term, shard.owner, strict=True)] == [w[:2] for w in want]
    weight = [idf[t] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(docs[i]) / 20.0)) for t, i, n in want]
    assert np.allclose(shard.weight, weight)
    for seed in (0, 7, 50, 51):
        shard.use(seed)
        score = {i: sum(w for (t, k, _), w in zip(want, weight, strict=True) if k == i and t in docs[seed]) for i in range(len(docs)) if not shard.used[i]}
        assert sorted(shard.nearest(seed).tolist()) == sorted(i for i, x in score.items() if x > 0)
        ranked = [score[i] for i in shard.nearest(seed).tolist()]
        assert all(x >= y - 1e-9 for x, y in zip(ranked, ranked[1:], strict=False))
    df, n, tokens = op10_pack.token_frequencies(spark.createDataFrame([(d.tobytes(),) for d in docs], "ids binary"), "<u2", 60)
    assert (n, tokens) == (len(docs), sum(map(len, docs))) and df.tolist() == [sum(t in d for d in docs) for t in range(61)]


def test_packing(spark):
    docs = documents(spark)
    rows = op10_pack.pack(docs, window=64, shard_tokens=3000).collect()
    pieces_hold(docs, rows, 64)
    assert op10_pack.pack(empty(spark)).count() == 0


def test_a_window_holds_what_is_nearest():
    rng = np.random.default_rng(4)
    topic = lambda t: (rng.choice(40, 30) + 100 * t + 2).astype("<u2")
    docs = [topic(i % 5) for i in range(40)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=1000)
    idf = np.log1p((40 - df + 0.5) / (df + 0.5))
    first = next(iter(op10_pack.pack_shard(docs, idf, 30.0, 120)))
    assert [i for i, _, _ in first] and all(i % 5 == 0 for i, _, _ in first)
    shard = op10_pack.Shard(docs, idf, 30.0)
    shard.use(3)
    score = [sum(idf[t] * (d == t).sum() * 2.2 / ((d == t).sum() + 1.2 * (0.25 + 0.75 * len(d) / 30.0)) for t in np.unique(docs[3])) for d in docs]
    assert shard.nearest(3).tolist() == [i for i in sorted(range(40), key=lambda i: (-round(score[i], 9), i)) if i != 3 and score[i] > 0]


def test_a_window_holds_no_document_twice(spark):
    rng = np.random.default_rng(6)
    docs = [(rng.choice(60, rng.integers(5, 90)) + 100 * (i % 4) + 2).astype("<u2") for i in range(120)]
    docs, names = docs + docs, [*range(120), *range(120)]
    idf = np.ones(1000)
    for sequence in op10_pack.pack_shard(docs, idf, 30.0, 128, names, 1):
        own = [names[i] for i, start, _ in sequence if not start]
        assert len(own) == len(set(own))
    twice = [np.array([5] * 40, "<u2")] * 4  # nothing else is left
    assert sum(n for s in op10_pack.pack_shard(twice, idf, 30.0, 64, [1] * 4, 1) for _, _, n in s) == 160
    sf = "/root/testdata/sf0.001"
    mixed = corpus_pipeline.mixing(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    windows = corpus_pipeline.packing(spark, mixed, sf).where("start = 0").groupBy("sequence_id", "doc_id").count().where("count > 1")
    assert mixed.groupBy("doc_id").count().where("count > 1").count() > 0 and windows.count() <= 1


def test_encoder_equals_the_tokenizer():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    whole, fast = Tokenizer.from_file(default_path()), Encoder(default_path())

    @settings(max_examples=400, deadline=None)
    @given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("abc'strevmldé ñ0²½.,\t  İΣ", max_size=60))
    def same(text):
        assert np.frombuffer(fast.encode(text), fast.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids

    same()
