"""Operators 11 to 13 on small tables and against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import op11_fill_in_middle as op11
from mnemospark.llm import op12_runs as op12
from mnemospark.llm import op13_main_text as op13
from test_llm_small import documents, empty

WORD = re.compile("[^\x20\x09-\x0d]+")
LINE = re.compile("[^\n]*\n|[^\n]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("text", ["", "\n", "one", "a\nb\n\nc", "é漢\U0001f600\nnaïve\n\n" * 150 + "end", "\n" * 200, "x" * 5000 + "\n" + "ü" * 3000 + "\n"])
@pytest.mark.parametrize("every, block", [(1, 1 << 20), (3, 7), (64, 1 << 20), (64, 100)])
def test_checkpoints_find_every_cut(text, every, block):
    lines = LINE.findall(text)
    index = op11.Checkpoints(np.frombuffer(text.encode(), np.uint8), every, block)
    assert (index.count, index.chars) == (len(lines), len(text))
    for u in range(len(lines) + 1):
        assert index.seek(u) == (len("".join(lines[:u]).encode()), len("".join(lines[:u])))


def fim(doc_id, text):
    text = text or ""
    lines = LINE.findall(text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return (doc_id, len(lines), "plain", None, None, sha(text), sha(text))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (doc_id, len(lines), form, len(p), len(m), sha(out), sha(text))


def test_fill_in_middle(spark):
    extra = [(100 + i, "".join(f"line {k} <P\né\n" for k in range(i * 7)), "en", "a", 1) for i in range(30)] + [(200, "a <S> b\nc", "en", "a", 1), (201, "<P\n>\n<M", "en", "a", 1), (202, "$1\\2|<\n(.*)\n", "en", "a", 1)]
    docs = documents(spark)
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True).withColumn("form", F.lit(1)).withColumn("output", F.lit(1))
    got = op11.fill_in_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256), F.sha2(op11.restored(F.col("output"), F.col("form")), 256))
    want = [fim(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert op11.fill_in_middle(empty(spark)).count() == 0
    none = op11.fill_in_middle(docs, rate=0)
    assert none.where("form <> 'plain'").count() == 0
    cut = op11.fill_in_middle(docs, sentinels=("[pre]", "[suf]", "[mid]"))
    texts = sorted((r.text or "") for r in docs.collect())
    assert sorted(r[0] for r in cut.select(op11.restored(F.col("output"), F.col("form"), ("[pre]", "[suf]", "[mid]"))).collect()) == texts


def rewritten(doc_id, words):
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a, out = g % n, list(words)
    p = 1 + (n - a) // (3 + g % 8)
    for i in range(a, n):
        out[i] = words[a + (i - a) % p]
    return out


def brute_runs(words):
    """Maximal stretches with their smallest period, by extending every start for every period."""
    n, found = len(words), set()
    for q in range(1, n // 3 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            length = e - s + q
            if length >= max(24, 3 * q) and (s == 0 or words[s - 1] != words[s - 1 + q]):
                part = words[s : s + length]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    found.add((s, length, q))
            s = e + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs_row(doc_id, text):
    words = rewritten(doc_id, WORD.findall(text or ""))
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(kept)))


@pytest.mark.parametrize("long", [1, 40, 8192])
def test_runs(spark, long):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        words = [f"w{k}" for k in rng.integers(0, int(rng.integers(1, 6)), int(rng.integers(0, 160)))]
        for _ in range(int(rng.integers(0, 3))):
            unit = [f"w{k}" for k in rng.integers(0, 4, int(rng.integers(1, 9)))]
            words += (unit * 40)[: int(rng.integers(20, 60))] + ["x"] * int(rng.integers(0, 3))
        rows.append((i, " ".join(words)))
    rows += [(500, "a " * 23), (501, "a " * 24), (502, "b c d " * 7 + "b c"), (503, "b c d e f g h i " * 3), (504, "a b " * 12 + "a a " * 12), (505, None), (506, ""), (507, " \n"), (None, "z " * 30), (501, "a " * 24), (None, "z " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("times", F.lit(1)).withColumn("found", F.lit(1))
    got = op12.with_digests(op12.periodic_runs(docs, op12.planted, long=long)).collect()
    want = [runs_row(*r) for r in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(w[1] > 1 for w in want) > 5
    assert op12.with_digests(op12.periodic_runs(docs.limit(0), op12.planted)).count() == 0


def test_runs_of_documents(spark):
    docs = documents(spark).where("doc_id <> 10 or doc_id is null")
    got = op12.with_digests(op12.periodic_runs(docs, op12.planted)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, (runs_row(r.doc_id, r.text) for r in docs.collect())))
    out = op12.periodic_runs(documents(spark).where("doc_id = 10"), lambda _, w: w).first()
    # 30,000 words in a circle of 997: one run, found by ranges of lags.
    assert [tuple(r) for r in out.runs] == [(0, 30_000, 997)] and len(out.collapsed.split()) == 997


LONG_TEXT = "This is the first paragraph of the story that was written for the readers who want to know what it is about, and it goes on for a while so that it is long enough to be taken as a text of its own by the rules, as they ask for two hundred characters."
SIDE = "This is what we have to say about the other stories that you may like to read on this site, and it is written in full sentences so that no count of the small words can tell it from the text of the page itself, which is why its place has to."
PAGES = {
    # div layout without an article: menus of links, short paragraphs between long ones, a copyright line.
    1: (f"<html><body><div id=top><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></div><div class='content'><h2>The <i>title</i></h2><p>{LONG_TEXT}<p>Short one.<p>{LONG_TEXT}<br>next line<br><br>New block of the same.</div><div>&copy; 2020 Somebody</div>", f"The title\n{LONG_TEXT}\nShort one.\n{LONG_TEXT} next line\nNew block of the same."),
    # Everything that stands beside an article, by element, role, class and id.
    2: (
        f"<body><header class=site-header><p>{SIDE}</p></header><div role=navigation><p>{SIDE}</p></div><div class='cookieNotice'>{SIDE}</div><main><article><header><h1>Head &amp; tail</h1></header><p>Tiny.</p><aside><p>{SIDE}</p></aside><div class='ad-slot'>{SIDE}</div>"
        f"<form><label>Mail</label><input name=x><button>Send it</button></form><p>{LONG_TEXT}</p><section id='comments'><p>{SIDE}</p></section><footer>Tags</footer></article><div class=sidebar>{SIDE}</div></main><footer>{SIDE}</footer></body>",
        f"Head & tail\nTiny.\n{LONG_TEXT}",
    ),
    # Comments after a heading only; scripts, styles, comments of the markup, text in them that looks like tags.
    3: (f"<article><script>if (a < b) document.write('<p>{SIDE}</p>')</script><style>p{{}}</style><!-- <p>{SIDE}</p> --><h1>One</h1><p>{LONG_TEXT} 1 &lt; 2 &#8364;&nbsp;5</p><div><h3>3 Comments</h3><p>{SIDE}</p></div><p>Last.</p></article>", f"One\n{LONG_TEXT} 1 < 2 € 5\nLast."),
    4: (None, ""),
    5: ("", ""),
    6: ("plain text without tags", ""),
    7: ("<article>just words", "just words"),
    8: (f"<p title=it's class=\"a > b\">{LONG_TEXT}</p><p>a < b &ampamp; &bogus; <b", f"{LONG_TEXT}\na < b &amp; &bogus;"),
    9: (f"<div class='story'><p>{LONG_TEXT}</p><ul><li>First point of the list</li><li>Second point</li></ul><p>{LONG_TEXT}</p></div><div><a href=x>More of this</a> | <a href=y>And of that</a></div>", f"{LONG_TEXT}\nFirst point of the list\nSecond point\n{LONG_TEXT}"),
    10: (f"<article><p>in<b>line</b>\t\n two  <span>spaces</span></p><p>{'long words ' * 20_000}</p><p hidden>{LONG_TEXT}</p><div style='display: none'>{LONG_TEXT}</div></article>", "inline two spaces\n" + " ".join(["long words"] * 20_000)),
}


def test_main_text(spark):
    rows = [(i, f"http://x/{i}", page) for i, (page, _) in PAGES.items()] + [(1, "http://x/1", PAGES[1][0]), (None, None, "<article>x</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x")).withColumn("block", F.lit(0))
    got = op13.main_text(pages).collect()
    for r in got:
        want = PAGES[r.page_id][1] if r.page_id else "x"
        assert (r.page_id, r.text, r.n_chars) == (r.page_id, want, len(want))
    assert sorted(str(r.page_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert op13.main_text(pages.limit(0)).count() == 0
    blocks = op13.page_blocks(pages.where("page_id = 2")).orderBy("block").collect()
    assert "\n".join(b.text for b in blocks if b.label == "good") == PAGES[2][1] and {b.label for b in blocks} == {"good", "bad"}
    assert any(b.ambiguous and b.label == "good" for b in blocks)
