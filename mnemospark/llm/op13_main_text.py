"""HTML extraction by two-pass block rules.

A page is cut into blocks at its block-level tags. Blocks of menus, headers, footers, asides, forms, notices, adverts and
comments, by element, role or name, are bad from the start. The first pass decides the others by link density, length and
stop-word density: good, bad, or ambiguous. The second gives each ambiguous block the label of its nearest decided
neighbours; the edges of an article count as good, those of the page as bad. Good blocks in page order are the text.

Nulls and empty pages give an empty text; tags that are never closed, cut-off pages and text without tags are read as far
as they go. Very long pages are read whole, one page at a time. Rows that repeat each have their row; an empty table gives
none. Only page_id, url and html are read, so other columns never clash.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

# Elements, roles, names, headings and stop words.
#: Elements that begin and end a block.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is never the article's: menus, controls, media.
OUTSIDE_TAGS = frozenset("aside audio button canvas datalist dialog embed fieldset footer form iframe map math menu nav noscript object select svg template video".split())
OUTSIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
#: Words of a class or an id that mark what stands beside an article, whole or as beginnings.
OUTSIDE_NAMES = frozenset(
    "ad ads adbox adslot adunit adv alert banner bio byline consent copyright disqus gdpr legal login masthead menu modal nav navbar overlay pager pagination paywall popup promo promotion rail recommended related replies respond share sharing signup skip social subscribe subscription tags toolbar trending".split()
)
OUTSIDE_BEGINNINGS = ("adsby", "advert", "breadcrumb", "comment", "cookie", "footer", "navigation", "newsletter", "notice", "notification", "recommendation", "sidebar", "sponsor")
#: Headings that begin the reader comments.
COMMENTS = re.compile(r"\d*\s*(comments?|responses?|replies|reader comments|leave a (comment|reply)|kommentare?|commentaires?|comentarios?)(\s*\(?\d*\)?)?:?", re.I)
STOP_WORDS = frozenset(
    (
        "a about after all also an and any are as at be been but by can could did do for from had has have he her his how i if in into is it its more my no not of on one or our she so some that the their them there they this to was we were what when which who will with would you your "
        "aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wie wir zu zum zur "
        "al con como de del e el en entre era es esta este la las lo los más me mi muy no o para pero por que se ser si sin sobre su sus también un una y ya "
        "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous ou où par pas plus pour qu que qui sa se ses son sont sur un une vous"
    ).split()
)

#: Share of characters in links from which a block is bad; characters below which a block is short, and from which dense text is good; shares of stop words.
MAX_LINKS, SHORT, LONG, LOW, HIGH = 0.5, 70, 200, 0.12, 0.25

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?P<raw>script|style|textarea|title|xmp)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.I | re.S,
)
_ATTR = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_MODIFIER = re.compile(r"\b(?:has|with|no|without)[-_ ]\w+", re.I)
_HEADER = re.compile(r"(?:^|[\s_-])header(?:\s|$)|[a-z]Header(?:\s|$)")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORD = re.compile(r"[^\W\d_]+")
_HEADING = re.compile(r"h[1-6]")


@dataclass
class Block:
    text: str
    tag: str
    path: tuple[int, ...]  # open containers, each by its number on the page
    article: bool
    outside: bool
    linked: int  # characters in links
    label: str = ""
    ambiguous: bool = False


def _outside(tag: str, attrs: str, in_article: bool) -> bool:
    """Whether an element holds what stands beside the article; a header does unless it is the article's own."""
    if tag in OUTSIDE_TAGS or tag == "header" and not in_article:
        return True
    if tag in ("html", "body", "main") or not attrs.strip():
        return False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if name == "role" and value.lower() in OUTSIDE_ROLES:
            return True
        if name in ("class", "id"):
            words = [w.lower() for w in _NAME.findall(_MODIFIER.sub(" ", value))]
            if any(w in OUTSIDE_NAMES or w.startswith(OUTSIDE_BEGINNINGS) and w != "commentary" for w in words) or not in_article and _HEADER.search(value):
                return True
    return False


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order."""
    found: list[Block] = []
    #: Open containers: tag, number, in an article, in a main, outside.
    stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
    parts: list[str] = []
    state = {"linked": 0, "links": 0, "number": 0, "tag": "", "breaks": 0}
    in_main: list[bool] = []

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            top = stack[-1]
            found.append(Block(text, state["tag"], tuple(s[1] for s in stack), top[2], top[4], min(state["linked"], len(text))))
            in_main.append(top[3])
        state["linked"] = state["breaks"] = 0

    def said(raw: str) -> None:
        text = entities.unescape(raw)
        parts.append(text)
        if not text.isspace():
            state["breaks"] = 0
        if state["links"]:
            state["linked"] += len(" ".join(text.split()))

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            said(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "a":
            state["links"] = 0 if m["end"] else 1
        elif tag == "br":
            # Two breaks in a row end a block, as an empty line does.
            state["breaks"] += 1
            if state["breaks"] == 2:
                flush()
            else:
                parts.append(" ")
        elif tag in BLOCK_TAGS or tag in OUTSIDE_TAGS:
            if tag in BLOCK_TAGS:
                flush()
            if m["end"]:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
                if depth:
                    flush()
                    del stack[depth:]
                state["tag"] = ""
                continue
            if tag in BLOCK_TAGS:
                state["tag"], state["links"] = tag, 0
            if tag == "hr" or m["attrs"].endswith("/") and tag in OUTSIDE_TAGS:
                continue
            if tag in ("p", "li", "dt", "dd", "td", "th", "tr") or _HEADING.fullmatch(tag):
                # Their end tags may be left out: one of a kind ends the one before it in the same container.
                while len(stack) > 1 and (stack[-1][0] == "p" or stack[-1][0] == tag or _HEADING.fullmatch(stack[-1][0])):
                    stack.pop()
            elif len(stack) > 1 and stack[-1][0] == "p" and tag in BLOCK_TAGS:
                stack.pop()
            _, _, article, main, outside = stack[-1]
            bad = outside or _outside(tag, m["attrs"], article or main)
            if bad and not outside and tag not in BLOCK_TAGS:
                flush()
            if tag == "main":
                bad, main = False, True
            state["number"] += 1
            stack.append((tag, state["number"], article or tag == "article" or "articlebody" in m["attrs"].lower(), main, bad))
    if at < len(page):
        said(page[at:])
    flush()
    # A main element stands for the article where there is none.
    if not any(b.article and not b.outside for b in found):
        for b, inside in zip(found, in_main, strict=True):
            b.article = b.article or inside
    return found


def decide(found: list[Block]) -> None:
    """First pass: good and bad by context-free rules, and which blocks stay ambiguous."""
    comments: tuple[int, ...] | None = None
    for b in found:
        if comments and b.path[: len(comments)] != comments:
            comments = None
        if not comments and not b.outside and _HEADING.fullmatch(b.tag) and COMMENTS.fullmatch(b.text):
            comments = b.path[:-1]  # the rest of the container that holds the heading
        if comments and len(comments) > 1:
            b.outside = True
        words = _WORD.findall(b.text.lower())
        density = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
        if b.outside or b.linked > MAX_LINKS * len(b.text) or "©" in b.text and not b.article:
            b.label = "bad"
        elif len(b.text) < SHORT or _HEADING.fullmatch(b.tag):
            b.ambiguous = True
        elif density >= HIGH and len(b.text) >= LONG or density >= LOW and b.article:
            b.label = "good"
        else:
            # Dense enough for a text, but not long; or long without a language's small words, as a table or a list of names is.
            b.ambiguous = density >= LOW or b.article
            b.label = "" if b.ambiguous else "bad"


def inherit(found: list[Block]) -> None:
    """Second pass: ambiguous blocks take the label of their nearest decided neighbours.

    In an article what stands beside it is passed over, and its edges are good. Of two that differ the one in the same
    container wins, then the nearer one; of equals a heading takes the one that follows, a dense block the good one.
    """
    n = len(found)
    for inside in (True, False):
        here = [i for i, b in enumerate(found) if b.article == inside and not (inside and b.outside)]
        if not inside:
            here = list(range(n))
        decided = [found[i].label for i in here]
        last, before = -1, []
        for j, label in enumerate(decided):
            before.append(last)
            last = j if label else last
        nxt, after = len(here), [0] * len(here)
        for j in range(len(here) - 1, -1, -1):
            after[j] = nxt
            nxt = j if decided[j] else nxt
        edge = "good" if inside else "bad"
        for j, i in enumerate(here):
            b = found[i]
            if b.label or b.article != inside:
                continue
            lo, hi = before[j], after[j]
            one, two = (decided[k] if 0 <= k < len(here) else edge for k in (lo, hi))
            if one != two:
                home = [0 <= k < len(here) and found[here[k]].path[:-1] == b.path[:-1] for k in (lo, hi)]
                if home[0] != home[1]:
                    one = one if home[0] else two
                elif j - lo != hi - j:
                    one = one if j - lo < hi - j else two
                else:
                    one = two if _HEADING.fullmatch(b.tag) else "good" if len(b.text) >= SHORT else "bad"
            b.label = one


def labelled(page: str | None) -> list[Block]:
    found = blocks(page or "")
    decide(found)
    inherit(found)
    return found


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the good blocks of each page, one a line."""

    def work(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                part = batch.slice(low, 128)
                texts = ["\n".join(b.text for b in labelled(page.as_py()) if b.label == "good") for page in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    types = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(work, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")


def page_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block, tag, text, label, ambiguous, linked): every block of each page with the label that it got."""

    def work(batches):
        for batch in batches:
            for page_id, page in zip(batch.column(0), batch.column(1), strict=True):
                found = labelled(page.as_py())
                cols = {"block": range(len(found)), "tag": [b.tag for b in found], "text": [b.text for b in found], "label": [b.label for b in found], "ambiguous": [b.ambiguous for b in found], "linked": [b.linked for b in found]}
                types = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([page_id.as_py()] * len(found), batch.schema.field(0).type), *(pa.array(v, t) for v, t in zip(cols.values(), types, strict=True))], names=["page_id", *cols])

    return pages.select("page_id", "html").mapInArrow(work, f"page_id {dict(pages.dtypes)['page_id']}, block int, tag string, text string, label string, ambiguous boolean, linked int")


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


# The given pages hold their text in one article element of h1 and p elements, so SQL can state what belongs to it.
ORACLE = r"""
WITH inner_html AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS a FROM pages),
pieces AS (SELECT page_id, url, unnest(regexp_split_to_array(a, '</?(?:p|h1)>')) AS piece, generate_subscripts(regexp_split_to_array(a, '</?(?:p|h1)>'), 1) AS i FROM inner_html),
plain AS (SELECT page_id, url, i, replace(replace(replace(replace(regexp_replace(regexp_replace(piece, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', '''') AS t FROM pieces),
decoded AS (SELECT page_id, url, i, trim(regexp_replace(regexp_replace(t, '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS t FROM plain),
joined AS (SELECT page_id, string_agg(t, chr(10) ORDER BY i) AS text FROM decoded WHERE t <> '' GROUP BY page_id)
SELECT p.page_id, p.url, coalesce(j.text, '') AS text, length(coalesce(j.text, ''))::BIGINT AS n_chars FROM pages p LEFT JOIN joined j USING (page_id)
"""
