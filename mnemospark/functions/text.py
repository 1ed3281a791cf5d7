"""Column builders over text: tokens, scores, sentences, normal forms, hashes and sensitive data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words that carry no retrieval signal.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "can", "could", "did", "do", "does", "for", "from",
    "had", "has", "have", "he", "her", "him", "his", "how", "i", "if", "in", "into", "is", "it", "its", "me", "my", "of",
    "on", "or", "our", "out", "she", "should", "so", "that", "the", "their", "them", "then", "they", "this", "to", "up",
    "was", "we", "were", "what", "when", "where", "which", "who", "whom", "why", "will", "with", "would", "you", "your",
)

# Types of sensitive data and their patterns, in the order in which they are tried.
SENSITIVE = (
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("PHONE", r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}\b"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("CREDIT_CARD", r"\b(?:\d[ -]*?){13,19}\b"),
    ("SECRET", r"(?i)\b(?:(?:sk|pk|api|token|secret|key)[_-][A-Za-z0-9][A-Za-z0-9_-]{12,})\b"),
)

# Attribute names and what they are folded to.
ASPECTS = {
    "result": "status", "outcome": "status", "state": "status", "reliability": "status", "health": "status",
    "scope": "coverage", "covers": "coverage", "path": "location", "dir": "location", "directory": "location",
    "ver": "version", "assignee": "owner", "responsible": "owner", "configuration": "config", "settings": "config",
    "engine": "implementation", "runtime": "implementation", "framework": "implementation", "platform": "implementation",
    "technology": "implementation", "tech": "implementation", "tool": "implementation",
    "replica_count": "replicas", "replica": "replicas",
}
# Subjects that mean the speaker.
SELF = ("i", "me", "my", "myself", "mine", "the user", "current user")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, though use names it many times or inside a lambda."""
    return F.transform(F.array(value), use)[0]


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(text)), F.lit("[a-z0-9_]+"), 0)


#: Endings of English words that a stem lacks, tried one after another: what is matched, and what stays of it.
ENDINGS = ((r"(..)ies$", "{}y"), (r"(ss)es$", "{}"), (r"([^sui])s$", "{}"), (r"(...)ing$", "{}"), (r"(...)ed$", "{}"), (r"(...)ly$", "{}"))


def stem(token: Column) -> Column:
    """A token without its ending: a light stemmer, whose stems need not be words."""
    for pattern, stays in ENDINGS:
        token = F.regexp_replace(token, pattern, stays.format("$1"))
    return token


def content_terms(text: Column | str) -> Column:
    """Distinct tokens without function words, or with them if there is nothing else."""
    every = F.array_distinct(tokens(text))
    content = F.array_except(every, F.array(*map(F.lit, STOPWORDS)))
    return F.when(F.size(content) > 0, content).otherwise(every)


def overlap_score(terms: Column, text: Column | str) -> Column:
    """Share of the terms that the text holds."""
    return F.when(F.size(terms) > 0, F.size(F.array_intersect(terms, tokens(text))) / F.size(terms)).otherwise(0.0)


def substring_count(text: Column | str, term: Column) -> Column:
    """Non-overlapping occurrences of a term."""
    text = col(text)
    return ((F.length(text) - F.length(F.replace(text, term))) / F.length(term)).cast("long")


def sentences(text: Column | str) -> Column:
    return F.filter(F.split(F.trim(col(text)), r"(?<=[.!?])\s+"), lambda s: s != "")


def packed_sentences(text: Column | str, max_chars: int = 1000, min_chars: int = 300) -> Column:
    """Whole sentences packed while they fit max_chars; a chunk below min_chars takes the next one all the same, and a short rest joins the last chunk."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, s: Column) -> Column:
        longer = F.when(acc["open"] == "", s).otherwise(F.concat_ws(" ", acc["open"], s))
        close = (F.length(acc["open"]) >= min_chars) & (F.length(longer) > max_chars)
        return F.struct(F.when(close, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"), F.when(close, s).otherwise(longer).alias("open"))

    def end(acc: Column) -> Column:
        n = F.size(acc["done"])
        joined = F.concat(F.slice(acc["done"], F.lit(1), n - 1), F.array(F.concat_ws(" ", F.get(acc["done"], n - 1), acc["open"])))
        return F.when(acc["open"] == "", acc["done"]).when((n > 0) & (F.length(acc["open"]) < min_chars), joined).otherwise(F.concat(acc["done"], F.array(acc["open"])))

    return F.aggregate(sentences(text), start, step, end)


def with_neighbours(parts: Column | str, n: int = 1) -> Column:
    """(n, centre, window) of each part: its place from 1, itself, and itself between the n parts on each side."""

    def windows(parts: Column) -> Column:
        window = lambda i: F.array_join(F.slice(parts, F.greatest(F.lit(1), i + 1 - n), F.least(F.lit(n), i) + 1 + n), " ")
        return F.transform(parts, lambda c, i: F.struct((i + 1).alias("n"), c.alias("centre"), window(i).alias("window")))

    return bound(col(parts), windows)


def trimmed(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("...")))


def prefix_summary(text: Column | str, most: int) -> Column:
    """Whole leading sentences while they fit; the first is always taken."""
    start = F.struct(F.lit("").alias("s"), F.lit(False).alias("end"))

    def step(acc: Column, s: Column) -> Column:
        longer = F.when(F.length(acc["s"]) == 0, s).otherwise(F.concat_ws(" ", acc["s"], s))
        stop = acc["end"] | ((F.length(longer) > most) & (F.length(acc["s"]) > 0))
        return F.struct(F.when(stop, acc["s"]).otherwise(longer).alias("s"), (stop | (F.length(longer) >= most)).alias("end"))

    return trimmed(F.aggregate(sentences(text), start, step, lambda acc: acc["s"]), most)


def sensitive_counts(text: Column | str) -> dict[str, Column]:
    return {kind: F.size(F.regexp_extract_all(col(text), F.lit(p), 0)).cast("long") for kind, p in SENSITIVE}


def scrubbed(text: Column | str) -> Column:
    """The text with each sensitive match replaced by its type, tried in order."""
    out = col(text)
    for kind, pattern in SENSITIVE:
        out = F.regexp_replace(out, pattern, f"[{kind}]")
    return out


def hash_bucket(token: Column, dim: int) -> Column:
    """The token's SHA-256, as a number, modulo dim; four hex digits at a time."""
    digest = F.sha2(token, 256)
    parts = F.transform(F.sequence(F.lit(1), F.lit(61), F.lit(4)), lambda i: F.conv(F.substr(digest, i, F.lit(4)), 16, 10).cast("long"))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, b: (a * 65536 + b) % dim)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def clean_label(label: Column) -> Column:
    """A label without colour codes and control characters, 256 characters at most."""
    return F.left(F.regexp_replace(F.regexp_replace(label, r"\x1b\[[0-9;?]*[A-Za-z]", ""), r"[\x00-\x1f\x7f]", ""), F.lit(256))


def capped(text: Column, most: int) -> Column:
    """A text of at most so many characters, cut where a word ends."""
    head = F.left(text, F.lit(most))
    back = F.instr(F.reverse(head), " ")
    return F.when(F.length(text) <= most, text).when((back == 0) | (back == most), F.rtrim(head)).otherwise(F.rtrim(F.left(head, most - back)))


def token_estimate(content: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.octet_length(col(content)) / 4)).cast("long")


def event_date(value: Column | str) -> Column:
    """A year, a month or an ISO time; null for anything else."""
    v = F.trim(col(value))
    parse = F.try_to_timestamp
    return F.when(v.rlike(r"^\d{4}$"), parse(F.concat(v, F.lit("-01-01")))).when(v.rlike(r"^\d{4}-\d{2}$"), parse(F.concat(v, F.lit("-01")))).when(v.rlike(r"^\d{4}-\d{2}-\d{2}"), parse(v))


def evolved_confidence(prior: Column, n: Column) -> Column:
    return F.when(n <= 1, F.least(F.lit(1.0), prior)).otherwise(F.least(F.lit(1.0), prior + (1 - prior) * (1 - 1 / n)))


def snippet(text: Column | str, words: Column, most: int = 500, lead: int = 166) -> Column:
    """A window around the first word found."""
    text = col(text)
    low = F.lower(text)
    hits = F.filter(F.transform(words, lambda w: F.position(w, low) - 1), lambda p: p >= 0)
    first = F.coalesce(F.array_min(hits), F.lit(0))
    start = F.least(F.greatest(F.lit(0), first - lead), F.greatest(F.lit(0), F.length(text) - most))
    body = F.trim(F.substr(text, start + 1, F.lit(most)))
    cut = F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(start + most < F.length(text), "...").otherwise(""))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def word_chunks(text: Column | str, window: int, overlap: int) -> Column:
    """Windows of words; an empty text is one chunk."""
    window, step = max(1, window), max(1, max(1, window) - min(overlap, max(1, window) - 1))
    text = F.coalesce(col(text), F.lit(""))

    def cut(words: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(words) - window) / step)).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i * step + 1, window), " "))
        return F.when(F.size(words) == 0, F.array(text)).otherwise(chunks)

    return bound(F.filter(F.split(text, r"\s+"), lambda w: w != ""), cut)
