"""Classification rules as data: kinds by pattern, states, vendors and priorities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Kinds, weights and patterns; of equal weights the earlier kind wins.
KINDS = (
    ("preference", 0.85, (r"(?i)\bi\s+(prefer|like|love|hate|dislike|enjoy)\b", r"(?i)\bmy\s+favou?rite\b", r"(?i)\bi(?:'m|\s+am)\s+(?:not\s+)?a\s+fan\s+of\b", r"(?i)\b(prefer|recommend)\b")),
    ("decision", 0.85, (r"(?i)\b(we|i)('ve|\s+have)?\s+decided\b", r"(?i)\blet'?s\s+go\s+with\b", r"(?i)\bwe(?:'re|\s+are)?\s+going\s+to\b", r"(?i)\bdecision\s*:\s*\S")),
    ("pitfall", 0.86, (r"(?i)\bnever\b.*\b(use|do|edit|call|import|run|commit|widen|bypass)\b", r"(?i)\b(do\s+not|don'?t)\b.*\b(use|edit|call|import|run|widen|bypass|commit)\b", r"(?i)\b(outdated|deprecated|forbidden|banned)\b")),
    ("workaround", 0.80, (r"(?i)\buse\b.+\binstead\b", r"(?i)\b(instead\s+of|rather\s+than|in\s+place\s+of)\b")),
    ("commitment", 0.75, (r"(?i)\b(by|before)\s+\w+day\b", r"(?i)\b(TODO|FIXME)\b", r"(?i)\bi('ll|\s+will)\s+\w+", r"(?i)\bdue\s+(by|on)\b")),
    ("instruction", 0.75, (r"(?i)\b(please|always|never|don'?t)\b.*\b(do|use|avoid|commit|skip|run)\b", r"(?i)\b(always|never)\s+\w+")),
    ("issue", 0.65, (r"(?i)\b(bug|broken|fails?|error|crash(?:es|ed|ing)?)\b", r"(?i)\bdoesn'?t\s+work\b", r"(?i)\bregression\b")),
)
# Kind and confidence that a source of candidates has without a rule.
DEFAULTS = {"key_fact": ("fact", 0.7), "stat": ("fact", 0.8), "metadata": ("fact", 0.7), "phrase": ("fact", 0.5), "summary": ("summary", 0.9)}
# Stems of states, in order.
STATES = (("abandoned", r"\b(abandon|descop|retract|drop|cancel)"), ("done", r"\b(ship|done|complet|finish|deploy|merg)"))
# Name parts and the family they belong to, in order.
FAMILIES = (
    ("gpt", "openai"), ("openai", "openai"), ("o1", "openai"), ("o3", "openai"), ("claude", "anthropic"), ("anthropic", "anthropic"),
    ("gemini", "google"), ("gemma", "google"), ("llama", "meta"), ("qwen", "qwen"), ("mistral", "mistral"), ("deepseek", "deepseek"),
)


def _any(text: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns))


def best_kind(text: Column) -> Column:
    """struct(weight, kind) of the heaviest rule that matches, else null."""
    found = [F.when(_any(text, patterns), F.struct(F.lit(weight).alias("weight"), F.lit(-i).alias("i"), F.lit(kind).alias("kind"))) for i, (kind, weight, patterns) in enumerate(KINDS)]
    return F.greatest(*found)


def classified(text: Column, source: str) -> Column:
    """struct(kind, confidence): the rule's if it outweighs the source's default."""
    kind, confidence = DEFAULTS[source]
    best = best_kind(text)
    wins = F.coalesce(best["weight"] > confidence, F.lit(False))
    return F.struct(F.when(wins, best["kind"]).otherwise(kind).alias("kind"), F.when(wins, best["weight"]).otherwise(confidence).alias("confidence"))


def state(text: Column) -> Column:
    low = F.lower(text)
    out = None
    for name, pattern in STATES:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise("in_progress")


def family(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(part)), F.lit(name)) for part, name in FAMILIES])


def content_type(text: Column) -> Column:
    head = F.ltrim(text)
    starts = lambda s: F.startswith(head, F.lit(s))
    json = (starts("{") | starts("[")) & F.try_parse_json(text).isNotNull()
    has = lambda s: F.contains(text, F.lit(s))
    return (
        F.when(json, "json").when(has("\n+++") | has("\n---") | starts("diff --git"), "code_diff")
        .when(has("Traceback ") | has(" ERROR ") | starts("[ERROR]"), "log").when(starts("<!DOCTYPE html") | starts("<html"), "html").otherwise("text")
    )


# The kinds that rules may have.
RULE_KINDS = ("pitfall", "decision", "preference", "instruction", "workaround")


def candidates(notes: DataFrame, key: str, text: str, most: int = 50, longest: int = 400) -> DataFrame:
    """(key, place, kind, confidence, text, types): what a note may teach, the first most of each.

    Lines lose their list marks and are split into sentences of at most longest characters. Those that match a rule come
    first, then all as key facts; each text once, whatever its case. Texts are scrubbed and classified.
    """
    from .pii import scrub

    lines = notes.select(key, F.posexplode(F.split(text, r"\n+")).alias("line_no", "l"))
    clean = F.btrim(F.btrim(F.btrim(F.regexp_replace("l", r"^[\s\-*#>`]+", "")), F.lit("*`")))
    units = lines.select(key, "line_no", F.posexplode(F.split(clean, r"(?<=[.!?])\s+")).alias("unit_no", "unit")).withColumn("unit", F.btrim("unit")).where((F.col("unit") != "") & (F.length("unit") <= longest))
    units = units.withColumn("best", best_kind(F.col("unit")))
    ruled = units.where(F.col("best.kind").isin(*RULE_KINDS)).withColumn("pass", F.lit(1))
    every = ruled.unionByName(units.withColumn("pass", F.lit(2))).withColumn("c", classified(F.col("unit"), "key_fact"))
    order = ["pass", "line_no", "unit_no"]
    once = every.withColumn("again", F.row_number().over(W.partitionBy(key, F.lower(F.trim("unit"))).orderBy(*order))).where("again = 1")
    kept = once.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("place") <= most)
    return kept.withColumn("s", scrub(F.col("unit"))).select(key, "place", "c.kind", "c.confidence", "s.text", F.array_join("s.types", ",").alias("types"))
