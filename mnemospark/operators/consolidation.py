"""Facts of conversations: a table function with state over a conversation's turns in order.

    dated_facts(turns, "sentences")

A row that gives a session's date anchors the turns after it. Sentences are ranked by how many dates, numbers and names
they hold; or every turn is a fact, as it stands. Each fact names its speaker, carries its session's date, and has the day
that its first relative expression means from there.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf

FACT = "conv_id long, place int, turn long, subject string, predicate string, object string, span string, said_on date, refers_to string, density int, confidence double"

# Expressions that mean a day before the session's, in the order in which they are tried, and the days that they go back.
DAYS_BACK = ((r"yesterday", 1), (r"\b(\d+) +(day|week|month|year)s? +ago\b", {"day": 1, "week": 7, "month": 30, "year": 365}), (r"last week|a week ago", 7), (r"last month|a month ago", 30), (r"last year|a year ago", "year"))
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Weights of what makes a sentence dense: dates, numbers, names within it.
_DENSE = ((4, re.compile(r"\b(?:\d{1,2} +)?(?:" + "|".join(MONTHS) + r")\b(?: +\d{1,2})?(?:,? +\d{4})?|\b\d{4}-\d{2}-\d{2}\b|\b(?:19|20)\d{2}\b", re.I)), (2, re.compile(r"\b\d+\b")), (1, re.compile(r"(?<!^)(?<![.!?] )\b[A-Z][a-z]{2,}\b")))
_MARK = re.compile(r"\[?session date:.*?(\d{1,2}) +([a-z]+),? +(\d{4})", re.I)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_TOKEN = re.compile(r"[A-Za-z0-9'-]+")


def session_date(text: str) -> dt.date | None:
    """The day of a row that says [Session date: ... 8 May, 2023], if it is one."""
    m = _MARK.match(text.strip())
    if not m or m[2].lower() not in MONTHS:
        return None
    try:
        return dt.date(int(m[3]), MONTHS.index(m[2].lower()) + 1, int(m[1]))
    except ValueError:
        return None


def refers_to(text: str, anchor: dt.date) -> str | None:
    """The day, or for last year the year, that a text's first known expression means from an anchor."""
    low = text.lower()
    for pattern, back in DAYS_BACK:
        m = re.search(pattern, low)
        if not m:
            continue
        if back == "year":
            return str(anchor.year - 1)
        days = back if isinstance(back, int) else back[m[2]] * int(m[1])
        return (anchor - dt.timedelta(days=days)).isoformat() if days < anchor.toordinal() else None
    m = re.search(r"\b(" + "|".join(WEEKDAYS) + r")\b", low)
    # The last such day before the anchor's own.
    return (anchor - dt.timedelta(days=(anchor.weekday() - WEEKDAYS.index(m[1]) - 1) % 7 + 1)).isoformat() if m else None


def density(sentence: str) -> int:
    return sum(weight * len(pattern.findall(sentence)) for weight, pattern in _DENSE)


def at_word(text: str, most: int) -> str:
    """The text up to its last whole word within most characters."""
    return text if len(text) <= most else text[: max(text.rfind(" ", 0, most), 0) or most].rstrip()


@udtf(returnType=FACT)
class DatedFacts:
    """One conversation a partition: its rows come in order, facts leave at its end."""

    def __init__(self):
        self.anchor, self.units, self.how, self.conv = None, [], None, None

    def eval(self, row) -> None:
        self.conv, self.how = row["conv_id"], (row["mode"], row["most"])
        text = (row["text"] or "").strip()
        day = session_date(text)
        if day:
            self.anchor = day
            return
        parts = _SENTENCE.split(text) if row["mode"] == "sentences" else [text]
        self.units += [(row["turn"], row["speaker"], p.strip(), self.anchor) for p in parts if p.strip()]

    def terminate(self) -> Iterator[tuple]:
        if self.how is None:
            return
        mode, most = self.how
        seen, place = set(), 0
        if mode == "sentences":
            fit = [u for u in self.units if 20 <= len(u[2]) <= 400]
            ranked = sorted(((density(u[2]), u) for u in fit), key=lambda x: -x[0])  # stable: equals stay in order
        else:
            ranked = [(density(u[2]), u) for u in self.units]
        for score, (turn, speaker, text, anchor) in ranked:
            key = text[:60].lower() if mode == "sentences" else text.lower()
            if key in seen or place >= most:
                continue
            seen.add(key)
            # Sentences without a date, number or name fill half of the places at most.
            if mode == "sentences" and not score and place >= most // 2:
                continue
            place += 1
            words = _TOKEN.findall(text)
            span = (f"[{speaker}] " if speaker else "") + (at_word(text, 200) if mode == "sentences" else text)
            day = refers_to(text, anchor) if anchor else None
            span = (f"(around {anchor.isoformat()}) " if anchor else "") + span + (f" [date: {day}]" if day else "")
            if mode == "sentences":
                told = (speaker or (words[0] if words else "?"), words[1] if len(words) > 1 else "said", " ".join(words[2:6]) or "?", 0.5)
            else:
                told = (speaker or "?", "said", " ".join(text.split()[:4]) or "?", 1.0)
            yield self.conv, place, turn, *told[:3], span, anchor, day, score, told[3]


def dated_facts(turns: DataFrame, mode: str = "turns", most: int | None = None) -> DataFrame:
    """Facts of turns (conv_id, turn, speaker, text), most of a conversation: 12 of its sentences, or 1,000 turns.

    Equal texts are one fact, the first. Blank turns are none; a null speaker is left out of the span.
    """
    if mode not in ("sentences", "turns"):
        raise ValueError(f"no such mode: {mode!r}")
    most = most or (12 if mode == "sentences" else 1000)
    rows = turns.selectExpr("conv_id", "turn", "speaker", "text", f"'{mode}' mode", f"{int(most)} most")
    return DatedFacts(rows.asTable().partitionBy("conv_id").orderBy("turn"))
