"""Relative date phrases in queries: the window of days they mean at an anchor day, and the query without them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days of a unit, and weekdays from Monday.
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
_UNIT = "(day|week|month|year)s?"
_DAY = "(" + "|".join(WEEKDAYS) + ")"
# The phrases in the order in which they are tried; the first that occurs counts.
PHRASES = {
    "last_n": rf"\b(?:in|over|within|during)?\s*(?:the\s+)?(?:last|past)\s+(\d+)\s+{_UNIT}\b",
    "ago": rf"\b(\d+)\s+{_UNIT}\s+ago\b",
    "since": rf"\bsince\s+(?:the\s+)?(?:last\s+)?(?:(\d+)\s+)?{_UNIT}(?:\s+ago)?\b",
    "last_weekday": rf"\blast\s+{_DAY}\b",
    "last_unit": rf"\blast\s+{_UNIT}\b",
    "this_unit": rf"\bthis\s+{_UNIT}\b",
    "weekday": rf"\b(?:this\s+)?{_DAY}\b",
    "yesterday": r"\byesterday\b",
    "today": r"\btoday\b",
    "recently": r"\b(?:recently|lately)\b",
}
#: Days that "recently" goes back.
RECENT = 7


def _days(unit: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in UNIT_DAYS.items() for x in kv]), unit)


def last_weekday(anchor: Column, weekday: Column, inclusive: bool = True) -> Column:
    back = F.pmod(F.weekday(anchor) - weekday, F.lit(7))
    return F.date_sub(anchor, back if inclusive else F.when(back == 0, 7).otherwise(back))


def date_window(phrase: Column, anchor: Column) -> Column:
    """struct(after, before): the first and last day that a phrase means at an anchor day; null without a phrase."""
    low = F.lower(phrase)
    part = lambda name, i: F.regexp_extract(low, PHRASES[name], i)
    number = lambda name: F.coalesce(F.try_to_number(part(name, 1), F.lit("999999")).cast("int"), F.lit(1))
    day = lambda name: F.array_position(F.array(*map(F.lit, WEEKDAYS)), part(name, 1)).cast("int") - 1
    back = lambda name: F.date_sub(anchor, _days(part(name, 2)) * number(name))
    to = lambda first, last: F.struct(first.alias("after"), last.alias("before"))
    by_unit = lambda name, week, month, year, rest: F.when(part(name, 1) == "week", week).when(part(name, 1) == "month", month).when(part(name, 1) == "year", year).otherwise(rest)
    monday, month, year = (F.trunc(anchor, x) for x in ("week", "month", "year"))
    before = lambda first, months: to(F.add_months(first, -months), F.date_sub(first, 1))
    once, wday = last_weekday(anchor, day("last_weekday"), False), last_weekday(anchor, day("weekday"))
    meant = {
        "last_n": to(back("last_n"), anchor), "ago": to(back("ago"), back("ago")), "since": to(back("since"), anchor), "last_weekday": to(once, once),
        "last_unit": by_unit("last_unit", to(F.date_sub(monday, 7), F.date_sub(monday, 1)), before(month, 1), before(year, 12), to(F.date_sub(anchor, 7), anchor)),
        "this_unit": by_unit("this_unit", to(monday, anchor), to(month, anchor), to(year, anchor), to(anchor, anchor)),
        "weekday": to(wday, wday), "yesterday": to(F.date_sub(anchor, 1), F.date_sub(anchor, 1)), "today": to(anchor, anchor), "recently": to(F.date_sub(anchor, RECENT), anchor),
    }
    out = None
    for name, pattern in PHRASES.items():
        out = F.when(low.rlike(pattern), meant[name]) if out is None else out.when(low.rlike(pattern), meant[name])
    return out


def day_start(day: Column) -> Column:
    return day.cast("timestamp_ntz")


def day_end(day: Column) -> Column:
    """A day's last second."""
    return F.date_add(day, 1).cast("timestamp_ntz") - F.expr("interval 1 second")


def without_phrase(query: Column) -> Column:
    """A query without its date phrase, the phrase's possessive, double spaces and marks at its ends; the query itself if nothing is left."""
    out = query
    for name, pattern in reversed(PHRASES.items()):
        # The lazy beginning makes this the phrase's first place, and the anchor replaces no other.
        rest = F.regexp_replace(query, rf"(?is)^(.*?){pattern}(?:'s)?", "$1 ")
        tidy = F.btrim(F.btrim(F.regexp_replace(rest, r"\s{2,}", " ")), F.lit(" ,."))
        out = F.when(query.rlike("(?i)" + PHRASES[name]), F.when(tidy == "", query).otherwise(tidy)).otherwise(out)
    return out
