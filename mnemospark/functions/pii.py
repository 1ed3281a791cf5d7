"""Numbered scrubbing of sensitive data, in Arrow batches: accepted spans of earlier types rule out later ones, which no built-in expresses."""

from __future__ import annotations

import re
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SENSITIVE


def spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, type, number) of the sensitive data in a text, by place. Types are tried in order; what overlaps a span taken before is left out."""
    taken: list[tuple[int, int, str, int]] = []
    for kind, pattern in SENSITIVE:
        count = 0
        for found in re.finditer(pattern, text):
            start, end = found.span()
            at = bisect_left(taken, (start,))
            free_before = at == 0 or taken[at - 1][1] <= start
            free_after = at == len(taken) or taken[at][0] >= end
            if free_before and free_after:
                count += 1
                insort(taken, (start, end, kind, count))
    return taken


def scrub(text: Column) -> Column:
    """struct(text, types, n): the text with each match as [TYPE_number], its types in order, and how many matches."""

    @F.pandas_udf("text string, types array<string>, n long")
    def work(values: pd.Series) -> pd.DataFrame:
        out = []
        for value in values:
            if value is None:
                out.append((None, [], 0))
                continue
            found, parts, at = spans(value), [], 0
            for start, end, kind, number in found:
                parts += [value[at:start], f"[{kind}_{number}]"]
                at = end
            out.append(("".join([*parts, value[at:]]), sorted({x[2] for x in found}), len(found)))
        return pd.DataFrame(out, columns=["text", "types", "n"])

    return work(text)
