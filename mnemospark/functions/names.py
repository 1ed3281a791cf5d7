"""Stable keys of subjects and attributes, in Arrow batches: Unicode normal forms and case folding have no built-in counterpart."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ASPECTS, SELF, col

# Where letters and digits meet, what is not a word, and white space.
_MEET = re.compile(r"(?<=[^\W\d_])(?=\d)|(?<=\d)(?=[^\W\d_])")
_MARKS, _SPACE = re.compile(r"[^\w\s]"), re.compile(r"\s+")


def _plain(label: str) -> str:
    return _SPACE.sub(" ", _MARKS.sub(" ", label)).strip().casefold()


def _by_value(work):
    """A column function of a string function; equal labels of a batch are worked on once."""

    def apply(label: Column | str) -> Column:
        @F.pandas_udf("string")
        def batch(values: pd.Series) -> pd.Series:
            values = values.fillna("")
            return values.map({x: work(x) for x in values.unique()})

        return batch(col(label))

    return apply


#: Letters and digits apart, no punctuation, single spaces, folded case.
subject = _by_value(lambda x: _plain(_MEET.sub(" ", unicodedata.normalize("NFKC", x))))
#: Synonyms folded to one name, words joined by underscores.
aspect = _by_value(lambda x: ASPECTS.get(_plain(unicodedata.normalize("NFKC", x)).replace(" ", "_"), _plain(unicodedata.normalize("NFKC", x)).replace(" ", "_")))


def is_self(label: Column) -> Column:
    """Whether a label means the speaker."""
    return F.lower(F.trim(label)).isin(*SELF)


def resolved(label: Column, kind: Column, user: Column, alias: Column, proposed: Column, known: Column, matches: Column, mint: bool = False) -> Column:
    """The subject of a label: the speaker, an alias, a proposal that exists, the only exact match, else a new one.

    alias is null without one; known says whether the proposed subject exists; matches is the sorted array of subjects of
    the label's key. Of several matches none is chosen: null, or a new one if mint.
    """
    new = F.concat(kind, F.lit(":"), subject(label))
    several = new if mint else F.lit(None).cast("string")
    return F.when(is_self(label) & user.isNotNull(), F.concat(F.lit("user:"), user)).when(alias.isNotNull(), alias).when(known, proposed).when(F.size(matches) == 1, matches[0]).when(F.size(matches) > 1, several).otherwise(new)
