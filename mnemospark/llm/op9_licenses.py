"""License scan: phrases in place, and an exact set-similarity join of text blocks with license templates.

A template is a license statement, and a block is a run of SPREAD times as many words of a document, wherever its lines
break; both are sets of words. So wrapped statements are found, as are those with words between, whatever else stands on
their line, and endless lines don't match by scattered words. Words of the templates are ordered by how often they occur
in all documents, rarest first. A block that holds at least the threshold's share of a template must hold one of the
template's first words in that order (prefix filter) and enough template words at all (length filter), with enough of
both sets still to come after the first common word (positional filter). Stretches that hold every run once are filtered
and counted first; in those that are left the runs themselves are counted in full, so every block that meets the
threshold is found and no other.

Nulls and ties: a null text is empty, n_words 0 and no labels; a null doc_id is kept; rows that repeat give a row each;
empty tables give no rows. Only doc_id and text are read, so other columns never clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import SpanHasher, byte_class, segments, table, text_buffer, word_spans

# The phrases that the contract names and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# License statements, from single sentences to whole public texts, and the label of each.
TEMPLATES = (
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "all rights reserved no part may be reproduced without permission"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied "
        "including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability "
        "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
        "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software "
        "even if advised of the possibility of such damage",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
)
CONTAINMENT = 0.8
#: Words of a block for each word of its template.
SPREAD = 2


def hashed_words(texts: list[str]) -> list[np.ndarray]:
    """The hashes of each text's words."""
    hasher, out = SpanHasher(), []
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        start, end, _ = word_spans(data, np.array([0, len(data)]), byte_class("alnum"))
        out.append(hasher.of(hasher.prefix(data), start, end))
    return out


def template_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each word of the vocabulary (sorted hashes) occurs in all documents; one row a word comes to the driver."""

    def count(batches):
        hasher, inside, total = SpanHasher(), byte_class("alnum"), np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for low, high in segments(offsets):
                part = data[offsets[low] : offsets[high]]
                start, end, _ = word_spans(part, offsets[low : high + 1] - offsets[low], inside)
                if len(start):
                    h = hasher.of(hasher.prefix(part), start, end)
                    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                    total += np.bincount(at[vocabulary[at] == h], minlength=len(vocabulary))
        yield pa.RecordBatch.from_pydict({"word": pa.array(range(len(vocabulary)), pa.int64()), "n": pa.array(total)})

    out = np.zeros(len(vocabulary), np.int64)
    for word, n in docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").sum("n").collect():
        out[word] = n
    return out


class Templates:
    """Templates (label, hashes of words) as sets of places in the global order, with prefixes for a containment threshold."""

    def __init__(self, templates, containment: float, vocabulary: np.ndarray, frequency: np.ndarray):
        order = np.lexsort((vocabulary, frequency))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.vocabulary, self.rank = vocabulary, rank
        self.labels = [label for label, _ in templates]
        self.has = np.zeros((len(templates), len(vocabulary)), bool)
        self.size, self.need, self.words, posting = [], [], [], []
        for t, (_, words) in enumerate(templates):
            places = np.sort(rank[np.searchsorted(vocabulary, np.unique(words))])
            self.has[t, places] = True
            self.size.append(len(places))
            self.words.append(len(words))
            need = int(np.ceil(containment * len(places) - 1e-9))
            self.need.append(need)
            posting += [(int(p), t, i) for i, p in enumerate(places[: len(places) - need + 1])]
        self.size, self.need = np.array(self.size), np.array(self.need)
        posting.sort()
        self.posting = np.array(posting, np.int64).reshape(-1, 3)
        self.ptr = np.searchsorted(self.posting[:, 0], np.arange(len(vocabulary) + 1))
        self.run = SPREAD * np.array(self.words, np.int64)

    def matches(self, block: np.ndarray, place: np.ndarray):
        """(block, template, containment) for blocks given by the block and place of each of their words that templates know."""
        pair = np.unique(block * len(self.vocabulary) + place)
        block, place = pair // len(self.vocabulary), pair % len(self.vocabulary)
        names, first, size = np.unique(block, return_index=True, return_counts=True)
        of = np.repeat(np.arange(len(names)), size)
        j = np.arange(len(block)) - first[of]
        n = self.ptr[place + 1] - self.ptr[place]
        hit = np.repeat(np.arange(len(block)), n)
        post = self.posting[np.repeat(self.ptr[place] - (np.cumsum(n) - n), n) + np.arange(len(hit))]
        # Words of a block come in the global order: the first hit of a pair is its first common word, so none is before it.
        pairs, at = np.unique(of[hit] * len(self.labels) + post[:, 1], return_index=True)
        t, i, hit = post[at, 1], post[at, 2], hit[at]
        most = 1 + np.minimum(self.size[t] - i - 1, size[of[hit]] - j[hit] - 1)
        candidates = pairs[(size[of[hit]] >= self.need[t]) & (most >= self.need[t])]
        b, t = candidates // len(self.labels), candidates % len(self.labels)
        common = np.array([self.has[u, place[first[x] : first[x] + size[x]]].sum() for x, u in zip(b, t, strict=True)], np.int64)
        keep = common >= self.need[t] if len(t) else np.zeros(0, bool)
        return names[b[keep]], t[keep], common[keep] / self.size[t[keep]]

    def runs(self, row: np.ndarray, begin: np.ndarray, word: np.ndarray, at: np.ndarray):
        """(row, template, share) for the runs of words within a row that hold the threshold's share of a template.

        Given are the row of each word, where each row begins, and which words are the at-th of the vocabulary.
        """
        half = int(self.run.max())
        mine = self.has.any(0)[self.rank[at]]
        word, at = word[mine], at[mine]
        # Stretches of 2 * half words begin at each half, so that each run lies within one; a word is in two of them.
        own = (word - begin[row[word]]) // half
        of = np.r_[0, np.cumsum((np.diff(np.r_[begin, len(row)]) + half - 1) // half)]
        block = of[row[word]] + own
        earlier = np.flatnonzero(own > 0)
        block, word = np.concatenate([block, block[earlier] - 1]), np.concatenate([word, word[earlier]])
        place = self.rank[np.concatenate([at, at[earlier]])]
        some = np.unique(block[self.ptr[place + 1] > self.ptr[place]])
        keep = np.isin(block, some)
        block, word, place = block[keep], word[keep], place[keep]
        order = np.argsort(block, kind="stable")
        block, word, place = block[order], word[order], place[order]
        found, t, _ = self.matches(block, place)
        rows, kinds, shares = [], [], []
        for low in range(0, len(found), 4096):
            b, u = found[low : low + 4096], t[low : low + 4096]
            best = self.fullest(u, word, place, np.searchsorted(block, b), np.searchsorted(block, b, "right"))
            full = best >= self.need[u]
            rows.append(np.searchsorted(of, b[full], "right") - 1)
            kinds.append(u[full])
            shares.append(best[full] / self.size[u[full]])
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, kinds, shares))

    def fullest(self, t: np.ndarray, word: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Most different words of template t that a run of its length holds, for stretches low..high of words at places."""
        n = high - low
        group = np.repeat(np.arange(len(t)), n)
        at = np.arange(len(group)) - np.repeat(np.cumsum(n) - n - low, n)
        mine = self.has[t[group], place[at]]
        group, at = group[mine], at[mine]
        # A run that begins at the i-th word ends before the to[i]-th.
        key = (group << 40) + word[at]
        to = np.searchsorted(key, key + self.run[t[group]])
        same = group * self.has.shape[1] + place[at]
        order, after = np.argsort(same, kind="stable"), np.full(len(at), len(at))
        again = np.flatnonzero(same[order[1:]] == same[order[:-1]])
        after[order[again]] = order[again + 1]
        # A word counts in the runs that hold it but not the next place of the same word: those from first to before past.
        each = np.arange(len(at))
        first, past = np.searchsorted(to, each, "right"), np.minimum(each + 1, np.searchsorted(to, after, "right"))
        count = np.cumsum(np.bincount(first, minlength=len(at) + 1) - np.bincount(past, minlength=len(at) + 1))[: len(at)]
        best = np.zeros(len(t), np.int64)
        np.maximum.at(best, group, count)
        return best


def by_length(templates, containment: float, vocabulary: np.ndarray, frequency: np.ndarray) -> list[Templates]:
    """The templates by the power of two that holds their words, as stretches of text grow with the longest run."""
    sizes = {}
    for label, words in templates:
        sizes.setdefault(len(words).bit_length(), []).append((label, words))
    return [Templates(own, containment, vocabulary, frequency) for own in sizes.values()]


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """A row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest share of a template that a run of words holds, 1 where a phrase stands, 0 without labels.
    """
    templates = list(zip([label for label, _ in templates], hashed_words([text for _, text in templates]), strict=True))
    vocabulary = np.unique(np.concatenate([words for _, words in templates]))
    joins = by_length(templates, containment, vocabulary, template_frequencies(docs, vocabulary))
    wanted = list(zip(hashed_words(list(phrases)), phrases.values(), strict=True))

    def find(batches):
        hasher, inside = SpanHasher(), byte_class("alnum")
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for low, high in segments(offsets):
                part, own, n = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], high - low
                start, end, row = word_spans(part, own, inside)
                words = np.bincount(row, minlength=n)
                begin = np.cumsum(words) - words
                base, labels, score = [set() for _ in range(n)], [set() for _ in range(n)], np.zeros(n)
                places, first, last = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
                if len(start):
                    h = hasher.of(hasher.prefix(part), start, end)
                    for phrase, label in wanted:
                        at = np.flatnonzero(h[: len(h) - len(phrase) + 1] == phrase[0])
                        for k in range(1, len(phrase)):
                            at = at[h[at + k] == phrase[k]]
                        at = at[row[at] == row[at + len(phrase) - 1]]
                        for r, p in zip(row[at].tolist(), (at - begin[row[at]]).tolist(), strict=True):
                            base[r].add(label)
                            places[r] += 1
                            first[r] = p if first[r] < 0 else min(first[r], p)
                            last[r] = max(last[r], p)
                            score[r] = 1.0
                    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                    known = np.flatnonzero(vocabulary[at] == h)
                    for join in joins:
                        for r, u, share in zip(*(x.tolist() for x in join.runs(row, begin, known, at[known])), strict=True):
                            labels[r].add(join.labels[u])
                            score[r] = max(score[r], share)
                none = first < 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, n), pa.array(words, pa.int64()), pa.array(places), pa.array(first, mask=none), pa.array(last, mask=none), pa.array([",".join(sorted(x)) for x in base]), pa.array([",".join(sorted(x | y)) for x, y in zip(base, labels, strict=True)]), pa.array(score)],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(find, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


_LIST = lambda text: "[" + ", ".join(f"'{w}'" for w in text.split()) + "]"
ORACLE = rf"""
WITH low AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
worded AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
phrases(words, label) AS (VALUES {", ".join(f"({_LIST(p)}, '{v}')" for p, v in PHRASES.items())}),
places AS (
  SELECT r, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1 : i + len(words)] = words)) AS p FROM worded, phrases WHERE list_has_all(w, words)),
based AS (SELECT r, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word FROM places GROUP BY r),
templates(t, label, words) AS (VALUES {", ".join(f"({t}, '{v}', {_LIST(x)})" for t, (v, x) in enumerate(TEMPLATES))}),
wanted AS (SELECT t, label, unnest(list_distinct(words)) AS word, len(list_distinct(words)) AS size, {SPREAD} * len(words) - 1 AS rest FROM templates),
held AS (SELECT r, i, t, label, size, rest, word FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM worded) JOIN wanted USING (word)),
many AS (SELECT r, t FROM held GROUP BY r, t HAVING count(DISTINCT word) >= ceil({CONTAINMENT} * any_value(size) - 1e-9)),
runs AS (SELECT r, label, size, count(DISTINCT word) OVER (PARTITION BY r, t ORDER BY i RANGE BETWEEN CURRENT ROW AND rest FOLLOWING) AS n FROM held SEMI JOIN many USING (r, t)),
met AS (SELECT r, label, n / size::DOUBLE AS share FROM runs WHERE n >= ceil({CONTAINMENT} * size - 1e-9)),
named AS (SELECT r, label, 1.0::DOUBLE AS share, true AS base FROM places UNION ALL SELECT r, label, share, false FROM met),
summed AS (SELECT r, max(share) AS score, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels FROM named GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM worded LEFT JOIN based USING (r) LEFT JOIN summed USING (r)
"""
