"""Fill-in-middle transformation: each document is cut into prefix, middle and suffix at whole units and put together anew.

Counting a document's units leaves a sparse index: byte and code-point offsets at every CHECKPOINT-th unit. A cut is found
by binary search among these checkpoints and a rescan of fewer than CHECKPOINT units, so a text is neither decoded nor split.

Nulls: a null text is empty; a null doc_id counts as an empty number when cuts are drawn. An empty text, or one that holds
a sentinel, stays as it is (form plain; prefix_chars and middle_chars null). Rows that repeat give equal rows; an empty
table gives none. Only doc_id and text are read, so other columns never clash.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import segments, table, text_buffer

SENTINELS = ("<P>", "<S>", "<M>")
#: Units between two checkpoints, and bytes that are counted at a time.
CHECKPOINT, BLOCK = 64, 1 << 20
NEWLINE = 10


class Checkpoints:
    """Offsets of every CHECKPOINT-th line of UTF-8 bytes; a line ends with its newline or with the text."""

    def __init__(self, data: np.ndarray, every: int = CHECKPOINT, block: int = BLOCK):
        self.data, self.size = data, len(data)
        units, at_byte, at_char, lines, chars = [0], [0], [0], 0, 0
        for low in range(0, len(data), block):
            part = data[low : low + block]
            first = (part & 0xC0) != 0x80  # the first byte of a code point
            ends = np.flatnonzero(part == NEWLINE) + 1
            # Of this block's lines, those whose number is a multiple of every.
            marks = ends[every - 1 - lines % every :: every]
            before = 0
            for mark in marks.tolist():
                chars += int(np.count_nonzero(first[before:mark]))
                units.append(units[-1] + every)
                at_byte.append(low + mark)
                at_char.append(chars)
                before = mark
            chars += int(np.count_nonzero(first[before:]))
            lines += len(ends)
        self.units, self.at_byte, self.at_char = (np.array(x, np.int64) for x in (units, at_byte, at_char))
        self.count = lines + (1 if len(data) and data[-1] != NEWLINE else 0)
        self.chars = chars

    def seek(self, unit: int) -> tuple[int, int]:
        """Byte and code-point offset of the start of a unit; of the text's end for the number of units."""
        if unit >= self.count:
            return self.size, self.chars
        i = int(np.searchsorted(self.units, unit, "right")) - 1
        low, left = int(self.at_byte[i]), unit - int(self.units[i])
        high = int(self.at_byte[i + 1]) if i + 1 < len(self.units) else self.size
        if not left:
            return low, int(self.at_char[i])
        part = self.data[low:high]
        to = int(np.flatnonzero(part == NEWLINE)[left - 1]) + 1
        return low + to, int(self.at_char[i]) + int(np.count_nonzero((part[:to] & 0xC0) != 0x80))


def draws(doc_id, seed: int) -> list[int]:
    """Four 32-bit numbers from the hash of seed and id."""
    found = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(found[i : i + 8], 16) for i in range(0, 32, 8)]


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, sentinels=SENTINELS, every: int = CHECKPOINT) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): rate percent of the documents are rearranged, spm percent of these suffix first."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n long, form string, prefix_chars long, middle_chars long, output string"
    marks = [s.encode() for s in sentinels]

    def rearranged(doc_id, data: np.ndarray):
        index, raw = Checkpoints(data, every), data.tobytes()
        h = draws(doc_id, seed)
        if not raw or any(m in raw for m in marks) or h[2] % 100 >= rate:
            return index.count, "plain", None, None, raw
        cuts = sorted((h[0] % (index.count + 1), h[1] % (index.count + 1)))
        (a, a_chars), (b, b_chars) = (index.seek(u) for u in cuts)
        prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
        p, s, m = marks
        form = "spm" if h[3] % 100 < spm else "psm"
        out = s + suffix + p + prefix + m + middle if form == "spm" else p + prefix + s + suffix + m + middle
        return index.count, form, a_chars, b_chars - a_chars, out

    def work(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            ids = batch.column(0)
            for low, high in segments(offsets):
                got = [rearranged(ids[i].as_py(), data[offsets[i] : offsets[i + 1]]) for i in range(low, high)]
                n, form, prefix, middle, out = zip(*got, strict=True)
                cols = [ids.slice(low, high - low), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select("doc_id", "text").mapInArrow(work, schema)


def restored(output: Column, form: Column, sentinels=SENTINELS) -> Column:
    """The text from which an output was made: no sentinel occurs in it, so each splits the output in one place only."""
    parts = F.split(output, "|".join(map(re.escape, sentinels)), -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fill_in_middle(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM lines),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
pieces AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM cuts)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM pieces
"""
