"""Periodic runs of words: every lag up to n / min_exp is compared with the whole word-id array, and stretches of equal words are run-length coded.

A run is a stretch with smallest period q and at least max(min_length, min_exp * q) words that no neighbouring word
extends. Documents of up to LONG words are scanned where they are read. Longer ones are cut into ranges of lags, a range
for each LONG words, which Spark deals to tasks with the document's word ids; a document's runs then meet again by its key.

Nulls: a null text has no words; a null doc_id is never rewritten. Rows that repeat each have their row. Empty texts and
documents without a run have the digests of empty and of their own words; an empty table gives no rows. Only doc_id and
text are read, so other columns never clash.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Kept, table

MIN_EXP, MIN_LENGTH = 3, 24
#: Words of a document for each range of its lags.
LONG = 8192
WORD = re.compile("[^\x20\x09-\x0d]+")
RUNS = "array<struct<start: long, length: long, period: long>>"


def word_ids(words: list[str]) -> np.ndarray:
    """Equal numbers for equal words, in the smallest type that holds them."""
    seen: dict[str, int] = {}
    ids = [seen.setdefault(w, len(seen)) for w in words]
    return np.array(ids, np.uint16 if len(seen) <= 1 << 16 else np.uint32)


def stretches(ids: np.ndarray, low: int, high: int, min_exp: int = MIN_EXP, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, lag) of the maximal stretches that are long enough, for lags low <= lag < high."""
    out, n = [], len(ids)
    for lag in range(low, min(high, n // min_exp + 1)):
        same = ids[lag:] == ids[: n - lag]
        least = max(min_length, min_exp * lag) - lag
        if np.count_nonzero(same) < least:
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).view(np.int8)))
        begin, size = edges[::2], edges[1::2] - edges[::2]
        keep = size >= least
        out += [(int(b), int(s) + lag, lag) for b, s in zip(begin[keep], size[keep], strict=True)]
    return out


def smallest_periods(found) -> list[tuple[int, int, int]]:
    """Runs by start, then period. A stretch that has a shorter period too is that period's stretch, with the same ends."""
    least: dict[tuple[int, int], int] = {}
    for start, length, lag in found:
        least[start, length] = min(lag, least.get((start, length), lag))
    return sorted(((s, n, q) for (s, n), q in least.items()), key=lambda r: (r[0], r[2]))


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, compared as whole numbers; of equals the first."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that repeat a run's first period."""
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    kept = np.cumsum(edges)[:-1] == 0
    return [w for w, k in zip(words, kept, strict=True) if k]


def periodic_runs(docs: DataFrame, rewrite: Callable | None = None, min_exp: int = MIN_EXP, min_length: int = MIN_LENGTH, long: int = LONG) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): all runs of each document by start, then period, and its text without the repeats.

    rewrite(doc_id, words) may change the words first.
    """
    ids_type = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {ids_type}, n_words long, runs {RUNS}, collapsed string"
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def words_of(doc_id, text) -> list[str]:
        words = WORD.findall(text or "")
        return rewrite(doc_id, words) if rewrite else words

    def rows(got: list[tuple], ids: pa.Array) -> pa.RecordBatch:
        runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for _, runs in got], run_type)
        texts = pa.array([" ".join(collapsed(words, runs)) for words, runs in got], pa.string())
        return pa.RecordBatch.from_arrays([ids, pa.array([len(w) for w, _ in got], pa.int64()), runs, texts], names=["doc_id", "n_words", "runs", "collapsed"])

    def here(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                got = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = words_of(doc_id, text)
                    got.append((words, smallest_periods(stretches(word_ids(words), 1, len(words) + 1, min_exp, min_length))))
                yield rows(got, part.column(0))

    def ranges(batches):
        """A row for each range of a document's lags."""
        for batch in batches:
            for key, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = word_ids(words_of(doc_id, text))
                parts = max(1, -(-len(ids) // long))
                cuts = np.linspace(1, len(ids) // min_exp + 1, parts + 1).astype(np.int64)
                for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if low < high:
                        yield pa.RecordBatch.from_pydict({"__key": [key], "low": [low], "high": [high], "width": pa.array([ids.itemsize], pa.int32()), "ids": [ids.tobytes()]})

    def scanned(batches):
        for batch in batches:
            for key, low, high, width, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = stretches(np.frombuffer(raw, np.uint16 if width == 2 else np.uint32), low, high, min_exp, min_length)
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in found]], run_type)], names=["__key", "found"])

    def finished(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, text, found, times = (batch.column(c)[i].as_py() for c in range(4))
                runs = smallest_periods((r["start"], r["length"], r["period"]) for r in found or ())
                one = rows([(words_of(doc_id, text), runs)], batch.column(0).slice(i, 1))
                for _ in range(times):
                    yield one

    # A document of at most twice this many bytes has no more words than long, as white space stands between words.
    is_long = F.coalesce(F.octet_length("text"), F.lit(0)) > 2 * long
    short = docs.select("doc_id", "text").where(~is_long).mapInArrow(here, schema)
    # Rows that repeat are scanned once: the counts are summed before the shuffle, so they are no hot key.
    once = docs.select("doc_id", "text").where(is_long).groupBy("doc_id", "text").agg(F.count("*").alias("times"))
    whole = Kept(docs.sparkSession).keep(once.withColumn("__key", F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text"), 256)), "long-documents")
    pieces = whole.select("__key", "doc_id", "text").mapInArrow(ranges, "__key string, low long, high long, width int, ids binary").repartition("__key", "low")
    found = pieces.mapInArrow(scanned, f"__key string, found {RUNS}").groupBy("__key").agg(F.flatten(F.collect_list("found")).alias("found"))
    joined = whole.join(found, "__key", "left").select("doc_id", "text", "found", "times")
    return short.unionByName(joined.mapInArrow(finished, schema))


def planted(doc_id, words: list[str]) -> list[str]:
    """A tenth of the documents, chosen by their id's checksum, repeat from some word on with a period drawn from it."""
    n = len(words)
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def with_digests(found: DataFrame) -> DataFrame:
    """The query's columns: number of runs, the one with the greatest exponent, digests of all runs and of the collapsed text."""

    def work(batches):
        for batch in batches:
            cols = {k: [] for k in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256")}
            for runs in batch.column(1).to_pylist():
                runs = [(r["start"], r["length"], r["period"]) for r in runs]
                best = greatest(runs)
                cols["n_runs"].append(len(runs))
                for i, name in enumerate(("start", "length", "period")):
                    cols[name].append(best and best[i])
                cols["exponent_milli"].append(best and 1000 * best[1] // best[2])
                cols["runs_sha256"].append(hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest())
            arrays = [pa.array(v, pa.string() if k == "runs_sha256" else pa.int64()) for k, v in cols.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, batch.column(2)], names=["doc_id", *cols, "collapsed_sha256"])

    schema = f"doc_id {dict(found.dtypes)['doc_id']}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return found.select("doc_id", "runs", F.sha2("collapsed", 256)).mapInArrow(work, schema)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digests(periodic_runs(table(spark, sf_dir, "documents"), planted))
