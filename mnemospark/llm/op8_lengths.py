"""Exact length histogram of encoded documents; suffix sums answer every context limit.

Nulls: a null text is empty (length 0 without an end token). Rows that repeat count each. An empty table gives no rows.
Only the text column is read, so other columns never clash.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Kept, table
from .tokens import default_path, encoder

#: Lengths that share a block of the two-level suffix sums.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(length, n_docs) by task: each task counts its own lengths, so a row of output stands for many documents."""

    def count(batches):
        enc, seen = encoder(path), {}
        size = enc.dtype.itemsize
        for batch in batches:
            for value in batch.column(0):
                n = len(enc.encode(value.as_py() or "")) // size
                seen[n] = seen.get(n, 0) + 1
        yield pa.RecordBatch.from_pydict({"length": pa.array(seen.keys(), pa.int64()), "n_docs": pa.array(seen.values(), pa.int64())})

    return docs.select(text).mapInArrow(count, "length long, n_docs long")


def length_histogram(lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each length: documents and tokens of that length, of it or more, and what a limit of that length keeps.

    docs_from and tokens_from count documents of at least this length; tokens_kept is the corpus cut to this length;
    tokens_cut is what that loses; quantile is the share of documents of at most this length.
    """
    hist = lengths.groupBy("length").agg(F.sum("n_docs").cast("long").alias("n_docs")).withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn("__block", F.floor(F.col("length") / block))
    blocks = hist.groupBy("__block").agg(F.sum("n_docs").alias("__d"), F.sum("tokens").alias("__t"))
    later = W.orderBy("__block").rowsBetween(1, W.unboundedFollowing)
    everything = W.partitionBy()
    zero = F.lit(0).cast("long")
    blocks = blocks.select("__block", F.coalesce(F.sum("__d").over(later), zero).alias("__dl"), F.coalesce(F.sum("__t").over(later), zero).alias("__tl"), F.sum("__d").over(everything).alias("__n"), F.sum("__t").over(everything).alias("__all"))
    here = W.partitionBy("__block").orderBy("length").rowsBetween(W.currentRow, W.unboundedFollowing)
    out = hist.join(blocks, "__block").withColumn("docs_from", F.col("__dl") + F.sum("n_docs").over(here)).withColumn("tokens_from", F.col("__tl") + F.sum("tokens").over(here))
    shorter = F.col("__all") - F.col("tokens_from")
    kept = shorter + F.col("length") * F.col("docs_from")
    return out.select(
        "length", "n_docs", "tokens", "docs_from", "tokens_from", kept.alias("tokens_kept"), (F.col("__all") - kept).alias("tokens_cut"),
        F.round((F.col("__n") - F.col("docs_from") + F.col("n_docs")) / F.col("__n"), 9).alias("quantile"),
    )


def at_limit(hist: DataFrame, limit: int) -> DataFrame:
    """One row for any context limit, in the histogram or not: documents that fit, total, kept and cut tokens."""
    kept = F.sum(F.least(F.col("length"), F.lit(limit)) * F.col("n_docs"))
    return hist.agg(F.sum(F.when(F.col("length") <= limit, F.col("n_docs")).otherwise(0)).alias("docs_fit"), F.sum("tokens").alias("tokens"), kept.alias("tokens_kept"), (F.sum("tokens") - kept).alias("tokens_cut"))


def length_quantile(hist: DataFrame, q: float) -> Column:
    """The least length that at least this share of documents doesn't exceed; for hist.agg()."""
    return F.min(F.when(F.col("quantile") >= q - 1e-9, F.col("length")))


def op8_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The histogram reads its counts twice; kept, they are encoded once.
    counts = Kept(spark).keep(encoded_lengths(table(spark, sf_dir, "documents"), default_path()), "lengths")
    return length_histogram(counts)
