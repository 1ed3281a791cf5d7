"""Work graphs as a log of patches: a graph is what its patches make of it, so any time's state is a fold of those up to then."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def graphs(patches: DataFrame, fields: list[str], until=None) -> DataFrame:
    """(graph_id, created_at, updated_at, fields): patches (graph_id, seq, at, fields) merged, each field as its last patch that has it.

    The first patch creates a graph. With a time, only graphs that exist then, in their state then. It is one aggregation
    with partial results, so a graph of many patches is no hot key. A field that no patch has is null.
    """
    if until is not None:
        patches = patches.where(F.col("at") <= F.lit(until).cast("timestamp_ntz"))
    last = [F.max(F.when(F.col(f).isNotNull(), F.struct("seq", F.col(f).alias("value"))))["value"].alias(f) for f in fields]
    return patches.groupBy("graph_id").agg(F.min("at").alias("created_at"), F.max("at").alias("updated_at"), *last)


def existing(current: DataFrame, at) -> DataFrame:
    """Of graphs in their current state those that existed at a time."""
    return current.where(F.col("created_at") <= F.lit(at).cast("timestamp_ntz"))


def listed(current: DataFrame, by: str, most: int = 50) -> DataFrame:
    """The oldest graphs of each namespace, then by id, with their place."""
    place = F.row_number().over(W.partitionBy(by).orderBy("created_at", "graph_id"))
    return current.withColumn("place", place).where(F.col("place") <= most)
