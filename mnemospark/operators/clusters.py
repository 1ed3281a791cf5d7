"""Greedy clusters of vectors of any number: each row joins the first seed, in order, that is near enough, or is a seed.

Which rows are seeds depends on the rows before, but not one by one: a row without an earlier undecided row near it is a
seed, and a row near a seed is none. Such rounds decide the rows of a large group, each by comparing blocks of undecided
rows, of which only a row's own verdict comes out, never its pairs. Groups of one block are decided by one pass in order.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.chunk_store import shared_dir

#: Rows of a block; a task compares two. Undecided rows of a group that are few enough are decided in order.
BLOCK = 2048


def units(vectors) -> np.ndarray:
    x = np.stack(list(vectors)).astype(float)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def in_order(pdf: pd.DataFrame, theta: float) -> pd.DataFrame:
    """(grp, id, seed) of one group's rows by one pass over them."""
    pdf = pdf.sort_values("id")
    x, ids = units(pdf.v), pdf.id.to_numpy()
    near, seed = x @ x.T >= theta - 1e-12, np.full(len(x), -1)
    for i in range(len(x)):
        if seed[i] < 0:
            # All later rows near this seed that no earlier seed took.
            near[i, i] = True
            seed[np.flatnonzero(near[i] & (seed < 0) & (np.arange(len(x)) >= i))] = i
    return pd.DataFrame({"grp": pdf.grp.to_numpy(), "id": ids, "seed": ids[seed]})


def least_near(left: DataFrame, right: DataFrame, theta: float, block: int) -> DataFrame:
    """(grp, id, least): for rows of left (grp, id, v) the least id of right, below their own, whose vector is near; rows with none are left out.

    Both sides of a group are dealt into blocks, and a task compares one of each.
    """
    parts = lambda df, name: df.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = parts(left, "m").join(parts(right, "n"), "grp")

    def deal(df: DataFrame, own: str, other: str, count: str, opposite: str) -> DataFrame:
        placed = df.join(sizes, "grp").withColumn(own, F.pmod(F.xxhash64("id"), F.col(count)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(opposite) - 1)))
        return placed.select("grp", "i", "j", F.lit(own).alias("side"), "id", "v")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.side == "i"], pdf[pdf.side == "j"].sort_values("id")
        if not len(a) or not len(b):
            return pd.DataFrame({"grp": [], "id": [], "least": []})
        own, other = a.id.to_numpy(), b.id.to_numpy()
        near = (units(a.v) @ units(b.v).T >= theta - 1e-12) & (other[None, :] < own[:, None])
        some = near.any(1)
        return pd.DataFrame({"grp": a.grp.to_numpy()[some], "id": own[some], "least": other[near.argmax(1)[some]]})

    both = deal(left, "i", "j", "m", "n").unionByName(deal(right, "j", "i", "n", "m"))
    found = both.groupBy("grp", "i", "j").applyInPandas(compare, "grp long, id long, least long")
    return found.groupBy("grp", "id").agg(F.min("least").alias("least"))


def greedy_clusters(vectors: DataFrame, group: str, order: str, theta: float, vector: str = "v", block: int = BLOCK) -> DataFrame:
    """(grp, id, seed): the cluster of each row (group, order, vector), as one pass over the group's rows in order makes it.

    Rows with a null vector, like zero vectors, are near nothing: each is a seed. order is unique within a group.
    """
    spark = vectors.sparkSession
    kept = lambda df: _kept(spark, df)
    rows = kept(vectors.select(F.col(group).cast("long").alias("grp"), F.col(order).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")))
    alone = F.coalesce(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), F.lit(0.0)) == 0
    # Equal vectors share their first row's seed, so a large group of copies is one row here.
    first = rows.where(~alone).withColumn("first", F.min("id").over(W.partitionBy("grp", "v")))
    reps = kept(first.where("id = first").drop("first"))
    sizes = reps.groupBy("grp").agg(F.count("*").alias("n"))
    small = reps.join(sizes.where(F.col("n") <= block).select("grp"), "grp", "left_semi")
    done = small.groupBy("grp").applyInPandas(lambda pdf: in_order(pdf, theta), "grp long, id long, seed long")
    open_ = kept(reps.join(sizes.where(F.col("n") > block).select("grp"), "grp", "left_semi"))
    seeds, large = open_.select("grp", "id", "v").limit(0), open_
    while open_.limit(1).count():
        few = kept(open_.join(open_.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") <= block).select("grp"), "grp", "left_semi"))
        many = open_.join(few.select("grp").distinct(), "grp", "left_anti")
        ends = few.groupBy("grp").applyInPandas(lambda pdf: in_order(pdf, theta), "grp long, id long, seed long").where("id = seed").select("grp", "id")
        blocked = least_near(many, many, theta, block).select("grp", "id")
        new = kept(few.join(ends, ["grp", "id"], "left_semi").unionByName(many.join(blocked, ["grp", "id"], "left_anti")))
        seeds = kept(seeds.unionByName(new))
        rest = many.join(new.select("grp", "id"), ["grp", "id"], "left_anti")
        open_ = kept(rest.join(least_near(rest, new, theta, block).select("grp", "id"), ["grp", "id"], "left_anti"))
    own = seeds.select("grp", "id", F.col("id").alias("seed"))
    others = large.join(seeds.select("grp", "id"), ["grp", "id"], "left_anti")
    joined = least_near(others, seeds, theta, block).withColumnRenamed("least", "seed")
    of = done.unionByName(own).unionByName(joined).withColumnRenamed("id", "first")
    copies = first.select("grp", "id", "first").join(of, ["grp", "first"]).select("grp", "id", "seed")
    return copies.unionByName(rows.where(alone).select("grp", "id", F.col("id").alias("seed")))


def _kept(spark, df: DataFrame) -> DataFrame:
    """df written to the shared folder, which cuts its lineage."""
    path = f"{shared_dir(spark)}/clusters-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merged_refs(clusters: DataFrame, refs: DataFrame) -> DataFrame:
    """(grp, seed, ref, place): each cluster's distinct references (grp, id, ref), in the order of the rows that bring them; a row each, so no cluster is gathered."""
    first = clusters.join(refs, ["grp", "id"]).groupBy("grp", "seed", "ref").agg(F.min("id").alias("by"))
    return first.withColumn("place", F.row_number().over(W.partitionBy("grp", "seed").orderBy("by", "ref")))
