"""Near-duplicate embeddings by an epsilon grid order join, exact for cosine.

Unit vectors with cosine of at least c lie within epsilon = sqrt(2 - 2c) of each other. Their coordinates on the leading
principal dimensions, cut into cells of width epsilon, give a lexicographic order; the sequence in that order is cut into
intervals of LEAF rows, described by their bounding boxes in those dimensions and in one more, the norm of what lies
outside them, as |a - b|^2 is at least |pa - pb|^2 + (ra - rb)^2. A pair of intervals is skipped if its boxes are more than
epsilon apart; else its halves are joined, down to intervals that are compared by matrix products. The upper levels of
this recursion run as joins of box tables, FAN children at a time, so only pairs of tiles that may hold links are dealt
to tasks; the lower levels run inside the task of a pair of tiles.

Equal vectors become one class, linked among themselves and counted by their number, so copies are not paired. A task
returns counts of links by vector and a spanning forest of what it linked, never all its pairs.

Nulls and ties: vectors that are null, zero, or hold null or non-finite components have n_links 0 and are their own
component; vectors of different length are not compared. Rows that share a vec_id are one vector id with several
vectors. A null vec_id links with nothing. Empty tables give no rows. Only vec_id and embedding are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Kept, components, mix64, table

COSINE = 0.95
#: Principal dimensions that order and bound the intervals.
DIMENSIONS = 8
#: Rows of a tile (two are in a task), of an interval compared by a product, and children of an interval above tiles.
TILE, LEAF, FAN = 8192, 512, 8
SLACK = 1e-9


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, k1, k2): vectors that can be linked, as doubles, with a digest of their bytes."""

    def keep(batches):
        for batch in batches:
            ids, raw, keys = [], [], []
            for i, value in zip(batch.column(0), batch.column(1), strict=True):
                x = value.as_py()
                if i.as_py() is None or not x or None in x:
                    continue
                x = np.asarray(x, np.float64)
                if np.isfinite(x).all() and x.any():
                    x = x + 0.0  # -0 and 0 are one number
                    ids.append(i.as_py())
                    raw.append(x.tobytes())
                    u = mix64(x.view(np.uint64) + np.arange(1, len(x) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    keys.append((int(u.sum().view(np.int64)), int(mix64(u).sum().view(np.int64))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())], ["vec_id", "v", "k1", "k2"])

    return vectors.select("vec_id", "embedding").mapInArrow(keep, "vec_id long, v binary, k1 long, k2 long")


def unit(raw, size: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(-1, size)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal(classes: DataFrame, size: int, dimensions: int) -> np.ndarray:
    """The leading eigenvectors of all unit vectors' covariance; a task sends its sums, size * (size + 1) numbers."""

    def sums(batches):
        total = np.zeros((size + 1, size))
        for batch in batches:
            if batch.num_rows:
                x = unit(batch.column(0).to_pylist(), size)
                total[:size] += x.T @ x
                total[size] += x.sum(0)
                total_n[0] += len(x)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(total.size + 1), pa.int64()), "s": pa.array([*total.ravel().tolist(), float(total_n[0])])})

    total_n = [0]
    got = np.zeros(size * (size + 1) + 1)
    for i, s in classes.select("v").mapInArrow(sums, "i long, s double").groupBy("i").agg(F.sum("s")).collect():
        got[i] = s
    n, mean = max(got[-1], 1), got[-1 - size : -1] / max(got[-1], 1)
    covariance = got[: size * size].reshape(size, size) / n - np.outer(mean, mean)
    values, axes = np.linalg.eigh(covariance)
    return axes[:, np.argsort(-values)[: min(dimensions, size)]]


def boxes_near(a_low, a_high, b_low, b_high, epsilon: float):
    gap = np.maximum(0, np.maximum(a_low - b_high, b_low - a_high))
    return np.sqrt((gap * gap).sum(-1)) <= epsilon + SLACK


def join_tiles(x: np.ndarray, px: np.ndarray, y: np.ndarray, py: np.ndarray, same: bool, cosine: float, leaf: int):
    """Yields (rows of x, rows of y) that are linked; the recursion over halves of both sequences."""
    epsilon = float(np.sqrt(2 - 2 * cosine))

    def boxes(p):
        cuts = list(range(0, len(p), leaf))
        return [p[c : c + leaf].min(0) for c in cuts], [p[c : c + leaf].max(0) for c in cuts]

    (xl, xh), (yl, yh) = boxes(px), boxes(py)

    def spread(low, high, i, j):
        return np.min(low[i:j], 0), np.max(high[i:j], 0)

    todo = [(0, len(xl), 0, len(yl))]
    while todo:
        i, j, k, m = todo.pop()
        if same and m <= i or not boxes_near(*spread(xl, xh, i, j), *spread(yl, yh, k, m), epsilon):
            continue
        if j - i == 1 and m - k == 1:
            a, b = slice(i * leaf, min(j * leaf, len(x))), slice(k * leaf, min(m * leaf, len(y)))
            r, s = np.nonzero(x[a] @ y[b].T >= cosine)
            r, s = r + i * leaf, s + k * leaf
            if same:
                up = r < s
                r, s = r[up], s[up]
            if len(r):
                yield r, s
            continue
        lefts = [(i, j)] if j - i == 1 else [(i, (i + j) // 2), ((i + j) // 2, j)]
        rights = [(k, m)] if m - k == 1 else [(k, (k + m) // 2), ((k + m) // 2, m)]
        todo += [(*p, *q) for p in lefts for q in rights]


def forest(n: int, pairs) -> list[tuple[int, int]]:
    """A spanning forest of the pairs among n nodes."""
    up = np.arange(n)

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for r, s in pairs:
        while True:  # after flattening only pairs of different trees are left
            up = up[up]
            if (up[up] == up).all():
                break
        apart = up[r] != up[s]
        for a, b in zip(r[apart].tolist(), s[apart].tolist(), strict=True):
            p, q = top(a), top(b)
            if p != q:
                up[max(p, q)] = min(p, q)
                out.append((a, b))
    return out


def grid_join(vectors: DataFrame, cosine: float = COSINE, dimensions: int = DIMENSIONS, tile: int = TILE, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """vec_id, n_links, component_id and kept by row of vectors."""
    spark = vectors.sparkSession
    kept = Kept(spark)
    good = kept.keep(usable(vectors), "vectors")
    classes = kept.keep(good.groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v"), (F.length(F.first("v")) / 8).cast("int").alias("size")), "classes")
    counts, forests = [], []
    # Vectors of different length are never linked: one join for each length, of which tables have one as a rule.
    for (size,) in classes.select("size").distinct().collect():
        own = classes.where(F.col("size") == size)
        axes, epsilon = principal(own, size, dimensions), float(np.sqrt(2 - 2 * cosine))
        d = axes.shape[1] + 1  # with the norm outside the axes

        def project(batches, axes=axes, size=size, epsilon=epsilon):
            for batch in batches:
                if batch.num_rows:
                    p = unit(batch.column(2).to_pylist(), size) @ axes
                    cell, outside = np.floor(p / epsilon).astype(np.int64), np.sqrt(np.maximum(0.0, 1 - (p * p).sum(1)))
                    p = np.column_stack([p, outside])
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.tolist(), pa.list_(pa.float64())), pa.array(cell.tolist(), pa.list_(pa.int64()))], ["id", "copies", "v", "p", "cell"])

        placed = own.select("id", "copies", "v").mapInArrow(project, "id long, copies long, v binary, p array<double>, cell array<long>")
        # Grid order: by cell, then by the leading coordinate. Ranks are two-level: rows of a range, then ranges.
        ordered = kept.keep(placed.repartitionByRange("cell", F.col("p")[0], "id").sortWithinPartitions("cell", F.col("p")[0], "id").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ordered")
        parts = ordered.groupBy("part").agg(F.count("*").alias("rows")).withColumn("before", F.coalesce(F.sum("rows").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        tiled = kept.keep(ordered.join(parts.select("part", "before"), "part").withColumn("rank", F.col("before") + F.col("at")).withColumn("tile", F.floor(F.col("rank") / tile)).select("tile", "rank", "id", "copies", "v", "p"), "tiled")
        kept.drop(ordered)
        box = lambda level: [F.min(F.col("p")[k]).alias(f"l{k}") for k in range(d)] + [F.max(F.col("p")[k]).alias(f"h{k}") for k in range(d)]
        boxes = [kept.keep(tiled.groupBy(F.col("tile").alias("i")).agg(*box(0)), "boxes")]
        while boxes[-1].count() > fan:
            boxes.append(kept.keep(boxes[-1].groupBy(F.floor(F.col("i") / fan).alias("i")).agg(*[F.min(f"l{k}").alias(f"l{k}") for k in range(d)], *[F.max(f"h{k}").alias(f"h{k}") for k in range(d)]), "boxes"))
        # At most fan intervals are on top.
        tops = range(fan)
        pairs = spark.createDataFrame([(i, j) for i in tops for j in tops if i <= j], "i long, j long")
        for level, table_of in enumerate(reversed(boxes)):
            if level:
                kids = lambda c: F.explode(F.sequence(F.col(c) * fan, F.col(c) * fan + fan - 1))
                pairs = pairs.withColumn("i", kids("i")).withColumn("j", kids("j")).where("i <= j")
            side = lambda name, t=table_of: t.select(F.col("i").alias(name), *[F.col(f"{e}{k}").alias(f"{name}{e}{k}") for e in "lh" for k in range(d)])
            gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"il{k}") - F.col(f"jh{k}"), F.col(f"jl{k}") - F.col(f"ih{k}")), 2) for k in range(d)), F.lit(0.0))
            pairs = pairs.join(side("i"), "i").join(side("j"), "j").where(F.sqrt(gap) <= epsilon + SLACK).select("i", "j")
        pairs = kept.keep(pairs, "pairs")
        left = pairs.join(tiled, F.col("tile") == F.col("i")).select("i", "j", F.lit(0).alias("side"), "rank", "id", "copies", "v", "p")
        right = pairs.where("i <> j").join(tiled, F.col("tile") == F.col("j")).select("i", "j", F.lit(1).alias("side"), "rank", "id", "copies", "v", "p")

        def compare(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["side", "rank"])
            x, y = pdf[pdf.side == 0], pdf[pdf.side == 1]
            same = not len(y)
            n = len(x)
            y = x if same else y
            ids = pdf.id.to_numpy()
            copies = pdf.copies.to_numpy()
            shift = 0 if same else n
            links, pairs = np.zeros(len(pdf), np.int64), []
            # Only a leaf's links are held at once; the forest takes them before the next.
            def found():
                px, py = np.stack(x.p), np.stack(y.p)
                for r, s in join_tiles(unit(x.v, size), px, unit(y.v, size), py, same, cosine, leaf):
                    np.add.at(links, r, copies[s + shift])
                    np.add.at(links, s + shift, copies[r])
                    yield r, s + shift

            pairs = forest(len(pdf), found())
            some = np.flatnonzero(links)
            return pd.DataFrame({"a": [*ids[some].tolist(), *(int(ids[a]) for a, _ in pairs)], "b": pd.array([*[None] * len(some), *(int(ids[b]) for _, b in pairs)], "Int64"), "n": [*links[some].tolist(), *[0] * len(pairs)]})

        linked = kept.keep(left.unionByName(right).groupBy("i", "j").applyInPandas(compare, "a long, b long, n long"), "linked")
        kept.drop(tiled, pairs, *boxes)
        counts.append(linked.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n")))
        forests.append(linked.where("b is not null").select("a", "b"))
    blank = spark.createDataFrame([], "id long, n long"), spark.createDataFrame([], "a long, b long")
    for c, f in zip(counts, forests, strict=True):
        blank = blank[0].unionByName(c), blank[1].unionByName(f)
    groups = components(spark, blank[1])
    named = classes.join(blank[0].groupBy("id").agg(F.sum("n").alias("n")), "id", "left").join(groups, "id", "left")
    named = named.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = good.select("vec_id", "k1", "k2").join(named, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    bad = F.col("vec_id").isNull() | F.col("embedding").isNull() | (F.size("embedding") == 0) | F.exists("embedding", lambda v: v.isNull()) | F.coalesce(F.exists("embedding", lambda v: F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False)) | ~F.coalesce(F.exists("embedding", lambda v: v != 0), F.lit(False))
    rest = vectors.where(bad).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join(table(spark, sf_dir, "embeddings"))
