"""An index for approximate vector search: a coarse quantiser with inverted lists as partitions.

Centroids are fitted on a bounded sample; every vector is written to the list of its nearest centroid, so a query reads
the files of its nearest lists only. Scores of what is read are exact cosines. How many lists a query needs for a wanted
recall is measured at the build against exact search, as it depends on how far the vectors lie in clusters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import top_k, vector_top_k

#: Vectors that are sampled for each list, lists at most, and numbers of the sample at most (64 MB): bounds of what the driver fits.
SAMPLED, MOST_LISTS, NUMBERS = 64, 4096, 1 << 24
#: Products that are held at a time.
HELD = 1 << 22
#: Rows of a file of a list: longer lists are cut into several.
FILE_ROWS = 1 << 18
#: Queries of the calibration, and queries that are sent to tasks at a time.
TRIED, BLOCK = 256, 4096


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows that are zero or not finite become zero, and are near nothing."""
    x = np.where(np.isfinite(x).all(1, keepdims=True), x, 0.0)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def rows_of(column) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), float).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The number of each row's nearest centroid, some rows at a time."""
    step = max(1, HELD // max(1, len(centroids)))
    return np.concatenate([np.zeros(0, np.int64), *((x[at : at + step] @ centroids.T).argmax(1) for at in range(0, len(x), step))])


def spherical_means(x: np.ndarray, lists: int, steps: int = 10, seed: int = 0) -> np.ndarray:
    """Centroids of unit vectors by cosine; a centroid that loses all of its vectors stays where it was."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(steps):
        near = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        moved = np.linalg.norm(sums, axis=1) > 0
        c[moved] = unit(sums[moved])
    return c


def by_parts(table: pa.Table, column: str) -> np.ndarray:
    """A column of lists as unit vectors in single precision, a batch at a time."""
    parts = [unit(rows_of(batch.column(column))).astype(np.float32) for batch in table.to_batches(max_chunksize=4096) if len(batch)]
    return np.concatenate(parts) if parts else np.zeros((0, 1), np.float32)


class VectorIndex:
    """lists/list=n (key, v), centroids (list, c, size), totals (n, probes, recall: one row)."""

    def __init__(self, spark: SparkSession, path: str, key: str = "vec_id"):
        self.spark, self.path, self.key = spark, path, key
        self.lists = spark.read.parquet(f"{path}/lists")
        rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # at most MOST_LISTS
        self.centroids, self.sizes = np.array([r.c for r in rows]), np.array([r["size"] for r in rows], np.int64)
        self.n, self.probes, self.recall = spark.read.parquet(f"{path}/totals").first()

    @classmethod
    def build(cls, vectors: DataFrame, path: str, key: str = "vec_id", lists: int | None = None, wanted: float = 0.95, k: int = 10) -> VectorIndex:
        """Writes the index over (key, v); null vectors aren't indexed. wanted is the recall of the k nearest that sets how many lists are read."""
        spark, kind, held = vectors.sparkSession, dict(vectors.dtypes)[key], dict(vectors.dtypes)["v"]
        vectors.where("v is not null").select(key, "v").write.parquet(f"{path}/rows")
        every = spark.read.parquet(f"{path}/rows")
        n = every.count()
        lists = max(1, min(lists or int(n**0.5), MOST_LISTS, n))

        def by_chance(seed: int, most: int) -> pa.Table:
            """About most rows, and never more, chosen by the hash of their key."""
            chosen = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(max(n, 1))) < most
            return every.where(chosen).limit(2 * most).select(key, F.col("v").cast("array<float>").alias("v")).toArrow()

        width = max(1, len(every.first().v or [])) if n else 1
        # About as many as fit, whatever the dimension; a list has one at least.
        sample = by_parts(by_chance(0, max(lists, min(lists * SAMPLED, NUMBERS // width))), "v") if n else np.zeros((0, 1), np.float32)
        lists = min(lists, len(sample))
        centroids = spherical_means(sample, lists) if lists else np.zeros((0, 1))
        # A list that holds a large share of the sample, hence of all rows, is cut into files of about FILE_ROWS, so no task writes it alone.
        share = np.bincount(nearest(sample, centroids), minlength=lists) / max(1, len(sample)) if lists else np.zeros(0)
        files = np.maximum(1, np.ceil(share * n / FILE_ROWS)).astype(np.int32)

        def assign(batches):
            for batch in batches:
                near = nearest(unit(rows_of(batch.column(1))).astype(np.float32), centroids).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(files[near])], names=[key, "v", "list", "files"])

        if lists:
            dealt = every.mapInArrow(assign, f"{key} {kind}, v {held}, list int, files int").repartition("list", F.pmod(F.xxhash64(key), F.col("files")))
            dealt.drop("files").write.partitionBy("list").parquet(f"{path}/lists")
        else:
            every.withColumn("list", F.lit(0)).write.parquet(f"{path}/lists")
        written = spark.read.parquet(f"{path}/lists")
        sizes = {r.list: r.n for r in written.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most MOST_LISTS
        spark.createDataFrame([(i, centroids[i].tolist(), sizes.get(i, 0)) for i in range(lists)], "list int, c array<double>, size long").coalesce(1).write.parquet(f"{path}/centroids")
        probes, recall = cls._calibrated(written, by_chance(1, TRIED), centroids, key, wanted, k) if lists else (1, 1.0)
        spark.createDataFrame([(n, probes, recall)], "n long, probes int, recall double").coalesce(1).write.parquet(f"{path}/totals")
        return cls(spark, path, key)

    @staticmethod
    def _calibrated(lists: DataFrame, rows: pa.Table, centroids: np.ndarray, key: str, wanted: float, k: int) -> tuple[int, float]:
        """The least number of lists whose rows hold the wanted share of the true neighbours of TRIED vectors, and that share."""
        number = {own: i for i, own in enumerate(rows.column(key).to_pylist())}
        vectors = rows_of(rows.column("v"))
        queries = lists.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "qid long, q array<double>")
        order = np.argsort(-(unit(vectors) @ centroids.T), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None], 1)
        # The exact search wants numbers as ids, and keys may be of any type.
        numbered = lists.select("list", F.col(key).alias("own"), "v", F.xxhash64(key).alias("row"))
        truth = vector_top_k(numbered.select(F.col("row").alias("vec_id"), "v"), queries, k + 1).select("qid", F.col("vec_id").alias("row"))
        found = truth.join(numbered.select("row", "list", "own"), "row").select("qid", "own", "list").collect()  # TRIED * (k + 1)
        at = np.array([place[r.qid, r.list] for r in found if number.get(r.own) != r.qid])
        if not len(at):
            return 1, 1.0
        share = np.searchsorted(np.sort(at), np.arange(1, order.shape[1] + 1)) / len(at)
        probes = int(np.argmax(share >= wanted)) + 1
        return probes, float(share[probes - 1])

    def search(self, queries: DataFrame, k: int, probes: int | None = None, within: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(qid, key, score, rank) of the k nearest of (qid, q) in each query's nearest lists, its own row left out, and a report of (qid, lists, scanned, returned, shortfall).

        within: keys to which the search is restricted, before ranking. A query with fewer than k hits has a shortfall;
        widened() asks it again over all lists.
        """
        probes = min(probes or self.probes, len(self.centroids))
        kind = dict(self.lists.dtypes)[self.key]
        parts = max(1, -(-queries.count() // BLOCK))
        found, asked = [], []
        for part in range(parts):
            rows = queries.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part).select("qid", "q").collect()  # about BLOCK
            if not rows or not len(self.centroids):
                continue
            y = unit(np.array([r.q for r in rows], float))
            near = np.argsort(-(y @ self.centroids.T), axis=1, kind="stable")[:, :probes]
            asked += [(r.qid, len(lists), int(self.sizes[lists].sum())) for r, lists in zip(rows, near, strict=True)]
            found.append(self._scanned([r.qid for r in rows], y, near, k, kind, within))
        hits = found[0] if found else self.spark.createDataFrame([], f"qid long, {self.key} {kind}, score double")
        for more in found[1:]:
            hits = hits.unionByName(more)
        best = top_k(hits, k, self.key)
        counted = best.groupBy("qid").agg(F.count("*").alias("returned"))
        report = self.spark.createDataFrame(asked, "qid long, lists int, scanned long").join(counted, "qid", "left").na.fill(0, ["returned"])
        return best, report.withColumn("shortfall", F.col("returned") < k)

    def _scanned(self, qids: list, y: np.ndarray, near: np.ndarray, k: int, kind: str, within: DataFrame | None) -> DataFrame:
        by_list: dict[int, list[int]] = {}
        for i, lists in enumerate(near.tolist()):
            for number in lists:
                by_list.setdefault(number, []).append(i)
        key, ids = self.key, np.array(qids)

        def scan(batches):
            for batch in batches:
                number, own, x = (np.asarray(batch.column(0)), np.array(batch.column(1).to_pylist()), unit(rows_of(batch.column(2))))
                got: list[tuple] = []
                for one in np.unique(number):
                    rows, who = np.flatnonzero(number == one), np.array(by_list[int(one)])
                    score = (x[rows] @ y[who].T).round(6)
                    score[own[rows][:, None] == ids[who][None, :]] = -2.0
                    # Only rows that can be among the best leave the task; equal scores are told apart by key later.
                    least = np.partition(score, len(score) - k, axis=0)[len(score) - k] if len(score) > k else -1.0
                    row, column = np.nonzero((score >= least) & (score >= -1.0))
                    got.append((ids[who[column]], own[rows[row]], score[row, column]))
                if got:
                    yield pa.RecordBatch.from_pydict({name: pa.array(np.concatenate(parts)) for name, parts in zip(("qid", key, "score"), zip(*got, strict=True), strict=True)})

        # Only the folders of these lists are read.
        rows = self.lists.where(F.col("list").isin(list(by_list)))
        if within is not None:
            rows = rows.join(within.select(key), key, "left_semi")
        return rows.select("list", key, "v").mapInArrow(scan, f"qid long, {key} {kind}, score double")

    def widened(self, queries: DataFrame, k: int, within: DataFrame | None = None, probes: int | None = None) -> DataFrame:
        """The hits of search(), where queries with a shortfall are asked again over all lists, which is exact."""
        best, report = self.search(queries, k, probes, within)
        short = report.where("shortfall").select("qid")
        again, _ = self.search(queries.join(short, "qid", "left_semi"), k, len(self.centroids), within)
        return best.join(short, "qid", "left_anti").unionByName(again)


def recall(found: DataFrame, truth: DataFrame, key: str = "vec_id") -> float:
    """Share of the true hits (qid, key) that were found."""
    return truth.join(found.select("qid", key).withColumn("hit", F.lit(1)), ["qid", key], "left").agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
