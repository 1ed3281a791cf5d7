"""What the operators share: table access, shared scratch tables, Arrow text slices and connected components."""

from __future__ import annotations

import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Executors need not have this package installed: its functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])

SEGMENT_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session without the setting gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        local = spark.sparkContext.master.startswith("local")
        found = "file://" + tempfile.mkdtemp(prefix="scratch-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/scratch"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


class Kept:
    """Tables written to the shared folder, which cut lineage; drop() removes those no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, what: str) -> DataFrame:
        path = scratch_path(self.spark, what)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self.paths.pop(id(df), None)
            if path:
                jvm = self.spark.sparkContext._jvm
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and its len + 1 offsets; a null is an empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def segments(offsets: np.ndarray, limit: int = SEGMENT_BYTES):
    """Row ranges of at most limit bytes, or of one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection whose results look independent."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(fold: bool = True) -> np.ndarray:
    """A random odd 64-bit value for each byte; A-Z have those of a-z."""
    with np.errstate(over="ignore"):
        values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    if fold:
        values[65:91] = values[97:123]
    return values


def byte_class(pattern: str) -> np.ndarray:
    """Which bytes belong to words. space: all but white space of ASCII; alnum: ASCII letters and digits and all beyond ASCII."""
    inside = np.ones(256, bool)
    if pattern == "space":
        inside[[32, *range(9, 14)]] = False
    else:
        inside[:128] = False
        for low, high in ((48, 58), (65, 91), (97, 123)):
            inside[low:high] = True
    return inside


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """Start, end and row of each word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    word = inside[data]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    begins[edges] |= word[edges]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    ends[edges - 1] |= word[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


_BASE = 0xD1342543DE82EF95
_UNBASE = pow(_BASE, -1, 1 << 64)


class SpanHasher:
    """64-bit hashes of byte spans by prefix sums, SEGMENT_BYTES at a time."""

    def __init__(self, fold: bool = True):
        self.values, self.size = byte_values(fold), 0

    def _powers(self, size: int) -> None:
        if size > self.size:
            self.size = max(size, SEGMENT_BYTES)
            self.up, self.down = (np.cumprod(np.array([1] + [base] * self.size, np.uint64)) for base in (_BASE, _UNBASE))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=sums[1:])
        return sums

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            raw = (sums[end] - sums[start]) * self.down[start]
            return mix64(raw ^ ((end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, component) for each end of the edges (a, b); component is the smallest id that is reachable.

    Alternating large-star and small-star steps over written tables: each step pre-aggregates to one minimum for each
    node and joins it back, so no node's neighbours are gathered. The number of steps grows with the logarithm of the
    largest component's diameter. Nulls in a or b are ignored; no edges give no rows.
    """
    kept = Kept(spark)
    pairs = kept.keep(edges.where("a is not null and b is not null and a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = mark(pairs)
    while before[0]:
        both = pairs.unionByName(pairs.selectExpr("b a", "a b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").selectExpr("b a", "m b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").selectExpr("explode(array(struct(b a, m b), struct(a a, m b))) x").select("x.*").where("a <> b").distinct()
        after = kept.keep(small, "edges")
        kept.drop(pairs)
        # A forest of stars stays as it is: then the two tables hold the same rows.
        pairs, last, before = after, before, mark(after)
        if before == last:
            break
    return pairs.selectExpr("a id", "b component").unionByName(pairs.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
