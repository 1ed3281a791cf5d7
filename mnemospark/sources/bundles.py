"""Bundles of artifacts and memories as JSON lines, and scans of directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 2
_LINE = "format_version int, kind string, id string, namespace string, text string, body string, confirmations long"
# Folders that are no sources.
IGNORED = (".git", ".hg", ".svn", "node_modules", ".venv", "venv", "dist", "build", "__pycache__", ".mypy_cache", ".ruff_cache", ".pytest_cache", ".tox", ".idea")


def export_bundle(artifacts: DataFrame, memories: DataFrame, path: str) -> None:
    """A line for each row, keys in order, contents in base64; one file a partition."""
    fields = ("body", "confirmations", "format_version", "id", "kind", "namespace", "text")

    def lines(df: DataFrame, kind: str, **have) -> DataFrame:
        values = {"kind": F.lit(kind), "format_version": F.lit(VERSION), **have}
        return df.select(F.to_json(F.struct(*[values[f].alias(f) for f in fields if f in values])).alias("value"))

    a = lines(artifacts, "artifact", id=F.col("artifact_id"), namespace=F.col("namespace"), body=F.base64(F.encode("content", "UTF-8")))
    m = lines(memories, "memory", id=F.col("memory_id").cast("string"), namespace=F.col("namespace"), text=F.col("text"), confirmations=F.col("confirmations"))
    a.unionByName(m).write.text(path)


def import_bundle(spark: SparkSession, path: str) -> DataFrame:
    """kind, id, namespace, content, confirmations; a line of another version or kind, or that can't be read, fails the job with its text."""
    rows = spark.read.text(path).select("value", F.from_json("value", _LINE).alias("x"))
    known = F.coalesce((F.col("x.format_version") == VERSION) & F.col("x.kind").isin("artifact", "memory"), F.lit(False))
    checked = rows.withColumn("x", F.when(known, F.col("x")).otherwise(F.raise_error(F.concat(F.lit("not a line of a bundle: "), F.left("value", F.lit(120))))))
    content = F.when(F.col("x.kind") == "artifact", F.decode(F.unbase64("x.body"), "UTF-8")).otherwise(F.col("x.text"))
    return checked.select("x.kind", "x.id", "x.namespace", content.alias("content"), "x.confirmations")


def directory(spark: SparkSession, root: str, ignored=IGNORED) -> DataFrame:
    """path (below root), content_hash, length and modified of the files of a folder and those below it, but in ignored ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "^/*" + root.split("://")[-1].strip("/") + "/", "")
    inside = ~F.exists(F.split(below, "/"), lambda part: part.isin(*ignored))
    return files.where(inside).select(below.alias("path"), F.sha2("content", 256).alias("content_hash"), "length", F.col("modificationTime").alias("modified"))


def changes(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(path, change): what was added, modified or deleted since the manifest (path, content_hash)."""
    both = manifest.select("path", F.col("content_hash").alias("before")).join(found.select("path", F.col("content_hash").alias("now")), "path", "full")
    change = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("before") != F.col("now"), "modified")
    return both.select("path", change.alias("change")).where("change is not null")
