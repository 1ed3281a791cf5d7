"""Transcript files and databases as sources."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "type string, session string, turn long, is_error boolean, text string, _bad string"


def json_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Events and the lines that can't be read, from agent transcripts of a JSON object a line."""
    raw = spark.read.text(path).select("value", F.from_json("value", EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("e"))
    bad = F.col("e._bad").isNotNull() | F.col("e").isNull()
    return raw.where(~bad).select("e.*").drop("_bad"), raw.where(bad).select("value")


def message_lists(spark: SparkSession, path: str) -> DataFrame:
    """Turns of files that each hold an array of messages with role and content."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", "array<struct<role string, content string>>").alias("m"))
    return raw.select("file", F.posexplode("m").alias("turn", "m")).select("file", "turn", "m.role", F.col("m.content").alias("text"))


def identifier(name: str) -> str:
    """A table or column name that is safe in SQL text; raises ValueError for others."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]{0,62}", name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table of a database, read in ranges of a numeric key."""
    if not url.startswith("jdbc:"):
        raise ValueError("a JDBC address is wanted")
    ranges = {"partitionColumn": identifier(key), "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(url=url, dbtable=identifier(name), **ranges, **options).load()
