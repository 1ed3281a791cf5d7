"""Indexes that are written once a session to the shared folder, and again if the files that they are made from change."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chunk_store import file_state, shared_dir

_PATHS: dict[tuple, str] = {}


def built(spark: SparkSession, source: str, what: str, build: Callable[[str], object]) -> str:
    """The folder to which build(path) wrote an index over the files of source."""
    key = (spark.sparkContext.applicationId, what, source, *file_state(spark, source))
    if key not in _PATHS:
        path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        build(path)
        _PATHS[key] = path
    return _PATHS[key]


def kept(df: DataFrame) -> DataFrame:
    """df as it is now, written to the shared folder, for what reads it more than once."""
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
