"""Transcript events to lines; the same function serves batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OK_CHARS, ERROR_CHARS = 120, 220
EVENT = "type string, turn long, is_error boolean, text string"


def as_events(turns: DataFrame) -> DataFrame:
    """(conv_id, raw): turns as JSON events; every third is a failed tool result."""
    return turns.select("conv_id", F.to_json(F.struct(F.col("role").alias("type"), "turn", (F.col("turn") % 3 == 0).alias("is_error"), "text")).alias("raw"))


def reduced(events: DataFrame) -> DataFrame:
    """(conv_id, turn, line): users' and assistants' events; errors keep more characters; lines that can't be read drop out."""
    e = events.select("conv_id", F.from_json("raw", EVENT).alias("e")).select("conv_id", "e.*").where(F.col("type").isin("user", "assistant"))
    e = e.where(~((F.col("type") == "user") & F.startswith("text", F.lit("<"))))
    line = F.when(F.col("is_error"), F.concat(F.lit("[RESULT error] "), F.left("text", F.lit(ERROR_CHARS)))).otherwise(F.concat(F.lit("["), F.upper("type"), F.lit("] "), F.left("text", F.lit(OK_CHARS))))
    return e.select("conv_id", "turn", line.alias("line"))
