"""Agent transcripts as a data source, in batches and as a stream, with the byte at which each line begins.

    spark.dataSource.register(Transcripts)
    spark.read.format("agent_transcripts").load(folder)          # file, at, value
    spark.readStream.format("agent_transcripts").load(folder)

Spark's own text source gives no place of a line in its file, which orders a session's events; and it reads a file once,
though transcripts grow while their session runs. A stream reads complete lines up to where each file ended, and later on
from there. Files are cut into ranges of bytes; a line belongs to the range in which it begins.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a range, and bytes that are read at a time.
RANGE, PIECE = 32 << 20, 1 << 20


def _opened(path: str):
    """The file system of an address and the path on it; a bare path is local."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        path = path.replace("file:///", "file:/").replace("file:/", "file:///").replace("s3a://", "s3://")
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _files(path: str, suffix: str) -> list[tuple[str, int]]:
    """(path, bytes) of the folder's files, or of one file."""
    from pyarrow import fs

    system, at = _opened(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffix) and not f.base_name.startswith((".", "_")))


class Range(InputPartition):
    """Lines of a file that begin in low <= at < high."""

    def __init__(self, path: str, low: int, high: int, first: int = 0):
        self.path, self.low, self.high, self.first = path, low, high, first


def _ranges(path: str, low: int, high: int) -> list[Range]:
    """Ranges from low, where a line begins."""
    return [Range(path, at, min(at + RANGE, high), low) for at in range(low, high, RANGE)]


def _lines(root: str, part: Range) -> Iterator[tuple[str, int, str]]:
    """(file, at, line) of a range; the last line may reach beyond it."""
    system, _ = _opened(root)
    with system.open_input_file(part.path) as file:
        at = part.low
        if at > part.first:
            # The line before ends at this range's first newline, counted from the byte before it.
            at -= 1
            file.seek(at)
            while True:
                piece = file.read(PIECE)
                end = piece.find(b"\n")
                if end >= 0 or not piece:
                    at += end + 1 if end >= 0 else 0
                    break
                at += len(piece)
            if not piece:
                return
        file.seek(at)
        rest = b""
        while at < part.high:
            piece = file.read(PIECE)
            *whole, rest = (rest + piece).split(b"\n")
            for line in whole:
                if at >= part.high:
                    return
                yield part.path, at, line.decode("utf-8", "replace")
                at += len(line) + 1
            if not piece:
                if rest:
                    yield part.path, at, rest.decode("utf-8", "replace")
                return


class TranscriptReader(DataSourceReader):
    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix

    def partitions(self) -> list[Range]:
        return [r for path, size in _files(self.path, self.suffix) for r in _ranges(path, 0, size)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return _lines(self.path, partition) if partition.high else iter(())


class TranscriptStream(DataSourceStreamReader):
    """Offsets are the end of the last complete line of each file, so they grow with the number of files of the folder."""

    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix

    def initialOffset(self) -> dict:
        return {"ends": "{}"}

    def latestOffset(self) -> dict:
        system, _ = _opened(self.path)
        ends = {}
        for path, size in _files(self.path, self.suffix):
            with system.open_input_file(path) as file:
                end = size
                while end > 0:
                    low = max(0, end - PIECE)
                    file.seek(low)
                    last = file.read(end - low).rfind(b"\n")
                    if last >= 0:
                        ends[path] = low + last + 1
                        break
                    end = low
        return {"ends": json.dumps(ends, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, after = (json.loads(offset["ends"]) for offset in (start, end))
        return [r for path, to in sorted(after.items()) if to > before.get(path, 0) for r in _ranges(path, before.get(path, 0), to)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return _lines(self.path, partition) if partition.high else iter(())

    def commit(self, end: dict) -> None:
        pass


class Transcripts(DataSource):
    """Options: path, and suffix of the files' names (.jsonl)."""

    @classmethod
    def name(cls) -> str:
        return "agent_transcripts"

    def schema(self) -> str:
        return "file string, at long, value string"

    def _wanted(self) -> tuple[str, str]:
        return self.options["path"], self.options.get("suffix", ".jsonl")

    def reader(self, schema) -> DataSourceReader:
        return TranscriptReader(*self._wanted())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TranscriptStream(*self._wanted())


def parsed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, at, event) as VARIANT, and the (file, at, value) that are no JSON; blank lines are neither."""
    seen = lines.where(F.trim("value") != "").withColumn("event", F.try_parse_json("value"))
    return seen.where("event is not null").select("file", "at", "event"), seen.where("event is null").select("file", "at", "value")


def _text(v: Column) -> Column:
    """A content's text: a string, or the text blocks of a list joined by spaces."""
    blocks = F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda b: F.try_variant_get(b, "$.type", "string") == "text")
    joined = F.array_join(F.transform(blocks, lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit(""))), " ")
    whole = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return F.coalesce(whole, joined, F.lit(""))


def turns(events: DataFrame, tool_chars: int | None = 200, result_chars: int | None = 120, error_chars: int | None = 220, drop_results: bool = False) -> DataFrame:
    """(file, at, block, role, is_error, text): the turns of events, the same in a batch and a stream.

    Only users' and assistants' events count. A user's plain string is a turn unless it is blank or begins with <. Of a
    list, texts and thoughts are turns (never a thought's signature), tool calls show their name and arguments as JSON,
    without spaces and with keys in order, and results their text, marked if they failed. Characters are cut as told, or
    not for None; drop_results leaves results that succeeded out.
    """
    kind = F.try_variant_get("event", "$.type", "string")
    content = F.try_variant_get("event", "$.message.content", "variant")
    own = events.select("file", "at", kind.alias("kind"), content.alias("content")).where(F.col("kind").isin("user", "assistant"))
    cut = lambda c, most: c if most is None else F.left(c, F.lit(most))
    string = F.trim(F.when((F.col("kind") == "user") & (F.schema_of_variant("content") == "STRING"), F.try_variant_get("content", "$", "string")), F.lit(" \t\r\n\f\v"))
    said = F.when(string.isNotNull(), F.array(F.when((string != "") & ~F.startswith(string, F.lit("<")), F.struct(F.col("kind").alias("role"), F.lit(False).alias("is_error"), string.alias("text")))))

    def turn(b: Column) -> Column:
        get = lambda path, type_="string": F.try_variant_get(b, path, type_)
        row = lambda role, bad, text: F.struct(role.alias("role"), bad.alias("is_error"), text.alias("text"))
        type_, no = get("$.type"), F.lit(False)
        words = F.trim(F.coalesce(F.nullif(get("$.text"), F.lit("")), get("$.thinking"), F.lit("")), F.lit(" \t\r\n\f\v"))
        call = F.concat(F.coalesce(get("$.name"), F.lit("tool")), F.lit("("), cut(F.coalesce(F.to_json(get("$.input", "variant")), F.lit("{}")), tool_chars), F.lit(")"))
        failed = F.coalesce(get("$.is_error", "boolean"), no)
        result = _text(get("$.content", "variant"))
        out = F.when(type_.isin("text", "thinking") & (words != ""), row(F.col("kind"), no, words)).when(type_ == "tool_use", row(F.lit("tool"), no, call))
        out = out.when((type_ == "tool_result") & failed, row(F.lit("result"), F.lit(True), cut(result, error_chars)))
        return out if drop_results else out.when(type_ == "tool_result", row(F.lit("result"), no, cut(result, result_chars)))

    listed = F.transform(F.try_variant_get("content", "$", "array<variant>"), turn)
    each = own.select("file", "at", F.posexplode(F.coalesce(said, listed)).alias("block", "t")).where("t is not null")
    return each.select("file", "at", "block", "t.*")


def line(role: Column, is_error: Column, text: Column) -> Column:
    """A turn as a line of a transcript."""
    name = F.when(role == "tool", "TOOL").when(role == "result", F.when(is_error, "RESULT ERROR").otherwise("RESULT ok")).otherwise(F.upper(role))
    return F.concat(F.lit("["), name, F.lit("] "), text)


def _agent_lines(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(Transcripts)
    return turns(parsed(spark.read.format("agent_transcripts").load(path))[0])


def _message_lists(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold a list of messages, or an object with one under messages; a message without text is no turn."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.try_parse_json("value").alias("v"))
    found = F.coalesce(F.try_variant_get("v", "$.messages", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    each = raw.select("file", F.posexplode(found).alias("at", "m"))
    text = F.trim(_text(F.try_variant_get("m", "$.content", "variant")), F.lit(" \t\r\n\f\v"))
    out = each.select("file", F.col("at").cast("long").alias("at"), F.lit(0).alias("block"), F.coalesce(F.try_variant_get("m", "$.role", "string"), F.lit("assistant")).alias("role"), F.lit(False).alias("is_error"), text.alias("text"))
    return out.where("text <> ''")


#: Readers of transcripts by name; register() adds others.
FORMATS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"agent_lines": _agent_lines, "message_lists": _message_lists}


def register(name: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    """Adds a format: reader(spark, path) gives (file, at, block, role, is_error, text)."""
    FORMATS[name] = reader


def transcript(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    """The turns of a path in a registered format; without one, message lists for a path that ends in .json, else agent lines."""
    form = form or ("message_lists" if path.endswith(".json") else "agent_lines")
    if form not in FORMATS:
        raise ValueError(f"no such format: {form!r}; there are {sorted(FORMATS)}")
    return FORMATS[form](spark, path)
