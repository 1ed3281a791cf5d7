"""A folder that is watched: a stream of what was added, modified or deleted, a batch for each burst of changes.

    spark.dataSource.register(Changes)
    spark.readStream.format("folder_changes").option("settled", "2").load(folder)

Spark's file source reads a file once and never sees that it changed or went. Here an offset is what the folder held, with
each file's time of change; a batch is the difference of two. A file that changes again within settled seconds waits, so a
burst of writes to one path is one change.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.agent_transcripts import _opened

# Folders and endings of files that are no sources.
IGNORED = r"(^|/)(\.git|\.hg|\.venv|venv|node_modules|__pycache__|\.mypy_cache|\.pytest_cache|target|dist|build)(/|$)|\.(pyc|pyo|so|o|class)$|~$"


class Paths(InputPartition):
    def __init__(self, changes: list[tuple[str, str, float]]):
        self.changes = changes


class FolderStream(DataSourceStreamReader):
    """Offsets hold the folder's paths, so it suits folders of sources, not of data."""

    def __init__(self, path: str, settled: float, ignore: str):
        self.path, self.settled, self.ignore, self.last = path, settled, re.compile(ignore), {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, at = _opened(self.path)
        now, found = time.time(), {}
        for f in system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True)):
            name = f.path[len(at) :].lstrip("/")
            if f.type == fs.FileType.File and not self.ignore.search(name):
                changed = f.mtime_ns / 1e9
                if now - changed >= self.settled:
                    found[name] = changed
                elif name in self.last:
                    found[name] = self.last[name]  # it is still being written: as it was
        self.last = found
        return {"files": json.dumps(found, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Paths]:
        before, after = (json.loads(offset["files"]) for offset in (start, end))
        changes = [(p, "added" if p not in before else "modified", t) for p, t in after.items() if before.get(p) != t]
        return [Paths(sorted(changes + [(p, "deleted", t) for p, t in before.items() if p not in after]))]

    def read(self, partition: Paths) -> Iterator[tuple]:
        return iter(partition.changes)

    def commit(self, end: dict) -> None:
        self.last = json.loads(end["files"])


class Changes(DataSource):
    """Options: path; settled, the seconds for which a file must rest; ignore, a pattern of paths that don't count."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return "path string, change string, modified double"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FolderStream(self.options["path"], float(self.options.get("settled", "2")), self.options.get("ignore", IGNORED))
