"""Dictionary-compressed WARC archives: a writer that trains a Zstandard dictionary for each archive, and its reader.

An archive (.warc.zst) begins with a skippable frame that holds the dictionary; each record is a frame of its own,
compressed with it, so a record can be read alone by its offset. Records with equal payloads are written once as
response; the others are revisit records that name it. Writers put archives into the shared folder under a name of
their own and rename them when complete, and only archives that the returned manifest names are read, so tasks that
are lost or run twice leave nothing that is read. A task holds at most ARCHIVE_BYTES of records, or one record.

Nulls and ties: a null html is an empty payload; a null page_id is kept, is nobody's smallest unless all of a payload's
are null, and then all its records are responses; rows that repeat a page_id and payload are each a response if that
page_id is the smallest. An empty table gives no archives and no rows. Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, table

#: Payload of an archive, besides its last record.
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
#: Bytes of records, evenly spaced over the archive, that its dictionary is trained on.
TRAINING_BYTES = 4 << 20
LEVEL = 6
# Magic of the skippable frame that holds a dictionary, and the WARC profile of revisits.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "1970-01-01T00:00:00Z"


def file_system(uri: str):
    """The Arrow file system of a folder and the folder's name there; Hadoop's names for S3 are the same store."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id} {digest}'.encode()).digest()[:16])}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A record of WARC/1.1; page ids and the full payload's length are in extension headers."""
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {RECORD_DATE}", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
    ]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {'' if refers_to is None else refers_to}"]
        payload = b""
    block = http + payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record; raises ValueError if its lengths don't add up."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(fields["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:size].partition(b"\r\n\r\n")[2]


def archive(records: list[bytes], dictionary_bytes: int = DICTIONARY_BYTES, level: int = LEVEL) -> tuple[bytes, list[int]]:
    """An archive's bytes and its records' offsets."""
    import zstandard

    step, size, sample = max(1, sum(map(len, records)) // TRAINING_BYTES), 0, []
    for r in records[::step]:
        if size < TRAINING_BYTES:
            sample.append(r[: TRAINING_BYTES - size])
            size += len(sample[-1])
    try:
        trained = zstandard.train_dictionary(min(dictionary_bytes, max(256, size // 8)), sample).as_bytes()
    except zstandard.ZstdError:  # too few records to train on: they are the dictionary themselves
        trained = b"".join(sample)[-dictionary_bytes:]
    out = [struct.pack("<II", SKIPPABLE, len(trained)), trained]
    pack = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
    at, offsets = 8 + len(trained), []
    for r in records:
        out.append(pack.compress(r))
        offsets.append(at)
        at += len(out[-1])
    return b"".join(out), offsets


def read_archive(data: bytes):
    """The records of an archive, in order."""
    import zstandard

    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    trained = data[8 : 8 + size]
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
    at = 8 + size
    while at < len(data):
        one = unpack.decompressobj()
        raw = one.decompress(memoryview(data)[at:])
        at = len(data) - len(one.unused_data)
        yield raw


def with_decisions(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, digest and first: the smallest page_id of an equal payload of at least this many bytes.

    Digests are grouped with partial aggregation; only those that several rows share are joined back, so a payload that
    a third of the rows share is one small row on its side of the join.
    """
    payload = F.coalesce("html", F.lit(""))
    base = pages.select("page_id", "url", payload.alias("html")).withColumn("digest", F.sha1("html"))
    shared = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size")).where(F.col("size") >= least)
    shared = shared.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return base.join(shared, "digest", "left")


def write_archives(decided: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(path, records): the archives written; the rows are written as they are computed, so keep them before reading."""

    def write(batches):
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        records, size = [], 0

        def flush():
            nonlocal records, size
            data, _ = archive(records)
            name = f"{root}/{uuid.uuid4().hex}"
            with fs.open_output_stream(name + ".part") as f:
                f.write(data)
            fs.move(name + ".part", name + ".warc.zst")
            row = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name.rsplit('/', 1)[1]}.warc.zst"], "records": pa.array([len(records)], pa.int64())})
            records, size = [], 0
            return row

        for batch in batches:
            for page_id, url, html, first in zip(*batch.columns, strict=True):
                page_id, first, payload = page_id.as_py(), first.as_py(), html.as_py().encode()
                revisit = first is not None and page_id != first
                records.append(record(page_id, url.as_py(), payload, base32_digest(payload), first, revisit))
                size += len(payload)
                if size >= archive_bytes:
                    yield flush()
        if records:
            yield flush()

    return decided.select("page_id", "url", "html", "first").mapInArrow(write, "path string, records long")


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row for each record; a response's digest and length are those of the payload read, which must match its header."""

    def read(batches):
        for batch in batches:
            for path in batch.column(0):
                fs, name = file_system(path.as_py())
                with fs.open_input_file(name) as f:
                    data = f.read()
                rows = []
                for raw in read_archive(data):
                    fields, payload = parse(raw)
                    kind, said = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = len(payload) if kind == "response" else int(fields["X-Payload-Length"])
                    if kind == "response" and (base32_digest(payload) != said or size != int(fields["X-Payload-Length"])):
                        raise ValueError(f"{path}: a payload differs from its digest")
                    number = lambda key: int(fields[key]) if fields.get(key) else None  # noqa: B023, E731
                    rows.append((number("X-Page-Id"), size, said, kind, number("X-Refers-To-Page-Id"), fields.get("WARC-Target-URI")))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    return manifest.select("path").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 2)).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    made = write_archives(with_decisions(table(spark, sf_dir, "pages")), folder)
    made.write.parquet(folder + "-manifest")
    return read_archives(spark.read.parquet(folder + "-manifest"))


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORACLE = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS x FROM pages),
b AS (SELECT *, octet_length(encode(html)) AS n, min(page_id) OVER (PARTITION BY x) AS first,
  list_transform(list_reverse(range(0, 32)), lambda i: substr('{_B32}', 1 + (('0x' || substr(x, 1 + 10 * (3 - i // 8), 10))::BIGINT // (32 ** (i % 8))::BIGINT % 32)::INT, 1)) AS d FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(d, '') AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, url FROM b
"""
