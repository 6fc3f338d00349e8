"""WARC archives: a deterministic sharded writer of response and revisit records, and a reader.

Records are range-sorted by page id; a task writes its range to gzip files of a member per record and rolls to the next file
once ``roll`` compressed bytes are reached. Headers, record ids and digests are made anew from the row, so a task that runs
again writes the same bytes. Files get their names by a rename; the manifest (a row a file), written by Spark's committer,
decides what belongs to the archive. Rows and the marks that say which of them are revisits meet in one range shuffle.

Defined results: a null payload is an empty one; a null url leaves out the target URI; control characters and blanks in a url are
percent-encoded; rows with a null page id are written, and are responses unless a page with an id has their payload; rows
that share both the largest id and the payload are responses each; an empty table writes no file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import storage
from .skew import lookup

ROLL = 32 << 20  # compressed bytes after which a file is closed
PART = 1 << 13  # compressed bytes unpacked at a time
DATE = "2024-01-01T00:00:00Z"  # of every record, so that bytes depend on the input alone
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records long, bytes long, crc32 long"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{payload_digest}')}>"


def member(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record as one gzip member; fields that are None are left out."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, kept_page: int | None) -> bytes:
    """A response, or a revisit of kept_page where that is given."""
    payload_digest = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = kept_page is not None
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, payload_digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url)),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", record_id(kept_page, payload_digest) if revisit else None),
        ("Page-Id", page_id),
        ("Refers-To-Page-Id", kept_page),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    return member(fields, block)


def info_record(name: str) -> bytes:
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return member(fields, b"software: pagewright\r\nformat: WARC File Format 1.1\r\n")


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record, member by member."""
    data, at = memoryview(data), 0
    while at < len(data):
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof and at < len(data):
            parts.append(unpacker.decompress(data[at : at + PART]))  # what lies behind the member is copied each time, so little is given
            at += PART
        if not unpacker.eof:
            raise ValueError("cut-off WARC member")
        at = min(at, len(data)) - len(unpacker.unused_data)
        plain = b"".join(parts)
        head, _, block = plain.partition(b"\r\n\r\n")
        fields = dict((k.lower(), v) for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:]))
        size = int(fields["content-length"])
        if block[size:] != b"\r\n\r\n":
            raise ValueError("WARC record of a wrong length")
        yield fields, block[:size]


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, sha1, kept_page): the pages whose payload a page with a larger id has too."""
    keys = pages.select("page_id", F.sha1("payload").alias("sha1"))
    kept = keys.groupBy("sha1").agg(F.max("page_id").alias("kept_page"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return lookup(keys, kept, "sha1").filter("kept_page is not null and not (page_id <=> kept_page)")


def write(pages: DataFrame, folder: str, partitions: int, roll: int = ROLL) -> DataFrame:
    """Writes pages (page_id bigint, url string, html string) into folder; gives the manifest, written."""
    pages = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    marks = revisits(pages).select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.unhex("sha1").alias("payload"), "kept_page")
    rows = pages.select("page_id", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("kept_page"))
    ranged = marks.unionByName(rows).repartitionByRange(partitions, "page_id").sortWithinPartitions("page_id", "kind", "url", "payload")

    def write_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, pieces, held, n = TaskContext.get(), 0, [], 0, 0
        page, marked = object(), {}

        def close() -> pa.RecordBatch:
            nonlocal made, pieces, held, n
            name = f"part-{task.partitionId():06d}-{made:04d}.warc.gz"
            data = [info_record(name), *pieces]
            storage.put(folder, name, task.taskAttemptId(), data)
            crc = 0
            for x in data:
                crc = zlib.crc32(x, crc)
            row = pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([n], pa.int64()), "bytes": pa.array([sum(map(len, data))], pa.int64()), "crc32": pa.array([crc], pa.int64())})
            made, pieces, held, n = made + 1, [], 0, 0
            return row

        for batch in batches:
            for at in range(batch.num_rows):
                page_id, kind, url, payload, kept_page = (c[at].as_py() for c in batch.columns)
                if page_id != page:
                    page, marked = page_id, {}
                if kind == 0:
                    marked[payload] = kept_page
                    continue
                kept_page = marked.get(hashlib.sha1(payload).digest()) if marked else None
                pieces.append(page_record(page_id, url, payload, kept_page))
                held, n = held + len(pieces[-1]), n + 1
                if held >= roll:
                    yield close()
        if pieces:
            yield close()

    return storage.written(ranged.mapInArrow(write_part, MANIFEST), "warc-manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record of the manifest's files; digests are checked."""

    def read_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for content, crc in zip(batch.column(0), batch.column(1), strict=True):
                data, out = memoryview(content.as_buffer()), []
                if zlib.crc32(data) != crc.as_py():
                    raise ValueError("WARC file and manifest differ")
                for fields, block in records(data):
                    if fields["warc-type"] not in ("response", "revisit"):
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    said = fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-type"] == "response" and digest(payload) != said or digest(block) != fields["warc-block-digest"].removeprefix("sha1:"):
                        raise ValueError(f"digest of {fields['warc-record-id']} differs")
                    size = int(head.decode().rpartition("Content-Length: ")[2])
                    out.append((number(fields.get("page-id")), size, said, fields["warc-type"], number(fields.get("refers-to-page-id"))))
                columns = list(zip(*out, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    spark = manifest.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(manifest.select("file", "crc32"), "file")
    return files.select("content", "crc32").mapInArrow(read_part, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
