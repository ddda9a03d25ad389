"""WARC archives as a Spark data source: a writer of gzip members and a splittable reader.

Writing: ``df.write.format("warc").mode("append").save(folder)``. Every record is one gzip member.
A task writes files of about ``fileBytes`` under names of its own; the commit lists the files of the
successful tasks in ``_files.json``, so files of lost or repeated tasks are never read.

Reading: files are cut into byte ranges of ``splitBytes``. A task scans its range for the gzip magic,
takes a candidate for a member only if it decodes to a WARC header, and owns the records that start
inside its range, reading past its end to finish the last one. After a member it goes on at the
member's end. Payload digests are recomputed (``digest_ok``).

Folders are opened with pyarrow's file systems, as Spark has no reader of raw byte ranges.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage)

from assetlane.llm.tables import if_small, store
from assetlane.session import scratch_folder

MAGIC = b"\x1f\x8b\x08"
READ = 1 << 16
WRITE_SCHEMA = "page_id bigint, url string, payload binary, refers_to bigint"
READ_SCHEMA = (
    "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, "
    "refers_to bigint, digest_ok boolean, file string, offset bigint, payload binary")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PRINTABLE = "".join(chr(c) for c in range(0x21, 0x7F))


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One gzip member with the record of a page: a response, or a revisit without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_PRINTABLE)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


class MemberScanner:
    """Finds and decodes the members of one open file that start in a byte range."""

    def __init__(self, file, start: int, end: int):
        self.file, self.start, self.end = file, start, end

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        at = self.start
        while (at := self._next_magic(at)) is not None:
            found = self._decode(at)
            if found is None:
                at += 1
            else:
                raw, size = found
                yield at, raw
                at += size

    def _next_magic(self, at: int) -> int | None:
        while at < self.end:
            self.file.seek(at)
            block = self.file.read(READ)
            if len(block) < len(MAGIC):
                return None
            i = block.find(MAGIC)
            if i >= 0:
                return at + i if at + i < self.end else None
            at += len(block) - len(MAGIC) + 1
        return None

    def _decode(self, at: int) -> tuple[bytes, int] | None:
        self.file.seek(at)
        unpack, out, read = zlib.decompressobj(31), [], 0
        try:
            while not unpack.eof:
                block = self.file.read(READ)
                if not block:
                    return None
                read += len(block)
                out.append(unpack.decompress(block))
                if len(out[0]) >= 5 and not out[0].startswith(b"WARC/"):
                    return None
        except zlib.error:
            return None
        raw = b"".join(out)
        return (raw, read - len(unpack.unused_data)) if raw.startswith(b"WARC/") else None


_PAGE = re.compile(r"<urn:page:(-?\d+)>")


def _fields(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, body


def parse(raw: bytes) -> dict:
    """The columns of ``READ_SCHEMA`` that a record holds."""
    warc, body = _fields(raw)
    body = body[:int(warc.get("content-length", len(body)))]
    http, payload = _fields(body) if body.startswith(b"HTTP/") else ({}, body)
    kind = warc.get("warc-type")
    digest = warc.get("warc-payload-digest", "").removeprefix("sha1:") or None
    page, refers = (_PAGE.fullmatch(warc.get(k, "")) for k in ("warc-record-id", "warc-refers-to"))
    revisit = kind == "revisit"
    size = int(http["content-length"]) if http.get("content-length", "").isdigit() else len(payload)
    return {
        "page_id": int(page[1]) if page else None, "url": warc.get("warc-target-uri"), "record_type": kind,
        "payload_bytes": size if revisit else len(payload), "payload_digest": digest,
        "refers_to": int(refers[1]) if refers else None,
        "digest_ok": None if revisit or digest is None else sha1_base32(payload) == digest,
        "payload": None if revisit else payload}


def _open_folder(path: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    if "://" in path or path.startswith("file:"):
        return FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return LocalFileSystem(), path


@dataclass
class WrittenFiles(WriterCommitMessage):
    files: list


@dataclass
class ByteRange(InputPartition):
    file: str
    start: int
    end: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, file_bytes: int, date: str):
        self.path, self.file_bytes, self.date = path, file_bytes, date

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenFiles:
        system, folder = _open_folder(self.path)
        system.create_dir(folder)
        files, out, size, name = [], None, 0, ""
        for batch in iterator:
            for page_id, url, payload, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))):
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{folder}/{name}", compression=None)
                data = member(page_id, url, payload or b"", refers, self.date)
                out.write(data)
                size += len(data)
                if size >= self.file_bytes:
                    out.close()
                    files.append([name, size])
                    out = None
        if out is not None:
            out.close()
            files.append([name, size])
        return WrittenFiles(files)

    def commit(self, messages: list) -> None:
        system, folder = _open_folder(self.path)
        system.create_dir(folder)
        listed = [f for m in messages if m is not None for f in m.files]
        with system.open_output_stream(f"{folder}/_files.json") as out:
            out.write(json.dumps(listed).encode())

    def abort(self, messages: list) -> None:
        system, folder = _open_folder(self.path)
        for m in messages:
            for name, _ in m.files if m is not None else ():
                system.delete_file(f"{folder}/{name}")


class WarcReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, payloads: bool):
        self.path, self.split_bytes, self.payloads = path, split_bytes, payloads

    def partitions(self) -> list[ByteRange]:
        from pyarrow.fs import FileSelector, FileType

        system, folder = _open_folder(self.path)
        if system.get_file_info(f"{folder}/_files.json").type == FileType.File:
            with system.open_input_stream(f"{folder}/_files.json") as f:
                files = [(name, size) for name, size in json.loads(f.read())]
        else:
            files = [(i.base_name, i.size) for i in system.get_file_info(FileSelector(folder)) if i.base_name.endswith(".warc.gz")]
        ranges = [ByteRange(name, a, min(a + self.split_bytes, size))
                  for name, size in sorted(files) for a in range(0, size, self.split_bytes)]
        return ranges or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, folder = _open_folder(self.path)
        rows: list[dict] = []
        held = 0
        with system.open_input_file(f"{folder}/{partition.file}") as file:
            for at, raw in MemberScanner(file, partition.start, partition.end):
                row = parse(raw) | {"file": partition.file, "offset": at}
                held += len(raw)
                if not self.payloads:
                    row["payload"] = None
                rows.append(row)
                if held >= 8 << 20:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
        schema = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in READ_SCHEMA.split(", "))])
        return pa.RecordBatch.from_pylist(rows, schema)


class WarcSource(DataSource):
    """Options: path, fileBytes and date (writing), splitBytes and payloads (reading)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], int(self.options.get("splitBytes", 64 << 20)),
                          self.options.get("payloads", "true") == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("fileBytes", 256 << 20)),
                          self.options.get("date", "2000-01-01T00:00:00Z"))


def mark_revisits(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload and refers_to for the writer.

    Of pages with equal payloads of at least ``least_bytes`` bytes, that with the largest page_id is
    the response and the others revisit it. Repeated rows with that id are all responses. Pages
    without an id never stand for others, and revisit a page that has one. A null html is an empty
    payload. Payloads are not shuffled while the list of repeated digests is small.
    """
    payload: Column = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload")).withColumn("hash", F.sha2("payload", 256))
    long = F.length("payload") >= least_bytes
    again = store(spark, rows.where(long).groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("keep"))
                  .where("n > 1 AND keep IS NOT NULL").select("hash", "keep"), "repeated-payloads")
    refers = F.when(long & (F.col("page_id").isNull() | (F.col("page_id") < F.col("keep"))), F.col("keep"))
    return rows.join(if_small(again, 80), "hash", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def archive_pages(spark: SparkSession, pages: DataFrame, least_bytes: int = 0, file_bytes: int = 256 << 20,
                  split_bytes: int = 64 << 20, payloads: bool = False) -> DataFrame:
    """Writes one record a page to archives in the shared folder and reads the archives back.

    Rows come from the archives alone, one for each row of ``pages`` (none for an empty table), with
    ``READ_SCHEMA``; other columns of ``pages`` are not read.
    """
    spark.dataSource.register(WarcSource)
    folder = scratch_folder(spark, "warc")
    mark_revisits(spark, pages, least_bytes).write.format("warc").option("fileBytes", file_bytes).mode("append").save(folder)
    return (spark.read.format("warc").option("splitBytes", split_bytes)
            .option("payloads", str(payloads).lower()).load(folder))
