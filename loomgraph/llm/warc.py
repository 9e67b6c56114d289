"""WARC archives of pages, each record compressed with a dictionary of the corpus."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from functools import partial
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, save, shared_dir, type_of

#: Payloads of so many bytes or more are archived once; the others that equal one revisit it.
REVISIT_BYTES = 1000
#: Of the skippable frame that holds the dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
#: Records that the dictionary is built from, by the hash of their address, and bytes taken of each.
SAMPLE, SAMPLE_BYTES = 512, 16 << 10
#: An archive is closed once it holds so much.
ARCHIVE_BYTES = 64 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _file(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _line(value: str) -> str:
    """A header's value without line ends."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def _block(headers: list[tuple[str, str]], body: bytes) -> bytes:
    head = "".join(f"{k}: {_line(v)}\r\n" for k, v in [*headers, ("Content-Length", str(len(body)))])
    return f"WARC/1.1\r\n{head}\r\n".encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url or "urn:x-unknown"),
        ("WARC-Payload-Digest", f"sha1:{_base32(digest)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    return _block(headers, http if refers_to is not None else http + payload)


def dictionary(samples: list[bytes]) -> bytes:
    """A trained Zstandard dictionary, or none if the samples are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


class Writer:
    """Appends records to an archive, each a frame of its own behind the dictionary's skippable frame."""

    def __init__(self, out: BinaryIO, trained: bytes) -> None:
        self.out, self.bytes, self.records = out, 0, 0
        if trained:
            self._put(struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        self._put(self.compressor.compress(_block([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'warcinfo')}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"software: loomgraph\r\n")))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, record: bytes) -> None:
        self._put(self.compressor.compress(record))
        self.records += 1


def read_records(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, read as a stream."""
    head, trained = source.read(8), None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_MAGIC:
        trained, head = zstandard.ZstdCompressionDict(source.read(struct.unpack("<I", head[4:])[0])), b""
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=trained).stream_reader(_Joined(head, source), read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if line == b"\r\n":
            continue
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode("utf-8", "surrogatepass").rstrip("\r\n").partition(": ")
            headers[key] = value
        yield headers, stream.read(int(headers["Content-Length"]))


class _Joined(io.RawIOBase):
    """Bytes already read, and then the rest of a source."""

    def __init__(self, head: bytes, rest: BinaryIO) -> None:
        self.head, self.rest = head, rest

    def readable(self) -> bool:
        return True

    def read(self, size: int = -1) -> bytes:
        if self.head:
            found, self.head = self.head, b""
            return found
        return self.rest.read(size)


def _write(batches: Iterator[pa.RecordBatch], folder: str, trained: bytes) -> Iterator[pa.RecordBatch]:
    """Archives of this task; their names also hold the attempt, so that a repeated task harms none."""
    context = TaskContext.get()
    name, done, out, writer = f"{folder}/pages-{context.partitionId():06d}-{context.taskAttemptId()}", [], None, None
    for batch in batches:
        for at in range(batch.num_rows):
            page_id, url, html, digest, refers_to = (batch.column(k)[at].as_py() for k in ("page_id", "url", "html", "digest", "refers_to"))
            if writer is None:
                done.append(f"{name}-{len(done):04d}.warc.zst")
                system, path = _file(done[-1])
                out = system.open_output_stream(path, compression=None)
                writer = Writer(out, trained)
            writer.add(page_record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, refers_to))
            if writer.bytes >= ARCHIVE_BYTES:
                out.close()
                writer = None
    if writer is not None:
        out.close()
    yield pa.record_batch([pa.array(done, pa.string())], names=["path"])


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Archives pages (page_id, url, html, ...) below folder and returns a table of their paths.

    Of equal payloads of REVISIT_BYTES or more the one with the largest page_id is
    a response and the others revisit it; rows that repeat that id are responses
    too, and rows without an id revisit it unless none of them has one. Null html
    is an empty payload. Only payloads that occur twice or more are looked up, by
    digest; copies of one page, however many, are counted before they are moved.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.select("*", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("bytes"))
    twice = rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")
    other = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    records = rows.join(twice, "digest", "left").select("page_id", "url", "html", "digest", F.when(other, F.col("response")).alias("refers_to"))
    starts = rows.select("page_id", "url", F.substring("html", 1, SAMPLE_BYTES).alias("html"), "digest")
    sample = hash_sample(starts, SAMPLE, "url", "page_id")
    samples = [page_record(r.page_id, r.url, r.html.encode("utf-8", "surrogatepass"), r.digest, None) for r in sample.collect()]
    system, path = _file(folder)
    system.create_dir(path, recursive=True)
    return save(records.mapInArrow(partial(_write, folder=folder, trained=dictionary(samples)), "path string"), "archives")


RECORD = "payload_bytes bigint, payload_digest string, record_type string, refers_to"


def _read(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column("path").to_pylist():
            system, path = _file(uri)
            rows: list[tuple] = []
            with system.open_input_stream(path, compression=None) as source:
                for headers, block in read_records(source):
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if headers["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"{uri}: {headers['WARC-Record-ID']} doesn't hold the payload that it names")
                    ids = (int(headers[k]) if k in headers else None for k in ("X-Page-ID", "X-Refers-To-Page-ID"))
                    page, refers_to = ids
                    rows.append((page, size, digest, headers["WARC-Type"], refers_to))
                    if len(rows) == 10_000:
                        yield _batch(rows, kind)
                        rows = []
            yield _batch(rows, kind)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.string(), kind]
    columns = zip(*rows) if rows else [()] * 5
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read(archives: DataFrame, kind: str = "bigint") -> DataFrame:
    """A table of paths -> page_id, payload_bytes, payload_digest, record_type, refers_to of every page record."""
    spread = archives.repartition(max(1, min(archives.count(), 10_000)))
    return spread.mapInArrow(partial(_read, kind={"bigint": pa.int64(), "int": pa.int32()}[kind]), f"page_id {kind}, {RECORD} {kind}")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and returns what reading them back gives."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read(write(pages, folder), type_of(pages, "page_id"))


#: What round_trip() returns for a view pages, in SQL.
SQL = """with sized as (select page_id, coalesce(html, '') as body, strlen(coalesce(html, '')) as n from pages),
 found as (select *, case when n >= 1000 then max(page_id) over (partition by body) else page_id end as first from sized)
select page_id, cast(n as bigint) as payload_bytes, sha1(body) as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
 case when page_id = first then null else first end as refers_to from found"""
