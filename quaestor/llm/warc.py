"""WARC archives: writing, normalising whole-file gzip streams, and reading back by offset.

``write_archives`` writes pages as records into monolithic archives, each one gzip stream.
``normalise`` inflates such a stream once, rewrites every record as a gzip member of its own, and puts a
sidecar index (record id, offset, length) beside the archive. ``read_records`` seeks to single members.

Of equal payloads of at least ``least`` bytes the record with the smallest page_id is the response, the
others revisit it; rows that repeat this id are responses too. Null html is an empty payload. A record
without page_id has the id ``null``. URLs are percent-encoded where they have control characters or blanks.

Archives are files in the shared folder, named per task attempt, so a task that runs again writes a new
file; only the files in the returned table count. Streams are read and written piece by piece; one
record at a time is in memory.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import scratch_path, stored

LEAST = 100
LEVEL = 4
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "<urn:x-page:{}>"
INDEX = "archive string, record_id string, offset long, length long"


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    name = "null" if page_id is None else page_id
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {URN.format(name)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {URN.format(refers_to)}"]
    else:
        block += payload
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode()
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def _records(stream) -> Iterator[bytes]:
    """The records of a whole-file gzip stream, which may also have several members."""
    inflate, held = zlib.decompressobj(31), bytearray()
    need = None
    while True:
        while True:
            if need is None and (at := held.find(b"\r\n\r\n")) >= 0:
                need = at + 4 + int(_headers(bytes(held[:at]))["Content-Length"]) + 4
            if need is None or len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
        data = inflate.unused_data if inflate.eof else b""
        if inflate.eof:
            inflate = zlib.decompressobj(31)
        data = data or stream.read(1 << 20)
        if not data:
            break
        held += inflate.decompress(data)
    if held:
        raise ValueError("the archive ends inside a record")


def _open(path: str):
    return fs.FileSystem.from_uri(path)


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, digest and refers_to (null for responses)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    page_id, url = F.col("page_id").cast("long"), F.col("url").cast("string")
    rows = pages.select(page_id.alias("page_id"), url.alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    large = rows.where(F.octet_length("html") >= least)
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return rows.join(first.select("digest", "first"), "digest", "left").select(
        "page_id", "url", "html", "digest", refers.alias("refers_to")
    )


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes each partition as one gzip stream; returns the table of archives."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/mono-{uuid.uuid4().hex}.warc.gz"
        out, deflate = None, zlib.compressobj(LEVEL, wbits=31)
        for batch in batches:
            if out is None and batch.num_rows:
                files, at = _open(path)
                files.create_dir(at.rsplit("/", 1)[0], recursive=True)
                out = files.open_output_stream(at, compression=None)
            for page_id, url, html, digest, refers in zip(*batch.columns, strict=True):
                payload = html.as_py().encode()
                record = _record(page_id.as_py(), url.as_py(), payload, digest.as_py(), refers.as_py())
                out.write(deflate.compress(record))
        if out is not None:
            out.write(deflate.flush())
            out.close()
            yield pa.record_batch([pa.array([path])], ["archive"])

    return stored(records.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(each, "archive string"), "archives")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites archives with one member per record and a sidecar index; returns the index."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                files, at = _open(source)
                out_files, out_at = _open(target)
                out_files.create_dir(out_at.rsplit("/", 1)[0], recursive=True)
                index, offset = [], 0
                with files.open_input_stream(at, compression=None) as stream, out_files.open_output_stream(out_at, compression=None) as out:
                    for record in _records(stream):
                        deflate = zlib.compressobj(LEVEL, wbits=31)
                        member = deflate.compress(record) + deflate.flush()
                        out.write(member)
                        name = _headers(record[: record.index(b"\r\n\r\n")])["WARC-Record-ID"]
                        index.append((target, name, offset, len(member)))
                        offset += len(member)
                with out_files.open_output_stream(f"{out_at}.idx", compression=None) as out:
                    out.write("".join(f"{name} {o} {n}\n" for _, name, o, n in index).encode())
                if index:
                    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
                    columns = [pa.array(c, k) for c, k in zip(zip(*index, strict=True), kinds, strict=True)]
                    yield pa.record_batch(columns, ["archive", "record_id", "offset", "length"])

    parts = max(1, archives.count())
    return stored(archives.repartition(parts, "archive").mapInArrow(each, INDEX), "index")


def read_records(index: DataFrame, payloads: bool = False) -> DataFrame:
    """The records the index names, each read by its offset; checks the digest of every response."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * payloads]
    start = len(URN.split("{}")[0])

    def page(name: str | None):
        return None if name is None or name[start:-1] == "null" else int(name[start:-1])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != path:
                    files, at = _open(archive)
                    path, file = archive, files.open_input_file(at)
                record = zlib.decompress(file.read_at(length, offset), wbits=31)
                head, _, rest = record.partition(b"\r\n\r\n")
                fields = _headers(head)
                http, _, body = rest.partition(b"\r\n\r\n")
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                size = int(_headers(http)["Content-Length"])
                body = body[:size] if kind == "response" else b""
                if kind == "response" and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
                    raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not match its digest")
                row = (page(fields["WARC-Record-ID"]), size, digest, kind, page(fields.get("WARC-Refers-To")))
                rows.append((*row, body) if payloads else row)
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return index.select("archive", "offset", "length").mapInArrow(each, kind + ", payload binary" * payloads)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages, normalises the archives and reads every record back."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    archives = write_archives(with_revisits(pages), f"{folder}/monolithic")
    return read_records(normalise(archives, f"{folder}/members"))
