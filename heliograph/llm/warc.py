"""Web archives: writing them, making every record its own gzip member, reading them by offset.

Archives that were compressed as one gzip stream can't be read from the middle. The normaliser inflates
such a file once from end to end, writes each of its records as a member of its own, and puts an index
of offsets beside the result. Neither a file nor a record is ever held whole.

One task handles one file. Files get the number of the task's attempt in their name, and a file counts
only if a written manifest or index names it, so that a repeated task can neither damage nor double it.
Files are reached through Arrow's file systems by the URI of the shared folder.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import in_small_batches, written
from heliograph.session import scratch_path

CHUNK = 1 << 20
#: A file is closed once it holds so many bytes before compression.
FILE_BYTES = 128 << 20
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
MANIFEST = "path string, records long"
INDEX = (
    "path string, offset long, length long, record_id string, record_type string, target_uri string, "
    "payload_digest string"
)
RECORDS = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
    "payload binary"
)


def _open(uri: str, write: bool = False) -> BinaryIO:
    from pyarrow.fs import FileSystem

    system, path = FileSystem.from_uri(uri)
    if not write:
        return system.open_input_file(path)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    arrays = [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of batches, few of them unpacked at a time."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(begin, 256).columns))


def record_head(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, nth: str) -> bytes:
    """Everything of a WARC record up to the payload. A revisit has the HTTP header of the payload it
    stands for, and with it its length, but no payload."""
    http = HTTP.format(len(payload)).encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {nth}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else len(payload))}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=SAFE)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"X-Refers-To-Page-ID: {refers_to}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


#: What stays as it is in a URI of a header; everything else, line ends above all, is percent-encoded.
SAFE = "!#$&'()*+,/:;=?@[]~%"


def _writer(folder: str, min_bytes: int, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt, files = TaskContext.get().taskAttemptId(), 0
        out = None
        for page_id, url, html, first in _values(batches):
            if out is None:
                path = f"{folder}/monolith-{attempt}-{files}.warc.gz"
                out, packer, size, records = _open(path, True), zlib.compressobj(level, wbits=31), 0, 0
            payload = (html or "").encode()
            revisit = first is not None and page_id != first and len(payload) >= min_bytes
            head = record_head(page_id, url, payload, first, revisit, f"{attempt} {files} {records}")
            for part in (head, b"" if revisit else payload, b"\r\n\r\n"):
                out.write(packer.compress(part))
                size += len(part)
            records += 1
            if size >= FILE_BYTES:
                out.write(packer.flush())
                out.close()
                yield _batch([(path, records)], MANIFEST)
                out, files = None, files + 1
        if out is not None:
            out.write(packer.flush())
            out.close()
            yield _batch([(path, records)], MANIFEST)

    return write


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 6) -> DataFrame:
    """Write pages (page_id, url, html) as WARC records, one gzip stream per file; returns the manifest.

    Of the pages with equal payloads of at least `min_bytes`, those with the smallest page_id are
    responses and the others revisit them; smaller payloads are all responses.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    hashed = pages.withColumn("_sha", F.sha1(payload))
    # The key of the looked-up side is made after its aggregation, so that the join can be split.
    first = hashed.groupBy("_sha").agg(F.min("page_id").alias("_first"))
    first = first.select(F.concat(F.lit("="), "_sha").alias("_key"), "_first")
    marked = hashed.withColumn("_key", F.concat(F.lit("="), "_sha")).join(first, "_key", "left")
    rows = marked.select("page_id", "url", "html", "_first")
    return written(in_small_batches(rows).mapInArrow(_writer(folder, min_bytes, level), MANIFEST), "warc-manifest")


class _Stream:
    """Bytes of a file, inflated once; several gzip members in a row are one stream."""

    def __init__(self, source: BinaryIO) -> None:
        self.source, self.inflater, self.ended = source, zlib.decompressobj(31), False
        self.buffer, self.at = b"", 0

    def more(self) -> bool:
        while not self.ended:
            raw = self.inflater.unconsumed_tail or self.inflater.unused_data or self.source.read(CHUNK)
            if not raw:
                if not self.inflater.eof:
                    raise ValueError("the gzip stream is cut off")
                self.ended = True
                return False
            if self.inflater.eof:
                self.inflater = zlib.decompressobj(31)
            if found := self.inflater.decompress(raw, CHUNK):
                self.buffer, self.at = self.buffer[self.at :] + found, 0
                return True
        return False

    def head(self) -> bytes | None:
        """The next record's header with its empty line; None at the end."""
        while True:
            while self.buffer[self.at : self.at + 1] in (b"\r", b"\n"):
                self.at += 1
            if (end := self.buffer.find(b"\r\n\r\n", self.at)) >= 0:
                head, self.at = self.buffer[self.at : end + 4], end + 4
                return head
            if not self.more():
                if self.at < len(self.buffer):
                    raise ValueError("a record's header is cut off")
                return None

    def body(self, length: int) -> Iterator[bytes]:
        while length:
            if self.at == len(self.buffer) and not self.more():
                raise ValueError("a record's content is cut off")
            part = self.buffer[self.at : self.at + length]
            self.at += len(part)
            length -= len(part)
            yield part


def header_fields(head: bytes) -> dict[str, str]:
    """A WARC header's named fields, names in lower case."""
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def _normaliser(folder: str, level: int):
    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt, files = TaskContext.get().taskAttemptId(), 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                target = f"{folder}/members-{attempt}-{files}.warc.gz"
                files += 1
                rows, offset = [], 0
                with _open(path) as source, _open(target, True) as out, _open(f"{target}.idx", True) as index:
                    stream = _Stream(source)
                    while (head := stream.head()) is not None:
                        fields, packer, length = header_fields(head), zlib.compressobj(level, wbits=31), 0
                        for part in chain([head], stream.body(int(fields["content-length"])), [b"\r\n\r\n", None]):
                            packed = packer.flush() if part is None else packer.compress(part)
                            out.write(packed)
                            length += len(packed)
                        row = (
                            target, offset, length, fields["warc-record-id"], fields["warc-type"],
                            fields.get("warc-target-uri"), fields.get("warc-payload-digest"),
                        )
                        names = [f.split()[0] for f in INDEX.split(", ")]
                        index.write(json.dumps(dict(list(zip(names, row))[1:])).encode() + b"\n")
                        rows.append(row)
                        offset += length
                        if len(rows) >= 10_000:
                            yield _batch(rows, INDEX)
                            rows = []
                if rows:
                    yield _batch(rows, INDEX)

    return normalise


def normalise_archives(manifest: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrite whole-stream archives with one gzip member per record, each file with a sidecar index
    (`.idx`, a JSON line per record). Returns the index of all files.

    A file may consist of several gzip members and may hold empty lines between records. A file that
    ends within a record fails its task rather than losing the record.
    """
    files = manifest.select("path")
    return written(
        files.repartition(max(1, files.count())).mapInArrow(_normaliser(folder, level), INDEX), "warc-index"
    )


def read_record(raw: bytes) -> tuple:
    """One gzip member as a row of `RECORDS`. The payload of a response must have its stated digest."""
    data = zlib.decompress(raw, wbits=31)
    at = data.index(b"\r\n\r\n") + 4
    fields = header_fields(data[:at])
    content = data[at : at + int(fields["content-length"])]
    http, _, payload = content.partition(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
    if fields["warc-type"] == "response":
        if len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"damaged record {fields['warc-record-id']}")
    return (
        page and int(page), fields.get("warc-target-uri"), fields["warc-type"], length, digest,
        refers and int(refers), payload if fields["warc-type"] == "response" else None,
    )


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    source, opened = None, None
    for batch in batches:
        rows, size = [], 0
        for path, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
            if path != opened:
                if source:
                    source.close()
                source, opened = _open(path), path
            source.seek(offset)
            rows.append(read_record(source.read(length)))
            size += rows[-1][3]
            if size >= 16_000_000:
                yield _batch(rows, RECORDS)
                rows, size = [], 0
        if rows:
            yield _batch(rows, RECORDS)
    if source:
        source.close()


def read_archives(index: DataFrame) -> DataFrame:
    """Records at the offsets of an index, in any selection and order; payloads of revisits are null."""
    spread = index.select("path", "offset", "length")
    parts = max(1, spread.select("path").distinct().count())
    spread = spread.repartition(parts, "path").sortWithinPartitions("path", "offset")
    return spread.mapInArrow(_reader, RECORDS)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages as whole-stream archives, normalise those, and read the records back by offset.

    A missing html is an empty payload; a missing url has no target; line ends and other foreign
    characters of a url come back percent-encoded. Pages without id are revisits of the smallest id with
    their payload, responses if none has one; repeated rows with the smallest id are all responses.
    Empty tables give no records; other columns of `pages` are not read.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    index = normalise_archives(write_archives(pages, folder, min_bytes), folder)
    return read_archives(index)
