"""WARC archives: monolithic gzip files, their normaliser with a sidecar index, and a reader.

`write` streams pages into WARC files that are one gzip stream each. Such a file can only be
read from its start. `normalise` inflates each file once, rewrites every record as a
gzip member of its own - a repeated payload becomes a revisit - and writes a sidecar index
of offsets next to it, so that `read` can fetch records by range in any task. Every task
names its files anew, so a repeated task leaves only unused files behind.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import checkpoint, shared_folder

#: Uncompressed bytes after which a task starts another archive, and compressed bytes that one reading task fetches.
ROLL, RANGE = 1 << 30, 64 << 20
LEVEL = 1
CHUNK = 1 << 20
ENTRY = "file string, seq long, page_id long, digest string, payload_bytes long"
MEMBER = "file string, seq long, offset long, length long, page_id long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _number(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def record(page_id: int | None, url: str | None, digest: str, length: int, payload: bytes | None, refers_to: str | None = None) -> bytes:
    """A response record, or a revisit (no payload) of the record named `refers_to`."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    body = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if ord(c) < 33 or c == "%" else c for c in url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def headers(block: bytes) -> dict[str, str]:
    lines = block.decode().split("\r\n")[1:]
    return {name.lower(): value for name, _, value in (line.partition(": ") for line in lines)}


class Stream:
    """Records of a gzip file of one or several members, inflated once from start to end."""

    def __init__(self, source) -> None:
        self.source, self.buffer, self.inflate, self.rest = source, bytearray(), zlib.decompressobj(31), b""

    def _more(self) -> bool:
        data = self.rest or self.source.read(CHUNK)
        if not data:
            return False
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(31)
        self.buffer += self.inflate.decompress(data)
        self.rest = self.inflate.unused_data
        return True

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """(headers, block) of each record."""
        while True:
            while (end := self.buffer.find(b"\r\n\r\n")) < 0:
                if not self._more():
                    return
            head = headers(bytes(self.buffer[:end]))
            stop = end + 4 + int(head["content-length"])
            while len(self.buffer) < stop + 4:
                if not self._more():
                    raise EOFError("the archive ends within a record")
            yield head, bytes(self.buffer[end + 4 : stop])
            del self.buffer[: stop + 4]


def _batch(rows: list[tuple], schema: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema)], names)


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write every page as a response record; return its place (file, seq) with digest and length.

    A null html is an empty payload, a null url leaves its header out, a null id its
    number. Each task writes files of about 1 GB uncompressed; the returned table is written.
    """
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        out = deflate = None
        name, seq, size = "", 0, 0
        for batch in batches:
            rows = []
            for page_id, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                if out is None:
                    name, seq, size = f"{uuid.uuid4().hex}.mono.warc.gz", 0, 0
                    out, deflate = system.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(LEVEL, wbits=31)
                payload = html or b""
                digest = digest_of(payload)
                data = record(page_id, url, digest, len(payload), payload)
                out.write(deflate.compress(data))
                rows.append((name, seq, page_id, digest, len(payload)))
                seq, size = seq + 1, size + len(data)
                if size >= ROLL:
                    out.write(deflate.flush())
                    out.close()
                    out = None
            yield _batch(rows, [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()], ["file", "seq", "page_id", "digest", "payload_bytes"])
        if out is not None:
            out.write(deflate.flush())
            out.close()

    return checkpoint(slim.mapInArrow(run, ENTRY))


def revisits(entries: DataFrame, least: int = 0) -> DataFrame:
    """Entries with revisit (bool) and first (the page it repeats).

    Of records with equal payloads of at least `least` bytes the one with the smallest
    id (null last, then by place) stays; smaller payloads all stay.
    """
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "file", "seq")
    firsts = entries.where(F.col("payload_bytes") >= least).groupBy(F.col("digest").alias("d")).agg(F.min(place).alias("at"))
    joined = entries.join(firsts, (F.col("digest") == F.col("d")) & (F.col("payload_bytes") >= least), "left")
    again = F.col("at").isNotNull() & ~((F.col("at.file") == F.col("file")) & (F.col("at.seq") == F.col("seq")))
    return joined.select("file", "seq", "page_id", again.alias("revisit"), F.col("at.page_id").alias("first"))


def normalise(entries: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive with one gzip member per record and a sidecar index; return the index as a written table.

    `entries` has a row (file, seq, revisit, first) per record. The sidecar
    `<name>.idx` has one line per record: offset, length, record id, type.
    """
    files = entries.select("file").distinct().count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        current, name, at = None, "", 0
        source = out = index = records = None
        for batch in batches:
            rows = []
            for file, seq, revisit, first in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if file != current:
                    if out is not None:
                        out.close(), index.close(), source.close()
                    current, name, at = file, f"{uuid.uuid4().hex}.warc.gz", 0
                    source = system.open_input_stream(f"{base}/{file}", compression=None)
                    records = iter(Stream(source))
                    out, index = system.open_output_stream(f"{base}/{name}", compression=None), system.open_output_stream(f"{base}/{name}.idx", compression=None)
                head, block = next(records)
                split = block.index(b"\r\n\r\n") + 4
                page_id, url = _number(head["warc-record-id"]), head.get("warc-target-uri")
                payload, digest = block[split:], head["warc-payload-digest"].removeprefix("sha1:")
                again = record(page_id, _plain(url), digest, len(payload), None if revisit else payload, _name(first) if revisit else None)
                deflate = zlib.compressobj(LEVEL, wbits=31)
                member = deflate.compress(again) + deflate.flush()
                out.write(member)
                index.write(f"{at} {len(member)} {head['warc-record-id']} {'revisit' if revisit else 'response'}\n".encode())
                rows.append((name, seq, at, len(member), page_id))
                at += len(member)
            yield _batch(rows, [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()], ["file", "seq", "offset", "length", "page_id"])
        if out is not None:
            out.close(), index.close(), source.close()

    dealt = entries.select("file", "seq", "revisit", "first").repartition(max(files, 1), "file").sortWithinPartitions("file", "seq")
    return checkpoint(dealt.mapInArrow(run, MEMBER))


def _plain(url: str | None) -> str | None:
    """Undo the escapes of `record`."""
    if url is None or "%" not in url:
        return url
    head, *rest = url.split("%")
    return head + "".join(chr(int(p[:2], 16)) + p[2:] for p in rest)


def read(members: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records of normalised archives, fetched by the offsets of their index.

    payload_bytes and payload_digest are those of the full payload, also for revisits,
    whose own payload is null. A payload that does not have its digest raises an error.
    """
    ranged = members.withColumn("piece", F.floor(F.col("offset") / RANGE))
    pieces = ranged.select("file", "piece").distinct().count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        current, source = None, None
        for batch in batches:
            rows, held = [], 0
            for file, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if file != current:
                    if source is not None:
                        source.close()
                    current, source = file, system.open_input_file(f"{base}/{file}")
                data = zlib.decompress(source.read_at(length, offset), 31)
                end = data.index(b"\r\n\r\n")
                head, block = headers(data[:end]), data[end + 4 : -4]
                split = block.index(b"\r\n\r\n") + 4
                http, payload = headers(block[: split - 4]), block[split:]
                kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and digest_of(payload) != digest:
                    raise ValueError(f"{file}, offset {offset}: the payload does not have its digest")
                own = payload if payloads and kind == "response" else None
                rows.append((_number(head["warc-record-id"]), _plain(head.get("warc-target-uri")), kind, int(http["content-length"]), digest, _number(head.get("warc-refers-to")), own))
                held += len(own or b"")
                if held > RANGE:
                    yield _batch(rows, kinds, names)
                    rows, held = [], 0
            yield _batch(rows, kinds, names)

    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    dealt = ranged.select("file", "offset", "length", "piece").repartition(max(pieces, 1), "file", "piece").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, RECORD)


def archive(pages: DataFrame, folder: str | None = None, *, least: int = 0) -> tuple[DataFrame, str]:
    """Write, normalise and index the pages under `folder` (else a new shared one); return (index, folder).

    The monolithic files are removed once the normalised ones are complete.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    entries = write(pages, folder)
    members = normalise(revisits(entries, least), folder)
    for row in entries.select("file").distinct().toLocalIterator():
        system.delete_file(f"{base}/{row.file}")
    return members, folder
