"""WARC archives as seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each with some whole records, and one last
skippable frame with the sizes of all frames (the seek table of the public seekable format). Any
decoder reads it from front to back; a reader that wants one record reads the table at the end,
then the one frame that the index names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.llm.common import ship, stored, text_or_empty
from kairograph.plans.storage import new_path

# Fixed values of the seekable format and of WARC 1.1.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n"
URN = "urn:page:"
NO_ID = "none"

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 256 << 20
CHUNK_BYTES = 8 << 20
READ_TASKS = 100_000
LEVEL = 3


# --- records ------------------------------------------------------------------------------


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One record; a revisit holds the HTTP header of the page and no payload."""
    http = END.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""])
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{URN}{page_id}>"),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{URN}{refers_to}>"), ("WARC-Profile", REVISIT)]
    head = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return b"WARC/1.1\r\n" + head.encode() + END + block + END + END


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def _page(value: str | None) -> str | None:
    found = value[len(URN) + 1 : -1] if value else None
    return None if found == NO_ID else found


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of one or more whole frames; a payload that does not match its digest is an error."""
    at = 0
    while at < len(data):
        body = data.index(b"\r\n\r\n", at) + 4
        fields = _fields(data[at : body - 4])
        end = body + int(fields["Content-Length"])
        http = data.index(b"\r\n\r\n", body, end) + 4
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        payload = data[http:end] if fields["WARC-Type"] == "response" else None
        if payload is not None and payload_digest(payload) != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
        yield {
            "page": _page(fields["WARC-Record-ID"]),
            "url": fields.get("WARC-Target-URI"),
            "record_type": fields["WARC-Type"],
            "payload_digest": digest,
            "payload_bytes": int(_fields(data[body : http - 4])["Content-Length"]),
            "refers_to": _page(fields.get("WARC-Refers-To")),
            "payload": payload,
        }
        at = end + 4


# --- bundles ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Place:
    frame: int
    offset: int
    length: int


class Bundle:
    """Writes records to frames of about `frame_bytes` before compression, then the seek table."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.out, self.frame_bytes = out, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.filled = self.written = 0

    def add(self, data: bytes) -> Place:
        place = Place(len(self.sizes), self.filled, len(data))
        self.open.append(data)
        self.filled += len(data)
        if self.filled >= self.frame_bytes:
            self._frame()
        return place

    def _frame(self) -> None:
        packed = self.compressor.compress(b"".join(self.open))
        self.out.write(packed)
        self.sizes.append((len(packed), self.filled))
        self.written += len(packed)
        self.open, self.filled = [], 0

    def close(self) -> None:
        if self.open:
            self._frame()
        entries = b"".join(struct.pack("<II", *sizes) for sizes in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()


def _opened(uri: str):
    system, path = pafs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def seek_table(file) -> list[tuple[int, int, int]]:
    """Offset, packed size and size of every frame, from the end of the file."""
    size = file.size()
    n, checksums, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end")
    entry = 12 if checksums & 0x80 else 8
    table = file.read_at(n * entry, size - 9 - n * entry)
    found, at = [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", table, i * entry)
        found.append((at, packed, plain))
        at += packed
    return found


def read_record(uri: str, place: Place) -> dict:
    """One record by its place: reads the seek table and one frame."""
    with _opened(uri) as file:
        at, packed, plain = seek_table(file)[place.frame]
        data = zstandard.ZstdDecompressor().decompress(file.read_at(packed, at), max_output_size=plain)
    return next(parse_records(data[place.offset : place.offset + place.length]))


# --- jobs ---------------------------------------------------------------------------------

INDEX = "page string, file string, frame int, offset long, length long"


def _write_bundles(folder: str, frame_bytes: int, bundle_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pafs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        # The name is new for each attempt: only files that the index of finished tasks names count.
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        bundle, name, made = None, "", 0
        for batch in batches:
            rows = []
            for page, url, payload, digest, refers_to in zip(*batch.columns, strict=True):
                if bundle is None:
                    name = f"{part:06d}-{attempt}-{made}.warc.zst"
                    bundle, made = Bundle(system.open_output_stream(f"{base}/{name}", compression=None), frame_bytes), made + 1
                data = record(page.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py(), date)
                place = bundle.add(data)
                rows.append((page.as_py(), f"{folder}/{name}", place.frame, place.offset, place.length))
                if bundle.written >= bundle_bytes:
                    bundle.close()
                    bundle = None
            types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["page", "file", "frame", "offset", "length"])
        if bundle is not None:
            bundle.close()

    return run


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    revisit_bytes: int = 0,
    frame_bytes: int = FRAME_BYTES,
    bundle_bytes: int = BUNDLE_BYTES,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write one record per page to bundles in `folder`; the index (page, file, frame, offset, length) comes back.

    Of pages with equal payloads of at least `revisit_bytes` bytes the one with the smallest key is a
    response and the others revisit it. A null html is an empty payload; a null url leaves the field
    out. Null keys are largest, written as `none`; where all keys are null, and where rows repeat the
    smallest key, each such row is a response. Other columns are ignored. An empty table writes nothing.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = folder or new_path(spark, "warc")
    payload = F.encode(text_or_empty(html), "utf-8")
    digest = F.sha2(payload, 256)
    few = pages.select(F.col(key).alias("key"), digest.alias("strong"), F.octet_length(payload).alias("n"))
    first = few.where(F.col("n") >= revisit_bytes).groupBy("strong").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies"))
    first = first.where("copies > 1").drop("copies")
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), payload.alias("payload"), digest.alias("strong"))
    repeats = F.coalesce(F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")), F.lit(False))
    records = rows.join(first, "strong", "left").select(
        F.coalesce(F.col("key").cast("string"), F.lit(NO_ID)).alias("page"),
        "url",
        "payload",
        F.sha1("payload").alias("sha1"),
        F.when(repeats, F.col("first").cast("string")).alias("refers_to"),
    )
    records = records.withColumn("sha1", _base32("sha1"))
    return stored(records.mapInArrow(_write_bundles(folder, frame_bytes, bundle_bytes, date), INDEX), "warc-index")


def _base32(name: str):
    """Base 32 of a hexadecimal SHA-1: 160 bits are 32 digits of five bits."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    bits = F.concat(*[F.lpad(F.conv(F.substring(name, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)])
    return F.translate(F.lower(bits), "0123456789abcdefghijklmnopqrstuv", letters)


def _chunks(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows: list[tuple[str, int, list[int]]] = []
                with _opened(uri) as file:
                    for at, packed, _ in seek_table(file):
                        if not rows or at + packed - rows[-1][1] > chunk_bytes:
                            rows.append((uri, at, []))
                        rows[-1][2].append(packed)
                columns = list(zip(*rows, strict=True)) if rows else [()] * 3
                types = [pa.string(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file", "at", "frames"])

    return run


RECORDS = {
    "page": pa.string(), "url": pa.string(), "record_type": pa.string(), "payload_digest": pa.string(),
    "payload_bytes": pa.int64(), "refers_to": pa.string(), "payload": pa.binary(),
}


def _read_chunks(with_payload: bool):
    def batch_of(rows: Iterable[dict]) -> pa.RecordBatch:
        names = [n for n in RECORDS if with_payload or n != "payload"]
        rows = list(rows)
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], RECORDS[n]) for n in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for uri, at, frames in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _opened(uri) as file:
                    data = memoryview(file.read_at(sum(frames), at))
                start = 0
                for size in frames:
                    yield batch_of(parse_records(unpack.decompress(data[start : start + size])))
                    start += size

    return run


def read_archives(spark: SparkSession, index: DataFrame, with_payload: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """All records of the bundles that the index names, a row each; frames of a file are dealt out to tasks."""
    ship(spark)
    files = index.select("file").distinct()
    chunks = stored(files.mapInArrow(_chunks(chunk_bytes), "file string, at long, frames array<long>"), "warc-chunks")
    # A row stands for a chunk of a file, so the rows are dealt to as many tasks, up to a bound.
    tasks = min(max(chunks.count(), 1), READ_TASKS)
    names = ", ".join(
        f"{n} {'long' if t == pa.int64() else 'binary' if t == pa.binary() else 'string'}"
        for n, t in RECORDS.items()
        if with_payload or n != "payload"
    )
    return chunks.repartition(tasks, "file", "at").mapInArrow(_read_chunks(with_payload), names)
