"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; a bundle ends with a skippable frame, the
seek table (compressed and decompressed size of every frame), so that any frame can be
read alone. The index maps a record to its bundle, its frame and its place within the
decompressed frame. Of pages with equal payloads of ``MIN_SHARED`` bytes or more the one
with the smallest id is stored, the others are revisit records that refer to it.

Each task writes bundles of its own under a fresh name and returns their index rows,
which Spark commits as a table: bundles of failed or repeated attempts are in no index
and so are never read. Files are reached through the Arrow file system of the folder's
URI, which on a cluster must be one that all executors share.

Null html is an empty payload; null urls and ids are left out of the headers. A page
without an id is stored whole and nothing refers to it. Repeated rows are records of
their own. A payload of any size that Spark can hold is one record; it gets a frame of
its own if it is larger than a frame. No pages give no bundle. Columns besides id, url
and html are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import saved

MIN_SHARED = 100
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 26
LEVEL = 3
DATE = "2026-01-01T00:00:00Z"

# Fixed by the seekable format.
SEEK_FRAME, SEEK_FOOTER = 0x184D2A5E, 0x8F92EAB1
FOOTER_SIZE = 9
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id bigint, bundle string, frame int, offset bigint, length bigint"
RECORD = ("page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, "
          "record_type string, refers_to bigint, intact boolean")


def elected(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, payload, payload_digest, refers_to``; narrow rows elect the stored copy."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    pages = pages.withColumn("payload_digest", F.sha2("payload", 256))
    shared = (pages.where((F.octet_length("payload") >= MIN_SHARED) & F.col("page_id").isNotNull())
              .groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.max("page_id").alias("_last"))
              .where("_first < _last").select("payload_digest", "_first"))
    refers = F.when(F.col("page_id") != F.col("_first"), F.col("_first"))
    return pages.join(shared, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_digest", refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has no body, but the length and digest of the full payload."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    name = uuid.uuid4().urn if page_id is None else f"urn:page:{page_id}"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}",
              "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", *sizes) for sizes in frames)
    footer = struct.pack("<IBI", len(frames), 0, SEEK_FOOTER)
    return struct.pack("<II", SEEK_FRAME, len(entries) + FOOTER_SIZE) + entries + footer


def frames_of(file) -> list[tuple[int, int, int]]:
    """Start, compressed and decompressed size of a bundle's frames, from its seek table."""
    size = file.size()
    count, descriptor, magic = struct.unpack("<IBI", file.read_at(FOOTER_SIZE, size - FOOTER_SIZE))
    if magic != SEEK_FOOTER:
        raise ValueError("no seek table")
    width = 12 if descriptor & 0x80 else 8
    entries = file.read_at(count * width, size - FOOTER_SIZE - count * width)
    out, start = [], 0
    for k in range(count):
        compressed, plain = struct.unpack_from("<II", entries, k * width)
        out.append((start, compressed, plain))
        start += compressed
    return out


class Bundle:
    """A bundle being written, frame by frame."""

    def __init__(self, folder: str):
        import zstandard

        self.system, base = arrow_fs.FileSystem.from_uri(folder)
        self.name = f"bundle-{uuid.uuid4().hex}.warc.zst"
        self.file = self.system.open_output_stream(f"{base}/{self.name}", compression=None)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[tuple[int, int]] = []
        self.plain, self.size, self.written = io.BytesIO(), 0, 0

    def add(self, data: bytes) -> tuple[str, int, int, int]:
        """Where the record lies: bundle, frame, offset within the frame, length."""
        if self.size and self.size + len(data) > FRAME_BYTES:
            self.close_frame()
        place = self.name, len(self.frames), self.size, len(data)
        self.plain.write(data)
        self.size += len(data)
        return place

    def close_frame(self) -> None:
        if self.size:
            data = self.compressor.compress(self.plain.getvalue())
            self.file.write(data)
            self.frames.append((len(data), self.size))
            self.written += len(data)
            self.plain, self.size = io.BytesIO(), 0

    def close(self) -> None:
        self.close_frame()
        self.file.write(seek_table(self.frames))
        self.file.close()


def write_bundles(pages: DataFrame, folder: str, **columns: str) -> DataFrame:
    """Write all pages to bundles in ``folder``; returns the stored index."""
    spark = pages.sparkSession
    system, base = arrow_fs.FileSystem.from_uri(folder)
    system.create_dir(f"{base}/bundles", recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            rows = []
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle is not None and bundle.written > BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
                bundle = bundle or Bundle(f"{folder}/bundles")
                rows.append((page_id, *bundle.add(record(page_id, url, payload, digest, refers_to))))
            if rows:
                kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)],
                                                 ["page_id", "bundle", "frame", "offset", "length"])
        if bundle is not None:
            bundle.close()

    index = elected(pages, **columns).mapInArrow(write, INDEX)
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and body of the records in a decompressed frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        length = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + length]
        at = end + 4 + length + 4


def _page_number(name: str | None) -> int | None:
    return int(name[len("<urn:page:") : -1]) if name and name.startswith("<urn:page:") else None


def _row(headers: dict[str, str], body: bytes, with_payload: bool) -> tuple:
    kind, stated = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
    length = int(headers["WARC-Payload-Length"])
    digest = hashlib.sha256(body).hexdigest() if kind == "response" else stated
    intact = digest == stated and (kind == "revisit" or length == len(body))
    return (_page_number(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"),
            body if with_payload and kind == "response" else None,
            len(body) if kind == "response" else length, digest, kind,
            _page_number(headers.get("WARC-Refers-To")), intact)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
             ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
             ("intact", pa.bool_())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds, strict=True)],
                                      [name for name, _ in kinds])


def read_bundles(index: DataFrame, folder: str, *, with_payload: bool = False) -> DataFrame:
    """All records of the bundles an index names, in parallel by bundle. ``intact`` says
    whether a payload has the digest and length its header states."""
    bundles = index.select("bundle").distinct()
    count = bundles.count()
    cores = index.sparkSession.sparkContext.defaultParallelism

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        system, base = arrow_fs.FileSystem.from_uri(f"{folder}/bundles")
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_file(f"{base}/{name}") as file:
                    for start, compressed, plain in frames_of(file):
                        frame = zstandard.ZstdDecompressor().decompress(file.read_at(compressed, start), plain)
                        rows = [_row(headers, body, with_payload) for headers, body in parsed(frame)]
                        if rows:
                            yield _batch(rows)

    return bundles.repartition(max(1, min(count, 4 * cores))).mapInArrow(read, RECORD)


def fetch(index: DataFrame, ids: DataFrame, folder: str, *, id_col: str = "page_id") -> DataFrame:
    """Records of given pages: only the frames that hold them are read."""
    wanted = index.join(ids.select(F.col(id_col).cast("long").alias("page_id")).distinct(), "page_id", "left_semi")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        system, base = arrow_fs.FileSystem.from_uri(f"{folder}/bundles")
        for batch in batches:
            rows = []
            for name, number, offset, length in sorted(zip(*(batch.column(c).to_pylist() for c in (
                    "bundle", "frame", "offset", "length")), strict=True)):
                with system.open_input_file(f"{base}/{name}") as file:
                    start, compressed, plain = frames_of(file)[number]
                    frame = zstandard.ZstdDecompressor().decompress(file.read_at(compressed, start), plain)
                rows += [_row(h, b, True) for h, b in parsed(frame[offset : offset + length])]
            if rows:
                yield _batch(rows)

    return wanted.select("bundle", "frame", "offset", "length").mapInArrow(read, RECORD)


def round_trip(pages: DataFrame, folder: str, **columns: str) -> DataFrame:
    """Write, then read back what was written."""
    return saved(read_bundles(write_bundles(pages, folder, **columns), folder), "records")
