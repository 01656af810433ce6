"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding some records,
followed by a seek table in a skippable frame: for each frame its compressed
and decompressed size, then the number of frames, a descriptor byte and the
magic number, all little-endian.  A decoder that does not know the table skips
it.  The index maps a record's id to its bundle, frame, and place in the
decompressed frame, so one record costs one frame.

Bundles are binary rows of a table, so that Spark's committer decides which
attempt of a task counts, in any store that Spark writes to; `export` puts
each into a file of its own.

Of records with equal payloads of at least `revisit_bytes`, that with the
largest id is a response and the others revisit it.

Nulls and repeats: a null payload is empty; a null url or id is written as an
empty header, and a row without an id, which no revisit could name, is always a
response; rows with one id are written each, and those with equal payloads take
the same role; ids of any type are written as text and read back as `id_type`;
an empty table gives no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch

# Fixed values of the seekable format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1

BUNDLES = "bundle_id long, data binary, ids array<string>, frames array<int>, starts array<long>, lengths array<long>"


def record(page_id: object, url: str | None, payload: bytes, digest: str, size: int, refers_to: object) -> bytes:
    """One WARC/1.1 record; a revisit has no payload of its own."""
    name = "" if page_id is None else quote(str(page_id), safe="")
    kind = "response" if refers_to is None else "revisit"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{quote(str(refers_to), safe='')}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of a record."""

    def headers(lines: bytes) -> dict[str, str]:
        return dict(x.split(": ", 1) for x in lines.decode().split("\r\n")[1:])

    top, _, rest = data.partition(b"\r\n\r\n")
    fields = headers(top)
    head, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, headers(head), payload


class Bundle:
    """Frames of one bundle, written one after another."""

    def __init__(self, frame_bytes: int, level: int) -> None:
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.parts: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.open_bytes = self.written = 0
        self.entries: list[tuple[str, int, int, int]] = []

    def add(self, name: str, data: bytes) -> None:
        self.entries.append((name, len(self.sizes), self.open_bytes, len(data)))
        self.open.append(data)
        self.open_bytes += len(data)
        if self.open_bytes >= self.frame_bytes:
            self._close()

    def _close(self) -> None:
        if self.open:
            packed = self.packer.compress(b"".join(self.open))
            self.parts.append(packed)
            self.sizes.append((len(packed), self.open_bytes))
            self.written += len(packed)
            self.open, self.open_bytes = [], 0

    def finish(self) -> bytes:
        self._close()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join([*self.parts, struct.pack("<II", SKIPPABLE, len(table)), table])


class Reader:
    """Random access to a bundle by its seek table."""

    def __init__(self, data: bytes) -> None:
        count, descriptor, magic = struct.unpack("<IBI", data[-9:])
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end")
        width = 12 if descriptor & 0x80 else 8
        table = data[-9 - width * count : -9]
        self.data, self.frames, at = data, [], 0
        for n in range(count):
            packed, size = struct.unpack_from("<II", table, n * width)
            self.frames.append((at, packed, size))
            at += packed
        self.kept: tuple[int, bytes] = (-1, b"")

    def frame(self, n: int) -> bytes:
        if self.kept[0] != n:
            at, packed, size = self.frames[n]
            self.kept = n, zstandard.ZstdDecompressor().decompress(self.data[at : at + packed], max_output_size=size)
        return self.kept[1]

    def record(self, frame: int, start: int, length: int) -> bytes:
        return self.frame(frame)[start : start + length]


def roles(pages: DataFrame, scratch: Scratch, revisit_bytes: int, id_col: str, payload_col: str) -> DataFrame:
    """page_id, digest, refers_to of the pages that revisit another; only digests are shuffled."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    light = pages.select(F.col(id_col).alias("page_id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    light = scratch.keep(light.where(F.col("size") >= revisit_bytes), "light")
    first = light.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    first = scratch.keep(first.where("n > 1").select("digest", "refers_to"), "first")
    return scratch.keep(light.join(first, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct(), "roles")


def write_bundles(pages: DataFrame, scratch: Scratch, *, revisit_bytes: int = 1000, frame_bytes: int = 1 << 17, bundle_bytes: int = 8 << 20, level: int = 3, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """The bundles, with the index of each, as a written table."""
    known = roles(pages, scratch, revisit_bytes, id_col, payload_col)
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    full = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), body.alias("payload"))
    full = full.withColumn("digest", F.sha1("payload"))
    full = full.join(known, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        made = Bundle(frame_bytes, level)

        def done() -> pa.RecordBatch:
            nonlocal number, made
            data = made.finish()
            columns = list(map(list, zip(*made.entries, strict=True)))
            out = pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([data], pa.binary()), pa.array([columns[0]], pa.list_(pa.string())), pa.array([columns[1]], pa.list_(pa.int32())), pa.array([columns[2]], pa.list_(pa.int64())), pa.array([columns[3]], pa.list_(pa.int64()))],
                names=["bundle_id", "data", "ids", "frames", "starts", "lengths"],
            )
            number, made = number + 1, Bundle(frame_bytes, level)
            return out

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(i) for i in range(5)), strict=True):
                body = payload.as_py()
                made.add(str(page_id), record(page_id.as_py(), url.as_py(), body, digest.as_py(), len(body), refers_to.as_py()))
                if made.written >= bundle_bytes:
                    yield done()
        if made.entries:
            yield done()

    return scratch.keep(full.mapInArrow(bundle, BUNDLES), "bundles")


def index(bundles: DataFrame) -> DataFrame:
    """record id, bundle_id, frame, start in the decompressed frame, length."""
    entries = F.explode(F.arrays_zip("ids", "frames", "starts", "lengths")).alias("e")
    return bundles.select("bundle_id", entries).select(F.col("e.ids").alias("record_id"), "bundle_id", F.col("e.frames").alias("frame"), F.col("e.starts").alias("start"), F.col("e.lengths").alias("length"))


def read_records(bundles: DataFrame, *, id_type: str = "long") -> DataFrame:
    """page_id, url, payload (null of a revisit), payload_bytes, payload_digest, record_type, refers_to, read back through the index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                reader = Reader(batch.column(1)[n].as_py())
                rows: list[tuple] = []
                for frame, start, length in zip(*(batch.column(i)[n].as_py() for i in (3, 4, 5)), strict=True):
                    top, http, payload = parse(reader.record(frame, start, length))
                    page = unquote(top["WARC-Record-ID"][len("<urn:page:") : -1])
                    response = top["WARC-Type"] == "response"
                    digest = hashlib.sha1(payload).hexdigest() if response else base64.b32decode(top["WARC-Payload-Digest"][5:]).hex()
                    other = None if response else unquote(top["WARC-Refers-To"][len("<urn:page:") : -1])
                    rows.append((page or None, top["WARC-Target-URI"], payload if response else None, len(payload) if response else int(http["Content-Length"]), digest, top["WARC-Type"], other))
                    if len(rows) >= 500:
                        yield _records(rows)
                        rows = []
                if rows:
                    yield _records(rows)

    found = bundles.mapInArrow(read, "page_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def fetch(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """record_id, data of the wanted record ids: each task decompresses the frames that hold them, no others."""
    places = index(bundles).join(wanted.select(F.col("record_id")).distinct(), "record_id").groupBy("bundle_id").agg(F.sort_array(F.collect_list(F.struct("frame", "start", "length", "record_id"))).alias("places"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, found in zip(batch.column(0), batch.column(1), strict=True):
                reader = Reader(data.as_py())
                for p in found.as_py():
                    yield pa.RecordBatch.from_arrays([pa.array([p["record_id"]]), pa.array([reader.record(p["frame"], p["start"], p["length"])], pa.binary())], names=["record_id", "data"])

    return bundles.select("bundle_id", "data").join(places, "bundle_id").select("data", "places").mapInArrow(read, "record_id string, data binary")


def export(bundles: DataFrame, folder: str) -> DataFrame:
    """Writes each bundle to `folder`/<bundle_id>.warc.zst (any place that pyarrow's file systems reach); file, bytes."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                name, content = f"{base}/{number:016x}.warc.zst", data.as_py()
                with store.open_output_stream(name, compression=None) as out:
                    out.write(content)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(content)], pa.int64())], names=["file", "bytes"])

    return bundles.select("bundle_id", "data").mapInArrow(put, "file string, bytes long")
