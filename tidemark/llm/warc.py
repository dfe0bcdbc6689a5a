"""WARC archives as seekable Zstandard bundles: independent frames, a seek table at the end, an index of records."""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, materialise, new_folder

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # magic numbers of the seekable format
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, bundle string, frame long, record_start long, record_bytes long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    told = (urn or "").strip("<>").rpartition(":")[2]
    return int(told) if told not in ("", "null") else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response with its HTTP head and payload, or a revisit that has the head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join(c for c in url or "" if c.isprintable())
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Type, id, digest, payload length and reference of a record; a response's payload is measured and hashed anew."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in x)
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        if digest(payload) != told:
            raise ValueError(f"record {fields['WARC-Record-ID']} has another digest than it says")
        n = len(payload)
    else:
        n = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")).split(": ")[1])
    return {"page_id": _page(fields["WARC-Record-ID"]), "payload_bytes": n, "payload_digest": told, "record_type": kind, "refers_to": _page(fields.get("WARC-Refers-To")), "payload": payload if kind == "response" else None}


class BundleWriter:
    """One file: frames of about `frame` bytes of whole records (a longer record is a frame of its own), then the seek table."""

    def __init__(self, path: str, frame: int, level: int = 3):
        fs, at = pafs.FileSystem.from_uri(path)
        self.path, self.frame, self.out = path, frame, fs.open_output_stream(at, compression=None)
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.size, self.open, self.held, self.index = 0, bytearray(), [], []

    def add(self, page_id: int | None, data: bytes) -> None:
        if self.open and len(self.open) + len(data) > self.frame:
            self.flush()
        self.held.append((page_id, len(self.open), len(data)))
        self.open += data

    def flush(self) -> None:
        if not self.open:
            return
        packed = self.packer.compress(bytes(self.open))
        self.out.write(packed)
        self.index += [(p, self.path, len(self.frames), a, n) for p, a, n in self.held]
        self.frames.append((len(packed), len(self.open)))
        self.size += len(packed)
        self.open, self.held = bytearray(), []

    def close(self) -> list[tuple]:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        return self.index


def seek_table(tail: bytes) -> list[tuple[int, int]]:
    """(packed, unpacked) bytes of each frame, from the end of a bundle."""
    n, _, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    return [struct.unpack_from("<II", tail, len(tail) - 9 - 8 * (n - i)) for i in range(n)]


class BundleReader:
    """Records of one bundle: the footer's seek table tells where frames start, and only the frame asked for is read."""

    def __init__(self, path: str):
        fs, at = pafs.FileSystem.from_uri(path)
        self.file, self.held, self.data = fs.open_input_file(at), None, b""
        size = self.file.size()
        self.file.seek(size - 9)
        frames = struct.unpack("<IBI", self.file.read(9))[0]
        self.file.seek(size - 9 - 8 * frames)
        self.packed = [p for p, _ in seek_table(self.file.read())]
        self.starts = [0, *itertools.accumulate(self.packed)]

    def record(self, frame: int, start: int, size: int) -> bytes:
        if frame != self.held:
            self.file.seek(self.starts[frame])
            self.data, self.held = zstandard.ZstdDecompressor().decompress(self.file.read(self.packed[frame])), frame
        return self.data[start : start + size]


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 5
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["page_id", "bundle", "frame", "record_start", "record_bytes"])


def write(pages: DataFrame, folder: str, least: int = 0, frame: int = 1 << 20, bundle: int = 256 << 20) -> DataFrame:
    """Write all pages below `folder`, which all executors reach, and return the index of the records.

    Of payloads that are equal and have `least` bytes or more, that of the largest page_id is a response (all rows
    of that page_id, if it repeats) and the others refer to it; null page_ids come last and are written as `null`.
    A task writes files of about `bundle` bytes under names of its attempt; the index, written by Spark when all
    tasks have ended, names those of the attempts that count, so a repeated task does no harm.
    """
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload")).withColumn("key", F.unhex(F.sha2("payload", 256)))
    facts = materialise(rows.where(F.octet_length("payload") >= least).groupBy("key").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")), "payloads")
    told = attach(rows, facts.withColumn("known", F.lit(True)), ["key"], "n", F.col("page_id"))
    revisit = F.coalesce(F.col("known") & F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            for i in range(b.num_rows):
                page_id, url, payload, keeper, again = (b.column(k)[i].as_py() for k in range(5))
                if out is None:
                    out = BundleWriter(f"{folder}/{uuid.uuid4().hex}.warc.zst", frame)
                out.add(page_id, record(page_id, url, payload, keeper if again else None, again))
                if out.size >= bundle:
                    yield _index_batch(out.close())
                    out = None
        if out is not None:
            yield _index_batch(out.close())

    return materialise(told.select("page_id", "url", "payload", "keeper", revisit.alias("again")).mapInArrow(run, INDEX), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record, read from its frame of its bundle."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = bundle = None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["bundle"] != path:
                    path, bundle = r["bundle"], BundleReader(r["bundle"])
                out.append(parse(bundle.record(r["frame"], r["record_start"], r["record_bytes"])))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], k) for n, k in zip(names, kinds)], names=names)

    return index.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write pages and read them back. Null html is an empty payload, null urls are empty, an empty table writes nothing.

    Only page_id, url and html are read. A page_id that repeats has a record per row.
    """
    at = new_folder(pages.sparkSession, "warc") if folder is None else folder if "://" in folder else f"file://{folder}"
    fs, name = pafs.FileSystem.from_uri(at)
    fs.create_dir(name, recursive=True)
    return read(write(pages, at, least))
