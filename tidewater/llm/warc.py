"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent frames, so that any frame can be decompressed alone. A bundle ends with a
seek table in a skippable frame, which gives every frame's place; the index gives for each record its bundle,
frame and offset in the decompressed frame. Bundles are written by the executors to a shared folder, each under a
temporary name that becomes its final one when it is whole. The name tells the attempt: the index names only bundles of
attempts that ended, so those of a repeated or lost task are never read."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.spread import joined
from tidewater.storage import new_path, written

#: Bytes of records in a frame before compression, and of frames in a bundle, about.
FRAME, BUNDLE = 1 << 18, 1 << 26
#: Bytes from which equal payloads are stored once.
LEAST_REVISIT = 100
#: Fixed values of the seekable format: magic numbers of skippable frames and of the footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
RECORD = pa.schema([("id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload", pa.binary())])


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP header alone and the size of the payload it stands for."""
    block = HTTP if refers_to is not None else HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%-._~"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record; the digest of a stored payload is computed and must be the one that it names."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(field["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where it says")
    payload, size, digest = block.partition(b"\r\n\r\n")[2], int(field["X-Payload-Length"]), field["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = field["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload is not what its record names")
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    refers = field.get("WARC-Refers-To")
    return {"id": number(field["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(refers) if refers else None, "target_uri": field.get("WARC-Target-URI"), "payload": payload if kind == "response" else None}


class Bundle:
    """A bundle being written."""

    def __init__(self, folder: str, name: str):
        self.fs, root = file_system(folder)
        self.fs.create_dir(root, recursive=True)
        self.name, self.path, self.temporary = name, f"{root}/{name}", f"{root}/.{name}"
        self.out = self.fs.open_output_stream(self.temporary, compression=None)  # the name ends like one to compress
        self.frames: list[tuple[int, int]] = []
        self.held, self.held_bytes, self.size = [], 0, 0
        self.compressor = zstandard.ZstdCompressor(level=3)

    def add(self, data: bytes) -> tuple[int, int]:
        """The frame and the offset in it where the record will be."""
        place = len(self.frames), self.held_bytes
        self.held.append(data)
        self.held_bytes += len(data)
        if self.held_bytes >= FRAME:
            self.flush()
        return place

    def flush(self) -> None:
        if self.held:
            data = self.compressor.compress(b"".join(self.held))
            self.out.write(data)
            self.frames.append((len(data), self.held_bytes))
            self.size += len(data)
            self.held, self.held_bytes = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        self.fs.move(self.temporary, self.path)


def seek_table(f: pa.NativeFile) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of each frame, from a bundle's footer."""
    size = f.size()
    f.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table")
    f.seek(size - 9 - 8 * n)
    out, at = [], 0
    for small, large in struct.iter_unpack("<II", f.read(8 * n)):
        out.append((at, small, large))
        at += small
    return out


def write(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for each row of pages to bundles in folder; returns the index (id, row, bundle, frame, offset, length).

    Null html counts as empty. Of rows with equal payloads of LEAST_REVISIT bytes or more, those with the smallest
    id are responses and the others revisits of it; all shorter ones are responses, and so are rows whose
    payload no row with an id has. Rows that repeat an id have records of their own. An empty table gives an empty index;
    other columns are ignored."""
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    first = base.where(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    first = written(first.where("copies > 1 and first is not null"), "first-payloads")
    rows = joined(base, first, ["digest"], F.xxhash64("id", "url"), how="left")
    refers = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, bundle, made, n = TaskContext.get(), None, 0, 0
        for b in batches:
            out: dict[str, list] = {k: [] for k in INDEX.names}
            for page, url, html, digest, ref in zip(*(b.column(c).to_pylist() for c in ("id", "url", "html", "digest", "refers"))):
                if bundle is None:
                    bundle = Bundle(folder, f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{made:04d}.warc.zst")
                data = record(page, url, html.encode(), digest, ref, date)
                frame, offset = bundle.add(data)
                for name, value in zip(INDEX.names, (page, n, bundle.name, frame, offset, len(data))):
                    out[name].append(value)
                n += 1
                if bundle.size >= BUNDLE:
                    bundle.close()
                    bundle, made = None, made + 1
            yield pa.RecordBatch.from_pydict(out, schema=INDEX)
        if bundle is not None:
            bundle.close()

    index = rows.select("id", "url", "html", "digest", refers.alias("refers")).mapInArrow(run, "id long, row long, bundle string, frame int, offset long, length long")
    return written(index, "warc-index")


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that index names, each read from its frame: id, payload_bytes, payload_digest, record_type,
    refers_to, target_uri and, if asked for, payload (null for revisits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        name, number, f, table, frame = None, None, None, [], b""
        for b in batches:
            out = []
            for bundle, k, offset, length in zip(*(b.column(c).to_pylist() for c in ("bundle", "frame", "offset", "length"))):
                if bundle != name:
                    if f is not None:
                        f.close()
                    f = fs.open_input_file(f"{root}/{bundle}")
                    name, number, table = bundle, None, seek_table(f)
                if k != number:
                    at, small, large = table[k]
                    f.seek(at)
                    frame, number = zstandard.ZstdDecompressor().decompress(f.read(small), max_output_size=large), k
                out.append(parse(frame[offset : offset + length]))
                if not payloads:
                    out[-1]["payload"] = None
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, schema=RECORD)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema=RECORD)

    # a bundle is opened, and its seek table read, by one task; bundles end at BUNDLE bytes
    by_place = index.repartition("bundle").sortWithinPartitions("bundle", "frame", "offset")
    schema = "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary"
    return by_place.select("bundle", "frame", "offset", "length").mapInArrow(run, schema)


def new_archive(spark: SparkSession) -> str:
    return new_path(spark, "warc")
