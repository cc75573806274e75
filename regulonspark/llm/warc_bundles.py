"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with the records of
some hundred kilobytes, and a skippable frame at the end with the seek table
of the public seekable format (compressed and decompressed size of each frame,
their number, a magic number). An index maps a record's id to its bundle,
frame, and offset and length within the decompressed frame, so a record is
read with two reads and one frame's decompression.

Of records with equal payloads, the one with the smallest id is a ``response``;
the others are ``revisit`` records without a body that name its page, its URL, its
digest, and its length. The comparison is by SHA-1 digest, of narrow rows; payloads
move at most once, to meet the list of repeated digests, and those that very many
pages share are dealt over many tasks.

A record's id is made from its bundle's name and its number there, so that no two
records have the same, whatever their pages have in common.

Bundles are written under a name of their own and renamed when complete; the
index names those that count, so a task that is run again after an executor
was lost leaves at most a file that nobody reads.

Defined results: a null payload is empty; payloads of fewer than ``min_bytes``
bytes are always responses; rows that repeat both id and payload with the
smallest id are all responses; a row without an id is a revisit wherever a row
with an id has its payload, and refers to nothing otherwise; an empty table
gives an empty index and no bundle. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import fresh_path, salted_join, written

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
LEVEL = 3
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public name space for URLs
_DATE = "2026-01-01T00:00:00Z"
INDEX = "page_id {id}, record_id string, bundle string, frame int, offset bigint, length bigint, record_type string"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(bundle: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{bundle} {nth}')}>"


def _text(value) -> str:
    return " ".join(str(value).split())


def make_record(name: str, page_id, url: str | None, payload: bytes, refers_to=None, refers_url: str | None = None, revisit: bool = False) -> bytes:
    """A WARC 1.1 record, with ``name`` for its id and an HTTP response block."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_text(url or '')}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To-Target-URI: {_text(refers_url or '')}",
                 f"X-Refers-To-Page: {'' if refers_to is None else refers_to}"]
    else:
        block += payload
    head += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload (empty for a revisit) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame for (compressed, decompressed) sizes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame."""
    file.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    file.seek(size - 9 - width * count)
    table, at, out = file.read(width * count), 0, []
    for i in range(count):
        packed, plain = struct.unpack_from("<II", table, i * width)
        out.append((at, packed, plain))
        at += packed
    return out


class BundleWriter:
    """Writes one bundle; ``add`` gives a record's (frame, offset, length)."""

    def __init__(self, file, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.file, self.frame_bytes = file, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.held = io.BytesIO()
        self.size = 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        if self.held.tell() and self.held.tell() + len(record) > self.frame_bytes:
            self._flush()
        place = len(self.frames), self.held.tell(), len(record)
        self.held.write(record)
        return place

    def _flush(self) -> None:
        plain = self.held.getvalue()
        packed = self.packer.compress(plain)
        self.file.write(packed)
        self.frames.append((len(packed), len(plain)))
        self.size += len(packed)
        self.held = io.BytesIO()

    def close(self) -> None:
        if self.held.tell():
            self._flush()
        self.file.write(seek_table(self.frames))


class BundleReader:
    """Reads records of one bundle by (frame, offset, length)."""

    def __init__(self, file, size: int):
        self.file = file
        self.frames = read_seek_table(file, size)
        self.unpacker = zstandard.ZstdDecompressor()
        self.last: tuple[int, bytes] = (-1, b"")

    def record(self, frame: int, offset: int, length: int) -> bytes:
        if self.last[0] != frame:
            start, packed, plain = self.frames[frame]
            self.file.seek(start)
            self.last = frame, self.unpacker.decompress(self.file.read(packed), max_output_size=plain)
        return self.last[1][offset : offset + length]


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def marked_pages(pages: DataFrame, *, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, revisit, refers_to, refers_url."""
    base = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
        F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    place = F.struct(F.col("page_id").isNull(), F.col("page_id").alias("refers_to"), F.col("url").alias("refers_url"))
    repeated = written(base.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(
        F.count("*").alias("many"), F.min(place).alias("first")).where("many > 1").select("digest", "many", "first.refers_to", "first.refers_url"), "warc-digests")
    met = salted_join(base, repeated, ["digest"], ["page_id", "url"], pages.count())
    revisit = F.col("refers_to").isNotNull() & ~F.col("refers_to").eqNullSafe(F.col("page_id"))
    return met.select("page_id", "url", "payload", revisit.alias("revisit"), *(F.when(revisit, F.col(c)).alias(c) for c in ("refers_to", "refers_url")))


def write_bundles(
    pages: DataFrame, folder: str | None = None, *, min_bytes: int = 0, frame_bytes: int = FRAME_BYTES,
    bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL, **cols,
) -> DataFrame:
    """Writes all rows as records and returns the index, itself a written table.

    ``folder`` is one that all executors can write to (the shared folder if not given).
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")
    kind = pages.schema[cols.get("id_col", "page_id")].dataType.simpleString()
    schema = INDEX.format(id=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _place(folder)
        writer, temp, final, rows = None, "", "", []

        def finish() -> pa.RecordBatch:
            nonlocal writer, rows
            writer.close()
            writer.file.close()
            fs.move(temp, final)
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(c)) if i else pa.array(list(c), ids) for i, c in enumerate(zip(*rows))],
                names=["page_id", "record_id", "bundle", "frame", "offset", "length", "record_type"])
            writer, rows = None, []
            return out.set_column(3, "frame", out.column(3).cast(pa.int32()))

        ids = None
        for batch in batches:
            ids = batch.schema.field("page_id").type
            for lo in range(0, batch.num_rows, 64):
                for row in batch.slice(lo, 64).to_pylist():
                    if writer is None:
                        fs.create_dir(root, recursive=True)
                        name = uuid.uuid4().hex
                        temp, final = f"{root}/.{name}.part", f"{root}/{name}.warc.zst"
                        writer = BundleWriter(fs.open_output_stream(temp), frame_bytes, level)
                    rid = record_id(name, len(rows))
                    data = make_record(rid, row["page_id"], row["url"], row["payload"], row["refers_to"], row["refers_url"], row["revisit"])
                    rows.append((row["page_id"], rid, f"{folder}/{final.rpartition('/')[2]}", *writer.add(data),
                                 "revisit" if row["revisit"] else "response"))
                    if writer.size >= bundle_bytes:
                        yield finish()
        if writer is not None:
            yield finish()

    return written(marked_pages(pages, min_bytes=min_bytes, **cols).mapInArrow(run, schema), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """Every record of an index read back: page_id, payload_bytes, payload_digest, record_type, refers_to, intact.

    ``intact`` is whether a response's body has the length and digest that its header states.
    """
    kind = index.schema["page_id"].dataType.simpleString()
    whole = kind in ("bigint", "int", "smallint", "tinyint")
    schema = f"page_id {kind}, payload_bytes bigint, payload_digest string, record_type string, refers_to {kind}, intact boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, opened = None, None
        for batch in batches:
            ids = batch.schema.field("page_id").type
            rows = []
            for x in batch.to_pylist():
                if x["bundle"] != opened:
                    fs, path = _place(x["bundle"])
                    reader = BundleReader(fs.open_input_file(path), fs.get_file_info(path).size)
                    opened = x["bundle"]
                fields, body = parse_record(reader.record(x["frame"], x["offset"], x["length"]))
                digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                response = fields["WARC-Type"] == "response"
                if response:
                    found = payload_digest(body), len(body)
                    intact = found == (digest, size)
                    digest, size = found
                else:
                    intact = True
                to = fields.get("X-Refers-To-Page") or None
                own = fields["X-Page-ID"] or None
                rows.append((int(own) if whole and own else own, size, digest, fields["WARC-Type"],
                             int(to) if whole and to else to, intact))
            if rows:
                kinds = [ids, pa.int64(), pa.string(), pa.string(), ids, pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"])

    return index.mapInArrow(run, schema)
