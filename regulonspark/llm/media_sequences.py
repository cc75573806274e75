"""Interleaved document sequences with media columns.

HTML is parsed into an ordered array of structs: text blocks and references to
media, each with its position, a reference with its digest and caption. Media
lie in a table of their own, one binary column of losslessly coded 8-bit
samples (PNG, RGB, 64 pixels wide) with the digest of their samples as key; a
join on the digest resolves the references of the sequences, whose positions
and captions stay with them.

Digests are joined with the few columns that a caller asks for, computed next
to the stored bytes, so payloads are not shuffled unless asked for; equal
media are one row before the join.

Defined results: null HTML or text is empty; HTML that is not well formed is
read as browsers' tokenizers do, unclosed elements end with the document;
script and style contents are no text; a reference that the media table does
not have keeps its place with null media columns; repeated rows stay; an empty
table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import salted_join, written

#: Samples of a pixel row (64 pixels of three bytes): payloads are padded to a multiple.
ROW = 192
PAD = b" "
LEVEL = 1
_SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value of the format

ITEM = "struct<pos:int,kind:string,text:string,ref:string,caption:string>"
_BLOCKS = frozenset(
    "address article aside blockquote body caption dd details div dl dt figure figcaption footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul br".split())
_SILENT = frozenset(("script", "style", "template", "noscript"))
_MEDIA = frozenset(("img", "audio", "video", "source", "embed", "object"))


class _Sequence(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.silent = 0
        self.figures: list[tuple[list[int], list[str]]] = []  # of each open figure, its media and captions
        self.caption: list[str] | None = None

    def end_block(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"pos": len(self.items), "kind": "text", "text": text, "ref": None, "caption": None})

    def end_caption(self) -> None:
        if self.caption is None:
            return
        text, self.caption = " ".join("".join(self.caption).split()), None
        if self.figures:
            self.figures[-1][1].append(text)
        else:
            self.words.append(text)
            self.end_block()

    def end_figure(self) -> None:
        self.end_caption()
        self.end_block()
        media, captions = self.figures.pop()
        text = " ".join(filter(None, captions))
        if text and not media:
            self.words.append(text)
            self.end_block()
        for at in media if text else ():
            self.items[at]["caption"] = text

    def end(self) -> list[dict]:
        while self.figures:
            self.end_figure()
        self.end_caption()
        self.end_block()
        return self.items

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SILENT:
            self.silent += 1
        if tag in _MEDIA:
            named = dict(attrs)
            if ref := named.get("src") or named.get("data"):
                self.end_block()
                if self.figures:
                    self.figures[-1][0].append(len(self.items))
                self.items.append({"pos": len(self.items), "kind": "media", "text": None, "ref": ref, "caption": named.get("alt")})
        elif tag == "figcaption":
            self.end_caption()
            self.end_block()
            self.caption = []
        elif tag in _BLOCKS:
            if tag == "figure":
                self.end_caption()
            self.end_block()
            if self.caption is not None:
                self.caption.append(" ")
            if tag == "figure":
                self.figures.append(([], []))

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure":
            if self.figures:
                self.end_figure()
        elif tag in _BLOCKS:
            self.end_block()
            if self.caption is not None:
                self.caption.append(" ")

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.words if self.caption is None else self.caption).append(data)


def parse_html(html: str | None) -> list[dict]:
    """The ordered items of a page; a figure's caption, wherever it stands in it, goes to all its media.

    A caption without media is text; one that is not closed ends with its figure.
    """
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    return parser.end()


def sequences(pages: DataFrame, *, id_col: str, html_col: str = "html") -> DataFrame:
    """id_col, items: the interleaved sequence of each page."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                items = pa.array([parse_html(h) for h in part.column(1).to_pylist()], pa.list_(item))
                yield pa.RecordBatch.from_arrays([part.column(0), items], names=[id_col, "items"])

    return pages.select(id_col, html_col).mapInArrow(run, f"{id_col} {kind}, items array<{ITEM}>")


def encode_png(samples: bytes, level: int = LEVEL) -> bytes:
    """A PNG of 8-bit RGB samples, 64 pixels wide; their number is a positive multiple of 192."""
    height = len(samples) // ROW
    if not height or height * ROW != len(samples):
        raise ValueError("samples must fill whole rows")

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.zeros((height, ROW + 1), np.uint8)  # each row starts with its filter, 0
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(height, ROW)
    return (_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW // 3, height, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b""))


def decode_png(png: bytes) -> bytes:
    """The samples of a PNG that :func:`encode_png` wrote; checksums are verified."""
    if png[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, data, height = 8, [], 0
    while at < len(png):
        (size,) = struct.unpack_from(">I", png, at)
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", png, at + 8 + size)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if width * 3 != ROW or form != [8, 2, 0, 0, 0]:
                raise ValueError("another kind of PNG")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, ROW + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 with blanks up to a positive multiple of 192, and its length without them."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + PAD * (-len(data) % ROW if data else ROW), len(data)


def feature_of(samples: bytes) -> str:
    """Size, channel means in thousandths, and a 64-bit hash of bands brighter than the whole."""
    pixels = np.frombuffer(samples, np.uint8).reshape(-1, 3)
    total = pixels.sum(0, dtype=np.int64)
    edges = np.linspace(0, len(pixels), 65).astype(np.int64)
    sums = np.concatenate([[0], pixels.sum(1, dtype=np.int64).cumsum()])
    part, size = sums[edges[1:]] - sums[edges[:-1]], edges[1:] - edges[:-1]
    bits = part * len(pixels) > int(total.sum()) * size
    means = ",".join(str(int(t) * 1000 // len(pixels)) for t in total)
    return f"64x{len(pixels) // 64}:{means}:{int(np.packbits(bits).view('>u8')[0]):016x}"


def store_media(docs: DataFrame) -> DataFrame:
    """A written table of doc_id, html, digest, media: each text's payload as a PNG, and a page that refers to it."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                rows = []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    samples, n = payload_of(text)
                    digest = hashlib.sha256(samples).hexdigest()
                    page = (f"<article><h1>Document {html_lib.escape(str(i))}</h1><figure><img src=\"sha256:{digest}\" alt=\"samples\">"
                            f"<figcaption>{n} bytes</figcaption></figure></article>")
                    rows.append((page, digest, encode_png(samples)))
                page, digest, media = map(list, zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(page), pa.array(digest), pa.array(media, pa.binary())],
                    names=["doc_id", "html", "digest", "media"])

    return written(docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, html string, digest string, media binary"), "media")


def describe_media(media: DataFrame) -> DataFrame:
    """digest and what the stored bytes say of themselves, one row per digest, and many: how often it is stored."""
    schema = ("digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, "
              "media_sha256 string, feature string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part, rows = batch.slice(lo, 64), []
                for digest, stored in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    samples = decode_png(stored)
                    rows.append((digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]),
                                 len(stored), hashlib.sha256(stored).hexdigest(), feature_of(samples)))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    found = media.select("digest", "media").mapInArrow(run, schema)
    return found.groupBy("digest").agg(*[F.first(c).alias(c) for c in found.columns[1:]], F.count("*").alias("many"))


def resolve(pages: DataFrame, media: DataFrame, *, id_col: str, total: int | None = None) -> DataFrame:
    """id_col, pos, caption, digest and the columns of ``media`` (unique in digest) for every media reference.

    With ``total``, ``media`` is a written table whose column ``many`` says how many of the
    ``total`` references have the digest; those of very many are dealt over tasks.
    """
    refs = pages.select(id_col, F.explode("items").alias("_item")).where("_item.kind = 'media'").select(
        id_col, F.col("_item.pos").alias("pos"), F.col("_item.caption").alias("caption"),
        F.regexp_replace("_item.ref", "^sha256:", "").alias("digest"))
    return refs.join(media, "digest", "left") if total is None else salted_join(refs, media, ["digest"], [id_col, "pos"], total)


def document_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature per row of ``docs``."""
    stored = store_media(docs)
    described = written(describe_media(stored), "media-features")
    found = resolve(sequences(stored, id_col="doc_id"), described, id_col="doc_id", total=stored.count())
    return found.select(
        "doc_id", F.regexp_extract("caption", r"^(\d+)", 1).cast("long").alias("n_bytes"), "payload_bytes",
        "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")
