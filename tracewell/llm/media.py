"""Interleaved document sequences with media columns.

HTML is parsed to an ordered list of text items and media references with their captions; the
references are joined by digest to a media table, and keep their positions. Media are 8-bit
grey images, stored as PNG; a text's bytes can be stored as one and read back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, small_batches, stage

#: Width of an image, and bytes of which a payload's length is a multiple.
WIDTH, UNIT = 24, 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pad(raw: bytes) -> bytes:
    """Bytes 255 up to the next positive multiple of UNIT."""
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def to_png(samples: bytes, width: int = WIDTH) -> bytes:
    """A grey 8-bit PNG of rows of ``width`` samples."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)
    lines[:, 1:] = rows
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes(), 6)) + part(b"IEND", b"")


def from_png(png: bytes) -> tuple[int, int, bytes]:
    """Width, height and samples of an image that to_png wrote."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, width, height = 8, b"", 0, 0
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            width, height = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)
    return width, height, lines[:, 1:].tobytes()


def feature(width: int, height: int, samples: bytes) -> str:
    """Size, mean, deviation and an average hash over 8 x 8 cells of an image."""
    grid = np.frombuffer(samples, np.uint8).reshape(height, width).astype(np.float64)
    rows = np.add.reduceat(grid, np.arange(8) * height // 8, axis=0)
    cells = np.add.reduceat(rows, np.arange(8) * width // 8, axis=1)
    cells /= np.outer(np.diff(np.append(np.arange(8) * height // 8, height)), np.diff(np.append(np.arange(8) * width // 8, width)))
    bits = "".join("1" if x else "0" for x in (cells > cells.mean()).ravel())
    return f"{width}x{height} mean {grid.mean():.6f} deviation {grid.std():.6f} hash {int(bits, 2):016x}"


class Sequence(HTMLParser):
    """Text and media items of one page in order. Scripts, styles and comments are left out;
    a caption is a figure's figcaption, else the alternative text."""

    BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol table tr article section nav header footer blockquote pre figure figcaption title br".split())
    MEDIA = frozenset(("img", "video", "audio", "source"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.text: list[str] = []
        self.hidden, self.caption, self.figure = 0, None, None

    def flush(self):
        text = "".join(self.text)
        self.text.clear()
        if text.strip():
            self.items.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in self.MEDIA and (source := dict(attrs).get("src")):
            self.flush()
            self.items.append(["media", None, source, dict(attrs).get("alt")])
        elif tag in self.BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = len(self.items)
            elif tag == "figcaption":
                self.caption = []

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            text, self.caption = "".join(self.caption).strip(), None
            for item in self.items[self.figure or 0 :]:
                if item[0] == "media" and self.figure is not None:
                    item[3] = text
        elif tag in self.BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data):
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[list]:
    reader = Sequence()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return reader.items


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, position, kind, text, digest, caption): the items of every page, in order from 0.

    A media item's digest is what follows "media:" in its source, else its source. Null, empty
    and item-less pages have no rows. Pages that repeat, or share an id, give their items each.
    """
    small_batches(pages.sparkSession)

    def start():
        def work(ids, htmls):
            out = {k: [] for k in ("id", "position", "kind", "text", "digest", "caption")}
            for i, html in zip(ids, htmls, strict=True):
                for at, (kind, text, source, caption) in enumerate(parse(html)):
                    for k, v in zip(out, (i, at, kind, text, source.removeprefix("media:") if source else None, caption), strict=True):
                        out[k].append(v)
            return out

        return work

    items = map_rows(pages, [id_col, html_col], "id long, position int, kind string, text string, digest string, caption string", start, rows=100)
    return items.withColumnRenamed("id", id_col)


def read_media(media: DataFrame) -> DataFrame:
    """(digest, payload_sha256, payload_bytes, tail_crc32, media_bytes, media_sha256, feature) of
    each digest, from the stored bytes. Media that can't be read have null features."""
    ddl = "digest string, payload_sha256 string, payload_bytes long, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def start():
        def work(digests, stored):
            out = {k.split()[0]: [] for k in ddl.split(", ")}
            for digest, png in zip(digests, stored, strict=True):
                try:
                    width, height, samples = from_png(png or b"")
                    seen = (hashlib.sha256(samples).hexdigest(), len(samples), zlib.crc32(samples[-32:]))
                    last = feature(width, height, samples)
                except (ValueError, zlib.error, struct.error):
                    seen, last = (None, None, None), None
                row = (digest, *seen, len(png or b""), hashlib.sha256(png or b"").hexdigest(), last)
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            return out

        return work

    found = map_rows(media, ["digest", "media"], ddl, start, rows=200)
    rest = [c.split()[0] for c in ddl.split(", ")][1:]
    one = found.where("digest is not null").groupBy("digest").agg(F.min(F.struct(*rest)).alias("m"))
    return one.select("digest", *[F.col(f"m.{c}").alias(c) for c in rest])


def resolve(items: DataFrame, media: DataFrame) -> DataFrame:
    """The items with what their digests resolve to; text items and unknown digests keep nulls.

    Only digests and features move: the payloads are read where they are stored.
    """
    return items.join(read_media(media), "digest", "left")


def store_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest, media): every text's padded bytes as an image, written in the shared folder and
    read again. Null texts count as empty; equal texts have one digest and equal images."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))

    def start():
        def work(digests, raws):
            return {"digest": digests, "media": [to_png(pad(raw)) for raw in raws]}

        return work

    return stage(map_rows(docs.select(F.sha2(text, 256).alias("digest"), text.cast("binary").alias("raw")), ["digest", "raw"], "digest string, media binary", start, rows=200), "media")


def document_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A page for every document: its text, then a figure that refers to its stored image."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(F.lit("<article><p>"), safe, F.lit('</p><figure><img src="media:'), F.sha2(text, 256), F.lit('"><figcaption>bytes '), F.octet_length(text), F.lit("</figcaption></figure></article>"))
    return docs.select(id_col, html.alias("html"))
