"""Operator 2: interleaved document sequences with media columns.

``parse`` turns HTML into an ordered sequence of structs: text blocks and media references, each
with its position; a reference has its source, the digest that this names (null if it names none,
as an ordinary address does) and its caption (the figure's caption, else the alternative text). ``store`` writes payloads as lossless 8-bit greyscale PNG images of 64
samples a row into a content-addressed table, named by the payload's SHA-256. ``resolve`` joins
references to stored media by digest; positions and captions stay aligned, as a sequence is taken
apart into rows that carry their position.

Scale. Payloads are never shuffled: each writing task keeps one copy per digest, and readers reduce
what they compute to one small row per digest before any join. So a payload that a third of all
documents share is one row on the media side. These rows are cut off from their aggregation, so
that both sides of the join are dealt for it alone and Spark may split a digest's references.
``resolve`` joins such small rows by default, or the media themselves if asked to.

Defined results: null texts are empty, empty payloads are 64 zero bytes; null html is an empty
sequence; references to unknown digests stay, with null media columns; unclosed and unknown tags are
tolerated, and scripts, styles and comments are no text; null and repeated ids are kept; a
very long text is held by one task with its image; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched, cut, written

WIDTH = 64
PNG = b"\x89PNG\r\n\x1a\n"
ITEM = "struct<position:int,kind:string,text:string,digest:string,caption:string,source:string>"
DIGEST = re.compile(r"(?:^|[:/])([0-9a-f]{64})(?:\.\w+)?$", re.I)
BLOCKS = frozenset("p div br h1 h2 h3 h4 h5 h6 li ul ol table tr td th section article header footer nav blockquote pre hr title main aside".split())
SILENT = frozenset(("script", "style", "template", "noscript"))
MEDIA = frozenset(("img", "video", "audio", "source", "embed"))


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def to_png(data: bytes) -> bytes:
    """``data``, a positive multiple of 64 bytes, as the samples of a greyscale image."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with its filter, 0
    lines[:, 1:] = rows

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))

    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of an image that ``to_png`` wrote; checks its chunks."""
    if image[:8] != PNG:
        raise ValueError("not a PNG image")
    at, packed, height = 8, [], 0
    while at < len(image):
        n, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("a chunk's check sum is wrong")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", body)
            if (width, depth, colour) != (WIDTH, 8, 0):
                raise ValueError("not an image of this store")
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("a line has a filter")
    return lines[:, 1:].tobytes()


def features(samples: bytes) -> str:
    """Size, mean, deviation, entropy and mean step between neighbours."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    values, share = np.arange(256), counts[counts > 0] / len(x)
    total, squares = int((counts * values).sum()), int((counts * values * values).sum())
    mean = total / len(x)
    deviation = max(0.0, squares / len(x) - mean * mean) ** 0.5
    steps = int(np.abs(np.diff(x.reshape(-1, WIDTH).astype(np.int16), axis=1)).sum(dtype=np.int64)) / (len(x) // WIDTH * (WIDTH - 1))
    return f"{WIDTH}x{len(x) // WIDTH};mean={mean:.4f};deviation={deviation:.4f};entropy={abs(float((share * np.log2(share)).sum())):.4f};step={steps:.4f}"


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.silent = 0
        self.figure: list[int] | None = None
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "digest": None, "caption": None, "source": None})

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        elif tag == "figure":
            self.flush()
            self.figure = []
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in MEDIA:
            a = dict(attrs)
            found = DIGEST.search(a.get("data-digest") or "") or DIGEST.search(a.get("src") or "")
            if a.get("src") or found:  # a video whose sources are tags of their own has none itself
                self.flush()
                if self.figure is not None:
                    self.figure.append(len(self.items))
                self.items.append({"position": len(self.items), "kind": "media", "text": None, "digest": found and found[1].lower(), "caption": a.get("alt") or None, "source": a.get("src") or None})
        elif tag in BLOCKS:
            self.flush()

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for i in self.figure or []:
                self.items[i]["caption"] = text or self.items[i]["caption"]
            if not self.figure and text:
                self.text.append(text)
            self.caption = None
        elif tag == "figure":
            self.flush()
            self.figure = None
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def sequence(html: str | None) -> list[dict]:
    p = _Sequence()
    p.feed(html or "")
    p.close()
    if p.caption is not None:
        p.handle_endtag("figcaption")
    p.flush()
    return p.items


def parse(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key and ``items``, the ordered sequence of ``ITEM`` structs of each row's HTML."""
    kind = pa.list_(pa.struct([("position", pa.int32()), *((c, pa.string()) for c in ("kind", "text", "digest", "caption", "source"))]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sequence(x.as_py()) for x in b.column(1)], kind)], names=[key, "items"])

    return batched(df.select(df[key], df[html].cast("string"))).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, items array<{ITEM}>")


def references(parsed: DataFrame, key: str) -> DataFrame:
    """One row per media reference: key, position, digest, caption, source."""
    items = parsed.select(key, F.explode(F.filter("items", lambda x: x["kind"] == "media")).alias("item"))
    return items.select(key, "item.position", "item.digest", "item.caption", "item.source")


def store(df: DataFrame, text: str = "text", name: str = "media") -> DataFrame:
    """The table (digest, n_bytes, media) of the payloads of ``text``, written to the shared folder.
    A digest may occur once per writing task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            digests, sizes, media = [], [], []

            def batch() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["digest", "n_bytes", "media"])

            held = 0
            for x in b.column(0):
                raw = (x.as_py() or "").encode()
                data = payload(x.as_py())
                d = hashlib.sha256(data).digest()
                # a text and the same with zero bytes after it share a payload, not their length
                if (mark := d[:16] + len(raw).to_bytes(8, "little")) in seen:
                    continue
                seen.add(mark)
                digests.append(d.hex())
                sizes.append(len(raw))
                media.append(to_png(data))
                held += len(media[-1])
                if held > 16_000_000:
                    yield batch()
                    digests, sizes, media, held = [], [], [], 0
            yield batch()

    return written(batched(df.select(df[text].cast("string"))).mapInArrow(run, "digest string, n_bytes long, media binary"), name)


def read_back(media: DataFrame) -> DataFrame:
    """One row per digest: what the stored bytes give when they are read."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, m in zip(b.column(0).to_pylist(), b.column(1)):
                image = m.as_py()
                data = from_png(image)
                out.append((d, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), features(data)))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)

    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return batched(media.select("digest", "media")).mapInArrow(run, schema).groupBy("digest").agg(*(F.min(c).alias(c) for c in names[1:]))


def resolve(refs: DataFrame, media: DataFrame) -> DataFrame:
    """``refs`` with the columns of ``media`` (one row per digest), null where there is none."""
    clash = [c for c in media.columns if c != "digest" and c in refs.columns]
    return refs.drop(*clash).join(media, "digest", "left")


def page_of(text: Column, caption: Column) -> Column:
    """An HTML page that shows a text's payload as a figure."""
    raw = F.encode(F.coalesce(text, F.lit("")), "utf-8")
    n = F.octet_length(raw)
    zeros = F.when(n == 0, WIDTH).otherwise(F.pmod(-n, F.lit(WIDTH)))
    padded = F.concat(raw, F.encode(F.repeat(F.lit("\0"), zeros), "utf-8"))
    return F.concat(F.lit('<article><p>Payload</p><figure><img src="media:'), F.sha2(padded, 256), F.lit('.png"><figcaption>'), caption, F.lit("</figcaption></figure></article>"))


def document_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text as a stored image, found again by way of the page that refers to it."""
    texts = df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    size = F.coalesce(F.octet_length("__text"), F.lit(0)).cast("long").cast("string")
    pages = texts.select("__key", page_of(F.col("__text"), size).alias("html"))
    refs = references(parse(pages, "__key"), "__key")
    found = resolve(refs, cut(read_back(store(texts, "__text"))))
    return found.select(
        F.col("__key").alias(key), F.col("caption").cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position"
    )
