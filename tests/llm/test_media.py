import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from starlode.llm import media
from starlode.llm.queries import op2_media


def padded(text):
    raw = (text or "").encode()
    out = raw + b"\0" * (-len(raw) % 64)
    return raw, out or bytes(64)


def samples(image: bytes) -> tuple[int, int, bytes]:
    """Width, height and samples of a greyscale PNG, by the format's rules."""
    at, data = 8, b""
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        body = image[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]
        if kind == b"IHDR":
            width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", body)
            assert (depth, colour, rest) == (8, 0, [0, 0, 0])
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    rows = zlib.decompress(data)
    return width, height, b"".join(rows[i + 1 : i + 1 + width] for i in range(0, len(rows), width + 1))


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=300))
def test_png_round_trip(text):
    raw, data = padded(text)
    assert media.payload(text) == data
    image = media.to_png(data)
    width, height, out = samples(image)
    assert (width, height, out) == (64, len(data) // 64, data)
    assert media.from_png(image) == data


def test_broken_images_are_refused():
    image = bytearray(media.to_png(bytes(128)))
    image[45] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(image))
    with pytest.raises(ValueError, match="not a PNG"):
        media.from_png(b"GIF89a")


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        raw, data = padded(texts[r.doc_id])
        image = media.to_png(data)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(data), hashlib.sha256(data).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(data[-64:]), len(image), hashlib.sha256(image).hexdigest())
        assert r.feature == media.features(data) and r.feature.startswith(f"64x{len(data) // 64};")


def test_query_equals_plain_python(spark, sf):
    check(op2_media(spark, sf).collect(), {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()})


def test_odd_rows(spark):
    texts = {1: None, 2: "", 3: "a" * 64, 4: "a" * 65, 5: "é　\U0001f600", 6: "a", 7: "a\0", 8: "x<img src='media:'>&amp;</figure>\n" * 9000, 9: "a" * 64}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").select("*", *(F.lit("z").alias(c) for c in ("digest", "caption", "position", "media", "html", "feature")))
    rows = media.document_media(df).collect()
    check(rows, texts)
    by = {r.doc_id: r for r in rows}
    assert by[6].payload_sha256 == by[7].payload_sha256 and (by[6].n_bytes, by[7].n_bytes) == (1, 2)
    again = media.document_media(df.union(df).union(df.withColumn("doc_id", F.lit(None).cast("long"))))
    assert again.count() == 27 and again.where("doc_id is null").count() == 9
    assert media.document_media(df.limit(0)).count() == 0


def test_sequences_keep_order_positions_and_captions(spark):
    a, b = "a" * 64, "b" * 64
    html = f"""<h1>Title</h1>lead <b>bold</b><script>no()</script><figure><img src="media:{a}.png" alt="alt"><figcaption>Cap <i>one</i></figcaption></figure>
    <p>middle<img src="media:{b}" alt="two"><p>end &amp; more<img src="other.png"><figure><figcaption>only text</figcaption></figure><img data-digest="{a}">"""
    items = media.sequence(html)
    assert [x["position"] for x in items] == list(range(len(items)))
    assert [(x["kind"], x["text"] or x["digest"] or x["source"], x["caption"]) for x in items] == [
        ("text", "Title", None), ("text", "lead bold", None), ("media", a, "Cap one"), ("text", "middle", None), ("media", b, "two"), ("text", "end & more", None), ("media", "other.png", None), ("text", "only text", None), ("media", a, None),
    ]
    assert media.sequence(None) == [] and media.sequence("<p></p>") == []
    df = spark.createDataFrame([(1, html), (2, None), (1, "<img src='media:" + "c" * 64 + "'>")], "page_id long, html string")
    refs = media.references(media.parse(df, "page_id"), "page_id").withColumn("n_bytes", F.lit(9))
    known = spark.createDataFrame([(a, 5, bytes(3)), (b, 6, None)], "digest string, n_bytes long, media binary")
    got = sorted((r.page_id, r.position, (r.digest or r.source)[0], r.caption, r.n_bytes) for r in media.resolve(refs, known).collect())
    assert got == [(1, 0, "c", None, None), (1, 2, "a", "Cap one", 5), (1, 4, "b", "two", 6), (1, 6, "o", None, None), (1, 8, "a", None, 5)]


def test_ordinary_sources_keep_their_place_and_caption():
    html = '<p>a<figure><video><source src="https://x.org/v.mp4"></video><figcaption>film</figcaption></figure><img src="data:image/png;base64,AA" alt="dot">b<img src="/' + "AB" * 32 + '.JPG">'
    got = [(x["position"], x["kind"], x["text"] or x["source"], x["digest"], x["caption"]) for x in media.sequence(html)]
    assert got == [(0, "text", "a", None, None), (1, "media", "https://x.org/v.mp4", None, "film"), (2, "media", "data:image/png;base64,AA", None, "dot"), (3, "text", "b", None, None), (4, "media", "/" + "AB" * 32 + ".JPG", "ab" * 32, None)]


def test_pages_parse(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    parsed = media.parse(pages, "page_id")
    assert parsed.count() == pages.count() and parsed.where(F.size("items") > 0).count() > 0
