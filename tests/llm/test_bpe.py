import hashlib
from array import array

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from starlode.llm import bpe, encoding
from starlode.llm.queries import op8_bpe

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
TEXTS = st.text(alphabet=st.one_of(st.sampled_from(list("abcXYZ 019.,'!-_\n\t\r\x1c\x1f\x85\xa0éßſıİ　​漢ñÀ\U0001f600")), st.characters(codec="utf-8")), max_size=50)


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module", params=[(encoding.ForcedBoundaryEncoder, WORD), (encoding.BlankBoundaryEncoder, BYTE)], ids=["word", "byte"])
def both(request):
    kind, path = request.param
    return kind(path, 200), library(path)


def ids(e, text):
    return list(array("I", e.encode(text)))


@settings(max_examples=600, deadline=None)
@given(text=TEXTS)
def test_encodings_equal_the_librarys(both, text):
    own, lib = both
    got = ids(own, text)
    assert got == lib.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "it's we'll I'D 'tis don't''s", "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|>", "x" * 5000, "ﬁ ① Å Å ĳ", "Áb́", "a\x00b", "1234567890" * 30, "\n\n\n a\n b", "tab\tsep\x0bvt\x0cff", "ÀÉÎ straße ŒUVRE", "a b c", "​zero​width"])
def test_particular_texts(both, text):
    own, lib = both
    assert ids(own, text) == lib.encode(text, add_special_tokens=False).ids


def test_forced_cuts_are_certain():
    """Merging never crosses a byte pair that no token holds, so pieces encoded apart are the whole."""
    e = encoding.ForcedBoundaryEncoder(WORD)
    assert e.vocabulary.never
    cut = 0
    for w in ("foo-bar", "x9y8z7qqjx", "a.b.c", "qzxjqk", "ñandúß", "don't"):
        for piece in e.pieces(w):
            parts = e.fragments(piece)
            assert b"".join(parts) == piece
            assert all((a[-1], b[0]) in e.vocabulary.never for a, b in zip(parts, parts[1:]))
            cut += len(parts) > 1
    assert cut


def test_query_equals_the_library(spark, sf):
    lib = library(WORD)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(got), hashlib.sha256(array("I", got).tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(got, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "hello world " * 60_000), (4, "Same text"), (4, "Same text"), (None, "x"), (5, "z" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("z").alias(c) for c in ("ids", "decoded", "n_tokens", "other")))
    out = bpe.encode(df, WORD, results=("ids", "n_tokens", "decoded"))
    assert sorted(out.columns) == ["decoded", "doc_id", "ids", "n_tokens", "other"]
    got = out.collect()
    lib = library(WORD)
    for r, t in zip(sorted(got, key=lambda r: (r.doc_id or 0, r.n_tokens)), sorted(rows, key=lambda r: r[0] or 0)):
        assert r.ids == lib.encode(t[1] or "", add_special_tokens=False).ids and r.decoded == lib.decode(r.ids, skip_special_tokens=False) and r.n_tokens == len(r.ids)
    again = bpe.decode(out.select("doc_id", "ids", "n_tokens"), WORD)
    assert sorted((r.doc_id or 0, r.decoded) for r in again.collect()) == sorted((r.doc_id or 0, r.decoded) for r in got)
    assert bpe.encode(df.limit(0), WORD).count() == 0
    assert bpe.decode(spark.createDataFrame([(None,), ([],)], "ids array<bigint>"), WORD).collect()[0].decoded == ""
