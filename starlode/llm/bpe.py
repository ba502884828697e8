"""Operator 8: BPE encoding and decoding with forced boundaries.

``encode`` adds a row's ids; ``decode`` turns ids into text. Method: see ``encoding``. Every whole
text is encoded on its own, in the order of the input and without a shuffle, so neither hot keys
nor groups of copies matter; a long text is held by one task, beside its ids.

Defined results: a null text counts as empty (no ids, empty decoded text); ids of rows are kept as
they are, null or repeated; columns that clash with a result's name are replaced by the result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import batched, slices
from .encoding import ForcedBoundaryEncoder, encoder

RESULTS = {
    "ids": (T.ArrayType(T.LongType()), pa.list_(pa.int64())),
    "n_tokens": (T.LongType(), pa.int64()),
    "decoded": (T.StringType(), pa.string()),
    "ids_sha256": (T.StringType(), pa.string()),
    "decoded_sha256": (T.StringType(), pa.string()),
}


def _results(e: ForcedBoundaryEncoder, text: str | None, wanted: Sequence[str]) -> dict:
    ids = e.encode(text)
    out = {"n_tokens": len(ids) // 4}
    if "ids" in wanted:
        out["ids"] = list(array("I", ids))
    if "ids_sha256" in wanted:
        out["ids_sha256"] = hashlib.sha256(ids).hexdigest()
    if "decoded" in wanted or "decoded_sha256" in wanted:
        out["decoded"] = e.decode(ids)
    if "decoded_sha256" in wanted:
        out["decoded_sha256"] = hashlib.sha256(out["decoded"].encode()).hexdigest()
    return out


def encode(df: DataFrame, tokenizer: str, text: str = "text", results: Sequence[str] = ("ids", "decoded")) -> DataFrame:
    """``df`` with the named results (see ``RESULTS``) of each whole ``text``, which goes unless it
    is among them. ``tokenizer`` is the path of a ``tokenizers`` JSON file, the same on all machines."""
    kept = [c for c in df.columns if c != text and c not in results]
    fields = [df.schema[c] for c in kept] + [T.StructField(r, RESULTS[r][0]) for r in results]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        e = encoder(ForcedBoundaryEncoder, tokenizer)
        for b in slices(batches, 2_000):
            got = [_results(e, x.as_py(), results) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array([g[r] for g in got], RESULTS[r][1]) for r in results)], names=[*kept, *results])

    return batched(df.select(df[text].cast("string"), *(df[c] for c in kept))).mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the text of each row's ``ids`` (null: empty), special tokens kept."""
    kept = [c for c in df.columns if c not in (ids, decoded)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        e = encoder(ForcedBoundaryEncoder, tokenizer)
        for b in batches:
            texts = [e.decode(array("I", x.as_py() or []).tobytes()) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(texts, pa.string())], names=[*kept, decoded])

    return batched(df.select(df[ids].cast("array<bigint>"), *(df[c] for c in kept))).mapInArrow(run, T.StructType([*(df.schema[c] for c in kept), T.StructField(decoded, T.StringType())]))
