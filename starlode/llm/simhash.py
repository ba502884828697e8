"""Operator 1: SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints: A-Z in lower case, words between ASCII white space, shingles of ``shingle`` words
(repeats count; fewer words: the whole sequence), XXH64 with seed 42 of each. A bit is set if it is
set in more than half of the hashes. Two fingerprints link if they differ in ``radius`` bits or less.

Search. Documents are first reduced to distinct fingerprints, so groups of copies cost one row.
Every fingerprint emits all variants within half the radius and meets others in the middle. A
radius of 3 is odd: its half, 1, finds only distances up to 2. Emitting a ball of 2 as well would
take 2,081 variants a row. Instead one of three parts of the bits (22, 21, 21) is masked out in
turn: three differing bits fall into the parts somehow, so masking a part that holds one of them
leaves at most 2, and a ball of 1 over the rest meets: 44 + 43 + 43 variants and the 3 centres, 133
rows instead of 2,146. Every collision is verified on whole fingerprints.

Rows that share a variant are sorted by Spark (which can spill) and read as a stream, run by run.
Within a run no pair list is made: a search outward from a member links those within the radius
and takes them from the rest, so a run gives at most one edge per member. Edges between runs are
joined in ``graphs.connected_components``.

The masked bits are free, so very many fingerprints may share a variant. A run of more than ``MOST``
isn't held: its fingerprints pass on, and emit the ball of 2 over all 64 bits. There a variant names
every bit, so at most 2,081 fingerprints share one, whatever the data, and none of the links is lost.

Other radii: r bits are covered by masking one of (r mod 2) * 2 + 1 parts and balls of r // 2;
radii from 0 to 5 are accepted.

Defined results: null and empty texts have fingerprint zero and link like any other; rows with a
null id keep it, and their component is the smallest non-null id reachable (null if there is none);
repeated rows are returned as often as they occur (``deduplicate`` keeps one); a very long text is held
by one task beside its shingles' hashes; an empty table gives an empty result; other columns are ignored,
whatever their names (``deduplicate`` keeps them).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batched, cut, slices
from .graphs import connected_components

SEED, MOST, BITS = 42, 16_384, 26


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):  # bounds the unpacked bits
        bits = np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 3, seed: int = SEED) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), dtype=np.uint64, count=n))


def distance(x: np.ndarray, y: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(x ^ y)


def masks(radius: int, whole: bool = False) -> list[tuple[int, list[int]]]:
    """What is kept of a fingerprint, and the bits that vary, for each masked part; none is masked if
    the radius is even or the ``whole`` fingerprint is wanted."""
    if not 0 <= radius <= 5:
        raise ValueError("radius must be from 0 to 5")
    if radius % 2 == 0 or whole:
        return [((1 << 64) - 1, list(range(64)))]
    parts = [range(0, 22), range(22, 43), range(43, 64)]
    return [(((1 << 64) - 1) & ~sum(1 << b for b in p), [b for b in range(64) if b not in p]) for p in parts]


def balls(radius: int, whole: bool = False) -> list[tuple[int, list[int]]]:
    """For each masked part, what is kept and the flips within half the radius, rounded up for ``whole``."""
    half = (radius + whole) // 2
    return [(kept, [0] + [sum(1 << b for b in c) for n in range(1, half + 1) for c in combinations(bits, n)]) for kept, bits in masks(radius, whole)]


def variants(prints: np.ndarray, radius: int, whole: bool = False) -> Iterator[np.ndarray]:
    """For each masked part, the variants (rows: fingerprints) within half the radius. Different
    parts get different numbers from the masked bits, which are free."""
    for k, (kept, flips) in enumerate(balls(radius, whole)):
        free = next((b for b in range(64) if not kept >> b & 1), None)
        mark = np.uint64(0 if free is None else k << free)
        yield ((prints & np.uint64(kept))[:, None] ^ np.array(flips, dtype=np.uint64)[None, :]) ^ mark


def run_links(members: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges that join the members within ``radius`` of each other into their components."""
    a, b, rest = [], [], members
    while len(rest):
        found, rest = [rest[0]], rest[1:]
        while found and len(rest):
            x = found.pop()
            near = distance(rest, x) <= radius
            if near.any():
                hits = rest[near]
                a += [int(x)] * len(hits)
                b += hits.tolist()
                found += list(hits)
                rest = rest[~near]
    return a, b


def meetings(prints: DataFrame, radius: int, whole: bool = False, most: int | None = None) -> DataFrame:
    """(a, b): edges between fingerprints that share a variant and are within ``radius``; (a, null) for
    each fingerprint of a run of more than ``most``."""
    size = sum(len(flips) for _, flips in balls(radius, whole))

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            every = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(every), max(1, 1_000_000 // size)):
                some = every[at : at + max(1, 1_000_000 // size)]
                for v in variants(some, radius, whole):
                    keys = v.reshape(-1).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(some, v.shape[1]).view(np.int64))], names=["variant", "print"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        keys, members = np.empty(0, np.int64), np.empty(0, np.uint64)
        passing = None  # the variant whose run is too large to hold

        def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        def passed(of: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(of.view(np.int64)), pa.nulls(len(of), pa.int64())], names=["a", "b"])

        def runs(keys: np.ndarray, members: np.ndarray) -> Iterable[pa.RecordBatch]:
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, int)
            sizes = np.diff(np.r_[starts, len(keys)])
            a, b = [], []
            for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
                if most is not None and n > most:
                    yield passed(members[s : s + n])
                    continue
                x, y = run_links(members[s : s + n], radius)
                a += x
                b += y
            two = starts[sizes == 2]
            near = distance(members[two], members[two + 1]) <= radius if len(two) else np.empty(0, bool)
            x, y = members[two][near], members[two + 1][near]
            yield edges(*(np.concatenate([np.array(p, dtype=np.uint64), q]).view(np.int64) for p, q in ((a, x), (b, y))))

        for batch in batches:
            new, more = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if passing is not None:
                at = int(np.searchsorted(new, passing, side="right"))
                yield passed(more[:at])
                new, more = new[at:], more[at:]
            if not len(new):
                continue
            passing = None
            keys, members = np.concatenate([keys, new]), np.concatenate([members, more])
            last = int(np.searchsorted(keys, keys[-1]))  # the last run may go on in the next batch
            if last:
                yield from runs(keys[:last], members[:last])
                keys, members = keys[last:], members[last:]
            if most is not None and len(keys) > most:
                passing = keys[-1]
                yield passed(members)
                keys, members = keys[:0], members[:0]
        yield from runs(keys, members)

    every = prints.mapInArrow(emit, "variant long, print long")
    return every.repartition("variant").sortWithinPartitions("variant", "print").mapInArrow(meet, "a long, b long").distinct()


def links(prints: DataFrame, column: str, radius: int, most: int = MOST) -> DataFrame:
    """(a, b): edges between distinct fingerprints (longs) that join those within ``radius``."""
    prints = prints.select(column)
    if radius % 2 == 0:
        return meetings(prints, radius)
    found = cut(meetings(prints, radius, most=most))
    crowded, found = found.where("b is null").select("a"), found.where("b is not null")
    return found if crowded.isEmpty() else found.unionByName(meetings(crowded, radius, whole=True))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, print): the fingerprint of every whole text, as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in slices(batches, 2_000):
            prints = np.array([fingerprint(x.as_py(), shingle) for x in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], names=[key, "print"])

    return batched(df.select(df[key], df[text].cast("string"))).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, print long")


def _components(df: DataFrame, key: str, text: str, radius: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(key, print) of every row, and (print, root, component_id) of every fingerprint."""
    docs = cut(fingerprints(df, key, text, shingle))
    prints = cut(docs.groupBy("print").agg(F.min(key).alias("least")))
    # connected_components names a component by its smallest fingerprint; the smallest id is wanted
    parts = connected_components(links(prints, "print", radius))
    rooted = prints.join(parts, prints["print"] == parts["id"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    rooted = cut(rooted)
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return docs, rooted.join(of_root, "root").select("print", "root", "component_id")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 3, shingle: int = 3) -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id of every row of ``df``."""
    docs, named = _components(df, key, text, radius, shingle)
    return docs.join(named, "print").select(key, F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 3, shingle: int = 3) -> DataFrame:
    """One row of ``df`` per component: that with the smallest id; of rows that share this id, the
    first by their other columns. Components without any id keep one of their rows."""
    docs, named = _components(df, key, text, radius, shingle)
    return keep_least(df, docs, named, key, text, lambda x: fingerprint(x, shingle))


def keep_least(df: DataFrame, docs: DataFrame, named: DataFrame, key: str, text: str, of: Callable[[str | None], int]) -> DataFrame:
    """What ``deduplicate`` keeps, from (key, print) of every row and (print, root, component_id) of
    every print; ``of`` gives a text's print."""
    named = cut(named)
    kept = named.where(F.col("component_id").isNotNull()).select(F.col("component_id").alias(key)).distinct()
    out = remaining(df, docs.where(F.col(key).isNotNull()).select(key).distinct().join(kept, key, "left_anti"), kept, key)
    repeated = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    others = F.struct(F.xxhash64(*(c for c in df.columns if c != key)), F.col(text))
    row, mark, whole = (unused(df, n) for n in ("print", "root", "row"))
    # the first row of a group as a minimum: each task gives one, so that a frequent id isn't held by one
    first = F.min_by(F.struct(*df.columns), others).alias(whole)
    if not repeated.isEmpty():
        repeated = cut(repeated)
        again = out.join(repeated, key, "left_semi").groupBy(key).agg(first).select(f"{whole}.*")
        out = out.join(repeated, key, "left_anti").select(*df.columns).unionByName(again)
    nameless = named.where(F.col("component_id").isNull()).select("print", "root")
    if nameless.isEmpty():
        return out
    names, at = [*df.columns, row], df.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in slices(batches):
            prints = np.array([of(x.as_py()) for x in b.column(at)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prints.view(np.int64))], names=names)

    schema = T.StructType([*df.schema, T.StructField(row, T.LongType())])
    roots = nameless.select(F.col("print").alias(row), F.col("root").alias(mark))
    alone = batched(df.where(F.col(key).isNull())).mapInArrow(run, schema).join(roots, row)
    return out.unionByName(alone.groupBy(mark).agg(first).select(f"{whole}.*"))


def remaining(df: DataFrame, dropped: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose key is ``kept``. Those whose key's hash falls on no ``dropped`` one in a bitmap
    of 2 ** BITS (8 MB at most) stay where they are; only the others are shuffled to be joined. Beyond about
    2 ** BITS dropped keys the bitmap is full, and all rows are joined."""
    at = lambda: F.xxhash64(key).bitwiseAND((1 << BITS) - 1)
    cell, bits = unused(df, "cell"), unused(df, "bits")
    cells = dropped.groupBy(F.shiftright(at(), 15).alias(cell)).agg(F.bitmap_construct_agg(at().bitwiseAND(32767)).alias(bits))
    cells = F.broadcast(cut(cells))  # a row of 4 KB for each of 2 ** (BITS - 15) cells
    place = at().bitwiseAND(32767).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    mark = F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(place, F.lit(8)))), F.lit(2)), F.lit(0))
    rows = df.where(df[key].isNotNull()).withColumn(cell, F.shiftright(at(), 15)).join(cells, cell, "left")
    unsure = rows.where(mark == 1).select(*df.columns).join(kept, key, "left_semi").select(*df.columns)
    return rows.where(mark == 0).select(*df.columns).unionByName(unsure)


def unused(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name = f"_{name}"
    return name
