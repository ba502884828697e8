"""Operator 10: best-fit-decreasing packing of documents into sequences.

Method. Pieces are placed in order of falling length, each into the tightest open sequence that
takes it, found in a segment tree over remaining capacities. Sequences of one remaining capacity
are interchangeable, and so are pieces of one length; hence the tree needs only how many pieces of
each length there are: ``capacity`` numbers, whatever the size of the corpus. The driver runs
best fit on those counts and gets *placements*: pieces a..b of length l go to sequences c.., at
offset o. Executors number the pieces within each length and look their placement up. The result
is that of one global best-fit-decreasing pass over all pieces, at any size.

Scale. Tokenising is a narrow map; a text is held by one task with its ids. The pieces are written
once, so each has a place (file and position); cells are hashes of places. A number within a length is a
number within (length, cell) plus the counts of the cells before: no task takes all pieces of a
frequent length, nor all copies of a row. Placements number at most 3 x capacity runs times the pieces in a sequence, in
practice a few thousand, and travel with the task.

Defined results: null texts count as empty and have just the end token; ids of documents are
carried as they are, null or repeated; an empty table gives an empty result; other columns are
ignored. Sequence numbers are arbitrary, distinct and dense.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batched, cut, slices
from .encoding import BlankBoundaryEncoder, encoder

CELL_ROWS = 20_000


class CapacityTree:
    """A segment tree over remaining capacities 0..size: the number of open sequences of each."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that an open sequence has."""
        at = least + self.leaves
        if self.count[at]:
            return least
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first piece, how many, first sequence, offset) of ``counts[length]``
    pieces, by best fit in order of falling length."""
    tree, runs = CapacityTree(capacity), [[] for _ in range(capacity + 1)]  # by capacity: (first sequence, how many)
    out, sequences = [], 0

    def put(left: int, first: int, n: int) -> None:
        runs[left].append((first, n))
        tree.add(left, n)

    for length in sorted(counts, reverse=True):
        at, left = 0, counts[length]
        while left:
            if (room := tree.tightest(length)) is None:
                # each sequence opened takes all it can before the next one opens
                each = capacity // length
                full, rest = divmod(left, each)
                for n, times in ((full, each), (int(rest > 0), rest)):
                    if n:
                        # piece k of each: consecutive pieces go to consecutive sequences, as they are interchangeable
                        for k in range(times):
                            out.append((length, at, n, sequences, k * length))
                            at += n
                        put(capacity - times * length, sequences, n)
                        sequences += n
                break
            first, n = runs[room].pop()
            tree.add(room, -n)
            if n > left:
                put(room, first + left, n - left)
                n = left
            out.append((length, at, n, first, capacity - room))
            put(room - length, first, n)
            at += n
            left -= n
    return out


def _crc(ids: bytes) -> int:
    return zlib.crc32(ids)


def tokenize(df: DataFrame, tokenizer: str, end: int, capacity: int, key: str, text: str) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32. A document longer than ``capacity``
    is cut into pieces of that length; the first may be shorter."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in ("piece", "start", "length", "ids_crc32"))])
    tail = end.to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        e = encoder(BlankBoundaryEncoder, tokenizer)
        for b in slices(batches, 2_000):
            rows, columns = [], ([], [], [], [])
            for i, x in enumerate(b.column(1)):
                ids = e.encode(x.as_py()) + tail
                total = len(ids) // 4
                start, stop, piece = 0, (total - 1) % capacity + 1, 0
                while start < total:
                    rows.append(i)
                    for c, v in zip(columns, (piece, start, stop - start, _crc(ids[4 * start : 4 * stop]))):
                        c.append(v)
                    start, stop, piece = stop, stop + capacity, piece + 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], names=schema.names)

    return batched(df.select(df[key], df[text].cast("string"))).mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int, length: str = "length", cell_rows: int = CELL_ROWS) -> DataFrame:
    """``pieces`` (lengths of 1..capacity, any other columns) with sequence_id and offset."""
    pieces = cut(pieces)
    columns = [F.col(f"`{c}`") for c in pieces.columns if c not in ("sequence_id", "offset")]
    known = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    cells = max(1, -(-pieces.count() // cell_rows))
    # the place of a written piece, by partition and position: the same each time it is read
    placed = pieces.select(*columns, F.monotonically_increasing_id().alias("__place"))
    with_cell = placed.withColumn("__cell", F.pmod(F.xxhash64("__place"), F.lit(cells)))
    per_cell = cut(with_cell.groupBy(F.col(length).alias("__length"), "__cell").agg(F.count("*").alias("__n")))
    counts = {r[0]: r[1] for r in per_cell.groupBy("__length").agg(F.sum("__n")).collect()}  # at most `capacity` rows
    placements = best_fit(counts, capacity)
    before = Window.partitionBy("__length").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_cell.select("__length", "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__length", "__cell").orderBy("__place")
    ranked = (
        with_cell.withColumn("__length", F.col(length))
        .join(offsets, ["__length", "__cell"])
        .select(*columns, (F.row_number().over(within) - 1 + F.col("__before")).alias("__rank"))
    )
    schema = T.StructType([*(pieces.schema[c] for c in known), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    table = np.array(placements, dtype=np.int64).reshape(-1, 5)
    starts = {int(n): (t[:, 1], t) for n in np.unique(table[:, 0]) for t in (table[table[:, 0] == n],)}

    def place(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column(known.index(length)).to_numpy(), b.column(len(known)).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(size):
                first, t = starts[int(n)]
                at = np.flatnonzero(size == n)
                row = t[np.searchsorted(first, rank[at], side="right") - 1]
                sequence[at], offset[at] = row[:, 3] + rank[at] - row[:, 1], row[:, 4]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(place, schema)


def pack_documents(df: DataFrame, tokenizer: str, end: int = 2, capacity: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All of ``df`` tokenised, cut and packed; see the module's docstring."""
    return pack(tokenize(df, tokenizer, end, capacity, key, text), capacity)


def brute_force(lengths: list[int], capacity: int) -> int:
    """The number of sequences that one best-fit-decreasing pass opens, piece by piece."""
    open_: list[int] = []
    n = 0
    for x in sorted(lengths, reverse=True):
        k = bisect_right(open_, x - 1)
        room = open_.pop(k) if k < len(open_) else capacity
        n += room == capacity
        if room > x:
            open_.insert(bisect_right(open_, room - x), room - x)
    return n
