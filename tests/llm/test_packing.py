import random
import zlib
from array import array
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from starlode.llm import packing
from starlode.llm.queries import op10_packing

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, texts, capacity=1024):
    """rows: the result; texts: (id, text) of every document, ids distinct."""
    lib = Tokenizer.from_file(BYTE)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert set(by) == {i for i, _ in texts}
    for i, t in texts:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        own, at = sorted(by[i], key=lambda r: r.piece), 0
        assert [r.piece for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // capacity)
        for r in own:
            assert r.start == at and (r.length == capacity or r.piece == 0) and 0 < r.length <= capacity
            assert r.ids_crc32 == zlib.crc32(array("I", ids[at : at + r.length]).tobytes())
            at += r.length
        assert at == len(ids)
    gapless(rows, capacity)
    assert len({r.sequence_id for r in rows}) == packing.brute_force([r.length for r in rows], capacity)


def gapless(rows, capacity):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for x in places.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity


def test_query_equals_brute_force(spark, sf):
    check(op10_packing(spark, sf).collect(), [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_odd_rows(spark):
    texts = [(1, None), (2, ""), (3, "word " * 30_000), (4, "same"), (5, "same"), (6, "é\U0001f600 \n\n x"), (7, "a" * 20_000), (8, "<|endoftext|>")]
    df = spark.createDataFrame(texts, "doc_id long, text string").select("*", *(F.lit("z").alias(c) for c in ("piece", "start", "length", "sequence_id", "offset", "ids_crc32")))
    check(packing.pack_documents(df, BYTE).collect(), texts)
    more = packing.pack_documents(df.unionByName(df).unionByName(df.withColumn("doc_id", F.lit(None).cast("long"))), BYTE).collect()
    gapless(more, 1024)
    assert Counter(r.doc_id for r in more)[None] == len(more) // 3
    assert packing.pack_documents(df.limit(0), BYTE).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=120))))
def test_counts_are_placed_like_single_pieces(case):
    capacity, lengths = case
    counts = Counter(lengths)
    rooms, seen = defaultdict(int), Counter()
    for length, first, n, sequence, offset in packing.best_fit(dict(counts), capacity):
        assert first == seen[length]
        seen[length] += n
        for k in range(n):
            assert rooms[sequence + k] == offset
            rooms[sequence + k] += length
            assert rooms[sequence + k] <= capacity
    assert seen == counts and len(rooms) == packing.brute_force(lengths, capacity)


def test_tree_finds_the_tightest():
    rng, tree, have = random.Random(1), packing.CapacityTree(100), Counter()
    for _ in range(2000):
        c = rng.randint(0, 100)
        n = rng.choice([1, -1]) if have[c] else 1
        have[c] += n
        tree.add(c, n)
        least = rng.randint(0, 100)
        assert tree.tightest(least) == min((k for k, v in have.items() if v and k >= least), default=None)


@pytest.mark.parametrize("cell_rows", [3, 20_000])
def test_cells_do_not_change_the_packing(spark, cell_rows):
    rng = random.Random(2)
    lengths = [rng.choice([1, 5, 5, 5, 5, 7, 9, 16]) for _ in range(400)]
    df = spark.createDataFrame([(i % 150, n) for i, n in enumerate(lengths)], "id long, length long").repartition(5)
    rows = packing.pack(df, 16, cell_rows=cell_rows).collect()
    assert Counter(r.length for r in rows) == Counter(lengths)
    gapless(rows, 16)
    ids = {r.sequence_id for r in rows}
    assert ids == set(range(packing.brute_force(lengths, 16)))
