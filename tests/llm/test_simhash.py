import random

import brute_simhash
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from starlode.llm import simhash
from starlode.llm.graphs import connected_components
from starlode.llm.queries import op1_simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="aB \t\n\x0b\x0c\r\x1c\x85\xa0éß　z", max_size=60)))
def test_fingerprint_equals_the_plain_one(text):
    assert simhash.fingerprint(text) == brute_simhash.fingerprint(text)


def test_query_equals_brute_force(spark, sf):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: brute_simhash.fingerprint(t) for i, t in rows.items()}
    least = brute_simhash.components(prints)
    got = op1_simhash(spark, sf).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{p:016x}", least[i]) for i, p in prints.items())


def test_every_distance_up_to_the_radius_is_found(spark):
    """Random fingerprints, each with others at 0 to 5 flipped bits, over all radii."""
    rng = random.Random(5)
    prints = {0: 0}
    for _ in range(60):
        base = rng.getrandbits(64)
        prints[len(prints)] = base
        for bits in (0, 1, 2, 3, 3, 3, 4, 5):
            x = base
            for b in rng.sample(range(64), bits):
                x ^= 1 << b
            prints[len(prints)] = x
    signed = sorted({int(np.uint64(p).view(np.int64)) for p in prints.values()})
    df = spark.createDataFrame([(p,) for p in signed], "print long").repartition(3)
    for radius in (0, 1, 2, 3):
        edges = simhash.links(df, "print", radius)
        if radius == 0:
            assert edges.count() == 0
            continue
        parts = {r.id: r.root for r in connected_components(edges).collect()}
        own = brute_simhash.components({p: p & (1 << 64) - 1 for p in signed}, radius)
        groups = lambda of: sorted(sorted(p for p in signed if of(p) == r) for r in {of(p) for p in signed})
        assert groups(lambda p: parts.get(p, p)) == groups(own.__getitem__)
    with pytest.raises(ValueError, match="radius"):
        simhash.masks(6)


def test_odd_rows(spark):
    long = " ".join(f"word{i % 977} and{i % 311}" for i in range(60_000))
    rows = [(5, None), (4, ""), (3, " \t\n"), (9, "one"), (8, "ONE"), (7, "one two"), (2, long), (1, long + " tail"), (6, "a b c d"), (6, "a b c d"), (None, "one"), (None, "alone by itself here"), (11, "a b c d")]
    df = docs(spark, rows).select("*", *(F.lit(1).alias(c) for c in ("print", "component_id", "fingerprint", "variant", "root", "id", "least", "a", "b")))
    got = simhash.near_duplicates(df).collect()
    known = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id if r.component_id is not None else -1) for r in got)
    assert known == [(-1, -1), (-1, 8), (1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, 6), (6, 6), (7, 7), (8, 8), (9, 8), (11, 6)]
    assert {r.fingerprint for r in got if r.doc_id in (3, 4, 5)} == {"0" * 16}
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in kept.collect()) == sorted([(-1, "alone by itself here"), (1, long + " tail"), (3, " \t\n"), (6, "a b c d"), (7, "one two"), (8, "ONE")])


def test_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.deduplicate(docs(spark, [])).count() == 0


def test_a_large_group_of_near_copies(spark):
    """A third of all rows in one group, and copies whose fingerprints differ."""
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base)) for i in range(300)] + [(300 + i, " ".join(base[: i % 7 + 50] + ["x"] + base[i % 7 + 51 :])) for i in range(100)] + [(1000 + i, " ".join(random.Random(i).choices(base, k=80))) for i in range(200)]
    prints = {i: brute_simhash.fingerprint(t) for i, t in rows}
    least = brute_simhash.components(prints)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == least
    assert sum(v == 0 for v in got.values()) >= 300


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(70)] + [(200, i) for i in range(201, 260)] + [(300, 301), (301, 300), (400, 400), (None, 5), (-3, -9)]
    got = {r.id: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(71)} | {i: 200 for i in range(200, 260)} | {300: 300, 301: 300, -3: -9, -9: -9}


def test_a_variant_with_many_members(spark):
    """100,000 fingerprints that share all bits but the 22 masked ones meet in one run."""
    rng = np.random.default_rng(6)
    members = np.unique(rng.integers(0, 1 << 22, 100_000, dtype=np.uint64))[:40_000]
    a, b = simhash.run_links(members, 3)
    roots = {int(x): int(x) for x in members}

    def find(x):
        while roots[x] != x:
            roots[x] = roots[roots[x]]
            x = roots[x]
        return x

    for x, y in zip(a, b):
        assert bin(x ^ y).count("1") <= 3
        roots[find(x)] = find(y)
    known = set(members.tolist())
    for x in members[:300].tolist():
        for i in range(22):
            if (y := x ^ 1 << i) in known:
                assert find(x) == find(y)


@pytest.mark.parametrize("radius", [1, 3])
@pytest.mark.parametrize("rows", [7, 10_000])
def test_crowded_variants_lose_no_link(spark, rows, radius):
    """Fingerprints that differ in masked bits only, in runs too large to hold, among others."""
    rng = random.Random(7)
    prints = [rng.getrandbits(22) & 0x0FFF7 for _ in range(150)] + [rng.getrandbits(20) << 44 for _ in range(150)]
    for _ in range(40):
        x = rng.getrandbits(64)
        prints += [x, x ^ 1 << rng.randrange(64), x ^ 7 << rng.randrange(60)]
    signed = sorted({int(np.uint64(p).view(np.int64)) for p in prints})
    df = spark.createDataFrame([(p,) for p in signed], "print long").repartition(3)
    own = brute_simhash.components({p: p & (1 << 64) - 1 for p in signed}, radius)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        crowded = simhash.meetings(df, radius, most=20).where("b is null").count()
        edges = simhash.links(df, "print", radius, most=20).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert crowded > 250
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= radius for r in edges)
    parts = {r.id: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = lambda of: sorted(sorted(p for p in signed if of(p) == r) for r in {of(p) for p in signed})
    assert groups(lambda p: parts.get(p, p)) == groups(own.__getitem__)


def test_many_rows_of_one_id_and_clashing_names(spark):
    rows = [(1, "same words in all of these rows", i % 3, "p", "r", "w") for i in range(5000)] + [(None, "no id here at all", 7, "p", "r", "w")] * 3 + [(2, "other words that stand alone", 1, "p", "r", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, print string, root string, row string").repartition(7)
    got = simhash.deduplicate(df)
    assert got.columns == df.columns and sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "no id here at all"), (1, "same words in all of these rows"), (2, "other words that stand alone")]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, simhash.deduplicate(df.repartition(3)).collect()))


@pytest.mark.parametrize("bits", [15, 16, 26])
def test_remaining_rows(spark, monkeypatch, bits):
    """With a full bitmap, a crowded one and a sparse one; keys in no bitmap cell, null keys, clashing names."""
    monkeypatch.setattr(simhash, "BITS", bits)
    df = spark.range(60_000).select(F.when(F.col("id") % 1000 != 5, F.col("id")).alias("doc_id"), F.lit("x").alias("cell"), F.lit("y").alias("bits"))
    gone = spark.range(60_000).where("id % 3 = 1 and id % 1000 != 5").toDF("doc_id")
    kept = spark.range(60_000).where("id % 3 != 1 and id % 1000 != 5").toDF("doc_id")
    got = simhash.remaining(df, gone, kept, "doc_id")
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [i for i in range(60_000) if i % 3 != 1 and i % 1000 != 5]
    assert simhash.remaining(df, gone.limit(0), kept.unionByName(gone), "doc_id").count() == 60_000 - 60
