import duckdb
from pyspark.sql import functions as F

from starlode.llm import licences
from starlode.llm.queries import op7_licences, oracle_sql


def test_query_equals_duckdb(spark, sf):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = c.sql(oracle_sql()["op7_licences"])
    order = [want.columns.index(x) for x in ("doc_id", "digest", "license")]
    assert sorted((tuple(r) for r in op7_licences(spark, sf).collect()), key=str) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)


def test_each_known_text_is_found_in_other_spellings(spark):
    rows = []
    for i, (name, text) in enumerate(licences.KNOWN):
        rows += [(10 * i, text, name), (10 * i + 1, "Copyright (c) 2021 Someone & Sons\n\n" + text.upper().replace("\n", "\r\n\t") + "\n(C) 2020 me", name), (10 * i + 2, "  " + text.replace("License", "Licence").replace("copyright holder", "copyright owner") + " !!", name)]
        rows += [(10 * i + 3, text + " and more", None)]
    got = {r.doc_id: r.license for r in licences.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id int, text string")).collect()}
    assert got == {i: name for i, _, name in rows}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " .,;\n"), (4, "Copyright 2020 someone"), (5, "word " * 300_000), (6, licences.KNOWN[0][1]), (6, licences.KNOWN[0][1]), (None, licences.KNOWN[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("z").alias(c) for c in ("digest", "license")))
    got = licences.scan(df)
    assert sorted(((r.doc_id or 0, r.license) for r in got.collect()), key=str) == sorted([(0, "MIT"), (1, None), (2, None), (3, None), (4, None), (5, None), (6, "MIT"), (6, "MIT")], key=str)
    assert licences.scan(df.limit(0)).count() == 0


def test_whole_texts_are_found(spark):
    names = {"Apache-2.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "Artistic-1.0-Perl", "BSL-1.0", "Unlicense"}
    assert {name for name, _ in licences.FULL} == names
    rows = []
    for i, (name, text) in enumerate(licences.FULL):
        rows += [(10 * i, text, name), (10 * i + 1, "Copyright 2021 Someone\n\n" + text.upper().replace("\n", "\r\n"), name), (10 * i + 2, text + " and more", None)]
    got = {r.doc_id: r.license for r in licences.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id int, text string")).collect()}
    assert got == {i: name for i, _, name in rows}


def test_wrapping_does_not_hide_a_licence(spark):
    """No line of a licence is taken for a notice, however it is wrapped."""
    import textwrap

    rows, n = [], 0
    for name, text in licences.TABLE:
        parts = [p for p in text.split("\n\n") if "copyright (c)" not in p.lower() and "copyright [" not in p.lower() and "copyright <" not in p.lower() and "copyright 20" not in p.lower() and "copyright 19" not in p.lower() and "\u00a9" not in p]
        whole = "\n\n".join(parts)
        rows.append((n, whole, n))
        for width in range(60, 101, 5):
            rows.append((n, "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in parts), n))
        n += 1
    got = licences.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id int, text string"))
    assert got.groupBy("doc_id").agg(F.countDistinct("digest").alias("d")).where("d > 1").count() == 0


def test_notices_go_and_texts_that_begin_with_the_word_stay(spark):
    base = "copyright notice and this permission notice\n(c) you must retain\ncopyright holders be liable\n"
    forms = [base, "Copyright (c) 1999 X\n" + base, "# Copyright: 2001-2004 X\n" + base + "All rights reserved.\n", "(C) 2020 me\n" + base, "\u00a9 Me\n" + base, "Copyright by Me\n" + base, "Copyright [yyyy] [name]\n" + base]
    got = licences.scan(spark.createDataFrame([(1, x) for x in forms], "doc_id int, text string")).select("digest").distinct()
    assert got.count() == 1


def test_whole_licences_in_a_table_of_other_documents(spark, sf):
    """The planted ones are found, and no other document, as a plain lookup says."""
    import re
    from string import ascii_lowercase, ascii_uppercase

    def plain(text):
        x = re.sub(licences.COPYRIGHT.replace("\\x{a9}", "\u00a9"), "\n", (text or "").translate(str.maketrans(ascii_uppercase, ascii_lowercase)))
        x = " " + re.sub("[^a-z0-9\x80-\U0010ffff]+", " ", x) + " "
        for a, b in licences.EQUIVALENT:
            x = x.replace(f" {a} ", f" {b} ")
        return x.strip(" ")

    known = {}
    for name, text in licences.TABLE:
        known[plain(text)] = min(name, known.get(plain(text), name))
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs += [(100_000 + i, f"Copyright (c) {1990 + i} Someone\n\n{re.sub(chr(92) + 'bLicense' + chr(92) + 'b', 'Licence', t)}\n") for i, (_, t) in enumerate(licences.TABLE)]
    got = {r.doc_id: r.license for r in licences.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: known.get(plain(t)) for i, t in docs}
    assert sum(v is not None for v in got.values()) >= len(licences.TABLE)
