import random

import pytest
from brute_pii import BASE, base_spans, digest
from pyspark.sql import functions as F

from starlode.llm import pii
from starlode.llm.queries import op4_pii


def spans_of(text):
    return [] if not text else [(int(a), int(b), k) for k, a, b in (x.split(":") for x in text.split(","))]


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want = base_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, _, k, _ in want) for kind in BASE], texts[r.doc_id][:200]
        assert r.base_sha256 == digest(want)
        found = spans_of(r.spans)
        assert {(a, b, k) for a, _, k, b in want} <= set(found)
        assert [(a, list(BASE).index(k)) for a, _, k in found] == sorted((a, list(BASE).index(k)) for a, _, k in found)


def test_query_equals_plain_python(spark, sf):
    check(op4_pii(spark, sf).collect(), {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()})


def test_random_texts(spark):
    rng, texts = random.Random(3), {}
    parts = ["@", ".", "-", " ", "+", "(", ")", "0", "1", "9", "25", "255", "4111 1111 1111 1111", "4111111111111111", "a", "Z_", "%", "b.c", "\U0001f600", "é", "x@y.z", "1.2.3.4", "+49 30 123456", "00", "\n", "378282246310005"]
    for i in range(3000):
        texts[i] = "".join(rng.choices(parts, k=rng.randint(1, 25)))
    check(pii.find(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect(), texts)


def runs(n):
    return ["9" * n, "a" * n, "a." * n + "@", "+1" + "(" * n, "1." * n, "1-" * n]


def test_long_runs_take_linear_time(spark):
    df = spark.createDataFrame(list(enumerate(runs(100_000))), "doc_id long, text string")
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.find(df).collect()}
    assert got == {i: (0, 25_000 if i == 4 else 0, 0, 0) for i in range(6)}


def test_odd_rows(spark):
    many = " ".join(f"user{i}@mail{i % 7}.example.org 10.{i % 300}.3.4" for i in range(1500))
    # runs that the plain version would scan again and again are short here, and long below
    texts = {1: None, 2: "", 3: many, 10: "4111 1111 1111 1111"} | {20 + i: x for i, x in enumerate(runs(2000))}
    rows = [*texts.items(), (10, texts[10]), (None, texts[10])]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("z").alias(c) for c in ("spans", "n_email", "kind", "match", "start", "n")))
    out = pii.find(df)
    got = out.collect()
    assert len(got) == len(rows)
    check([r for r in got if r.doc_id not in (10, None)], {k: v for k, v in texts.items() if k != 10})
    assert [r.n_card for r in got if r.doc_id in (10, None)] == [1, 1, 1]
    red = pii.redact(df)
    assert red.columns == df.columns
    by = {r.doc_id: r.text for r in red.collect()}
    assert by[1] is None and by[2] == "" and by[10] == "<CARD>" and by[None] == "<CARD>" and by[21] == texts[21]
    assert by[3].startswith("<EMAIL> <IP> <EMAIL>") and "@" not in by[3]
    assert pii.find(df.limit(0)).count() == 0 and pii.redact(df.limit(0)).count() == 0


def test_redaction_equals_a_plain_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    spans = {r.doc_id: spans_of(r.spans) for r in op4_pii(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.redact(docs).collect():
        out, at = [], 0
        for a, b, k in spans[r.doc_id]:
            if a >= at:
                out += [texts[r.doc_id][at:a], f"<{k.upper()}>"]
            at = max(at, b)
        assert r.text == (None if texts[r.doc_id] is None else "".join(out) + texts[r.doc_id][at:])


def test_votes_tell_reliable_labelers_from_noise():
    """Labelers 0 and 1 say the truth mostly, labeler 2 is a coin, labeler 3 never speaks."""
    rng, counts = random.Random(1), {}
    for _ in range(4000):
        y = rng.random() < 0.5
        say = lambda right: (1 if y == (rng.random() < right) else -1)
        p = (0, say(0.95), say(0.9), say(0.5), 0, 1)
        counts[p] = counts.get(p, 0) + 1
    v = pii.Votes([(*p, n) for p, n in sorted(counts.items())])
    gap = [v.reliability[j, 1, 1] - v.reliability[j, 1, 0] for j in range(4)]
    assert gap[0] > 0.7 and gap[1] > 0.6 and abs(gap[2]) < 0.15 and abs(gap[3]) < 0.05
    assert v.weights[4] > 0.5 and v.weights[5] > 0.5 and abs(v.weights[6]) < 0.4


def test_method_adds_spelled_out_addresses(spark):
    rows = [(i, f"please contact me at user{i}@example.org today") for i in range(60)] + [(100 + i, f"e-mail: someone{i} [at] example [dot] com") for i in range(20)] + [(200 + i, f"order number 12{i:02d} 3456 7890") for i in range(20)]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 + i].n_email == 0 and spans_of(got[100 + i].spans)[0][2] == "email" for i in range(20))


def test_no_python_on_the_main_path(spark, sf):
    for df in (op4_pii(spark, sf), pii.redact(spark.read.parquet(f"{sf}/documents.parquet"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("number,right", [("4111111111111111", True), ("4111111111111112", False), ("378282246310005", True), ("0", True), ("", True), ("18", True), ("19", False)])
def test_luhn(spark, number, right):
    assert spark.range(1).select(pii.luhn(F.lit(number))).first()[0] is right
