import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from starlode.llm import toxicity
from starlode.llm.queries import op6_toxicity

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def small():
    rng = np.random.default_rng(1)
    net = toxicity.Network({"a": 1, "b": 2, "c": 3}, rng.standard_normal((4, toxicity.WORD)) * 0.5, rng.standard_normal((toxicity.BUCKETS, toxicity.CHARS)) * 0.1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["attend"] = rng.standard_normal(2 * toxicity.UNITS) * 0.5
    return net


def batch(net, tokens):
    known, rows = net.inputs([w for t in tokens for w in t])
    n = len(tokens)
    known, rows = known.reshape(n, toxicity.WINDOW).T, rows.reshape(n, toxicity.WINDOW, toxicity.CHARS).transpose(1, 0, 2)
    mask = np.array([[w != "" for w in t] for t in tokens]).T
    x = np.concatenate([net.p["words"][known], rows], axis=2) * mask[:, :, None]
    return known, x, mask, np.concatenate([x @ net.p["in_f"] + net.p["gate_f"], x @ net.p["in_b"] + net.p["gate_b"]], axis=2)


def test_gradients_equal_differences():
    net, rng = small(), random.Random(2)
    tokens = [rng.choices(["a", "b", "c", "dd", "eee"], k=toxicity.WINDOW) for _ in range(3)] + [["a", "zz"] + [""] * (toxicity.WINDOW - 2)]
    target, weight = np.array([1.0, 0, 1, 0]), np.full(4, 0.25)
    known, x, mask, gates = batch(net, tokens)
    slopes, _ = net.slopes(gates, mask, known, x, target, weight)

    def loss():
        _, _, mask, gates = batch(net, tokens)
        p = toxicity.sigmoid(net.run(gates, mask))
        return float(-(weight * (target * np.log(p) + (1 - target) * np.log(1 - p))).sum())

    for name in ("out", "bias", "attend", "rec_f", "rec_b", "in_f", "in_b", "words"):
        flat = net.p[name].reshape(-1)
        for i in rng.sample(range(len(flat)), min(4, len(flat))):
            if name == "words" and i < toxicity.WORD:
                continue
            was, step = flat[i], 1e-3
            flat[i] = was + step
            up = loss()
            flat[i] = was - step
            down = loss()
            flat[i] = was
            assert slopes[name].reshape(-1)[i] == pytest.approx((up - down) / (2 * step), rel=2e-2, abs=2e-5), name


def test_windows_cover_the_text_and_overlap():
    for n in (0, 1, 15, 16, 17, 28, 29, 1000):
        s = toxicity.starts(n)
        covered = {i for b in s for i in range(b, min(n, b + toxicity.WINDOW))}
        assert covered == set(range(n)) and all(b - a < toxicity.WINDOW for a, b in zip(s, s[1:]))


def test_a_texts_score_is_its_highest_window():
    net = small()
    words = [random.Random(1).choice(["a", "b", "c", "dd"]) for _ in range(70)]
    singles = [net.logits([" ".join(words[b : b + toxicity.WINDOW])])[0][0] for b in toxicity.starts(70)]
    high, where = net.logits([" ".join(words)], 2)
    assert high[0] == pytest.approx(max(singles), abs=1e-4)
    assert toxicity.starts(70).index(where[0][0]) == int(np.argmax(singles))


def test_held_out_documents(spark, sf):
    """Fitted on other documents, the held-out ones are told apart. The smaller tables have six toxic
    documents or fewer among those held out, too few to measure."""
    big = sf.replace("sf0.001", "sf0.1")
    rows = op6_toxicity(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id", "left").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(r.score, r.toxic) for r in rows if r.held_out and r.toxic is not None]
    bad, good = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert bad and good
    # measured: 0.935 and 0.97; about 5 % of the labels contradict the texts, and de, es and fr have few toxic documents to learn from
    assert np.mean([(a > b) + (a == b) / 2 for a in bad for b in good]) > 0.9
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.95


def corpus(spark):
    rng, rows = random.Random(4), []
    calm, rude = "the river ran past a quiet old mill and children played there".split(), "zorbish grakking vunt".split()
    for i in range(400):
        words = rng.choices(calm, k=rng.randint(3, 80))
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(rude)
        rows.append((i, " ".join(words), "en"))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], LABELS)


def test_odd_rows(spark):
    docs, labels = corpus(spark)
    more = [(1000, None, None), (1001, "", "en"), (1002, "the river " * 100_000 + "zorbish", "en"), (1003, "the river " * 100_000, "en"), (1004, "a zorbish vunt", None), (1004, "a zorbish vunt", None), (None, "a zorbish vunt", None), (1005, "x" * 100_000, "en")]
    df = docs.unionByName(spark.createDataFrame(more, DOCS)).select("*", *(F.lit(1).alias(c) for c in ("score", "predicted", "toxic", "held_out", "quality")))
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 1), (1001, 0, None), (9999, 1, 1), (2, 1, 0), (2, 0, 0), (3, 1, 7)], LABELS))
    net = toxicity.fit(df, odd)
    got = toxicity.score(df, net)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == df.count()
    by = {r.doc_id: r for r in got.where("doc_id >= 1000 or doc_id is null").collect()}
    assert [by[i].predicted for i in (1000, 1001, 1003)] == [0, 0, 0] and [by[i].predicted for i in (1002, 1004, None)] == [1, 1, 1]
    assert by[None].held_out is False
    kept = toxicity.keep(df, net)
    assert kept.columns == df.columns
    assert kept.where("doc_id in (1002, 1004) or doc_id is null").count() == 0 and kept.where("doc_id in (1000, 1001, 1003)").count() == 3
    assert toxicity.score(df.limit(0), net).count() == 0


def test_one_class_or_none(spark):
    docs, labels = corpus(spark)
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.where("toxic = 1"))).collect()} == {1.0}
