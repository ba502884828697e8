import math

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from starlode.llm import langid
from starlode.llm.queries import op3_language

PIECES = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string"


def segmentations(word, known):
    """The sum over all ways to cut a word into pieces, plainly."""
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, min(langid.LONGEST, len(word)) + 1):
        p = known.get(word[:n], 0.0)
        total += (max(p, langid.UNKNOWN) if n == 1 else p) * segmentations(word[n:], known)
    return total


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "▁a", "ab", "ba", "aba", "▁ab", "bb"]
    lexicon, rng = langid.Lexicon(pieces), np.random.default_rng(1)
    p = rng.dirichlet(np.ones(len(pieces)), 2).T
    table = np.vstack([p, np.zeros(2)])
    for word in ("▁a", "▁ab", "▁abba", "▁babab", "▁abzab", "▁" + "ab" * 5):
        got = langid.forward(lexicon.lattice([word], len(word)), table)[0]
        for k in range(2):
            assert got[k] == pytest.approx(math.log(segmentations(word, dict(zip(pieces, p[:, k])))), rel=1e-9)


def test_learning_raises_the_likelihood():
    lexicon = langid.Lexicon(langid.vocabulary(PIECES))
    words = {"▁the": 50, "▁house": 9, "▁river": 7, "▁unhappy": 3}
    value = lambda p: sum(n * langid.forward(lexicon.lattice([w], len(w)), p[:, None])[0, 0] for w, n in words.items())
    at = [value(langid.learn(lexicon, words, steps=k, prior=1e-9)) for k in (1, 2, 4, 8)]
    assert at == sorted(at)


def test_lexicon_finds_its_pieces_and_no_others():
    pieces = langid.vocabulary(PIECES)
    lexicon = langid.Lexicon(pieces, 1 << 14)  # small tables: several are needed
    for n in (1, 3, 7):
        some = [p for p in pieces if len(p) == n][:500]
        found = lexicon.lattice(some, n)[:, n - 1, n - 1]
        assert [lexicon.pieces[i] for i in found] == some
    assert lexicon.lattice(["qqqqq"], 5)[0, 4, 4] == -1


def test_held_out_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = op3_language(spark, sf)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang is not None and sum(c.isalpha() for c in r.text or "") >= 20]
    right = sum(r.lang_pred == r.lang for r in held) / len(held)
    assert len(held) > 20 and right >= 0.95


def train(spark):
    rows = [(i, t, k) for k, ws in (("xx", "kalo mira tesu vanek"), ("yy", "dubro shenta wifol gratz")) for i, t in enumerate([" ".join(ws.split()[j % 4 :]) for j in range(40)])]
    return spark.createDataFrame([(i, t, k) for i, (_, t, k) in enumerate(rows)], DOCS)


def test_odd_rows(spark):
    base = train(spark)
    odd = [(1000, None, "xx"), (1001, "", None), (1002, "12 !? 34", "yy"), (1003, "kalo " * 200_000, None), (1004, "KALO, mira.", None), (None, "dubro shenta", "xx"), (1004, "KALO, mira.", None), (1005, "漢字" * 50 + "x" * 5000, "zz")]
    df = base.unionByName(spark.createDataFrame(odd, DOCS)).select("*", *(F.lit(0).alias(c) for c in ("held_out", "lang_pred", "score", "word", "n")))
    model = langid.fit(df.where("lang is null or lang <> 'zz'"), PIECES)
    assert model.languages == ["xx", "yy"]
    got = langid.identify(df, model)
    assert got.count() == df.count()
    by = {}
    for r in got.where("doc_id >= 1000 or doc_id is null").collect():
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.score, r.held_out))
    assert [by[i][0][:2] for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert by[1003][0][0] == "xx" and len(by[1004]) == 2 and by[1004][0] == by[1004][1] and by[1004][0][0] == "xx"
    assert by[None][0][0] == "yy" and by[None][0][2] is False
    kept = langid.keep(df, model)
    assert kept.columns == df.columns and not kept.where("doc_id in (1000, 1001, 1002)").count() and kept.where("doc_id = 1004").count() == 2


def test_predictions_do_not_depend_on_labels_or_neighbours(spark):
    df = train(spark)
    model = langid.fit(df, PIECES)
    own = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, model).collect()}
    other = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df.withColumn("lang", F.lit("yy")).orderBy(F.desc("doc_id")).repartition(3), model).collect()}
    assert {k: v[0] for k, v in own.items()} == {k: v[0] for k, v in other.items()}
    assert all(own[k][1] == pytest.approx(other[k][1], abs=1e-9) for k in own)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "hello there", None), (2, None, "en")], DOCS)
    model = langid.fit(df, PIECES)
    assert [(r.lang_pred, r.score) for r in langid.identify(df, model).collect()] == [("und", 0.0)] * 2
    empty = df.limit(0)
    assert langid.identify(empty, langid.fit(empty, PIECES)).count() == 0


def test_query_equals_a_plain_version(spark, sf):
    """Predictions and scores of the query, from the model's probabilities, summed letter by letter."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs, PIECES)
    known = {p: i for i, p in enumerate(model.lexicon.pieces)}

    def word(w, p):
        w, ahead, log = langid.MARK + w, [1.0], 0.0
        for end in range(1, len(w) + 1):
            total = 0.0
            for n in range(1, min(langid.LONGEST, end) + 1):
                q = p[known[w[end - n : end]]] if w[end - n : end] in known else 0.0
                total += ahead[end - n] * (max(q, langid.UNKNOWN) if n == 1 else q)
            ahead.append(total)
            if total < 1e-200:
                ahead = [a * 1e200 for a in ahead]
                log -= math.log(1e200)
        return math.log(ahead[-1]) + log

    got = {r.doc_id: r for r in op3_language(spark, sf).collect()}
    checked = 0
    for r in docs.orderBy("doc_id").collect():
        words = ["".join(g) for g in "".join(c if c.isalpha() else " " for c in (r.text or "").lower()).split()]
        if not words:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
        elif len(words) < 120:
            sums = [sum(word(w, model.probability[:, k]) for w in words) for k in range(len(model.languages))]
            best = max(range(len(sums)), key=lambda k: sums[k])
            assert got[r.doc_id].lang_pred == model.languages[best]
            assert got[r.doc_id].score == pytest.approx(1 / sum(math.exp(s - sums[best]) for s in sums), abs=1e-6)
            checked += 1
    assert checked > 20


def test_a_rare_language_keeps_its_words(spark):
    """One language has a thousandth of the other's words; each is learned from its own most frequent ones."""
    rows = [(i, " ".join(f"{a}{b}lo" for a in "kmnptrs" for b in "aeiou"), "big") for i in range(3000)] + [(5000 + i, "zwyx qruv zwyx", "rare") for i in range(6)]
    df = spark.createDataFrame(rows, DOCS)
    model = langid.fit(df, PIECES, words=5)
    assert model.languages == ["big", "rare"]
    assert [r.lang_pred for r in langid.identify(df.where("doc_id = 5001"), model).collect()] == ["rare"]


def test_sampling_and_letters():
    share = lambda n: (langid.threshold(600, n) + 2**63 + 1) / 2**64
    for n in (700, 10**6, 10**10, 10**15):
        assert share(n) * n == pytest.approx(600, rel=1e-3)
    assert langid.threshold(600, 600) == langid.threshold(600, 1) == 2**63 - 1
    assert langid.letters("ab\u00bdc \u00b2 \u2167 d1e_f") == ["ab", "c", "d", "e", "f"]
    model = langid.LanguageModel(["xx"], langid.Lexicon(["\u2581", "a"]), np.array([[0.5], [0.5], [0]]))
    assert model.predict(["\u00bd \u00b2 \u2167", "a"]) == (["und", "xx"], [0.0, 1.0])


def test_long_words_are_learned_from(spark):
    df = spark.createDataFrame([(i, ("kalo" if i % 2 else "dubr") * 200, "xx" if i % 2 else "yy") for i in range(60)], DOCS)
    got = langid.identify(df, langid.fit(df, PIECES)).collect()
    assert all(r.lang_pred == ("xx" if r.doc_id % 2 else "yy") for r in got)
