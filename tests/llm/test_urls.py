import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from starlode.llm import urls
from starlode.llm.queries import op9_urls


def plain(url):
    """Host, path, rule and the rule's verdict, by the letter."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, says) for says, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_query_follows_the_rules(spark, sf):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op9_urls(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path, rule, verdict = plain(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_odd_rows(spark):
    texts = [None, "", "no scheme", "://", "HTTP://Sub.Example.NET/en/x?q#f", "http://example.net/en", "http://example.net", "http://net/", "http://xnet/", "http://a.org/fr/b", "http://a.org/de", "http://example.com/de/", "http://example.com/en/", "a://b://c.net/d", "http://x.net?y/", "http://É.NET/ü", "http://h.net/a\nb", "http://u@h.net:80/", "x" * 100_000 + "://" + "y" * 100_000 + "/z"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4])]
    df = spark.createDataFrame(rows, "page_id long, url string").select("*", *(F.lit("z").alias(c) for c in ("host", "path", "rule", "verdict", "score", "html")))
    got = urls.judge(df)
    assert got.count() == len(rows)
    for r in got.collect():
        if r.page_id is not None:
            want = plain(texts[r.page_id])
            assert (r.host, r.path, r.rule) == want[:3] and (want[3] is None or r.verdict == want[3]), texts[r.page_id]
            assert (r.score is None) == (want[3] is not None) and r.verdict in ("allow", "block")
    assert urls.judge(df.limit(0)).count() == 0
    assert urls.judge(df.where("page_id is null")).count() == 1


def log(texts, order, context, char):
    """Witten-Bell, from counts taken over again."""
    p = 1 / urls.ALPHABET
    for k in range(order + 1):
        c = context[len(context) - k :]
        seen = Counter(t[i] for t in texts for i in range(order, len(t)) if t[i - k : i] == c)
        if not seen:
            break
        p = (seen[char] + len(seen) * p) / (sum(seen.values()) + len(seen))
    return math.log(p)


def test_scores_equal_a_plain_model():
    good, bad = ["http://a.org/fr/1", "http://b.org/fr/22", "http://a.org/fr/3", "http://c.org/fr/4"], ["http://spam.net/x", "http://buy.net/y", "http://spam.net/zz", "http://q.net/"]
    m = urls.UrlModel(good, bad, order=3, memo=5)
    sides = [[urls.START * 3 + t + urls.END for i, t in enumerate(s) if i % 4] for s in (good, bad)]
    for url in ("http://a.org/new", "", "ftp://é", None):
        t = urls.START * 3 + (url or "") + urls.END
        want = sum(log(sides[0], 3, t[i - 3 : i], t[i]) - log(sides[1], 3, t[i - 3 : i], t[i]) for i in range(3, len(t))) / (len(t) - 3)
        assert m.score(url) == pytest.approx(want, rel=1e-9)


def test_probabilities_sum_to_one():
    m = urls.Markov(["abab", "abc"], 2)
    known = set("abc") | {urls.END}
    for context in (urls.START * 2, "ab", "zz", "bz"):
        seen = sum(math.exp(m.log(context, c)) for c in known)
        assert seen + (urls.ALPHABET - len(known)) * math.exp(m.log(context, "\u2603")) == pytest.approx(1)


def test_unseen_urls_of_both_kinds_are_told_apart():
    rng = random.Random(3)
    word = lambda ws: "-".join(rng.choices(ws, k=3))
    make = lambda ws, n: [f"https://site{rng.randint(1, 99)}.example/{word(ws)}/{rng.randint(1, 999)}" for _ in range(n)]
    good, bad = ("river", "garden", "history", "school", "museum"), ("casino", "bonus", "pills", "jackpot", "replica")
    m = urls.UrlModel(make(good, 300), make(bad, 300))
    right = [m.score(u) >= m.threshold for u in make(good, 200)] + [m.score(u) < m.threshold for u in make(bad, 200)]
    assert sum(right) / len(right) > 0.98


def test_one_class_alone(spark):
    df = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://other.example/x")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.judge(df).collect()}[1] == "block"


def test_the_methods_verdicts_equal_plain_ones(spark, sf):
    """The query's undecided URLs against models that are summed up anew for each character."""
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    model = urls.fit(spark.read.parquet(f"{sf}/pages.parquet"))

    def log(counts, context, char, order):
        p = 1 / urls.ALPHABET
        for k in range(order + 1):
            seen = counts.get(context[len(context) - k :])
            if seen is None:
                break
            p = (seen.get(char, 0) + len(seen) * p) / (sum(seen.values()) + len(seen))
        return math.log(p)

    n = 0
    verdicts = {r.page_id: r.verdict for r in op9_urls(spark, sf).collect()}
    for i, url in pages:
        if plain(url)[3] is None:
            t = urls.START * model.order + (url or "") + urls.END
            both = [sum(log(m.counts, t[j - model.order : j], t[j], model.order) for j in range(model.order, len(t))) for m in model.models]
            ratio = (both[0] - both[1]) / (len(t) - model.order)
            if abs(ratio - model.threshold) > 1e-9:
                assert verdicts[i] == ("allow" if ratio >= model.threshold else "block")
                n += 1
    assert n


def many(rng, n):
    """URLs of both classes and undecided ones, some of them repeated."""
    out = [f"http://{rng.choice(('a.org/fr', 'spam.net', 'shop.example'))}/{rng.choice(('river', 'casino', 'bonus', 'garden'))}{rng.randrange(n)}{rng.choice('xyzé')}" for _ in range(n)]
    return out + [None, "", "http://shop.example/common"] * 30


def equal_to_one_model(spark, texts, **how):
    """The model of all labelled URLs, by hand, against what Spark gives."""
    df = spark.createDataFrame(list(enumerate(texts)), "page_id long, url string").repartition(3)
    order = [r.url for r in df.select("url").where("url is not null").distinct().orderBy(F.xxhash64("url"), "url").collect()]
    both = [[u for u in order if plain(u)[3] == says] for says in ("allow", "block")]
    want = urls.UrlModel(*both)
    got = {r.page_id: r for r in urls.judge(df, **how).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, u in enumerate(texts):
        if plain(u)[3] is None:
            assert got[i].score == pytest.approx(want.score(u), rel=1e-9, abs=1e-12)
            if abs(got[i].score - want.threshold) > 1e-9:
                assert got[i].verdict == ("allow" if got[i].score >= want.threshold else "block")
    return both, got


def test_every_labelled_url_counts(spark):
    """More of a class than the 5,000 that were once learned from."""
    both, _ = equal_to_one_model(spark, many(random.Random(5), 21_000))
    assert all(len(b) > 5_500 for b in both)


def test_ratios_that_tasks_dont_hold_are_joined(spark):
    texts = many(random.Random(6), 400)
    got = [equal_to_one_model(spark, texts, held=n)[1] for n in (1, 60, 100_000)]
    assert got[0] == got[1] == got[2]


def test_the_threshold_equals_the_plain_one(spark):
    rng = random.Random(7)
    for n in (1, 2, 40, 300):
        good, bad = [rng.randrange(-9, 20) / 7 for _ in range(n)], [rng.randrange(-20, 9) / 7 for _ in range(n + 3)]
        df = spark.createDataFrame([("allow", x) for x in good] + [("block", x) for x in bad], "__rules string, __score double")
        assert urls.best_cut(df.repartition(3)) == urls.UrlModel._threshold(good, bad)


def test_classes_of_few_urls(spark):
    for texts in (["http://a.org/fr/1", "http://b.net/", "http://c.de/"], ["http://a.org/fr/1", "http://a.org/fr/2", "http://b.net/", "http://c.de/"], ["http://c.de/"]):
        equal_to_one_model(spark, texts)
