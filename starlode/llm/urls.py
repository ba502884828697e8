"""Operator 9: URL filters: rules first, then a ratio of character language models.

Two variable-order Markov models over characters, of URLs that the rules accept and of those they
reject, are smoothed by Witten-Bell interpolation from order ``order`` down to a uniform
distribution. A URL that no rule decides is allowed if the difference of the two log-likelihoods,
per character with the end mark, reaches a threshold, calibrated on rule-labelled URLs that the
models haven't seen (highest mean of both classes' accuracies).

Every distinct rule-labelled URL counts, whatever their number: in the order of their hashes, three of
four are learned from and each fourth one calibrates. Contexts are counted in Spark, and the ratio of every
context and next character that is asked for is a join of these counts. The ``held`` most frequent ratios
go to every task, so a URL that is common is judged where it lies; URLs with rarer ones get those by a
join. The threshold is the best of all cuts between the calibrating URLs' scores, in Spark too. A URL's
parts are summed up in their order, so neither ``held`` nor partitions change a score.

``UrlModel`` is the same classifier in memory, ``fit`` makes one of all labelled URLs on the driver; the
query doesn't use it. A very long URL is held by one task with its contexts.

Defined results: a null URL or one without ``://`` has an empty host and path, no rule, and the
verdict of its text (null: empty); a class without a URL to learn from has a uniform model,
and the threshold is 0 if a class has fewer than two; rows with null or repeated ids are kept; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Mapping, Sequence
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, cut, slices

ALPHABET = 1024  # the uniform distribution at the root
START, END = "\x02", "\x03"
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, ascii_uppercase, ascii_lowercase), path


def with_rule(df: DataFrame, url: str, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``df`` with host, path, rule and __rules (its verdict); the longest rule that fits wins."""
    host, path = host_and_path(F.col(url))
    df = df.withColumns({"host": host, "path": path})
    rule = verdict = F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.endswith("host", F.lit(f".{h}"))) & F.startswith("path", F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return df.withColumns({"rule": rule, "__rules": verdict})


class Markov:
    """Counts of the characters after each context of 0 to ``order`` characters."""

    def __init__(self, texts: Iterable[str], order: int):
        self.order, self.counts = order, {}
        for t in texts:
            t = START * order + t + END
            for i in range(order, len(t)):
                for k in range(order + 1):
                    seen = self.counts.setdefault(t[i - k : i], {})
                    seen[t[i]] = seen.get(t[i], 0) + 1
        self.totals = {c: sum(x.values()) for c, x in self.counts.items()}

    def log(self, context: str, char: str) -> float:
        p = 1 / ALPHABET
        for k in range(self.order + 1):
            c = context[len(context) - k :]
            if (total := self.totals.get(c)) is None:
                break
            seen = self.counts[c]
            p = (seen.get(char, 0) + len(seen) * p) / (total + len(seen))
        return math.log(p)


class UrlModel:
    def __init__(self, accepted: Sequence[str], rejected: Sequence[str], order: int = 5, memo: int = 500_000):
        fit, check = zip(*(([x for i, x in enumerate(s) if i % 4], [x for i, x in enumerate(s) if i % 4 == 0]) for s in (accepted, rejected)))
        self.order, self.limit, self.memo = order, memo, {}
        self.models = [Markov(s, order) for s in fit]
        self.threshold = self._threshold(*([self.score(x) for x in s] for s in check)) if all(fit) and all(check) else 0.0
        self.memo = {}

    @staticmethod
    def _threshold(good: list[float], bad: list[float]) -> float:
        good, bad = np.sort(good), np.sort(bad)
        cuts = np.unique(np.r_[good, bad])
        middles = np.r_[cuts[0] - 1, (cuts[1:] + cuts[:-1]) / 2, cuts[-1] + 1]
        right = (1 - np.searchsorted(good, middles) / len(good)) + np.searchsorted(bad, middles) / len(bad)
        best = middles[right >= right.max() - 1e-12]
        return float(best[np.abs(best).argmin()])

    def score(self, url: str | None) -> float:
        """The length-normalised log-likelihood difference; higher: more like accepted URLs."""
        k, memo, total = self.order, self.memo, 0.0
        t = START * k + (url or "") + END
        for i in range(len(t) - k):
            gram = t[i : i + k + 1]
            if (x := memo.get(gram)) is None:
                if len(memo) >= self.limit:
                    memo.clear()
                x = memo[gram] = self.models[0].log(gram[:-1], gram[-1]) - self.models[1].log(gram[:-1], gram[-1])
            total += x
        return total / (len(t) - k)


def grams_of(url: str | None, order: int) -> list[str]:
    """Each character with its context."""
    t = START * order + (url or "") + END
    return [t[i : i + order + 1] for i in range(len(t) - order)]


def labelled(df: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(__url, __rules, rank): the distinct URLs that a rule decides, numbered from 0 in each class by hash."""
    all_urls = with_rule(df.select(F.col(url).cast("string").alias("__url")), "__url", rules)
    each = cut(all_urls.where("__rules is not null").select("__url", "__rules").distinct().withColumn("hash", F.xxhash64("__url")))
    each = each.withColumn("cell", F.shiftright("hash", 54))  # 1,024 even parts
    sizes = each.groupBy("__rules", "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("__rules").orderBy("cell")) - F.col("n")
    place = F.row_number().over(Window.partitionBy("__rules", "cell").orderBy("hash", "__url")) - 1
    ranked = each.withColumn("place", place).join(F.broadcast(sizes.select("__rules", "cell", before.alias("before"))), ["__rules", "cell"])
    return ranked.select("__url", "__rules", (F.col("before") + F.col("place")).alias("rank"))


def fit(df: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, order: int = 5) -> UrlModel:
    """The classifier of all rule-labelled URLs, which the driver holds."""
    texts: dict[str, list[str]] = {"allow": [], "block": []}
    for u, says in labelled(df, url, rules).orderBy("__rules", "rank").select("__url", "__rules").collect():
        texts[says].append(u)
    return UrlModel(texts["allow"], texts["block"], order)


def counted(asked: DataFrame, order: int, flush: int = 200_000) -> DataFrame:
    """(gram, n0, n1, asked) of the last 1 to ``order`` + 1 characters of every gram of (url, side): how often
    accepted URLs (side 0) and rejected ones (1) hold it, and those to be scored (2)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        sides = [Counter(), Counter(), Counter()]

        def out() -> Iterable[pa.RecordBatch]:
            for i, c in enumerate(sides):
                n = pa.array(list(c.values()), pa.int64())
                none = pa.array(np.zeros(len(c), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), *(n if i == j else none for j in range(3))], names=["gram", "n0", "n1", "asked"])
                c.clear()

        for b in slices(batches, 2_000):
            for u, side in zip(b.column(0), b.column(1).to_pylist()):
                sides[side].update(grams_of(u.as_py(), order))
                if len(sides[side]) >= flush:
                    yield from out()
        yield from out()

    sums = [F.sum(c).alias(c) for c in ("n0", "n1", "asked")]
    whole = asked.mapInArrow(run, "gram string, n0 long, n1 long, asked long").groupBy("gram").agg(*sums)
    ends = F.explode(F.transform(F.sequence(F.lit(1), F.lit(order + 1)), lambda n: F.substring("gram", order + 2 - n, n)))
    return whole.select(ends.alias("gram"), "n0", "n1", "asked").groupBy("gram").agg(*sums)


def ratios(counts: DataFrame, order: int) -> DataFrame:
    """(gram, ratio, asked) of the asked grams, as ``UrlModel`` has them. A shorter end of a gram is the end
    of no more grams than there are characters, so no join meets a frequent key."""
    context = F.substring("gram", F.lit(1), F.length("gram") - 1)
    after = counts.groupBy(context.alias("context")).agg(*(f(i) for i in (0, 1) for f in (lambda i: F.sum(f"n{i}").alias(f"total{i}"), lambda i: F.count_if(F.col(f"n{i}") > 0).alias(f"kinds{i}"))))
    rows = cut(counts.where("asked > 0").withColumn("context", context).join(after, "context").drop("context"))

    def p(i: int, below: Column) -> Column:
        total, kinds = F.col(f"total{i}"), F.col(f"kinds{i}")
        return F.when(total > 0, (F.col(f"n{i}") + kinds * below) / (total + kinds)).otherwise(below).alias(f"p{i}")

    known = rows.where(F.length("gram") == 1).select("gram", "asked", *(p(i, F.lit(1 / ALPHABET)) for i in (0, 1)))
    for n in range(2, order + 2):
        below = known.select(F.col("gram").alias("end"), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
        longer = rows.where(F.length("gram") == n).withColumn("end", F.substring("gram", 2, n))
        known = longer.join(below, "end").select("gram", "asked", *(p(i, F.col(f"q{i}")) for i in (0, 1)))
    return cut(known.select("gram", (F.log("p0") - F.log("p1")).alias("ratio"), "asked"))


class Ratios:
    """The most frequent grams' ratios, which every task holds."""

    def __init__(self, known: Mapping[str, float], order: int):
        self.known, self.order = known, order

    def score(self, url: str | None, more: Mapping[str, float] = {}) -> float | list[str]:  # noqa: B006
        """A URL's score, or the grams it needs besides."""
        total, known, grams = 0.0, self.known, grams_of(url, self.order)
        missing = {g for g in grams if g not in known and g not in more}
        if missing:
            return sorted(missing)
        for g in grams:
            total += known[g] if g in known else more[g]
        return total / len(grams)


def scored(df: DataFrame, of: DataFrame, order: int, held: int) -> DataFrame:
    """``df``, whose last column is __url, with __score; ``of`` has the ratios of all its grams."""
    top = of.orderBy(F.desc("asked"), "gram").limit(held).select("gram", "ratio").toArrow()
    known = dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist()))
    shared, names = Shared(Ratios(known, order)), df.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        own = shared.get()
        for b in slices(batches, 2_000):
            more = b.column(len(names)) if b.num_columns > len(names) else None
            found = [own.score(u.as_py(), {} if more is None else dict(more[i].as_py())) for i, u in enumerate(b.column(len(names) - 1))]
            score = pa.array([x if isinstance(x, float) else None for x in found], pa.float64())
            needs = pa.array([None if isinstance(x, float) else x for x in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], score, needs], names=[*names, "__score", "__needs"])

    first = df.mapInArrow(run, f"{fields}, __score double, __needs array<string>")
    if len(known) < held:
        return first.drop("__needs")
    first = cut(first)
    rest = first.where("__needs is not null")
    more = rest.select("__url", F.explode("__needs").alias("gram")).distinct().join(of.select("gram", "ratio"), "gram")
    more = more.groupBy("__url").agg(F.map_from_entries(F.collect_list(F.struct("gram", "ratio"))).alias("__more"))
    rest = rest.select(*names).join(more, "__url").select(*names, "__more")
    last = rest.mapInArrow(run, f"{fields}, __score double, __needs array<string>")
    return first.where("__needs is null").unionByName(last).drop("__needs")


def best_cut(scores: DataFrame) -> float:
    """``UrlModel``'s threshold from (__rules, __score) of both classes, in parts of ascending scores."""
    says = F.col("__rules")
    each = scores.groupBy("__score").agg(F.count_if(says == "allow").alias("good"), F.count_if(says == "block").alias("bad"))
    each = cut(each.repartitionByRange("__score").sortWithinPartitions("__score")).withColumn("part", F.spark_partition_id())
    parts = each.groupBy("part").agg(F.sum("good"), F.sum("bad"), F.max("__score")).orderBy("part").collect()
    before, good, bad, last = [], 0, 0, None
    for part, g, b, top in parts:
        before.append((part, good, bad, last))
        good, bad, last = good + g, bad + b, top
    each = each.join(F.broadcast(each.sparkSession.createDataFrame(before, "part int, g long, b long, last double")), "part")
    w = Window.partitionBy("part").orderBy("__score")
    lower = F.coalesce(F.lag("__score").over(w), "last")
    middle = F.when(lower.isNull(), F.col("__score") - 1).otherwise((F.col("__score") + lower) / 2)
    under = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = lambda c: c.cast("decimal(18,0)")
    less = [F.col(n) + F.coalesce(F.sum(c).over(under), F.lit(0)) for n, c in (("g", "good"), ("b", "bad"))]
    right = whole(F.lit(good) - less[0]) * whole(F.lit(bad)) + whole(less[1]) * whole(F.lit(good))
    best = each.select(right.alias("right"), middle.alias("middle")).orderBy(F.desc("right"), F.abs("middle"), "middle").first()
    return min((-int(best[0]), abs(best[1]), best[1]), (-good * bad, abs(last + 1), last + 1))[2]


def judge(df: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, model: UrlModel | None = None, order: int = 5, held: int = 200_000) -> DataFrame:
    """key, host, path, rule, verdict and score (null where a rule decides) of every row; by ``model``, or
    by all URLs of ``df`` that a rule decides."""
    rows = with_rule(df.select(F.col(key).alias("__key"), F.col(url).cast("string").alias("__url")), "__url", rules).select("__key", "host", "path", "rule", "__rules", "__url")
    decided, others = rows.where("__rules is not null"), rows.where("__rules is null").withColumn("__url", F.coalesce("__url", F.lit("")))  # texts are joined by
    if model is None:
        known = cut(labelled(df, url, rules))
        checks, learned = known.where("rank % 4 = 0").select("__rules", "__url"), known.where("rank % 4 > 0")
        side = F.when(F.col("__rules") == "allow", 0).otherwise(1)
        asked = learned.select("__url", side.alias("side")).unionByName(checks.select("__url", F.lit(2).alias("side"))).unionByName(others.select("__url", F.lit(2).alias("side")))
        of = ratios(cut(counted(asked, order)), order)
        both = learned.select("__rules").distinct().count() == 2  # a class that has one to learn from has one to check
        threshold = best_cut(scored(checks, of, order, held)) if both else 0.0
        others = scored(others, of, order, held)
    else:
        shared, threshold = Shared(model), model.threshold

        def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            own = shared.get()
            for b in slices(batches, 2_000):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([own.score(u.as_py()) for u in b.column(5)], pa.float64())], names=[*b.schema.names, "__score"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others.schema)
        others = others.mapInArrow(run, f"{fields}, __score double")
    others = others.withColumn("__rules", F.when(F.col("__score") >= threshold, "allow").otherwise("block"))
    every = decided.withColumn("__score", F.lit(None).cast("double")).unionByName(others)
    return every.select(F.col("__key").alias(key), "host", "path", "rule", F.col("__rules").alias("verdict"), F.col("__score").alias("score"))
