"""Operator 4: personal data by weak-supervision aggregation, in SQL functions only.

Base spans are those of four patterns (leftmost, not overlapping within a kind) that pass a check:
parts of an address at most 255, 12 to 19 digits with a valid Luhn sum, 9 to 15 digits. Candidates
are the base spans, the matches that fail the check, and looser forms (spelled-out addresses,
national telephone numbers) that overlap no base span. Labelers vote on each (-1, 0, 1): a regex
labeler (strict form), a gazetteer labeler (domains, number ranges, calling codes), a context
labeler (words before it) and a shape labeler. Expectation-maximisation over the counts of vote
patterns estimates how reliable each labeler is and what each pattern means; a logistic classifier
over votes, kind and size is trained on that. Base spans stay whatever it says; it adds candidates
that it gives ``least`` or more.

Positions come from the gaps between matches (``split``) and the matches (``regexp_extract_all``),
whose lengths are summed in blocks, so positions of n matches take about n steps (n * n / 8192 more for
blocks); patterns are written so that they never rescan a run of characters. What overlaps is found by
binary search in the matches of each pattern, which are sorted and disjoint. ``redact`` cuts bytes, not
characters, whose positions would have to be counted from the beginning. ``let`` binds a value to a lambda's variable,
so it is computed once.

Scale. All row work is a narrow map over whole texts. What is aggregated and collected are counts of
vote patterns, at most 4 kinds x 3^4 votes x 3 sizes. No joins, no groups.

Defined results: a null text counts as empty; null and repeated ids are kept; other columns are
ignored by ``find`` and kept by ``redact``; an empty table gives an empty result. Offsets are code
points, the end exclusive. Counts and the base digest are of base spans.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone")
LOCAL = r"[A-Za-z0-9._%+-]"
LABEL = r"[A-Za-z0-9-]++"
#: A run is entered at its beginning or where the match before ended, never in its middle: what
#: follows the run is the same from anywhere within it.
PATTERNS = (
    rf"(?={LOCAL})(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}(?:\.{LABEL})++",
    r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
LOOSE_EMAIL = rf"(?={LOCAL})(?:\G|(?<!{LOCAL})){LOCAL}++ ?(?:\[at\]|\(at\)) ?{LABEL}(?: ?(?:\[dot\]|\(dot\)) ?{LABEL})++"
LOOSE_PHONE = r"(?<![0-9+(])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"
#: What a text must hold before its patterns are tried.
HINTS = (r"@", r"[0-9]\.[0-9]", r"[0-9][\x20-]?[0-9]", r"\+[0-9]")
PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
DOMAINS = r"(?i)(?:\.|dot[\])] ?)(?:com|org|net|edu|gov|int|info|biz|io|eu|de|at|ch|fr|es|it|nl|uk|us|ca|au|br|in|jp)$"
CONTEXT = (
    r"(?i)\b(?:e-?mail|mail|contact|write|reach|correo|courriel|kontakt)\b",
    r"(?i)\b(?:ip|host|server|address|addr|client|login|from)\b",
    r"(?i)\b(?:card|credit|visa|mastercard|amex|karte|carte|tarjeta|payment|pay)\b",
    r"(?i)\b(?:tel|phone|telephone|mobile|cell|fax|call|telefon|t.l.phone|tel.fono)\b",
)
AGAINST = r"(?i)\b(?:order|invoice|isbn|issn|version|serial|part|ref|id|number|no|figure|section|page)\b[^A-Za-z0-9]*$"
BLOCK = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _matches(text: Column, pattern: str, length: Callable[[Column], Column]) -> Column:
    """array<struct<start,end,match,before>> of a pattern's matches; positions are counted by ``length``."""

    def of(m: Column, gaps: Column) -> Column:
        def at(sizes: Column) -> Column:
            total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
            blocks = F.transform(F.sequence(F.lit(0), ((F.size(sizes) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK))))
            before = let(blocks, lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b))))

            def struct(sums: Column) -> Column:
                def one(x: Column, i: Column) -> Column:
                    b = (i / BLOCK).cast("int")
                    start = F.get(sums, b) + total(F.slice(sizes, b * BLOCK + 1, i - b * BLOCK)) + length(F.get(gaps, i))
                    return F.struct(start.alias("start"), (start + length(x)).alias("end"), x.alias("match"), F.substring(F.get(gaps, i), -24, 24).alias("before"))

                return F.transform(m, one)

            return let(before, struct)

        return let(F.transform(m, lambda x, i: length(x) + length(F.get(gaps, i))), at)

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, let(F.split(text, pattern, -1), lambda g: of(m, g))))
    return F.coalesce(found, _none("array<struct<start:int,end:int,match:string,before:string>>"))


def _none(kind: str) -> Column:
    return F.from_json(F.lit("[]"), kind)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def total(r: Column) -> Column:
        digit = lambda i: F.substring(r, i, F.lit(1))
        doubled = lambda i: F.translate(digit(i), "123456789", "246813579")
        return F.aggregate(F.sequence(F.lit(1), F.length(r)), F.lit(0), lambda a, i: a + F.coalesce(F.when(i % 2 == 1, digit(i)).otherwise(doubled(i)).try_cast("int"), F.lit(0)))

    return let(F.reverse(digits), total) % 10 == 0


def _passes(kind: int, match: Column) -> Column:
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return F.rlike(match, F.lit(rf"^{PART}(?:\.{PART}){{3}}$"))
    low, high = (12, 19) if kind == 2 else (9, 15)
    return let(_digits(match), lambda d: F.length(d).between(low, high) & (luhn(d) if kind == 2 else F.lit(True)))


def _votes(kind: int, base: Column, match: Column, before: Column) -> list[Column]:
    vote = lambda plus, minus=None: F.when(plus, 1).when(F.lit(False) if minus is None else minus, -1).otherwise(0)
    like = lambda c, p: F.rlike(c, F.lit(p))
    strict = (like(match, r"(?:\[dot\]|\(dot\)) ?[A-Za-z]{2,}$"), F.lit(False), F.lit(False), like(match, r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$"))[kind]
    fails = (F.lit(False), F.lit(True), F.lit(True), ~like(match, r"^\(?[0-9]{2,4}"))[kind]
    listed = (
        vote(like(match, DOMAINS)),
        vote(~like(match, r"^(?:0|127|22[4-9]|2[3-5][0-9])\."), like(match, r"^0+\.")),
        vote(like(match, "^[3-6]"), ~like(match, "^[1-9]")),
        vote(like(match, r"^\+(?:1|7|[2-689][0-9])"), like(match, r"^\+0")),
    )[kind]
    return [
        vote(base | strict, fails).alias("form"),
        listed.alias("listed"),
        vote(like(before, CONTEXT[kind]), like(before, AGAINST)).alias("context"),
        vote(F.lit(False), like(before, "[A-Za-z0-9]$") | like(match, r"([0-9])\1{7}")).alias("shape"),
    ]


def _candidates_of(text: Column, kind: int, pattern: str, loose: bool, length: Callable[[Column], Column]) -> Column:
    def one(x: Column) -> Column:
        base = F.lit(False) if loose else _passes(kind, x["match"])

        def struct(b: Column) -> Column:
            n = F.length(x["match"])
            return F.struct(
                x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), b.alias("base"), F.lit(int(loose)).alias("loose"),
                *_votes(kind, b, x["match"], x["before"]), F.when(n < 12, 0).when(n < 20, 1).otherwise(2).alias("size"),
            )

        return let(base, struct)

    return F.transform(_matches(text, pattern, length), one)


SPAN = "struct<start:int,kind:int,end:int,base:boolean,loose:int,form:int,listed:int,context:int,shape:int,size:int>"


def _meets(found: Column, start: Column, end: Column) -> Column:
    """Whether a span from ``start`` to ``end`` overlaps one of ``found``, which are sorted and disjoint: the
    first of them that ends after ``start`` is the only one to look at."""

    def halve(s: Column, _: Column) -> Column:
        middle = ((s["lo"] + s["hi"]) / 2).cast("int")
        after = F.get(found, middle)["end"] > start
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & ~after, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & after, middle).otherwise(s["hi"]).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(found) + F.lit(1))).cast("int"))
    first = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(found).alias("hi")), halve, lambda s: s["lo"])
    return (F.size(found) > 0) & F.coalesce(F.get(found, first)["start"] < end, F.lit(False))


def candidates(text: Column, length: Callable[[Column], Column] = F.length) -> Column:
    """array<SPAN> by start, then kind: base spans, failed matches and looser forms."""
    none = _none(f"array<{SPAN}>")
    strict = [F.when(F.rlike(text, F.lit(HINTS[k])), _candidates_of(text, k, p, False, length)).otherwise(none) for k, p in enumerate(PATTERNS)]
    loose = [
        F.when(F.rlike(text, F.lit(r"[\[(]at[\])]")), _candidates_of(text, 0, LOOSE_EMAIL, True, length)).otherwise(none),
        F.when(F.rlike(text, F.lit(r"[0-9]{2}\)?[ .-][0-9]{3}")), _candidates_of(text, 3, LOOSE_PHONE, True, length)).otherwise(none),
    ]

    def joined(a: Column) -> Column:
        def free(base: Column) -> Column:
            by_kind = F.transform(F.sequence(F.lit(0), F.lit(len(KINDS) - 1)), lambda k: F.filter(base, lambda x: x["kind"] == k))
            apart = lambda lists: lambda x: ~F.exists(lists, lambda b: _meets(b, x["start"], x["end"]))
            return let(by_kind, lambda lists: F.concat(base, F.filter(a, lambda x: ~x["base"] & apart(lists)(x)), F.filter(F.concat(*loose), apart(lists))))

        return let(F.filter(a, lambda x: x["base"]), free)

    return F.array_sort(let(F.concat(*strict), joined))


class Votes:
    """What the votes mean: labelers' reliabilities by expectation-maximisation, then a classifier."""

    FEATURES = 4 + 4 + 3

    def __init__(self, patterns: list[tuple[int, int, int, int, int, int, int]], steps: int = 20, rate: float = 0.5, rounds: int = 400):
        """``patterns``: kind, four votes, size, count."""
        self.belief = [1 / (1 + math.exp(-sum(p[1:5]))) for p in patterns]
        self.reliability: dict[tuple[int, int, int, int], float] = {}
        for _ in range(steps if patterns else 0):
            sums: dict[tuple, float] = {}
            for p, y in zip(patterns, self.belief):
                for side, share in ((1, y), (0, 1 - y)):
                    for j in range(4):
                        sums[j, p[1 + j], side] = sums.get((j, p[1 + j], side), 0.0) + share * p[6]
                    sums["side", p[0], side] = sums.get(("side", p[0], side), 0.0) + share * p[6]
            weight = lambda j, v, side: (sums.get((j, v, side), 0.0) + 1) / (sum(sums.get((j, u, side), 0.0) for u in (-1, 0, 1)) + 3)
            self.reliability = {(j, v, side): weight(j, v, side) for j in range(4) for v in (-1, 0, 1) for side in (0, 1)}
            odds = lambda p: math.log((sums["side", p[0], 1] + 1) / (sums["side", p[0], 0] + 1)) + sum(math.log(self.reliability[j, p[1 + j], 1] / self.reliability[j, p[1 + j], 0]) for j in range(4))
            self.belief = [1 / (1 + math.exp(-max(-30.0, min(30.0, odds(p))))) for p in patterns]
        self.weights = [0.0] * self.FEATURES
        rows = [([float(p[0] == k) for k in range(4)] + [float(v) for v in p[1:5]] + [float(p[5] == k) for k in range(3)], y, math.sqrt(p[6])) for p, y in zip(patterns, self.belief)]
        total = sum(n for _, _, n in rows)
        for _ in range(rounds if rows else 0):
            slope = [0.001 * w for w in self.weights]
            for x, y, n in rows:
                miss = (1 / (1 + math.exp(-sum(a * b for a, b in zip(x, self.weights)))) - y) * n / total
                for k, v in enumerate(x):
                    slope[k] += miss * v
            self.weights = [w - rate * s for w, s in zip(self.weights, slope)]

    def accepts(self, x: Column, least: float) -> Column:
        w = self.weights
        z = F.element_at(F.array(*map(F.lit, w[:4])), x["kind"] + 1) + F.element_at(F.array(*map(F.lit, w[8:])), x["size"] + 1)
        for k, v in enumerate(("form", "listed", "context", "shape")):
            z = z + x[v] * w[4 + k]
        return x["base"] | (z >= math.log(least / (1 - least)))


def fit(found: DataFrame, spans: str = "__found") -> Votes:
    """Trains on the candidates of all rows, by the counts of their patterns."""
    x = found.select(F.explode(spans).alias("x")).groupBy("x.kind", "x.form", "x.listed", "x.context", "x.shape", "x.size").agg(F.count("*").alias("n"))
    return Votes(sorted(tuple(r) for r in x.collect()))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def find(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.9) -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row."""
    rows = cut(df.select(F.col(key).alias("__key"), candidates(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("__found")))
    votes = fit(rows)
    base = F.filter("__found", lambda x: x["base"])
    of_kind = lambda k: F.filter("__found", lambda x: x["base"] & (x["kind"] == k))
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select(
        F.col("__key").alias(key), *counts, F.sha2(F.encode(_written(base), "utf-8"), 256).alias("base_sha256"), _written(F.filter("__found", lambda x: votes.accepts(x, least))).alias("spans")
    )


def redact(df: DataFrame, text: str = "text", least: float = 0.9) -> DataFrame:
    """``df`` with each run of overlapping spans of ``text`` replaced by the first one's kind, like
    ``<EMAIL>``. Null texts stay null."""
    votes = fit(df.select(candidates(F.coalesce(F.col(text), F.lit(""))).alias("__found")))
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    whole = F.col(text)

    def cut_out(spans: Column, raw: Column) -> Column:
        """The bytes between runs of overlapping spans, and each run's first kind. A run begins where no
        span that began before ends later, and ends where no span that ends later began before."""
        lists = F.transform(F.sequence(F.lit(0), F.lit(2 * len(KINDS) - 1)), lambda k: F.filter(spans, lambda x: (x["kind"] * 2 + x["loose"]) == k))

        def pieces(by: Column) -> Column:
            inside = lambda at: F.exists(by, lambda b: _meets(b, at, at))
            # two spans may begin or end at one place: the first, by kind, names the run
            begins = F.filter(spans, lambda x, i: ~inside(x["start"]) & ((i == 0) | (F.get(spans, i - 1)["start"] != x["start"])))
            ends = F.array_sort(F.array_distinct(F.transform(F.filter(spans, lambda x: ~inside(x["end"])), lambda x: x["end"])))

            def written(b: Column, e: Column) -> Column:
                before = lambda i: F.when(i == 0, 0).otherwise(F.get(e, i - 1))
                part = lambda x, i: F.concat(F.substring(raw, before(i) + 1, x["start"] - before(i)).cast("string"), F.element_at(names, x["kind"] + 1))
                last = F.substring(raw, F.element_at(e, -1) + 1, F.lit(2**31 - 1)).cast("string")
                return F.concat(F.array_join(F.transform(b, part), ""), last)

            return let(begins, lambda b: let(ends, lambda e: written(b, e)))

        return let(lists, pieces)

    found = F.filter(candidates(whole, F.octet_length), lambda x: votes.accepts(x, least))
    chosen = let(found, lambda s: F.when(F.size(s) > 0, let(F.encode(whole, "utf-8"), lambda raw: cut_out(s, raw))).otherwise(whole))
    return df.withColumn(text, chosen)
