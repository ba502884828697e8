"""Operator 3: language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary (a SentencePiece model's
letter pieces, in lower case, with the mark of a word's start). The probability of a word is the
sum, over all its segmentations into pieces, of the product of their probabilities, by the forward
algorithm; pieces never reach across words, so a text's is the product over its words, which are
runs of letters. Letters outside the vocabulary count as a piece of small fixed probability.

Learning: expectation-maximisation by the forward-backward algorithm over word counts, gathered on
the executors from a bounded sample: each language's documents are taken with a probability that
gives ``sample`` of them on average, by the 64-bit hash of their ids, and of each language the
``words`` most frequent words. Every language is learned, each in a task of its own; the driver holds
a number per piece and language, about 80 KB a language. Words longer than ``CUT`` letters are learned
from in parts of that length, and scored whole.

Scoring is a narrow map over whole texts. Words' scores are computed in batches and remembered in a
memo of bounded size. ``score`` is the posterior probability of the language that is returned
(``und``: 0), with equal priors.

Defined results: null texts and texts without letters (characters of Unicode's letter categories) are
``und`` with score 0; if no language can be learned, all texts are; ties go to the language that sorts
first; rows with null ids are not held out and never learned from; repeated rows are kept; a very long
text is held by one task as its words, 256 texts at a time at most; other columns are ignored (``keep``
keeps whole rows); an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, batched, crc_remainder, held, slices

UND = "und"
MARK = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
LONGEST, CUT = 10, 40
UNKNOWN = 1e-7
BASE = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str) -> list[str]:
    """The runs of letters of a text; the pattern also takes numerals like \u00bd and \u2167, which are none."""
    found = LETTERS.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in ("".join(c if c.isalpha() else " " for c in x).split())]


class Lexicon:
    """Pieces by the hash of their characters: tables without collisions, tried one after another."""

    def __init__(self, pieces: Sequence[str], slots: int = 1 << 18):
        self.pieces = list(pieces)
        self.shift, self.tables = np.uint64(64 - slots.bit_length() + 1), []
        hashes = np.array([self.hash(p) for p in self.pieces], dtype=np.uint64)
        left = np.arange(len(hashes))
        while len(left):
            ids, keys = np.full(slots, -1, np.int32), np.zeros(slots, np.uint64)
            at = self.slot(hashes[left], len(self.tables))
            _, first = np.unique(at, return_index=True)
            ids[at[first]], keys[at[first]] = left[first], hashes[left[first]]
            self.tables.append((ids, keys))
            left = np.delete(left, first)
        self.known = {p for p in self.pieces if len(p) == 1}

    @staticmethod
    def hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def slot(self, hashes: np.ndarray, k: int) -> np.ndarray:
        return ((hashes ^ (hashes >> np.uint64(29))) * np.uint64(2 * k + 0xBF58476D1CE4E5B9)) >> self.shift

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(hashes.shape, -1, np.int32)
        for k, (ids, keys) in enumerate(self.tables):
            at = self.slot(hashes, k)
            out = np.where((keys[at] == hashes) & (ids[at] >= 0), ids[at], out)
        return out

    def lattice(self, words: Sequence[str], length: int) -> np.ndarray:
        """Pieces (-1: none) of words of ``length`` characters, by word, end - 1 and size - 1."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length).astype(np.uint64) + np.uint64(1)
        most = min(LONGEST, length)
        out = np.full((len(words), length, most), -1, np.int32)
        hashes = codes
        for size in range(1, most + 1):
            if size > 1:
                hashes = hashes[:, :-1] * BASE + codes[:, size - 1 :]
            out[:, size - 1 :, size - 1] = self.find(hashes)
        return out


def vocabulary(path: str) -> list[str]:
    """The model's pieces of lower-case letters, with or without a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted({p for p in pieces if len(p) <= LONGEST and p == p.lower() and (p == MARK or p.removeprefix(MARK).isalpha())})


def forward(lattice: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """Log-probabilities by word and language, the sum over all segmentations, rescaled at each step.
    ``probability``: by piece and language; the last row stands for no piece."""
    n, length, most = lattice.shape
    k = probability.shape[1]
    recent = np.zeros((most + 1, n, k))  # a ring of the last forward sums, all on the scale of `log`
    recent[0] = 1
    log = np.zeros((n, k))
    for end in range(1, length + 1):
        total = np.zeros((n, k))
        for size in range(1, min(most, end) + 1):
            p = probability[lattice[:, end - 1, size - 1]]
            if size == 1:
                p = np.maximum(p, UNKNOWN)
            total += recent[(end - size) % (most + 1)] * p
        recent[end % (most + 1)] = total
        scale = np.maximum(recent.max(axis=0), 1e-300)
        if end == length or end % 8 == 0:
            recent /= scale
            log += np.log(scale)
    return log + np.log(np.maximum(recent[length % (most + 1)], 1e-300))


def learn(lexicon: Lexicon, words: dict[str, int], steps: int = 6, prior: float = 0.05) -> np.ndarray:
    """Piece probabilities that fit word counts, by expectation-maximisation."""
    parts: Counter = Counter()
    for w, n in words.items():
        for at in range(0, len(w), CUT):
            parts[w[at : at + CUT]] += n
    words, by_length = parts, {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    lattices = [(lexicon.lattice(ws, n), np.array([words[w] for w in ws], dtype=float)) for n, ws in by_length.items()]
    size = len(lexicon.pieces)
    p = np.append(np.full(size, 1 / size), 0.0)
    for _ in range(steps):
        counts = np.full(size + 1, prior)
        for lattice, times in lattices:
            n, length, most = lattice.shape
            arcs = p[lattice]
            arcs[:, :, 0] = np.maximum(arcs[:, :, 0], UNKNOWN)
            ahead, behind = np.zeros((n, length + 1)), np.zeros((n, length + 1))
            ahead[:, 0] = behind[:, length] = 1
            for end in range(1, length + 1):
                for s in range(1, min(most, end) + 1):
                    ahead[:, end] += ahead[:, end - s] * arcs[:, end - 1, s - 1]
            for start in range(length - 1, -1, -1):
                for s in range(1, min(most, length - start) + 1):
                    behind[:, start] += behind[:, start + s] * arcs[:, start + s - 1, s - 1]
            total = times / np.maximum(ahead[:, length], 1e-300)
            for end in range(1, length + 1):
                for s in range(1, min(most, end) + 1):
                    expected = ahead[:, end - s] * arcs[:, end - 1, s - 1] * behind[:, end] * total
                    np.add.at(counts, lattice[:, end - 1, s - 1], expected)
        counts[-1] = 0
        p = counts / counts.sum()
    return p


class LanguageModel:
    def __init__(self, languages: Sequence[str], lexicon: Lexicon, probability: np.ndarray, memo: int = 1_000_000):
        """``memo``: how many scores are remembered, over all languages."""
        self.languages, self.lexicon, self.probability, self.memo = list(languages), lexicon, probability, memo
        self.limit = max(1_000, memo // (len(self.languages) + 1))
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((4096, len(self.languages) + 1))  # the last column counts letters

    def __getstate__(self):
        return self.languages, self.lexicon.pieces, self.probability, self.memo

    def __setstate__(self, state):
        languages, pieces, probability, memo = state
        self.__init__(languages, Lexicon(pieces), probability, memo)

    def add(self, tokens: Sequence[str]) -> None:
        """Scores of tokens that the memo doesn't have."""
        at = len(self.rows)
        while len(self.scores) < at + len(tokens):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[at : at + len(tokens)] = 0
        by_length: dict[int, list[tuple[int, str]]] = {}
        for i, t in enumerate(tokens, at):
            self.rows[t] = i
            for w in (t,) if t.isalpha() else letters(t):
                by_length.setdefault(len(w) + 1, []).append((i, MARK + w))
        for n, found in by_length.items():
            for b in range(0, len(found), step := max(1, 800_000 // (n * max(4, len(self.languages))))):
                some = found[b : b + step]
                logs = forward(self.lexicon.lattice([w for _, w in some], n), self.probability)
                np.add.at(self.scores, [i for i, _ in some], np.c_[logs, np.full(len(some), n - 1.0)])

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
        languages, scores = [], []
        for at in range(0, len(texts), 256):  # so that new words are scored many at a time
            some = [(t or "").lower().split() for t in texts[at : at + 256]]
            if len(self.rows) > self.limit:
                self.clear()
            new: dict[str, None] = {}
            for words in some:
                new.update(dict.fromkeys(w for w in words if w not in self.rows))
            if new:
                self.add(list(new))
            for words in some:
                sums = self.scores[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))].sum(axis=0)
                if not sums[-1] or not self.languages:
                    languages.append(UND)
                    scores.append(0.0)
                else:
                    best = int(sums[:-1].argmax())
                    languages.append(self.languages[best])
                    scores.append(float(1 / np.exp(sums[:-1] - sums[best]).sum()))
        return languages, scores


def held_out(key: str) -> Column:
    return F.coalesce(crc_remainder(key, 3) == 1, F.lit(False))


def fit(df: DataFrame, pieces: str, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 600, words: int = 20_000) -> LanguageModel:
    """A model of ``df``'s languages, from rows that aren't held out. ``pieces``: a SentencePiece
    model's path, the same on all machines."""
    rows = df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"), F.col(lang).cast("string").alias("__lang"))
    rows = rows.where(F.col("__lang").isNotNull() & (F.col("__lang") != UND) & F.col("__text").isNotNull() & F.col("__key").isNotNull() & ~held_out("__key"))
    sizes = {r[0]: r[1] for r in rows.groupBy("__lang").agg(F.count("*")).collect()}  # a row per language
    lexicon = Lexicon(vocabulary(pieces))
    if not sizes:
        return LanguageModel([], lexicon, np.zeros((len(lexicon.pieces) + 1, 0)))
    share = df.sparkSession.createDataFrame([(k, threshold(sample, n)) for k, n in sizes.items()], "__lang string, __most long")
    # a row per language, so its size is known here; a shuffle would take whole texts to one task a language
    share = F.broadcast(share) if len(sizes) <= 100_000 else share
    chosen = rows.join(share, "__lang").where(F.xxhash64("__key", F.lit("lang")) <= F.col("__most"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in slices(batches):
            seen: dict[str, Counter] = {}
            for name, t in zip(b.column(0).to_pylist(), b.column(1)):
                seen.setdefault(name, Counter()).update(letters(t.as_py().lower()))
            flat = [(k, w, n) for k, c in seen.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["__lang", "word", "n"])

    def one(names: tuple, counted: pd.DataFrame) -> pd.DataFrame:
        own = held(("lexicon", pieces), lambda: Lexicon(vocabulary(pieces)))
        counted = counted.sort_values(["n", "word"], ascending=[False, True])
        learned = learn(own, dict(zip((MARK + counted["word"]).tolist(), counted["n"].tolist())))
        return pd.DataFrame({"__lang": [names[0]], "p": [learned.astype(np.float64).tobytes()]})

    counted = batched(chosen.select("__lang", "__text")).mapInArrow(count, "__lang string, word string, n long").groupBy("__lang", "word").agg(F.sum("n").alias("n"))
    often = F.row_number().over(Window.partitionBy("__lang").orderBy(F.desc("n"), "word"))
    top = counted.withColumn("__rank", often).where(F.col("__rank") <= words).select("__lang", "word", "n")
    found = {r[0]: np.frombuffer(r[1]) for r in top.groupBy("__lang").applyInPandas(one, "__lang string, p binary").collect()}
    languages = sorted(found)
    probability = np.stack([found[k] for k in languages], axis=1) if languages else np.zeros((len(lexicon.pieces) + 1, 0))
    return LanguageModel(languages, lexicon, probability)


def threshold(sample: int, n: int) -> int:
    """The signed 64-bit hash up to which rows are taken, so that of n rows ``sample`` are on average."""
    return min(2**63 - 1, sample * 2**64 // n - 2**63)


def identify(df: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, lang_pred and score of every row."""
    shared = Shared(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        own = shared.get()
        for b in slices(batches):
            found = own.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(found[0], pa.string()), pa.array(found[1], pa.float64())], names=[key, "held_out", "lang_pred", "score"])

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    return batched(df.select(F.col(key), held_out(key).alias("__held"), F.col(text).cast("string"))).mapInArrow(run, schema)


def keep(df: DataFrame, model: LanguageModel, least: float = 0.5, text: str = "text") -> DataFrame:
    """The whole rows of ``df`` that have a language with a score of ``least`` or more."""
    at, shared = df.columns.index(text), Shared(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        own = shared.get()
        for b in slices(batches):
            languages, scores = own.predict(b.column(at).to_pylist())
            yield b.filter(pa.array([x != UND and s >= least for x, s in zip(languages, scores)], pa.bool_()))

    return batched(df).mapInArrow(run, df.schema)
