"""Operator 6: toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input joins a word vector (trained; words frequent enough in the sample) and a vector of
its hashed runs of four characters. A window of ``WINDOW`` words goes through gated recurrent units in
both directions; attention pools their states, and a linear layer gives the window's logit. All
overlapping windows, one from each word on that has ``WINDOW`` words, are scored, and the highest
counts for the text. Training, in numpy with hand-written gradients,
alternates between finding each document's highest windows and stepping on them. The first
coordinate of both vectors starts as a statistic of how much more often toxic documents hold the
word or run. The score is calibrated on sample documents that weren't trained on, weighted so
that classes count as in all labels.

Learning uses a bounded sample: of the labelled documents of at most ``longest`` characters that aren't
held out, the ``positives`` and ``negatives`` whose ids' hash is smallest; of an id's texts one. Scoring is a narrow map over
whole texts; a word's contribution to the gates is computed once and remembered in a memo of bounded
size, so a step costs little more than its small matrix product.

Defined results: null and empty texts are a window of padding and get a low score like any text
without toxic words; labels that are null, or of ids that no document has, aren't learned; a
document with several labels is toxic if one says so; rows with null ids aren't held out; repeated
rows are kept; without labels of both classes every score is the share of toxic labels (0 if there
are none); other columns are ignored (``keep`` keeps whole rows).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, batched, crc_remainder, slices

WINDOW = 16
UNITS, WORD, CHARS, BUCKETS = 8, 6, 4, 1 << 16
EDGES = ".,;:!?\"'()[]{}<>*#$%&|/\\-_=+~`"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def starts(n: int) -> list[int]:
    """Where the windows of a text of n words begin."""
    return list(range(max(1, n - WINDOW + 1)))


def grams(words: Sequence[str], length: int) -> np.ndarray:
    """Buckets of the runs of four characters of words of one length, with their edges."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), length + 2).astype(np.uint64)
    h, k = codes, min(4, length + 2)
    for i in range(1, k):
        h = h[:, :-1] * np.uint64(0x9E3779B97F4A7C15) + codes[:, i:]
    return ((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64)


def signal(have: np.ndarray, have_not: np.ndarray, n: int, m: int) -> np.ndarray:
    """By how many deviations, beyond 4, a feature's share of n toxic and m other documents differs."""
    p = (have + have_not + 1) / (n + m + 2)
    z = (have / n - have_not / m) / np.sqrt(p * (1 - p) * (1 / n + 1 / m))
    return np.sign(z) * np.maximum(0, np.abs(z) - 4).clip(max=8) / 2


class Network:
    """The parameters, and the memo of what words contribute to the gates."""

    def __init__(self, vocabulary: dict[str, int], words: np.ndarray, chars: np.ndarray, seed: int = 7, memo: int = 120_000):
        rng, width = np.random.default_rng(seed), WORD + CHARS
        self.vocabulary, self.chars, self.limit = vocabulary, chars.astype(np.float32), memo
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"words": words.astype(np.float32), "attend": np.zeros(2 * UNITS, np.float32), "out": draw(2 * UNITS), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"in_{side}": draw(width, 3 * UNITS), f"rec_{side}": draw(UNITS, 3 * UNITS), f"gate_{side}": np.r_[np.full(UNITS, -0.5), np.zeros(2 * UNITS)].astype(np.float32)}
        self.slope, self.offset, self.constant = 1.0, 0.0, None
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {"": 0}
        self.gates = np.zeros((4096, 6 * UNITS), np.float32)
        self.gates[0] = np.r_[self.p["gate_f"], self.p["gate_b"]]  # padding

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("rows", "gates")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def inputs(self, tokens: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers (0: none) and character vectors."""
        words = [t.strip(EDGES) for t in tokens]
        known, chars = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words)), np.zeros((len(words), CHARS), np.float32)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for n, at in by_length.items():
            for b in range(0, len(at), step := max(1, 400_000 // (n + 1))):
                some = at[b : b + step]
                chars[some] = self.chars[grams([words[i] for i in some], n)].sum(axis=1) / np.sqrt(max(1, n))
        return known, chars

    def project(self, known: np.ndarray, chars: np.ndarray) -> np.ndarray:
        x = np.c_[self.p["words"][known], chars]
        return np.c_[x @ self.p["in_f"] + self.p["gate_f"], x @ self.p["in_b"] + self.p["gate_b"]]

    def numbers(self, texts: Sequence[Sequence[str]]) -> list[np.ndarray]:
        if len(self.rows) > self.limit:
            self.forget()
        new: dict[str, None] = {}
        for words in texts:
            new.update(dict.fromkeys(w for w in words if w not in self.rows))
        if new:
            at = len(self.rows)
            while len(self.gates) < at + len(new):
                self.gates = np.concatenate([self.gates, np.zeros_like(self.gates)])
            self.gates[at : at + len(new)] = self.project(*self.inputs(list(new)))
            self.rows.update(zip(new, range(at, at + len(new))))
        return [np.fromiter(map(self.rows.__getitem__, w), np.int64, len(w)) for w in texts]

    def run(self, gates: np.ndarray, mask: np.ndarray | None, trace: dict | None = None) -> np.ndarray:
        """Logits of windows from what their words contribute: (WINDOW, windows, 6 UNITS)."""
        n, u = gates.shape[1], UNITS
        states = np.empty((WINDOW, n, 2 * u), np.float32)
        for side, first in (("f", 0), ("b", 1)):
            rec, h = self.p[f"rec_{side}"], np.zeros((n, u), np.float32)
            steps = range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1)
            for t in steps:
                g = gates[t, :, first * 3 * u : (first + 1) * 3 * u]
                zr = 0.5 + 0.5 * np.tanh(0.5 * (g[:, : 2 * u] + h @ rec[:, : 2 * u]))  # the logistic function
                z, r = zr[:, :u], zr[:, u:]
                c = np.tanh(g[:, 2 * u :] + (r * h) @ rec[:, 2 * u :])
                if trace is not None:
                    trace[side, t] = (h, z, r, c)
                h = h + z * (c - h)
                states[t, :, first * u : (first + 1) * u] = h
        score = states @ self.p["attend"]
        if mask is not None:
            score = np.where(mask, score, -1e4)
        a = np.exp(score - score.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", a, states)
        if trace is not None:
            trace |= {"states": states, "a": a, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def slopes(self, gates: np.ndarray, mask: np.ndarray, known: np.ndarray, x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[dict, float]:
        """Gradients of the weighted log-loss. known, x: word numbers and inputs by step and window."""
        u, t_ = UNITS, {}
        logit = self.run(gates, mask, t_)
        p = sigmoid(logit)
        loss = float(-(weight * (target * np.log(p + 1e-9) + (1 - target) * np.log(1 - p + 1e-9))).sum())
        d = (weight * (p - target)).astype(np.float32)
        states, a = t_["states"], t_["a"]
        pool = d[:, None] * self.p["out"]
        da = np.einsum("tnk,nk->tn", states, pool)
        ds = a * (da - (a * da).sum(axis=0))
        g = {"out": t_["pooled"].T @ d, "bias": d.sum(keepdims=True), "attend": np.einsum("tn,tnk->k", ds, states)}
        dstates = a[:, :, None] * pool[None] + ds[:, :, None] * self.p["attend"]
        dx = np.zeros_like(x)
        for side, first in (("f", 0), ("b", 1)):
            rec, drec = self.p[f"rec_{side}"], np.zeros((u, 3 * u), np.float32)
            dgates, dh = np.empty((*x.shape[:2], 3 * u), np.float32), np.zeros((x.shape[1], u), np.float32)
            steps = range(WINDOW - 1, -1, -1) if side == "f" else range(WINDOW)
            for t in steps:
                h, z, r, c = t_[side, t]
                dh = dh + dstates[t, :, first * u : (first + 1) * u]
                dc = dh * z * (1 - c * c)
                back = dc @ rec[:, 2 * u :].T
                dzr = np.c_[dh * (c - h) * z * (1 - z), back * h * r * (1 - r)]
                drec[:, 2 * u :] += (r * h).T @ dc
                drec[:, : 2 * u] += h.T @ dzr
                dh = dh * (1 - z) + back * r + dzr @ rec[:, : 2 * u].T
                dgates[t] = np.c_[dzr, dc]
            flat = dgates.reshape(-1, 3 * u)
            g |= {f"rec_{side}": drec, f"gate_{side}": flat.sum(axis=0), f"in_{side}": x.reshape(-1, x.shape[2]).T @ flat}
            dx += dgates @ self.p[f"in_{side}"].T
        g["words"] = np.zeros_like(self.p["words"])
        np.add.at(g["words"], known.reshape(-1), dx[:, :, :WORD].reshape(-1, WORD))
        g["words"][0] = 0
        return g, loss

    def sweep(self, numbers: np.ndarray) -> np.ndarray:
        """Logits of the windows from every word of a row of words on. Neighbours share their words' gates,
        so a step of all windows reads one slice; only each state's attention and output are kept."""
        u, n = UNITS, len(numbers) - WINDOW + 1
        # a row per unit: numpy's inner loops then run along the windows
        gates, pad, out = np.ascontiguousarray(self.gates[numbers].T), numbers == 0, np.empty(n, np.float32)
        sides = []
        for side, first in (("f", 0), ("b", 1)):
            g, rec = gates[3 * u * first : 3 * u * (first + 1)], self.p[f"rec_{side}"].T.copy()
            g[: 2 * u] *= 0.5  # the logistic function is half a tanh of half the argument
            rec[: 2 * u] *= 0.5
            ends = np.stack([self.p["attend"], self.p["out"]])[:, first * u : (first + 1) * u]
            sides.append((g, rec[: 2 * u].copy(), rec[2 * u :].copy(), ends, range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1)))
        for at in range(0, n, 4096):
            m = min(4096, n - at)
            told = np.zeros((WINDOW, 2, m), gates.dtype)
            zr, c = np.empty((2 * u, m), gates.dtype), np.empty((u, m), gates.dtype)
            for g, rec_zr, rec_c, ends, steps in sides:
                h = np.zeros((u, m), gates.dtype)
                for t in steps:
                    own = g[:, at + t : at + t + m]
                    np.matmul(rec_zr, h, out=zr)
                    zr += own[: 2 * u]
                    np.tanh(zr, out=zr)
                    zr *= 0.5
                    zr += 0.5
                    zr[u:] *= h
                    np.matmul(rec_c, zr[u:], out=c)
                    c += own[2 * u :]
                    np.tanh(c, out=c)
                    c -= h
                    c *= zr[:u]
                    h += c
                    told[t] += ends @ h
            score = told[:, 0]
            if pad[at : at + m + WINDOW - 1].any():
                score = np.where(np.stack([pad[at + t : at + t + m] for t in range(WINDOW)]), -1e4, score)
            a = np.exp(score - score.max(axis=0))
            out[at : at + m] = (a * told[:, 1]).sum(axis=0) / a.sum(axis=0) + self.p["bias"][0]
        return out

    def logits(self, texts: Sequence[str | None], best: int = 1) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each text's highest logit, and where its ``best`` highest windows that don't overlap begin."""
        words = [(t or "").lower().split() for t in texts]
        sizes = [max(len(w), WINDOW) for w in words]
        offsets = np.cumsum([0, *sizes])
        flat = np.zeros(offsets[-1], np.int64)
        for at, own in zip(offsets, self.numbers(words)):
            flat[at : at + len(own)] = own
        every, high, where = self.sweep(flat) if texts else None, np.empty(len(texts)), []
        for i, (at, n) in enumerate(zip(offsets, sizes)):
            own = every[at : at + n - WINDOW + 1]
            high[i] = own.max()
            if best == 1:
                where.append(own.argmax(keepdims=True))
                continue
            left, found = own.copy(), []
            while len(found) < best and left.max() > -np.inf:
                k = int(left.argmax())
                found.append(k)
                left[max(0, k - WINDOW + 1) : k + WINDOW] = -np.inf
            where.append(np.array(found))
        return high, where

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out = [sigmoid(self.slope * self.logits(texts[b : b + 64])[0] + self.offset) for b in range(0, len(texts), 64)]
        return np.concatenate(out) if out else np.empty(0)


def train(texts: Sequence[str], toxic: Sequence[int], shares: tuple[float, float], least: int = 4, size: int = 20_000, rounds: int = 5, epochs: int = 2, seed: int = 7) -> Network:
    """A network that tells ``texts`` apart. shares: of the classes 0 and 1 among all labels."""
    y = np.asarray(toxic)
    if not len(y) or y.min() == y.max():
        net = Network({}, np.zeros((1, WORD)), np.zeros((BUCKETS, CHARS)))
        net.constant = shares[1]
        return net
    words = [t.lower().split() for t in texts]
    check = np.zeros(len(y), bool)
    for side in (0, 1):  # every fourth of each class calibrates
        check[np.flatnonzero(y == side)[3::4]] = True
    fit = np.flatnonzero(~check)
    n, m = int(y[fit].sum()), int((1 - y[fit]).sum())
    counts: list[Counter] = [Counter(), Counter()]
    runs = np.zeros((2, BUCKETS))
    for i in fit:
        own = {w.strip(EDGES) for w in words[i]} - {""}
        counts[y[i]].update(own)
        seen = np.zeros(BUCKETS, bool)
        by_length: dict[int, list[str]] = {}
        for w in own:
            by_length.setdefault(len(w), []).append(w)
        for k, ws in by_length.items():
            seen[grams(ws, k).reshape(-1)] = True
        runs[y[i]] += seen
    total = counts[0] + counts[1]
    common = sorted((w for w, c in total.items() if c >= least), key=lambda w: (-total[w], w))[:size]
    rng = np.random.default_rng(seed)
    vectors = rng.standard_normal((len(common) + 1, WORD)) * 0.01
    vectors[1:, 0] = signal(np.array([counts[1][w] for w in common]), np.array([counts[0][w] for w in common]), n, m)
    vectors[0] = 0
    chars = rng.standard_normal((BUCKETS, CHARS)) * 0.004
    chars[:, 0] = signal(runs[1], runs[0], n, m)
    net = Network({w: i for i, w in enumerate(common, 1)}, vectors, chars, seed)
    moments: dict[str, tuple] = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for _ in range(rounds):
        net.forget()
        some: list[tuple[int, int]] = []
        for b in range(0, len(fit), 64):
            part = fit[b : b + 64]
            for i, begins in zip(part, net.logits([texts[i] for i in part], 3)[1]):
                some += [(int(i), int(s)) for s in begins[: 1 if y[i] else 3]]
        for _ in range(epochs):
            order = rng.permutation(len(some))
            for b in range(0, len(order), 128):
                own = [some[j] for j in order[b : b + 128]]
                tokens = [(words[i][s : s + WINDOW] + [""] * WINDOW)[:WINDOW] for i, s in own]
                flat = [w for row in tokens for w in row]
                known, rows = net.inputs(flat)
                known, rows = known.reshape(len(own), WINDOW).T, rows.reshape(len(own), WINDOW, CHARS).transpose(1, 0, 2)
                mask = np.array([[w != "" for w in row] for row in tokens]).T
                mask[0] |= ~mask.any(axis=0)
                x = np.concatenate([net.p["words"][known], rows], axis=2) * mask[:, :, None]
                gates = np.concatenate([x @ net.p["in_f"] + net.p["gate_f"], x @ net.p["in_b"] + net.p["gate_b"]], axis=2)
                target = y[[i for i, _ in own]].astype(np.float32)
                weight = np.where(target == 1, 0.5 / max(1, target.sum()), 0.5 / max(1, (1 - target).sum())).astype(np.float32)
                slopes, _ = net.slopes(gates, mask, known, x, target, weight)
                step += 1
                for k, g in slopes.items():
                    first, second = moments[k]
                    first += 0.1 * (g - first)
                    second += 0.01 * (g * g - second)
                    net.p[k] = net.p[k] - ((0.0005 if k == "words" else 0.02) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    net.forget()
    held = np.flatnonzero(check) if 0 < y[check].sum() < check.sum() else np.arange(len(y))
    high = np.concatenate([net.logits([texts[i] for i in held[b : b + 64]])[0] for b in range(0, len(held), 64)])
    net.slope, net.offset = _calibrate(high, y[held], shares)
    return net


def _calibrate(logit: np.ndarray, y: np.ndarray, shares: tuple[float, float], steps: int = 500) -> tuple[float, float]:
    """A slope from 0.3 to 3 and an offset that fit outcomes, with the classes' weights as in ``shares``."""
    weight = np.where(y == 1, shares[1] / max(1, y.sum()), shares[0] / max(1, (1 - y).sum()))
    logit, slope, offset = np.clip(logit, -15, 15), 1.0, 0.0
    for _ in range(steps):
        miss = weight * (sigmoid(slope * logit + offset) - y)
        slope = float(np.clip(slope - 0.5 * (miss * logit).sum() / 10, 0.3, 3))
        offset -= 2.0 * miss.sum()
    return slope, float(offset)


def held_out(key: str) -> Column:
    return F.coalesce(crc_remainder(key, 5) == 0, F.lit(False))


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", positives: int = 500, negatives: int = 1000, longest: int = 50_000) -> Network:
    marks = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__y")).where(F.col("__key").isNotNull() & F.col("__y").isin(0, 1) & ~held_out("__key"))
    marks = marks.groupBy("__key").agg(F.max("__y").alias("__y"))
    totals = {r[0]: r[1] for r in marks.groupBy("__y").agg(F.count("*")).collect()}
    if not totals:
        return train([], [], (1.0, 0.0))
    docs = df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text")).where(F.col("__text").isNotNull() & (F.length("__text") <= longest))
    marks = marks.join(docs.select("__key"), "__key", "left_semi")  # only ids move
    order = [F.xxhash64("__key", F.lit("toxic")), F.col("__key")]
    chosen = None
    for side, n in ((1, positives), (0, negatives)):
        part = marks.where(F.col("__y") == side).orderBy(*order).limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    # chosen has at most `positives + negatives` rows, and so has the result: one text an id
    rows = docs.join(F.broadcast(chosen), "__key").groupBy("__key", "__y").agg(F.min("__text").alias("__text")).collect()
    rows.sort(key=lambda r: (str(r["__key"]), r["__text"]))
    n = sum(totals.values())
    return train([r["__text"] for r in rows], [r["__y"] for r in rows], (totals.get(0, 0) / n, totals.get(1, 0) / n))


def score(df: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score and predicted of every row."""

    shared = Shared(net)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        own = shared.get()
        for b in slices(batches):
            s = own.score(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=[key, "held_out", "score", "predicted"])

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, held_out boolean, score double, predicted int"
    return batched(df.select(F.col(key), held_out(key).alias("__held"), F.col(text).cast("string"))).mapInArrow(run, schema)


def keep(df: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """The whole rows of ``df`` whose text isn't predicted to be toxic."""
    at, shared = df.columns.index(text), Shared(net)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        own = shared.get()
        for b in slices(batches):
            yield b.filter(pa.array(own.score(b.column(at).to_pylist()) < 0.5))

    return batched(df).mapInArrow(run, df.schema)
