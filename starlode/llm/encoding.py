"""Tokenisers that cut texts where no token can reach across and encode the fragments alone.

Both read a ``tokenizers`` JSON file whose path is a parameter; results equal that library's with
``add_special_tokens=False`` and without truncation or padding (compared in ``tests/llm``).

* A byte pair that occurs inside no token of the vocabulary marks a certain cut: no merge can join
  its two bytes, so merging left and right of it is independent (``ForcedBoundaryEncoder``).
* With word ends, texts are first cut at blanks, whose pieces repeat so often that a bounded memo
  saves most work.
* In a byte-level vocabulary a blank before anything but white space begins a piece, so stretches of
  words that tiktoken and the library read alike are encoded by the former, the others one by one.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterable
from itertools import groupby

import regex
import tiktoken
from tokenizers import Tokenizer

from .common import held

GENERATION = 150_000
#: Characters up to U+00FF: here Python, tiktoken and tokenizers agree on classes and case.
GPT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+""")
ODD_BLANKS = "\x1c\x1d\x1e\x1f"
BEFORE_WORD = re.compile(r"(?= \S)")


class Memo(dict):
    """What ``make`` gives for a key, remembered for at least the last ``generation`` keys: when the
    young half is full, it becomes the old half."""

    def __init__(self, make: Callable[[str], bytes], generation: int = GENERATION):
        self.make, self.generation, self.old = make, generation, {}

    def __missing__(self, key: str) -> bytes:
        if (value := self.old.get(key)) is None:
            value = self.make(key)
        self[key] = value
        return value

    def all(self, keys: Iterable[str]) -> bytes:
        out = b"".join(map(self.__getitem__, keys))
        if len(self) >= self.generation:
            self.old = dict(self)
            self.clear()
        return out


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Vocabulary:
    """A BPE vocabulary as bytes. ``end`` (0xFF, never part of UTF-8) stands for the suffix that
    marks a word's end. Ranks are token ids, which must follow the order of the merges."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(self.library.to_str())
        model, to_byte = spec["model"], byte_of_char()
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        order = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(a >= b for a, b in zip(order, order[1:])):
            raise ValueError("token ids don't follow the order of the merges")
        self.ranks: dict[bytes, int] = {}
        inside: set[tuple[int, int]] = set()
        for token, k in model["vocab"].items():
            if token in self.special:
                continue
            ended = bool(self.suffix) and token.endswith(self.suffix)
            raw = bytes(to_byte[c] for c in (token[: -len(self.suffix)] if ended else token))
            inside.update(zip(raw, raw[1:]))
            self.ranks[raw + b"\xff" if ended else raw] = k
        self.never = {(a, b) for a in range(256) for b in range(256)} - inside
        size = max(k for k in [*model["vocab"].values(), *self.special.values()]) + 1
        self.token = [self.library.id_to_token(k) or "" for k in range(size)]
        self.bpe = tiktoken.Encoding(path, pat_str=GPT_PATTERN, mergeable_ranks=self.ranks, special_tokens={})._core_bpe
        self.splits = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def parts(self, text: str) -> Iterable[tuple[str, int | None]]:
        """The text between special tokens' strings, and those tokens' ids."""
        at = 0
        if self.splits is not None and any(s in text for s in self.special):
            for m in self.splits.finditer(text):
                if m.start() > at:
                    yield text[at : m.start()], None
                yield m[0], self.special[m[0]]
                at = m.end()
        if at < len(text):
            yield text[at:], None


class ForcedBoundaryEncoder:
    """For vocabularies with word ends (NFC, one blank for white space, lower case, words)."""

    def __init__(self, path: str, generation: int = GENERATION):
        self.vocabulary = Vocabulary(path)
        self.memo = Memo(self.word, generation)

    def fragments(self, piece: bytes) -> list[bytes]:
        """``piece`` cut between all byte pairs that no token holds."""
        never = self.vocabulary.never
        if never.isdisjoint(zip(piece, piece[1:])):
            return [piece]
        at, out = 0, []
        for k, pair in enumerate(zip(piece, piece[1:]), 1):
            if pair in never:
                out.append(piece[at:k])
                at = k
        out.append(piece[at:])
        return out

    def pieces(self, word: str) -> list[bytes]:
        if word.isalpha() and is_latin(word):
            return [word.encode()]
        if is_latin(word):
            return [x.encode() for x in WORD_PATTERN.findall(word)]
        to_byte = byte_of_char()
        return [bytes([to_byte[c] for c in x]) for x, _ in self.vocabulary.library.pre_tokenizer.pre_tokenize_str(word)]

    def word(self, word: str) -> bytes:
        """A word's ids, as little-endian unsigned integers."""
        if word[:-1].isalpha() and not word[-1].isalnum() and is_latin(word):
            return self[word[:-1]] + self[word[-1]]
        ids: list[int] = []
        encode, end = self.vocabulary.bpe.encode_single_piece, b"\xff" if self.vocabulary.suffix else b""
        for piece in self.pieces(word):
            *first, last = self.fragments(piece)
            for x in first:
                ids += encode(x)
            ids += encode(last + end)
        return array("I", ids).tobytes()

    def words(self, text: str) -> list[str]:
        if not is_latin(text):
            text = self.vocabulary.library.normalizer.normalize_str(text)
            return [w for w in text.split(" ") if w]
        if any(c in text for c in ODD_BLANKS):
            return [w for w in re.split("[\t-\r \x85\xa0]+", text.lower()) if w]
        return text.lower().split()

    def __getitem__(self, word: str) -> bytes:
        return self.memo[word]

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, four bytes each."""
        return b"".join([self.memo.all(self.words(x)) if k is None else k.to_bytes(4, "little") for x, k in self.vocabulary.parts(text or "")])

    def decode(self, ids: bytes) -> str:
        """What the library's ``decode`` gives without a decoder: the tokens, joined by blanks."""
        return " ".join(map(self.vocabulary.token.__getitem__, array("I", ids)))


class BlankBoundaryEncoder:
    """For byte-level vocabularies. A blank before anything but white space begins a piece: the pattern
    leaves the last blank of a run to what follows. Texts that are not plain are cut there."""

    def __init__(self, path: str, generation: int = 20_000):
        self.vocabulary = Vocabulary(path)
        self.memo = Memo(self.other, generation)

    def is_plain(self, text: str) -> bool:
        """Whether tiktoken and the library agree on the classes of all its characters."""
        return is_latin(text) and not any(c in text for c in ODD_BLANKS)

    def plain(self, text: str) -> bytes:
        return self.vocabulary.bpe.encode_to_tiktoken_buffer(text, set())

    def other(self, text: str) -> bytes:
        return array("I", self.vocabulary.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, four bytes each."""
        out = []
        for part, special in self.vocabulary.parts(text or ""):
            if special is not None:
                out.append(special.to_bytes(4, "little"))
            elif self.is_plain(part):
                out.append(self.plain(part))
            else:
                for same, words in groupby(BEFORE_WORD.split(part), self.is_plain):
                    out.append(self.plain("".join(words)) if same else self.memo.all(words))
        return b"".join(out)


def encoder(kind: type, path: str):
    """The encoder of a file, kept by the Python worker."""
    return held((kind.__name__, path), lambda: kind(path))
