"""Fingerprints and their components, plainly: what the SimHash operator is held against."""

import re

import xxhash

WORDS = re.compile(rb"[^\x20\x09-\x0d]+")
UPPER = bytes(range(65, 91)), bytes(range(97, 123))


def fingerprint(text: str | None) -> int:
    words = WORDS.findall((text or "").encode().translate(bytes.maketrans(*UPPER)))
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: dict[int, int], radius: int = 3) -> dict[int, int]:
    """The smallest id reachable from each id; ``prints``: fingerprints by id."""
    root = {k: k for k in prints}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in prints}
