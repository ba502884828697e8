"""The base spans, plainly: what the native operator is held against."""

import hashlib
import re

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def passes(kind: str, match: str) -> bool:
    digits = [int(c) for c in re.sub("[^0-9]", "", match)]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text: str | None) -> list[tuple[int, int, str, int]]:
    found = [(m.start(), i, kind, m.end()) for i, (kind, p) in enumerate(BASE.items()) for m in p.finditer(text or "") if passes(kind, m[0])]
    return sorted(found)


def digest(spans: list[tuple[int, int, str, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()
