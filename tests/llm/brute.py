"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re

import regex

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text: str | None, width: int = 5) -> frozenset:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(low)
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def near_components(rows: list[tuple[int, str | None]], percent: int = 75) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, smallest linked doc_id)."""
    sets = [(doc, shingles(text)) for doc, text in rows]
    parent = {doc: doc for doc, _ in sets}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    where: dict[tuple, list[int]] = {}
    for i, (_, own) in enumerate(sets):
        for one in own:
            where.setdefault(one, []).append(i)
    for i, (doc, own) in enumerate(sets):
        for j in {j for one in own for j in where[one] if j > i}:
            both = len(own & sets[j][1])
            if 100 * both >= percent * len(own | sets[j][1]):
                a, b = root(doc), root(sets[j][0])
                parent[max(a, b)] = min(a, b)
    return {doc: (len(own), root(doc)) for doc, own in sets}


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str | None) -> list[str]:
    found = []
    for kind, pattern in BASE.items():
        for m in regex.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 16 <= len(digits) <= 19 and _luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}
            if good[kind]():
                found.append(f"{kind}:{m.start()}:{m.end()}")
    return found
