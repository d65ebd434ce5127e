"""Awkward rows that every operator must take, and plain-Python versions of the contracts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, n: int) -> str:
    """`n` invented words, the same for a seed."""
    state, out = seed * 2654435761 + 12345, []
    for _ in range(n):
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append("".join("aeiou"[state >> (8 + 6 * i) & 3] + "bdfgklmnprst"[(state >> (9 + 6 * i)) % 12] for i in range(1 + (state >> 60) % 3)))
    return " ".join(out)


def awkward_documents() -> list[tuple]:
    base, long = prose(1, 60), prose(2, 6000)
    words = base.split(" ")
    rows = [
        (1, base),
        (2, base),
        (3, " ".join([*words[:30], "CHANGED", *words[31:]])),
        (4, base.upper()),
        (5, None),
        (6, ""),
        (7, " \t\n\x0b "),
        (8, "one two"),
        (9, "ONE  two"),
        (10, "four words are here"),
        (11, long),
        (12, "start " + long[: len(long) // 2]),
        (13, prose(3, 20) + " " + base + " " + prose(4, 20)),
        (14, "x" * 70_000 + " " + "y" * 70_000),
        (15, prose(5, 14)),
        (15, prose(5, 14)),
        (15, prose(6, 14)),
        (None, base),
        (None, None),
        (16, "Ünïcödé wörds …     stay 你好 世界 " + prose(7, 15)),
        (17, "12 345 ... 67"),
        (18, " ".join(["same"] * 40)),
        (19, " ".join(["same"] * 30)),
    ]
    langs, sources = ["en", None, "de"], ["src0", "src0", "src1", None]
    return [(i, t, langs[n % 3], sources[n % 4], None if t is None else len(t)) for n, (i, t) in enumerate(rows)]


def shingles(text: str | None) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard_components(rows: list[tuple]) -> Counter:
    """Counter of (doc_id, n_shingles, component_id); rows of one id are one document."""
    rows = [(r[0], shingles(r[1])) for r in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(i, s) for i, s in rows if i is not None and s]
    for a, (i, s) in enumerate(known):
        for j, t in known[:a]:
            if 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return Counter((i, len(s), None if i is None else find(i) if s else i) for i, s in rows)


def removed_words(rows: list[tuple], size: int = 13) -> Counter:
    """Counter of (doc_id, n_words, n_removed, kept_sha256)."""
    words = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    first: dict[tuple, int] = {}
    for i, w in words:
        if i is not None:
            for p in range(len(w) - size + 1):
                key = tuple(w[p : p + size])
                first[key] = min(i, first.get(key, i))
    out = Counter()
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if i is not None and first[tuple(w[p : p + size])] < i:
                gone[p : p + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[(i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out
