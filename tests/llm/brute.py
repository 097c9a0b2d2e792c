"""Plain versions of the operators, one row after another."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {65 + k: 97 + k for k in range(26)}


def shingles(text: str | None, width: int) -> set[tuple]:
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def near_components(rows: list[tuple], width: int, least: int = 80) -> dict[int, tuple[int, int]]:
    """doc_id -> (shingles, component) for rows of distinct ids."""
    sets = {i: shingles(t, width) for i, t in rows}
    up = {i: i for i in sets}

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    inverse = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in inverse[s])
        for j, n in shared.items():
            if 100 * n >= least * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                up[b] = a
        for s in sets[i]:
            inverse[s].append(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


def contained(docs: list[tuple], items: list[tuple]) -> set[tuple]:
    found = set()
    for i, t in docs:
        own = shingles(t, 5)
        for k, x in items:
            item = shingles(x, 5)
            if item and len(own & item) >= 0.8 * len(item):
                found.add((i, k, len(item), len(own & item)))
    return found


def conversations(rows: list[tuple]) -> dict[int, tuple]:
    """conv_id -> (turns, digest of turns, loss chars, loss digest) of rows (conv_id, turn, role, text)."""
    turns = defaultdict(list)
    for c, _, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        turns[c].append((role, text or ""))
    out = {}
    for c, v in turns.items():
        loss = "".join(x for r, x in v if r == "assistant")
        out[c] = (len(v), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in v).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out
