"""Spelling variants against plain versions, and their defined cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from assetweave.llm import spelling


def plain_words(rows: list[tuple]) -> dict[str, int]:
    lower = {65 + k: 97 + k for k in range(26)}
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows: list[tuple]) -> set[tuple]:
    n = plain_words(rows)
    out, form = set(), {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
        out.add((w, n[w], len(others)))
    root = {}
    for w in n:
        r = w
        while form[r]:
            r = form[r]
        root[w] = r
    return {(w, form[w], root[w], k, near_n, n.get(form[w])) for w, k, near_n in out}


def made(spark, rows: list[tuple]) -> set[tuple]:
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    return {tuple(r) for r in spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()}


def edited(rng: random.Random, w: str) -> str:
    k, c = rng.randrange(len(w) + 1), rng.choice("abcxyzéÿß÷")
    return rng.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]])


@pytest.mark.parametrize("seed", [0, 1])
def test_variants_equal_plain_ones(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcéÀx" if seed else "abcdefghij", k=rng.randint(6, 12))) for _ in range(40)]
    pool = base + [edited(rng, w) for w in base for _ in range(4)] + ["prefixed" + w for w in base]
    rows = [(rng.choice([None, *range(60)]), rng.choice([" ", "-", "9", "\n", "×", "_"]).join(rng.choices(pool, weights=[50 if k < 40 else 3 for k in range(len(pool))], k=rng.randint(0, 60)))) for _ in range(400)]
    rows += [(5, None), (5, ""), (6, "SHOUTING Shouting shouting " * 4), (7, "shoutin shoutin shoutin shoutin shoutin"), (8, "abcdefg" * 3000)]
    assert made(spark, rows) == plain(rows)


def test_no_pair_is_lost(spark, monkeypatch):
    """Words whose grams are nearly all frequent, with every kind of edit at every place, against all pairs."""
    rng = random.Random(7)
    pool = set()
    for stem in ("aaaaaa", "abababab", "internation", "préfixe", "zzzzzzzz"):
        for tail in ("", "a", "ab", "ation", "ations"):
            w = stem + tail
            pool |= {w, *(edited(rng, w) for _ in range(25)), *(edited(rng, edited(rng, w)) for _ in range(10))}
    pool = sorted(w for w in pool if len(w) >= 6)
    found = spark.createDataFrame([(w, 5) for w in pool], "word string, n long")
    wanted = {(a, b) if (len(a), a) < (len(b), b) else (b, a) for a in pool for b in pool if a < b and near(a, b)}
    for frequent in (1, 4, 32):
        got = {(r.a, r.b) for r in spelling.near_pairs(found, frequent).collect()}
        assert got == wanted
    monkeypatch.setattr(spelling, "BROADCAST_GRAMS", 0)
    assert {(r.a, r.b) for r in spelling.near_pairs(found, 2).collect()} == wanted


def test_roots_follow_forms_to_the_last(spark):
    chain = [(f"word{k}", f"word{k + 1}" if k < 9 else None) for k in range(10)]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame([*chain, ("alone", None)], "word string, form string"), 5**10 * 5).collect()}
    assert got == {**{w: "word9" for w, _ in chain}, "alone": "alone"}


def test_empty_table(spark):
    assert made(spark, [(1, "x")][:0]) == set() and made(spark, [(1, None), (None, "short words")]) == set()
