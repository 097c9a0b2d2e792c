"""The trie of conversations against a plain one, and its defined cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from assetweave.llm import prefixtrie


def plain(rows: list[tuple]) -> list[tuple]:
    """The nodes' columns, of rows (conv_id, turn, role, text) whose turns differ."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)

    def under(path: tuple) -> list[tuple]:
        found, todo = [], [path]
        while todo:
            found.append(todo.pop())
            todo += children[found[-1]]
        return found

    out = []
    for path, convs in members.items():
        sub = under(path)
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(whole[c]) == len(path)))
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in sub if p)
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(children[path]), sum(not children[p] for p in sub), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(spark, rows: list[tuple]) -> list[tuple]:
    convs = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, fp string, depth int").repartition(3)
    return sorted((tuple(r) for r in prefixtrie.node_report(convs).collect()), key=str)


def talk(seed: int, convs: list[int], texts: int, longest: int) -> list[tuple]:
    rng = random.Random(seed)
    return [(c, t if t else None, rng.choice(["user", "assistant", None]), rng.choice([None, ""] + [f"text {k} é\U0001f600" * (k % 3 + 1) for k in range(texts)])) for c in convs for t in range(rng.randint(1, longest))]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_nodes_equal_plain_ones(spark, seed):
    rows = talk(seed, [*range(0, 30), *range(100, 140), 199, *range(250, 260), 9_000_000_000], 1 + 2 * seed, 9)
    assert made(spark, [*rows, (None, 1, "user", "no conversation")]) == plain(rows)


def test_one_conversation_with_most_turns(spark):
    """It lies in several ranges, and so does its copy; others have its head."""
    long = [(100, t, "user", f"turn {t % 50}") for t in range(700)] + [(101, t, "user", f"turn {t % 50}") for t in range(600)]
    rows = long + talk(4, [102, 103, 104, 105, 205], 2, 8)
    assert made(spark, rows) == plain(rows)


def test_all_alike_and_turnless(spark):
    rows = [(c, t, "user", "hello") for c in range(300, 360) for t in range(2)]
    rows += [(c, 0, "user", "x") for c in range(501, 560)]  # without a base: some have no turns left
    assert made(spark, rows) == plain(rows)
    assert made(spark, rows[:0]) == []


def test_fingerprints_compose():
    whole = 0
    parts = [hashlib.md5(bytes([k])).digest() for k in range(40)]
    for x in parts:
        whole = (whole * prefixtrie.BASE + prefixtrie.element(x)) % prefixtrie.PRIME
    one = two = 0
    for x in parts[:13]:
        one = (one * prefixtrie.BASE + prefixtrie.element(x)) % prefixtrie.PRIME
    for x in parts[13:]:
        two = (two * prefixtrie.BASE + prefixtrie.element(x)) % prefixtrie.PRIME
    assert whole == (one * pow(prefixtrie.BASE, 27, prefixtrie.PRIME) + two) % prefixtrie.PRIME


def test_a_reference_of_two_turns_is_an_error(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = prefixtrie.turn_rows
    monkeypatch.setattr(prefixtrie, "turn_rows", lambda convs: rows(convs).withColumn("ref", F.unhex(F.lit("00" * 16))))
    with pytest.raises(ValueError, match="reference"):
        made(spark, [(1, 1, "user", "a"), (1, 2, "user", "b")])
