"""Names that share their beginnings or their ends, whose pairs by segments grow with the square of the names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetweave.operators import leaves, names
from tests.test_names import edited, edits


def texts(spark, made):
    return spark.createDataFrame([(t, f"K{k}") for k, t in enumerate(dict.fromkeys(made))], "name string, key string").withColumn("size", F.length("name")).repartition(3).cache()


def wanted(made, threshold=0.8):
    made, found = list(dict.fromkeys(made)), {}
    for k, x in enumerate(made):
        for y in made[:k]:
            most = max(len(x), len(y))
            if abs(len(x) - len(y)) <= (1 - threshold) * most + 1e-9 and (like := 1 - edits(x, y) / most) >= threshold:
                found[tuple(sorted((x, y)))] = like
    return found


def test_edits_of_all_pairs():
    r, of = random.Random(5), leaves.compared()
    for n, whole in [(1, 1), (1, 3), (4, 4), (5, 7), (8, 8), (9, 12)]:
        a, b = (["".join(r.choice("abc") for _ in range(size)) for _ in range(12)] for size in (n, whole))
        points = [np.array([[*map(ord, t)] for t in side], np.uint8) for side in (a, b)]
        for k in range(6):
            got = of(*points, k) if whole - n <= k else None
            for i, x in enumerate(a if got is not None else []):
                for j, y in enumerate(b):
                    d = edits(x, y)
                    assert got[i, j] == d if d <= k else got[i, j] > k
        # a beginning of b, and code point 0 for what follows, gives no more
        part = points[1].copy()
        part[:, whole // 2 :] = 0
        if whole - n <= 5:
            assert (of(points[0], part, 5, True) <= np.minimum(of(points[0], points[1], 5), 6)).all()


@pytest.mark.parametrize("threshold", [0.8, 0.6])
def test_names_with_one_beginning_equal_brute_force(spark, monkeypatch, threshold):
    monkeypatch.setattr(leaves, "LEAF", 24)
    monkeypatch.setattr(leaves, "DENSE", 4)
    r = random.Random(23)
    made = [f"{r.choice(['red plate', 'rod plate', 'old rod', 'żółty ring', 'x'])} {r.randrange(10 ** r.randint(1, 5))}" for _ in range(330)] + [edited(r, "red plate 123", r.randint(0, 4), "12ż \0") or "a" for _ in range(40)]
    rows = texts(spark, made)
    heads = leaves.in_leaves(rows, ["key"], names.LONG).select("dense").collect()
    assert sum(h.dense for h in heads) > 5 and sum(not h.dense for h in heads) > 5
    pairs = names.similar_texts(rows, threshold, ("name", "key")).collect()
    keys = {r.name: r.key for r in rows.collect()}
    assert all((keys[p.a_name], keys[p.b_name]) == (p.a_key, p.b_key) for p in pairs)
    got = {tuple(sorted((p.a_name, p.b_name))): p.likeness for p in pairs}
    assert len(got) == len(pairs) > 1000 and got == pytest.approx(wanted(made, threshold))


def test_names_with_one_ending_make_few_candidates(spark):
    """Eighteen random digits and a common word: by segments of equal length, names met whose last digits alone were equal."""
    r = random.Random(29)
    made = ["".join(r.choice("0123456789abcdef") for _ in range(18)) + " token" for _ in range(3000)]
    made += [m[:5] + "~" + m[6:] for m in made[:50]] + [m[:9] + m[10:] for m in made[50:100]]
    rows = texts(spark, made)
    sizes = [(23, 4, 23), (23, 4, 24), (24, 4, 24)]
    candidates = names._short_pairs(rows, rows.select("size", "name"), sizes).distinct()
    assert 100 <= candidates.count() < 1000
    pairs = names.similar_texts(rows).collect()
    assert {tuple(sorted((p.a_name, p.b_name))) for p in pairs} >= {tuple(sorted((made[k], made[3000 + k]))) for k in range(100)}
    assert len(pairs) == 100


def test_one_name_in_the_key_of_very_many(spark, monkeypatch):
    """Keys of two segments that many names have are dealt out, and lose no pair."""
    monkeypatch.setattr(names, "FREQUENT", 2)
    r = random.Random(31)
    made = [edited(r, "shared words 12", r.randint(1, 4), "abc1 ") or "a" for _ in range(120)]
    monkeypatch.setattr(leaves, "DENSE", 10**6)
    got = {tuple(sorted((p.a_name, p.b_name))): p.likeness for p in names.similar_texts(texts(spark, made)).collect()}
    assert got == pytest.approx(wanted(made)) and len(got) > 200
