"""Alignment by likeness of names against all pairs."""

import random

import pytest

from assetweave.operators import names

SCHEMA = "asset_key string, source string, name string"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def edited(r, t, n, letters):
    t = list(t)
    for _ in range(n):
        k, how = r.randrange(len(t) + 1), r.randrange(3)
        if how == 0:
            t.insert(k, r.choice(letters))
        elif k < len(t):
            t[k : k + 1] = [] if how == 1 else [r.choice(letters)]
    return "".join(t).strip()


def plain(rows):
    """Links between assets, and the class of each, of rows (asset_key, source, name)."""
    by = {}
    for key, source, name in rows:
        if name and name.strip():
            old = by.get(key, (None, set()))
            by[key] = (min(filter(None, (old[0], name.strip().lower()))), old[1] | {source})
    classes = {}
    for key in sorted(by):
        classes.setdefault((by[key][0], frozenset(by[key][1])), key)
    links = {}
    for a in sorted(by):
        for b in sorted(by):
            if a < b and not by[a][1] & by[b][1]:
                x, y = by[a][0], by[b][0]
                if abs(len(x) - len(y)) <= 0.2 * max(len(x), len(y)) + 1e-9:
                    like = 1 - edits(x, y) / max(len(x), len(y))
                    if like >= 0.8:
                        links[a, b] = like
    return links, {k: classes[v[0], frozenset(v[1])] for k, v in by.items()}


def compared(spark, rows):
    links, of = plain(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    members = {r.asset_key: (r.class_key, r.n_links) for r in names.class_members(df).collect()}
    assert members == {k: (c, sum(k in pair for pair in links)) for k, c in of.items()}
    got = {(r.left_key, r.right_key): (r.likeness, r.n_left, r.n_right) for r in names.similar_names(df).collect()}
    size = {c: sum(x == c for x in of.values()) for c in of.values()}
    wanted = {tuple(sorted((of[a], of[b]))): like for (a, b), like in links.items()}
    assert got == {(a, b): (pytest.approx(like), size[a], size[b]) for (a, b), like in wanted.items()}
    return links


def test_short_names_equal_brute_force(spark):
    r, letters, made = random.Random(13), "abcdef ", []
    for _ in range(50):
        base = "".join(r.choice(letters) for _ in range(r.choice([1, 2, 4, 5, 9, 10, 16, 25, 40]))).strip() or "a"
        made += [edited(r, base, r.randint(0, max(1, len(base) // 4)), letters) for _ in range(3)]
    rows = [(f"K{k:03d}", "wxyz"[k % 4], t) for k, t in enumerate(made)] + [("K000", "x", made[0]), ("N1", "w", None), ("N2", "x", " "), ("T1", "w", "tether usd token"), ("T2", "x", "TEHTER usd token ")]
    links = compared(spark, rows)
    assert len(links) > 20 and ("T1", "T2") in links


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz ", "ab"])
def test_long_names_equal_brute_force(spark, letters):
    """Names of 24 to 500 characters, with as many edits as the likeness allows and some more."""
    r, made = random.Random(17), []
    for n in [24, 28, 31, 32, 33, 38, 39, 40, 41, 60, 100, 200] + [400] * (letters != "ab"):
        base = "".join(r.choice(letters) for _ in range(n)).strip()
        made += [base] + [edited(r, base, round(n * share), letters) for share in (0.02, 0.1, 0.19, 0.2, 0.21, 0.25)]
    made += ["x" * 500, "x" * 420, "x" * 399, "shared words of a name " * 9 + "one", "shared words of a name " * 9 + "two"]
    rows = [(f"K{k:03d}", "wxyz"[k % 4], t) for k, t in enumerate(made)]
    assert len(compared(spark, rows)) > 20


def test_copies_of_a_name_make_no_pairs(spark):
    rows = [(f"A{k:05d}", "wxyz"[k % 4], "one name") for k in range(3000)] + [("B", "w", "one nome")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert names.similar_names(df).count() == 4 * 3 // 2 + 3
    got = {r.asset_key: (r.class_key, r.n_links) for r in names.class_members(df).collect()}
    assert len(got) == 3001 and got["A00004"] == ("A00000", 2250) and got["A00001"] == ("A00001", 2251) and got["B"] == ("B", 2250)
    assert names.class_members(df.limit(0)).count() == 0


def test_entries_of_all_sources_are_aligned(spark):
    """Links between names whatever their sources, and each entry as a member of its name."""
    r, letters = random.Random(19), "abcd 12"
    bases = ["red plate 12345", "small widget 123", "old rod 77", "ab"]
    named = [edited(r, r.choice(bases), r.randint(0, 3), letters) for _ in range(120)]
    rows = [(f"E{k:03d}", "wxyz"[r.randrange(4)], named[k % 120]) for k in range(200)] + [("N", "w", None), ("T", "x", " Red Plate 12354")]
    got = names.aligned_entries(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    entries = {k: (t.strip().lower(), s) for k, s, t in rows if t and t.strip()}
    of = {}
    for k in sorted(entries):
        of.setdefault(entries[k][0], []).append(k)
    apart = lambda x, y: sum(entries[a][1] != entries[b][1] for a in x for b in y)
    wanted = {("member", k, of[t][0]): (1.0, 1, len(of[t]), apart([k], of[t])) for k, (t, _) in entries.items()}
    for x, xs in of.items():
        for y, ys in of.items():
            like = 1 - edits(x, y) / max(len(x), len(y))
            if xs[0] < ys[0] and like >= 0.8 and apart(xs, ys):
                wanted["link", xs[0], ys[0]] = (pytest.approx(like), len(xs), len(ys), apart(xs, ys))
    assert sum(k[0] == "link" for k in wanted) > 100
    assert {tuple(g)[:3]: tuple(g)[3:] for g in got} == wanted


def test_query_aligns_every_listing(spark):
    """All listings are members, and the parts' own names are linked, not only made-up ones."""
    from assetweave.plans import assets
    from tests.oracle import DATA

    listings = {f"{k.asset_key}:{k.source}" for k in assets.keyed(spark, DATA).select("asset_key", "source").collect()}
    got = assets.align_by_name_similarity(spark, DATA).collect()
    members = {g.left_key for g in got if g.kind == "member"}
    assert listings <= members and len(members) == len(listings) + 200
    assert sum(g.kind == "link" and ":" in g.left_key for g in got) > 200
