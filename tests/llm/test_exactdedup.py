"""Exact dedup and its filters against plain versions, and their defined cases."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetweave.llm import exactdedup, fusefilter
from assetweave.llm.common import joined_by_size

GONE = {ord(c): None for c in exactdedup.SPACES}


def plain(rows: list[tuple]) -> list[tuple]:
    """(doc_id, keep_id, group size, kept, digest) of rows (doc_id, text)."""
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[(t or "").translate(GONE)].append((-len(t or ""), i is None, i or 0, k))
    out = []
    for body, members in groups.items():
        best = min(members)
        out += [(rows[k][0], rows[best[3]][0], len(members), k == best[3], hashlib.sha256(body.encode()).hexdigest()) for *_, k in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 30_000])
def test_filter_holds_its_keys_and_few_others(n):
    keys, others = (np.random.default_rng(n + k).integers(-(2**63), 2**63 - 1, 20_000 if k else n) for k in (0, 1))
    made = fusefilter.build(np.concatenate([keys, keys[: n // 2]]))
    assert fusefilter.holds(keys, *made).all()
    assert fusefilter.holds(others, *made).mean() < 0.01
    assert n < 1000 or len(made[3]) < 1.5 * n


CASES = [(1, None), (1, None), (2, ""), (3, " \t\n"), (None, "a b"), (None, "ab "), (4, "a\x0bb"), (5, "a  b"), (6, "a  b"), (7, "AB"), (8, "a b"), (9, "x" * 9000), (10, " ".join("x" * 9000)), (11, "\U0001f600 é"), (12, "\U0001f600é"), (-3, "ab   "), (-3, "   ab")]


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_groups_equal_plain_ones(spark, batches):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in CASES], "doc_id long, text string, sha string, kept int").repartition(3)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exactdedup.copy_groups(docs, batches).collect()), key=str)
    assert got == plain(CASES)


def test_copies_in_other_batches_are_found(spark):
    """Most of each batch's texts are in older snapshots; a third of all rows are one text."""
    rows = [(k, "hot text" if k % 3 == 0 else f"text {k % 400}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    store = exactdedup.Snapshots(spark, 4)
    for low in range(0, 3000, 750):
        store.add(docs.where(F.col("doc_id").between(low, low + 749)))
    owners = [{r.owner: r.n for r in s.members().groupBy("owner").agg(F.count(F.lit(1)).alias("n")).collect()} for s in store.found]
    first, wanted = {}, []
    for number, low in enumerate(range(0, 3000, 750)):
        texts = {t for _, t in rows[low : low + 750]}
        wanted.append(Counter(first.setdefault(t, number) for t in texts))
    assert owners == wanted and wanted[1][0] > 300
    store.remove()
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exactdedup.copy_groups(docs).collect()), key=str)
    assert got == plain(rows)


def test_bytes_decide_where_a_filter_errs(spark, monkeypatch):
    monkeypatch.setattr(fusefilter, "holds", lambda keys, *_: np.ones(len(keys), bool))
    rows = [(k, f"text {k % 7} {k // 20}") for k in range(80)]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exactdedup.copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == plain(rows)


def test_keep_one(spark):
    docs = spark.createDataFrame([(i, t, "x", 0, 1) for i, t in CASES], "doc_id long, text string, sha string, size int, own int")
    got = exactdedup.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted([r.doc_id for r in got.collect()], key=str) == sorted([r[0] for r in plain(CASES) if r[3]], key=str)
    assert exactdedup.keep_one(docs.limit(0)).count() == 0 and exactdedup.copy_groups(docs.limit(0)).count() == 0


def test_joined_by_size(spark):
    rows = spark.createDataFrame([(k % 5 if k > 4000 else 9, k) for k in range(6000)], "key long, v long")
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("most"))
    got = joined_by_size(rows, groups, ["key"], "n")
    assert got.count() == 6000 and got.where("key = 9").select("most").distinct().collect()[0].most == 4000
