"""Elements of JSON arrays against json.loads, whatever the byte ranges."""

import json
import random

import pytest
from pyspark.sql import functions as F

from assetweave.sources import jsonarrays as ja
from assetweave.sources import snapshots as sn


def value(r, depth=0):
    texts = ["plain", 'quote " and },{ and \\', "[{}]", "ends with \\", "", "é日\U0001f600", "},", '"data": [']
    kinds = [lambda: r.choice(texts), lambda: r.randrange(1000), lambda: None, lambda: True]
    if depth < 3:
        kinds += [lambda: [value(r, depth + 1) for _ in range(r.randrange(4))], lambda: {r.choice(texts) + str(k): value(r, depth + 1) for k in range(r.randrange(4))}]
    return r.choice(kinds)()


def asset(r, k):
    return {"id": k, "name": value(r, 3), "more": value(r), "networks": [{"a": value(r, 2)}, {"b": {"c": 1}}], **({"last": {"x": {}}} if k % 2 else {})}


def found(spark, path, *args, **options):
    rows = ja.elements(spark, path, *args, **options).orderBy("file", "element").collect()
    out = {}
    for x in rows:
        whole, _ = json.JSONDecoder().raw_decode(x.text)
        out.setdefault(x.file.rsplit("/", 1)[1], []).append((x.element, whole))
    return out


@pytest.mark.parametrize("limit", ["128m", "300", "70"])
def test_elements_of_any_layout(spark, tmp_path, limit):
    r, wanted = random.Random(3), {}
    for k, (indent, wrap) in enumerate((i, w) for i in (None, 2) for w in ("bare", "data", "around", "late")):
        rows = [asset(r, j) for j in range((6 if limit == "70" else 40) if k else 1)]
        doc = {"bare": rows, "data": {"data": rows}, "around": {"status": {"a": [{"n": 1}, {"n": 2}]}, "data": rows, "end": {"b": [{"m": {}}, {"n": 3}]}}, "late": {"errors": [], "note": '"data": [', "data": rows}}[wrap]
        wanted[f"f{k}.json"] = list(enumerate(rows))
        (tmp_path / f"f{k}.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=k % 3 == 0))
    (tmp_path / "none.json").write_text('{"data": []}')
    (tmp_path / "other.json").write_text('{"other": [{"id": 1}, {"id": 2}]}')
    names = {"spark.sql.files.maxPartitionBytes": limit, "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        assert found(spark, str(tmp_path), "data") == wanted
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_a_large_document_is_many_tasks(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"data": [{"id": k, "pad": {"x": "y" * 100}} for k in range(5000)]}))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        assert spark.read.option("lineSep", ja.END).text(str(tmp_path)).rdd.getNumPartitions() > 8
        assert ja.parsed(ja.elements(spark, str(tmp_path), "data"), "struct<id:bigint>").agg(F.sum("id"), F.count("id")).first() == (5000 * 4999 // 2, 5000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_broken_elements_are_counted(spark, tmp_path):
    (tmp_path / "f.json").write_text('[{"id": 1}, {"id": oops, "x": {"y": 2}}, {"id": "text"}, {"id": 4}]')
    rows = ja.elements(spark, str(tmp_path))
    assert sorted(r.id for r in ja.parsed(rows, "struct<id:bigint>").collect()) == [1, 4]
    assert [(r.n, r.n_broken) for r in ja.count_broken(rows, "struct<id:bigint>").collect()] == [(4, 2)]


def test_a_snapshot_without_its_array_is_an_error(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"other": [{"id": "1"}]}')
    with pytest.raises(Exception, match="peggedAssets"):
        sn.scan_chain_supply(spark, str(tmp_path)).collect()
    assert sn.scan_listings(spark, str(tmp_path)).count() == 0
