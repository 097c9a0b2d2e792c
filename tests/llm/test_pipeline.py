"""The stages of the pipeline against plain versions."""

from pyspark.sql import functions as F

import corpus_pipeline
from assetweave.llm.common import written
from tests.llm import brute
from tests.oracle import DATA


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], DATA), "stage"))
    start, good, single, clean, mixed, placed = seen
    assert all(set(x.columns) == set(docs.columns) for x in seen[:-1]) and set(placed.columns) > set(docs.columns)
    kept = good.join(labels, "doc_id")
    assert kept.where("quality = 0").count() <= 1
    assert kept.where("quality = 1").count() >= start.join(labels, "doc_id").where("quality = 1").count() - 1
    groups = brute.near_components([(r.doc_id, r.text) for r in good.collect()], 5)
    assert {r.doc_id for r in single.collect()} == {i for i, (_, c) in groups.items() if i == c}
    rows = [(r.doc_id, r.text) for r in single.collect()]
    hit = {x[0] for x in brute.contained(rows, [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()])}
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - hit
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in clean.collect()}
    assert placed.count() == mixed.count() and placed.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0


def test_pipeline_of_no_documents(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_carry_columns_of_any_name(spark):
    """Columns with the names that stages use; slot and shard are the last stage's."""
    names = ["_score", "score", "component_id", "kept", "_text", "hit", "chances", "count", "copy", "slot", "shard"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumns({n: F.concat(F.lit(n), "doc_id") for n in names})
    for _, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, DATA), "stage")
    assert before.columns[-2:] == ["slot", "shard"] and set(docs.columns) == set(before.columns) and docs.count() > 0
    assert all(r[n] == f"{n}{r.doc_id}" for r in docs.collect() for n in names[:-3])
