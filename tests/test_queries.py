"""Every registered query of the library against its SQL."""

import pytest

import assetweave.plans  # noqa: F401
from assetweave import registry
from tests.oracle import DATA, check


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    check(spark, registry.QUERIES[name], registry.ORACLES[name])


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_no_python_in_batch_plans(spark):
    for name in ("merge_assets", "platform_rollup", "classify_peg", "latency_stats", "error_rate"):
        plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan, name


def test_entry_imports_without_the_optional_parts(monkeypatch):
    import importlib
    import sys

    for name in [m for m in sys.modules if m.startswith("assetweave.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "assetweave.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(registry.QUERIES)
    assert set(entry.oracle_sql()) == set(registry.ORACLES)
    sys.modules.pop("__spark_entry__", None)
