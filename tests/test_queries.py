"""Every registered query against its SQL twin on the smallest tables; slow queries run at a larger scale by hand."""

import os

import pytest

import compare
from factloom.plans import catalog
from factloom.plans.registry import REGISTRY

FOLDER = os.environ.get("QUERY_TEST_DIR", "/root/testdata/sf0.001")
# These build wide plans; tests/compare.py runs them with all others.
HEAVY = {"radar_replay", "followup_news", "sub_dimension_levels", "score_gates", "dimension_scores", "report_stats", "candidate_view"}


@pytest.fixture(scope="module")
def connection():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - HEAVY))
def test_query(spark, connection, name):
    query = REGISTRY[name]
    if query.oracle:
        assert compare.compare(spark, connection, name, catalog.callables()[name], query.oracle, FOLDER) is None
    else:
        assert catalog.run(name, spark, FOLDER).columns


def test_entry_and_contract(spark):
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "evidence_rank" in entry.queries()


@pytest.mark.parametrize("name", ["source_classification", "host_tier_join", "keyword_groups", "evidence_stats", "pool_stats"])
def test_plans_stay_in_the_jvm_and_compare_no_all_pairs(spark, name):
    plan = catalog.run(name, spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
