"""Properties of the physical plans."""

import pytest

from contentloom.plans import registered_queries as queries

FOLDER = "/root/testdata/sf0.001"
PLANS = queries()
# Multi-job operators and those whose tasks score vectors with numpy.
OTHER = {n for n in PLANS if n.startswith(("e01_", "l03_", "h01_", "st1_", "st2_"))}


@pytest.mark.parametrize("name", sorted(set(PLANS) - OTHER))
def test_no_python_rows_and_no_pair_joins(spark, name):
    plan = PLANS[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for bad in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


def test_filters_reach_the_scan(spark):
    from contentloom.operators import store
    from contentloom.plans.registry import Tables

    t = Tables(spark, FOLDER)
    docs = t.documents.withColumnsRenamed({"source": "content_type", "doc_id": "id"})
    plan = store.by_type(docs, "src1").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,src1)" in plan and "text" not in plan.split("ReadSchema")[1]


def test_paging_needs_no_full_sort(spark):
    plan = PLANS["f02_by_type"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
