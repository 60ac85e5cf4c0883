"""Plan-shape checks: no Python UDF in the D plans, no cartesian product, top-K as a group limit."""

import pytest

from shelfspark.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["popular_recency", "fbt_lift", "content_topk", "item_cf_topk",
                                  "eval_item_cf", "serve_personalized", "eda_weekly"])
def test_no_cartesian_no_python(spark, name):
    p = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_topk_uses_group_limit(spark):
    df = QUERIES["popular_recency_by_segment"](spark, SF)
    df.collect()
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_scan_prunes_columns(spark):
    p = plan(QUERIES["feat_behavioral"](spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double,l_extendedprice:double>" in p
