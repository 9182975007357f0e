"""Physical-plan properties the design relies on (checked on the executed plan text)."""

import re

import pytest

import __spark_entry__ as ent

SF = "/root/testdata/sf0.001"


def plan_of(spark, name):
    df = ent.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(plan):
    return len(re.findall(r"Exchange hashpartitioning", plan))


def test_scan_pushdown_and_pruning(spark):
    df = ent.queries()["panel"](spark, SF)
    text = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThan(l_quantity,0.0)" in text
    read = re.search(r"ReadSchema: struct<(l_[^>]*)>", text).group(1)
    assert "l_orderkey" not in read and "l_tax" not in read


def test_per_product_operators_reuse_panel_partitioning(spark):
    base = shuffles(plan_of(spark, "panel"))
    for name in ("product_table", "product_span"):
        assert shuffles(plan_of(spark, name)) <= base, name


def test_knn_plan_shape(spark):
    plan = plan_of(spark, "knn_topk")
    assert "FlatMapCoGroupsInPandas" in plan
    assert plan.count("WindowGroupLimit") >= 2     # partial before the shuffle, final after


@pytest.mark.parametrize("name", ["product_table", "season_history", "knn_topk", "label_encode_unseen",
                                  "metrics_table", "key_overlap", "blend_grid"])
def test_no_cartesian_products(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
