"""Physical-plan properties that matter at scale."""

import re

import pytest

from wearline.plans import REGISTRY
from conftest import SF_SMALL


def _executed(spark, name):
    df = REGISTRY[name].build(spark, SF_SMALL)
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def _final(plan: str) -> str:
    return plan.split("== Initial Plan ==")[0]


def test_unit_windows_share_one_exchange(spark):
    plan = _final(_executed(spark, "rul_temporal_features"))
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(exchanges) == 1 and "unit_id" in exchanges[0] and "_chunk" in exchanges[0]
    assert "WholeStageCodegen" in plan or "*(" in plan


def test_filter_and_columns_reach_the_scan(spark):
    plan = _executed(spark, "history_truncation")
    assert "LessThanOrEqual(cycle,20)" in plan
    assert "ReadSchema: struct<unit_id:bigint,cycle:bigint,sensor_4:double>" in plan


def test_top_k_is_take_ordered(spark):
    assert "TakeOrderedAndProject" in _executed(spark, "top_anomalous_rows")


def test_parameter_rows_are_broadcast(spark):
    plan = _final(_executed(spark, "fleet_alert_status"))
    assert "BroadcastNestedLoopJoin" in plan or "BroadcastHashJoin" in plan


def test_orders_are_cut_into_key_ranges(spark):
    plan = _final(_executed(spark, "pr_curve"))
    windows = re.findall(r"Window \[.*?\], \[([^\]]*)\], \[", plan)
    assert any("_ob" in w for w in windows)


def test_duplicate_dimension_keys_fail_the_join(spark):
    from pyspark.errors import PySparkException

    from wearline.operators.joins import many_to_one

    fact, dim = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(PySparkException, match="not unique"):
        many_to_one(fact, dim.select("k"), "k").collect()


def test_a_gap_between_chunks_is_no_monotone_label(spark):
    from wearline.operators.validate import label_sanity

    cycles = [*range(1, 101), *range(40000, 40101)]
    df = spark.createDataFrame([("u", c, 40100 - c) for c in cycles], "unit_id string, cycle long, raw_rul long")
    assert [r.rul_monotone for r in label_sanity(df).collect()] == [False]
