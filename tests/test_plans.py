"""Plan properties the scale design relies on (checked on the physical plans, sf0.001)."""

import pytest

from conftest import SF_SMALL
from looplake.plans.explain import summarize
from looplake.plans.registry import load_all

REG = load_all()


@pytest.mark.parametrize("key", ["eligible_by_clinic", "feedback_counts", "upsert_feedback", "dedup_feedback",
                                 "monitor_metrics", "confidence_threshold_sweep", "training_snapshot"])
def test_no_python_stage(spark, key):
    assert summarize(REG[key].build(spark, SF_SMALL))["python_udfs"] == 0


@pytest.mark.parametrize("key", ["next_batch_ids", "per_class_pick"])
def test_top_k_per_group_uses_window_group_limit(spark, key):
    assert summarize(REG[key].build(spark, SF_SMALL))["window_group_limits"] >= 1


def test_global_top_k_is_take_ordered(spark):
    assert summarize(REG["recent_tail"].build(spark, SF_SMALL))["take_ordered"] >= 1


def test_flagship_has_no_cartesian_product(spark):
    plan = REG["collect_training_frame"].build(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_scans_are_pruned(spark):
    df = REG["eligible_by_clinic"].build(spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "value" not in plan.split("ReadSchema")[1].split(">")[0] and "props" not in plan
