"""Joins of tables whose files are small for their rows must not pass through the driver."""

import pytest

from assetlane.suite import load_cases


def plan_of(spark, sf, name):
    return load_cases()[name].run(spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["ctm_cut_draws", "ctm_walk_nested"])
def test_stored_draws_are_not_broadcast(spark, sf, name):
    plan = plan_of(spark, sf, name)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["ssim_packed", "score_sweep", "bar_percent", "sweep_summary",
                                  "dedupe_images", "repoint_refs", "prune_objects", "pdf_summary", "resolve_outcomes"])
def test_exploded_tables_are_not_broadcast(spark, sf, name):
    plan = plan_of(spark, sf, name)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
