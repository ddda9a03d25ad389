"""What the plans of all registered queries must not contain, and that the contract holds."""

import pytest

import __spark_entry__ as entry
from assetlane.suite import load_cases

CASES = load_cases()
EAGER = {n for n in CASES if n.endswith("_stream")} | {"write_results", "presets_io"}


@pytest.mark.parametrize("name", sorted(set(CASES) - EAGER))
def test_no_cross_join_and_no_whole_table_window(spark, sf, name):
    plan = CASES[name].run(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "SinglePartition" not in plan


def test_contract(spark):
    queries, checks = entry.queries(), entry.oracle_sql()
    assert set(checks) <= set(queries) and len(checks) > 85
    flagship = entry.entry(spark)
    assert flagship.count() > 0 and "recommended" in flagship.columns


def test_geometry_needs_no_shuffle(spark, sf):
    from assetlane.operators import pixels

    px = CASES["explode_pixels"].run(spark, sf)
    for moved in (pixels.rotate(px, 90), pixels.luma(px)):
        assert "Exchange" not in moved._jdf.queryExecution().executedPlan().toString()


def test_planes_are_shuffled_once(spark, sf):
    from assetlane.operators import pixels
    from assetlane.suite.fixtures import view

    scores = pixels._window_scores(view(spark, sf, "v_px"), view(spark, sf, "v_px_out"))
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
