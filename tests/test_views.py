"""Exploded fixture views are dealt to tasks by the rows they become, not by the bytes they are read from."""

import pytest

from assetlane.suite import fixtures


@pytest.mark.parametrize("name", ["v_cells", "v_px", "v_pdf_objects", "v_settings"])
def test_tasks_of_exploded_views_hold_a_bounded_number_of_rows(spark, sf, monkeypatch, name):
    monkeypatch.setattr(fixtures, "TASK_CELLS", 1000)
    rows = fixtures.view(spark, sf, name)
    sizes = rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(sizes) == rows.count() and max(sizes) <= 2500
