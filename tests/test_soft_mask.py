"""Soft masks meet images in one packed shuffle, with the results of joining pixels."""
import pytest
from pyspark.sql import functions as F

from assetlane.operators import pixels
from assetlane.suite import load_cases

PX = "image_id bigint, width int, height int, x int, y int, r int, g int, b int, a int"


def joined(px, mask_px, masks):
    """The plain form: two joins of pixels."""
    masks = masks if masks is not None else mask_px.groupBy("image_id").agg(F.max("width").alias("mask_width"), F.max("height").alias("mask_height"))
    at = px.join(masks, "image_id", "left").selectExpr(
        "*", "int(floor(double(x) * double(mask_width) / nullif(double(width), 0D))) AS sx", "int(floor(double(y) * double(mask_height) / nullif(double(height), 0D))) AS sy")
    gray = mask_px.selectExpr("image_id", "x AS sx", "y AS sy", "r AS m")
    return at.join(gray, ["image_id", "sx", "sy"], "left").select(*pixels.PX[:8], F.coalesce("m", "a").alias("a"))


@pytest.mark.parametrize("given", [False, True])
@pytest.mark.parametrize("records", [7, 10_000])
def test_masks_by_runs_equal_a_join(spark, given, records):
    px = [(i, 5, 4, x, y, (i * x) % 256, y, 3, 255) for i in range(30) for y in range(4) for x in range(5)]
    px += [(31, 5, 4, 1, 1, 300, -1, None, 7), (31, 5, 4, 2, 1, 1, 2, 3, None), (None, 5, 4, 0, 0, 1, 2, 3, 4), (2, 5, 4, 3, 3, 9, 9, 9, 9), (3, 0, 4, 0, 0, 1, 1, 1, 1)]
    mask = [(i, 3, 2, x, y, (40 * i + x + 10 * y) % 256, 0, 0, 255) for i in range(0, 34, 2) for y in range(2) for x in range(3) if (i, x) != (4, 1)]
    mask += [(6, 3, 2, 0, 0, 77, 0, 0, 255), (8, 9, 9, 8, 8, 400, 0, 0, 255), (10, 3, 2, 1, 0, None, 0, 0, 255)]
    px, mask = (spark.createDataFrame(rows, PX).orderBy(F.rand(7)) for rows in (px, mask))
    masks = spark.createDataFrame([(i, 3, 2) for i in range(0, 34, 4)], "image_id bigint, mask_width int, mask_height int") if given else None
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    try:
        got = sorted(map(repr, pixels.apply_soft_mask(px, mask, masks).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted(map(repr, joined(px, mask, masks).collect()))


def test_pixels_are_shuffled_once_and_never_joined(spark, sf):
    plan = load_cases()["apply_soft_mask"].run(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
