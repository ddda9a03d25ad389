"""Small rasters are packed, resized and taken apart many at a time, with the results of one at a time."""
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assetlane.operators import packed, pixels


@pytest.mark.parametrize("method,premultiply,linear", [("triangle", False, False), ("mitchell", True, False), ("lanczos3", True, True)])
def test_small_rasters_resized_together_equal_one_at_a_time(method, premultiply, linear):
    rng = np.random.default_rng(3)
    rasters, sizes = [], []
    for _ in range(120):
        h, w, oh, ow = rng.integers(1, [64, 64, 64, 64], endpoint=True).tolist()
        raster = rng.integers(0, 256, (h, w, 4)).astype(np.uint8)
        raster[..., 3] = rng.choice([0, 128, 255], (h, w))
        rasters.append(raster)
        sizes.append((ow, oh, str(rng.choice(["stretch", "contain"]))))
    made = packed.resample_small(rasters, sizes, method, premultiply, linear)
    for raster, size, got in zip(rasters, sizes, made):
        if size[:2] != (raster.shape[1], raster.shape[0]):
            np.testing.assert_array_equal(got, packed.resample(raster, *size, method, premultiply, linear))


def test_images_of_all_sizes_and_broken_ones_come_out_alike(spark):
    """Images of all sizes, broken ones among them, come out as they did one by one."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        w, h = (int(v) for v in rng.choice([1, 5, 20, 70], 2))
        body = rng.integers(0, 256, 4 * w * h, np.uint8).tobytes()
        rows.append((i, w, h, None if i == 7 else body[:5] if i == 8 else body + b"more" if i == 9 else body))
    rows += [(60, 0, 3, b""), (61, None, 3, b"abcd"), (None, 2, 1, bytes(range(8)))]
    images = spark.createDataFrame(rows, "image_id bigint, width int, height int, data binary").coalesce(1)
    targets = spark.createDataFrame([(i, 1 + i % 90, 1 + i % 9, "contain" if i % 2 else "stretch") for i in range(0, 60, 3)],
                                    "image_id bigint, out_w int, out_h int, fit string")
    got = {r["image_id"]: r for r in packed.resize_packed(images, targets, "mitchell", True, False).collect()}
    goals = {r["image_id"]: r for r in targets.collect()}
    assert len(got) == len(rows)
    for i, w, h, body in rows:
        if not w or not h or body is None or len(body) < 4 * w * h:
            assert got[i]["data"] is None and (got[i]["width"], got[i]["height"]) == (w, h)
            continue
        want, g = np.frombuffer(body, np.uint8, 4 * w * h).reshape(h, w, 4), goals.get(i)
        if g is not None:
            want = packed.resample(want, g["out_w"], g["out_h"], g["fit"], "mitchell", True, False)
        assert (got[i]["height"], got[i]["width"]) == want.shape[:2] and bytes(got[i]["data"]) == want.tobytes()


def test_packing_undoes_exploding_in_any_order(spark):
    """Every sample comes through, and images leave in few batches."""
    images = spark.range(3000).coalesce(1).select(
        F.col("id").alias("image_id"), F.lit(2).alias("width"), F.lit(2).alias("height"),
        F.unhex(F.concat(F.lit("0102030405060708090A0B0C0D0E0F"), F.lpad(F.hex(F.col("id") % 256), 2, "0"))).alias("data"))
    px = pixels.explode_pixels(images)
    batches = lambda df: df.mapInArrow(
        lambda part: (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())}) for b in part), "n bigint").collect()
    sizes = [r["n"] for r in batches(px)]
    assert sum(sizes) == 12_000 and len(sizes) < 100
    back = pixels.pack_pixels(px.orderBy(F.rand(1)))
    assert back.join(images.withColumnRenamed("data", "d"), "image_id").where("data <> d").isEmpty() and back.count() == 3000


@pytest.mark.parametrize("channels,n", [("gray", 1), ("rgb", 3), ("rgba", 4)])
def test_large_rasters_go_in_bands_between_small_ones(spark, channels, n):
    sizes = [(1, 3, 2), (2, 700, 600), (3, 2, 2)]  # the second is larger than a band
    rows = [(i, w, h, (np.arange(w * h * n) * 7 % 251).astype(np.uint8).tobytes()) for i, w, h in sizes]
    images = spark.createDataFrame(rows, "image_id bigint, width int, height int, data binary").coalesce(1)
    px = pixels.explode_pixels(images, channels)
    got = {r["image_id"]: bytes(r["data"]) for r in pixels.pack_pixels(px, "data", channels).collect()}
    assert got == {i: body for i, _, _, body in rows}
    assert px.where("x >= width OR y >= height").isEmpty()
