import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlane.operators import pixels, resample

PX_TYPE = "image_id bigint, width int, height int, x int, y int, r int, g int, b int, a int"


def raster(spark, w, h, fn, image_id=1):
    data = [(image_id, w, h, x, y, *fn(x, y)) for y in range(h) for x in range(w)]
    return spark.createDataFrame(data, PX_TYPE)


def gradient(offset=0):
    return lambda x, y: ((x * 7 + y * 11) % 200 + offset,) * 3 + (255,)


def noise(seed):
    rng = random.Random(seed)
    table = {}
    return lambda x, y: table.setdefault((x, y), tuple(rng.randrange(256) for _ in range(3)) + (255,))


def score(a, b, **kw):
    return pixels.ssim(a, b, **kw).collect()[0]


def reference_ssim(p, q):
    h, w = p.shape
    ww, wh = min(8, w), min(8, h)
    found = []
    for top in range(0, h - wh + 1, 8):
        for left in range(0, w - ww + 1, 8):
            a, b = p[top:top + wh, left:left + ww], q[top:top + wh, left:left + ww]
            ma, mb = a.mean(), b.mean()
            va, vb, cov = (a * a).mean() - ma * ma, (b * b).mean() - mb * mb, (a * b).mean() - ma * mb
            found.append((2 * ma * mb + 6.5025) * (2 * cov + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225)))
    return float(np.mean(found))


@pytest.mark.parametrize("size", [(16, 16), (5, 3), (20, 9), (1, 1), (8, 23)])
def test_ssim_of_itself_is_one(spark, size):
    px = raster(spark, *size, gradient())
    assert score(px, px)["ssim"] == pytest.approx(1.0, abs=1e-12)


@pytest.mark.parametrize("size", [(17, 24), (6, 30), (9, 9)])
def test_ssim_matches_a_plain_computation(spark, size):
    a, b = raster(spark, *size, noise(1)), raster(spark, *size, noise(2))
    plane = lambda px: np.array([[r.l for r in row] for row in _rows(pixels.luma(px))])
    assert score(a, b)["ssim"] == pytest.approx(reference_ssim(plane(a), plane(b)), abs=1e-9)


def _rows(df):
    out = {}
    for r in df.orderBy("y", "x").collect():
        out.setdefault(r.y, []).append(r)
    return [out[y] for y in sorted(out)]


def test_ssim_falls_with_distortion(spark):
    base = gradient()
    px = raster(spark, 24, 24, base)
    worse = [score(px, raster(spark, 24, 24, lambda x, y, k=k: tuple(min(255, v + (x * y * k) % (k * 9 + 1)) for v in base(x, y)[:3]) + (255,)))["ssim"] for k in (0, 1, 4)]
    assert worse[0] > worse[1] > worse[2]


def test_ssim_sees_alpha_over_white(spark):
    opaque = raster(spark, 8, 8, lambda x, y: (10, 10, 10, 255))
    clear = raster(spark, 8, 8, lambda x, y: (10, 10, 10, 0))
    assert score(opaque, clear)["ssim"] < 0.2


def test_ssim_reports_mismatches(spark):
    a, b = raster(spark, 4, 4, gradient()), raster(spark, 5, 4, gradient())
    assert score(a, b)["error"] == "sizes differ: 4x4 and 5x4"
    short = a.where("x < 3")
    assert score(a, short)["error"] == "too few samples"
    assert score(a, b.where("false"))["error"] == "one side has no pixels"


def test_factor_table(spark):
    data = [(1, 1000, 2000, 1), (2, 2001, 1000, 2), (3, 4000, 3000, 3), (4, 8000, 6000, 5), (5, 1, 1, 1)]
    df = spark.createDataFrame(data, "image_id int, width int, height int, want int")
    assert all(r.factor == r.want for r in pixels.metrics_factor(df).collect())
    assert all(r.factor == 1 for r in pixels.metrics_factor(df, 0).collect())


def test_box_rounds_half_to_even_and_drops_the_edge(spark):
    px = raster(spark, 5, 2, lambda x, y: (x, 1 if (x + y) % 2 else 2, 255, 255))
    got = [(r.x, r.y, r.width, r.height, r.r, r.g) for r in pixels.box_downscale(px, 2).orderBy("x").collect()]
    assert got == [(0, 0, 2, 1, 0, 2), (1, 0, 2, 1, 2, 2)]


def test_four_turns_are_identity(spark):
    px = raster(spark, 3, 2, noise(5))
    turned = px
    for _ in range(4):
        turned = pixels.rotate(turned, 90)
    assert sorted(turned.collect()) == sorted(px.collect())
    once = {(r.x, r.y): r.r for r in pixels.rotate(px, 90).collect()}
    assert once == {(2 - 1 - r.y, r.x): r.r for r in px.collect()}
    back = pixels.rotate(pixels.rotate(px, 270), F.lit(90))
    assert sorted(back.collect()) == sorted(px.collect())


def test_packed_rgba_unpacks_in_order(spark):
    images = spark.createDataFrame([(1, 2, 1, bytes(range(8))), (2, 2, 2, b"short")], "image_id bigint, width int, height int, data binary")
    got = [tuple(r) for r in pixels.explode_pixels(images, "rgba").orderBy("x").collect()]
    assert got == [(1, 2, 1, 0, 0, 0, 1, 2, 3), (1, 2, 1, 1, 0, 4, 5, 6, 7)]
    arrays = spark.createDataFrame([(1, 2, 1, list(range(6)))], "image_id bigint, width int, height int, data array<int>")
    got = [tuple(r)[5:] for r in pixels.explode_pixels(arrays, "rgb").orderBy("x").collect()]
    assert got == [(0, 1, 2, 255), (3, 4, 5, 255)]


def test_crop_never_goes_empty(spark):
    px = raster(spark, 4, 4, gradient())
    rects = spark.createDataFrame([(1, 99.0, -5.0, 0.0, 2.4)], "image_id bigint, rx double, ry double, rw double, rh double")
    got = [(r.x, r.y, r.width, r.height) for r in pixels.crop(px, rects).orderBy("y").collect()]
    assert got == [(0, 0, 1, 2), (0, 1, 1, 2)]


@pytest.mark.parametrize("method", ["triangle", "catrom", "mitchell", "lanczos3", "browser-pixelated"])
def test_resize_keeps_flat_colour_and_fills_the_target(spark, method):
    px = raster(spark, 7, 5, lambda x, y: (200, 100, 50, 255))
    targets = spark.createDataFrame([(1, 11, 3, "stretch")], "image_id bigint, out_w int, out_h int, fit string")
    got = resample.resize(px, targets, method).collect()
    assert len(got) == 33 and {(r.x, r.y) for r in got} == {(x, y) for x in range(11) for y in range(3)}
    assert {(r.r, r.g, r.b, r.a) for r in got} == {(200, 100, 50, 255)}


def test_contain_samples_only_the_centre(spark):
    px = raster(spark, 9, 3, lambda x, y: (255 if 3 <= x < 6 else 0, 0, 0, 255))
    targets = spark.createDataFrame([(1, 6, 6, "contain")], "image_id bigint, out_w int, out_h int, fit string")
    for method in ("lanczos3", "browser-pixelated"):
        assert {r.r for r in resample.resize(px, targets, method).collect()} == {255}


def test_nearest_upscale_then_same_size(spark):
    px = raster(spark, 3, 2, noise(9))
    up = spark.createDataFrame([(1, 6, 4, "stretch")], "image_id bigint, out_w int, out_h int, fit string")
    got = {(r.x, r.y): r.g for r in resample.resize_nearest(px, up).collect()}
    src = {(r.x, r.y): r.g for r in px.collect()}
    assert got == {(x, y): src[x // 2, y // 2] for x in range(6) for y in range(4)}
    none = up.where("false")
    assert sorted(resample.resize_nearest(px, none).collect()) == sorted(px.collect())


@pytest.mark.parametrize("size,budget", [((17, 24), 10**6), ((6, 30), 10**6), ((40, 33), 200), ((9, 9), 0)])
def test_packed_score_equals_the_pixel_table(spark, size, budget):
    w, h = size
    pixel = lambda seed: (lambda f: lambda x, y: f(x, y)[:3] + ((x * y * 31) % 256,))(noise(seed))
    a, b = (raster(spark, w, h, pixel(s)) for s in (1, 2))
    pack = lambda px: bytes(v for r in px.orderBy("y", "x").collect() for v in (r.r, r.g, r.b, r.a))
    pairs = spark.createDataFrame([(1, w, h, pack(a), pack(b))], "image_id bigint, width int, height int, ref binary, out binary")
    want = pixels.measure_ssim(a, b, budget).first().ssim
    assert pixels.ssim_packed(pairs, budget).first().ssim == pytest.approx(want, abs=1e-9)


def test_images_without_a_size_are_rejected(spark):
    rows = [("a", None, 2, bytearray(16)), ("b", 2, None, bytearray(16)), ("c", 2, 2, bytearray(16)), ("d", None, None, None)]
    images = spark.createDataFrame(rows, "image_id string, width int, height int, data binary")
    arrays = images.withColumn("data", F.when(F.col("data").isNotNull(), F.array_repeat(F.lit(7), 16)))
    for table in (images, arrays):
        assert {r.image_id for r in pixels.explode_pixels(table).collect()} == {"c"}
        assert {(r.image_id, r.error) for r in pixels.explode_rejects(table).collect()} == {("a", "no size"), ("b", "no size"), ("d", "no samples")}
    pairs = images.select("image_id", "width", "height", F.col("data").alias("ref"), F.col("data").alias("out"))
    got = {r.image_id: (r.ssim, r.error) for r in pixels.ssim_packed(pairs).collect()}
    assert got == {"a": (None, "no size"), "b": (None, "no size"), "c": (1.0, None), "d": (None, "one side has no pixels")}
