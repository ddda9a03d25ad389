"""Banded resampling against a plain loop, on sparse tables, and within a memory bound."""
import math
import random
import tracemalloc

import numpy as np
import pytest

from assetlane.operators import packed, resample

PX = "image_id string, width int, height int, x int, y int, r int, g int, b int, a int"


def plain_kernel(method, t):
    t = abs(t)
    if method == "triangle":
        return max(0.0, 1 - t)
    if method == "lanczos3":
        return 1.0 if t == 0 else math.sin(math.pi * t) / (math.pi * t) * math.sin(math.pi * t / 3) / (math.pi * t / 3) if t < 3 else 0.0
    b, c = {"catrom": (0, 0.5), "mitchell": (1 / 3, 1 / 3)}[method]
    if t < 1:
        return ((12 - 9 * b - 6 * c) * t ** 3 + (-18 + 12 * b + 6 * c) * t ** 2 + 6 - 2 * b) / 6
    return ((-b - 6 * c) * t ** 3 + (6 * b + 30 * c) * t ** 2 + (-12 * b - 48 * c) * t + 8 * b + 24 * c) / 6 if t < 2 else 0.0


def plain_pass(points, span, out, method):
    """points: {(line, place): [values]} -> {(line, target): value}, weighted over the pixels there are."""
    radius, scale = {"triangle": 1, "catrom": 2, "mitchell": 2, "lanczos3": 3}[method], span / out
    stretch, got = max(scale, 1), {}
    for (line, place), values in points.items():
        for d in range(out):
            t = abs(place + 0.5 - (d + 0.5) * scale) / stretch
            if t < radius:
                k, (total, weight) = plain_kernel(method, t), got.get((line, d), (0.0, 0.0))
                got[line, d] = (total + k * sum(values), weight + k * len(values))
    return {at: total / weight for at, (total, weight) in got.items() if weight}


@pytest.mark.parametrize("method, size, out", [
    ("lanczos3", (13, 9), (6, 4)), ("mitchell", (5, 4), (17, 11)), ("catrom", (40, 3), (1, 1)), ("triangle", (7, 30), (7, 2)),
])
@pytest.mark.parametrize("strip", [1 << 18, 20])
def test_pixel_table_matches_a_plain_loop(spark, monkeypatch, method, size, out, strip):
    """Gaps and repeated pixels included; strips of many lines and of one."""
    monkeypatch.setattr(resample, "STRIP_PIXELS", strip)
    rng, (w, h), (ow, oh) = random.Random(w_seed := size[0]), size, out
    rows = [("i", w, h, x, y, *(rng.randrange(256) for _ in range(4))) for x in range(w) for y in range(h) if rng.random() < 0.9]
    rows += rows[:3]
    want = {}
    for c in range(4):
        points = {}
        for r in rows:
            points.setdefault((r[4], r[3]), []).append(r[5 + c] / 255)
        across = plain_pass(points, w, ow, method)
        for at, v in plain_pass({(x, y): [v] for (y, x), v in across.items()}, h, oh, method).items():
            want.setdefault(at, []).append(min(255, max(0, math.floor(v * 255 + 0.5 + 1e-9))))
    px, targets = spark.createDataFrame(rows, PX).repartition(3), spark.createDataFrame([("i", ow, oh, "stretch")], "image_id string, out_w int, out_h int, fit string")
    got = resample.resize_kernel(px, targets, method, premultiply=False, linear_rgb=False).collect()
    assert w_seed and {(r.x, r.y): [r.r, r.g, r.b, r.a] for r in got} == want and len(got) == len(want)
    assert {(r.image_id, r.width, r.height) for r in got} == {("i", ow, oh)}


def test_bands_are_sparse_and_equal_the_dense_weights():
    for method in packed.RADIUS:
        for span, out in ((4000, 2000), (7, 50), (50, 7), (1, 9), (9, 1)):
            taps, weight = packed.axis_bands(method, span, out)
            scale = span / out
            t = np.abs(np.arange(span) + 0.5 - (np.arange(out)[:, None] + 0.5) * scale) / max(scale, 1)
            dense = np.where(t < packed.RADIUS[method], packed.kernel_of(method, t), 0)
            got = np.zeros_like(dense)
            np.add.at(got, (np.arange(out)[:, None], taps), weight)
            assert np.allclose(got, dense, atol=1e-12) and taps.shape[1] <= 2 * packed.RADIUS[method] * max(scale, 1) + 3


def test_twelve_megapixels_within_a_bound():
    """48 MB of samples; lines and weights of a band only."""
    raster = np.random.default_rng(1).integers(0, 256, (3000, 4000, 4), dtype=np.uint8)
    tracemalloc.start()
    try:
        out = packed.resample(raster, 2000, 1500, "stretch", "lanczos3", True, True)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out.shape == (1500, 2000, 4) and peak < 120 << 20


def test_empty_and_unmatched_tables(spark):
    targets = spark.createDataFrame([("i", 3, 2, None)], "image_id string, out_w int, out_h int, fit string")
    assert resample.resize_kernel(spark.createDataFrame([], PX), targets).count() == 0
    one = spark.createDataFrame([("other", 1, 1, 0, 0, 1, 2, 3, 4), (None, 2, 1, 0, 0, 9, 9, 9, 255)], PX)
    assert sorted(map(repr, resample.resize_kernel(one, targets).collect())) == sorted(map(repr, one.collect()))


@pytest.mark.parametrize("method", ["lanczos3", "mitchell", "triangle"])
def test_many_strips_at_once_equal_one_at_a_time(method):
    import pyarrow as pa

    rng, rows = random.Random(3), []
    for image in (None, "a", "b", "c", "d"):
        w, h, ow, oh = (rng.randint(1, 30) for _ in range(4))
        for strip in range(-(-oh // 4)):
            for y in range(h):
                line = [{"x": x, "c": rng.randrange(1 << 32)} for x in range(w) if rng.random() < 0.9]
                if line:
                    rows.append({"image_id": image, "y": y, "line": line + line[:1], "__sx": 0, "__sy": 0, "__sw": w, "__sh": h,
                                 "__ow": ow, "__oh": oh, "__tall": 4, "__strip": strip})
    lines = pa.Table.from_pylist(rows)
    starts = resample._strip_starts(lines)
    ends = [*starts[1:], lines.num_rows]
    want = [r for a, b in zip(starts, ends) for r in resample.resample_strip(lines.slice(a, b - a), method, True, True).to_pylist()]
    got = resample.resample_strips(lines, starts, method, True, True).to_pylist()
    order = lambda r: (str(r["image_id"]), r["y"], r["x"])
    assert len(starts) > 5 and sorted(got, key=order) == sorted(want, key=order)
