"""Pixels of kernel resampling are shuffled once, packed; images pass, go together or go strip by strip."""
import numpy as np
import pytest

from assetlane.operators import packed, resample

PX = "image_id string, width int, height int, x int, y int, r int, g int, b int, a int"
TARGETS = "image_id string, out_w int, out_h int, fit string"


@pytest.fixture
def conf(spark):
    held = {}

    def put(key, value):
        held.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield put
    for key, value in held.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def rasters(seed):
    rng = np.random.default_rng(seed)
    return {f"i{k}": rng.integers(0, 256, (*rng.integers(1, 24, 2), 4)) for k in range(25)}


def table(spark, images):
    rows = [(i, v.shape[1], v.shape[0], x, y, *v[y, x].tolist()) for i, v in images.items() for y in range(v.shape[0]) for x in range(v.shape[1])]
    np.random.default_rng(1).shuffle(rows)
    return rows


def test_no_pixel_is_joined_where_targets_are_not_broadcast(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    images = rasters(1)
    px = spark.createDataFrame([tuple(map(lambda v: v if isinstance(v, str) else int(v), r)) for r in table(spark, images)], PX)
    targets = spark.createDataFrame([(i, 5, 4, "stretch") for i in images], TARGETS)
    plan = resample.resize_kernel(px, targets, "catrom")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize("strip", [1, 150, 1 << 18])
def test_images_of_all_kinds_side_by_side(spark, conf, monkeypatch, strip):
    """Images go over many batches; levels that are no bytes pass unchanged."""
    conf("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    monkeypatch.setattr(resample, "STRIP_PIXELS", strip)
    images = rasters(2)
    goals = {i: (1 + k * 5 % 23, 1 + k * 7 % 19, "contain" if k % 2 else "stretch") for k, i in enumerate(images) if k % 5}
    goals["i6"] = (images["i6"].shape[1], images["i6"].shape[0], "contain")
    rows = [tuple(v if isinstance(v, str) else int(v) for v in r) for r in table(spark, images)]
    odd = [(None, 2, 1, 0, 0, 1, None, 300, -5), (None, 2, 1, 1, 0, 9, 9, 9, 255), ("odd", 1, 1, None, 0, 7, 7, 7, 7), ("odd", 1, 1, 0, 0, 1 << 20, 0, 0, 0)]
    px = spark.createDataFrame([*rows, *odd], PX).repartition(3)
    got, passed = {}, []
    for r in resample.resize_kernel(px, spark.createDataFrame([(i, *g) for i, g in goals.items()], TARGETS), "mitchell", True, False).collect():
        if r.image_id in images:
            got.setdefault(r.image_id, {})[r.x, r.y] = (r.width, r.height, r.r, r.g, r.b, r.a)
        else:
            passed.append(tuple(r))
    assert sorted(map(repr, passed)) == sorted(map(repr, odd))
    for i, raster in images.items():
        want = raster.astype(np.uint8)
        if i in goals:
            want = packed.resample(want, *goals[i], "mitchell", True, False)
        h, w = want.shape[:2]
        assert got[i] == {(x, y): (w, h, *want[y, x].tolist()) for y in range(h) for x in range(w)}


def test_packed_rows_hold_one_channel_after_the_other(spark):
    """Alike levels lie together, and rows come apart as they were."""
    import pyarrow as pa

    from assetlane.operators import pixels

    px = spark.createDataFrame([("b", 2, 2, k % 2, k // 2, 10 + k, 20 + k, 30 + k, 255) for k in range(4)] + [("a", 1, 1, 0, 0, 1, 2, 3, 4)], PX).coalesce(1)
    runs = pixels._pixel_runs(px, 2)
    held = {r.image_id: bytes(r.data) for r in runs.collect()}
    assert held["b"] == bytes([10, 11, 12, 13, 20, 21, 22, 23, 30, 31, 32, 33, 255, 255, 255, 255]) and held["a"] == bytes([1, 2, 3, 4])
    of, found = pixels._flat_runs(pa.Table.from_batches(runs.toArrow().to_batches()))
    rows = {(int(i), *(found[c][k].as_py() for c in "xyrgba")) for k, i in enumerate(of)}
    assert len(rows) == 5 and sum((0, 0, 1, 2, 3, 4) == r[1:] for r in rows) == 1 and sum((1, 1, 13, 23, 33, 255) == r[1:] for r in rows) == 1
