"""Cases that once gave wrong answers or lost rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlane.functions.settings import fingerprint
from assetlane.operators import intake, pixels, resample, sweep
from assetlane.session import ensure_checkpoint_dir
from assetlane.sources.assets import export_presets, read_presets, scan_assets
from assetlane.streaming import jobs

CELL = "image_id int, row int, col int, encoder string, step int, lossless boolean, original_bytes bigint, status string, size bigint, ssim double"


def pixel_rows(spark, image, image_id=1):
    h, w, _ = image.shape
    rows = [(image_id, w, h, x, y, *map(int, image[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id int, width int, height int, x int, y int, r int, g int, b int, a int")


def boxes(image, step):
    """Plain loop over the samples as stored, row after row."""
    h, w, _ = image.shape
    flat, out_w, out_h = image.reshape(-1, 4), max(1, w // step), max(1, h // step)
    out = np.zeros((out_h, out_w, 4))
    for oy in range(out_h):
        for ox in range(out_w):
            for sy in range(step):
                for sx in range(step):
                    i = (oy * step + sy) * w + ox * step + sx
                    if i < w * h:
                        out[oy, ox] += flat[i]
    return np.rint(out / step ** 2).astype(int)


@pytest.mark.parametrize("shape,step", [((30, 1), 4), ((2, 25), 5), ((9, 7), 3), ((1, 1), 3), ((12, 3), 4)])
def test_boxes_of_narrow_images(spark, shape, step):
    image = np.random.default_rng(1).integers(0, 256, (*shape, 4))
    want = boxes(image, step)
    got = np.zeros_like(want)
    rows = pixels.box_downscale(pixel_rows(spark, image), step).collect()
    for r in rows:
        got[r.y, r.x] = r.r, r.g, r.b, r.a
    assert len(rows) == want.shape[0] * want.shape[1] and (got == want).all()


def test_strips_are_scored_alike_in_both_forms(spark):
    strip = lambda v: np.tile(np.array([v, v, v, 255]), (300, 1, 1))
    black, white = strip(0), strip(255)
    score = pixels.measure_ssim(pixel_rows(spark, black), pixel_rows(spark, white), 100).first()
    packed = spark.createDataFrame([(1, 1, 300, bytearray(black.astype(np.uint8).tobytes()), bytearray(white.astype(np.uint8).tobytes()))],
                                   "image_id int, width int, height int, ref binary, out binary")
    other = pixels.ssim_packed(packed, 100).first()
    assert score.error is None and other.error is None
    assert score.ssim < 0.1 and abs(score.ssim - other.ssim) < 1e-9


def test_images_of_their_target_size_are_not_resampled(spark):
    image = np.random.default_rng(2).integers(0, 256, (5, 6, 4))
    px = pixel_rows(spark, image).unionByName(pixel_rows(spark, image, 2)).unionByName(pixel_rows(spark, image, 3))
    targets = spark.createDataFrame([(2, 6, 5, "stretch"), (3, 3, 3, "stretch")], "image_id int, out_w int, out_h int, fit string")
    out = resample.resize_kernel(px, targets, "mitchell")
    same = lambda df: sorted(map(tuple, df.where("image_id < 3").collect()))
    assert same(out) == same(px.select(*out.columns)) and out.where("image_id = 3").count() == 9


def test_nan_scores_are_never_picked(spark):
    nan = float("nan")
    cells = spark.createDataFrame([
        (1, 0, 0, "webp", 50, False, 1000, "done", 100, nan), (1, 0, 1, "webp", 70, False, 1000, "done", 300, 0.99),
        (2, 0, 0, "webp", 50, False, 1000, "done", 100, nan), (2, 0, 1, "webp", 70, False, 1000, "done", 300, 0.5)], CELL)
    assert {(r.image_id, r.size) for r in sweep.recommend(cells).collect()} == {(1, 300), (2, 300)}
    assert [(r.image_id, r.step) for r in sweep.lowest_quality(cells, 0.98).collect()] == [(1, 70)]


def test_separators_inside_settings_make_other_keys(spark):
    side = '{"encoderId":"webp","encoderOptions":%s}'
    rows = [(side % o,) for o in ('{"a":"x\\u001eb=string:y"}', '{"a":"x","b":"y"}', '{"b":"y","a":"x"}', '{"a":"x\\",\\"b"}', '{}')]
    keys = [r.fp for r in fingerprint(spark.createDataFrame(rows, "settings_json string")).collect()]
    assert keys[1] == keys[2] and len(set(keys)) == 4


def test_preset_files_of_every_form(spark, tmp_path):
    preset = '{"v":1,"name":"a","side":{"encoderId":"webp","encoderOptions":{}}}'
    for name, text in {"one": preset, "many": f"[{preset},{preset}]", "none": "[]", "bad": "{oops", "null": "null"}.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows = read_presets(spark, str(tmp_path)).collect()
    found = {}
    for r in rows:
        found.setdefault(os.path.basename(r.file)[:-5], []).append((r.name, r.reject_reason))
    assert [n for n, _ in found["one"]] == ["a"] and [n for n, _ in found["many"]] == ["a", "a"]
    assert found["bad"] == [(None, "not-json")] and "none" not in found and found["null"][0][1] is not None


def test_exported_libraries_come_back(spark, tmp_path):
    preset = '{"v":1,"name":"%s","side":{"encoderId":"webp","encoderOptions":{}}}'
    rows = spark.createDataFrame([(i % 2, preset % i) for i in range(5)], "library_id int, preset_json string")
    export_presets(rows, str(tmp_path / "out"))
    back = read_presets(spark, str(tmp_path / "out" / "*" / "*.txt"))
    assert {r.name for r in back.collect()} == set("01234")


def test_roots_may_be_relative_or_hold_wildcards(spark, tmp_path, monkeypatch):
    for path in ("rel/sub/a.txt", "rel/b.txt", "other/c.txt"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x")
    here = os.path.relpath(tmp_path, os.getcwd())
    for root in (f"{here}/rel", f"{tmp_path}/rel/", f"file://{tmp_path}/rel"):
        assert {(r.rel_path, r.depth) for r in scan_assets(spark, root).collect()} == {("sub/a.txt", 1), ("b.txt", 0)}
    found = scan_assets(spark, f"{tmp_path}/*").collect()
    assert {r.rel_path for r in found} == {"rel/sub/a.txt", "rel/b.txt", "other/c.txt"}


def test_notes_join_and_sizes_are_flagged(spark):
    big = 60 << 20
    drops = spark.createDataFrame([
        (1, 1, "a.png", "", big), (2, 1, "b.pdf", "", 5), (3, 2, "c.png", "", big), (4, 3, "d.txt", "", 5), (5, 4, "e.png", "", 5)],
        "seq bigint, drop_id bigint, path string, declared string, bytes bigint")
    notes = {r.drop_id: r.note for r in intake.route_drops(drops).collect()}
    assert notes == {1: "Drop a PDF on its own to compress it. · Skipped (over 50 MB): 1", 2: "Skipped (over 50 MB): 1",
                     3: "No readable images in that drop.", 4: None}
    assert {(r.seq, r.oversize) for r in intake.intake_filter(drops).collect()} == {(1, True), (3, True), (5, False)}
    assert [tuple(r) for r in intake.oversize_names(drops).orderBy("drop_id").collect()] == [(1, 1, "a.png"), (2, 1, "c.png")]


def test_a_stored_call_that_ended_late_is_late_not_hung(spark):
    starts = spark.sql("SELECT 1 AS call_id, timestamp'2024-01-01 00:00:00' AS ts, 1000000 AS pixels UNION ALL SELECT 2, timestamp'2024-01-01 00:00:00', 1")
    ends = spark.sql("SELECT 1 AS call_id, timestamp'2024-01-01 00:03:00' AS ts")
    found = {r.call_id: r.status for r in jobs.overdue_calls(starts, ends, watermark=None).collect()}
    assert found == {1: "late", 2: "hung"}


def test_short_rasters_are_listed(spark):
    df = spark.createDataFrame([(1, 2, 2, bytearray(16)), (2, 2, 2, bytearray(3)), (3, 0, 2, bytearray(1)), (4, 1, 1, None)],
                               "image_id int, width int, height int, data binary")
    assert {(r.image_id, r.error) for r in pixels.explode_rejects(df).collect()} == {
        (2, "too few samples"), (3, "image has no area"), (4, "no samples")}
    assert pixels.explode_pixels(df).select(F.countDistinct("image_id")).first()[0] == 1


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())


def test_packed_forms_equal_the_pixel_forms(spark):
    from assetlane.operators import packed

    rng = np.random.default_rng(5)
    images = {i: rng.integers(0, 256, (h, w, 4)) for i, (h, w) in enumerate([(7, 9), (1, 5), (12, 4), (6, 6)], 1)}
    px = None
    for i, image in images.items():
        rows = pixel_rows(spark, image, i)
        px = rows if px is None else px.unionByName(rows)
    rows = [(i, m.shape[1], m.shape[0], bytearray(m.astype(np.uint8).tobytes())) for i, m in images.items()]
    whole = spark.createDataFrame(rows, "image_id int, width int, height int, data binary")
    targets = spark.createDataFrame([(1, 4, 11, "contain"), (2, 3, 2, "stretch"), (3, 12, 3, "contain")], "image_id int, out_w int, out_h int, fit string")

    def same(a, b):
        b = pixels.explode_pixels(b)
        assert sorted(map(tuple, a.select(*pixels.PX).collect())) == sorted(map(tuple, b.select(*pixels.PX).collect()))

    for method in ("triangle", "catrom", "mitchell", "lanczos3", "browser-pixelated"):
        same(resample.resize(px, targets, method), packed.resize_packed(whole, targets, method))
    same(pixels.rotate(px, F.col("image_id") * 90), packed.rotate_packed(whole.withColumn("angle", F.col("image_id") * 90)))
    rects = spark.createDataFrame([(1, 1.5, 2.0, 3.2, 90.0), (3, -4.0, 0.0, 0.0, 2.0)], "image_id int, rx double, ry double, rw double, rh double")
    same(pixels.crop(px, rects), packed.crop_packed(whole, rects))
    short = whole.withColumn("data", F.substring("data", 1, 3))
    assert {r.data for r in packed.rotate_packed(short.withColumn("angle", F.lit(90))).collect()} == {None}


def test_stream_bodies_are_not_shuffled(spark):
    from assetlane.operators.pdf import dedupe_images

    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(1, 1, "/Image", bytearray(b"x")), (1, 2, "/Image", bytearray(b"x")), (1, 3, "/Image", bytearray(b"y"))],
                                   "doc_id int, obj_no int, subtype string, contents binary")
        found = dedupe_images(df)
        assert [tuple(r) for r in found.collect()] == [(1, 2, 1)]
        plan = found._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.splitlines() if "Exchange" in line or "Sort [" in line]
        assert moved and not any("contents" in line for line in moved)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
