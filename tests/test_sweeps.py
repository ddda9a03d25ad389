import random

import pytest

from assetlane.functions import savings
from assetlane.operators import sweep
from assetlane.operators.sweep import search_quality
from assetlane.suite import load_cases

CELL = ("image_id int, row int, col int, encoder string, step int, lossless boolean, original_bytes bigint, status string, "
        "size bigint, ssim double")


def pct(src, out):
    import math
    return math.floor((src - out) / src * 100 + 0.5)


def choose(cells, floor=50):
    """The rule as a plain loop, for comparison."""
    done = [c for c in cells if c["status"] == "done"]
    if not done:
        return None
    measured = [c for c in done if c["ssim"] is not None]
    if measured:
        pool = [c for c in measured if c["ssim"] >= 0.985]
        if not pool:
            best = measured[0]
            for c in measured[1:]:
                best = c if c["ssim"] > best["ssim"] else best
            pool = [best]
    else:
        pool = [c for c in done if c["lossless"] or c["step"] >= floor] or done
    pool = [c for c in pool if pct(c["original_bytes"], c["size"]) >= 5] or pool
    best = pool[0]
    for c in pool[1:]:
        if (c["size"], -(c["ssim"] or 0)) < (best["size"], -(best["ssim"] or 0)):
            best = c
    return best["row"], best["col"]


def test_recommend_matches_the_rule(spark):
    rng, cells = random.Random(3), []
    for image in range(150):
        blind = image % 3 == 0
        for row in range(3):
            for col in range(4):
                cells.append(dict(
                    image_id=image, row=row, col=col, encoder=["webp", "avif", "oxipng"][row], step=[30, 50, 70, 90][col] if row < 2 else col,
                    lossless=row == 2, original_bytes=1000, status=rng.choice(["done", "done", "done", "error", "pending"]),
                    size=rng.choice([500, 600, 940, 960, 951, 1200]),
                    ssim=None if blind or rng.random() < 0.2 else rng.choice([0.9, 0.985, 0.99, 0.97, 1.0])))
    df = spark.createDataFrame([tuple(c[k.split()[0]] for k in CELL.split(", ")) for c in cells], CELL)
    got = {r.image_id: (r.row, r.col) for r in sweep.recommend(df).collect()}
    want = {i: choose([c for c in cells if c["image_id"] == i]) for i in range(150)}
    assert got == {i: p for i, p in want.items() if p is not None}


def test_verdict_edges(spark):
    edges = [(1.0, "Lossless", "Identical"), (0.998, "Overkill", "Looks identical"), (0.994, "Excellent", "Looks identical"),
             (0.985, "Good", "Looks identical"), (0.96, "Soft", "Minor loss"), (0.94, "Watch skies", "Visible loss"),
             (0.5, "Visible loss", "Heavy loss"), (float("nan"), "Unmeasured", "Unmeasured"), (None, "Unmeasured", "Unmeasured")]
    df = spark.createDataFrame(edges, "ssim double, v string, s string")
    assert all(r.verdict == r.v and r.short == r.s for r in savings.verdicts(df).collect())


def test_savings_round_half_up_and_keep_nulls(spark):
    df = spark.createDataFrame([(200, 201, 0), (200, 199, 1), (200, 203, -1), (0, 5, 0), (100, None, None)], "original_bytes bigint, size bigint, want bigint")
    assert [r.saved_pct for r in savings.savings(df).collect()] == [0, 1, -1, 0, None]


def test_plan_steps_and_short_effort_lists(spark):
    images = spark.createDataFrame([(1,)], "image_id int")
    got = sweep.sweep_plan(images, ["qoi", "webp"], [10, 20, 30], [1, 3]).orderBy("row", "col").collect()
    assert [(r.step, r.step_label, r.lossless) for r in got] == [
        (1, "Effort 1", True), (3, "Effort 3", True), (3, "Effort 3", True), (10, "Quality 10", False),
        (20, "Quality 20", False), (30, "Quality 30", False)]


def test_bars(spark):
    df = spark.createDataFrame([(1, "a", 100, 1.0), (1, "a", 29, 1.0), (1, "a", 1, 1.0), (1, "a", None, None), (2, "a", None, None)],
                               "image_id int, encoder string, size bigint, ssim double")
    assert sorted(r.bar_pct for r in sweep.bar_percent(df).collect()) == [0, 0, 2, 29, 100]


def test_every_image_with_a_done_cell_has_one_pick(spark, sf):
    rows = load_cases()["sweep_summary"].run(spark, sf).collect()
    assert rows and all((r.completed > 0) == (r.recommended is not None) for r in rows)


@pytest.mark.parametrize("encodes", [0, 1, 3, 6, 7])
def test_search_finds_what_the_whole_sweep_finds(spark, encodes):
    least = {i: 30 + i for i in range(66)} | {66: None, 67: None}
    images = spark.createDataFrame([(i, "x") for i in [*least, 5, 5, None]], "image_id int, step string")
    asked = []

    def probe(wanted):
        rows = wanted.collect()
        assert all(r["image_id"] is not None for r in rows) and len({r["image_id"] for r in rows}) == len(rows)
        asked.extend((r["image_id"], r["step"]) for r in rows)
        out = []
        for i, step in rows:
            good = least[i] is not None and step >= least[i]
            out.append((i, step, step * 10, 0.995 if good else 0.5))
            if i == 3:  # measured twice: the worst counts
                out.append((i, step, step * 10 + 1, 0.999))
            if i == 66:
                out[-1] = (i, step, 1, [None, float("nan")][step % 2])
        return spark.createDataFrame([r for r in out if r[0] != 67], "image_id int, step int, size int, ssim double")

    found = {r["image_id"]: r for r in search_quality(images, probe, encodes=encodes).collect()}
    assert set(found) == set(least) and len(asked) == len(set(asked)) == sum(r["encodes"] for r in found.values())
    for i, r in found.items():
        low, high, step = 30, 95, None
        for used in range(encodes):
            if low > high:
                break
            mid = (low + high) // 2
            if least[i] is not None and mid >= least[i]:
                step, high = mid, mid - 1
            else:
                low = mid + 1
        assert (r["step"], r["exact"]) == (step, low > high) and r["encodes"] <= encodes
        assert r["size"] == (step and step * 10) and r["ssim"] == (step and 0.995)
        if r["exact"]:
            assert r["step"] == least[i]
        elif encodes == 6 and least[i] is not None:
            assert least[i] == 95 if r["step"] is None else r["step"] - least[i] in (0, 1)
    assert encodes < 7 or all(r["exact"] for r in found.values())


def test_search_of_nothing(spark):
    def probe(wanted):
        return wanted.selectExpr("image_id", "step", "1 AS size", "CAST(1 AS DOUBLE) AS ssim")

    images = spark.createDataFrame([], "image_id int")
    assert search_quality(images, probe).collect() == []
    with pytest.raises(ValueError):
        search_quality(images, probe, low=9, high=8)
