import random
import re

import pandas as pd
import pytest

from assetlane.operators import batch
from assetlane.operators.encode import custom_metric, run_encodes
from assetlane.suite import load_cases


def place(names):
    """The naming rule as a plain loop, for comparison."""
    used, out = set(), []
    for name in names:
        found = name
        if name in used:
            stem, ext = re.match(r"^(.*?)(\.[^./\\]*)?$", name, re.S).groups()
            n = 2
            while f"{stem} ({n}){ext or ''}" in used:
                n += 1
            found = f"{stem} ({n}){ext or ''}"
        used.add(found)
        out.append(found)
    return out


def entries(spark, names, chunk_rows=4):
    df = spark.createDataFrame(pd.DataFrame({"run_id": 1, "seq": range(len(names)), "path": names}))
    got = batch.archive_paths(df, chunk_rows=chunk_rows).orderBy("seq").collect()
    return [r.entry_path for r in got]


@pytest.mark.parametrize("names", [
    ["a.png", "a (2).png", "a.png"],
    ["a.png", "a.png", "a (2).png", "a (2).png", "a.png"],
    ["a (2).png", "a.png", "a.png", "a (2) (2).png", "a (2).png"],
    ["x", "x", "x (2)", "x/y.d/z", "x/y.d/z", "x/y.d/z (2)"],
    [".hid", ".hid", " (2).hid", "a (02).png", "a.png", "a.png"],
    ["a (3).png", "a.png", "a.png", "a.png", "a (3).png", "a (2).png"],
])
def test_archive_names_meet_copies(spark, names):
    assert entries(spark, names) == place(names)


def test_archive_names_random_families(spark):
    pool = ["a.png", "a (2).png", "a (3).png", "a (2) (2).png", "a (5).png", "b", "b (2)", "b (2) (3)"]
    frames, want = [], {}
    for run in range(40):
        rng = random.Random(run)
        names = [rng.choice(pool) for _ in range(rng.randint(2, 40))]
        want.update({(run, i): p for i, p in enumerate(place(names))})
        frames.append(pd.DataFrame({"run_id": run, "seq": range(len(names)), "path": names}))
    df = spark.createDataFrame(pd.concat(frames))
    got = {(r.run_id, r.seq): r.entry_path for r in batch.archive_paths(df, chunk_rows=5).collect()}
    assert got == want


def test_archive_links_are_cut_to_what_copies_reach(spark):
    dense = ["a.png"] + [f"a ({n}).png" for n in range(2, 400)]
    far = ["b", "b", "b"] + [f"b ({n})" for n in (2, 4, 9, 10, 500, 10**17)]
    names = dense + far
    assert entries(spark, names) == place(names) and entries(spark, names[::-1]) == place(names[::-1])
    counted = spark.createDataFrame([(1, p, names.count(p), names.index(p)) for p in set(names)], "run_id int, path string, count bigint, seq bigint")
    assert sorted(r.path for r in batch._links(counted, 4).collect()) == ["b (2)", "b (4)"]


def test_archive_clashing_query_matches_loop(spark, sf):
    rows = load_cases()["archive_paths_clashing"].run(spark, sf).toPandas().sort_values(["run_id", "seq"])
    for _run, group in rows.groupby("run_id"):
        assert list(group.entry_path) == place(list(group.path))


def test_progress_counts_add_up(spark, sf):
    rows = load_cases()["batch_progress"].run(spark, sf).collect()
    assert rows and all(r.done + r.errored + r.processing + r.pending == r.total for r in rows)


def test_encodes_isolate_failures_and_check_types(spark):
    plan = spark.createDataFrame(
        [(1, 1, "oxipng", "ok", "image/png"), (2, 1, "oxipng", "bad", "image/png"), (3, 1, "identity", "", "image/png"),
         (4, 2, "oxipng", "boom", "image/png"), (5, 3, "oxipng", "ok", None)],
        "item_id bigint, image_id bigint, encoder string, settings_json string, out_mime string",
    )
    images = spark.createDataFrame([(1, b"raw"), (2, b"x")], "image_id bigint, content binary")
    png = bytes.fromhex("89504E470D0A1A0A")

    def encode(content, settings):
        if settings == "boom":
            raise RuntimeError("codec failed")
        return png + content if settings == "ok" else content

    got = {r.item_id: (r.status, r.out_size, r.error) for r in run_encodes(plan, images, encode).collect()}
    assert got == {
        1: ("done", 11, None), 2: ("error", None, "output is not image/png"), 3: ("done", 3, None),
        4: ("error", None, "codec failed"), 5: ("error", None, "source not found"),
    }


def test_metric_that_fails_is_null(spark):
    pairs = spark.createDataFrame(
        [(1, 1, 1, b"a", b"b"), (2, 1, 1, b"a", b"")], "image_id bigint, width int, height int, ref binary, out binary"
    )
    got = {r.image_id: r.score for r in custom_metric(pairs, lambda a, b, w, h: a[0] - b[0]).collect()}
    assert got == {1: -1.0, 2: None}
