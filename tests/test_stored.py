"""State stored batch by batch (T2, T3) and heads of files."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from assetlane.functions import filetypes
from assetlane.sources.assets import read_heads
from assetlane.streaming import stored

STATUS = "item_id bigint, ts timestamp, seq bigint, status string, out_size bigint, error string"
RUNS = "run_id bigint, ts timestamp, status string, src_size bigint, out_size bigint"
START = datetime(2024, 1, 1)


def batches(spark, folder, schema, parts):
    """The parts as files that a stream takes one at a time, in order."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/n={i}")
    return (spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1)
            .parquet(folder))


def test_stored_status_survives_replays(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), START + timedelta(minutes=rng.randrange(50)), i, rng.choice(["queued", "done", "error"]),
             rng.randrange(9), None) for i in range(120)]
    parts, folder = [rows[i:i + 40] for i in (0, 40, 80)], str(tmp_path / "out")
    stream = batches(spark, str(tmp_path / "in"), STATUS, parts)
    stored.store_status(stream, folder).awaitTermination()
    want = {}
    for r in rows:
        if r[0] not in want or r[1:3] > want[r[0]][1:3]:
            want[r[0]] = r
    want = {k: (r[3], r[4], r[5], r[1]) for k, r in want.items()}

    def got():
        return {r[0]: tuple(r)[1:] for r in stored.stored_status(spark, folder, stream.schema).collect()}

    assert got() == want
    for _ in range(2):
        stored.put_status(spark.createDataFrame(parts[1], STATUS), 1, folder)
    assert got() == want
    assert {r["batch"] for r in spark.read.parquet(f"{folder}/status").select("batch").collect()} == {0, 1, 2}


def test_stored_progress_counts_late_rows(spark, tmp_path):
    rng = random.Random(2)
    parts = []
    for i in range(4):
        # most rows of a batch come in its hours, some long before
        hours = [3 * i + rng.random() * 3 if rng.random() < 0.7 else rng.random() * 3 * (i + 1) for _ in range(50)]
        parts.append([(rng.randrange(3), START + timedelta(seconds=int(h * 3600)), rng.choice(["done", "error", "queued"]),
                       rng.randrange(100), rng.randrange(50)) for h in hours])
    folder = str(tmp_path / "out")
    # put in order here: a stream takes files by time of change, which may tie
    frames = [spark.createDataFrame(p, RUNS) for p in parts]
    for i, frame in enumerate(frames):
        stored.put_progress(frame, i, folder, "1 hour", None, "1 hour")
    want, late, newest = {}, {}, None
    for part in parts:
        mark = newest and newest - timedelta(hours=1)
        for run, ts, status, src, out in part:
            begin = ts.replace(minute=0, second=0)
            if mark and begin + timedelta(hours=1) <= mark:
                late[run] = late.get(run, 0) + 1
                continue
            w = want.setdefault((run, begin, begin + timedelta(hours=1)), [0] * 5)
            done = status == "done"
            for k, v in enumerate((1, done, status == "error", src * done, out * done)):
                w[k] += v
        newest = max([t for _, t, *_ in part] + ([newest] if newest else []))

    def check():
        rows = stored.stored_progress(spark, folder, frames[0].schema).collect()
        assert {tuple(r)[:3]: list(r)[3:] for r in rows} == want
        assert {r[0]: r[1] for r in stored.stored_late(spark, folder, frames[0].schema).collect()} == late

    assert sum(late.values()) > 10
    check()
    for i in (1, 3, 1):
        stored.put_progress(frames[i], i, folder, "1 hour", None, "1 hour")
    check()


def test_stored_progress_of_a_stream_and_of_nothing(spark, tmp_path):
    stream = batches(spark, str(tmp_path / "in"), RUNS, [[(1, START, "done", 5, 2), (1, None, "done", 5, 2)]])
    stored.store_progress(stream, str(tmp_path / "out")).awaitTermination()
    rows = stored.stored_progress(spark, str(tmp_path / "out"), stream.schema).collect()
    assert [tuple(r)[3:] for r in rows] == [(1, 1, 0, 5, 2)]
    empty = spark.createDataFrame([], RUNS)
    stored.put_progress(empty, 0, str(tmp_path / "none"))
    assert stored.stored_progress(spark, str(tmp_path / "none"), empty.schema).collect() == []
    assert stored.stored_late(spark, str(tmp_path / "none"), empty.schema).collect() == []


def test_heads_of_files_larger_than_a_row_may_be(spark, tmp_path):
    """Five sparse gigabytes: a reader of whole files would fail on them."""
    (tmp_path / "sub dir").mkdir()
    png = b"\x89PNG\r\n\x1a\n" + b"x" * 40
    with open(tmp_path / "sub dir" / "a 100%.png", "wb") as file:
        file.write(png)
        file.truncate(5 << 30)
    (tmp_path / "b.gif").write_bytes(b"GIF89a")
    (tmp_path / "none.bin").write_bytes(b"")
    rows = {r["rel_path"]: r for r in read_heads(spark, str(tmp_path), 16).collect()}
    assert {k: (bytes(r["head"]), r["bytes"], r["depth"]) for k, r in rows.items()} == {
        "sub dir/a 100%.png": (png[:16], 5 << 30, 1), "b.gif": (b"GIF89a", 6, 0)}
    typed = filetypes.resolve_mime(read_heads(spark, str(tmp_path), glob="*.png").withColumns(
        {"declared": F.lit(""), "name": F.lit("x")}))
    assert [r["mime"] for r in typed.collect()] == ["image/png"]
    assert read_heads(spark, str(tmp_path), max_depth=0).count() == 1


def test_marks_are_searched_in_all_bytes_unless_told(spark):
    far = b"\0" * filetypes.HDR_BYTES
    box = b"colrnclx\x00\x09\x00\x10\x00"
    rows = [(1, bytearray(far + box), "image/avif"), (2, bytearray(far[:-12] + box), "image/avif"),
            (3, bytearray(far + b"hdrgm:Version"), "image/jpeg"), (4, None, "image/avif"), (5, bytearray(b""), None)]
    df = spark.createDataFrame(rows, "id int, head binary, mime string")

    def kinds(n):
        out = filetypes.gamut_space(filetypes.hdr_flags(df, scan_bytes=n), scan_bytes=n)
        return {r["id"]: (r["hdr_kind"], r["color_space"]) for r in out.collect()}

    plain = (None, "srgb")
    assert kinds(None) == {1: ("pq", "display-p3"), 2: ("pq", "display-p3"), 3: ("gainmap", "srgb"), 4: plain, 5: plain}
    assert kinds(filetypes.HDR_BYTES) == {1: plain, 2: kinds(None)[2], 3: plain, 4: plain, 5: plain}
