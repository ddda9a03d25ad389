import pytest
from pyspark.sql import functions as F

from assetlane.plans import ordered
from assetlane.streaming import jobs
from assetlane.suite import load_cases
from assetlane.suite.events import drain


@pytest.mark.parametrize("batch,stream", [
    ("debounce_edits", "debounce_edits_stream"), ("idle_sessions", "idle_sessions_stream"), ("progress", "progress_stream"),
    ("drop_superseded", "drop_superseded_stream"),
])
def test_stream_equals_its_batch_twin(spark, sf, batch, stream):
    cases = load_cases()
    want, got = (sorted(map(tuple, cases[n].run(spark, sf).collect())) for n in (batch, stream))
    assert want and got == want


def test_landing_folder_takes_each_image_once(spark, tmp_path):
    (tmp_path / "in" / ".hid").mkdir(parents=True)
    for name, data in (("a.png", b"\x89PNG\r\n\x1a\n"), ("b.txt", b"x"), (".hid/c.png", b"1"), ("d.JPG", b"2")):
        (tmp_path / "in" / name).write_bytes(data)
    landed = jobs.intake_stream(spark, str(tmp_path / "in"))
    got = sorted((r.rel_path, r.bytes) for r in drain(landed.select("rel_path", "bytes")).collect())
    assert got == [("a.png", 8), ("d.JPG", 1)]


def test_budget(spark):
    df = spark.createDataFrame([(0, 20.0), (10_000_000, 60.0), (50_000_000, 120.0), (None, 120.0)], "px bigint, want double")
    assert all(r.b == r.want for r in df.withColumn("b", jobs.call_budget(F.col("px"))).collect())


def test_running_values_across_chunks_equal_a_window(spark):
    df = spark.range(500).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(0).alias("k"), F.col("id").alias("seq"),
        (F.col("id") * 37 % 101).alias("v"))
    got = ordered.running_sum(df, ["k"], [F.col("seq")], F.col("v"), "s", ordered.by_step("seq", 9))
    got = ordered.running_max(got, ["k"], [F.col("seq")], F.col("v"), "m", ordered.by_step("seq", 11), before=True)
    want = df.selectExpr(
        "*", "sum(v) over (partition by k order by seq) as s",
        "max(v) over (partition by k order by seq rows between unbounded preceding and 1 preceding) as m")
    assert sorted(got.select("k", "seq", "v", "s", "m").collect(), key=lambda r: r.seq) == sorted(want.collect(), key=lambda r: r.seq)


def test_one_endless_session_over_many_chunks(spark):
    df = spark.range(200).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 10 + F.when(F.col("id") >= 150, 500).otherwise(0)).alias("ts"))
    starts = ordered.sessions(df, ["k"], "ts", 10, 60).groupBy("session_start").count().orderBy("session_start").collect()
    assert [r["count"] for r in starts] == [150, 50]


def test_intake_stream_types_by_head_and_name(spark, tmp_path):
    from assetlane.suite.events import drain

    for name, body in {"a.svg": b"<svg/>", "plain": b"\x89PNG\r\n\x1a\n0000", "b.txt": b"hello", "c.png": b"x"}.items():
        (tmp_path / name).write_bytes(body)
    rows = drain(jobs.intake_stream(spark, str(tmp_path)).select("name", "mime")).collect()
    assert {(r.name, r.mime) for r in rows} == {("a.svg", "image/svg+xml"), ("plain", "image/png"), ("c.png", "image/png")}
    every = drain(jobs.intake_stream(spark, str(tmp_path), images_only=False, max_bytes=5).select("name")).collect()
    assert {r.name for r in every} == {"b.txt", "c.png"}


def test_latest_status_in_update_mode(spark, sf):
    from assetlane.suite import events as E

    query = (
        jobs.latest_status(E._item_events(E._stream(spark, sf))).writeStream.outputMode("update").format("memory")
        .queryName("latest_status_now").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = spark.table("latest_status_now").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, load_cases()["latest_status"].run(spark, sf).collect()))


def test_latch_is_one_way_and_only_its_call_runs_again(spark):
    rows = [
        ("a", 1, 1, False, True), ("a", 2, 2, True, True), ("a", 2, 3, False, True),   # latches, retried
        ("a", 3, 4, True, True), ("a", 3, 5, False, True),                             # after the latch: no retry
        ("a", 4, 6, False, True),
        ("b", 5, 1, True, False), ("b", 5, 2, False, False), ("b", 6, 3, True, True),  # not retryable, but it latches
        ("c", 7, 1, True, None), ("c", 7, 2, True, True), ("c", 7, 3, False, True),    # no third attempt
        ("d", 8, 1, True, True), ("e", 9, 1, None, None), ("e", None, 2, True, True), ("e", None, 3, False, True),
        (None, 1, 1, True, True), ("f", 1, None, True, True),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "bridge string, call_id int, seq int, failed boolean, retryable boolean, latched string")
    got = {(r["bridge"], r["call_id"]): (r["outcome"], r["attempts"], r["mode"]) for r in jobs.latched_outcomes(df).collect()}
    assert got == {
        ("a", 1): ("ok", 1, "threads"), ("a", 2): ("retried-ok", 2, "switched"), ("a", 3): ("load-error", 1, "single"),
        ("a", 4): ("ok", 1, "single"), ("b", 5): ("load-error", 1, "switched"), ("b", 6): ("load-error", 1, "single"),
        ("c", 7): ("load-error", 2, "switched"), ("d", 8): ("unfinished", 1, "switched"), ("e", 9): ("ok", 1, "threads"),
        ("e", None): ("retried-ok", 2, "switched"),
    }
    assert jobs.latched_outcomes(df.limit(0)).collect() == []
