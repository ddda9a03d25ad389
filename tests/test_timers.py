"""Scans in chunks by rows, and stream operators with timers, on several triggers and hot keys."""
import random
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from assetlane.plans import ordered
from assetlane.streaming import jobs, timers
from assetlane.suite import load_cases
from assetlane.suite.events import drain

T0 = datetime(2024, 5, 1, tzinfo=timezone.utc)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def stream_of(spark, folder, batches, schema):
    """A file stream that takes one batch of rows a trigger, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/b{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def scans(df):
    return len(re.findall(r"FileScan|Scan parquet|BatchScan|Scan ExistingRDD", df._jdf.queryExecution().executedPlan().toString()))


def test_chunks_hold_a_bounded_number_of_rows(spark):
    """Epoch microseconds, one hot key, bursts and ties."""
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 50).alias("k"),
        (F.lit(1_700_000_000_000_000) + F.when(F.col("id") < 9000, F.col("id") * 3).otherwise(F.col("id") * 7_000_000)).alias("seq"))
    cut, more = ordered.cut(df, F.col("seq"), 500)
    sizes = [r["count"] for r in cut.groupBy("k", "__chunk").count().collect()]
    assert more and max(sizes) <= 520
    ranges = cut.groupBy("__chunk").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).orderBy("__chunk").collect()
    assert len(ranges) == 40 and all(a["hi"] < b["lo"] for a, b in zip(ranges, ranges[1:]))
    got = ordered.running_position(df, ["k"], [F.col("seq")], "n", 500)
    want = df.selectExpr("*", "CAST(row_number() OVER (PARTITION BY k ORDER BY seq) AS BIGINT) AS n")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    one, more = ordered.cut(df.where("false"), F.col("seq"), 500)
    assert not more and one.count() == 0


@pytest.mark.parametrize("rows", [3, 17, 10 ** 6])
def test_spans_over_chunks_equal_a_loop(spark, rows):
    rng = random.Random(4)
    events = [(rng.choice(["a", "a", "a", "b", None]), at(round(rng.random() * 400, 1)), i, f"s{i}", rng.random() < 0.1) for i in range(400)]
    events += [("z", at(10), 1000 + i, f"z{i}", i == 2) for i in range(6)]
    df = spark.createDataFrame(events, "key string, ts timestamp, seq bigint, settings string, once boolean")
    got = jobs.debounce_edits_batch(df, gap_seconds=2, chunk_rows=rows, at_once=F.col("once"))
    assert sorted(map(repr, (tuple(r) for r in utc(got).collect()))) == sorted(map(repr, plain_spans(events, 2)))


def utc(df):
    return df.withColumns({c: F.date_format(c, "HH:mm:ss.SSS") for c in ("start", "end")})


def plain_spans(events, gap):
    out = []
    for key in {e[0] for e in events}:
        span = None
        for _, ts, seq, settings, once in sorted((e for e in events if e[0] == key), key=lambda e: (e[1], e[2])):
            if span and (ts - span[1]).total_seconds() > gap:
                out.append((key, *span))
                span = None
            span = (span[0] if span else ts, ts, settings, (span[3] if span else 0) + 1)
            if once:
                out.append((key, *span))
                span = None
        if span:
            out.append((key, *span))
    return [(k, *(t.strftime("%H:%M:%S.%f")[:-3] for t in (a, b)), s, n) for k, a, b, s, n in out]


@pytest.mark.parametrize("name", ["debounce_edits", "idle_sessions"])
def test_stored_spans_scan_their_source_twice_at_most(spark, name, monkeypatch):
    plans = []
    real = ordered.hand_over
    monkeypatch.setattr(ordered, "hand_over", lambda df, at: (plans.append(scans(df)), real(df, at))[1])
    cut = ordered.cut
    monkeypatch.setattr(ordered, "cut", lambda df, order, chunk: cut(df, order, 500))
    load_cases()[name].run(spark, "/root/testdata/sf0.01")
    assert plans == [1]  # the quantiles are the other scan


def test_a_source_takes_pending_edits_along(spark, tmp_path):
    """Edits and a source within the gap are one row; edits come out of order and over several triggers."""
    schema = "key string, ts timestamp, seq bigint, settings string, once boolean"
    rng = random.Random(8)
    events = [("a", at(1), 1, "edit", False), ("a", at(1.05), 2, "source", True), ("a", at(1.1), 3, "next", False)]
    events += [(rng.choice("ab"), at(round(5 + rng.random() * 60, 2)), 10 + i, f"s{i}", rng.random() < 0.2) for i in range(300)]
    last = [("end", at(10_000), 9999, "x", False)]
    order = sorted(events, key=lambda e: (e[1] + timedelta(seconds=rng.random() * 5)))  # at most 5 s late
    batches = [order[i:i + 40] for i in range(0, len(order), 40)] + [last]
    stream = stream_of(spark, tmp_path / "in", batches, schema)
    got = drain(jobs.debounce_edits(stream, gap="100 milliseconds", watermark="6 seconds", at_once=F.col("once"))).where("key <> 'end'")
    rows = [tuple(r) for r in utc(got).collect()]
    assert ("a", "00:00:01.000", "00:00:01.050", "source", 2) in rows
    assert sorted(rows) == sorted(plain_spans(events, 0.1))


def test_a_hung_call_is_reported_at_its_own_deadline(spark, tmp_path):
    """1 megapixel: 24 s. It is told of by the trigger after event time 24 s, long before the ceiling of 120 s."""
    calls = "call_id bigint, ts timestamp, pixels bigint, kind string"
    batches = [
        [(1, at(0), 1_000_000, "start"), (2, at(0), 1_000_000, "start"), (3, at(0), None, "start"), (9, at(1), None, "end")],
        [(2, at(24), None, "end"), (8, at(25), 0, "start")],
        [(8, at(30), None, "end"), (7, at(40), 0, "start")],
        [(1, at(50), None, "end"), (7, at(59.9999), None, "end")],
        [(6, at(5000), 0, "start")],
    ]
    events = stream_of(spark, tmp_path / "in", batches, calls)
    out = jobs.watch_calls(events.where("kind = 'start'").drop("kind"), events.where("kind = 'end'").select("call_id", "ts"),
                           watermark="0 seconds")
    seen = []
    with timers.timers_enabled(spark):
        query = out.writeStream.foreachBatch(lambda df, i: seen.extend((i, r.call_id, r.status, round(r.reported.timestamp() - T0.timestamp(), 3)) for r in df.collect())).option(
            "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    told = sorted((c, s, t) for _, c, s, t in seen)
    assert told == [(1, "hung", 24.0), (1, "late", 50.0), (3, "hung", 120.0)]
    when = {(c, s): i for i, c, s, _ in seen}
    assert when[(1, "hung")] < when[(1, "late")] < when[(3, "hung")]


def test_a_side_is_forgotten_and_nulls_pass(spark, tmp_path):
    schema = "session string, side int, seq bigint, kind string, start_seq bigint, ts timestamp"
    batches = [
        [("s", 0, 5, "start", 5, at(0)), ("s", 0, 6, "result", 4, at(1)), ("s", 0, 7, "result", 5, at(1)), ("t", 1, None, "result", None, at(0))],
        [("s", 0, 9, "result", 5, at(2)), ("s", 0, 8, "start", 8, at(2)), ("x", 0, 1, "other", 1, at(3))],
        [("u", 0, 1, "start", 1, at(9000))], [("u", 0, 2, "start", 2, at(9001))],
        [("s", 0, 10, "result", 1, at(9002))],
    ]
    got = drain(jobs.drop_superseded(stream_of(spark, tmp_path / "in", batches, schema), watermark="1 second")).collect()
    assert sorted((r.session, r.seq, r.start_seq) for r in got if r.seq) == [("s", 7, 5), ("s", 10, 1)]
    assert [(r.session, r.seq, r.start_seq) for r in got if r.seq is None] == [("t", None, None)]


def test_a_hot_side_of_a_million_rows_in_one_trigger(spark):
    """The processor itself, fed a generator: what it holds is 17 bytes a row."""
    import tracemalloc

    from pyspark.sql import Row

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, row):
            self.held = row

    class Handle:
        def getValueState(self, *_):
            return Value()

        def registerTimer(self, _):
            pass

    n = 1_000_000
    rows = (Row(seq=n - i, kind="start" if i % 2 else "result", start_seq=n - i, us=i) for i in range(n))
    side = timers.CurrentResults(10 ** 6)
    side.init(Handle())
    tracemalloc.start()
    try:
        kept = sum(1 for _ in side.handleInputRows(("s", 0), rows, None))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert kept == n // 2 and peak < 100 << 20
    assert side.newest.get()[0] == n - 1
