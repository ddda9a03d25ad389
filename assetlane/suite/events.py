"""Queries on job events.

Sessions are users. A signup loads a source, a view starts work on a side, a click edits, a purchase
is an encoded side and an error a failed one. Events are minutes apart, so gaps are hours.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from assetlane.operators.reuse import recent_results
from assetlane.session import scratch_folder
from assetlane.sources.assets import scan_assets
from assetlane.streaming import jobs, stored
from assetlane.streaming.timers import timers_enabled
from assetlane.suite.files import PAGE_FILES, page_files, page_folders
from assetlane.suite.fixtures import read
from assetlane.suite.registry import case


def _events(spark, sf_dir):
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _stream(spark, sf_dir):
    schema = read(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream, mode: str = "append"):
    """Run a stream over what is there and read its output back."""
    spark = stream.sparkSession
    folder = scratch_folder(spark, "stream")
    with timers_enabled(spark):
        query = (
            stream.writeStream.outputMode(mode).format("parquet").trigger(availableNow=True)
            .option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").start()
        )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _islands(key, gap_hours, where, picks):
    return f"""WITH e AS (SELECT * FROM events WHERE {where}),
 f AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL {gap_hours} HOUR THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY {key} ORDER BY ts, event_id)),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY ts, event_id) AS s FROM f) SELECT {picks} FROM s GROUP BY {key}, s"""


_DEBOUNCED = _islands(
    "user_id", 6, "event_type = 'click'",
    'user_id AS key, min(ts) AS "start", max(ts) AS "end", arg_max(props, ts) AS last_settings, count(*) AS n',
)


def _edits(events):
    return events.where("event_type = 'click'").selectExpr(
        "user_id AS key", "ts", "event_id AS seq", "props AS settings"
    )


def _naive(df, *columns):
    """Timestamps without a zone, as the check engine has them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@case("debounce_edits", _DEBOUNCED)
def _(spark, sf_dir):
    out = jobs.debounce_edits_batch(_edits(_events(spark, sf_dir)), gap_seconds=6 * 3600)
    return _naive(out, "start", "end")


@case("debounce_edits_stream", _DEBOUNCED)
def _(spark, sf_dir):
    """The streaming form; a last far-off event lets the watermark close every session."""
    out = jobs.debounce_edits(_edits(_flushed(_stream(spark, sf_dir))), gap="6 hours", watermark="1 hour")
    return _naive(drain(out).where("key >= 0"), "start", "end")


def _flushed(stream):
    """Each event also as a far-future one of a user of negative id, so that real sessions close."""
    both = F.array(F.struct(F.col("user_id").alias("u"), F.col("ts").alias("t")),
                   F.struct((-1 - 10 * F.col("user_id")).alias("u"), (F.col("ts") + F.expr("interval 400 days")).alias("t")))
    return stream.withColumn("__b", F.explode(both)).withColumns({"user_id": F.col("__b.u"), "ts": F.col("__b.t")}).drop("__b")


@case(
    "immediate_edits",
    """SELECT user_id AS key, ts AS "start", ts AS "end", props AS last_settings, CAST(1 AS BIGINT) AS n FROM events WHERE event_type = 'signup'""",
)
def _(spark, sf_dir):
    rows = _events(spark, sf_dir).selectExpr("user_id AS key", "ts", "event_type", "props AS settings")
    return _naive(jobs.immediate(rows, F.col("event_type") == "signup"), "start", "end")


# a signup is a new source: it takes the pending clicks along and fires at once
_AT_ONCE = """WITH e AS (SELECT * FROM events WHERE event_type IN ('click', 'signup')),
 f AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR AND lag(event_type) OVER w = 'click' THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM f)
 SELECT user_id AS key, min(ts) AS "start", max(ts) AS "end", arg_max(props, (ts, event_id)) AS last_settings, count(*) AS n FROM s GROUP BY user_id, s"""


def _edits_and_sources(events):
    return events.where("event_type IN ('click', 'signup')").selectExpr(
        "user_id AS key", "ts", "event_id AS seq", "props AS settings", "event_type"
    )


@case("debounce_at_once", _AT_ONCE)
def _(spark, sf_dir):
    out = jobs.debounce_edits_batch(_edits_and_sources(_events(spark, sf_dir)), gap_seconds=6 * 3600, chunk_rows=1000,
                                    at_once=F.col("event_type") == "signup")
    return _naive(out, "start", "end")


@case("debounce_at_once_stream", _AT_ONCE)
def _(spark, sf_dir):
    """The state machine with its timer; a last far-off event lets the watermark close every span."""
    out = jobs.debounce_edits(_edits_and_sources(_flushed(_stream(spark, sf_dir))), gap="6 hours", watermark="1 hour",
                              at_once=F.col("event_type") == "signup")
    return _naive(drain(out).where("key >= 0"), "start", "end")


_LIVES = _islands(
    "user_id", 3, "true", 'user_id AS worker, min(ts) AS "start", max(ts) AS "end", count(*) AS calls, round(sum(value), 4) AS busy'
)


@case("idle_sessions", _LIVES)
def _(spark, sf_dir):
    calls = _events(spark, sf_dir).selectExpr("user_id AS worker", "ts", "value AS busy")
    out = jobs.idle_sessions_batch(calls, gap_seconds=3 * 3600)
    return _naive(out.withColumn("busy", F.round("busy", 4)), "start", "end")


@case("idle_sessions_stream", _LIVES)
def _(spark, sf_dir):
    calls = _flushed(_stream(spark, sf_dir)).selectExpr("user_id AS worker", "ts", "value AS busy")
    out = drain(jobs.idle_sessions(calls, gap="3 hours", watermark="1 hour")).where("worker >= 0")
    return _naive(out.withColumn("busy", F.round("busy", 4)), "start", "end")


_STATUS = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'done' ELSE 'error' END"
_SIZE = "CAST(floor(value * 1000) AS BIGINT)"


def _item_events(events):
    return events.selectExpr(
        "user_id * 10 + event_id % 7 AS item_id", "user_id % 20 AS session", "ts", "event_id AS seq", f"{_STATUS} AS status",
        f"CASE WHEN event_type = 'purchase' THEN {_SIZE} END AS out_size", "CASE WHEN event_type = 'error' THEN props END AS error",
    )


_LATEST = f"""SELECT user_id * 10 + event_id % 7 AS item_id, {_STATUS} AS status, CASE WHEN event_type = 'purchase' THEN {_SIZE} END AS out_size, CASE WHEN event_type = 'error' THEN props END AS error, ts
 FROM events QUALIFY row_number() OVER (PARTITION BY user_id * 10 + event_id % 7 ORDER BY ts DESC, event_id DESC) = 1"""


@case("latest_status", _LATEST)
def _(spark, sf_dir):
    return _naive(jobs.latest_status(_item_events(_events(spark, sf_dir))), "ts")


@case("latest_status_stored_stream", _LATEST)
def _(spark, sf_dir):
    """The stream's state as stored batch by batch, read back."""
    folder, events = scratch_folder(spark, "status"), _item_events(_stream(spark, sf_dir))
    stored.store_status(events, folder).awaitTermination()
    return _naive(stored.stored_status(spark, folder, events.schema), "ts")


@case(
    "busy_sessions",
    f"WITH l AS ({_LATEST}) SELECT item_id % 20 AS session, bool_or(status IN ('queued', 'processing')) AS busy FROM l GROUP BY 1",
)
def _(spark, sf_dir):
    status = jobs.latest_status(_item_events(_events(spark, sf_dir)))
    return jobs.busy_sessions(status.withColumn("session", F.col("item_id") % 20))


_ROLLING = f"""SELECT user_id % 10 AS run_id, time_bucket(INTERVAL 6 HOUR, ts) AS window_start, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS window_end, count(*) AS total,
 count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'error') AS errored, CAST(coalesce(sum({_SIZE}) FILTER (event_type = 'purchase'), 0) AS BIGINT) AS bytes_in,
 CAST(coalesce(sum({_SIZE} // 2) FILTER (event_type = 'purchase'), 0) AS BIGINT) AS bytes_out FROM events GROUP BY 1, 2"""


def _run_events(events):
    return events.selectExpr(
        "user_id % 10 AS run_id", "ts", f"{_STATUS} AS status", f"{_SIZE} AS src_size", f"{_SIZE} div 2 AS out_size"
    )


@case("progress", _ROLLING)
def _(spark, sf_dir):
    out = jobs.progress_stream(_run_events(_events(spark, sf_dir)), "6 hours", watermark=None)
    return _naive(out, "window_start", "window_end")


@case("progress_stream", _ROLLING)
def _(spark, sf_dir):
    out = drain(jobs.progress_stream(_run_events(_flushed(_stream(spark, sf_dir))), "6 hours", watermark="1 hour"))
    return _naive(out.where("run_id >= 0"), "window_start", "window_end")


@case("progress_stored_stream", _ROLLING)
def _(spark, sf_dir):
    """All events in one batch, so none is late."""
    folder, events = scratch_folder(spark, "progress"), _run_events(_stream(spark, sf_dir))
    stored.store_progress(events, folder, "6 hours").awaitTermination()
    return _naive(stored.stored_progress(spark, folder, events.schema), "window_start", "window_end")


# a side's results belong to the newest start, or to the one before it for every third event
def _side_events(events):
    return events.where("event_type IN ('view', 'purchase')").selectExpr(
        "user_id AS session", "CAST(event_id % 2 AS INT) AS side", "event_id AS seq", "ts",
        "CASE WHEN event_type = 'view' THEN 'start' ELSE 'result' END AS kind",
        "CASE WHEN event_type = 'view' THEN event_id ELSE event_id - (event_id % 3) * 400 END AS start_seq",
    )


_SUPERSEDED = """WITH e AS (SELECT user_id AS session, CAST(event_id % 2 AS INTEGER) AS side, event_id AS seq, CASE WHEN event_type = 'view' THEN 'start' ELSE 'result' END AS kind,
  CASE WHEN event_type = 'view' THEN event_id ELSE event_id - (event_id % 3) * 400 END AS start_seq FROM events WHERE event_type IN ('view', 'purchase')),
 m AS (SELECT *, max(start_seq) FILTER (kind = 'start') OVER (PARTITION BY session, side ORDER BY seq) AS newest FROM e)
 SELECT session, side, seq, kind, start_seq FROM m WHERE kind = 'result' AND (newest IS NULL OR start_seq >= newest)"""


@case("drop_superseded", _SUPERSEDED)
def _(spark, sf_dir):
    return jobs.drop_superseded_batch(_side_events(_events(spark, sf_dir))).drop("ts")


@case("drop_superseded_stream", _SUPERSEDED)
def _(spark, sf_dir):
    return drain(jobs.drop_superseded(_side_events(_stream(spark, sf_dir))))


def _calls(events):
    starts = events.where("event_type <> 'signup'").selectExpr(
        "event_id AS call_id", "ts", "CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 40 * 1000000 END AS pixels"
    )
    ends = events.where("event_type <> 'signup' AND event_id % 10 < 8").selectExpr(
        "event_id AS call_id", "ts + make_dt_interval(0, 0, 0, event_id * 37 % 200) AS ts"
    )
    return starts, ends


_OVERDUE = """WITH s AS (SELECT event_id AS call_id, ts, least(120, coalesce(20 + CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 40 END * 4, 120)) AS budget,
  CASE WHEN event_id % 10 < 8 AND event_id * 37 % 200 <= 120 THEN event_id * 37 % 200 END AS took FROM events WHERE event_type <> 'signup')
 SELECT call_id, ts + to_seconds(budget) AS deadline, CASE WHEN took IS NULL THEN 'hung' ELSE 'late' END AS status FROM s WHERE took IS NULL OR took > budget"""


# the stream's bound of 120 s is no part of the question on stored tables
@case("overdue_calls", _OVERDUE.replace(" AND event_id * 37 % 200 <= 120", ""))
def _(spark, sf_dir):
    return _naive(jobs.overdue_calls(*_calls(_events(spark, sf_dir)), watermark=None), "deadline")


@case("overdue_calls_stream", _OVERDUE)
def _(spark, sf_dir):
    """Stream-stream join; far-off calls of negative id let the watermark pass every real call."""
    stream = _stream(spark, sf_dir)
    flush = lambda df: _doubled(df)
    starts, ends = _calls(stream)
    out = drain(jobs.overdue_calls(flush(starts), flush(ends)))
    return _naive(out.where("call_id >= 0"), "deadline")


_WATCHED = """WITH s AS (SELECT event_id AS call_id, ts, least(120, coalesce(20 + CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 40 END * 4, 120)) AS budget,
  CASE WHEN event_id % 10 < 8 THEN event_id * 37 % 200 END AS took FROM events WHERE event_type <> 'signup'),
 d AS (SELECT *, ts + to_seconds(budget) AS deadline, ts + to_seconds(took) AS ended FROM s WHERE took IS NULL OR took > budget),
 r AS (SELECT call_id, deadline, deadline AS due, 'hung' AS status FROM d UNION ALL SELECT call_id, deadline, ended, 'late' FROM d WHERE ended IS NOT NULL)
 SELECT call_id, deadline, date_trunc('millisecond', due + INTERVAL 999 MICROSECOND) AS reported, status FROM r"""


@case("watch_calls_stream", _WATCHED)
def _(spark, sf_dir):
    """Each call is reported at its own deadline."""
    starts, ends = _calls(_stream(spark, sf_dir))
    out = drain(jobs.watch_calls(_doubled(starts), _doubled(ends)))
    return _naive(out.where("call_id >= 0"), "deadline", "reported")


def _doubled(df):
    both = F.array(F.struct(F.col("call_id").alias("c"), F.col("ts").alias("t")),
                   F.struct((-1 - F.col("call_id")).alias("c"), (F.col("ts") + F.expr("interval 400 days")).alias("t")))
    return df.withColumn("__b", F.explode(both)).withColumns({"call_id": F.col("__b.c"), "ts": F.col("__b.t")}).drop("__b")


@case(
    "attempt_outcomes",
    """WITH a AS (SELECT user_id AS bridge, event_id AS call_id, 1 AS attempt, event_type = 'error' AS failed FROM events
  UNION ALL SELECT user_id, event_id, 2, event_id % 3 = 0 FROM events WHERE event_type = 'error' AND event_id % 4 <> 0)
 SELECT bridge, call_id, CASE WHEN arg_max(failed, attempt) THEN 'load-error' WHEN count(*) > 1 THEN 'retried-ok' ELSE 'ok' END AS outcome,
  CAST(count(*) AS INTEGER) AS attempts FROM a GROUP BY ALL""",
)
def _(spark, sf_dir):
    """A log of first attempts, and of second ones where the first was lost."""
    rows = _events(spark, sf_dir)
    first = rows.selectExpr("user_id AS bridge", "event_id AS call_id", "1 AS attempt", "event_type = 'error' AS failed")
    second = rows.where("event_type = 'error' AND event_id % 4 <> 0").selectExpr(
        "user_id AS bridge", "event_id AS call_id", "2 AS attempt", "event_id % 3 = 0 AS failed")
    return jobs.attempt_outcomes(first.unionByName(second))


@case(
    "latched_outcomes",
    """WITH a AS (SELECT user_id AS bridge, event_id AS call_id, 2 * event_id AS seq, event_type = 'error' AS failed, event_id % 5 <> 0 AS retryable FROM events
  UNION ALL SELECT user_id, event_id, 2 * event_id + 1, event_id % 3 = 0, event_id % 5 <> 0 FROM events WHERE event_type = 'error' AND event_id % 7 <> 0),
 l AS (SELECT *, min(seq) FILTER (failed) OVER (PARTITION BY bridge) AS latched, row_number() OVER (PARTITION BY bridge, call_id ORDER BY seq) AS k FROM a),
 c AS (SELECT x.*, y.failed AS lost, x.failed AND x.seq = x.latched AS switched FROM l AS x LEFT JOIN l AS y ON y.bridge = x.bridge AND y.call_id = x.call_id AND y.k = 2 WHERE x.k = 1)
 SELECT bridge, call_id, CASE WHEN NOT failed THEN 'ok' WHEN NOT (switched AND retryable) THEN 'load-error' WHEN lost IS NULL THEN 'unfinished' WHEN lost THEN 'load-error' ELSE 'retried-ok' END AS outcome,
  CAST(CASE WHEN switched AND retryable AND lost IS NOT NULL THEN 2 ELSE 1 END AS INTEGER) AS attempts,
  CASE WHEN coalesce(switched, false) THEN 'switched' WHEN seq > latched THEN 'single' ELSE 'threads' END AS mode FROM c""",
)
def _(spark, sf_dir):
    """Every event as a first attempt, and second ones where a first was lost, whether or not the rules allow them."""
    rows = _events(spark, sf_dir)
    first = rows.selectExpr("user_id AS bridge", "event_id AS call_id", "2 * event_id AS seq", "event_type = 'error' AS failed", "event_id % 5 <> 0 AS retryable")
    second = rows.where("event_type = 'error' AND event_id % 7 <> 0").selectExpr(
        "user_id AS bridge", "event_id AS call_id", "2 * event_id + 1 AS seq", "event_id % 3 = 0 AS failed", "event_id % 5 <> 0 AS retryable")
    return jobs.latched_outcomes(first.unionByName(second))


@case(
    "intake_stream",
    f"SELECT folder, CAST(1 AS INTEGER) AS depth, CAST(length(text) AS BIGINT) AS bytes, sha256(text) AS digest, '' AS mime, 'unknown' AS mime_source FROM ({PAGE_FILES})",
)
def _(spark, sf_dir):
    """The pages laid out as files of a landing folder, watched once; the files of a folder put together.

    Contents are read again where path and digest are those that the stream found.
    """
    folder = page_files(spark, sf_dir, "landing")
    found = drain(jobs.intake_stream(spark, folder, images_only=False).where("name LIKE '%.txt'").select(
        "rel_path", "depth", "bytes", "digest", "mime", "mime_source"))
    files = scan_assets(spark, folder, glob="*.txt").withColumn("digest", F.sha2("content", 256)).select("rel_path", "digest", "content")
    texts = page_folders(files.join(found.select("rel_path", "digest"), ["rel_path", "digest"]))
    at = F.regexp_extract("rel_path", "^([^/]*)/[^/]*$", 1).alias("folder")
    sizes = found.groupBy(at, "depth", "mime", "mime_source").agg(F.sum("bytes").alias("bytes"))
    return sizes.join(texts, "folder").select("folder", "depth", "bytes", "digest", "mime", "mime_source")


@case(
    "recent_results",
    """WITH u AS (SELECT user_id AS source, concat(event_type, '-', CAST(event_id % 6 AS VARCHAR)) AS key, max(ts) AS ts FROM events GROUP BY 1, 2)
 SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY ts DESC, key) AS INTEGER) AS place FROM u QUALIFY place <= 5""",
)
def _(spark, sf_dir):
    log = _events(spark, sf_dir).selectExpr(
        "user_id AS source", "concat(event_type, '-', CAST(event_id % 6 AS STRING)) AS key", "ts"
    )
    return _naive(recent_results(log), "ts")
