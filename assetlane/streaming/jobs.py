"""Job events as streams, with batch twins.

Functions without a suffix take a streaming DataFrame (most run on a batch too); the ``_batch``
forms give the same rows from stored events and spread hot keys over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlane.functions.filetypes import looks_like_image, resolve_mime
from assetlane.functions.numbers import dbl
from assetlane.functions.paths import basename, is_ignored
from assetlane.plans.ordered import CHUNK_ROWS, by_time, running_max, spans
from assetlane.sources.assets import BINARY_SCHEMA, relative_paths
from assetlane.streaming.timers import current_results, debounce_with_timer, watchdog

# Worker budget in seconds and its ceiling.
BUDGET_BASE, BUDGET_PER_MP, BUDGET_CEILING = 20.0, 4.0, 120.0


# ----------------------------------------------------------------------- T1 debounce, T5 spans


def debounce_edits(
    stream: DataFrame, key: str = "key", gap: str = "100 milliseconds", watermark: str = "1 minute",
    at_once: Column | None = None,
) -> DataFrame:
    """Edits closer than the gap coalesce to the last; ``(key, start, end, last_settings, n)``.

    Input (key, ts, seq, settings). An event for which ``at_once`` holds (a new source) fires at once: it ends the
    span it comes in, pending edits included, and what follows it begins anew. Without such events
    the spans are session windows; with them a state machine with a timer keeps the pending events.
    """
    if at_once is not None:
        return debounce_with_timer(stream, key, gap, watermark, at_once)
    return stream.withWatermark("ts", watermark).groupBy(key, F.session_window("ts", gap)).agg(
        *[e.alias(n) for n, e in _edits().items()]).select(
        key, "start", "end", F.col("last.settings").alias("last_settings"), "n")


def _edits() -> dict[str, Column]:
    return {
        "start": F.min("ts"), "end": F.max("ts"),
        "last": F.max_by(F.struct("ts", "seq", "settings"), F.struct("ts", "seq")), "n": F.count(F.lit(1)),
    }


def _edit_parts() -> dict[str, Column]:
    return {
        "start": F.min("start"), "end": F.max("end"),
        "last": F.max_by("last", F.struct("last.ts", "last.seq")), "n": F.sum("n"),
    }


def debounce_edits_batch(
    edits: DataFrame, key: str = "key", gap_seconds: float = 0.1, chunk_rows: int = CHUNK_ROWS,
    at_once: Column | None = None,
) -> DataFrame:
    """T1 over stored events; a key's events are cut by rows, so no key is one task."""
    found = spans(edits, [key], "ts", gap_seconds, _edits(), _edit_parts(), ["seq"], at_once, chunk_rows)
    return found.select(key, "start", "end", F.col("last.settings").alias("last_settings"), "n")


def immediate(events: DataFrame, at_once: Column, key: str = "key") -> DataFrame:
    """Events that are never coalesced (a new source), in the shape of debounced rows."""
    return events.where(at_once).select(
        key, F.col("ts").alias("start"), F.col("ts").alias("end"),
        F.col("settings").alias("last_settings"), F.lit(1).cast("bigint").alias("n"),
    )


def _life() -> dict[str, Column]:
    return {"start": F.min("ts"), "end": F.max("ts"), "calls": F.count(F.lit(1)), "busy": F.sum("busy")}


def _life_parts() -> dict[str, Column]:
    return {"start": F.min("start"), "end": F.max("end"), "calls": F.sum("calls"), "busy": F.sum("busy")}


def idle_sessions(stream: DataFrame, gap: str = "10 seconds", watermark: str = "1 minute") -> DataFrame:
    """T5: worker life spans ``(worker, start, end, calls, busy)``; each is one cold start.

    Input (worker, ts, busy). A worker lives on while calls come within the gap.
    """
    return stream.withWatermark("ts", watermark).groupBy("worker", F.session_window("ts", gap)).agg(
        *[e.alias(n) for n, e in _life().items()]).select("worker", *_life())


def idle_sessions_batch(calls: DataFrame, gap_seconds: float = 10, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    return spans(calls, ["worker"], "ts", gap_seconds, _life(), _life_parts(), chunk=chunk_rows)


# --------------------------------------------------------------- T2 status, T3 rolling progress


def latest_status(events: DataFrame) -> DataFrame:
    """``(item_id, status, out_size, error, ts)`` from the newest event of an item.

    Input (item_id, ts, seq, status, out_size, error). A plain aggregate in update mode; partial
    results combine per task, so a busy item costs one row per task.
    """
    newest = F.max(F.struct("ts", "seq", "status", "out_size", "error")).alias("e")
    return events.groupBy("item_id").agg(newest).select(
        "item_id", "e.status", "e.out_size", "e.error", "e.ts"
    )


def busy_sessions(status: DataFrame, session: str = "session") -> DataFrame:
    """Sessions with something in flight; a session without is idle."""
    active = F.col("status").isin("queued", "processing")
    return status.groupBy(session).agg(F.max(active).alias("busy"))


def progress_stream(
    events: DataFrame, window: str = "1 hour", slide: str | None = None,
    watermark: str | None = "1 hour",
) -> DataFrame:
    """``(run_id, window_start, window_end, total, done, errored, bytes_in, bytes_out)``.

    With a watermark (streams) late rows are dropped and counted by the query's progress.
    """
    rows = events.withWatermark("ts", watermark) if watermark else events
    done = F.col("status") == "done"
    return rows.groupBy("run_id", F.window("ts", window, slide or window)).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(done).alias("done"),
        F.count_if(F.col("status") == "error").alias("errored"),
        F.coalesce(F.sum(F.when(done, F.col("src_size"))), F.lit(0)).cast("bigint").alias("bytes_in"),
        F.coalesce(F.sum(F.when(done, F.col("out_size"))), F.lit(0)).cast("bigint").alias("bytes_out"),
    ).select(
        "run_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "total", "done", "errored", "bytes_in", "bytes_out",
    )


# --------------------------------------------------------------------------- T4 superseded work


def drop_superseded_batch(events: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """T4 over stored events: results whose start is the newest of its side when they land.

    Input (session, side, seq, kind, start_seq): a 'start' opens work number ``start_seq``, a
    'result' ends it. Output: the result rows that still count.
    """
    opened = F.when(F.col("kind") == "start", F.col("start_seq"))
    marked = running_max(events, ["session", "side"], [F.col("seq")], opened, "__newest", chunk_rows)
    return marked.where(
        (F.col("kind") == "result")
        & (F.col("__newest").isNull() | (F.col("start_seq") >= F.col("__newest")))
    ).drop("__newest")


def drop_superseded(
    stream: DataFrame, ttl: str = "1 hour", watermark: str = "1 minute"
) -> DataFrame:
    """T4 on a stream: the newest start per (session, side) is kept in state.

    Input also has ``ts``; a side is forgotten ``ttl`` of event time after its last event. A side's events
    of one trigger are taken in ``seq`` order (see :class:`CurrentResults`).
    """
    return current_results(stream, ttl, watermark)


# ---------------------------------------------------------------- T6 overdue calls, T7 attempts


def call_budget(pixels: Column) -> Column:
    """Seconds a call may take: 20 plus 4 per megapixel, 120 at most or when pixels are unknown."""
    seconds = F.least(
        dbl(BUDGET_CEILING), dbl(BUDGET_BASE) + pixels.cast("double") / dbl(1e6) * dbl(BUDGET_PER_MP)
    )
    return F.coalesce(seconds, dbl(BUDGET_CEILING))


def overdue_calls(
    starts: DataFrame, ends: DataFrame, ceiling: str | None = "120 seconds", watermark: str | None = "1 minute"
) -> DataFrame:
    """``(call_id, deadline, status)`` of calls that ended late or never.

    ``starts(call_id, ts, pixels)``, ``ends(call_id, ts)``. On streams the state needs the constant
    bound ``ceiling``; the per-call deadline is compared afterwards. Stored tables know no such bound:
    an end however late is found, and only calls without one are hung.
    """
    a = starts.select("call_id", F.col("ts").alias("started"), "pixels")
    b = ends.select(F.col("call_id").alias("__id"), F.col("ts").alias("ended"))
    if watermark:
        a, b = a.withWatermark("started", watermark), b.withWatermark("ended", watermark)
    within = (F.col("call_id") == F.col("__id")) & (F.col("ended") >= F.col("started"))
    if starts.isStreaming and ceiling:
        within = within & (F.col("ended") <= F.col("started") + F.expr(f"interval {ceiling}"))
    deadline = F.timestamp_micros(
        F.unix_micros("started") + F.round(call_budget(F.col("pixels")) * dbl(1e6)).cast("bigint")
    )
    joined = a.join(b, within, "leftOuter").withColumn("deadline", deadline)
    status = F.when(F.col("ended").isNull(), "hung").when(F.col("ended") > F.col("deadline"), "late")
    return joined.withColumn("status", status).where(F.col("status").isNotNull()).select(
        "call_id", "deadline", "status"
    )


def watch_calls(
    starts: DataFrame, ends: DataFrame, watermark: str = "1 minute", forget: str = "1 day"
) -> DataFrame:
    """T6 with a timer for each call: ``(call_id, deadline, reported, status)``.

    Streams ``starts(call_id, ts, pixels)`` and ``ends(call_id, ts)``. A call that has not ended by its own
    deadline is ``hung`` and reported when event time passes it (``reported``), not when a common ceiling does. An end
    that comes within ``forget`` after that adds a row ``late``, reported at its own time. Times of reports
    are whole milliseconds, rounded up.
    """
    budget = F.round(call_budget(F.col("pixels")) * dbl(1e6)).cast("bigint")
    a = starts.select("call_id", "ts", budget.alias("budget"))
    b = ends.select("call_id", "ts", F.lit(None).cast("bigint").alias("budget"))
    return watchdog(a.unionByName(b), watermark, forget)


def attempt_outcomes(attempts: DataFrame) -> DataFrame:
    """``(bridge, call_id, outcome, attempts)`` from logged attempts.

    Input (bridge, call_id, attempt, failed), one row per attempt that was made. The last attempt
    decides: ``ok``, ``retried-ok`` after earlier failures, or ``load-error``. One aggregate,
    combined before the shuffle.
    """
    calls = attempts.groupBy("bridge", "call_id").agg(
        F.count(F.lit(1)).cast("int").alias("attempts"), F.max_by("failed", "attempt").alias("lost")
    )
    outcome = F.when(F.col("lost"), "load-error").when(F.col("attempts") > 1, "retried-ok").otherwise("ok")
    return calls.select("bridge", "call_id", outcome.alias("outcome"), "attempts")


def latched_outcomes(attempts: DataFrame) -> DataFrame:
    """T7 with the latch: ``(bridge, call_id, outcome, attempts, mode)`` of each call.

    Input (bridge, call_id, seq, failed, retryable), one row per attempt; ``seq`` orders the attempts of a
    bridge. The first failure of a bridge latches it for good: later calls run ``single`` threaded,
    earlier ones ``threads``, and the call that failed is ``switched``. Only that call may run again, once,
    and only if it is retryable: ``retried-ok``, or ``load-error`` if it fails again, or ``unfinished`` if
    the log holds no second attempt. Any other failure is a ``load-error`` at its first attempt. ``attempts``
    counts those that these rules allow; others in the log are ignored.

    A null ``failed`` is no failure, a null ``retryable`` is retryable, rows without bridge or seq are left out.
    Attempts are combined per call and first failures per bridge before each shuffle; one row a bridge is
    joined back, so a busy bridge can be split by the skew join.
    """
    made = attempts.where("bridge IS NOT NULL AND seq IS NOT NULL").select(
        "bridge", "call_id", "seq", F.coalesce("failed", F.lit(False)).alias("failed"),
        F.coalesce("retryable", F.lit(True)).alias("retryable"),
    )
    step = F.struct("seq", "failed", "retryable")
    calls = made.groupBy("bridge", "call_id").agg(F.min_by(step, "seq").alias("one"))
    # of a call that latches, the attempt after the first; its first attempt is the one that failed
    latch = made.where("failed").groupBy("bridge").agg(F.min("seq").alias("latched"))
    tried = made.join(latch, "bridge", "left").where("seq > latched").groupBy("bridge", "call_id").agg(
        F.min_by("failed", "seq").alias("lost"))
    rows = calls.join(latch, "bridge", "left").join(
        tried, calls["call_id"].eqNullSafe(tried["call_id"]) & (calls["bridge"] == tried["bridge"]), "left"
    ).select(calls["bridge"], calls["call_id"], "one", "latched", "lost")
    failed, switched = F.col("one.failed"), F.col("one.failed") & (F.col("one.seq") == F.col("latched"))
    again = switched & F.col("one.retryable")
    outcome = (
        F.when(~failed, "ok").when(again & F.col("lost").isNull(), "unfinished")
        .when(again & ~F.col("lost"), "retried-ok").otherwise("load-error")
    )
    mode = F.when(switched, "switched").when(F.col("one.seq") > F.col("latched"), "single").otherwise("threads")
    return rows.select(
        "bridge", "call_id", outcome.alias("outcome"),
        F.when(again & F.col("lost").isNotNull(), 2).otherwise(1).alias("attempts"), mode.alias("mode"),
    )


# ------------------------------------------------------------------------------------ T8 intake


def intake_stream(
    spark: SparkSession, folder: str, watermark: str = "1 day", files_per_trigger: int = 1000,
    max_depth: int | None = None, max_bytes: int | None = None, images_only: bool = True,
) -> DataFrame:
    """Files as they land in a folder, each once: (path, rel_path, depth, bytes, mtime, name,
    head, digest, declared, mime, mime_source).

    Files are typed by ``resolve_mime``, head bytes first, and kept if an image by type or by name
    (all of them without ``images_only``). Size and depth limits are off unless given.
    """
    landed = (
        spark.readStream.format("binaryFile").schema(BINARY_SCHEMA)
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger)
        .load(folder)
    )
    rows = relative_paths(landed, folder, max_depth).withColumns({
        "name": basename(F.col("rel_path")), "head": F.substring("content", 1, 32),
        "digest": F.sha2("content", 256), "declared": F.lit(""),
    }).drop("content")
    wanted = resolve_mime(rows.where(~is_ignored(F.col("name"))))
    if max_bytes is not None:
        wanted = wanted.where(F.col("bytes") <= max_bytes)
    if images_only:
        wanted = wanted.where(F.coalesce(F.col("mime"), F.lit("")).startswith("image/") | looks_like_image(F.lit(""), F.col("name")))
    return wanted.withWatermark("mtime", watermark).dropDuplicatesWithinWatermark(
        ["name", "bytes", "mtime"]
    )


__all__ = [
    "attempt_outcomes", "busy_sessions", "by_time", "call_budget", "debounce_edits",
    "debounce_edits_batch", "drop_superseded", "drop_superseded_batch", "idle_sessions",
    "idle_sessions_batch", "immediate", "intake_stream", "latched_outcomes", "latest_status", "overdue_calls",
    "progress_stream", "watch_calls",
]
