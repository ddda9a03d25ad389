"""Stored state of streams, kept batch by batch: newest status of items (T2), rolling progress with its late rows.

A micro-batch is reduced to one row per key and written to a folder of its own, named by the batch
id. A batch that Spark runs again writes that same folder anew, so replays change nothing. Readers
reduce the folders once more; a busy item or run is one row a batch there. Folders are not merged:
where there are many, write what the reader returns to a new folder and start from there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StructType

EVENT = ["ts", "seq", "status", "out_size", "error"]
COUNTS = ["total", "done", "errored", "bytes_in", "bytes_out"]


def _batches(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """What the batches wrote, with their number as ``batch``; the first call makes an empty batch -1."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/batch=-1")
    return spark.read.schema(StructType(list(schema.fields)).add("batch", LongType())).parquet(folder)


def _start(stream: DataFrame, folder: str, each: Callable[[DataFrame, int], None], trigger: dict | None) -> StreamingQuery:
    return (stream.writeStream.foreachBatch(each).trigger(**(trigger or {"availableNow": True}))
            .option("checkpointLocation", f"{folder}/state").start())


def _newest(events: DataFrame) -> DataFrame:
    return events.groupBy("item_id").agg(F.max(F.struct(*EVENT)).alias("e")).select("item_id", "e.*")


def store_status(events: DataFrame, folder: str, trigger: dict | None = None) -> StreamingQuery:
    """Keeps the newest event of each item of a stream (item_id, ts, seq, status, out_size, error) in ``folder``."""
    def each(batch: DataFrame, batch_id: int) -> None:
        put_status(batch, batch_id, folder)

    return _start(events.select("item_id", *EVENT), folder, each, trigger)


def put_status(batch: DataFrame, batch_id: int, folder: str) -> None:
    """One micro-batch of :func:`store_status`; the same batch may be put any number of times."""
    _newest(batch).write.mode("overwrite").parquet(f"{folder}/status/batch={batch_id}")


def stored_status(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """``(item_id, status, out_size, error, ts)``, the newest event of each item that ``folder`` holds.

    ``schema`` is that of the events. Ties go to the larger seq, status, size, error, as in ``latest_status``.
    """
    own = StructType([schema[c] for c in ("item_id", *EVENT)])
    rows = _batches(spark, f"{folder}/status", own)
    return _newest(rows.select("item_id", *EVENT)).select("item_id", "status", "out_size", "error", "ts")


def _part_schema(run: DataFrame | StructType) -> StructType:
    schema = run if isinstance(run, StructType) else run.schema
    out = StructType([schema["run_id"], schema["ts"]])
    for c in ("window_start", "window_end"):
        out = out.add(c, schema["ts"].dataType)
    out = out.add("late", BooleanType())
    for c in COUNTS:
        out = out.add(c, LongType())
    return out


def store_progress(
    events: DataFrame, folder: str, window: str = "1 hour", slide: str | None = None, delay: str = "1 hour",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Rolling progress of a stream (run_id, ts, status, src_size, out_size), late rows counted exactly.

    The watermark of a batch is the newest ``ts`` of all earlier batches less ``delay``. A row is late for
    a window that ended at or before it: it is left out of the window and counted by ``stored_late``.
    (A windowed stream counts what it drops only after rows were combined.) ``slide`` is at most ``window``.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        put_progress(batch, batch_id, folder, window, slide, delay)

    return _start(events.select("run_id", "ts", "status", "src_size", "out_size"), folder, each, trigger)


def put_progress(batch: DataFrame, batch_id: int, folder: str, window: str = "1 hour", slide: str | None = None,
                 delay: str = "1 hour") -> None:
    """One micro-batch of :func:`store_progress`; the same batch may be put any number of times."""
    spark, top = batch.sparkSession, StructType([batch.schema["ts"]])
    earlier = _batches(spark, f"{folder}/newest", top).where(F.col("batch") < batch_id)
    mark = earlier.agg((F.max("ts") - F.expr(f"interval {delay}")).alias("mark"))  # one row a batch
    done = F.col("status") == "done"
    rows = batch.groupBy("run_id", F.window("ts", window, slide or window)).agg(
        F.max("ts").alias("ts"), F.count(F.lit(1)).alias("total"), F.count_if(done).alias("done"),
        F.count_if(F.col("status") == "error").alias("errored"),
        F.coalesce(F.sum(F.when(done, F.col("src_size"))), F.lit(0)).cast("bigint").alias("bytes_in"),
        F.coalesce(F.sum(F.when(done, F.col("out_size"))), F.lit(0)).cast("bigint").alias("bytes_out"))
    newest = mark.first()["mark"]
    late = F.lit(False) if newest is None else F.col("window.end") <= F.lit(newest)
    parts = rows.select("run_id", "ts", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                        late.alias("late"), *COUNTS)
    path = f"{folder}/parts/batch={batch_id}"
    parts.write.mode("overwrite").parquet(path)
    (spark.read.schema(parts.schema).parquet(path).agg(F.max("ts").alias("ts")).where("ts IS NOT NULL")
     .write.mode("overwrite").parquet(f"{folder}/newest/batch={batch_id}"))


def _parts(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return _batches(spark, f"{folder}/parts", _part_schema(schema))


def stored_progress(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """``(run_id, window_start, window_end, total, done, errored, bytes_in, bytes_out)`` so far, late rows left out."""
    rows = _parts(spark, folder, schema).where("NOT late")
    return rows.groupBy("run_id", "window_start", "window_end").agg(*[F.sum(c).alias(c) for c in COUNTS])


def stored_late(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """``(run_id, late_rows)`` of each run that lost rows to the watermark."""
    return _parts(spark, folder, schema).where("late").groupBy("run_id").agg(F.sum("total").alias("late_rows"))
