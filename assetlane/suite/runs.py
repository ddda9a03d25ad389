"""Queries on batch runs and encodes."""

from __future__ import annotations

import json
import zlib

from pyspark.sql import functions as F

from assetlane.operators import batch
from assetlane.operators.encode import run_encodes
from assetlane.session import scratch_folder
from assetlane.sources import assets
from assetlane.suite.fixtures import read, view, with_views
from assetlane.suite.registry import case

_ITEMS = with_views("v_items")


@case(
    "batch_progress",
    f"""{_ITEMS}, g AS (SELECT run_id, count(*) AS total, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'error') AS errored, count(*) FILTER (status = 'processing') AS processing,
  count(*) FILTER (status = 'pending') AS pending, CAST(coalesce(sum(src_size) FILTER (status = 'done'), 0) AS BIGINT) AS bytes_in, CAST(coalesce(sum(out_size) FILTER (status = 'done'), 0) AS BIGINT) AS bytes_out FROM v_items GROUP BY run_id)
 SELECT *, CAST(done + errored AS DOUBLE) / total AS fraction, CASE WHEN bytes_in > 0 THEN CAST(floor((1 - CAST(bytes_out AS DOUBLE) / bytes_in) * 100 + 0.5) AS BIGINT) END AS saved_pct FROM g""",
)
def _(spark, sf_dir):
    return batch.batch_progress(view(spark, sf_dir, "v_items"))


_NAMED = "concat('pics/', CASE item_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END, '/img', CAST(item_id % 3 AS STRING), '.png')"


@case(
    "archive_paths",
    f"""{_ITEMS}, n AS (SELECT run_id, item_id, seq, {_NAMED} AS path FROM v_items),
 p AS (SELECT *, row_number() OVER (PARTITION BY run_id, path ORDER BY seq) AS k FROM n)
 SELECT run_id, item_id, CASE WHEN k = 1 THEN path ELSE concat(left(path, length(path) - 4), ' (', CAST(k AS VARCHAR), ').png') END AS entry_path FROM p""",
)
def _(spark, sf_dir):
    items = view(spark, sf_dir, "v_items").selectExpr("run_id", "item_id", "seq", f"{_NAMED} AS path")
    return batch.archive_paths(items, chunk_rows=1000).select("run_id", "item_id", "entry_path")


@case("archive_paths_clashing")
def _(spark, sf_dir):
    """Names that look like copies of each other; checked against a plain loop in the tests."""
    items = view(spark, sf_dir, "v_items").selectExpr("item_id % 40 AS run_id", "item_id", "seq", f"{CLASHING} AS path")
    return batch.archive_paths(items, chunk_rows=1000).select("run_id", "seq", "path", "entry_path")


CLASHING = """CASE item_id % 11 WHEN 0 THEN 'a (2).png' WHEN 1 THEN 'a (3).png' WHEN 2 THEN 'a (2) (2).png' WHEN 3 THEN concat('a (', CAST(2 + item_id % 97 AS STRING), ').png')
 WHEN 4 THEN 'b.tar (2).gz' WHEN 5 THEN 'b.tar.gz' WHEN 6 THEN 'b (2).tar.gz' WHEN 7 THEN concat('a (', CAST(2 + item_id % 5 AS STRING), ') (2).png') ELSE 'a.png' END"""


@case(
    "archive_manifest",
    f"""{_ITEMS}, d AS (SELECT *, concat('img', CAST(item_id AS VARCHAR), '.png') AS entry_path FROM v_items WHERE status = 'done' AND out_size IS NOT NULL)
 SELECT run_id, item_id, seq, entry_path, out_size AS bytes, CAST(sum(out_size) OVER w - out_size AS BIGINT) AS offset,
  least(1, CAST(sum(out_size) OVER w AS DOUBLE) / sum(out_size) OVER (PARTITION BY run_id)) AS progress FROM d WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def _(spark, sf_dir):
    items = view(spark, sf_dir, "v_items").withColumn(
        "entry_path", F.concat(F.lit("img"), F.col("item_id").cast("string"), F.lit(".png"))
    )
    return batch.archive_manifest(items, chunk_rows=1000)


def _changed(status, out_size, error):
    return (f"{_ITEMS} SELECT item_id, {status} AS status, {out_size} AS out_size, {error} AS error FROM v_items")


_ERROR = "CASE WHEN status = 'error' THEN 'codec failed' END"


def _failed_items(spark, sf_dir):
    return view(spark, sf_dir, "v_items").withColumn("error", F.expr(_ERROR))


@case("retry_failed", _changed("CASE WHEN status = 'error' THEN 'pending' ELSE status END", "out_size", "CAST(NULL AS VARCHAR)"))
def _(spark, sf_dir):
    return batch.retry_failed(_failed_items(spark, sf_dir)).select("item_id", "status", "out_size", "error")


@case("cancel_run", _changed("CASE WHEN status = 'processing' THEN 'pending' ELSE status END", "out_size", _ERROR))
def _(spark, sf_dir):
    return batch.cancel_run(_failed_items(spark, sf_dir)).select("item_id", "status", "out_size", "error")


@case("reset_items", _changed("'pending'", "CAST(NULL AS BIGINT)", "CAST(NULL AS VARCHAR)"))
def _(spark, sf_dir):
    return batch.reset_items(_failed_items(spark, sf_dir)).select("item_id", "status", "out_size", "error")


def deflate(content: bytes, settings_json: str) -> bytes:
    """Demonstration encoder: zlib with the level of the settings."""
    level = json.loads(settings_json)["encoderOptions"]["level"]
    if level > 9:
        raise ValueError(f"level {level} is out of range")
    return zlib.compress(content, level)


def _encoded(spark, sf_dir):
    """Every document at three levels, one of them not allowed, and passed through."""
    docs = read(spark, sf_dir, "documents")
    levels = F.explode(F.array(*[F.lit(n) for n in (0, 1, 9, 12)])).alias("level")
    plan = docs.select("doc_id", levels).select(
        (F.col("doc_id") * 100 + F.col("level")).alias("item_id"), F.col("doc_id").alias("image_id"),
        F.when(F.col("level") == 0, "identity").otherwise("zlib").alias("encoder"),
        F.concat(F.lit('{"encoderOptions":{"level":'), F.col("level").cast("string"), F.lit("}}")).alias("settings_json"),
        F.lit(None).cast("string").alias("out_mime"),
    )
    images = docs.select(F.col("doc_id").alias("image_id"), F.encode("text", "UTF-8").alias("content"))
    return run_encodes(plan, images, deflate)


@case(
    "run_encodes",
    """WITH l AS (SELECT doc_id, unnest([0, 1, 9, 12]) AS level, text FROM documents)
 SELECT doc_id * 100 + level AS item_id, doc_id AS image_id, CASE WHEN level = 0 THEN 'identity' ELSE 'zlib' END AS encoder, CASE WHEN level = 12 THEN 'error' ELSE 'done' END AS status,
 CASE WHEN level = 0 THEN octet_length(encode(text)) END AS passed_size, level IN (1, 9) AS packed, CASE WHEN level = 12 THEN 'level 12 is out of range' END AS error FROM l""",
)
def _(spark, sf_dir):
    done = _encoded(spark, sf_dir)
    return done.select(
        "item_id", "image_id", "encoder", "status",
        F.when(F.col("encoder") == "identity", F.col("out_size")).alias("passed_size"),
        ((F.col("encoder") == "zlib") & (F.coalesce("out_size", F.lit(0)) > 0)).alias("packed"), "error",
    )


@case(
    "write_results",
    f"""{_ITEMS} SELECT CASE item_id % 3 WHEN 0 THEN 'avif' WHEN 1 THEN 'webp' ELSE 'jxl' END AS encoder, status, count(*) AS n, CAST(sum(out_size) AS BIGINT) AS out_size FROM v_items GROUP BY ALL""",
)
def _(spark, sf_dir):
    """Store results by encoder, read them back, count."""
    folder = scratch_folder(spark, "results")
    rows = view(spark, sf_dir, "v_items").withColumn(
        "encoder", F.expr("CASE item_id % 3 WHEN 0 THEN 'avif' WHEN 1 THEN 'webp' ELSE 'jxl' END")
    )
    assets.write_results(rows, folder)
    return assets.read_results(spark, folder).groupBy("encoder", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("out_size").alias("out_size")
    )
