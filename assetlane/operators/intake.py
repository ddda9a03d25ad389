"""Intake of dropped files: filters, size gates, routing, repeats, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlane.functions.filetypes import looks_like_image, looks_like_pdf
from assetlane.functions.paths import basename, is_ignored, safe_path
from assetlane.plans.ordered import running_position

# Size ceilings, folder limits, retention.
MAX_FILE_BYTES = 50 * 1024 * 1024
MAX_PDF_BYTES = 150 * 1024 * 1024
MAX_FILES = 5000
MAX_DEPTH = 16
STALE_MS = 12 * 60 * 60 * 1000
# Fixed value: what joins two notes on one drop. The sentences of ``route_drops`` are fixed too.
NOTE_JOIN = " · "


def taken_path(path: Column) -> Column:
    return F.coalesce(F.nullif(safe_path(path), F.lit("")), path)


def intake_filter(
    manifest: DataFrame, max_files: int | None = None, max_depth: int | None = None,
    max_bytes: int | None = None, include_non_images: bool = False, folder_walk: bool = False,
    chunk_rows: int = 1_000_000,
) -> DataFrame:
    """The files a drop takes in, ``+taken_path, +oversize`` (over the image ceiling).

    With ``folder_walk`` no folder on the way may be hidden or ignored. Limits are off unless given:
    ``max_bytes`` and, in a walk, ``max_depth`` leave files out, ``max_files`` keeps the first of
    each drop by ``seq``, counted in chunks (a drop of any size is spread over tasks). The
    application's own limits are ``MAX_FILE_BYTES``, ``MAX_DEPTH`` and ``MAX_FILES``.
    """
    path = taken_path(F.col("path"))
    rows = manifest.withColumn("taken_path", path).where(~is_ignored(basename(F.col("taken_path"))))
    rows = rows.withColumn("oversize", F.col("bytes") > F.lit(MAX_FILE_BYTES))
    if max_bytes is not None:
        rows = rows.where(F.col("bytes") <= F.lit(max_bytes))
    if not include_non_images:
        rows = rows.where(looks_like_image(F.col("declared"), F.col("taken_path")))
    if folder_walk:
        walked = F.filter(F.split(F.translate("path", "\\", "/"), "/"), lambda s: s != "")
        rows = rows.where(~F.exists(walked, is_ignored))
        if max_depth is not None:
            rows = rows.where(F.size(walked) - F.lit(1) <= F.lit(max_depth))
    if max_files is None:
        return rows
    placed = running_position(
        rows, ["drop_id"], [F.col("seq")], "__at", chunk_rows
    )
    return placed.where(F.col("__at") <= max_files).drop("__at")


def size_limit(declared: Column, path: Column) -> Column:
    pdf = looks_like_pdf(declared, basename(path))
    return F.when(pdf, F.lit(MAX_PDF_BYTES)).otherwise(F.lit(MAX_FILE_BYTES)).cast("bigint")


def partition_by_size(manifest: DataFrame, limit: int | None = None) -> DataFrame:
    """S3: ``+accepted``; 50 MB for images and 150 MB for PDFs unless ``limit`` is given."""
    cap = F.lit(limit) if limit is not None else size_limit(F.col("declared"), F.col("path"))
    return manifest.withColumn("accepted", F.col("bytes") <= cap)


def oversize_names(manifest: DataFrame, chunk_rows: int = 1_000_000) -> DataFrame:
    """S3: the files skipped for size, ``(drop_id, position, name)`` in arrival order.

    One row a name, however long the list: the note of a drop is its names joined by comma.
    """
    images = manifest.where(
        looks_like_image(F.col("declared"), basename(F.col("path")))
        & (F.col("bytes") > F.lit(MAX_FILE_BYTES))
    ).select("drop_id", "seq", basename(F.col("path")).alias("name"))
    placed = running_position(
        images, ["drop_id"], [F.col("seq")], "position", chunk_rows
    )
    return placed.select("drop_id", F.col("position").cast("bigint").alias("position"), "name")


def route_drops(manifest: DataFrame) -> DataFrame:
    """``(drop_id, route, n_images, pdf, note)``.

    One hash aggregate per drop, combined before the shuffle. A note joins what there is to say; its
    over-size part says how many images were skipped, and their names are ``oversize_names``.
    """
    name = basename(F.col("path"))
    rows = manifest.select(
        "drop_id", "seq", "bytes", name.alias("name"),
        looks_like_pdf(F.col("declared"), name).alias("pdf"),
        looks_like_image(F.col("declared"), name).alias("image"),
    )
    readable = ~F.col("pdf") & F.col("image")
    small = F.col("bytes") <= F.lit(MAX_FILE_BYTES)
    drops = rows.groupBy("drop_id").agg(
        F.count_if(F.col("pdf")).alias("n_pdfs"),
        F.count_if(~F.col("pdf")).alias("n_rest"),
        F.count_if(readable & small).alias("n_images"),
        F.count_if(readable & ~small).alias("n_oversize"),
        F.min(F.when(F.col("pdf"), F.struct("seq", "name", "bytes"))).alias("first_pdf"),
    )
    only_pdfs = (F.col("n_pdfs") > 0) & (F.col("n_rest") == 0)
    too_big = F.col("first_pdf.bytes") > F.lit(MAX_PDF_BYTES)
    route = (
        F.when(only_pdfs & too_big, "none").when(only_pdfs, "pdf")
        .when(F.col("n_images") == 0, "none").when(F.col("n_images") == 1, "editor")
        .otherwise("queue")
    )
    note = (
        F.when(only_pdfs & too_big,
               F.concat(F.lit("Skipped (over 150 MB): "), F.col("first_pdf.name")))
        .when(only_pdfs & (F.col("n_pdfs") > 1), "One PDF at a time — opened the first.")
        .when(only_pdfs, None)
        .otherwise(F.coalesce(
            F.nullif(F.concat_ws(
                NOTE_JOIN,
                F.when(F.col("n_pdfs") > 0, "Drop a PDF on its own to compress it."),
                F.when(F.col("n_oversize") > 0, F.concat(
                    F.lit("Skipped (over 50 MB): "), F.col("n_oversize").cast("string"))),
            ), F.lit("")),
            F.when(F.col("n_images") == 0, "No readable images in that drop."),
        ))
    )
    return drops.select(
        "drop_id", route.alias("route"),
        F.when(only_pdfs, F.lit(0).cast("bigint")).otherwise(F.col("n_images")).alias("n_images"),
        F.when(only_pdfs, F.lit(0).cast("bigint")).otherwise(F.col("n_oversize")).alias("n_oversize"),
        F.when(only_pdfs & ~too_big, F.col("first_pdf.name")).alias("pdf"), note.alias("note"),
    )


def dedupe_intake(manifest: DataFrame, identity=("name", "bytes", "mtime_ms")) -> DataFrame:
    """The first arrival of every (name, size, last-modified).

    An aggregate rather than a window: copies collapse before the shuffle, so a file that was
    dropped a billion times is one row per map task.
    """
    rows = manifest if "name" in manifest.columns else manifest.withColumn(
        "name", basename(F.col("path"))
    )
    rest = [c for c in rows.columns if c not in identity and c != "seq"]
    first = rows.groupBy(*identity).agg(F.min(F.struct("seq", *rest)).alias("__first"))
    return first.select(*identity, "__first.*").select(*rows.columns)


def sweep_stale_sessions(
    dirs: DataFrame, now_ms: Column, max_age_ms: int = STALE_MS, current: str | None = None
) -> DataFrame:
    """``+started_ms, +stale`` of working folders named ``session-<base 36 ms>-<rand>``."""
    stamp = F.regexp_extract("name", r"^session-([0-9a-z]+)-", 1)
    started = F.when(stamp != "", F.conv(stamp, 36, 10).cast("bigint"))
    stale = started.isNull() | (now_ms - started > F.lit(max_age_ms))
    if current is not None:
        stale = stale & (F.col("name") != current)
    return dirs.withColumns({"started_ms": started, "stale": stale})
