"""Folders of assets, preset files and stored results."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlane.functions.paths import basename
from assetlane.functions.settings import PARTS, member, preset_parts, preset_reason

BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def scan_assets(
    spark: SparkSession, root: str, glob: str | None = None, max_depth: int | None = None
) -> DataFrame:
    """Every file under ``root``, ``(path, rel_path, depth, bytes, mtime, content)``.

    ``root`` may be relative or hold wildcards; paths are then relative to its fixed part. A file in
    the root has depth 0; ``max_depth`` leaves out what lies deeper. Columns not used are pruned: without ``content`` (or a column
    made from it) no file is opened. A ``content`` is the whole file; :func:`read_heads` reads first bytes only.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return relative_paths(reader.load(root), root, max_depth)


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:/*"


def fixed_root(spark: SparkSession, root: str) -> str:
    """The part of ``root`` before any wildcard, as the file system itself names it."""
    wild = re.search(r"[*?\[{]", root)
    fixed = root[: wild.start()].rpartition("/")[0] or "/" if wild else root
    path = spark._jvm.org.apache.hadoop.fs.Path(fixed)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def relative_paths(files: DataFrame, root: str, max_depth: int | None) -> DataFrame:
    bare = F.regexp_replace("path", _SCHEME, "/")
    base = ("/" + re.sub(_SCHEME, "", fixed_root(files.sparkSession, root)).strip("/")).rstrip("/") + "/"
    rel = F.when(bare.startswith(base), F.substring(bare, len(base) + 1, 1 << 20)).otherwise(basename(bare))
    depth = F.size(F.split(rel, "/")) - 1
    out = files.select(
        "path", rel.alias("rel_path"), depth.alias("depth"), F.col("length").alias("bytes"),
        F.col("modificationTime").alias("mtime"), "content",
    )
    return out if max_depth is None else out.where(F.col("depth") <= max_depth)


def with_name_and_head(assets: DataFrame, n: int = 32) -> DataFrame:
    """``+name, +head`` for typing; drops the content."""
    return assets.withColumns(
        {"name": basename(F.col("rel_path")), "head": F.substring("content", 1, n)}
    ).drop("content")


def read_heads(
    spark: SparkSession, root: str, n: int = 32, glob: str | None = None, max_depth: int | None = None
) -> DataFrame:
    """As :func:`scan_assets`, but with ``head``, the first ``n`` bytes, for ``content``.

    Spark lists the files and opens none; each task then asks the file system for the first bytes of its
    own, so a file of any size costs one small read (``n=256 * 1024`` is what HDR marks are looked for in).
    Spark's listing leaves empty files out, here and in :func:`scan_assets`; a file gone since it was listed fails the task.
    """
    files = scan_assets(spark, root, glob, max_depth).drop("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        systems: dict = {}
        for batch in batches:
            # heads are up to n bytes each: a few MB go out at a time
            step = max(1, (4 << 20) // max(n, 1))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                heads = [_first_bytes(systems, path, n) for path in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(heads, pa.binary())], [*part.schema.names, "head"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(run, f"{fields}, head binary")


def _first_bytes(systems: dict, path: str, n: int) -> bytes:
    from pyarrow.fs import FileSystem, LocalFileSystem

    whole = re.match(r"([A-Za-z][A-Za-z0-9+.\-]*)://([^/]+)/(.*)", path, re.S)
    if whole is None or whole[1] == "file":
        system, inner = systems.setdefault("file", LocalFileSystem()), re.sub(r"^file:/*", "/", path)
    else:
        scheme = "s3" if whole[1] in ("s3a", "s3n") else whole[1]
        at = f"{scheme}://{whole[2]}/"
        if at not in systems:
            systems[at] = FileSystem.from_uri(at)
        system, base = systems[at]
        inner = f"{base.rstrip('/')}/{whole[3]}"
    with system.open_input_file(inner) as file:
        return file.read_at(n, 0)


def read_presets(spark: SparkSession, path: str, layout: str = "document") -> DataFrame:
    """Presets with ``valid`` and ``reject_reason``.

    ``layout="document"``: each file is one JSON array, as users export it, or a single preset (files
    are read in parallel); a file that is not JSON is one row with reason ``not-json``. ``layout="lines"``: one preset per line, as :func:`write_presets` stores libraries
    of any size. Returns (file, pos, name, preset_json, valid, reject_reason).
    """
    whole = layout == "document"
    text = spark.read.text(path, wholetext=whole).select(
        F.input_file_name().alias("file"), F.try_parse_json("value").alias("__v")
    )
    if whole:
        items = F.coalesce(F.try_variant_get("__v", "$", "array<variant>"),
                           F.when(F.col("__v").isNotNull(), F.array("__v")))
        rows = text.select("file", F.col("__v").isNull().alias("__bad"), F.posexplode_outer(items).alias("pos", "__v"))
        rows = rows.where(F.col("__bad") | F.col("pos").isNotNull())
    else:
        rows = text.withColumn("pos", F.monotonically_increasing_id())
    bad = F.col("__bad") if whole else F.lit(False)
    rows = preset_parts(rows)
    rows = rows.withColumns(
        {
            "name": member("__top", "name", "string"), "preset_json": F.to_json("__v"),
            "reject_reason": F.when(bad, F.lit("not-json")).otherwise(preset_reason(rows)),
        }
    ).drop(*PARTS, "__top", "__bad")
    return rows.withColumn("valid", F.col("reject_reason").isNull())


def export_presets(presets: DataFrame, path: str, json: str = "preset_json", library: str = "library_id") -> None:
    """Each library as one file holding one JSON array, under ``path/library_id=<id>``.

    A library is one document and so passes through one task; use :func:`write_presets` for more.
    """
    rows = presets.groupBy(library).agg(F.sort_array(F.collect_list(json)).alias("all"))
    text = F.concat(F.lit("["), F.array_join("all", ","), F.lit("]"))
    rows.select(library, text.alias("value")).repartition(library).write.mode("overwrite").partitionBy(library).text(path)


def write_presets(presets: DataFrame, path: str, json: str = "preset_json") -> None:
    """Store preset JSON, one per line."""
    presets.select(F.col(json).alias("value")).write.mode("overwrite").text(path)


def write_results(results: DataFrame, path: str) -> None:
    """Store encode results by encoder; a rerun replaces only the encoders it holds."""
    (
        results.repartition("encoder", F.pmod(F.xxhash64("item_id"), F.lit(64)))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("encoder").parquet(path)
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
