"""Session defaults and the checkpoint folder rule."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "assetlane", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume.

    On a cluster the master, memory and shuffle sizes come from spark-submit; pass only what
    differs. ``spark.sql.shuffle.partitions`` is left to the deployment (AQE coalesces it).
    """
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # settings JSON follows the "last key wins" rule of JSON.parse
        .config("spark.sql.variant.allowDuplicateKeys", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable on the workers, however the driver came by it."""
    if getattr(spark.sparkContext, "_assetlane_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        for folder, _, names in sorted(os.walk(package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    # the driver serves the file to the executors; it is not read back by path
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "assetlane.zip")
    with open(path, "wb") as file:
        file.write(packed.getvalue())
    spark.sparkContext.addPyFile(path)
    spark.sparkContext._assetlane_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and hand-over tables.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, a local master gets a
    temporary folder; a cluster is refused, as its executors would not see one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for a table handed from one job to the next.

    Only a name is made; Spark creates the folder, so any file system will do.
    """
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def hand_over(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back, which cuts the lineage."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A side of a join that is shuffled, never broadcast.

    Spark judges a table by its compressed files and does not count the rows that exploding adds, so a table of many
    alike rows looks small to it and would pass through the driver whole.
    """
    return df.hint("merge")
