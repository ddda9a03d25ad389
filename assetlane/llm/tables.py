"""Hand-over tables in the shared folder, and joins that broadcast only what is known to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlane.session import scratch_folder

BROADCAST_BYTES = 32 << 20
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ``BATCH_ROWS`` rows: texts are long rows, and a batch is
    held in the executor and in its Python worker at once. A smaller setting stays."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def store(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage, survives executors."""
    small_batches(spark)
    path = scratch_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def if_small(stored: DataFrame, row_bytes: int, items: str | None = None) -> DataFrame:
    """The table with a broadcast hint if it is counted to be below ``BROADCAST_BYTES``.

    ``row_bytes`` is the size of a row, or of one item of the array column ``items``. Beyond the
    bound the table comes back as it is and Spark shuffles the join; results are the same. Meant for
    lists of keys and of places in texts; tables with payload are left to Spark's own size check.
    """
    size = F.count(F.lit(1)) if items is None else F.sum(F.size(items) + 1)
    n = stored.agg(size.alias("n")).first()["n"] or 0
    return F.broadcast(stored) if n * row_bytes <= BROADCAST_BYTES else stored
