"""Reusable results and recompute planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetlane.functions.settings import fingerprint, settings_keys

RESULT_SLOTS = 5


def reuse_results(
    requests: DataFrame, ledger: DataFrame, seq: str = "seq"
) -> tuple[DataFrame, DataFrame]:
    """``(hits, todo)`` for requests against earlier results.

    Both sides hold (image_hash, settings_json). The newest ledger row of a key serves it, with
    all its result columns, the fallback label included. The ledger is reduced to one row per key
    before the join; a hot request key sits on the splittable side of the skew join.
    """
    keys = ["image_hash", "__fp"]
    wanted = fingerprint(requests, "settings_json", "__fp")
    kept = [c for c in ledger.columns if c not in ("image_hash", "settings_json", seq)]
    newest = (
        fingerprint(ledger, "settings_json", "__fp").where(F.col("__fp").isNotNull())
        .groupBy(*keys).agg(F.max_by(F.struct(*kept), seq).alias("__r"))
    )
    hits = wanted.join(newest, keys, "inner").select(*requests.columns, "__r.*")
    todo = wanted.join(newest, keys, "left_anti").select(*requests.columns)
    return hits, todo


def work_diff(current: DataFrame, desired: DataFrame, removals: bool = False) -> DataFrame:
    """Cheapest sufficient work per image and side.

    Both hold (image_id, side, file_id, rotate, crop, settings_json) with ``crop`` a struct or
    null. ``removals`` also lists rows that are no longer wanted.
    """
    keys = ["image_id", "side"]

    def state(df: DataFrame, p: str) -> DataFrame:
        df = settings_keys(df)
        # the resize of a pass-through side has no effect
        effective = F.when(F.col("encoder_key") == "identity", "off").otherwise(F.col("resize_key"))
        return df.select(
            *keys, F.lit(True).alias(f"{p}_row"), F.col("file_id").alias(f"{p}_file"),
            F.struct("rotate", "crop").alias(f"{p}_pre"),
            F.col("encoder_key").alias(f"{p}_enc"), F.col("options_key").alias(f"{p}_opt"),
            effective.alias(f"{p}_resize"),
        )

    both = state(desired, "d").join(
        state(current, "c"), keys, "full" if removals else "left"
    )

    def differs(name: str):
        return ~F.col(f"c_{name}").eqNullSafe(F.col(f"d_{name}"))

    fresh = F.col("c_row").isNull()
    gone = F.col("d_row").isNull()
    both = both.withColumn("decoding", ~gone & (fresh | differs("file")))
    both = both.withColumn("preprocessing", ~gone & (F.col("decoding") | differs("pre")))
    crossed = ~(F.col("c_enc") == "identity").eqNullSafe(F.col("d_enc") == "identity")
    both = both.withColumn(
        "processing", ~gone & (F.col("preprocessing") | crossed | differs("resize"))
    )
    both = both.withColumn(
        "encoding", ~gone & (F.col("processing") | differs("enc") | differs("opt"))
    )
    return both.select(
        *keys, "decoding", "preprocessing", "processing", "encoding",
        F.col("encoding").alias("needed"), *([gone.alias("removed")] if removals else []),
    )


def recent_results(access_log: DataFrame, k: int = RESULT_SLOTS) -> DataFrame:
    """The k most recently used distinct keys per source, ``(source, key, ts, place)``.

    Uses collapse to one row per (source, key) before the shuffle; the rank filter becomes a
    window group limit, which keeps k rows per source and map task.
    """
    last = access_log.groupBy("source", "key").agg(F.max("ts").alias("ts"))
    order = Window.partitionBy("source").orderBy(F.col("ts").desc(), F.col("key"))
    return last.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
