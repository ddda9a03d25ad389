"""Preset library, start-up settings, fallbacks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlane.functions import settings as S
from assetlane.functions.encoders import DEFAULT_RESIZE, side_settings
from assetlane.functions.numbers import dbl

# Starter presets as (name, encoder, changed options, changed resize).
BUILTIN_PRESETS = [
    ("Web hero image — AVIF q50", "avif", {"quality": 50}, {}),
    ("Lossless PNG — oxipng", "oxipng", {"level": 4, "optimiseAlpha": True}, {}),
    ("Email photo — mozjpeg q75 + resize 1600w", "mozjpeg", {"quality": 75},
     {"enabled": True, "width": 1600, "height": 1200, "fitMethod": "contain"}),
    ("JXL archival — lossless", "jxl", {"lossless": True, "effort": 9}, {}),
]


def builtin_presets() -> Column:
    """The starter presets as a constant array of (name, settings_json)."""
    rows = []
    for name, encoder, options, resize in BUILTIN_PRESETS:
        side = json.loads(side_settings(encoder, **options))
        side["processorState"]["resize"] = {**DEFAULT_RESIZE, **resize}
        text = json.dumps(side, separators=(",", ":"))
        rows.append(F.struct(F.lit(name).alias("name"), F.lit(text).alias("settings_json")))
    return F.array(*rows)


def preset_match(settings: DataFrame, presets: DataFrame) -> DataFrame:
    """``+preset_name``, the first preset by name whose settings equal the row's."""
    named = (
        S.fingerprint(presets, "settings_json", "__fp").where(F.col("__fp").isNotNull())
        .groupBy("__fp").agg(F.min("name").alias("preset_name"))
    )
    keyed = S.fingerprint(settings, "settings_json", "__fp")
    return keyed.join(named, "__fp", "left").drop("__fp")


def settings_precedence(shared: DataFrame, saved: DataFrame, app: DataFrame) -> DataFrame:
    """Start-up settings per user, ``(user_id, origin, encoder, settings_json)``.

    ``shared(user_id, preset_json)`` with a valid preset beats ``saved(user_id, settings_json)``
    that can be rebuilt, which beats ``app(user_id, app_json)``. Each holds one row per user.
    """
    presets = S.validate_presets(shared).where("valid").select(
        "user_id", F.get_json_object("preset_json", "$.side").alias("__shared")
    )
    kept = S.sanitise_settings(saved).where(F.col("encoder").isNotNull()).select(
        "user_id", F.col("settings_json").alias("__saved")
    )
    base = S.sanitise_app_settings(app).select("user_id", "default_encoder")
    joined = base.join(presets, "user_id", "left").join(kept, "user_id", "left")
    chosen = F.coalesce("__shared", "__saved")
    return joined.select(
        "user_id",
        F.when(F.col("__shared").isNotNull(), "shared").when(F.col("__saved").isNotNull(), "saved")
        .otherwise("default").alias("origin"),
        F.coalesce(F.get_json_object(chosen, "$.encoderId"), F.col("default_encoder")).alias("encoder"),
        chosen.alias("settings_json"),
    )


def seed_presets(
    current: DataFrame, builtins: Column | None = None, seeded: DataFrame | None = None,
    library: str = "library_id",
) -> DataFrame:
    """Every library with the built-ins it lacks by name, unless it was seeded before.

    ``current(library, name, settings_json)``, ``seeded(library)``. The built-ins are a constant
    array, exploded once per library.
    """
    libraries = current.select(library).distinct()
    if seeded is not None:
        libraries = libraries.join(seeded.select(library).distinct(), library, "left_anti")
    pack = builtin_presets() if builtins is None else builtins
    wanted = libraries.select(library, F.explode(pack).alias("__b")).select(library, "__b.*")
    missing = wanted.join(current.select(library, "name"), [library, "name"], "left_anti")
    return current.select(library, "name", "settings_json").unionByName(missing)


def upsert_presets(current: DataFrame, incoming: DataFrame, library: str = "library_id") -> DataFrame:
    """Merge by name; the later incoming entry (by ``seq``) wins."""
    rows = current.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    rest = [c for c in current.columns if c not in (library, "name")]
    last = F.max(F.struct("__new", "seq", *[c for c in rest if c != "seq"])).alias("__last")
    merged = rows.groupBy(library, "name").agg(last)
    return merged.select(library, "name", *[F.col(f"__last.{c}").alias(c) for c in rest])


def in_name_order(presets: DataFrame, library: str = "library_id") -> DataFrame:
    """Presets by name, in binary order."""
    return presets.orderBy(library, "name")


def rename_presets(current: DataFrame, renames: DataFrame, library: str = "library_id") -> DataFrame:
    """``renames(library, old_name, new_name)``; the moved row replaces any row of that name.

    Unknown names and renames to the same name change nothing. One rename per preset at a time.
    """
    real = renames.where(F.col("old_name") != F.col("new_name"))
    moved = current.join(
        real.withColumnRenamed("old_name", "name"), [library, "name"], "inner"
    )
    landed = moved.select(library, F.col("new_name").alias("__gone"))
    left = moved.select(library, F.col("name").alias("__gone"))
    gone = landed.unionByName(left).distinct().withColumnRenamed("__gone", "name")
    stay = current.join(gone, [library, "name"], "left_anti")
    renamed = moved.withColumn("name", F.col("new_name")).select(*current.columns)
    return stay.select(*current.columns).unionByName(renamed)


def remove_presets(current: DataFrame, names: DataFrame, library: str = "library_id") -> DataFrame:
    """Drop presets by name; unknown names change nothing."""
    return current.join(names.select(library, "name"), [library, "name"], "left_anti")


def fallback_encoder(failures: DataFrame, failure: str = "failure") -> DataFrame:
    """``+fallback, +fallback_quality`` after a worker failure ('load' or 'timeout').

    Works on sanitised settings columns. An abort or an encode error never falls back.
    """
    option = lambda k: F.try_element_at(F.col("options"), F.lit(k)).cast("double")
    worker = F.col(failure).isin("load", "timeout")
    enc = F.col("encoder")
    lossy_webp = (enc == "webp") & (option("lossless") != dbl(1)) & (
        option("near_lossless") >= dbl(100)
    )
    fallback = F.when(
        worker,
        F.when(enc == "mozjpeg", "browser-jpeg").when(lossy_webp, "browser-webp")
        .when(enc == "oxipng", "browser-png"),
    )
    quality = F.when(fallback.isin("browser-jpeg", "browser-webp"), option("quality") / dbl(100))
    return failures.withColumns({"fallback": fallback, "fallback_quality": quality})
