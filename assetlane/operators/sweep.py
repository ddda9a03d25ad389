"""Encoder sweeps: plan, score, recommend, summarise."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlane.functions.encoders import (
    DEFAULT_OPTIONS, ENCODER_IDS, LOSSLESS_ROWS, encoder_attr, encoder_dim, side_settings,
)
from assetlane.functions.numbers import clamp, dbl, js_round
from assetlane.functions.savings import GOOD, SAVINGS_FLOOR, saved_percent, verdict
from assetlane.session import hand_over, spread

# The default sweep.
SWEEP_ENCODERS = ["mozjpeg", "webp", "avif", "jxl", "oxipng"]
QUALITY_STEPS = [30, 50, 70, 90]
EFFORT_STEPS = [0, 2, 4, 6]
UNMEASURED_FLOOR = 50


def steps_for(encoder: str, qualities: Sequence[int], efforts: Sequence[int]) -> list[int]:
    if encoder not in LOSSLESS_ROWS:
        return list(qualities)
    last = efforts[-1] if efforts else 2
    return [efforts[i] if i < len(efforts) else last for i in range(len(qualities))]


def step_settings(encoder: str, step: int) -> str:
    if encoder == "oxipng":
        return side_settings(encoder, level=max(0, min(6, step)))
    if "quality" in DEFAULT_OPTIONS[encoder] and not encoder.startswith("browser-"):
        return side_settings(encoder, quality=step)
    return side_settings(encoder)


def sweep_plan(
    images: DataFrame, encoders: Sequence[str] = tuple(SWEEP_ENCODERS),
    qualities: Sequence[int] = tuple(QUALITY_STEPS), efforts: Sequence[int] = tuple(EFFORT_STEPS),
) -> DataFrame:
    """Image x encoder x step, ``+row, +col, +encoder, +step, +step_label, +lossless,
    +settings_json``.

    The grid is a handful of constants, so it is exploded from a literal array inside the scan
    stage: no join and no shuffle, whatever the number of images.
    """
    cells = []
    for row, enc in enumerate(encoders):
        for col, step in enumerate(steps_for(enc, qualities, efforts)):
            lossless = enc in LOSSLESS_ROWS
            cells.append(
                F.struct(
                    F.lit(row).alias("row"), F.lit(col).alias("col"), F.lit(enc).alias("encoder"),
                    F.lit(step).alias("step"),
                    F.lit(f"{'Effort' if lossless else 'Quality'} {step}").alias("step_label"),
                    F.lit(lossless).alias("lossless"),
                    F.lit(step_settings(enc, step)).alias("settings_json"),
                )
            )
    return images.select("*", F.explode(F.array(*cells)).alias("__cell")).select(
        *images.columns, "__cell.*"
    )


def score_sweep(
    plan: DataFrame, results: DataFrame, originals: DataFrame | None = None
) -> DataFrame:
    """The plan with its results: done, error or pending cells.

    ``results`` holds (image_id, row, col, status, size, ssim, error, ms). ``originals`` adds
    ``original_bytes`` when the plan lacks it.
    """
    if originals is not None and "original_bytes" not in plan.columns:
        plan = plan.join(spread(originals.select("image_id", "original_bytes")), "image_id", "left")
    given = results.select(
        "image_id", "row", "col", F.col("status").alias("__status"), F.col("size").alias("__size"),
        F.col("ssim").alias("__ssim"), F.col("error").alias("__error"), F.col("ms").alias("__ms"),
    )
    joined = plan.join(spread(given), ["image_id", "row", "col"], "left")
    done = F.col("__status") == "done"
    failed = F.col("__status") == "error"
    # a cell whose output type cannot be decoded back stays unmeasured
    ssim = F.when(done & encoder_attr(F.col("encoder"), "decodable"), F.col("__ssim"))
    zero = F.lit(0).cast("bigint")
    return joined.select(
        *plan.columns,
        F.when(done, "done").when(failed, "error").otherwise("pending").alias("status"),
        F.when(done, F.col("__size")).alias("size"),
        F.when(done, F.coalesce(saved_percent(F.col("original_bytes"), F.col("__size")), zero))
        .otherwise(zero).alias("saved_pct"),
        ssim.alias("ssim"),
        F.when(failed, "Failed").when(done, verdict(ssim)).otherwise("Unmeasured").alias("verdict"),
        F.when(failed, F.col("__error")).alias("error"),
        F.when(done | failed, F.col("__ms")).alias("ms"),
    )


def recommend(cells: DataFrame, quality_floor: int = UNMEASURED_FLOOR) -> DataFrame:
    """One pick per image, ``(image_id, row, col, encoder, step, size, ssim)``.

    All candidate pools are ranked in one aggregate: the least (size, -ssim, row, col) of every
    pool, and the first pool that is not empty and allowed wins. Partial aggregation leaves one
    row per image and map task to shuffle.
    """
    size, ssim = F.col("size"), F.col("ssim")
    done = (F.col("status") == "done") & size.isNotNull()
    measured = done & ssim.isNotNull()
    worth = saved_percent(F.col("original_bytes"), size) >= SAVINGS_FLOOR
    # NaN sorts above every number here, and is no match
    good = measured & ~F.isnan(ssim) & (ssim >= dbl(GOOD))
    trusted = done & (F.col("lossless") | (F.col("step") >= quality_floor))
    picked = F.struct("encoder", "step", "size", "ssim")
    by_size = F.struct(
        size, (-F.coalesce(ssim, dbl(0))).alias("worse"), F.col("row"), F.col("col"),
        picked.alias("cell"),
    )
    by_ssim = F.struct(
        (-ssim).alias("worse"), F.col("row"), F.col("col"), picked.alias("cell")
    )

    def least(pool: Column, key: Column, name: str) -> Column:
        return F.min(F.when(pool, key)).alias(name)

    pools = cells.groupBy("image_id").agg(
        F.max(measured).alias("any_measured"),
        least(good & worth, by_size, "good_worth"), least(good, by_size, "good_any"),
        least(measured, by_ssim, "best"),
        least(trusted & worth, by_size, "trusted_worth"), least(trusted, by_size, "trusted_any"),
        least(done & worth, by_size, "done_worth"), least(done, by_size, "done_any"),
    )

    def field(name: str) -> Column:
        seen = F.coalesce(*[F.col(f"{p}.{name}") for p in ("good_worth", "good_any", "best")])
        blind = F.coalesce(
            *[F.col(f"{p}.{name}")
              for p in ("trusted_worth", "trusted_any", "done_worth", "done_any")]
        )
        return F.when(F.col("any_measured"), seen).otherwise(blind)

    def inner(name: str) -> Column:
        seen = F.coalesce(*[F.col(p) for p in ("good_worth.cell", "good_any.cell", "best.cell")])
        blind = F.coalesce(
            *[F.col(f"{p}.cell") for p in ("trusted_worth", "trusted_any", "done_worth", "done_any")]
        )
        return F.when(F.col("any_measured"), seen).otherwise(blind)[name]

    return pools.where(F.col("done_any").isNotNull()).select(
        "image_id", field("row").alias("row"), field("col").alias("col"),
        *[inner(n).alias(n) for n in ("encoder", "step", "size", "ssim")],
    )


def lowest_quality(
    cells: DataFrame, target: float = 0.99, low: int = 30, high: int = 95
) -> DataFrame:
    """The smallest quality step in range that reaches the SSIM target, per encoder."""
    return (
        cells.where(
            (F.col("status") == "done") & ~F.col("lossless") & (F.col("ssim") >= dbl(target)) & ~F.isnan("ssim")
            & F.col("step").between(low, high)
        )
        .groupBy("image_id", "encoder")
        .agg(F.min("step").alias("step"), F.min_by("size", "step").alias("size"))
    )


def search_quality(
    images: DataFrame, probe: Callable[[DataFrame], DataFrame], target: float = 0.99,
    low: int = 30, high: int = 95, encodes: int = 6,
) -> DataFrame:
    """W2 as a search: ``(image_id, step, size, ssim, encodes, exact)`` with at most ``encodes`` encodes an image.

    Each round halves the range of steps of all images at once: ``probe`` gets ``(image_id, step)``, encodes
    and measures, and returns ``(image_id, step, size, ssim)``. A step that reaches the target becomes the
    pick and the search goes on below it, otherwise above. As in any bisection, quality is taken to rise with
    the step. ``step`` is null where no probe reached the target. ``exact`` tells whether the range is used up; 66
    steps can need a seventh encode. Without it the pick is the least step known to do, at most one above the
    least; it is null where ``high`` alone is left untried.

    A null, NaN or missing ``ssim`` reaches nothing; of several measures of one step the worst counts. Repeated
    ids are searched once, null ids not at all. A round is two key-co-located joins and one stored table of a
    row an image, so lineage stays short; images that are done are not probed again.
    """
    if low > high or encodes < 0:
        raise ValueError("the range of steps must not be empty, nor the number of encodes negative")
    nothing = {"step": "int", "size": "bigint", "ssim": "double"}
    state = images.select("image_id").where("image_id IS NOT NULL").distinct().withColumns({
        "__low": F.lit(low), "__high": F.lit(high), **{c: F.lit(None).cast(t) for c, t in nothing.items()}, "encodes": F.lit(0)})
    state = hand_over(state, "quality-search")
    for _ in range(encodes):
        active = F.col("__low") <= F.col("__high")
        middle = F.floor((F.col("__low") + F.col("__high")) / 2).cast("int")
        found = probe(state.where(active).select("image_id", middle.alias("step")))
        worst = F.when(~F.isnan("ssim"), F.col("ssim"))
        found = found.groupBy("image_id").agg(
            F.max_by(F.col("size").cast("bigint"), F.struct(worst.isNull(), -worst)).alias("__size"),
            F.when(F.count_if(worst.isNull()) == 0, F.min(worst)).cast("double").alias("__ssim"))
        reached = active & F.coalesce(F.col("__ssim") >= dbl(target), F.lit(False))
        rows = state.join(found, "image_id", "left").select(
            "image_id",
            F.when(active & ~reached, middle + 1).otherwise(F.col("__low")).alias("__low"),
            F.when(reached, middle - 1).otherwise(F.col("__high")).alias("__high"),
            F.when(reached, middle).otherwise(F.col("step")).alias("step"),
            F.when(reached, F.col("__size")).otherwise(F.col("size")).alias("size"),
            F.when(reached, F.col("__ssim")).otherwise(F.col("ssim")).alias("ssim"),
            (F.col("encodes") + active.cast("int")).alias("encodes"))
        state = hand_over(rows, "quality-search")  # no encode is made again, whatever is read from the result
    return state.select("image_id", "step", "size", "ssim", "encodes", (F.col("__low") > F.col("__high")).alias("exact"))


def bar_percent(cells: DataFrame) -> DataFrame:
    """``+row_max, +bar_pct`` against the largest encode of the (image, encoder) row.

    Aggregate and join back, so a row group of any size can be split by the skew join.
    """
    tops = cells.groupBy("image_id", "encoder").agg(
        F.coalesce(F.max("size"), F.lit(0)).cast("bigint").alias("row_max")
    )
    bar = clamp(
        js_round(F.col("size") / F.col("row_max") * dbl(100)),
        F.lit(2).cast("bigint"), F.lit(100).cast("bigint"),
    )
    missing = F.col("size").isNull() | (F.col("row_max") <= 0)
    return cells.join(spread(tops), ["image_id", "encoder"], "left").withColumn(
        "bar_pct", F.when(missing, F.lit(0).cast("bigint")).otherwise(bar)
    ).select(*cells.columns, "row_max", "bar_pct")


def sweep_summary(cells: DataFrame, quality_floor: int = UNMEASURED_FLOOR) -> DataFrame:
    """A2: per image the grid size, completed, failed, whether measured, and the pick."""
    done = F.col("status") == "done"
    counts = cells.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(done).alias("completed"),
        F.count_if(F.col("status") == "error").alias("failed"),
        F.max(done & F.col("ssim").isNotNull()).alias("measured"),
    )
    picks = recommend(cells, quality_floor).select(
        "image_id", F.col("encoder").alias("recommended"), F.col("step").alias("recommended_step"),
        F.col("size").alias("recommended_size"),
    )
    return counts.join(spread(picks), "image_id", "left")


def excluded_encoders(spark: SparkSession, cells: DataFrame) -> DataFrame:
    """A2: encoders that a sweep leaves out, in display order (at most nine rows)."""
    known = encoder_dim(spark).where(F.col("encoder") != ENCODER_IDS[0])
    return known.join(cells.select("encoder").distinct(), "encoder", "left_anti").select(
        "encoder", "label", "ord"
    )


def sweep_matrix(cells: DataFrame, columns: Sequence[int] = (0, 1, 2, 3)) -> DataFrame:
    """A3: one row per (image, encoder), ``size_<col>`` and ``ssim_<col>`` per step column."""
    picks = []
    for c in columns:
        here = F.col("col") == c
        picks.append(F.max(F.when(here, F.col("size"))).alias(f"size_{c}"))
        picks.append(F.max(F.when(here, F.col("ssim"))).alias(f"ssim_{c}"))
    return cells.groupBy("image_id", "row", "encoder").agg(*picks)
