"""User functions at the edge: encoders and image metrics."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlane.functions.filetypes import magic_type

EncodeFn = Callable[[bytes, str], bytes]
MetricFn = Callable[[bytes, bytes, int, int], float]


def run_encodes(
    plan: DataFrame, images: DataFrame, fn: EncodeFn, partitions: int | None = None,
    cells_per_task_row: int = 16,
) -> DataFrame:
    """Apply ``fn(content, settings_json) -> bytes`` to every planned item.

    ``plan(item_id, image_id, encoder, settings_json, out_mime)`` and ``images(image_id,
    content)`` give ``(item_id, image_id, encoder, status, out_size, out_bytes, error, ms)``. The
    settings are those in the plan at call time. Identity passes the content through, a raised
    error becomes an error row, and so does an output that is not of type ``out_mime`` (unchecked
    when null).

    The cells of an image travel together in packs of about ``cells_per_task_row``, so its content
    is shuffled and handed to Python once per pack, not once per cell.
    """
    pack_of = F.pmod(F.xxhash64("item_id"), F.lit(1 << 20))
    cell = F.struct("item_id", "encoder", "settings_json", "out_mime")
    counts = plan.groupBy("image_id").agg(F.count(F.lit(1)).alias("__n"))
    spread = plan.join(counts, "image_id").withColumn(
        "__pack", F.pmod(pack_of, F.ceil(F.col("__n") / F.lit(cells_per_task_row)))
    )
    packs = spread.groupBy("image_id", "__pack").agg(F.collect_list(cell).alias("cells"))
    work = packs.join(images.select("image_id", "content"), "image_id", "left").select(
        "image_id", "content", "cells", "__pack"
    )
    keys = [F.col("image_id"), F.col("__pack")]
    work = work.repartition(partitions, *keys) if partitions else work.repartition(*keys)
    work = work.drop("__pack")

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for image_id, content, cells in zip(
                frame.image_id, frame.content, frame.cells, strict=True
            ):
                rows = []
                for c in cells:
                    began = time.perf_counter()
                    out, error = None, None
                    try:
                        if content is None:
                            raise ValueError("source not found")
                        out = content if c["encoder"] == "identity" else fn(content, c["settings_json"])
                    except Exception as problem:  # one failing item must not end the run
                        error = str(problem) or type(problem).__name__
                    spent = (time.perf_counter() - began) * 1000.0
                    rows.append(
                        (c["item_id"], image_id, c["encoder"], c["out_mime"], out, error, spent)
                    )
                yield pd.DataFrame(
                    rows, columns=["item_id", "image_id", "encoder", "out_mime", "out_bytes", "error", "ms"]
                )

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    done = work.mapInPandas(
        encode,
        f"item_id {kind(plan, 'item_id')}, image_id {kind(plan, 'image_id')}, encoder string, "
        "out_mime string, out_bytes binary, error string, ms double",
    )
    checked = (F.col("encoder") != "identity") & (F.coalesce("out_mime", F.lit("")) != "")
    wrong = checked & (magic_type(F.col("out_bytes")) != F.col("out_mime"))
    error = F.coalesce(
        F.col("error"), F.when(wrong, F.concat(F.lit("output is not "), F.col("out_mime")))
    )
    ok = error.isNull()
    return done.select(
        "item_id", "image_id", "encoder", F.when(ok, "done").otherwise("error").alias("status"),
        F.when(ok, F.octet_length("out_bytes").cast("bigint")).alias("out_size"),
        F.when(ok, F.col("out_bytes")).alias("out_bytes"), error.alias("error"), "ms",
    )


def custom_metric(pairs: DataFrame, fn: MetricFn) -> DataFrame:
    """``fn(ref, out, width, height) -> float`` over packed image pairs, ``(image_id, score)``.

    ``pairs`` holds (image_id, width, height, ref, out) with packed samples. A metric that raises
    or is not finite gives a null score. No shuffle: a pair is one row.
    """
    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores = []
            for ref, out, w, h in zip(frame.ref, frame.out, frame.width, frame.height, strict=True):
                try:
                    value = float(fn(ref, out, int(w), int(h)))
                except Exception:  # an image that cannot be measured is unmeasured, not an error
                    value = None
                scores.append(value if value is not None and abs(value) < float("inf") else None)
            yield pd.DataFrame(
                {"image_id": frame.image_id, "score": pd.Series(scores, dtype="float64")}
            )

    kind = pairs.schema["image_id"].dataType.simpleString()
    scored = pairs.select("image_id", "width", "height", "ref", "out").mapInPandas(
        score, f"image_id {kind}, score double"
    )
    return scored.withColumn("score", F.when(~F.isnan("score"), F.col("score")))
