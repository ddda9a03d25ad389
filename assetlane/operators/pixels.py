"""Pixel-table operators.

A pixel row is ``(image_id, width, height, x, y, r, g, b, a)``. The image size rides on every row
(it costs next to nothing in a columnar file), so the geometric operators are projections without
a join or a shuffle. ``with_dims`` attaches sizes to a table that lacks them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetlane.functions.numbers import byte_store, clamp, dbl, int_div, js_round

PX = ["image_id", "width", "height", "x", "y", "r", "g", "b", "a"]

# Luma weights, SSIM constants and window, pixel budget of a comparison.
LUMA = (0.2126, 0.7152, 0.0722)
C1, C2 = 6.5025, 58.5225
WINDOW = 8
MAX_METRIC_PIXELS = 2_000_000

# Crop and thumbnail limits, render scales, aspect presets.
MIN_CROP = 8
THUMB_EDGE = 120
MIN_SCALE = 0.01
ASPECTS = {"Free": None, "1:1": 1.0, "16:9": 16 / 9, "4:3": 4 / 3}

CHANNELS = {"rgba": 4, "rgb": 3, "gray": 1}
_BAND = 1 << 18


def with_dims(px: DataFrame, images: DataFrame) -> DataFrame:
    """Attach ``width`` and ``height`` from an image table (an equi-join on image_id)."""
    return px.join(images.select("image_id", "width", "height"), "image_id").select(*PX)


# ------------------------------------------------------------------------------- P1 exploding


def explode_pixels(images: DataFrame, channels: str = "rgba", data: str = "data") -> DataFrame:
    """Row-major 8-bit samples to pixel rows; RGB and gray become RGBA with a = 255.

    ``data`` is an array column (exploded natively) or packed binary (unpacked in Arrow batches,
    in bands, so that a large raster never becomes one large batch). Rasters with too few samples
    give no rows here and are listed by :func:`explode_rejects`.
    """
    n = CHANNELS[channels]
    field = images.schema[data].dataType
    if isinstance(field, T.BinaryType):
        return _explode_packed(images, n, data)
    width = F.col("width")
    count = width.cast("bigint") * F.col("height")
    grid = images.withColumn("__n", count).where((F.col("__n") > 0) & (F.size(data) >= F.col("__n") * F.lit(n)))
    if n == 1:
        rows = grid.select("image_id", "width", "height", "__n", F.posexplode(data).alias("__p", "r"))
        rows = rows.where(F.col("__p") < F.col("__n"))
        samples = [F.col("r"), F.col("r").alias("g"), F.col("r").alias("b")]
    else:
        at = F.explode(F.sequence(F.lit(0), (F.col("__n") - 1).cast("int"))).alias("__p")
        rows = grid.where(F.col("__n") > 0).select("image_id", "width", "height", data, at)
        sample = lambda c: F.get(F.col(data), F.col("__p") * n + c)
        samples = [sample(0).alias("r"), sample(1).alias("g"), sample(2).alias("b")]
    alpha = sample(3).alias("a") if n == 4 else F.lit(255).alias("a")
    return rows.select(
        "image_id", "width", "height", (F.col("__p") % F.col("width")).cast("int").alias("x"),
        int_div(F.col("__p"), F.col("width")).alias("y"), *samples, alpha,
    )


def explode_rejects(images: DataFrame, channels: str = "rgba", data: str = "data") -> DataFrame:
    """``(image_id, width, height, samples, error)`` of rasters that give no pixel rows."""
    field = images.schema[data].dataType
    samples = F.length(data) if isinstance(field, T.BinaryType) else F.size(data)
    samples = F.when(F.col(data).isNotNull(), samples)
    want = F.col("width").cast("bigint") * F.col("height") * CHANNELS[channels]
    error = (F.when(samples.isNull(), "no samples").when(want.isNull(), "no size").when((F.col("width") <= 0) | (F.col("height") <= 0), "image has no area")
             .when(samples < want, "too few samples"))
    return images.select("image_id", "width", "height", samples.alias("samples"), error.alias("error")).where(F.col("error").isNotNull())


def _runs(images: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Images in order, as many together as have ``most`` pixels; larger ones alone."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(images):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield images[lo:hi]
        lo = hi


def _pixel_rows(samples: np.ndarray, image: pa.Array, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """Pixel rows without the size, of samples by channel; gray and RGB become RGBA."""
    n = samples.shape[1]
    level = [pa.array(np.ascontiguousarray(samples[:, c], dtype=np.int32)) for c in range(n)]
    rgba = (level * 3 if n == 1 else level[:3]) + [level[3] if n == 4 else pa.array(np.full(len(samples), 255, np.int32))]
    return pa.RecordBatch.from_arrays([image, pa.array(x), pa.array(y), *rgba], names=["image_id", "x", "y", "r", "g", "b", "a"])


def _sized(rows: pa.RecordBatch, width: np.ndarray | int, height: np.ndarray | int) -> pa.RecordBatch:
    sizes = [pa.array(np.broadcast_to(np.asarray(v, np.int32), rows.num_rows)) for v in (width, height)]
    return pa.RecordBatch.from_arrays([rows.column(0), *sizes, *rows.columns[1:]], names=PX)


def _explode_packed(images: DataFrame, n: int, data: str) -> DataFrame:
    key_type = images.schema["image_id"].dataType.simpleString()

    def band(raster: np.ndarray, image: pa.Array, top: int) -> pa.RecordBatch:
        """Pixel rows of some lines of one image."""
        h, w = raster.shape[:2]
        y, x = np.divmod(np.arange(h * w, dtype=np.int32), np.int32(w))
        return _pixel_rows(raster.reshape(-1, n), image.take(pa.array(np.zeros(h * w, np.int64))), x, y + np.int32(top))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, h = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (1, 2))
            data = batch.column(3)
            size = pc.binary_length(data).fill_null(-1).to_numpy(zero_copy_only=False)
            area = np.where((w > 0) & (h > 0), w * h, 0)
            wide, tall = w.astype(np.int32), h.astype(np.int32)
            kept = np.flatnonzero((area > 0) & (size >= area * n))
            # small images together, larger ones in bands
            for some in _runs(kept, area[kept], _BAND):
                if area[some[0]] > _BAND:
                    i, step = int(some[0]), max(1, _BAND // int(w[some[0]]))
                    raster = np.frombuffer(data[i].as_buffer(), np.uint8, int(area[i]) * n).reshape(h[i], w[i], n)
                    for top in range(0, int(h[i]), step):
                        rows = band(raster[top:top + step], batch.column(0).slice(i, 1), top)
                        yield _sized(rows, wide[i], tall[i])
                    continue
                of = np.repeat(some, area[some])
                at = np.arange(len(of)) - np.repeat(np.cumsum(area[some]) - area[some], area[some])
                samples = np.concatenate([np.frombuffer(data[i].as_buffer(), np.uint8, int(area[i]) * n) for i in some.tolist()])
                y, x = np.divmod(at, w[of])
                rows = _pixel_rows(samples.reshape(-1, n), batch.column(0).take(pa.array(of)), x.astype(np.int32), y.astype(np.int32))
                yield _sized(rows, wide[of], tall[of])

    packed = images.select(
        "image_id", F.col("width").cast("int"), F.col("height").cast("int"),
        F.col(data).alias("data"),
    )
    return packed.mapInArrow(
        unpack, f"image_id {key_type}, width int, height int, x int, y int, r int, g int, b int, a int"
    )


def pack_pixels(px: DataFrame, name: str = "data", channels: str = "rgba") -> DataFrame:
    """Pixel rows back to one packed raster per image, ``(image_id, width, height, <name>)``.

    A pixel is one number; lines are put together first, images from lines, and bytes are made in
    Arrow batches. An image ends as one cell, as it is stored.
    """
    keys, n = ["image_id", "width", "height"], CHANNELS[channels]
    level = lambda c: F.col(c).cast("bigint")
    pixel = level("r") + F.shiftleft(level("g"), 8) + F.shiftleft(level("b"), 16) + F.shiftleft(level("a"), 24)

    # the place is above the 32 bits of the colours, so numbers are sorted and no structs
    placed = F.array_sort(F.collect_list(F.shiftleft(F.col("x").cast("bigint"), 32) + pixel))
    lines = px.groupBy(*keys, "y").agg(placed.alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("y", "line")))
    rasters = lines.groupBy(*keys).agg(F.flatten(F.transform(ordered, lambda p: p["line"])).alias("samples"))

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False).astype(np.int64)
            for some in _runs(np.arange(batch.num_rows), size, 1 << 24):
                part = batch.slice(int(some[0]), len(some))
                samples = part.column(3).flatten().to_numpy(zero_copy_only=False).astype("<u4").view(np.uint8)
                body = np.ascontiguousarray(samples.reshape(-1, 4)[:, :n])
                # one image may have more bytes than 32-bit places reach, and is then alone
                ends = np.concatenate([[0], np.cumsum(size[some])]) * n
                made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(ends.astype("<i8")), pa.py_buffer(body)])
                yield pa.RecordBatch.from_arrays([*part.columns[:3], made.cast(pa.binary())], [*keys, name])

    kinds = ", ".join(f"{k} {px.schema[k].dataType.simpleString()}" for k in keys)
    return rasters.mapInArrow(to_bytes, f"{kinds}, {name} binary")


# --------------------------------------------------------------------------- P2-P5 measuring


def luma_of(r: Column, g: Column, b: Column, a: Column) -> Column:
    tone = dbl(LUMA[0]) * r + dbl(LUMA[1]) * g + dbl(LUMA[2]) * b
    alpha = a / dbl(255)
    return F.when(a == 255, tone).otherwise(tone * alpha + dbl(255) * (dbl(1) - alpha))


def luma(px: DataFrame) -> DataFrame:
    """The luma plane, alpha composited over white."""
    value = luma_of(*[F.col(c) for c in "rgba"])
    return px.select("image_id", "width", "height", "x", "y", value.alias("l"))


def metric_factor(width: Column, height: Column, max_pixels: int = MAX_METRIC_PIXELS) -> Column:
    if max_pixels <= 0:
        return F.lit(1)
    pixels = width.cast("double") * height.cast("double")
    return F.when(pixels <= dbl(max_pixels), F.lit(1)).otherwise(
        F.greatest(F.lit(1), F.ceil(F.sqrt(pixels / dbl(max_pixels))).cast("int"))
    )


def metrics_factor(images: DataFrame, max_pixels: int = MAX_METRIC_PIXELS) -> DataFrame:
    """``+factor``, the box that brings an image under the pixel budget."""
    return images.withColumn(
        "factor", metric_factor(F.col("width"), F.col("height"), max_pixels)
    )


def box_downscale(px: DataFrame, factor: Column | int) -> DataFrame:
    """Average factor x factor blocks per channel; the ragged right and bottom edge is dropped.

    An image narrower or lower than its box keeps one block on that side, with nothing counted for
    the samples it lacks; :func:`undersized` lists such images.
    Blocks are combined before the shuffle, so it carries about 1/factor^2 of the rows.
    """
    f = factor if isinstance(factor, Column) else F.lit(factor)
    px = px.withColumn("__f", F.greatest(F.lit(1), F.floor(f.cast("double")).cast("int")))
    step, width, one = F.col("__f"), F.col("width"), F.lit(1)
    w, h = (F.greatest(one, int_div(F.col(side), step)) for side in ("width", "height"))
    # a block line is a run of samples from the start of a row; only in an image narrower than its
    # box does it run on into the next rows, so that a pixel serves several of them
    flat = F.col("y").cast("bigint") * width + F.col("x")
    lowest = F.greatest(F.lit(0), F.ceil((flat - step + 1) / width).cast("int"))
    serves = F.when(width < step, F.sequence(lowest, F.col("y"))).otherwise(F.array("y"))
    whole = px.withColumns({"__flat": flat, "__row": F.explode(serves)}).withColumn(
        "__at", (F.col("__flat") - F.col("__row").cast("bigint") * width).cast("int")
    ).where((F.col("__at") < w * step) & (F.col("__row") < h * step))
    blocks = whole.groupBy(
        "image_id", w.alias("width"), h.alias("height"), int_div(F.col("__at"), step).alias("x"),
        int_div(F.col("__row"), step).alias("y"), "__f",
    ).agg(*[F.sum(c).alias(c) for c in "rgba"])
    area = (step * step).cast("double")
    return blocks.select(*PX[:5], *[byte_store(F.col(c) / area).alias(c) for c in "rgba"])


def undersized(images: DataFrame) -> DataFrame:
    """Images whose shorter side is below their factor."""
    return images.where(F.col("factor") > F.least("width", "height"))


def plane_sizes(px: DataFrame) -> DataFrame:
    """(image_id, width, height, n) of a pixel table; one row per image after partial counts."""
    return px.groupBy("image_id").agg(
        F.max("width").alias("width"), F.max("height").alias("height"),
        F.count(F.lit(1)).alias("n"),
    )


def comparable(ref_sizes: DataFrame, out_sizes: DataFrame) -> DataFrame:
    """(image_id, error) for pairs of size tables; error is null when they can be compared."""
    a = ref_sizes.select("image_id", *[F.col(c).alias(f"a_{c}") for c in ("width", "height", "n")])
    b = out_sizes.select("image_id", *[F.col(c).alias(f"b_{c}") for c in ("width", "height", "n")])
    size = lambda p: F.concat_ws("x", F.col(f"{p}_width").cast("string"), F.col(f"{p}_height").cast("string"))
    joined = a.join(b, "image_id", "full")
    want = F.col("a_width").cast("bigint") * F.col("a_height")
    error = (
        F.when(F.col("a_n").isNull() | F.col("b_n").isNull(), "one side has no pixels")
        .when(
            (F.col("a_width") != F.col("b_width")) | (F.col("a_height") != F.col("b_height")),
            F.concat(F.lit("sizes differ: "), size("a"), F.lit(" and "), size("b")),
        )
        .when(want <= 0, "image has no area")
        .when(F.least("a_n", "b_n") < want, "too few samples")
    )
    return joined.select("image_id", error.alias("error"))


def window_size(side: str) -> Column:
    return F.least(F.lit(WINDOW), F.col(side))


def ssim(ref_px: DataFrame, out_px: DataFrame) -> DataFrame:
    """P5: ``(image_id, ssim, error)``, mean SSIM over non-overlapping 8x8 luma windows.

    The two planes are stacked, not joined, and shuffled once by window. Pairing the pixels and
    summing a window both follow from that partitioning, so neither shuffles again; what moves
    afterwards is one partial sum per image and task. Windows are hashed over the cluster: one huge
    image spreads like many small ones.
    """
    return _judged(ref_px, out_px, _image_scores(_window_scores(ref_px, out_px)))


def _judged(ref_px: DataFrame, out_px: DataFrame, scored: DataFrame) -> DataFrame:
    sizes = comparable(plane_sizes(ref_px), plane_sizes(out_px))
    return sizes.join(scored, "image_id", "left").select(
        "image_id",
        F.when(F.col("error").isNull(), F.col("ssim")).alias("ssim"),
        F.coalesce("error", F.when(F.col("ssim").isNull(), "no pixel of one side meets the other")).alias("error"),
    )


def _plane(px: DataFrame, is_ref: bool) -> DataFrame:
    """Luma by window and place in the window; trailing partial windows are dropped."""
    ww, wh = window_size("width"), window_size("height")
    x, y = F.col("x"), F.col("y")
    return luma(px).select(
        "image_id", "width", "height", int_div(x, ww).alias("wx"), int_div(y, wh).alias("wy"),
        (y % wh * ww + x % ww).alias("at"), "l", F.lit(is_ref).alias("ref"),
    ).where(
        ((F.col("wx") + 1) * ww <= F.col("width")) & ((F.col("wy") + 1) * wh <= F.col("height"))
    ).drop("width", "height")


def _window_sums(ref_px: DataFrame, out_px: DataFrame) -> DataFrame:
    window = ["image_id", "wx", "wy"]
    both = _plane(ref_px, True).unionByName(_plane(out_px, False)).repartition(*window)
    pairs = both.groupBy(*window, "at").agg(
        F.max(F.when(F.col("ref"), F.col("l"))).alias("p"),
        F.max(F.when(~F.col("ref"), F.col("l"))).alias("q"),
    ).where(F.col("p").isNotNull() & F.col("q").isNotNull())
    p, q = F.col("p"), F.col("q")
    return pairs.groupBy(*window).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(p).alias("sp"), F.sum(q).alias("sq"),
        F.sum(p * p).alias("spp"), F.sum(q * q).alias("sqq"), F.sum(p * q).alias("spq"),
    )


def _window_scores(ref_px: DataFrame, out_px: DataFrame) -> DataFrame:
    w = _window_sums(ref_px, out_px)
    n = F.col("n")
    mp, mq = F.col("sp") / n, F.col("sq") / n
    vp = F.col("spp") / n - mp * mp
    vq = F.col("sqq") / n - mq * mq
    cov = F.col("spq") / n - mp * mq
    top = (dbl(2) * mp * mq + dbl(C1)) * (dbl(2) * cov + dbl(C2))
    bottom = (mp * mp + mq * mq + dbl(C1)) * (vp + vq + dbl(C2))
    return w.select(
        "image_id", F.when(bottom == 0, dbl(1)).otherwise(top / F.nullif(bottom, dbl(0))).alias("s")
    )


def _image_scores(windows: DataFrame) -> DataFrame:
    return windows.groupBy("image_id").agg(
        clamp(F.avg("s"), dbl(-1), dbl(1)).alias("ssim")
    )


def measure_ssim(
    ref_px: DataFrame, out_px: DataFrame, max_pixels: int = MAX_METRIC_PIXELS
) -> DataFrame:
    """P3 + P4 + P5: both sides reduced with one factor, then scored."""
    factor = metric_factor(F.col("width"), F.col("height"), max_pixels)
    small = box_downscale(ref_px, factor), box_downscale(out_px, factor)
    return _judged(ref_px, out_px, _image_scores(_window_scores(*small)))


def ssim_packed(pairs: DataFrame, max_pixels: int = MAX_METRIC_PIXELS) -> DataFrame:
    """P3 + P4 + P5 for rasters kept packed, ``(image_id, ssim, error)``.

    ``pairs`` holds (image_id, width, height, ref, out) with row-major RGBA bytes; the sizes are the
    reference's, and ``out`` must hold as many samples. A pair is scored where it lies, in Arrow
    batches and in bands of lines, so 4 bytes a pixel are read and nothing is shuffled.
    """
    kind = pairs.schema["image_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values, errors = batch.column("image_id"), [], []
            columns = [batch.column(c) for c in ("width", "height", "ref", "out")]
            for w, h, ref, out in zip(*columns, strict=True):
                value, error = _score_pair(w.as_py(), h.as_py(), ref, out, max_pixels)
                values.append(value)
                errors.append(error)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(values, pa.float64()), pa.array(errors, pa.string())],
                names=["image_id", "ssim", "error"],
            )

    packed = pairs.select(
        "image_id", F.col("width").cast("int"), F.col("height").cast("int"), "ref", "out"
    )
    return packed.mapInArrow(score, f"image_id {kind}, ssim double, error string")


def _score_pair(w: int, h: int, ref: pa.Scalar, out: pa.Scalar, max_pixels: int):
    if ref.as_buffer() is None or out.as_buffer() is None:
        return None, "one side has no pixels"
    if w is None or h is None:
        return None, "no size"
    if w <= 0 or h <= 0:
        return None, "image has no area"
    if min(ref.as_buffer().size, out.as_buffer().size) < w * h * 4:
        return None, "too few samples"
    planes = [np.frombuffer(s.as_buffer(), np.uint8, w * h * 4).reshape(h, w, 4) for s in (ref, out)]
    factor = 1
    if max_pixels > 0 and w * h > max_pixels:
        factor = max(1, int(np.ceil(np.sqrt(w * h / max_pixels))))
    width, height = max(1, w // factor), max(1, h // factor)
    if factor > min(w, h):
        planes = [_narrow(plane, width, height, factor) for plane in planes]
        factor = 1
    ww, wh = min(WINDOW, width), min(WINDOW, height)
    lines = max(1, _BAND // (width * wh)) * wh
    total, count = 0.0, 0
    for top in range(0, height // wh * wh, lines):
        rows = min(lines, height // wh * wh - top)
        p, q = (_band_luma(plane, top, rows, width, factor) for plane in planes)
        s = _band_scores(p, q, ww, wh)
        total, count = total + float(s.sum()), count + s.size
    return max(-1.0, min(1.0, total / count)), None


def _narrow(plane: np.ndarray, width: int, height: int, factor: int) -> np.ndarray:
    """Boxes of an image smaller than a box: runs of samples from each row, none beyond the end."""
    h, w, _ = plane.shape
    flat = plane.reshape(-1, 4).astype(np.int64)
    row, at = np.arange(height * factor)[:, None] * w, np.arange(width * factor)[None, :]
    index = row + at
    taken = np.where((index < w * h)[..., None], flat[np.minimum(index, w * h - 1)], 0)
    sums = taken.reshape(height, factor, width, factor, 4).sum((1, 3))
    return np.rint(sums / (factor * factor)).astype(np.uint8)


def _band_luma(plane: np.ndarray, top: int, rows: int, width: int, factor: int) -> np.ndarray:
    band = plane[top * factor : (top + rows) * factor, : width * factor]
    if factor > 1:
        blocks = band.reshape(rows, factor, width, factor, 4)
        band = np.rint(blocks.sum((1, 3), dtype=np.int64) / (factor * factor))
    band = band.astype(np.float64)
    tone = band[..., 0] * LUMA[0] + band[..., 1] * LUMA[1] + band[..., 2] * LUMA[2]
    alpha = band[..., 3] / 255.0
    return np.where(band[..., 3] == 255, tone, tone * alpha + 255.0 * (1.0 - alpha))


def _band_scores(p: np.ndarray, q: np.ndarray, ww: int, wh: int) -> np.ndarray:
    def mean(v: np.ndarray) -> np.ndarray:
        cut = v[:, : v.shape[1] // ww * ww]
        return cut.reshape(v.shape[0] // wh, wh, cut.shape[1] // ww, ww).mean((1, 3))

    mp, mq = mean(p), mean(q)
    vp, vq, cov = mean(p * p) - mp * mp, mean(q * q) - mq * mq, mean(p * q) - mp * mq
    return ((2 * mp * mq + C1) * (2 * cov + C2)) / ((mp * mp + mq * mq + C1) * (vp + vq + C2))


# ------------------------------------------------------------------------- P6-P7, P12 moving


def rotate(px: DataFrame, angle: Column | int) -> DataFrame:
    """Clockwise quarter turns; the sides swap on odd ones. A projection, no shuffle."""
    q = angle if isinstance(angle, Column) else F.lit(angle)
    x, y, w, h = F.col("x"), F.col("y"), F.col("width"), F.col("height")
    one = F.lit(1)
    new_x = F.when(q == 90, h - one - y).when(q == 180, w - one - x).when(q == 270, y).otherwise(x)
    new_y = F.when(q == 90, x).when(q == 180, h - one - y).when(q == 270, w - one - x).otherwise(y)
    swap = q.isin(90, 270)
    return px.withColumns(
        {
            "x": new_x, "y": new_y, "width": F.when(swap, h).otherwise(w),
            "height": F.when(swap, w).otherwise(h),
        }
    )


def _whole(value: Column) -> Column:
    return js_round(value).cast("int")


def crop(px: DataFrame, rects: DataFrame) -> DataFrame:
    """Crop to ``rects(image_id, rx, ry, rw, rh)``, rounded and kept inside; origin moves to 0.

    Images without a rectangle pass unchanged. The rectangle table is one small row per image and
    is joined as the optimizer sees fit.
    """
    placed = px.join(rects.select("image_id", "rx", "ry", "rw", "rh"), "image_id", "left")
    w, h = F.col("width"), F.col("height")
    zero, one = F.lit(0), F.lit(1)
    left = clamp(_whole(F.coalesce("rx", dbl(0))), zero, F.greatest(w - 1, zero))
    top = clamp(_whole(F.coalesce("ry", dbl(0))), zero, F.greatest(h - 1, zero))
    wide = clamp(_whole(F.coalesce(F.col("rw"), w.cast("double"))), one, F.greatest(one, w - left))
    high = clamp(_whole(F.coalesce(F.col("rh"), h.cast("double"))), one, F.greatest(one, h - top))
    x, y = F.col("x"), F.col("y")
    inside = (x >= left) & (x < left + wide) & (y >= top) & (y < top + high)
    return placed.where(inside).select(
        "image_id", wide.alias("width"), high.alias("height"), (x - left).alias("x"),
        (y - top).alias("y"), "r", "g", "b", "a",
    )


#: of an image the given size of its mask comes first, then the mask, then its own pixels
_SIZE, _MASK, _IMAGE = 0, 1, 2


def _pixel_runs(px: DataFrame, part: int) -> DataFrame:
    """Pixels of an image that come in one Arrow batch as one row, so that a shuffle carries few bytes a pixel.

    Levels that are bytes are packed (``data``), of a row all red ones first, then green, blue and alpha, as levels of one
    kind repeat more and so compress better. All others are kept as they are (``r`` to ``a``).
    """
    kinds = {c: px.schema[c].dataType.simpleString() for c in PX}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            image = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            sides = [batch.column(c).fill_null(-(2 ** 31)).to_numpy(zero_copy_only=False) for c in (1, 2)]
            keys = [image, *sides]
            order = np.lexsort(keys[::-1])
            rows = batch.take(pa.array(order))
            changes = np.any([np.diff(k[order]) != 0 for k in keys], axis=0)
            starts = np.concatenate([[0], np.flatnonzero(changes) + 1])
            ends = pa.array(np.append(starts, batch.num_rows).astype(np.int32))
            lists = lambda c: pa.ListArray.from_arrays(ends, rows.column(c))
            level = [rows.column(c) for c in "rgba"]
            if all(not v.null_count and pc.min(v).as_py() >= 0 and pc.max(v).as_py() < 256 for v in level):
                packed = np.empty(4 * batch.num_rows, np.uint8)
                for at, v in zip(_planes(np.diff(np.append(starts, batch.num_rows))), level):
                    packed[at] = v.to_numpy().astype(np.uint8)
                places = pa.py_buffer(np.append(starts, batch.num_rows).astype(np.int32) * np.int32(4))
                loose = [pa.nulls(len(starts), pa.list_(v.type)) for v in level]
                data = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, places, pa.py_buffer(packed)])
            else:
                data, loose = pa.nulls(len(starts), pa.binary()), [lists(c) for c in "rgba"]
            first = rows.select(PX[:3]).take(pa.array(starts))
            yield pa.RecordBatch.from_arrays(
                [*first.columns, pa.array(np.full(len(starts), part, np.int32)), lists("x"), lists("y"), data, *loose],
                [*PX[:3], "part", "x", "y", "data", *"rgba"])

    kind = ", ".join([*(f"{c} {kinds[c]}" for c in PX[:3]), "part int", *(f"{c} array<{kinds[c]}>" for c in "xy"), "data binary",
                      *(f"{c} array<{kinds[c]}>" for c in "rgba")])
    return px.select(*PX).mapInArrow(run, kind)


def _planes(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Of rows with so many pixels, where the bytes of each channel lie."""
    begin, size = np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(sizes, sizes)
    place = 3 * begin + np.arange(len(begin))
    for channel in range(4):
        yield place + channel * size


def _flat_runs(runs: pa.Table) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """For every pixel its run, and its columns."""
    size = pc.list_value_length(runs.column("x")).fill_null(0).to_numpy().astype(np.int64)
    found = {c: pa.concat_arrays(runs.column(c).chunks).flatten() for c in "xy"}
    flat = np.frombuffer(b"".join(b for b in runs.column("data").to_pylist() if b), np.uint8)
    packed = runs.column("data").is_valid().to_numpy()
    tight, dense = np.stack([flat[at] for at in _planes(size[packed])], axis=1), np.repeat(packed, size)
    for i, c in enumerate("rgba"):
        kind, loose = runs.column(c).type.value_type, pa.concat_arrays(runs.column(c).chunks).flatten()
        if len(loose):
            both = pa.concat_arrays([pa.array(tight[:, i]).cast(kind), loose])
            at = np.where(dense, np.cumsum(dense) - 1, len(tight) + np.cumsum(~dense) - 1)
            found[c] = both.take(pa.array(at))
        else:
            found[c] = pa.array(tight[:, i]).cast(kind)
    return np.repeat(np.arange(runs.num_rows), size), found


def _numbers(column: pa.ChunkedArray | pa.Array, unknown: int = -1) -> np.ndarray:
    return column.fill_null(unknown).to_numpy().astype(np.int64)


def _masked(runs: pa.Table, sized: bool) -> Iterator[pa.RecordBatch]:
    """The pixels of images whose masks, if they have any, are among the runs."""
    image = pa.concat_arrays(runs.column("image_id").chunks)
    code = image.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    part, wide, high = (_numbers(runs.column(c)) for c in ("part", "width", "height"))
    size, of_size = np.zeros((2, int(code.max()) + 1), np.int64), part == (_SIZE if sized else _MASK)
    for k, side in enumerate((wide, high)):
        np.maximum.at(size[k], code[of_size], side[of_size])
    masks, is_mask = None, np.flatnonzero(part == _MASK)
    if len(is_mask):
        of, mask = _flat_runs(runs.take(pa.array(is_mask)))
        at, x, y = code[is_mask[of]], _numbers(mask["x"]), _numbers(mask["y"])
        across, down = int(x.max(initial=0)) + 1, int(y.max(initial=0)) + 1
        kept = np.flatnonzero((x >= 0) & (y >= 0))
        places = ((at * down + y) * across + x)[kept]
        order = np.argsort(places, kind="stable")
        masks = places[order], mask["r"].take(pa.array(kept[order]))
    own = np.flatnonzero(part == _IMAGE)
    lengths = pc.list_value_length(runs.column("x")).fill_null(0).to_numpy().astype(np.int64)
    for some in _runs(own, lengths[own], _BAND):
        of, px = _flat_runs(runs.take(pa.array(some)))
        of, alpha, rows = some[of], px["a"], np.arange(len(of))
        if masks is not None:
            x, y = (px[c].cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for c in "xy")
            with np.errstate(all="ignore"):
                sx = np.floor(x * size[0][code[of]].astype(float) / np.where(wide[of] > 0, wide[of], np.nan))
                sy = np.floor(y * size[1][code[of]].astype(float) / np.where(high[of] > 0, high[of], np.nan))
            usable = (sx >= 0) & (sx < across) & (sy >= 0) & (sy < down) & (size[0] > 0)[code[of]]
            place = np.where(usable, (code[of] * down + np.where(usable, sy, 0).astype(np.int64)) * across + np.where(usable, sx, 0).astype(np.int64), -1)
            lo, hi = (np.searchsorted(masks[0], place, side) for side in ("left", "right"))
            # a place that a mask holds twice gives two rows
            times = np.maximum(hi - lo, 1)
            rows = np.repeat(rows, times)
            nth = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
            met = pa.array(np.where((hi > lo)[rows], lo[rows] + nth, -1))
            level = masks[1].take(pc.if_else(pc.greater_equal(met, 0), met, None))
            kind = max(level.type, alpha.type, key=lambda t: t.bit_width)
            alpha = pc.coalesce(level.cast(kind), alpha.take(pa.array(rows)).cast(kind))
        pick, take = pa.array(of[rows]), pa.array(rows)
        fixed = [pa.concat_arrays(runs.column(c).chunks).take(pick) for c in PX[:3]]
        yield pa.RecordBatch.from_arrays([*fixed, *(px[c].take(take) for c in ("x", "y", "r", "g", "b")), alpha], names=PX)


def apply_soft_mask(px: DataFrame, mask_px: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """The gray level of the mask becomes alpha, by nearest mapping.

    ``mask_px`` is a gray pixel table; ``masks(image_id, mask_width, mask_height)`` gives the mask
    sizes (taken from ``mask_px`` when absent). Without a usable mask alpha stays.

    Pixels are shuffled once, packed: those of an image follow its mask in one sorted stream, in which a
    task holds one mask and one Arrow batch. No pixel is joined.
    """
    both = _pixel_runs(mask_px, _MASK).unionByName(_pixel_runs(px, _IMAGE))
    if masks is not None:
        given = masks.select("image_id", F.col("mask_width").alias("width"), F.col("mask_height").alias("height"), F.lit(_SIZE).alias("part"))
        both = given.unionByName(both, allowMissingColumns=True)
    stream = both.repartition("image_id").sortWithinPartitions("image_id", "part")
    sized = masks is not None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the mask of the last image, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pa.Table.from_batches([batch])
            runs = runs if held is None else pa.concat_tables([held, runs])
            yield from _masked(runs, sized)
            last = runs.column("image_id")[-1]
            same = runs.column("image_id").is_null() if not last.is_valid else pc.equal(runs.column("image_id"), last)
            held = runs.filter(pc.and_(pc.fill_null(same, False), pc.less(runs.column("part"), _IMAGE)))

    kinds = {c: px.schema[c].dataType for c in PX[:8]}
    level = px.select("a").crossJoin(mask_px.select("r")).select(F.coalesce("r", "a").alias("a")).schema["a"].dataType
    made = {c: stream.schema[c].dataType for c in PX[:3]} | {c: stream.schema[c].dataType.elementType for c in PX[3:8]} | {"a": level}
    out = stream.mapInArrow(work, ", ".join(f"{c} {t.simpleString()}" for c, t in made.items()))
    return out.select(*(F.col(c).cast(t).alias(c) for c, t in kinds.items()), "a")


# ------------------------------------------------------------------------ P8-P9 size planning


def _clamp_rect(x: Column, y: Column, w: Column, h: Column, bw: Column, bh: Column) -> list[Column]:
    one, least_side, zero = (F.lit(n).cast("bigint") for n in (1, MIN_CROP, 0))
    bw, bh = F.greatest(one, js_round(bw)), F.greatest(one, js_round(bh))
    w = clamp(js_round(w), F.least(least_side, bw), bw)
    h = clamp(js_round(h), F.least(least_side, bh), bh)
    return [clamp(js_round(x), zero, bw - w), clamp(js_round(y), zero, bh - h), w, h]


def crop_plan(images: DataFrame, ratio: float | None = None, move: tuple[float, float] = (0, 0)) -> DataFrame:
    """Crop rectangles ``(image_id, x, y, crop_width, crop_height)``.

    ``images`` holds (image_id, width, height) and optional (rx, ry, rw, rh); null means the whole
    image. The rectangle is refitted to ``ratio`` around its centre, clamped inside with a least
    side of 8, then moved.
    """
    bw, bh = F.col("width").cast("double"), F.col("height").cast("double")
    have = set(images.columns)
    given = lambda c, default: F.coalesce(F.col(c).cast("double"), default) if c in have else default
    x, y = given("rx", dbl(0)), given("ry", dbl(0))
    w, h = given("rw", bw), given("rh", bh)
    if ratio is not None:
        r = dbl(ratio)
        cx, cy = x + w / dbl(2), y + h / dbl(2)
        too_high = bw / r > bh
        max_w = F.when(too_high, bh * r).otherwise(bw)
        new_w = F.least(max_w, F.greatest(w, h * r))
        new_h = new_w / r
        x, y, w, h = cx - new_w / dbl(2), cy - new_h / dbl(2), new_w, new_h
    cx, cy, cw, ch = _clamp_rect(x, y, w, h, bw, bh)
    rects = images.select("image_id", "width", "height", cx.alias("x"), cy.alias("y"),
                          cw.alias("crop_width"), ch.alias("crop_height"))
    if move != (0, 0):
        def shifted(at: str, by: float, bound: str, side: str) -> Column:
            room = F.greatest(dbl(0), F.col(bound).cast("double") - F.col(side).cast("double"))
            return clamp(F.col(at).cast("double") + dbl(by), dbl(0), room)

        rects = rects.withColumns(
            {
                "x": shifted("x", move[0], "width", "crop_width"),
                "y": shifted("y", move[1], "height", "crop_height"),
            }
        )
    return rects.drop("width", "height")


def source_box(width: Column, height: Column, out_w: Column, out_h: Column, fit: Column) -> dict[str, Column]:
    """The source region a fit samples: all of it, or the largest centred part of the aspect."""
    w, h = width.cast("double"), height.cast("double")
    ow, oh = out_w.cast("double"), out_h.cast("double")
    contain = fit == "contain"
    aspect = ow / oh
    wider = w / h > aspect
    sw = F.when(contain & wider, h * aspect).otherwise(w)
    sh = F.when(contain & ~wider, w / aspect).otherwise(h)
    return {"sx": (w - sw) / dbl(2), "sy": (h - sh) / dbl(2), "sw": sw, "sh": sh}


def fit_boxes(targets: DataFrame, thumb_edge: int = THUMB_EDGE, max_scale: float = 4.0) -> DataFrame:
    """``+sx, +sy, +sw, +sh, +height_for_width, +width_for_height, +thumb_w, +thumb_h, +scale``.

    ``targets`` holds (width, height, out_w, out_h, fit). ``scale`` fits the source as a page into
    the (out_w, out_h) box, within [0.01, max_scale].
    """
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    ow, oh = F.col("out_w").cast("double"), F.col("out_h").cast("double")
    one = F.lit(1).cast("bigint")
    at_least = lambda v: F.greatest(one, js_round(v))
    empty = (F.col("width") <= 0) | (F.col("height") <= 0)
    shrink = F.least(dbl(1), dbl(thumb_edge) / F.greatest(w, h))
    scale = F.when(empty | (ow <= 0) | (oh <= 0), dbl(MIN_SCALE)).otherwise(
        F.greatest(dbl(MIN_SCALE), F.least(F.least(ow / w, oh / h), dbl(max_scale)))
    )
    box = source_box(F.col("width"), F.col("height"), F.col("out_w"), F.col("out_h"), F.col("fit"))
    return targets.withColumns(
        {
            **box,
            "height_for_width": F.when(w <= 0, one).otherwise(at_least(ow * h / w)),
            "width_for_height": F.when(h <= 0, one).otherwise(at_least(oh * w / h)),
            "thumb_w": F.when(empty, one).otherwise(at_least(w * shrink)),
            "thumb_h": F.when(empty, one).otherwise(at_least(h * shrink)),
            "scale": scale,
        }
    )
