"""Resampling of pixel tables.

Nearest neighbour *scatters*: every source pixel is sent to the destination pixels it serves, a short
range known from the sizes alone. For the kernels pixels are packed by image and Arrow batch before they are
shuffled, once; target sizes are joined with one row an image, which leads its pixels in the sorted stream. Small
images are resampled there along both axes with banded weights, and those that stay as they are pass. The lines of
larger ones go to the strips of destination lines they contribute to. No pixel is joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlane.functions.numbers import clamp, dbl, js_round
from assetlane.operators.packed import RADIUS, along, axis_bands, to_bytes, tones
from assetlane.operators.pixels import _BAND, PX, _flat_runs, _numbers, _pixel_runs, _runs, source_box
from assetlane.session import hand_over
from assetlane.session import spread as shuffled


def _targets(px: DataFrame, targets: DataFrame) -> DataFrame:
    """Attach ``out_w, out_h, fit``; images without a target keep their size."""
    t = targets.select(
        "image_id", F.col("out_w").alias("__ow"), F.col("out_h").alias("__oh"), F.col("fit").alias("__fit")
    )
    rows = px.join(t, "image_id", "left").withColumns(
        {
            "__ow": F.greatest(F.lit(1), F.coalesce(F.col("__ow").cast("int"), F.col("width"))),
            "__oh": F.greatest(F.lit(1), F.coalesce(F.col("__oh").cast("int"), F.col("height"))),
            "__fit": F.coalesce("__fit", F.lit("stretch")),
        }
    )
    box = source_box(F.col("width"), F.col("height"), F.col("__ow"), F.col("__oh"), F.col("__fit"))
    return rows.withColumns({f"__{k}": v for k, v in box.items()})


def _range(low: Column, high: Column, size: Column) -> Column:
    """Candidate destination indexes, a little wide; an empty range gives no rows."""
    lo = F.greatest(F.lit(0), F.floor(low).cast("int"))
    hi = F.least(size - F.lit(1), F.ceil(high).cast("int"))
    return F.when(lo <= hi, F.sequence(lo, hi))


def resize_nearest(px: DataFrame, targets: DataFrame) -> DataFrame:
    """P10: nearest neighbour at destination pixel centres; ``targets(image_id, out_w, out_h, fit)``."""
    rows = _targets(px, targets)

    def spread(df: DataFrame, at: str, start: str, span: str, out: str, side: str, name: str) -> DataFrame:
        scale = F.col(span) / F.col(out).cast("double")
        edge = F.col(at).cast("double") - F.col(start)
        candidates = _range(edge / scale - dbl(1.5), (edge + dbl(1)) / scale + dbl(0.5), F.col(out))
        # pixels at the rim also serve centres that fall just outside
        df = df.withColumn(name, F.explode(candidates))
        centre = F.col(start) + (F.col(name).cast("double") + dbl(0.5)) * scale
        source = clamp(F.floor(centre).cast("int"), F.lit(0), F.col(side) - F.lit(1))
        return df.where(source == F.col(at))

    rows = spread(rows, "x", "__sx", "__sw", "__ow", "width", "__dx")
    rows = spread(rows, "y", "__sy", "__sh", "__oh", "height", "__dy")
    return rows.select(
        "image_id", F.col("__ow").alias("width"), F.col("__oh").alias("height"),
        F.col("__dx").alias("x"), F.col("__dy").alias("y"), "r", "g", "b", "a",
    )


#: source and destination pixels that a strip should not exceed
STRIP_PIXELS = 1 << 18


#: how the pixels of an image are met: passed, resampled together, or strip by strip
PASSED, TOGETHER, STRIPS = range(3)
_BOX = ["__sx", "__sy", "__sw", "__sh", "__ow", "__oh"]


def _sized(px: DataFrame, targets: DataFrame) -> DataFrame:
    """One row an image: its box, cut to whole pixels, its target size and how it is met (``how``)."""
    one = F.lit(1).cast("bigint")
    rows = _targets(px.select(*PX[:3]).distinct(), shuffled(targets))
    box = {k: js_round(F.col(k)) for k in ("__sx", "__sy")} | {k: F.greatest(one, js_round(F.col(k))) for k in ("__sw", "__sh")}
    rows = rows.withColumns({k: v.cast("int") for k, v in box.items()})
    long = lambda c: F.col(c).cast("bigint")
    same = (F.col("__ow") == F.col("width")) & (F.col("__oh") == F.col("height"))
    few = (F.greatest(long("__sw"), long("__ow")) * F.greatest(long("__sh"), long("__oh")) <= STRIP_PIXELS) & (
        long("width") * long("height") <= 4 * STRIP_PIXELS)
    how = F.when(same, PASSED).when(~same & few, TOGETHER).when(~same, STRIPS)
    return rows.select(*PX[:3], *_BOX, how.alias("how"))


def _strips(lines: DataFrame, method: str) -> DataFrame:
    """Lines beside the strips of destination lines they contribute to."""
    one = F.lit(1).cast("bigint")
    rows = lines.where("y >= __sy AND y < __sy + __sh")
    scale = F.col("__sh") / F.col("__oh").cast("double")
    reach = F.greatest(scale, dbl(1)) * dbl(RADIUS[method])
    middle = F.col("y").cast("double") + dbl(0.5) - F.col("__sy").cast("double")
    # outermost centres may lie up to one radius beyond the rim pixel
    targets = _range((middle - reach) / scale - dbl(1.5), (middle + reach) / scale + dbl(0.5), F.col("__oh"))
    each = F.greatest(F.col("__ow").cast("bigint"), F.ceil(F.col("__sw") * scale))
    tall = F.greatest(one, F.floor(F.lit(STRIP_PIXELS) / each)).cast("int")
    rows = rows.withColumn("__tall", tall).withColumn("__at", targets).where("__at IS NOT NULL")
    first, last = (F.floor(F.element_at("__at", i) / F.col("__tall")).cast("int") for i in (1, -1))
    return rows.withColumn("__strip", F.explode(F.sequence(first, last))).drop("__at")


def _whole_lines(lines: pa.Table) -> tuple[np.ndarray, pa.ListArray]:
    """Each line once, its parts put together."""
    y = lines.column("y").to_numpy()
    order = np.argsort(y, kind="stable")
    line = lines.column("line").combine_chunks().take(pa.array(order))
    ys, begin = np.unique(y[order], return_index=True)
    ends = np.concatenate([[0], np.cumsum(line.value_lengths().to_numpy(zero_copy_only=False))])
    return ys, pa.ListArray.from_arrays(pa.array(ends[np.append(begin, len(y))].astype(np.int32)), line.flatten())


def resample_strip(lines: pa.Table, method: str, premultiply: bool, linear: bool) -> pa.Table:
    """The destination pixels of one strip; those that no source pixel reaches are absent."""
    p = {c: lines.column(c)[0].as_py() for c in ("__sx", "__sy", "__sw", "__sh", "__ow", "__oh", "__tall", "__strip")}
    sw, ow = p["__sw"], p["__ow"]
    lo, hi = p["__strip"] * p["__tall"], min(p["__oh"], (p["__strip"] + 1) * p["__tall"])
    x_taps, x_weight = axis_bands(method, sw, ow)
    y_taps, y_weight = (v[lo:hi] for v in axis_bands(method, p["__sh"], p["__oh"]))
    first = int(y_taps.min())
    across = np.zeros((int(y_taps.max()) + 1 - first, ow, 4))
    there = np.zeros((*across.shape[:2], 1))
    tone = tones(linear)
    step = max(1, STRIP_PIXELS // sw)
    ys, parts = _whole_lines(lines)
    ys = ys - p["__sy"] - first
    for a in range(0, len(ys), step):
        line = parts.slice(a, step)
        n = line.value_lengths().to_numpy(zero_copy_only=False)
        x, c = (v.to_numpy(zero_copy_only=False).astype(np.int64) for v in line.flatten().flatten())
        x -= p["__sx"]
        inside = (x >= 0) & (x < sw)
        at, c = (np.repeat(np.arange(len(n)), n) * sw + x)[inside], c[inside]
        alpha = (c >> 24) / 255
        light = [tone[(c >> s) & 255] * (alpha if premultiply else 1) for s in (0, 8, 16)] + [alpha]
        # a pixel that is there twice counts twice
        count = np.bincount(at, minlength=len(n) * sw).reshape(len(n), sw, 1).astype(float)
        value = np.stack([np.bincount(at, v, len(n) * sw).reshape(len(n), sw) for v in light], axis=2)
        weight = along(count, x_taps, x_weight, 1)
        some = weight != 0
        y = ys[a:a + step]
        kept = (y >= 0) & (y < len(across))
        across[y[kept]] = np.divide(along(value, x_taps, x_weight, 1), weight, where=some, out=np.zeros((len(n), ow, 4)))[kept]
        there[y[kept]] = some[kept]
    weight = along(there, y_taps - first, y_weight, 0)
    value = np.divide(along(across, y_taps - first, y_weight, 0), weight, where=weight != 0, out=np.zeros((hi - lo, ow, 4)))
    row, col = np.nonzero(weight[..., 0])
    rgba = to_bytes(value, premultiply, linear)[row, col].astype(np.int32)
    fixed = [pa.array(np.full(len(row), v, np.int32)) for v in (ow, p["__oh"])]
    image = pa.concat_arrays([pa.nulls(0, lines.column("image_id").type), *lines.column("image_id").slice(0, 1).chunks])
    return pa.table([image.take(pa.array(np.zeros(len(row), np.int64))), *fixed, pa.array(col.astype(np.int32)),
                     pa.array((row + lo).astype(np.int32)), *(pa.array(rgba[:, i]) for i in range(4))], names=PX)


def _bands(method: str, spans: np.ndarray, outs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bands of many (span, out) below each other, padded with weight 0: where each begins, taps, weights, tap counts."""
    pairs, which = np.unique(np.stack([spans, outs], axis=1), axis=0, return_inverse=True)
    found = [axis_bands(method, int(span), int(out)) for span, out in pairs]
    most = max(t.shape[1] for t, _ in found)
    taps, weight = (np.concatenate([np.pad(b[i], ((0, 0), (0, most - b[i].shape[1]))) for b in found]) for i in (0, 1))
    begin = np.concatenate([[0], np.cumsum([len(t) for t, _ in found])[:-1]])
    count = np.repeat([t.shape[1] for t, _ in found], [len(t) for t, _ in found])
    return begin[which.reshape(-1)], taps, weight, count


def _gathered(source: np.ndarray, at: np.ndarray, stride: np.ndarray, row: np.ndarray, taps: np.ndarray, weight: np.ndarray,
              count: np.ndarray) -> np.ndarray:
    """For every target the weighted sum of ``source`` rows ``at + tap * stride``, one tap at a time."""
    total, reach = np.zeros((len(at), source.shape[1])), count[row]
    for k in range(taps.shape[1]):
        some = np.flatnonzero(reach > k)
        here = row[some]
        total[some] += weight[here, k, None] * source[at[some] + taps[here, k] * stride[some]]
    return total


def _places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of these sizes one after the other: where each begins, and for every member its run and its place there."""
    begin = np.cumsum(sizes) - sizes
    run = np.repeat(np.arange(len(sizes)), sizes)
    return begin, run, np.arange(len(run)) - begin[run]


def resample_strips(lines: pa.Table, starts: np.ndarray, method: str, premultiply: bool, linear: bool) -> pa.Table:
    """``resample_strip`` for many small strips at once; strip ``i`` begins with line ``starts[i]``."""
    p = {c: lines.column(c).to_numpy()[starts].astype(np.int64) for c in (*_BOX, "__tall", "__strip")}
    of_line = np.searchsorted(starts, np.arange(lines.num_rows), side="right") - 1
    line = lines.column("line").combine_chunks()
    n = line.value_lengths().to_numpy(zero_copy_only=False)
    x, c = (v.to_numpy(zero_copy_only=False).astype(np.int64) for v in line.flatten().flatten())
    of, row, col, rgba = _resampled_pixels(p, np.repeat(of_line, n), x, np.repeat(lines.column("y").to_numpy(), n), c, method, premultiply, linear)
    image = lines.column("image_id").combine_chunks().take(pa.array(starts[of]))
    whole = lambda v: pa.array(v.astype(np.int32))
    return pa.table([image, whole(p["__ow"][of]), whole(p["__oh"][of]), whole(col), whole(row), *(pa.array(rgba[:, i]) for i in range(4))], names=PX)


def _resampled_pixels(p: dict[str, np.ndarray], of: np.ndarray, x: np.ndarray, y: np.ndarray, c: np.ndarray, method: str,
                      premultiply: bool, linear: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The destination pixels of many strips (``p``) from pixels ``(x, y, c)`` of strip ``of``: strip, line, column and bytes."""
    sw, ow = p["__sw"], p["__ow"]
    lo = p["__strip"] * p["__tall"]
    high = np.minimum(p["__oh"], lo + p["__tall"]) - lo
    x_begin, x_taps, x_weight, x_count = _bands(method, sw, ow)
    y_begin, y_taps, y_weight, y_count = _bands(method, p["__sh"], p["__oh"])
    # taps never fall from one target to the next
    least, most = y_taps[y_begin + lo, 0], y_taps[y_begin + lo + high - 1, y_count[y_begin + lo] - 1]
    tall = most + 1 - least

    x, y = x - p["__sx"][of], y - (p["__sy"] + least)[of]
    inside = (x >= 0) & (x < sw[of]) & (y >= 0) & (y < tall[of])
    begin, _, _ = _places(tall * sw)
    at, c = (begin[of] + y * sw[of] + x)[inside], c[inside]
    alpha, tone, size = (c >> 24) / 255, tones(linear), int((tall * sw).sum())
    light = [tone[(c >> s) & 255] * (alpha if premultiply else 1) for s in (0, 8, 16)] + [alpha]
    # a pixel that is there twice counts twice
    source = np.stack([np.bincount(at, v, size) for v in light] + [np.bincount(at, minlength=size)], axis=1)

    across_begin, of, place = _places(tall * ow)
    total = _gathered(source, begin[of] + place // ow[of] * sw[of], np.ones_like(of), x_begin[of] + place % ow[of], x_taps, x_weight, x_count)
    some = total[:, 4:] != 0
    across = np.concatenate([np.divide(total[:, :4], total[:, 4:], where=some, out=np.zeros((len(total), 4))), some], axis=1)

    _, of, place = _places(high * ow)
    row, col = place // ow[of], place % ow[of]
    total = _gathered(across, (across_begin - least * ow)[of] + col, ow[of], (y_begin + lo)[of] + row, y_taps, y_weight, y_count)
    met = total[:, 4] != 0
    of, row, col, total = of[met], row[met], col[met], total[met]
    return of, row + lo[of], col, to_bytes(total[:, :4] / total[:, 4:], premultiply, linear).astype(np.int32)


def _strip_starts(lines: pa.Table) -> np.ndarray:
    """Where strips begin in lines that are sorted by image and strip."""
    image = lines.column("image_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    strip = lines.column("__strip").to_numpy()
    return np.flatnonzero(np.concatenate([[True], (image[1:] != image[:-1]) | (strip[1:] != strip[:-1])]))


def _resampled(lines: pa.Table, starts: np.ndarray, method: str, premultiply: bool, linear: bool) -> Iterator[pa.Table]:
    """Whole strips: small ones together, up to about ``STRIP_PIXELS``, larger ones alone."""
    ends = np.append(starts[1:], lines.num_rows)
    wide, out = (lines.column(c).to_numpy().astype(np.int64)[starts] for c in ("__sw", "__ow"))
    tall = np.minimum(lines.column("__tall").to_numpy(), lines.column("__oh").to_numpy()).astype(np.int64)[starts]
    # about the largest grid of a strip: source lines across, source lines resampled, destination lines
    cost = np.maximum(wide, out) * np.maximum(ends - starts, tall)
    lo = 0
    while lo < len(starts):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(cost[lo:]), STRIP_PIXELS, side="right")))
        part = lines.slice(starts[lo], ends[hi - 1] - starts[lo])
        if hi == lo + 1 and cost[lo] > STRIP_PIXELS:
            yield resample_strip(part, method, premultiply, linear)
        else:
            yield resample_strips(part, starts[lo:hi] - starts[lo], method, premultiply, linear)
        lo = hi


def _image_starts(rows: pa.Table) -> np.ndarray:
    """Where images begin in a stream that is sorted by image and size."""
    image = rows.column("image_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    keys = [image, *(_numbers(rows.column(c)) for c in ("width", "height"))]
    return np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))


def _colours(px: dict[str, pa.Array]) -> np.ndarray:
    return sum(_numbers(px[c]) << s for c, s in zip("rgba", (0, 8, 16, 24)))


def _as_pixels(rows: pa.Table, at: np.ndarray, width, height, levels: list) -> pa.RecordBatch:
    """Pixel rows of the images at rows ``at``, in the types that pixels have in the stream."""
    kinds = [rows.schema.field(c).type if c in PX[:3] else rows.schema.field(c).type.value_type for c in PX]
    image = rows.column("image_id").combine_chunks().take(pa.array(at))
    found = [image, *((v if isinstance(v, pa.Array) else pa.array(v)).cast(t) for v, t in zip((width, height, *levels), kinds[1:]))]
    return pa.RecordBatch.from_arrays(found, names=PX)


def _passed(rows: pa.Table, at: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pixels of the packed rows ``at`` as they are."""
    for some in _runs(at, sizes[at], _BAND):
        of, px = _flat_runs(rows.take(pa.array(some)))
        side = lambda c: rows.column(c).combine_chunks().take(pa.array(some[of]))
        yield _as_pixels(rows, some[of], side("width"), side("height"), [px[c] for c in PX[3:]])


def _resampled_images(rows: pa.Table, starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray, work: tuple) -> Iterator[pa.RecordBatch]:
    """Whole small images, each beginning with its box, together up to about ``STRIP_PIXELS``."""
    p = {c: _numbers(rows.column(c))[starts] for c in _BOX}
    p |= {"__tall": p["__oh"], "__strip": np.zeros(len(starts), np.int64)}
    total = np.concatenate([[0], np.cumsum(sizes)])
    cost = np.maximum(np.maximum(p["__sw"], p["__ow"]) * np.maximum(p["__sh"], p["__oh"]), total[ends] - total[starts])
    for some in _runs(np.arange(len(starts)), cost, STRIP_PIXELS):
        at = np.concatenate([np.arange(starts[i] + 1, ends[i]) for i in some])
        run, px = _flat_runs(rows.take(pa.array(at)))
        image = np.repeat(np.arange(len(some)), ends[some] - starts[some] - 1)[run]
        some_p = {c: v[some] for c, v in p.items()}
        of, row, col, rgba = _resampled_pixels(some_p, image, _numbers(px["x"]), _numbers(px["y"]), _colours(px), *work)
        yield _as_pixels(rows, starts[some][of], some_p["__ow"][of], some_p["__oh"][of], [col, row, *rgba.T])


def _lines_of(rows: pa.Table, at: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The packed rows ``at`` as parts of lines, each beside the box of its image, which is row ``first``."""
    for some in _runs(at, sizes[at], _BAND):
        run, px = _flat_runs(rows.take(pa.array(some)))
        x, y = _numbers(px["x"]), _numbers(px["y"])
        order = np.lexsort([y, run])
        begin = np.flatnonzero(np.concatenate([[True], (np.diff(run[order]) != 0) | (np.diff(y[order]) != 0)]))
        line = pa.ListArray.from_arrays(pa.array(np.append(begin, len(order)).astype(np.int32)), pa.StructArray.from_arrays(
            [pa.array(x[order].astype(np.int32)), pa.array(_colours(px)[order])], ["x", "c"]))
        of = pa.array(first[some][run[order[begin]]])
        box = rows.select(["image_id", *_BOX]).take(of).combine_chunks()
        yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in box.columns), pa.array(y[order[begin]].astype(np.int32)), line],
                                         ["image_id", *_BOX, "y", "line"])


def _met(rows: pa.Table, work: tuple, strips: bool, whole: bool) -> tuple[pa.Table, Iterator[pa.RecordBatch]]:
    """What must be held of the last image, unless all are ``whole``, and the work on the others."""
    rows = rows.combine_chunks()
    starts = _image_starts(rows)
    ends, how = np.append(starts[1:], rows.num_rows), _numbers(rows.column("how"))[starts]
    sizes = pc.fill_null(pc.list_value_length(rows.column("x")), 0).to_numpy().astype(np.int64)
    held = rows.slice(0, 0)
    if not whole:
        # of an image whose pixels are met as they come the box is enough
        held = rows.slice(starts[-1]) if how[-1] == TOGETHER else rows.slice(starts[-1], 1)
    ready = np.ones(len(starts), bool)
    ready[-1] = whole or how[-1] != TOGETHER
    first = np.repeat(starts, ends - starts)
    pixels = np.repeat(how, ends - starts)
    pixels[starts] = -1

    def run() -> Iterator[pa.RecordBatch]:
        if strips:
            yield from _lines_of(rows, np.flatnonzero(pixels == STRIPS), first, sizes)
            return
        yield from _passed(rows, np.flatnonzero(pixels == PASSED), sizes)
        some = np.flatnonzero((how == TOGETHER) & ready & (ends - starts > 1))
        if len(some):
            yield from _resampled_images(rows, starts[some], ends[some], sizes, work)

    return held, run()


def _streamed(stream: DataFrame, work: tuple, strips: bool, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            if rows.num_rows:
                held, done = _met(rows, work, strips, False)
                yield from done
        if held is not None and held.num_rows:
            yield from _met(held, work, strips, True)[1]

    return stream.mapInArrow(run, schema)


def resize_kernel(
    px: DataFrame, targets: DataFrame, method: str = "lanczos3", premultiply: bool = True,
    linear_rgb: bool = True,
) -> DataFrame:
    """Separable resample with triangle, catrom, mitchell or lanczos3.

    An image without a target, or already of its size, passes unchanged.
    Weights are normalised over the source pixels that exist, so edges neither darken nor fade.
    The horizontal pass goes first. A task holds one Arrow batch and a small image; of larger ones a strip: the source lines
    that some destination lines reach, of ``STRIP_PIXELS`` if one destination line does not reach more.
    """
    if method not in RADIUS:
        raise ValueError(f"unknown method {method!r}")
    work = (method, premultiply, linear_rgb)
    kinds = {c: px.schema[c].dataType.simpleString() for c in PX}
    sized = hand_over(_sized(px, targets), "image-sizes")
    stream = sized.withColumn("part", F.lit(0)).unionByName(_pixel_runs(px, 1), allowMissingColumns=True)
    # packed rows are few bytes for their pixels, by which Spark would leave them to few tasks
    parts = int(px.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = stream.repartition(parts, "image_id").sortWithinPartitions("image_id", "width", "height", "part")
    found = _streamed(stream, work, False, ", ".join(f"{c} {t}" for c, t in kinds.items()))
    if sized.where(F.col("how") == STRIPS).isEmpty():
        return found
    lines = _streamed(stream, work, True, f"image_id {kinds['image_id']}, {', '.join(f'{c} int' for c in _BOX)}, "
                      "y int, line array<struct<x: int, c: bigint>>")
    return found.unionByName(_resized_strips(lines, work).select(*[F.col(c).cast(t) for c, t in kinds.items()]))


def _resized_strips(lines: DataFrame, work: tuple) -> DataFrame:
    """Pixels of images that are resampled strip by strip."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # lines of a strip that may go on in the next batch
        for batch in batches:
            lines = pa.Table.from_batches([batch])
            lines = lines if held is None else pa.concat_tables([held, lines])
            if lines.num_rows:
                starts = _strip_starts(lines)
                held, lines, starts = lines.slice(starts[-1]), lines.slice(0, starts[-1]), starts[:-1]
                for done in _resampled(lines, starts, *work) if len(starts) else ():
                    yield from done.combine_chunks().to_batches()
        if held is not None and held.num_rows:
            for done in _resampled(held, np.zeros(1, np.int64), *work):
                yield from done.combine_chunks().to_batches()

    kind = lines.schema["image_id"].dataType.simpleString()
    rows = _strips(lines, work[0]).select("image_id", "y", "line", *_BOX, "__tall", "__strip")
    dealt = rows.repartition("image_id", "__strip").sortWithinPartitions("image_id", "__strip")
    return dealt.mapInArrow(run, f"image_id {kind}, width int, height int, x int, y int, r int, g int, b int, a int")


def resize(
    px: DataFrame, targets: DataFrame, method: str, premultiply: bool = True, linear_rgb: bool = True
) -> DataFrame:
    """Resize by method name, ``browser-pixelated`` being nearest neighbour."""
    if method == "browser-pixelated":
        return resize_nearest(px, targets)
    return resize_kernel(px, targets, method, premultiply, linear_rgb)
