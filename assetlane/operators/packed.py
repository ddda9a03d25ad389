"""Geometry and resampling of packed rasters (P6, P7, P10, P11), one RGBA byte array an image.

The same results as the pixel-table forms, without a row a pixel: images are worked on where they
lie, in Arrow batches and in bands of lines, so nothing is shuffled but the one-row-per-image
parameters that are joined to them. An image whose samples do not fill it passes with null data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kernel radius in source pixels at scale 1.
RADIUS = {"triangle": 1.0, "catrom": 2.0, "mitchell": 2.0, "lanczos3": 3.0}
# Fixed values: (B, C) of the two cubic kernels.
CUBIC = {"catrom": (0.0, 0.5), "mitchell": (1 / 3, 1 / 3)}
_BAND = 1 << 18


def _rasters(batch: pa.RecordBatch) -> list[np.ndarray | None]:
    """The rasters of a batch, height x width x 4, null where the samples do not fill one."""
    found = []
    for w, h, body in zip(batch.column("width").to_pylist(), batch.column("height").to_pylist(), batch.column("data")):
        data = body.as_buffer()
        there = w and h and w > 0 and h > 0 and data is not None and data.size >= 4 * w * h
        found.append(np.frombuffer(data, np.uint8, 4 * w * h).reshape(h, w, 4) if there else None)
    return found


def _mapped(images: DataFrame, extra: list[str], work: Callable[..., np.ndarray], together: Callable | None = None) -> DataFrame:
    """Runs ``work(raster, *extra)`` on every image; the raster is height x width x 4.

    ``together(rasters, *extras)`` may do many images at once: it takes lists and returns a list in which null stands for
    an image that is left to ``work``. Finished images are passed on at ``_BAND`` samples, so few are held.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, size = 0, 0
            lengths = [4 * (w or 0) * (h or 0) for w, h in zip(batch.column("width").to_pylist(), batch.column("height").to_pylist())]
            for hi, more in enumerate([*lengths, None]):
                if hi > lo and (more is None or size + more > 16 * _BAND):
                    yield from done(batch.slice(lo, hi - lo))
                    lo, size = hi, 0
                size += more or 0

    def done(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rasters, extras = _rasters(batch), [batch.column(c).to_pylist() for c in extra]
        there = [i for i, r in enumerate(rasters) if r is not None]
        made = together([rasters[i] for i in there], *([e[i] for i in there] for e in extras)) if together and there else [None] * len(there)
        found = dict(zip(there, made))
        ws, hs, bodies, lo, held = batch.column("width").to_pylist(), batch.column("height").to_pylist(), [], 0, 0
        for i, raster in enumerate(rasters):
            body = None
            if raster is not None:
                out = found.pop(i)
                out = work(raster, *(e[i] for e in extras)) if out is None else out
                hs[i], ws[i] = out.shape[:2]
                body = out.tobytes()
            bodies.append(body)
            held += len(body or b"")
            if held > 16 * _BAND or i == len(rasters) - 1:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("image_id").slice(lo, i + 1 - lo), pa.array(ws[lo:i + 1], pa.int32()), pa.array(hs[lo:i + 1], pa.int32()),
                     pa.array(bodies, pa.binary())], ["image_id", "width", "height", "data"])
                bodies, lo, held = [], i + 1, 0

    kind = images.schema["image_id"].dataType.simpleString()
    chosen = images.select("image_id", F.col("width").cast("int"), F.col("height").cast("int"), "data", *extra)
    return chosen.mapInArrow(run, f"image_id {kind}, width int, height int, data binary")


def rotate_packed(images: DataFrame, angle: str = "angle") -> DataFrame:
    """Clockwise quarter turns by the column ``angle``; other values leave an image as it is."""
    def turn(raster: np.ndarray, angle: int | None) -> np.ndarray:
        return np.ascontiguousarray(np.rot90(raster, {90: -1, 180: 2, 270: 1}.get(angle, 0)))

    return _mapped(images.withColumn("__angle", F.col(angle).cast("int")), ["__angle"], turn)


def crop_packed(images: DataFrame, rects: DataFrame) -> DataFrame:
    """Crop to ``rects(image_id, rx, ry, rw, rh)``, rounded and kept inside."""
    def cut(raster: np.ndarray, rx, ry, rw, rh) -> np.ndarray:
        h, w, _ = raster.shape
        whole = lambda v: math.floor(v + 0.5)
        left = min(max(whole(rx or 0.0), 0), w - 1)
        top = min(max(whole(ry or 0.0), 0), h - 1)
        wide = min(max(whole(w if rw is None else rw), 1), w - left)
        high = min(max(whole(h if rh is None else rh), 1), h - top)
        return np.ascontiguousarray(raster[top:top + high, left:left + wide])

    names = ["rx", "ry", "rw", "rh"]
    placed = images.join(rects.select("image_id", *[F.col(c).cast("double").alias(f"__{c}") for c in names]), "image_id", "left")
    return _mapped(placed, [f"__{c}" for c in names], cut)


def kernel_of(method: str, t: np.ndarray) -> np.ndarray:
    """The published kernels at distance ``t``; 0 outside the radius."""
    t = np.abs(t)
    if method == "triangle":
        return np.maximum(0.0, 1 - t)
    if method == "lanczos3":
        return np.where(t < 3, np.sinc(t) * np.sinc(t / 3), 0.0)
    b, c = CUBIC[method]
    near = ((12 - 9 * b - 6 * c) * t ** 3 + (-18 + 12 * b + 6 * c) * t ** 2 + 6 - 2 * b) / 6
    far = ((-b - 6 * c) * t ** 3 + (6 * b + 30 * c) * t ** 2 + (-12 * b - 48 * c) * t + 8 * b + 24 * c) / 6
    return np.where(t < 1, near, np.where(t < 2, far, 0.0))


@lru_cache(64)
def axis_bands(method: str, span: int, out: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``out`` targets the source pixels of ``span`` it is made of, and their weights.

    Both are targets x taps, as many taps as the kernel reaches. Taps beyond the rim point at the rim
    with weight 0. Weights are not normalised. The arrays are
    shared, so copy before changing them.
    """
    scale = span / out
    stretch = max(scale, 1.0)
    reach = stretch * RADIUS[method]
    centre = (np.arange(out) + 0.5) * scale
    taps = np.floor(centre - reach - 0.5).astype(np.int64)[:, None] + np.arange(math.floor(2 * reach) + 3)
    t = np.abs(taps + 0.5 - centre[:, None]) / stretch
    weight = np.where((t < RADIUS[method]) & (taps >= 0) & (taps < span), kernel_of(method, t), 0.0)
    return np.clip(taps, 0, span - 1), weight


def along(values: np.ndarray, taps: np.ndarray, weight: np.ndarray, axis: int) -> np.ndarray:
    """Weighted sums of slices of ``values`` along an axis (0 or 1), one tap at a time."""
    total = 0.0
    for k in range(taps.shape[1]):
        if axis == 0:
            total = total + weight[:, k, None, None] * values[taps[:, k]]
        else:
            total = total + weight[None, :, k, None] * values[:, taps[:, k]]
    return total


def tones(linear: bool) -> np.ndarray:
    """The light of each byte."""
    level = np.arange(256) / 255
    return np.where(level <= 0.04045, level / 12.92, ((level + 0.055) / 1.055) ** 2.4) if linear else level


def to_bytes(value: np.ndarray, premultiply: bool, linear: bool) -> np.ndarray:
    """RGBA bytes of resampled light; halves within 1e-9 go up."""
    alpha, colour = value[..., 3:], value[..., :3]
    if premultiply:
        colour = np.divide(colour, alpha, out=np.zeros_like(colour), where=alpha > 0)
    if linear:
        c = np.clip(colour, 0, 1)
        colour = np.where(c <= 0.0031308, c * 12.92, 1.055 * c ** (1 / 2.4) - 0.055)
    value = np.concatenate([colour, alpha], axis=-1) * 255
    return np.clip(np.floor(value + 0.5 + 1e-9), 0, 255).astype(np.uint8)


def _source(w: int, h: int, out_w: int, out_h: int, fit: str) -> tuple[int, int, int, int]:
    """The source box of a fit in whole pixels: left, top, right, bottom."""
    sw, sh, aspect = float(w), float(h), out_w / out_h
    if fit == "contain" and w / h > aspect:
        sw = h * aspect
    elif fit == "contain":
        sh = w / aspect
    left, top = math.floor((w - sw) / 2 + 0.5), math.floor((h - sh) / 2 + 0.5)
    return left, top, min(w, left + max(1, math.floor(sw + 0.5))), min(h, top + max(1, math.floor(sh + 0.5)))


def resample(raster: np.ndarray, out_w: int, out_h: int, fit: str, method: str, premultiply: bool, linear: bool) -> np.ndarray:
    h, w, _ = raster.shape
    if (out_w, out_h) == (w, h):
        return raster
    left, top, right, bottom = _source(w, h, out_w, out_h, fit)
    box = raster[top:bottom, left:right]
    x_taps, x_weight = axis_bands(method, right - left, out_w)
    y_taps, y_weight = axis_bands(method, bottom - top, out_h)
    x_weight = x_weight / x_weight.sum(axis=1, keepdims=True)
    y_weight = y_weight / y_weight.sum(axis=1, keepdims=True)
    tone = tones(linear)
    out = np.empty((out_h, out_w, 4), np.uint8)
    # bands of targets: each makes only the source lines it reaches, a part of them at a time
    step = max(1, _BAND // max(out_w, math.ceil((right - left) * (bottom - top) / out_h)))
    part = max(1, _BAND // (right - left))
    for lo in range(0, out_h, step):
        taps = y_taps[lo:lo + step]
        first, last = int(taps.min()), int(taps.max()) + 1
        lines = np.empty((last - first, out_w, 4))
        for y in range(first, last, part):
            rows = box[y:min(y + part, last)]
            value = np.concatenate([tone[rows[..., :3]], rows[..., 3:] / 255], axis=2)
            if premultiply:
                value[..., :3] *= value[..., 3:]
            lines[y - first:y - first + len(rows)] = along(value, x_taps, x_weight, 1)
        out[lo:lo + step] = to_bytes(along(lines, taps - first, y_weight[lo:lo + step], 0), premultiply, linear)
    return out


#: samples of a side, before and after, that images resampled together have at most
SMALL_SIDE = 64


def _normal(method: str, span: int, out: int) -> tuple[np.ndarray, np.ndarray]:
    taps, weight = axis_bands(method, span, out)
    return taps, weight / weight.sum(axis=1, keepdims=True)


def _alike(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Pairs of numbers and where each is found."""
    code = first * (SMALL_SIDE + 1) + second
    order = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.diff(code[order], prepend=-1))
    for some in np.split(order, starts[1:]):
        yield int(first[some[0]]), int(second[some[0]]), some


def resample_small(rasters: list[np.ndarray], sizes: list[tuple[int, int, str]], method: str, premultiply: bool,
                   linear: bool) -> list[np.ndarray]:
    """``resample`` of many small images: lines of one span and target size together, then columns likewise.

    The taps of a sample are summed in the same order as there.
    """
    h, w = (np.array([r.shape[k] for r in rasters]) for k in (0, 1))
    ow, oh = (np.array([s[k] for s in sizes]) for k in (0, 1))
    left, top, right, bottom = (np.array(v) for v in zip(*(_source(r.shape[1], r.shape[0], *s) for r, s in zip(rasters, sizes))))
    sw, sh = right - left, bottom - top
    begin = lambda n: np.cumsum(n) - n
    source, tone = np.concatenate([r.reshape(-1, 4) for r in rasters]), tones(linear)
    at, lines_at, out_at = begin(w * h), begin(sh * ow), begin(oh * ow)
    lines, out = np.empty((int((sh * ow).sum()), 4)), np.empty((int((oh * ow).sum()), 4), np.uint8)
    for span, wide, some in _alike(sw, ow):
        of = np.repeat(some, sh[some])
        y = np.arange(len(of)) - np.repeat(begin(sh[some]), sh[some])
        # span x lines x 4
        rows = source[(at[of] + (top[of] + y) * w[of] + left[of]) + np.arange(span)[:, None]]
        value = np.concatenate([tone[rows[..., :3]], rows[..., 3:] / 255], axis=2)
        if premultiply:
            value[..., :3] *= value[..., 3:]
        lines[(lines_at[of] + y * wide) + np.arange(wide)[:, None]] = along(value, *_normal(method, span, wide), 0)
    for span, tall, some in _alike(sh, oh):
        of = np.repeat(some, ow[some])
        x = np.arange(len(of)) - np.repeat(begin(ow[some]), ow[some])
        value = lines[(lines_at[of] + x) + np.arange(span)[:, None] * ow[of]]
        made = to_bytes(along(value, *_normal(method, span, tall), 0), premultiply, linear)
        out[(out_at[of] + x) + np.arange(tall)[:, None] * ow[of]] = made
    ends = (out_at + oh * ow).tolist()
    return [out[lo:hi].reshape(b, a, 4) for lo, hi, a, b in zip(out_at.tolist(), ends, ow.tolist(), oh.tolist())]


def resize_packed(images: DataFrame, targets: DataFrame, method: str = "lanczos3", premultiply: bool = True,
                  linear_rgb: bool = True) -> DataFrame:
    """Resize to ``targets(image_id, out_w, out_h, fit)``.

    Images without a target, or already of its size, pass unchanged. ``browser-pixelated`` takes the
    nearest sample; the other methods are those of ``resize_kernel``.
    """
    def work(raster: np.ndarray, out_w, out_h, fit) -> np.ndarray:
        h, w, _ = raster.shape
        out_w, out_h, fit = max(1, out_w or w), max(1, out_h or h), fit or "stretch"
        if method == "browser-pixelated":
            aspect, sw, sh = out_w / out_h, float(w), float(h)
            if fit == "contain" and w / h > aspect:
                sw = h * aspect
            elif fit == "contain":
                sh = w / aspect
            x = np.clip(np.floor((w - sw) / 2 + (np.arange(out_w) + 0.5) * (sw / out_w)).astype(int), 0, w - 1)
            y = np.clip(np.floor((h - sh) / 2 + (np.arange(out_h) + 0.5) * (sh / out_h)).astype(int), 0, h - 1)
            return np.ascontiguousarray(raster[y[:, None], x[None, :]])
        return resample(raster, out_w, out_h, fit, method, premultiply, linear_rgb)

    def together(rasters: list, ows: list, ohs: list, fits: list) -> list:
        sizes = [(max(1, a or r.shape[1]), max(1, b or r.shape[0]), f or "stretch") for r, a, b, f in zip(rasters, ows, ohs, fits)]
        small = [i for i, (r, (a, b, _)) in enumerate(zip(rasters, sizes)) if max(a, b, *r.shape[:2]) <= SMALL_SIDE and (b, a) != r.shape[:2]]
        found = [None] * len(rasters)
        made = resample_small([rasters[i] for i in small], [sizes[i] for i in small], method, premultiply, linear_rgb) if small else ()
        for i, out in zip(small, made):
            found[i] = out
        return found

    chosen = targets.select("image_id", F.col("out_w").cast("int").alias("__ow"), F.col("out_h").cast("int").alias("__oh"), F.col("fit").alias("__fit"))
    return _mapped(images.join(chosen, "image_id", "left"), ["__ow", "__oh", "__fit"], work,
                   None if method == "browser-pixelated" else together)
