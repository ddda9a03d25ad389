"""Queries on pixel tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from assetlane.operators import packed, pixels, resample
from assetlane.operators.encode import custom_metric
from assetlane.session import spread
from assetlane.suite.fixtures import view, with_views
from assetlane.suite.registry import case

_PX, _PAIR, _IMAGES = with_views("v_px"), with_views("v_px", "v_px_out"), with_views("v_images")
_COLS = "image_id, width, height, x, y, r, g, b, a"
_GRAY = "least(255, greatest(0, CAST(floor((CAST(v AS DOUBLE) + 1) * 127.5 + 0.5) AS INTEGER)))"


def _tiles(spark, sf_dir):
    """Embedding vectors as 8x8 gray rasters."""
    level = lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") + 1) * 127.5 + 0.5).cast("int")))
    return view(spark, sf_dir, "v_tiles").withColumn("data", F.transform("embedding", level)).drop("embedding")


_TILES = f"""{with_views('v_tiles')}, t AS (SELECT image_id, width, height, unnest(range(64)) AS p, unnest(embedding) AS v FROM v_tiles),
 tiles AS (SELECT image_id, width, height, CAST(p % 8 AS INTEGER) AS x, CAST(p // 8 AS INTEGER) AS y, {_GRAY} AS r, {_GRAY} AS g, {_GRAY} AS b, 255 AS a FROM t)"""


@case("explode_pixels", f"{_TILES} SELECT * FROM tiles")
def _(spark, sf_dir):
    return pixels.explode_pixels(_tiles(spark, sf_dir), "gray")


@case("explode_packed_pixels", f"{_TILES} SELECT * FROM tiles")
def _(spark, sf_dir):
    digits = F.transform("data", lambda v: F.lpad(F.hex(v.cast("bigint")), 2, "0"))
    packed = _tiles(spark, sf_dir).withColumn("data", F.unhex(F.array_join(digits, "")))
    return pixels.explode_pixels(packed, "gray")


@case(
    "explode_pixels_rejects",
    "SELECT vec_id AS image_id, CAST(8 + vec_id % 3 AS INTEGER) AS width, 8 AS height, 64 AS samples, 'too few samples' AS error FROM embeddings WHERE vec_id % 3 > 0",
)
def _(spark, sf_dir):
    """Tiles declared wider than their samples reach."""
    wide = _tiles(spark, sf_dir).withColumn("width", (F.lit(8) + F.col("image_id") % 3).cast("int"))
    return pixels.explode_rejects(wide, "gray")


_LUMA = "CASE WHEN a = 255 THEN 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b ELSE (0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b) * (a / 255::DOUBLE) + 255 * (1 - a / 255::DOUBLE) END"


@case("luma", f"{_PX} SELECT image_id, x, y, round({_LUMA}, 6) AS l FROM v_px")
def _(spark, sf_dir):
    return pixels.luma(view(spark, sf_dir, "v_px")).select("image_id", "x", "y", F.round("l", 6).alias("l"))


@case(
    "metrics_factor",
    f"{_IMAGES} SELECT image_id, width, height, CASE WHEN width * height <= 2000000 THEN 1 ELSE CAST(ceil(sqrt(CAST(width * height AS DOUBLE) / 2000000)) AS INTEGER) END AS factor FROM v_images",
)
def _(spark, sf_dir):
    return pixels.metrics_factor(view(spark, sf_dir, "v_images").select("image_id", "width", "height"))


_BOX = """SELECT image_id, CAST(width // 3 AS INTEGER) AS width, CAST(height // 3 AS INTEGER) AS height, CAST(x // 3 AS INTEGER) AS x, CAST(y // 3 AS INTEGER) AS y,
 CAST(round_even(avg(r), 0) AS INTEGER) AS r, CAST(round_even(avg(g), 0) AS INTEGER) AS g, CAST(round_even(avg(b), 0) AS INTEGER) AS b, CAST(round_even(avg(a), 0) AS INTEGER) AS a
 FROM {0} WHERE x < (width // 3) * 3 AND y < (height // 3) * 3 GROUP BY image_id, width, height, x // 3, y // 3"""


@case("box_downscale", f"{_PX} {_BOX.format('v_px')}")
def _(spark, sf_dir):
    return pixels.box_downscale(view(spark, sf_dir, "v_px"), 3)


def _ssim_sql(ref, out):
    return f"""pa AS (SELECT image_id, width, height, x, y, {_LUMA} AS p FROM {ref}), pb AS (SELECT image_id, width, height, x, y, {_LUMA} AS q FROM {out}),
 sa AS (SELECT image_id, any_value(width) AS aw, any_value(height) AS ah, count(*) AS n FROM {ref} GROUP BY image_id),
 sb AS (SELECT image_id, any_value(width) AS bw, any_value(height) AS bh, count(*) AS m FROM {out} GROUP BY image_id),
 e AS (SELECT image_id, CASE WHEN n IS NULL OR m IS NULL THEN 'one side has no pixels' WHEN aw <> bw OR ah <> bh THEN concat('sizes differ: ', aw, 'x', ah, ' and ', bw, 'x', bh)
  WHEN least(n, m) < aw * ah THEN 'too few samples' END AS error FROM sa FULL JOIN sb USING (image_id)),
 wz AS (SELECT pa.*, q, least(8, width) AS ww, least(8, height) AS wh FROM pa JOIN pb USING (image_id, width, height, x, y)),
 s AS (SELECT image_id, x // ww AS wx, y // wh AS wy, count(*) AS n, avg(p) AS mp, avg(q) AS mq, avg(p * p) AS pp, avg(q * q) AS qq, avg(p * q) AS pq FROM wz
  WHERE (x // ww + 1) * ww <= width AND (y // wh + 1) * wh <= height GROUP BY ALL),
 f AS (SELECT image_id, (2 * mp * mq + 6.5025::DOUBLE) * (2 * (pq - mp * mq) + 58.5225::DOUBLE) / ((mp * mp + mq * mq + 6.5025::DOUBLE) * ((pp - mp * mp) + (qq - mq * mq) + 58.5225::DOUBLE)) AS s FROM s),
 g AS (SELECT image_id, greatest(-1, least(1, avg(s))) AS ssim FROM f GROUP BY image_id)
 SELECT image_id, CASE WHEN error IS NULL THEN round(ssim, 6) END AS ssim, error FROM e LEFT JOIN g USING (image_id)"""


@case("ssim", f"{_PAIR}, {_ssim_sql('v_px', 'v_px_out')}")
def _(spark, sf_dir):
    return pixels.ssim(view(spark, sf_dir, "v_px"), view(spark, sf_dir, "v_px_out")).select(
        "image_id", F.round("ssim", 6).alias("ssim"), "error"
    )


@case("ssim_tiles", f"""{_TILES}, pair AS (SELECT a.image_id, a.width, a.height, a.x, a.y, b.r, b.g, b.b, b.a FROM tiles a JOIN tiles b ON b.image_id = a.image_id AND b.x = a.x AND b.y = 7 - a.y),
 {_ssim_sql('tiles', 'pair')}""")
def _(spark, sf_dir):
    """Each tile against itself upside down."""
    px = pixels.explode_pixels(_tiles(spark, sf_dir), "gray")
    flipped = px.withColumn("y", F.lit(7) - F.col("y"))
    return pixels.ssim(px, flipped).select("image_id", F.round("ssim", 6).alias("ssim"), "error")


_BOX2 = _BOX.replace("// 3", "// 2").replace("* 3", "* 2")


@case(
    "measure_ssim",
    f"{_PAIR}, ra AS ({_BOX2.format('v_px')}), rb AS ({_BOX2.format('v_px_out')}), {_ssim_sql('ra', 'rb')}".replace(
        "concat('sizes differ: ', aw, 'x', ah, ' and ', bw, 'x', bh)",
        "'sizes differ: 20x18 and 19x18'",
    ),
)
def _(spark, sf_dir):
    """Both sides halved first, as a pixel budget of 100 asks for at 20 x 18."""
    scored = pixels.measure_ssim(view(spark, sf_dir, "v_px"), view(spark, sf_dir, "v_px_out"), 100)
    return scored.select("image_id", F.round("ssim", 6).alias("ssim"), "error")


def _packed_pairs(spark, sf_dir):
    """The two pixel views as packed rasters, one row per image."""
    ref, out = (
        pixels.pack_pixels(view(spark, sf_dir, v), name, "rgba").drop("width", "height")
        for v, name in (("v_px", "ref"), ("v_px_out", "out"))
    )
    return ref.join(spread(out), "image_id").selectExpr(
        "image_id", "20 AS width", "18 AS height", "ref", "CASE WHEN image_id % 29 = 0 THEN substring(out, 1, 9) ELSE out END AS out"
    )


_SHORT = "CASE WHEN image_id % 29 = 0 THEN 'too few samples' END"


@case("ssim_packed", f"{_PAIR}, {_ssim_sql('v_px', 'v_px_out').replace('SELECT image_id, CASE WHEN error IS NULL THEN round(ssim, 6) END AS ssim, error FROM e', f'SELECT image_id, CASE WHEN error IS NULL THEN round(ssim, 6) END AS ssim, {_SHORT} AS error FROM e')}")
def _(spark, sf_dir):
    """The pairs of ``ssim`` as packed rasters; those of another size are cut short instead."""
    return pixels.ssim_packed(_packed_pairs(spark, sf_dir)).select(
        "image_id", F.round("ssim", 6).alias("ssim"), "error"
    )


_ANGLE = "CAST(image_id % 4 * 90 AS INTEGER)"


@case(
    "rotate",
    f"""{_PX}, q AS (SELECT *, {_ANGLE} AS k FROM v_px) SELECT image_id, CASE WHEN k IN (90, 270) THEN height ELSE width END AS width, CASE WHEN k IN (90, 270) THEN width ELSE height END AS height,
 CASE k WHEN 90 THEN height - 1 - y WHEN 180 THEN width - 1 - x WHEN 270 THEN y ELSE x END AS x,
 CASE k WHEN 90 THEN x WHEN 180 THEN height - 1 - y WHEN 270 THEN width - 1 - x ELSE y END AS y, r, g, b, a FROM q""",
)
def _(spark, sf_dir):
    return pixels.rotate(view(spark, sf_dir, "v_px"), F.expr(_ANGLE))


_RECTS = "CAST(image_id % 25 AS DOUBLE) - 2.5 AS rx, CAST(image_id % 7 AS DOUBLE) + 0.5 AS ry, CAST(image_id % 13 AS DOUBLE) AS rw, CAST(image_id % 30 AS DOUBLE) AS rh"


@case(
    "crop",
    f"""{_PX}, i AS (SELECT p_partkey AS image_id FROM part), k AS (SELECT image_id, {_RECTS} FROM i),
 o AS (SELECT p.*, greatest(0, least(width - 1, CAST(floor(rx + 0.5) AS INTEGER))) AS l, greatest(0, least(height - 1, CAST(floor(ry + 0.5) AS INTEGER))) AS t, rw, rh FROM v_px p JOIN k USING (image_id)),
 z AS (SELECT *, greatest(1, least(width - l, CAST(floor(rw + 0.5) AS INTEGER))) AS w, greatest(1, least(height - t, CAST(floor(rh + 0.5) AS INTEGER))) AS h FROM o)
 SELECT image_id, w AS width, h AS height, x - l AS x, y - t AS y, r, g, b, a FROM z WHERE x >= l AND x < l + w AND y >= t AND y < t + h""",
)
def _(spark, sf_dir):
    rects = view(spark, sf_dir, "v_images").selectExpr("image_id", *_RECTS.split(", "))
    return pixels.crop(view(spark, sf_dir, "v_px"), rects)


def _crop_sql(rect):
    return f"""{_IMAGES}, i AS (SELECT image_id, CAST(width AS DOUBLE) AS bw, CAST(height AS DOUBLE) AS bh, CAST(width // 3 AS DOUBLE) - 20 AS rx, CAST(height // 4 AS DOUBLE) AS ry, CAST(width AS DOUBLE) / 2 AS rw, CAST(height // 3 AS DOUBLE) AS rh FROM v_images),
 k AS ({rect}), z AS (SELECT *, greatest(least(8, bw), least(bw, floor(w + 0.5))) AS cw, greatest(least(8, bh), least(bh, floor(h + 0.5))) AS ch FROM k)
 SELECT image_id, CAST(greatest(0, least(bw - cw, floor(x + 0.5))) AS BIGINT) AS x, CAST(greatest(0, least(bh - ch, floor(y + 0.5))) AS BIGINT) AS y, CAST(cw AS BIGINT) AS crop_width, CAST(ch AS BIGINT) AS crop_height FROM z"""


def _rects(spark, sf_dir):
    return view(spark, sf_dir, "v_images").selectExpr(
        "image_id", "width", "height", "CAST(width div 3 AS DOUBLE) - 20D AS rx", "CAST(height div 4 AS DOUBLE) AS ry",
        "CAST(width AS DOUBLE) / 2D AS rw", "CAST(height div 3 AS DOUBLE) AS rh",
    )


@case("crop_plan", _crop_sql("SELECT image_id, bw, bh, rx AS x, ry AS y, rw AS w, rh AS h FROM i"))
def _(spark, sf_dir):
    return pixels.crop_plan(_rects(spark, sf_dir))


@case(
    "crop_plan_wide",
    _crop_sql("""SELECT image_id, bw, bh, rx + rw / 2 - w / 2 AS x, ry + rh / 2 - h / 2 AS y, w, h FROM (SELECT *, w / (16::DOUBLE / 9) AS h FROM
 (SELECT *, least(CASE WHEN bw / (16::DOUBLE / 9) > bh THEN bh * (16::DOUBLE / 9) ELSE bw END, greatest(rw, rh * (16::DOUBLE / 9))) AS w FROM i))"""),
)
def _(spark, sf_dir):
    return pixels.crop_plan(_rects(spark, sf_dir), pixels.ASPECTS["16:9"])


_TARGETS = "1 + image_id % 300 AS out_w, 1 + image_id % 170 AS out_h, CASE WHEN image_id % 2 = 0 THEN 'contain' ELSE 'stretch' END AS fit"


@case(
    "fit_boxes",
    f"""{_IMAGES}, t AS (SELECT image_id, CAST(width AS DOUBLE) AS w, CAST(height AS DOUBLE) AS h, {_TARGETS} FROM v_images),
 u AS (SELECT *, CASE WHEN fit = 'contain' AND w / h > CAST(out_w AS DOUBLE) / out_h THEN h * (CAST(out_w AS DOUBLE) / out_h) ELSE w END AS sw,
  CASE WHEN fit = 'contain' AND NOT w / h > CAST(out_w AS DOUBLE) / out_h THEN w / (CAST(out_w AS DOUBLE) / out_h) ELSE h END AS sh, least(1, 120 / greatest(w, h)) AS k FROM t)
 SELECT image_id, round((w - sw) / 2, 6) AS sx, round((h - sh) / 2, 6) AS sy, round(sw, 6) AS sw, round(sh, 6) AS sh,
  greatest(1, CAST(floor(out_w * h / w + 0.5) AS BIGINT)) AS height_for_width, greatest(1, CAST(floor(out_h * w / h + 0.5) AS BIGINT)) AS width_for_height,
  greatest(1, CAST(floor(w * k + 0.5) AS BIGINT)) AS thumb_w, greatest(1, CAST(floor(h * k + 0.5) AS BIGINT)) AS thumb_h,
  round(greatest(0.01::DOUBLE, least(least(out_w / w, out_h / h), 4)), 6) AS scale FROM u""",
)
def _(spark, sf_dir):
    targets = view(spark, sf_dir, "v_images").selectExpr("image_id", "width", "height", *_split(_TARGETS))
    rounded = [F.round(c, 6).alias(c) for c in ("sx", "sy", "sw", "sh", "scale")]
    return pixels.fit_boxes(targets).select(
        "image_id", *rounded, "height_for_width", "width_for_height", "thumb_w", "thumb_h"
    )


def _split(text):
    return [p.strip() for p in text.split(", ")]


# some images are already of their target size
_SMALL = "CAST(CASE WHEN image_id % 11 = 0 THEN 20 ELSE 3 + image_id % 23 END AS INTEGER) AS out_w, CAST(CASE WHEN image_id % 11 = 0 THEN 18 ELSE 2 + image_id % 19 END AS INTEGER) AS out_h, CASE WHEN image_id % 3 = 0 THEN 'contain' ELSE 'stretch' END AS fit"
_BOXED = f"""i AS (SELECT p_partkey AS image_id FROM part), t AS (SELECT image_id, 20::DOUBLE AS w, 18::DOUBLE AS h, {_SMALL} FROM i),
 u AS (SELECT *, CASE WHEN fit = 'contain' AND w / h > CAST(out_w AS DOUBLE) / out_h THEN h * (CAST(out_w AS DOUBLE) / out_h) ELSE w END AS sw,
  CASE WHEN fit = 'contain' AND NOT w / h > CAST(out_w AS DOUBLE) / out_h THEN w / (CAST(out_w AS DOUBLE) / out_h) ELSE h END AS sh FROM t),
 box AS (SELECT *, (w - sw) / 2 AS sx, (h - sh) / 2 AS sy FROM u)"""


def _small(spark, sf_dir):
    return view(spark, sf_dir, "v_images").selectExpr("image_id", *_split(_SMALL))


@case(
    "resize_nearest",
    f"""{_PX}, {_BOXED}, dx AS (SELECT *, unnest(range(out_w)) AS x FROM box), dst AS (SELECT *, unnest(range(out_h)) AS y FROM dx),
 src AS (SELECT *, least(19, CAST(floor(sx + (x + 0.5::DOUBLE) * (sw / out_w)) AS INTEGER)) AS px, least(17, CAST(floor(sy + (y + 0.5::DOUBLE) * (sh / out_h)) AS INTEGER)) AS py FROM dst)
 SELECT src.image_id, out_w AS width, out_h AS height, CAST(src.x AS INTEGER) AS x, CAST(src.y AS INTEGER) AS y, r, g, b, a FROM src JOIN v_px p ON p.image_id = src.image_id AND p.x = px AND p.y = py""",
)
def _(spark, sf_dir):
    return resample.resize_nearest(view(spark, sf_dir, "v_px"), _small(spark, sf_dir))


_KERNEL_SQL = {
    "triangle": ("1", "greatest(0, 1 - t)"),
    "mitchell": ("2", "CASE WHEN t < 1 THEN (7 * t * t * t - 12 * t * t + 16::DOUBLE / 3) / 6 WHEN t < 2 THEN (-7::DOUBLE / 3 * t * t * t + 12 * t * t - 20 * t + 32::DOUBLE / 3) / 6 ELSE 0 END"),
    "catrom": ("2", "CASE WHEN t < 1 THEN (9 * t * t * t - 15 * t * t + 6) / 6 WHEN t < 2 THEN (-3 * t * t * t + 15 * t * t - 24 * t + 12) / 6 ELSE 0 END"),
    "lanczos3": ("3", "CASE WHEN t = 0 THEN 1 WHEN t < 3 THEN sin(t * pi()) / (t * pi()) * (sin(t * pi() / 3) / (t * pi() / 3)) ELSE 0 END"),
}


def _kernel_sql(method, linear, premultiply):
    """Weight tables joined with pixels: the gather form of what the operator scatters."""
    radius, k = _KERNEL_SQL[method]
    tone = "{0} / 255::DOUBLE"
    if linear:
        tone = "CASE WHEN {0} / 255::DOUBLE <= 0.04045::DOUBLE THEN {0} / 255::DOUBLE / 12.92::DOUBLE ELSE pow(({0} / 255::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"
    by_alpha = " * (a / 255::DOUBLE)" if premultiply else ""
    back = "{0} / nullif(av, 0)" if premultiply else "{0}"
    light = "least(1, greatest(0, coalesce(" + back + ", 0)))"
    if linear:
        light = f"CASE WHEN {light} <= 0.0031308::DOUBLE THEN {light} * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow({light}, 1 / 2.4::DOUBLE) - 0.055::DOUBLE END"
    byte = "CAST(least(255, greatest(0, floor(255 * (" + light + ") + 0.500000001::DOUBLE))) AS INTEGER)"
    # taps of a target are those its kernel reaches; every step is materialised, so that its cost hangs on no join order
    weights = lambda name, n, lo, span, out: f"""{name} AS MATERIALIZED (SELECT image_id, d, s, {k} AS k FROM (SELECT image_id, d, s, abs((s + 0.5::DOUBLE - {lo} - c) / f) AS t FROM
  (SELECT *, unnest(range(CAST(greatest({lo}, floor({lo} + c - {radius} * f - 1)) AS BIGINT), CAST(least({n}, {lo} + {span}, ceil({lo} + c + {radius} * f + 1)) AS BIGINT))) AS s FROM
   (SELECT *, (d + 0.5::DOUBLE) * ({span} / {out}) AS c, greatest({span} / {out}, 1) AS f FROM (SELECT *, unnest(range({out})) AS d FROM cut)))) WHERE t < {radius} AND {k} <> 0)"""  # noqa: E731
    return f"""{_PX}, {_BOXED}, cut AS MATERIALIZED (SELECT image_id, out_w, out_h, floor(sx + 0.5) AS sx, floor(sy + 0.5) AS sy, greatest(1, floor(sw + 0.5)) AS sw, greatest(1, floor(sh + 0.5)) AS sh FROM box WHERE out_w <> 20 OR out_h <> 18),
 {weights('wx', 20, 'sx', 'sw', 'out_w')}, {weights('wy', 18, 'sy', 'sh', 'out_h')},
 lin AS MATERIALIZED (SELECT image_id, x, y, ({tone.format('r')}){by_alpha} AS rv, ({tone.format('g')}){by_alpha} AS gv, ({tone.format('b')}){by_alpha} AS bv, a / 255::DOUBLE AS av FROM v_px),
 ax AS MATERIALIZED (SELECT l.image_id, d AS x, y, sum(rv * k) / sum(k) AS rv, sum(gv * k) / sum(k) AS gv, sum(bv * k) / sum(k) AS bv, sum(av * k) / sum(k) AS av FROM lin l JOIN wx ON wx.image_id = l.image_id AND wx.s = l.x GROUP BY ALL),
 ay AS MATERIALIZED (SELECT l.image_id, x, d AS y, sum(rv * k) / sum(k) AS rv, sum(gv * k) / sum(k) AS gv, sum(bv * k) / sum(k) AS bv, sum(av * k) / sum(k) AS av FROM ax l JOIN wy ON wy.image_id = l.image_id AND wy.s = l.y GROUP BY ALL)
 SELECT ay.image_id, out_w AS width, out_h AS height, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, {byte.format('rv')} AS r, {byte.format('gv')} AS g, {byte.format('bv')} AS b,
  CAST(least(255, greatest(0, floor(av * 255 + 0.500000001::DOUBLE))) AS INTEGER) AS a FROM ay JOIN cut USING (image_id)
 UNION ALL SELECT p.image_id, width, height, p.x, p.y, r, g, b, a FROM v_px p JOIN box USING (image_id) WHERE out_w = 20 AND out_h = 18"""


def _kernel_case(method, premultiply, linear):
    @case(f"resize_{method}", _kernel_sql(method, linear, premultiply))
    def run(spark, sf_dir):
        return resample.resize_kernel(
            view(spark, sf_dir, "v_px"), _small(spark, sf_dir), method, premultiply, linear
        )


for _method, _premultiply, _linear in (
    ("triangle", False, False), ("mitchell", True, False), ("catrom", True, True), ("lanczos3", True, True),
):
    _kernel_case(_method, _premultiply, _linear)


def _packed(spark, sf_dir):
    return pixels.pack_pixels(view(spark, sf_dir, "v_px"))


def _packed_case(method, premultiply, linear):
    @case(f"resize_packed_{method}", _kernel_sql(method, linear, premultiply))
    def run(spark, sf_dir):
        out = packed.resize_packed(_packed(spark, sf_dir), _small(spark, sf_dir), method, premultiply, linear)
        return pixels.explode_pixels(out)


_packed_case("mitchell", True, False)
_packed_case("lanczos3", True, True)


@case(
    "apply_soft_mask",
    f"""{_PX}, {_TILES.removeprefix('WITH ')} SELECT p.image_id, p.width, p.height, p.x, p.y, p.r, p.g, p.b, coalesce(m.r, p.a) AS a FROM v_px p
 LEFT JOIN tiles m ON m.image_id = p.image_id AND m.x = p.x * 8 // 20 AND m.y = p.y * 8 // 18""",
)
def _(spark, sf_dir):
    """Tiles as masks; images without one stay as they are."""
    masks = pixels.explode_pixels(_tiles(spark, sf_dir), "gray")
    return pixels.apply_soft_mask(view(spark, sf_dir, "v_px"), masks)


def mean_square_error(ref: bytes, out: bytes, width: int, height: int) -> float:
    a, b = (np.frombuffer(x, np.uint8).astype(np.float64) for x in (ref, out))
    if a.size != b.size:
        raise ValueError("sizes differ")
    return float(((a - b) ** 2).mean())


@case(
    "custom_metric",
    f"""{_TILES}, f AS (SELECT a.image_id, avg(CAST(a.r - b.r AS DOUBLE) * (a.r - b.r)) AS score FROM tiles a JOIN tiles b ON b.image_id = a.image_id AND b.x = a.x AND b.y = 7 - a.y GROUP BY a.image_id)
 SELECT image_id, CASE WHEN image_id % 50 <> 7 THEN round(score, 6) END AS score FROM f""",
)
def _(spark, sf_dir):
    """Mean square error of each tile against its flip; some pairs cannot be measured."""
    px = pixels.explode_pixels(_tiles(spark, sf_dir), "gray")
    ref, out = pixels.pack_pixels(px, "ref", "gray"), pixels.pack_pixels(px.withColumn("y", F.lit(7) - F.col("y")), "out", "gray")
    cut = F.when(F.col("image_id") % 50 == 7, F.substring("out", 1, 3)).otherwise(F.col("out"))
    pairs = ref.join(out, ["image_id", "width", "height"]).withColumn("out", cut)
    return custom_metric(pairs, mean_square_error).select("image_id", F.round("score", 6).alias("score"))
