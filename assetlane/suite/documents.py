"""Queries on PDF object tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetlane.functions import report
from assetlane.operators import drawing, pdf
from assetlane.session import spread
from assetlane.suite.fixtures import read, view, with_views
from assetlane.suite.registry import case
from assetlane.suite.sweeps import _sql_bytes, _sql_signed, sql_fixed

_OBJECTS = with_views("v_pdf_objects")
_PICTURES = with_views("v_pdf_images", "v_pdf_placements")


def _objects(spark, sf_dir):
    """The object view with its lists as arrays."""
    rows = view(spark, sf_dir, "v_pdf_objects")
    filters = F.when(F.col("filter_list") == "", F.array().cast("array<string>")).otherwise(F.split("filter_list", ","))
    return rows.withColumns(
        {"filters": filters, "decode": F.split("decode_list", ",").cast("array<double>")}
    ).drop("filter_list", "decode_list")


@case(
    "pdf_refusals",
    f"""{_OBJECTS}, s AS (SELECT doc_id, bool_or((sig_flags & 3) <> 0 OR ft = '/Sig' OR has_byte_range) AS signed FROM v_pdf_objects GROUP BY doc_id),
 r AS (SELECT doc_id, CASE WHEN doc_id % 53 = 0 THEN 'unreadable' WHEN doc_id % 47 = 0 THEN 'encrypted' WHEN signed THEN 'signed' END AS refusal FROM s)
 SELECT doc_id, refusal, CASE refusal WHEN 'unreadable' THEN 'This is not a readable PDF.' WHEN 'encrypted' THEN 'This PDF is encrypted — remove the password first.'
 WHEN 'signed' THEN 'This PDF is digitally signed — compressing would break the signature.' END AS message FROM r""",
)
def _(spark, sf_dir):
    return pdf.pdf_refusals(_docs(spark, sf_dir), _objects(spark, sf_dir))


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS doc_id", "c_custkey % 53 <> 0 AS parsed", "c_custkey % 47 = 0 AS encrypted"
    )


@case(
    "pdf_images",
    f"""{_OBJECTS} SELECT doc_id, obj_no AS ref, width, height, CASE WHEN filter_list IN ('DCTDecode', 'FlateDecode', 'JPXDecode') THEN filter_list ELSE 'unknown' END AS filter,
 color_space, coalesce(bpc, CASE WHEN is_mask THEN 1 ELSE 8 END) AS bpc, smask_ref IS NOT NULL AS has_smask, is_mask,
 coalesce(decode_list = '1,0', false) AS custom_decode, src_bytes FROM v_pdf_objects WHERE subtype = '/Image'""",
)
def _(spark, sf_dir):
    return pdf.pdf_images(_objects(spark, sf_dir))


_DPI = """draws AS (SELECT doc_id, ref, page, sqrt(a * a + b * b) AS w1, sqrt(c * c + d * d) AS h1, user_unit FROM v_pdf_placements),
 dpi AS (SELECT i.doc_id, i.ref, max(CASE WHEN w1 > 0 AND h1 > 0 THEN greatest(i.width * 72 / w1, i.height * 72 / h1) / user_unit END) AS dpi,
  list_sort(list(DISTINCT page) FILTER (page IS NOT NULL)) AS pages FROM v_pdf_images i LEFT JOIN draws ON draws.doc_id = i.doc_id AND draws.ref = i.ref GROUP BY i.doc_id, i.ref)"""


@case(
    "effective_dpi",
    f"{_PICTURES}, {_DPI} SELECT doc_id, ref, coalesce(array_to_string(pages, ','), '') AS pages, round(dpi, 6) AS dpi FROM dpi",
)
def _(spark, sf_dir):
    found = pdf.effective_dpi(view(spark, sf_dir, "v_pdf_placements"), view(spark, sf_dir, "v_pdf_images"))
    return found.select("doc_id", "ref", F.array_join("pages", ",").alias("pages"), F.round("dpi", 6).alias("dpi"))


@case(
    "page_ranges",
    f"""{with_views('v_pdf_placements')}, p AS (SELECT DISTINCT doc_id, ref, page FROM v_pdf_placements WHERE page IS NOT NULL AND ref IS NOT NULL),
 g AS (SELECT *, page - row_number() OVER (PARTITION BY doc_id, ref ORDER BY page) AS island FROM p)
 SELECT doc_id, ref, CAST(min(page) AS BIGINT) AS first, CAST(max(page) AS BIGINT) AS last FROM g GROUP BY doc_id, ref, island""",
)
def _(spark, sf_dir):
    """Blocks of two pages, so that runs meet block edges in these short documents."""
    return pdf.page_ranges(view(spark, sf_dir, "v_pdf_placements"), block=2)


_SKIP = """CASE WHEN is_mask THEN 'mask' WHEN color_space = '/DeviceCMYK' THEN 'cmyk' WHEN filter NOT IN ('DCTDecode', 'FlateDecode') {flate} THEN 'no-decoder'
 WHEN bpc <> 8 OR color_space NOT IN ('/DeviceRGB', '/DeviceGray') OR custom_decode THEN 'colorspace' WHEN src_bytes < 4096 THEN 'too-small' END"""


@case(
    "skip_reason",
    f"{with_views('v_pdf_images')} SELECT doc_id, ref, {_SKIP.format(flate='')} AS skip, {_SKIP.format(flate=chr(79) + 'R filter = ' + chr(39) + 'FlateDecode' + chr(39))} AS skip_flate_off FROM v_pdf_images",
)
def _(spark, sf_dir):
    rows = pdf.skip_reason(view(spark, sf_dir, "v_pdf_images"))
    off = pdf.skip_reason_of(pdf.PdfSettings(flate_to_jpeg=False))
    return rows.select("doc_id", "ref", "skip", off.alias("skip_flate_off"))


_TARGET = """scaled AS (SELECT i.*, dpi.pages, dpi.dpi, CASE WHEN dpi.dpi IS NOT NULL THEN CASE WHEN dpi.dpi > 150 THEN 150 / dpi.dpi END
  WHEN greatest(i.width, i.height) > 2400 THEN 2400 / CAST(greatest(i.width, i.height) AS DOUBLE) END AS k FROM v_pdf_images i JOIN dpi ON dpi.doc_id = i.doc_id AND dpi.ref = i.ref),
 sized AS (SELECT *, greatest(1, CAST(floor(width * k + 0.5) AS BIGINT)) AS tw, greatest(1, CAST(floor(height * k + 0.5) AS BIGINT)) AS th FROM scaled),
 plan AS (SELECT *, CASE WHEN k IS NOT NULL AND (tw < width OR th < height) THEN tw END AS out_w, CASE WHEN k IS NOT NULL AND (tw < width OR th < height) THEN th END AS out_h,
  CASE WHEN is_mask THEN 'mask' WHEN color_space = '/DeviceCMYK' THEN 'cmyk' WHEN filter NOT IN ('DCTDecode', 'FlateDecode') THEN 'no-decoder'
   WHEN bpc <> 8 OR color_space NOT IN ('/DeviceRGB', '/DeviceGray') OR custom_decode THEN 'colorspace' WHEN src_bytes < 4096 THEN 'too-small' END AS skip FROM sized)"""


def _planned(spark, sf_dir):
    images = view(spark, sf_dir, "v_pdf_images")
    placed = pdf.effective_dpi(view(spark, sf_dir, "v_pdf_placements"), images)
    return pdf.resample_target(pdf.skip_reason(images.join(spread(placed), ["doc_id", "ref"])))


@case("resample_target", f"{_PICTURES}, {_DPI}, {_TARGET} SELECT doc_id, ref, out_w, out_h FROM plan")
def _(spark, sf_dir):
    return _planned(spark, sf_dir).select("doc_id", "ref", "out_w", "out_h")


_ENCODES = "CASE WHEN (doc_id + ref) % 12 <> 0 THEN CAST(src_bytes * (40 + (doc_id + ref * 7) % 80) // 100 AS BIGINT) END"
_OUTCOMES = f"""out AS (SELECT doc_id, ref, src_bytes, out_w, out_h, skip, {_ENCODES} AS enc, (doc_id + ref) % 13 = 0 AS broken, CASE WHEN (doc_id + ref) % 3 > 0 THEN 0.97::DOUBLE END AS s
  FROM plan WHERE doc_id % 37 <> 0),
 done AS (SELECT *, skip IS NULL AND (broken OR enc IS NULL) AS failed FROM out),
 outcomes AS (SELECT doc_id, ref, src_bytes, CASE WHEN skip IS NULL AND NOT failed AND enc < src_bytes THEN enc END AS out_bytes, out_w AS tw, out_h AS th, s,
  CASE WHEN skip IS NOT NULL THEN skip WHEN failed THEN 'error' WHEN enc >= src_bytes THEN 'not-smaller' END AS why, CASE WHEN failed THEN CASE WHEN broken AND enc IS NOT NULL THEN 'decode failed' ELSE 'stream not found' END END AS error FROM done)"""


def _encodes(spark, sf_dir):
    rows = view(spark, sf_dir, "v_pdf_images").where((F.col("doc_id") + F.col("ref")) % 12 != 0)
    return rows.selectExpr(
        "doc_id", "ref", "CAST(src_bytes * (40 + (doc_id + ref * 7) % 80) div 100 AS BIGINT) AS enc_bytes",
        "CASE WHEN (doc_id + ref) % 3 > 0 THEN 0.97D END AS ssim", "CASE WHEN (doc_id + ref) % 13 = 0 THEN 'decode failed' END AS error",
    )


def _outcomes(spark, sf_dir):
    refusals = _docs(spark, sf_dir).select(
        "doc_id", F.when(F.col("doc_id") % 37 == 0, "signed").alias("refusal")
    )
    return pdf.resolve_outcomes(
        _planned(spark, sf_dir), _encodes(spark, sf_dir), refusals, pdf.PdfSettings(measure=True)
    )


@case(
    "resolve_outcomes",
    f"""{_PICTURES}, {_DPI}, {_TARGET}, {_OUTCOMES} SELECT doc_id, ref, src_bytes, out_bytes, CASE WHEN out_bytes IS NOT NULL THEN tw END AS out_w,
 CASE WHEN out_bytes IS NOT NULL THEN th END AS out_h, CASE WHEN out_bytes IS NOT NULL THEN s END AS ssim, why AS skip, error FROM outcomes""",
)
def _(spark, sf_dir):
    return _outcomes(spark, sf_dir)


_DUPES = """img AS (SELECT * FROM v_pdf_objects WHERE subtype = '/Image'),
 grp AS (SELECT doc_id, obj_no, first_value(obj_no) OVER (PARTITION BY doc_id, width, height, bpc, color_space, smask_ref, filter_list, decode_list, contents ORDER BY obj_no) AS c FROM img),
 dup AS (SELECT doc_id, obj_no AS dup_ref, c AS canonical_ref FROM grp WHERE c <> obj_no)"""


def _dupes(spark, sf_dir):
    objects = _objects(spark, sf_dir).withColumn("filter", F.array_join("filters", ","))
    return pdf.dedupe_images(objects)


@case("dedupe_images", f"{_OBJECTS}, {_DUPES} SELECT * FROM dup")
def _(spark, sf_dir):
    return _dupes(spark, sf_dir)


@case(
    "repoint_refs",
    f"""{_OBJECTS}, {_DUPES}, e AS (SELECT doc_id, obj_no AS owner, 'SMask' AS slot, smask_ref AS ref FROM v_pdf_objects WHERE smask_ref IS NOT NULL
  UNION ALL SELECT doc_id, obj_no AS owner, 'XObject' AS slot, (obj_no * 7 + 3) % 25 AS ref FROM v_pdf_objects)
 SELECT e.doc_id, owner, slot, coalesce(canonical_ref, ref) AS ref FROM e LEFT JOIN dup ON dup.doc_id = e.doc_id AND dup.dup_ref = e.ref""",
)
def _(spark, sf_dir):
    objects = view(spark, sf_dir, "v_pdf_objects")
    edges = objects.where("smask_ref IS NOT NULL").selectExpr(
        "doc_id", "obj_no AS owner", "'SMask' AS slot", "smask_ref AS ref"
    ).unionByName(
        objects.selectExpr("doc_id", "obj_no AS owner", "'XObject' AS slot", "(obj_no * 7 + 3) % 25 AS ref")
    )
    return pdf.repoint_refs(edges, _dupes(spark, sf_dir))


@case(
    "prune_objects",
    f"""{_OBJECTS}, {_DUPES} SELECT doc_id, obj_no, subtype FROM v_pdf_objects o WHERE NOT is_metadata AND NOT is_thumb
 AND NOT EXISTS (SELECT 1 FROM dup WHERE dup.doc_id = o.doc_id AND dup_ref = obj_no)
 AND NOT EXISTS (SELECT 1 FROM v_pdf_objects p WHERE p.doc_id = o.doc_id AND p.smask_ref = o.obj_no AND p.subtype = '/Image' AND p.obj_no % 2 = 0)""",
)
def _(spark, sf_dir):
    objects = view(spark, sf_dir, "v_pdf_objects")
    replaced = objects.where("subtype = '/Image' AND obj_no % 2 = 0").selectExpr("doc_id", "obj_no AS ref")
    return pdf.prune_objects(objects, _dupes(spark, sf_dir), replaced).select("doc_id", "obj_no", "subtype")


@case(
    "pdf_summary",
    f"""{with_views('v_pdf_images', 'v_pdf_placements', 'v_pdf_objects')}, {_DPI}, {_TARGET}, {_OUTCOMES}, {_DUPES},
 i AS (SELECT doc_id, count(*) AS images, CAST(sum(src_bytes) AS BIGINT) AS image_bytes FROM v_pdf_images GROUP BY doc_id),
 o AS (SELECT doc_id, count(out_bytes) AS replaced, CAST(sum(src_bytes - out_bytes) AS BIGINT) AS saved FROM outcomes GROUP BY doc_id),
 u AS (SELECT doc_id, count(*) AS deduped FROM dup GROUP BY doc_id), p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM v_pdf_placements GROUP BY doc_id)
 SELECT i.doc_id, coalesce(pages, 0) AS pages, images, image_bytes, coalesce(replaced, 0) AS replaced, coalesce(deduped, 0) AS deduped, coalesce(saved, 0) AS saved_bytes
 FROM i LEFT JOIN o USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN p USING (doc_id)""",
)
def _(spark, sf_dir):
    return pdf.pdf_summary(
        view(spark, sf_dir, "v_pdf_images"), _outcomes(spark, sf_dir), _dupes(spark, sf_dir),
        view(spark, sf_dir, "v_pdf_placements").select("doc_id", "page"),
    )


_LABEL = "CASE {0} WHEN 'no-decoder' THEN 'No decoder' WHEN 'cmyk' THEN 'CMYK' WHEN 'mask' THEN 'Mask' WHEN 'colorspace' THEN 'Colour space' WHEN 'too-small' THEN 'Too small' WHEN 'not-smaller' THEN 'No gain' WHEN 'error' THEN 'Failed' END"
_SAVED = "CAST(floor(CAST(i.src_bytes - o.out_bytes AS DOUBLE) / i.src_bytes * 100 + 0.5) AS BIGINT)"


@case(
    "outcome_table",
    f"""{_PICTURES}, {_DPI}, {_TARGET}, {_OUTCOMES} SELECT i.doc_id, i.ref, CASE WHEN coalesce(len(pages), 0) = 0 THEN '—' ELSE
  concat(array_to_string(list_transform(pages[:3], lambda p: p + 1), ', '), CASE WHEN len(pages) > 3 THEN concat(' +', len(pages) - 3) ELSE '' END) END AS pages_text,
  CASE WHEN i.skip IS NOT NULL THEN {_LABEL.format('i.skip')} WHEN i.out_w IS NOT NULL THEN concat('→ ', i.out_w, ' {report.TIMES} ', i.out_h) ELSE 'recompress' END AS plan,
  CASE WHEN o.out_bytes IS NOT NULL THEN {_sql_bytes('o.out_bytes')} ELSE coalesce({_LABEL.format('o.why')}, '—') END AS out_text,
  CASE WHEN o.out_bytes IS NOT NULL THEN {_sql_signed(_SAVED, report.MINUS)} ELSE '—' END AS saved_text,
  CASE WHEN o.out_bytes IS NOT NULL AND s IS NOT NULL THEN {sql_fixed('s', 3)} ELSE '—' END AS ssim_text
 FROM plan i LEFT JOIN outcomes o ON o.doc_id = i.doc_id AND o.ref = i.ref""",
)
def _(spark, sf_dir):
    """Each outcome also has an older row, which must not count."""
    now = _outcomes(spark, sf_dir).withColumn("seq", F.lit(2))
    old = now.withColumns({"seq": F.lit(1), "skip": F.lit("error"), "out_bytes": F.lit(None).cast("bigint")})
    return pdf.outcome_table(_planned(spark, sf_dir), now.unionByName(old))


# ------------------------------------------------------------------------------------ D3 replay

# One page per order: each line item saves, scales, draws and (mostly) restores. Lines with an odd
# number leave their save open until the line after, so states nest across lines.
def _page_ops(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS doc_id", "CAST(l_suppkey % 2 AS INT) AS page", "l_linenumber AS n", "l_partkey AS part",
        "l_quantity AS q", "l_tax AS t", "row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 2 ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS at",
    )
    num = lambda *v: F.array(*[F.col(x) if isinstance(x, str) else F.lit(float(x)) for x in v])
    none, blank = F.lit(None).cast("array<double>"), F.lit(None).cast("string")
    op = lambda i, o, a=none, n=blank: F.struct(F.lit(i).alias("i"), F.lit(o).alias("op"), a.alias("args"), n.alias("name"))
    ops = F.array(
        op(0, "q"), op(1, "cm", num("q", 0, 0, 2, "t", 1)),
        op(2, "Do", n=F.concat(F.lit("Im"), (F.col("part") % 3).cast("string"))), op(3, "Q"),
        op(4, "cm", num(1, 0, 0, 1, "q", "t")), op(5, "cm", F.slice(num(1, 2, 3), 1, 3)),
    )
    return line.select("doc_id", "page", "at", F.explode(ops).alias("o")).select(
        "doc_id", "page", (F.col("at") * 6 + F.col("o.i")).alias("op_no"), "o.op", "o.args", "o.name"
    )


def _owners(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("p"), (F.col("l_suppkey") % 2).cast("int").cast("string")).alias("owner")).distinct()


_DRAWN = """WITH l AS (SELECT l_orderkey AS doc_id, CAST(l_suppkey % 2 AS INTEGER) AS page, l_partkey AS part, l_quantity AS q, l_tax AS t,
  row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 2 ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS pos FROM lineitem),
 s AS (SELECT *, coalesce(sum(q) OVER w, 0) AS ox, coalesce(sum(t) OVER w, 0) AS oy FROM l WINDOW w AS (PARTITION BY doc_id, page ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 m AS (SELECT doc_id, page, part, q AS a, 0::DOUBLE AS b, 0::DOUBLE AS c, 2::DOUBLE AS d, t + ox AS e, 1 + oy AS f FROM s)"""


@case(
    "ctm_walk",
    f"""{_DRAWN},
 img AS (SELECT doc_id, page, 'Im0' AS name, 7 AS ref, a, b, c, d, e, f FROM m WHERE part % 3 = 0),
 frm AS (SELECT doc_id, page, 'Inner' AS name, 8 AS ref, 3 * a AS a, 0::DOUBLE AS b, 0::DOUBLE AS c, 3 * d AS d, 5 * a + e AS e, f FROM m WHERE part % 3 = 1)
 SELECT doc_id, page, name, ref, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(d, 6) AS d, round(e, 6) AS e, round(f, 6) AS f FROM (FROM img UNION ALL FROM frm)""",
)
def _(spark, sf_dir):
    """Im0 is an image, Im1 a form with a matrix that draws one, Im2 is unknown."""
    pages = _page_ops(spark, sf_dir)
    keys = _owners(spark, sf_dir)
    shift = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 1, 5, 0)])
    none = F.lit(None).cast("array<double>")
    named = F.array(
        F.struct(F.lit("Im0").alias("name"), F.lit("image").alias("kind"), F.lit(7).alias("ref"), none.alias("matrix")),
        F.struct(F.lit("Im1").alias("name"), F.lit("form").alias("kind"), F.lit(9).alias("ref"), shift.alias("matrix")),
    )
    docs = keys.select("doc_id").distinct()
    xobjects = keys.select("doc_id", "owner", F.explode(named).alias("x")).select("doc_id", "owner", "x.*").unionByName(
        docs.select("doc_id", F.lit("f9").alias("owner"), F.lit("Inner").alias("name"), F.lit("image").alias("kind"),
                    F.lit(8).alias("ref"), none.alias("matrix"))
    )
    triple = F.array(*[F.lit(float(v)) for v in (3, 0, 0, 3, 0, 0)])
    inner = F.array(
        F.struct(F.lit(0).alias("op_no"), F.lit("cm").alias("op"), triple.alias("args"), F.lit(None).cast("string").alias("name")),
        F.struct(F.lit(1).alias("op_no"), F.lit("Do").alias("op"), none.alias("args"), F.lit("Inner").alias("name")),
    )
    forms = docs.select("doc_id", F.lit(9).alias("form"), F.explode(inner).alias("o")).select("doc_id", "form", "o.*")
    found = drawing.ctm_walk(pages, forms, xobjects)
    return found.select("doc_id", "page", "name", "ref", *[F.round(c, 6).alias(c) for c in "abcdef"])


# Im1 is a form that draws a form that draws a form that draws the first again; each draws a picture
def _nested(spark, sf_dir):
    none, blank = F.lit(None).cast("array<double>"), F.lit(None).cast("string")
    num = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    thing = lambda owner, name, kind, ref, matrix=none: F.struct(
        owner.alias("owner"), F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(ref).alias("ref"), matrix.alias("matrix"))
    op = lambda form, i, o, args=none, name=blank: F.struct(
        F.lit(form).alias("form"), F.lit(i).alias("op_no"), F.lit(o).alias("op"), args.alias("args"), name.alias("name"))
    keys = _owners(spark, sf_dir)
    docs = keys.select("doc_id").distinct()
    inner, things = [], []
    for form, matrix, ref, then in ((9, num(3, 0, 0, 3, 0, 0), 8, 10), (10, num(2, 0, 0, 2, 0, 0), 10, 11), (11, num(1, 0, 0, 1, 0, 4), 12, 9)):
        inner += [op(form, 0, "cm", matrix), op(form, 1, "Do", name=F.lit("Pic")), op(form, 2, "Do", name=F.lit("Next"))]
        things += [thing(F.lit(f"f{form}"), "Pic", "image", ref), thing(F.lit(f"f{form}"), "Next", "form", then)]
    forms = docs.select("doc_id", F.explode(F.array(*inner)).alias("o")).select("doc_id", "o.*")
    first = keys.select("doc_id", thing(F.col("owner"), "Im1", "form", 9, num(1, 0, 0, 1, 5, 0)).alias("x"))
    rest = docs.select("doc_id", F.explode(F.array(*things)).alias("x"))
    return _page_ops(spark, sf_dir), forms, first.unionByName(rest).select("doc_id", "x.*")


@case(
    "ctm_walk_nested",
    f"""{_DRAWN}, f AS (SELECT doc_id, page, a, d, 5 * a + e AS e, f FROM m WHERE part % 3 = 1)
 SELECT doc_id, page, 'Pic' AS name, ref, round(k * a, 6) AS a, 0::DOUBLE AS b, 0::DOUBLE AS c, round(k * d, 6) AS d, round(e, 6) AS e, round(CASE WHEN ref = 12 THEN 24 * d ELSE 0 END + f, 6) AS f
 FROM f, (VALUES (8, 3), (10, 6), (12, 6)) AS pic(ref, k)""",
)
def _(spark, sf_dir):
    """Forms three deep, to any depth but never inside themselves."""
    found = drawing.ctm_walk(*_nested(spark, sf_dir), max_depth=None)
    return found.select("doc_id", "page", "name", "ref", *[F.round(c, 6).alias(c) for c in "abcdef"])


@case(
    "ctm_cut_draws",
    f"""{_DRAWN} SELECT DISTINCT doc_id, page, form, inner_form AS "inner", reason FROM m, (VALUES (11, 9, 'inside itself'), (9, 10, 'below 4')) AS cut(form, inner_form, reason) WHERE part % 3 = 1""",
)
def _(spark, sf_dir):
    """What is not followed without a depth limit, and with one of 4."""
    draws = drawing.form_draws(*_nested(spark, sf_dir))
    found = [drawing.cut_among(draws, d).withColumn("reason", F.lit(r)) for d, r in ((None, "inside itself"), (4, "below 4"))]
    return found[0].unionByName(found[1])


@case(
    "matrix_product",
    f"""{with_views('v_pdf_placements')} SELECT doc_id, page, ref, max(a * 2 + b * 3) AS a, max(a * 5 + b * 7) AS b, max(c * 2 + d * 3) AS c,
 max(c * 5 + d * 7) AS d, max(e * 2 + f * 3 + 11) AS e, max(e * 5 + f * 7 + 13) AS f FROM v_pdf_placements GROUP BY ALL""",
)
def _(spark, sf_dir):
    """Every draw matrix times (2, 5, 3, 7, 11, 13); the largest entries per page and image."""
    fixed = F.array(*[F.lit(float(v)) for v in (2, 5, 3, 7, 11, 13)])
    rows = view(spark, sf_dir, "v_pdf_placements").select(
        "doc_id", "page", "ref", drawing.multiply(F.array(*"abcdef"), fixed).alias("m")
    )
    return rows.groupBy("doc_id", "page", "ref").agg(
        *[F.max(F.get(F.col("m"), i)).alias(c) for i, c in enumerate("abcdef")]
    )
