"""PDF object tables: refusals, images, plans, outcomes, merging."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlane.functions.encoders import lookup
from assetlane.functions.numbers import dbl, js_round
from assetlane.functions.report import DASH, TIMES, format_bytes, format_savings, format_ssim
from assetlane.session import spread

# Known filters, the two that can be redone, the size floor.
KNOWN_FILTERS = [
    "DCTDecode", "FlateDecode", "JPXDecode", "CCITTFaxDecode", "JBIG2Decode", "LZWDecode",
    "RunLengthDecode",
]
REDOABLE_FILTERS = ["DCTDecode", "FlateDecode"]
MIN_IMAGE_BYTES = 4 * 1024
POINTS_PER_INCH = 72.0

# Labels and messages.
SKIP_LABELS = {
    "no-decoder": "No decoder", "cmyk": "CMYK", "mask": "Mask", "colorspace": "Colour space",
    "too-small": "Too small", "not-smaller": "No gain", "error": "Failed",
}
REFUSAL_MESSAGES = {
    "encrypted": "This PDF is encrypted — remove the password first.",
    "signed": "This PDF is digitally signed — compressing would break the signature.",
    "unreadable": "This is not a readable PDF.",
}


@dataclass(frozen=True)
class PdfSettings:
    """Defaults of a recompression run."""

    image_quality: int = 78
    target_dpi: float | None = 150
    max_pixels: int | None = 2400
    flate_to_jpeg: bool = True
    dedupe_images: bool = True
    strip_metadata: bool = True
    measure: bool = False


DEFAULTS = PdfSettings()


def pdf_refusals(docs: DataFrame, objects: DataFrame) -> DataFrame:
    """``(doc_id, refusal, message)`` for ``docs(doc_id, parsed, encrypted)``."""
    kind = F.col("type") == "/Sig" if "type" in objects.columns else F.lit(False)
    mark = (
        (F.coalesce(F.col("sig_flags"), F.lit(0)).bitwiseAND(F.lit(3)) != 0)
        | (F.col("ft") == "/Sig") | kind | F.col("has_byte_range")
    )
    signed = objects.groupBy("doc_id").agg(F.max(F.coalesce(mark, F.lit(False))).alias("signed"))
    refusal = (
        F.when(~F.col("parsed"), "unreadable").when(F.col("encrypted"), "encrypted")
        .when(F.col("signed"), "signed")
    )
    return docs.join(signed, "doc_id", "left").select(
        "doc_id", refusal.alias("refusal"), lookup(REFUSAL_MESSAGES, refusal).alias("message")
    )


def pdf_images(objects: DataFrame) -> DataFrame:
    """Image rows out of the raw object table.

    Input: (doc_id, obj_no, subtype, width, height, filters array<string>, color_space, bpc,
    is_mask, smask_ref, decode array<double>, src_bytes).
    """
    one = F.get(F.col("filters"), 0)
    known = (F.size("filters") == 1) & one.isin(KNOWN_FILTERS)
    odd = F.transform(
        "decode", lambda v, i: ~v.eqNullSafe(F.when(i % 2 == 0, dbl(0)).otherwise(dbl(1)))
    )
    is_mask = F.coalesce("is_mask", F.lit(False))
    return objects.where(F.col("subtype") == "/Image").select(
        "doc_id", F.col("obj_no").alias("ref"), F.coalesce("width", F.lit(0)).alias("width"),
        F.coalesce("height", F.lit(0)).alias("height"),
        F.when(known, one).otherwise("unknown").alias("filter"),
        F.coalesce("color_space", F.lit("")).alias("color_space"),
        F.coalesce(F.col("bpc"), F.when(is_mask, 1).otherwise(8)).alias("bpc"),
        F.col("smask_ref").isNotNull().alias("has_smask"), is_mask.alias("is_mask"),
        F.coalesce(F.exists(odd, lambda v: v), F.lit(False)).alias("custom_decode"), "src_bytes",
    )


def effective_dpi(placements: DataFrame, images: DataFrame) -> DataFrame:
    """``(doc_id, ref, pages, dpi)`` per image; never drawn -> empty pages, null dpi.

    ``placements`` holds (doc_id, page, ref, a..f, user_unit). Draws are reduced to their least
    extents per (image, user unit) before the image table is met: dividing by a smaller extent
    never gives a smaller quotient, so the largest dpi is among those. A logo drawn on every page
    is therefore a few rows after the map side.
    """
    wide = F.hypot(F.col("a"), F.col("b"))
    high = F.hypot(F.col("c"), F.col("d"))
    unit = F.col("user_unit")
    usable = unit.isNotNull() & ~F.isnan(unit) & (unit > 0) & (unit < dbl(float("inf")))
    draws = placements.select(
        "doc_id", "ref", "page", wide.alias("wide"), high.alias("high"),
        F.when(usable, unit).otherwise(dbl(1)).alias("unit"),
    ).withColumn("drawn", (F.col("wide") > 0) & (F.col("high") > 0))
    # pages are told apart before they are gathered: the set per image is its distinct pages
    least = draws.groupBy("doc_id", "ref", "unit").agg(
        F.min(F.when(F.col("drawn"), F.col("wide"))).alias("wide"),
        F.min(F.when(F.col("drawn"), F.col("high"))).alias("high"),
        F.collect_set("page").alias("pages"),
    )
    facts = images.select("doc_id", "ref", "width", "height")
    per_unit = facts.join(spread(least), ["doc_id", "ref"], "left")
    inch = dbl(POINTS_PER_INCH)
    dpi = F.greatest(
        F.col("width").cast("double") * inch / F.col("wide"),
        F.col("height").cast("double") * inch / F.col("high"),
    ) / F.col("unit")
    return per_unit.groupBy("doc_id", "ref").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"),
        F.max(F.when(dpi > 0, dpi)).alias("dpi"),
    )


def page_ranges(placements: DataFrame, block: int = 4096) -> DataFrame:
    """D4, page sets as ranges: ``(doc_id, ref, first, last)``, one row per run of pages an image is drawn on.

    Page numbers are cut into blocks of ``block``; the distinct pages of an image in a block (at most
    ``block`` of them) become runs in one cell, and only runs that touch a block's edge, two a block at most, meet
    in a window per image. So a logo on a million pages costs a few hundred rows there and is one row of the result.
    Repeated draws count once; rows without page or ref are left out; a null doc_id is a document too.
    """
    keys = ["doc_id", "ref"]
    pages = placements.where("page IS NOT NULL AND ref IS NOT NULL").select(*keys, F.col("page").cast("bigint").alias("page"))
    sets = pages.withColumn("block", F.floor(F.col("page") / F.lit(block))).groupBy(*keys, "block").agg(
        F.sort_array(F.collect_set("page")).alias("set"))
    at = F.col("set")
    begins = F.filter(at, lambda p, i: F.coalesce(F.get(at, i - 1) != p - 1, F.lit(True)))
    stops = F.filter(at, lambda p, i: F.coalesce(F.get(at, i + 1) != p + 1, F.lit(True)))
    runs = sets.select(*keys, "block", F.explode(F.arrays_zip(begins.alias("first"), stops.alias("last"))).alias("run")).select(
        *keys, "run.first", "run.last",
        ((F.col("run.first") == F.col("block") * block) | (F.col("run.last") == F.col("block") * block + block - 1)).alias("edge"))
    order = Window.partitionBy(*keys).orderBy("first")
    joined = runs.where("edge").withColumn("new", F.coalesce(F.col("first") != F.lag("last").over(order) + 1, F.lit(True)).cast("int"))
    merged = joined.withColumn("run", F.sum("new").over(order)).groupBy(*keys, "run").agg(
        F.min("first").alias("first"), F.max("last").alias("last")).drop("run")
    return runs.where("NOT edge").drop("edge").unionByName(merged)


def skip_reason_of(s: PdfSettings) -> Column:
    space, filt = F.col("color_space"), F.col("filter")
    flate_off = F.lit(not s.flate_to_jpeg) & (filt == "FlateDecode")
    return (
        F.when(F.col("is_mask"), "mask")
        .when(space == "/DeviceCMYK", "cmyk")
        .when(~filt.isin(REDOABLE_FILTERS) | flate_off, "no-decoder")
        .when(
            (F.col("bpc") != 8) | ~space.isin("/DeviceRGB", "/DeviceGray") | F.col("custom_decode"),
            "colorspace",
        )
        .when(F.col("src_bytes") < MIN_IMAGE_BYTES, "too-small")
    )


def skip_reason(images: DataFrame, settings: PdfSettings = DEFAULTS) -> DataFrame:
    """``+skip``, why an image is left alone; null when it is eligible."""
    return images.withColumn("skip", skip_reason_of(settings))


def resample_target(images: DataFrame, settings: PdfSettings = DEFAULTS) -> DataFrame:
    """``+out_w, +out_h``; null keeps the stored size. ``dpi`` null means never placed."""
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    longest, dpi = F.greatest(w, h), F.col("dpi")
    by_dpi = F.lit(None).cast("double") if settings.target_dpi is None else F.when(
        dpi > dbl(settings.target_dpi), dbl(settings.target_dpi) / dpi
    )
    by_cap = F.lit(None).cast("double") if settings.max_pixels is None else F.when(
        longest > dbl(settings.max_pixels), dbl(settings.max_pixels) / longest
    )
    scale = F.when(dpi.isNotNull(), by_dpi).otherwise(by_cap)
    one = F.lit(1).cast("bigint")
    out_w, out_h = F.greatest(one, js_round(w * scale)), F.greatest(one, js_round(h * scale))
    smaller = scale.isNotNull() & ((out_w < F.col("width")) | (out_h < F.col("height")))
    return images.withColumns(
        {"out_w": F.when(smaller, out_w), "out_h": F.when(smaller, out_h)}
    )


def resolve_outcomes(
    planned: DataFrame, encodes: DataFrame, refusals: DataFrame | None = None,
    settings: PdfSettings = DEFAULTS,
) -> DataFrame:
    """``(doc_id, ref, src_bytes, out_bytes, out_w, out_h, ssim, skip, error)``.

    ``planned`` carries D5 and D6 columns, ``encodes`` (doc_id, ref, enc_bytes, ssim, error). A
    stream is replaced only by a strictly smaller one. Refused documents have no outcomes.
    """
    if refusals is not None:
        refused = refusals.where(F.col("refusal").isNotNull()).select("doc_id")
        planned = planned.join(spread(refused), "doc_id", "left_anti")
    given = encodes.select(
        "doc_id", "ref", "enc_bytes", F.col("ssim").alias("__ssim"), F.col("error").alias("__error")
    )
    joined = planned.join(spread(given), ["doc_id", "ref"], "left")
    skipped = F.col("skip").isNotNull()
    failed = ~skipped & (F.col("__error").isNotNull() | F.col("enc_bytes").isNull())
    replaced = ~skipped & ~failed & (F.col("enc_bytes") < F.col("src_bytes"))
    measured = F.when(replaced & F.lit(settings.measure), F.col("__ssim"))
    return joined.select(
        "doc_id", "ref", "src_bytes", F.when(replaced, F.col("enc_bytes")).alias("out_bytes"),
        F.when(replaced, F.col("out_w")).alias("out_w"), F.when(replaced, F.col("out_h")).alias("out_h"),
        measured.alias("ssim"),
        F.when(skipped, F.col("skip")).when(failed, "error").when(~replaced, "not-smaller").alias("skip"),
        F.when(failed, F.coalesce("__error", F.lit("stream not found"))).alias("error"),
    )


SIGNATURE = ["width", "height", "bpc", "color_space", "filter", "smask_ref", "mask_ref", "decode"]


def dedupe_images(objects: DataFrame, contents: str = "contents") -> DataFrame:
    """``(doc_id, dup_ref, canonical_ref)`` of equal image streams within a document.

    Equal means the same signature, length, SHA-256 and SHA-512, both taken where a stream is read:
    digests, never streams, are shuffled, and combined on the map side.
    """
    image = objects.where(F.col("subtype") == "/Image")
    have = [c for c in SIGNATURE if c in objects.columns]
    body = F.col(contents).cast("binary")
    shape = F.to_json(F.struct(*have), {"ignoreNullFields": "false"})
    hashed = image.select(
        "doc_id", "obj_no", F.sha2(shape, 256).alias("shape"), F.octet_length(body).alias("len"),
        F.sha2(body, 256).alias("digest"), F.substring(F.sha2(body, 512), 1, 32).alias("proof"),
    )
    keys = ["doc_id", "shape", "len", "digest", "proof"]
    groups = hashed.groupBy(*keys).agg(
        F.min("obj_no").alias("canonical_ref"), F.count(F.lit(1)).alias("__n")
    ).where(F.col("__n") > 1).drop("__n")
    return hashed.join(spread(groups), keys).where(F.col("obj_no") != F.col("canonical_ref")).select(
        "doc_id", F.col("obj_no").alias("dup_ref"), "canonical_ref"
    )


def repoint_refs(edges: DataFrame, dup_map: DataFrame) -> DataFrame:
    """Consumers ``(doc_id, owner, slot, ref)`` with refs to duplicates made canonical."""
    renamed = dup_map.select("doc_id", F.col("dup_ref").alias("ref"), "canonical_ref")
    return edges.join(spread(renamed), ["doc_id", "ref"], "left").withColumn(
        "ref", F.coalesce("canonical_ref", "ref")
    ).select(*edges.columns)


def prune_objects(
    objects: DataFrame, dup_map: DataFrame, replaced: DataFrame, strip_metadata: bool = True
) -> DataFrame:
    """The objects that survive a rewrite.

    Duplicates, soft masks of ``replaced(doc_id, ref)`` images and, when stripping, the document
    metadata and page thumbnails go. The three sets are one anti-join.
    """
    duplicates = dup_map.select("doc_id", F.col("dup_ref").alias("obj_no"))
    masks = (
        objects.where(F.col("smask_ref").isNotNull())
        .select("doc_id", F.col("obj_no").alias("ref"), F.col("smask_ref").alias("obj_no"))
        .join(spread(replaced.select("doc_id", "ref")), ["doc_id", "ref"], "left_semi")
        .select("doc_id", "obj_no")
    )
    kept = objects
    if strip_metadata:
        kept = kept.where(~F.col("is_metadata") & ~F.col("is_thumb"))
    gone = duplicates.unionByName(masks)
    return kept.join(spread(gone), ["doc_id", "obj_no"], "left_anti").select(*objects.columns)


def pdf_summary(
    images: DataFrame, outcomes: DataFrame, dup_map: DataFrame | None = None,
    pages: DataFrame | None = None,
) -> DataFrame:
    """A4: ``(doc_id, pages, images, image_bytes, replaced, deduped, saved_bytes)``.

    Each input is reduced to one row per document before the joins.
    """
    zero = F.lit(0).cast("bigint")
    per_doc = images.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("images"), F.sum(F.col("src_bytes").cast("bigint")).alias("image_bytes")
    )
    done = outcomes.groupBy("doc_id").agg(
        F.count("out_bytes").alias("replaced"),
        F.sum(F.when(F.col("out_bytes").isNotNull(), F.col("src_bytes") - F.col("out_bytes")))
        .cast("bigint").alias("saved_bytes"),
    )
    out = per_doc.join(spread(done), "doc_id", "left")
    if dup_map is not None:
        out = out.join(
            spread(dup_map.groupBy("doc_id").agg(F.count(F.lit(1)).alias("deduped"))), "doc_id", "left"
        )
    if pages is not None:
        out = out.join(
            spread(pages.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))), "doc_id", "left"
        )
    have = set(out.columns)
    count = lambda c: (F.coalesce(F.col(c), zero) if c in have else zero).alias(c)
    return out.select(
        "doc_id", count("pages"), "images", "image_bytes", count("replaced"), count("deduped"),
        count("saved_bytes"),
    )


def pages_text(pages: Column) -> Column:
    """``1, 2, 3 +n`` from zero-based pages; a dash for none."""
    shown = F.array_join(
        F.transform(F.slice(pages, 1, 3), lambda p: (p + 1).cast("string")), ", "
    )
    rest = F.size(pages) - 3
    return F.when(F.coalesce(F.size(pages), F.lit(0)) <= 0, DASH).when(
        rest > 0, F.concat(shown, F.lit(" +"), rest.cast("string"))
    ).otherwise(shown)


def outcome_table(images: DataFrame, outcomes: DataFrame, seq: str = "seq") -> DataFrame:
    """Per image ``(doc_id, ref, pages_text, plan, out_text, saved_text, ssim_text)``.

    ``images`` carries pages and the D5/D6 columns; the last outcome of a ref (by ``seq``) counts.
    """
    last = outcomes.groupBy("doc_id", "ref").agg(
        F.max_by(F.struct("out_bytes", "skip", "ssim"), seq).alias("o")
    )
    joined = images.join(spread(last), ["doc_id", "ref"], "left")
    target = F.concat(
        F.lit("→ "), F.col("out_w").cast("string"), F.lit(f" {TIMES} "), F.col("out_h").cast("string")
    )
    out, skipped = F.col("o.out_bytes"), lookup(SKIP_LABELS, F.col("o.skip"))
    return joined.select(
        "doc_id", "ref", pages_text(F.col("pages")).alias("pages_text"),
        F.when(F.col("skip").isNotNull(), lookup(SKIP_LABELS, F.col("skip")))
        .when(F.col("out_w").isNotNull(), target).otherwise("recompress").alias("plan"),
        F.when(out.isNotNull(), format_bytes(out)).otherwise(F.coalesce(skipped, F.lit(DASH)))
        .alias("out_text"),
        F.when(out.isNotNull(), format_savings(F.col("src_bytes"), out)).otherwise(DASH).alias("saved_text"),
        format_ssim(F.col("o.ssim")).alias("ssim_text"),
    )
