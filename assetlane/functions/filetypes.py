"""What a file is: type evidence, HDR marks, colour space, SVG size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlane.functions.encoders import lookup
from assetlane.functions.paths import trim_ws

# Bytes read for typing and for HDR marks.
SNIFF_BYTES = 32
HDR_BYTES = 256 * 1024

# Magic rules in order, over the first bytes read as latin-1.
MAGIC_RULES = [
    (r"^%PDF-", "application/pdf"),
    (r"^GIF87a", "image/gif"),
    (r"^GIF89a", "image/gif"),
    (r"^\x89PNG\x0D\x0A\x1A\x0A", "image/png"),
    (r"^\xFF\xD8\xFF", "image/jpeg"),
    (r"^BM", "image/bmp"),
    (r"^I I", "image/tiff"),
    (r"^II\*", "image/tiff"),
    (r"^MM\x00\*", "image/tiff"),
    (r"(?s)^RIFF....WEBPVP8[LX ]", "image/webp"),
    (r"^\x00\x00\x00 ftypavif\x00\x00\x00\x00", "image/avif"),
    (r"(?s)^....ftyp(?:heic|heix|hevc|hevx|heim|heis|hevm|hevs)", "image/heic"),
    (r"(?s)^....ftyp(?:mif1|msf1|heif)", "image/heif"),
    (r"^\xFF\x0A", "image/jxl"),
    (r"^\x00\x00\x00\x0CJXL \x0D\x0A\x87\x0A", "image/jxl"),
    (r"^qoif", "image/qoi"),
    (r"(?i)^[\s\xA0]*<svg[\s\xA0>]", "image/svg+xml"),
    (r"(?is)^[\s\xA0]*<\?xml.*?<svg[\s\xA0>]", "image/svg+xml"),
]

# Image types a declared type may name.
IMAGE_TYPES = [
    "image/png", "image/jpeg", "image/webp", "image/avif", "image/jxl", "image/gif", "image/bmp",
    "image/tiff", "image/qoi", "image/heic", "image/heif", "image/svg+xml",
]

# Type by file extension.
TYPE_BY_EXTENSION = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "jpe": "image/jpeg",
    "webp": "image/webp", "avif": "image/avif", "jxl": "image/jxl", "gif": "image/gif",
    "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "qoi": "image/qoi",
    "heic": "image/heic", "heif": "image/heif", "svg": "image/svg+xml",
}

# Container types that carry colour boxes, and gain map marks in any container.
BOXED_TYPES = ["image/avif", "image/heic", "image/heif"]
GAIN_MAP_MARKS = [
    "hdrgm:Version", "urn:iso:std:iso:ts:21496", "urn:com:apple:photo:2020:aux:hdrgainmap",
]
TRANSFER_KINDS = {16: "pq", 18: "hlg"}
HDR_LABELS = {"pq": "HDR (PQ)", "hlg": "HDR (HLG)", "gainmap": "HDR (gain map)"}
WIDE_PRIMARIES = [9, 11, 12]


def latin1(data: Column, n: int) -> Column:
    return F.decode(F.substring(data, 1, n), "ISO-8859-1")


def magic_type(head: Column) -> Column:
    """First matching magic rule over the leading bytes, '' when none matches."""
    text = latin1(head, SNIFF_BYTES)
    chain = None
    for pattern, mime in MAGIC_RULES:
        hit = text.rlike(pattern)
        chain = F.when(hit, mime) if chain is None else chain.when(hit, mime)
    return chain.otherwise("")


def declared_type(declared: Column) -> Column:
    """The declared type before ';' when it is a known image type, else ''."""
    bare = trim_ws(F.substring_index(declared, ";", 1))
    return F.when(bare.isin(IMAGE_TYPES), bare).otherwise("")


def name_type(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)\z", 1))
    return F.coalesce(lookup(TYPE_BY_EXTENSION, ext), F.lit(""))


def looks_like_image(declared: Column, name: Column) -> Column:
    return declared.startswith("image/") | (name_type(name) != "")


def looks_like_pdf(declared: Column, name: Column) -> Column:
    return (declared == "application/pdf") | F.lower(name).endswith(".pdf")


def resolve_mime(
    df: DataFrame, head: str = "head", declared: str = "declared", name: str = "name",
    order: str = "editor",
) -> DataFrame:
    """``+mime, +mime_source, +unsupported``.

    ``order="editor"`` trusts magic, declared type, extension; ``order="batch"`` trusts magic,
    extension, then any declared ``image/*``; ``order="exact"`` trusts magic, the declared type where it is, as
    it stands, one of the known image types (no parameters, no blanks, no other case), then extension.
    """
    dec = F.coalesce(F.col(declared), F.lit(""))
    by_magic = "__magic"
    df = df.withColumn(by_magic, magic_type(F.col(head)))
    magic = F.col(by_magic)
    ext = name_type(F.coalesce(F.col(name), F.lit("")))
    if order == "editor":
        second, third = (declared_type(dec), "file-type"), (ext, "extension")
    elif order == "batch":
        any_image = F.when(dec.startswith("image/"), dec).otherwise("")
        second, third = (ext, "extension"), (any_image, "file-type")
    elif order == "exact":
        known = F.when(dec.isin(IMAGE_TYPES), dec).otherwise("")
        second, third = (known, "file-type"), (ext, "extension")
    else:
        raise ValueError("order must be 'editor', 'batch' or 'exact'")
    pdf = magic == "application/pdf"
    mime = (
        F.when(pdf, "").when(magic != "", magic).when(second[0] != "", second[0]).otherwise(third[0])
    )
    source = (
        F.when(magic != "", "magic-number").when(second[0] != "", second[1])
        .when(third[0] != "", third[1]).otherwise("unknown")
    )
    return df.withColumns(
        {"mime": mime, "mime_source": source,
         "unsupported": F.when(pdf, "application/pdf")}
    ).drop(by_magic)


def mime_census(
    df: DataFrame, size: Column, declared: str = "declared", name: str = "name"
) -> DataFrame:
    """Files per evidence, and how many disagree with their declared type or extension.

    Input is the result of :func:`resolve_mime`; ``size`` is the byte size of a file.
    """
    said = declared_type(F.coalesce(F.col(declared), F.lit("")))
    named = name_type(F.coalesce(F.col(name), F.lit("")))
    mime = F.col("mime")
    wrong = (mime != "") & (((said != "") & (said != mime)) | ((named != "") & (named != mime)))
    return df.groupBy("mime", "mime_source").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(size.cast("bigint")).alias("bytes"),
        F.count_if(wrong).alias("mismatched"),
    )


def _box_number(data: Column, offset: int) -> Column:
    """The 16-bit number ``offset`` bytes after the first 'colrnclx' mark, null when cut off."""
    at = F.instr(F.decode(data, "ISO-8859-1"), "colrnclx")
    complete = (at > 0) & (F.length(data) >= at + F.lit(11))
    return F.when(
        complete, F.conv(F.hex(F.substring(data, at + F.lit(8 + offset), F.lit(2))), 16, 10).cast("int")
    )


def _searched(head: str, scan_bytes: int | None) -> Column:
    return F.col(head) if scan_bytes is None else F.substring(head, 1, scan_bytes)


def hdr_flags(df: DataFrame, head: str = "head", mime: str = "mime", scan_bytes: int | None = None) -> DataFrame:
    """``+hdr_kind, +hdr_label``, from all bytes of ``head`` or its first ``scan_bytes``.

    The application looks at ``HDR_BYTES``: read that much with ``read_heads``, or pass it here.
    """
    data = _searched(head, scan_bytes)
    boxed = F.col(mime).isin(BOXED_TYPES)
    transfer = F.when(boxed, _box_number(data, 2))
    marked = F.lit(False)
    for mark in GAIN_MAP_MARKS:
        marked = marked | F.contains(data, F.lit(mark.encode()))
    kind = F.coalesce(lookup(TRANSFER_KINDS, transfer), F.when(marked, "gainmap"))
    return df.withColumns({"hdr_kind": kind, "hdr_label": lookup(HDR_LABELS, kind)})


def gamut_space(df: DataFrame, head: str = "head", mime: str = "mime", scan_bytes: int | None = None) -> DataFrame:
    """C4: ``+color_space``; ``scan_bytes`` as in :func:`hdr_flags`."""
    primaries = F.when(F.col(mime).isin(BOXED_TYPES), _box_number(_searched(head, scan_bytes), 0))
    return df.withColumn(
        "color_space", F.when(primaries.isin(WIDE_PRIMARIES), "display-p3").otherwise("srgb")
    )


_ROOT = (
    r"(?is)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!doctype[^>\[]*(?:\[.*?\]\s*)?>\s*)*"
    r"<([a-z_][\w:.\-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
)


def svg_size(df: DataFrame, svg_text: str = "svg_text") -> DataFrame:
    """``+width, +height, +size_error``; sizes stay text, as written."""
    text = F.col(svg_text)
    root, attrs = F.regexp_extract(text, _ROOT, 1), F.regexp_extract(text, _ROOT, 2)

    def attr(name: str) -> Column:
        quoted = rf"(?s)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
        return F.when(
            attrs.rlike(quoted),
            F.concat(F.regexp_extract(attrs, quoted, 1), F.regexp_extract(attrs, quoted, 2)),
        )

    wide, high, box = attr("width"), attr("height"), attr("viewBox")
    parts = F.split(trim_ws(box), r"[\s,]+", -1)
    box_w = F.nullif(F.get(parts, 2), F.lit(""))
    box_h = F.nullif(F.get(parts, 3), F.lit(""))
    sized = wide.isNotNull() & high.isNotNull()
    error = (
        F.when(root == "", "unparsable").when(F.lower(root) != "svg", "not-svg").when(sized, None)
        .when(box.isNull(), "no-size").when(box_w.isNull() | box_h.isNull(), "bad-viewbox")
    )
    ok = error.isNull()
    return df.withColumns(
        {
            "width": F.when(ok, F.when(sized, wide).otherwise(box_w)),
            "height": F.when(ok, F.when(sized, high).otherwise(box_h)),
            "size_error": error,
        }
    )
