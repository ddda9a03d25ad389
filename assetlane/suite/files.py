"""Queries on files: intake, typing, names (S, C1-C9)."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from assetlane.functions import filetypes, paths
from assetlane.functions.encoders import ENCODERS, encoder_dim, _FIELDS
from assetlane.operators import intake
from assetlane.session import scratch_folder
from assetlane.sources.assets import read_heads, scan_assets
from assetlane.suite.fixtures import read, view, with_views
from assetlane.suite.registry import case

_BASE = "regexp_extract(replace(path, '\\', '/'), '([^/]*)$', 1)"
_SAFE = (
    "array_to_string(list_filter(list_transform(string_split(regexp_replace(replace(path, '\\', '/'), "
    "'^[a-zA-Z]:', ''), '/'), lambda s: trim(s)), lambda s: s NOT IN ('', '.', '..')), '/')"
)
_EXT_TYPES = "|".join(filetypes.TYPE_BY_EXTENSION)
_IMAGE_NAME = f"regexp_matches({{0}}, '(?i)\\.({_EXT_TYPES})$')"


PAGES_PER_FILE = 256


def page_files(spark, sf_dir, name):
    """The pages as plain files of 8 folders, at most ``PAGES_PER_FILE`` in each: a page is a line.

    Files of a folder follow each other by task and file number (``page_folders``).
    """
    folder = scratch_folder(spark, name)
    pages = read(spark, sf_dir, "pages").select("html", "page_id", (F.col("page_id") % 8).alias("shard"))
    (pages.repartitionByRange("shard", "page_id").sortWithinPartitions("shard", "page_id")
     .select(F.lower(F.hex(F.encode("html", "utf-8"))).alias("value"), "shard")
     .write.option("maxRecordsPerFile", PAGES_PER_FILE).partitionBy("shard").text(folder))
    return folder


def _digests(batches):
    """Rows (folder, content) sorted by folder to one digest of each folder; holds a running hash only."""
    folder, running = None, None
    for batch in batches:
        for at, content in zip(batch.column("folder").to_pylist(), batch.column("content")):
            if running is not None and at != folder:
                yield pa.RecordBatch.from_pydict({"folder": [folder], "digest": [running.hexdigest()]})
                running = None
            folder, running = at, running or hashlib.sha256()
            running.update(content.as_buffer())
    if running is not None:
        yield pa.RecordBatch.from_pydict({"folder": [folder], "digest": [running.hexdigest()]})


def page_folders(files):
    """Folders of ``page_files`` as one text each: (folder, digest), from rows (rel_path, content).

    A SHA-256 is taken in order, so the files of a folder pass one task, as a sorted stream.
    """
    number = [F.regexp_extract("rel_path", p, 1).cast("bigint") for p in (r"/part-(\d+)-[^/]*$", r"\.c(\d+)\.txt$")]
    rows = files.select(F.regexp_extract("rel_path", "^([^/]*)/[^/]*$", 1).alias("folder"), number[0].alias("task"),
                        number[1].alias("nth"), "content")
    ordered = rows.repartition("folder").sortWithinPartitions("folder", "task", "nth").select("folder", "content")
    return ordered.mapInArrow(_digests, "folder string, digest string")


PAGE_FILES = """SELECT concat('shard=', CAST(page_id % 8 AS VARCHAR)) AS folder,
 string_agg(concat(lower(hex(encode(html))), chr(10)), '' ORDER BY page_id) AS text FROM pages GROUP BY page_id % 8"""


@case("scan_assets", f"SELECT folder, CAST(1 AS INTEGER) AS depth, CAST(length(text) AS BIGINT) AS bytes, sha256(text) AS digest FROM ({PAGE_FILES})")
def _(spark, sf_dir):
    """Files written from the pages, found and read again; the files of a folder put together."""
    files = scan_assets(spark, page_files(spark, sf_dir, "scan"), glob="*.txt")
    folder = F.regexp_extract("rel_path", "^([^/]*)/[^/]*$", 1).alias("folder")
    sizes = files.groupBy(folder, "depth").agg(F.sum("bytes").alias("bytes"))
    return sizes.join(page_folders(files), "folder").select("folder", "depth", "bytes", "digest")


@case("scan_heads", """SELECT chunk, CAST(length(text) AS BIGINT) AS bytes, substr(text, 1, 64) AS head FROM (
 SELECT page_id // 32 AS chunk, string_agg(concat(lower(hex(encode(html))), chr(10)), '' ORDER BY page_id) AS text FROM pages GROUP BY 1)""")
def _(spark, sf_dir):
    """Files of 32 pages each, typed by their first bytes without reading the rest."""
    folder = scratch_folder(spark, "heads")
    pages = read(spark, sf_dir, "pages").selectExpr("lower(hex(encode(html, 'utf-8'))) AS value", "page_id", "page_id div 32 AS chunk")
    (pages.repartition("chunk").sortWithinPartitions("chunk", "page_id").select("value", "chunk")
     .write.partitionBy("chunk").text(folder))
    heads = read_heads(spark, folder, 64, glob="*.txt")
    return heads.select(F.regexp_extract("rel_path", r"^chunk=(-?\d+)/", 1).cast("bigint").alias("chunk"), "bytes",
                        F.decode("head", "UTF-8").alias("head"))


_TAKEN = f"""{with_views('v_files')}, t AS (SELECT *, coalesce(nullif({_SAFE}, ''), path) AS taken_path FROM v_files),
 k AS (SELECT *, regexp_extract(taken_path, '([^/]*)$', 1) AS base FROM t),
 ok AS (SELECT * FROM k WHERE base NOT IN ('__MACOSX', '.DS_Store', 'Thumbs.db', 'desktop.ini') AND base NOT LIKE '.%'
  AND (declared LIKE 'image/%' OR {_IMAGE_NAME.format('taken_path')}) {{extra}})
 SELECT seq, drop_id, path, declared, bytes, mtime_ms, taken_path, bytes > 52428800 AS oversize FROM ok {{cap}}"""
_FIRST = "QUALIFY row_number() OVER (PARTITION BY drop_id ORDER BY seq) <= 3"


@case("intake_filter", _TAKEN.format(extra="", cap=""))
def _(spark, sf_dir):
    return intake.intake_filter(view(spark, sf_dir, "v_files"))


@case("intake_filter_capped", _TAKEN.format(extra="AND bytes <= 52428800", cap=_FIRST))
def _(spark, sf_dir):
    return intake.intake_filter(view(spark, sf_dir, "v_files"), max_files=3, max_bytes=intake.MAX_FILE_BYTES, chunk_rows=1000)


@case(
    "intake_folder_walk",
    _TAKEN.format(
        extra="AND NOT list_bool_or(list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), "
        "lambda s: s LIKE '.%' OR s IN ('__MACOSX', '.DS_Store', 'Thumbs.db', 'desktop.ini')))",
        cap="",
    ),
)
def _(spark, sf_dir):
    return intake.intake_filter(view(spark, sf_dir, "v_files"), folder_walk=True)


@case(
    "partition_by_size",
    f"""{with_views('v_files')} SELECT *, bytes <= CASE WHEN declared = 'application/pdf' OR lower({_BASE}) LIKE '%.pdf'
 THEN 157286400 ELSE 52428800 END AS accepted FROM v_files""",
)
def _(spark, sf_dir):
    return intake.partition_by_size(view(spark, sf_dir, "v_files"))


@case(
    "oversize_names",
    f"""{with_views('v_files')}, o AS (SELECT drop_id, seq, {_BASE} AS name FROM v_files
 WHERE bytes > 52428800 AND (declared LIKE 'image/%' OR {_IMAGE_NAME.format(_BASE)})),
 n AS (SELECT *, row_number() OVER (PARTITION BY drop_id ORDER BY seq) AS position FROM o)
 SELECT drop_id, position, name FROM n""",
)
def _(spark, sf_dir):
    return intake.oversize_names(view(spark, sf_dir, "v_files"), chunk_rows=1000)


@case(
    "route_drops",
    f"""{with_views('v_files')}, f AS (SELECT drop_id, seq, bytes, {_BASE} AS name,
  declared = 'application/pdf' OR lower({_BASE}) LIKE '%.pdf' AS pdf,
  declared LIKE 'image/%' OR {_IMAGE_NAME.format(_BASE)} AS image FROM v_files),
 d AS (SELECT drop_id, count(*) FILTER (pdf) AS np, count(*) FILTER (NOT pdf) AS nr,
  count(*) FILTER (NOT pdf AND image AND bytes <= 52428800) AS ni,
  count(*) FILTER (NOT pdf AND image AND bytes > 52428800) AS no,
  arg_min(name, seq) FILTER (pdf) AS first_name, arg_min(bytes, seq) FILTER (pdf) AS first_bytes FROM f GROUP BY drop_id),
 r AS (SELECT *, np > 0 AND nr = 0 AS only_pdf, coalesce(first_bytes > 157286400, false) AS big FROM d)
 SELECT drop_id, CASE WHEN only_pdf AND big THEN 'none' WHEN only_pdf THEN 'pdf' WHEN ni = 0 THEN 'none' WHEN ni = 1 THEN 'editor' ELSE 'queue' END AS route,
  CASE WHEN only_pdf THEN 0 ELSE ni END AS n_images, CASE WHEN only_pdf THEN 0 ELSE no END AS n_oversize,
  CASE WHEN only_pdf AND NOT big THEN first_name END AS pdf,
  CASE WHEN only_pdf AND big THEN concat('Skipped (over 150 MB): ', first_name)
   WHEN only_pdf AND np > 1 THEN 'One PDF at a time — opened the first.' WHEN only_pdf THEN NULL
   WHEN np > 0 AND no > 0 THEN concat('Drop a PDF on its own to compress it. · Skipped (over 50 MB): ', no)
   WHEN np > 0 THEN 'Drop a PDF on its own to compress it.' WHEN no > 0 THEN concat('Skipped (over 50 MB): ', no)
   WHEN ni = 0 THEN 'No readable images in that drop.' END AS note FROM r""",
)
def _(spark, sf_dir):
    return intake.route_drops(view(spark, sf_dir, "v_files"))


@case(
    "dedupe_intake",
    f"""{with_views('v_files')}, f AS (SELECT *, {_BASE} AS name FROM v_files)
 SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY name, bytes, mtime_ms ORDER BY seq) = 1""",
)
def _(spark, sf_dir):
    return intake.dedupe_intake(view(spark, sf_dir, "v_files"))


@case(
    "sweep_stale_sessions",
    """WITH s AS (SELECT 1704067200000 + event_id * 20000 AS ms, event_id FROM events),
 n AS (SELECT CASE WHEN event_id % 10 = 3 THEN concat('tmp-', CAST(event_id AS VARCHAR)) ELSE concat('session-', lower(to_base(ms, 36)), '-', CAST(event_id AS VARCHAR)) END AS name,
  CASE WHEN event_id % 10 <> 3 THEN ms END AS started_ms FROM s)
 SELECT name, started_ms, started_ms IS NULL OR 1704167200000 - started_ms > 43200000 AS stale FROM n""",
)
def _(spark, sf_dir):
    ms = F.lit(1704067200000).cast("bigint") + F.col("event_id") * 20000
    key = F.col("event_id").cast("string")
    session = F.concat(F.lit("session-"), F.lower(F.conv(ms.cast("string"), 10, 36)), F.lit("-"), key)
    dirs = read(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 10 == 3, F.concat(F.lit("tmp-"), key)).otherwise(session).alias("name")
    )
    return intake.sweep_stale_sessions(dirs, F.lit(1704167200000).cast("bigint"))


# ------------------------------------------------------------------------------- C1-C5 typing

_WS = "(09|0A|0B|0C|0D|20|A0)"
_MAGIC = f"""CASE WHEN h LIKE '255044462D%' THEN 'application/pdf' WHEN h LIKE '474946383761%' OR h LIKE '474946383961%' THEN 'image/gif'
 WHEN h LIKE '89504E470D0A1A0A%' THEN 'image/png' WHEN h LIKE 'FFD8FF%' THEN 'image/jpeg' WHEN h LIKE '424D%' THEN 'image/bmp'
 WHEN h LIKE '492049%' OR h LIKE '49492A%' OR h LIKE '4D4D002A%' THEN 'image/tiff'
 WHEN regexp_matches(h, '^52494646.{{8}}57454250565038(4C|58|20)') THEN 'image/webp'
 WHEN h LIKE '00000020667479706176696600000000%' THEN 'image/avif'
 WHEN regexp_matches(h, '^.{{8}}66747970(68656963|68656978|68657663|68657678|6865696D|68656973|6865766D|68657673)') THEN 'image/heic'
 WHEN regexp_matches(h, '^.{{8}}66747970(6D696631|6D736631|68656966)') THEN 'image/heif'
 WHEN h LIKE 'FF0A%' OR h LIKE '0000000C4A584C200D0A870A%' THEN 'image/jxl' WHEN h LIKE '716F6966%' THEN 'image/qoi'
 WHEN regexp_matches(h, '^{_WS}*3C[57]3[57]6[46]7({_WS}|3E)') THEN 'image/svg+xml' ELSE '' END"""
_TYPES = ", ".join(f"'{t}'" for t in filetypes.IMAGE_TYPES)
_BY_EXT = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in filetypes.TYPE_BY_EXTENSION.items())
_EVIDENCE = f"""{with_views('v_heads')}, e0 AS (SELECT *, substr(head_hex, 1, 64) AS h FROM v_heads),
 e AS (SELECT file_id, head_hex, declared, name, {_MAGIC} AS m,
  CASE WHEN trim(split_part(declared, ';', 1)) IN ({_TYPES}) THEN trim(split_part(declared, ';', 1)) ELSE '' END AS d,
  coalesce(CASE lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) {_BY_EXT} END, '') AS x FROM e0),
 r AS (SELECT *, CASE WHEN m = 'application/pdf' THEN '' WHEN m <> '' THEN m WHEN d <> '' THEN d ELSE x END AS mime,
  CASE WHEN m <> '' THEN 'magic-number' WHEN d <> '' THEN 'file-type' WHEN x <> '' THEN 'extension' ELSE 'unknown' END AS mime_source,
  CASE WHEN m = 'application/pdf' THEN m END AS unsupported FROM e)"""


def _heads(spark, sf_dir):
    return view(spark, sf_dir, "v_heads").withColumn("head", F.unhex("head_hex"))


@case("resolve_mime", f"{_EVIDENCE} SELECT file_id, mime, mime_source, unsupported FROM r")
def _(spark, sf_dir):
    return filetypes.resolve_mime(_heads(spark, sf_dir)).select(
        "file_id", "mime", "mime_source", "unsupported"
    )


@case(
    "resolve_mime_batch",
    f"""{_EVIDENCE} SELECT file_id, CASE WHEN m = 'application/pdf' THEN '' WHEN m <> '' THEN m WHEN x <> '' THEN x WHEN declared LIKE 'image/%' THEN declared ELSE '' END AS mime,
 CASE WHEN m <> '' THEN 'magic-number' WHEN x <> '' THEN 'extension' WHEN declared LIKE 'image/%' THEN 'file-type' ELSE 'unknown' END AS mime_source, unsupported FROM r""",
)
def _(spark, sf_dir):
    return filetypes.resolve_mime(_heads(spark, sf_dir), order="batch").select(
        "file_id", "mime", "mime_source", "unsupported"
    )


@case(
    "resolve_mime_exact",
    f"""{_EVIDENCE}, v AS (SELECT *, CASE file_id % 4 WHEN 0 THEN concat(declared, '; q=1') WHEN 1 THEN upper(declared) ELSE declared END AS said FROM r),
 k AS (SELECT *, CASE WHEN said IN ({_TYPES}) THEN said ELSE '' END AS t FROM v)
 SELECT file_id, CASE WHEN m = 'application/pdf' THEN '' WHEN m <> '' THEN m WHEN t <> '' THEN t ELSE x END AS mime,
 CASE WHEN m <> '' THEN 'magic-number' WHEN t <> '' THEN 'file-type' WHEN x <> '' THEN 'extension' ELSE 'unknown' END AS mime_source, unsupported FROM k""",
)
def _(spark, sf_dir):
    """Declared types partly with parameters or in upper case, which only the editor's order reads."""
    said = F.expr("CASE file_id % 4 WHEN 0 THEN concat(declared, '; q=1') WHEN 1 THEN upper(declared) ELSE declared END")
    return filetypes.resolve_mime(_heads(spark, sf_dir).withColumn("declared", said), order="exact").select(
        "file_id", "mime", "mime_source", "unsupported"
    )


@case(
    "mime_census",
    f"""{_EVIDENCE} SELECT mime, mime_source, count(*) AS n, CAST(sum(length(head_hex) // 2) AS BIGINT) AS bytes,
 count(*) FILTER (mime <> '' AND ((d <> '' AND d <> mime) OR (x <> '' AND x <> mime))) AS mismatched FROM r GROUP BY mime, mime_source""",
)
def _(spark, sf_dir):
    return filetypes.mime_census(
        filetypes.resolve_mime(_heads(spark, sf_dir)), F.octet_length("head")
    )


_NCLX = f"""{_EVIDENCE}, p AS (SELECT *, CASE WHEN mime IN ('image/avif', 'image/heic', 'image/heif') THEN regexp_extract(head_hex, '636F6C726E636C78(.{{8}})', 1) ELSE '' END AS nclx FROM r),
 k AS (SELECT file_id, nclx, CASE WHEN substr(nclx, 5, 4) = '0010' THEN 'pq' WHEN substr(nclx, 5, 4) = '0012' THEN 'hlg'
  WHEN contains(head_hex, '686472676D3A56657273696F6E') THEN 'gainmap' END AS hdr_kind FROM p)"""


@case(
    "hdr_flags",
    f"{_NCLX} SELECT file_id, hdr_kind, CASE hdr_kind WHEN 'pq' THEN 'HDR (PQ)' WHEN 'hlg' THEN 'HDR (HLG)' WHEN 'gainmap' THEN 'HDR (gain map)' END AS hdr_label FROM k",
)
def _(spark, sf_dir):
    typed = filetypes.resolve_mime(_heads(spark, sf_dir))
    return filetypes.hdr_flags(typed).select("file_id", "hdr_kind", "hdr_label")


@case(
    "gamut_space",
    f"{_NCLX} SELECT file_id, CASE WHEN substr(nclx, 1, 4) IN ('0009', '000B', '000C') THEN 'display-p3' ELSE 'srgb' END AS color_space FROM k",
)
def _(spark, sf_dir):
    typed = filetypes.resolve_mime(_heads(spark, sf_dir))
    return filetypes.gamut_space(typed).select("file_id", "color_space")


@case(
    "svg_size",
    f"""{with_views('v_svg')}, t AS (SELECT image_id, regexp_extract(svg_text, '^(?:<\\?[^>]*\\?>)?<([a-z]+)([^>]*)>', 1) AS tag,
  regexp_extract(svg_text, '^(?:<\\?[^>]*\\?>)?<([a-z]+)([^>]*)>', 2) AS attrs FROM v_svg),
 a AS (SELECT *, nullif(regexp_extract(attrs, ' width="([^"]*)"', 1), '') AS w, nullif(regexp_extract(attrs, ' height="([^"]*)"', 1), '') AS h,
  nullif(regexp_extract(attrs, ' viewBox="([^"]*)"', 1), '') AS vb FROM t),
 b AS (SELECT *, regexp_split_to_array(vb, '[ ,]+') AS parts FROM a),
 c AS (SELECT *, CASE WHEN tag = '' THEN 'unparsable' WHEN tag <> 'svg' THEN 'not-svg' WHEN w IS NOT NULL AND h IS NOT NULL THEN NULL
  WHEN vb IS NULL THEN 'no-size' WHEN parts[3] IS NULL OR parts[4] IS NULL THEN 'bad-viewbox' END AS size_error FROM b)
 SELECT image_id, CASE WHEN size_error IS NULL THEN CASE WHEN w IS NOT NULL AND h IS NOT NULL THEN w ELSE parts[3] END END AS width,
  CASE WHEN size_error IS NULL THEN CASE WHEN w IS NOT NULL AND h IS NOT NULL THEN h ELSE parts[4] END END AS height, size_error FROM c""",
)
def _(spark, sf_dir):
    return filetypes.svg_size(view(spark, sf_dir, "v_svg")).select(
        "image_id", "width", "height", "size_error"
    )


_DIM_ROWS = ", ".join(
    f"('{e[0]}', {i}, '{e[1]}', '{e[2]}', '{e[3]}', {e[4]}, {e[5]}, {e[6]}, {_FIELDS['decodable'][e[0]]})"
    for i, e in enumerate(ENCODERS)
)


@case(
    "encoder_dim",
    f"""{with_views('v_cells')}, dim(encoder, ord, label, mime, ext, lossy, alpha, worker, decodable) AS (VALUES {_DIM_ROWS}),
 n AS (SELECT encoder, count(*) AS cells FROM v_cells GROUP BY encoder)
 SELECT dim.*, coalesce(n.cells, 0) AS cells FROM dim LEFT JOIN n USING (encoder)""",
)
def _(spark, sf_dir):
    """The dimension with the number of sweep cells of each encoder."""
    cells = view(spark, sf_dir, "v_cells").groupBy("encoder").agg(F.count(F.lit(1)).alias("cells"))
    return encoder_dim(spark).drop("defaults").join(cells, "encoder", "left").withColumn(
        "cells", F.coalesce("cells", F.lit(0).cast("bigint"))
    )


# -------------------------------------------------------------------------------- C7-C9 names

_PATH_EXT = f"lower(regexp_extract({_BASE}, '.\\.([A-Za-z0-9]+)$', 1))"


@case(
    "path_columns",
    f"""{with_views('v_files')} SELECT seq, path, {_BASE} AS basename, regexp_extract(replace(path, '\\', '/'), '^(.*)/[^/]*$', 1) AS folder,
 CASE WHEN {_PATH_EXT} = '' THEN {_BASE} ELSE left({_BASE}, length({_BASE}) - length({_PATH_EXT}) - 1) END AS stem,
 {_PATH_EXT} AS ext, {_SAFE} AS safe_path FROM v_files""",
)
def _(spark, sf_dir):
    return paths.path_columns(view(spark, sf_dir, "v_files").select("seq", "path"))


_PICK = "CASE seq % 10 WHEN 0 THEN 'identity' WHEN 1 THEN 'mozjpeg' WHEN 2 THEN 'oxipng' WHEN 3 THEN 'webp' WHEN 4 THEN 'avif' WHEN 5 THEN 'jxl' WHEN 6 THEN 'qoi' WHEN 7 THEN 'browser-jpeg' WHEN 8 THEN 'browser-png' ELSE 'browser-webp' END"
_EXT_OF = " ".join(f"WHEN '{e[0]}' THEN '{e[3]}'" for e in ENCODERS)
_MIME_OF = " ".join(f"WHEN '{e[0]}' THEN '{e[2]}'" for e in ENCODERS)


@case(
    "output_name",
    f"""{with_views('v_files')}, f AS (SELECT seq, {_BASE} AS b, {_PICK} AS encoder FROM v_files),
 g AS (SELECT *, CASE encoder {_EXT_OF} END AS ext FROM f)
 SELECT seq, encoder, CASE WHEN ext = '' THEN b WHEN regexp_matches(b, '\\.[^./\\\\]*$') THEN regexp_replace(b, '\\.[^./\\\\]*$', concat('.', ext)) ELSE concat(b, '.', ext) END AS out_name,
 CASE encoder {_MIME_OF} END AS out_mime FROM g""",
)
def _(spark, sf_dir):
    rows = view(spark, sf_dir, "v_files").selectExpr("seq", "path", f"{_PICK} AS encoder")
    return paths.output_name(rows).select("seq", "encoder", "out_name", "out_mime")


_ODD = "concat(path, ': \t x', repeat('y', CAST(seq % 300 AS INTEGER)), CASE seq % 3 WHEN 0 THEN '.png' WHEN 1 THEN '' ELSE '. ' END)"


@case(
    "safe_names",
    f"""{with_views('v_files')}, o AS (SELECT seq, {_ODD} AS path FROM v_files),
 s AS (SELECT seq, path, trim(regexp_replace(replace(regexp_replace({_BASE}, '[\\x00-\\x1F\\x7F]', '', 'g'), ':', '-'), '\\s+', ' ', 'g')) AS t FROM o),
 e AS (SELECT *, lower(regexp_extract(t, '.\\.([A-Za-z0-9]+)$', 1)) AS x,
  left(trim(regexp_replace(regexp_replace(regexp_replace(path, '[\\x00-\\x1F\\x7F]', '', 'g'), '[/\\\\:*?"<>|]', '_', 'g'), '^\\.+', '')), 180) AS g FROM s)
 SELECT seq, CASE WHEN t IN ('', '.', '..') THEN 'image' WHEN length(t) <= 255 THEN t WHEN x = '' THEN left(t, 255)
  ELSE concat(left(left(t, length(t) - length(x) - 1), 254 - length(x)), '.', x) END AS safe_name,
  CASE WHEN g = '' THEN '_' ELSE g END AS segment FROM e""",
)
def _(spark, sf_dir):
    rows = view(spark, sf_dir, "v_files").selectExpr("seq", f"{_ODD} AS path")
    return paths.safe_names(rows).select("seq", "safe_name", "segment")
