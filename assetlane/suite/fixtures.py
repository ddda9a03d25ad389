"""Fixture views over the given tables, for Spark and for the SQL checks.

Each view is a list of column expressions that both engines read the same way, over one table and,
for grids, small number ranges. On Spark a range is exploded beside each row; in the check SQL it is
a joined range. Every view covers its whole table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlane.session import scratch_folder


#: rows that a task of an exploded view holds
TASK_CELLS = 1_000_000


@dataclass(frozen=True)
class View:
    table: str
    columns: list[str]
    ranges: dict[str, int] = field(default_factory=dict)
    #: what a row costs beside a plain cell, as settings that are parsed
    cost: int = 1

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = read(spark, sf_dir, self.table)
        cells = prod(self.ranges.values()) * self.cost
        if cells > 1:
            # a small file is one task to Spark, however many rows its rows become
            parts = max(2, -(-rows.count() * cells // TASK_CELLS))
            rows = rows.repartitionByRange(parts, rows.columns[0])
        for name, n in self.ranges.items():
            rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name))
        return rows.selectExpr(*self.columns)

    def sql(self) -> str:
        joins = "".join(
            f" CROSS JOIN (SELECT CAST(i AS INTEGER) AS {name} FROM range({n}) t(i)) g_{name}"
            for name, n in self.ranges.items()
        )
        return f"SELECT {', '.join(self.columns)} FROM {self.table}{joins}"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_FILES = """concat(CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'a/' WHEN 2 THEN 'a/b/' WHEN 3 THEN '.hid/' ELSE 'C:/../x/' END,
 CASE WHEN o_orderkey % 23 = 0 AND o_custkey % 11 <> 0 THEN '.DS_Store' ELSE concat('img', CAST(o_orderkey % 40 AS STRING),
 CASE WHEN o_custkey % 11 = 0 THEN '.pdf' ELSE CASE o_orderkey % 9 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.webp' WHEN 3 THEN '.txt'
 WHEN 4 THEN '.pdf' WHEN 5 THEN '' WHEN 6 THEN '.heic' WHEN 7 THEN '.tar.gz' ELSE '.svg' END END) END) AS path"""

_SETTINGS = """concat('{"encoderId":"', CASE p_partkey % 6 WHEN 0 THEN 'mozjpeg' WHEN 1 THEN 'webp' WHEN 2 THEN 'avif' WHEN 3 THEN 'identity' WHEN 4 THEN 'oxipng' ELSE 'evil' END,
 '","encoderOptions":{', CASE WHEN p_partkey % 6 IN (0, 1, 2) THEN concat('"quality":', CASE WHEN p_partkey % 31 = 0 THEN '"high"' ELSE CAST(p_size AS STRING) END) WHEN p_partkey % 6 = 4 THEN concat('"level":', CAST(p_size % 7 AS STRING)) ELSE '' END,
 CASE WHEN p_partkey % 37 = 0 AND p_partkey % 6 <> 3 THEN ',"junk":1' ELSE '' END, '},"processorState":{"resize":{"enabled":', CASE WHEN p_partkey % 3 = 0 THEN 'true' ELSE 'false' END,
 ',"width":', CAST(1 + p_size % 4 AS STRING), ',"height":', CAST(1 + p_size % 3 AS STRING), ',"method":"lanczos3","premultiply":true,"linearRGB":true,"fitMethod":"stretch"}}}')"""

VIEWS: dict[str, View] = {
    "v_files": View("orders", [
        "o_orderkey AS seq", "o_custkey AS drop_id", _FILES,
        "CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 9 <> 4 AND o_custkey % 11 <> 0 THEN 'image/png' ELSE '' END AS declared",
        "(o_orderkey % 40) * CASE WHEN o_custkey % 11 = 0 OR o_orderkey % 9 = 4 THEN 5600000 ELSE 1400000 END AS bytes",
        "1700000000000 + (o_orderkey % 3) * 1000 AS mtime_ms",
    ]),
    "v_heads": View("part", [
        "p_partkey AS file_id",
        """CASE p_partkey % 16
 WHEN 0 THEN '89504E470D0A1A0A0000000D' WHEN 1 THEN 'FFD8FFE000104A464946' WHEN 2 THEN '47494638396101000100'
 WHEN 3 THEN '524946462A000000574542505650382030' WHEN 4 THEN '52494646240800005741564566' WHEN 5 THEN '0000001866747970686569630000000000000013636F6C726E636C78000900100009'
 WHEN 6 THEN '00000020667479706176696600000000000000136F6C'  WHEN 7 THEN '00000018667479706D696631000000000000001300000000636F6C726E636C78000C00120009'
 WHEN 8 THEN 'FF0A0102' WHEN 9 THEN '0000000C4A584C200D0A870A' WHEN 10 THEN '716F6966' WHEN 11 THEN '255044462D312E37'
 WHEN 12 THEN '3C73766720786D6C6E733D2278223E' WHEN 13 THEN '49492A00' WHEN 14 THEN 'FFD8FFE12E2E2E686472676D3A56657273696F6E' ELSE '01020304' END AS head_hex""",
        "CASE p_partkey % 6 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg;q=1' WHEN 2 THEN 'text/plain' ELSE '' END AS declared",
        "concat('f', CAST(p_partkey AS STRING), CASE p_partkey % 5 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.tar.gz' WHEN 3 THEN '' ELSE '.tif' END) AS name",
    ]),
    "v_images": View("part", [
        "p_partkey AS image_id", "1 + p_partkey * 37 % 4000 AS width", "1 + p_partkey * 53 % 3000 AS height",
        "1000 + p_partkey * 7919 % 900000 AS original_bytes",
    ]),
    "v_px": View("part", [
        "p_partkey AS image_id", "20 AS width", "18 AS height", "x", "y",
        "(x * 7 + y * 11 + p_size) % 200 AS r", "(x * 5 + y * 3 + p_size * 2) % 256 AS g",
        "(x * y + p_size) % 256 AS b", "CASE WHEN (x + y + p_size) % 6 = 0 THEN 128 ELSE 255 END AS a",
    ], {"y": 18, "x": 20}),
    # the encoded twin of v_px: a wobble on the colours, opaque, a few of another size
    "v_px_out": View("part", [
        "p_partkey AS image_id", "CASE WHEN p_partkey % 29 = 0 THEN 19 ELSE 20 END AS width", "18 AS height", "x", "y",
        "least(255, (x * 7 + y * 11 + p_size) % 200 + (x * 3 + y * 5 + p_size) % 7) AS r",
        "greatest(0, (x * 5 + y * 3 + p_size * 2) % 256 - (x + y * 2) % 5) AS g",
        "(x * y + p_size) % 256 AS b", "255 AS a",
    ], {"y": 18, "x": 20}),
    "v_cells": View("part", [
        "p_partkey AS image_id", "e AS row", "c AS col",
        "CASE e WHEN 0 THEN 'mozjpeg' WHEN 1 THEN 'webp' WHEN 2 THEN 'avif' WHEN 3 THEN 'jxl' ELSE 'oxipng' END AS encoder",
        "CASE WHEN e = 4 THEN c * 2 ELSE 30 + c * 20 END AS step", "e = 4 AS lossless",
        "1000 + p_partkey * 7919 % 900000 AS original_bytes",
        "CASE WHEN (p_partkey + e * 4 + c) % 13 = 0 THEN 'error' WHEN (p_partkey + e + c) % 17 = 0 THEN 'pending' ELSE 'done' END AS status",
        "CAST(floor((1000 + p_partkey * 7919 % 900000) * CAST(20 + (p_partkey * 31 + e * 17 + c * 23) % 100 AS DOUBLE) / CAST(100 AS DOUBLE)) AS BIGINT) AS size",
        "CASE WHEN p_partkey % 10 = 0 OR (p_partkey + c) % 11 = 0 THEN NULL ELSE CAST(900 + (p_partkey * 13 + e * 29 + c * 19) % 101 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS ssim",
    ], {"e": 5, "c": 4}),
    "v_items": View("orders", [
        "o_orderkey AS item_id", "o_custkey AS run_id", "o_orderkey AS seq",
        "CASE o_orderkey % 7 WHEN 0 THEN 'error' WHEN 1 THEN 'pending' WHEN 2 THEN 'processing' ELSE 'done' END AS status",
        "CAST(floor(o_totalprice) AS BIGINT) AS src_size",
        "CASE WHEN o_orderkey % 7 > 2 THEN CAST(floor(CAST(floor(o_totalprice) AS DOUBLE) * CAST(30 + o_orderkey % 90 AS DOUBLE) / CAST(100 AS DOUBLE)) AS BIGINT) END AS out_size",
    ]),
    "v_settings": View("part", [
        "p_partkey AS row_id", "p_partkey % 50 AS image_hash", f"{_SETTINGS} AS settings_json",
    ], cost=50),
    "v_presets": View("part", [
        "p_partkey AS row_id", "p_partkey % 20 AS library_id", "p_partkey AS seq",
        "CASE WHEN p_partkey % 41 = 0 THEN '' ELSE concat('preset ', CAST(p_partkey * 7 % 90 AS STRING)) END AS name",
        f"{_SETTINGS} AS settings_json",
        "concat('{\"v\":', CASE WHEN p_partkey % 17 = 0 THEN '2' ELSE '1' END, ',\"name\":', "
        "CASE WHEN p_partkey % 43 = 0 THEN '7' WHEN p_partkey % 41 = 0 THEN '\"\"' ELSE concat('\"preset ', CAST(p_partkey * 7 % 90 AS STRING), '\"') END, "
        f"',\"side\":', {_SETTINGS}, '}}') AS preset_json",
    ], cost=50),
    "v_pdf_objects": View("customer", [
        "c_custkey AS doc_id", "n AS obj_no", "CASE WHEN n % 3 = 0 THEN '/Image' WHEN n % 3 = 1 THEN '/Form' ELSE '' END AS subtype",
        "CASE WHEN c_custkey % 41 = 0 AND n = 2 THEN '/Sig' ELSE '' END AS ft", "c_custkey % 43 = 0 AND n = 5 AS has_byte_range",
        "CASE WHEN n = 0 AND c_custkey % 5 = 0 THEN c_custkey % 8 ELSE 0 END AS sig_flags", "10 + (c_custkey + n) % 3 AS width", "10 AS height",
        "CASE WHEN n % 2 = 0 THEN '/DeviceRGB' ELSE '/DeviceGray' END AS color_space", "CASE WHEN (c_custkey + n) % 9 = 0 THEN n - 1 END AS smask_ref",
        "concat('bytes', CAST((c_custkey + n * 5) % 4 AS STRING)) AS contents", "n = 23 AS is_metadata", "n = 22 AS is_thumb",
        "CASE (c_custkey + n) % 6 WHEN 0 THEN 'DCTDecode' WHEN 1 THEN 'FlateDecode' WHEN 2 THEN 'ASCII85Decode,DCTDecode' WHEN 3 THEN 'FooDecode' WHEN 4 THEN '' ELSE 'JPXDecode' END AS filter_list",
        "CASE WHEN (c_custkey + n) % 7 = 0 THEN NULL ELSE CASE WHEN n % 4 = 0 THEN 1 ELSE 8 END END AS bpc", "(c_custkey + n) % 11 = 0 AS is_mask",
        "CASE (c_custkey + n) % 5 WHEN 0 THEN '1,0' WHEN 1 THEN '0,1' WHEN 2 THEN '0,1,0,1' ELSE NULL END AS decode_list",
        "500 + (c_custkey * 997 + n * 7919) % 90000 AS src_bytes",
    ], {"n": 25}),
    "v_pdf_images": View("customer", [
        "c_custkey AS doc_id", "r AS ref", "1 + (c_custkey * 131 + r * 977) % 5000 AS width", "1 + (c_custkey * 71 + r * 577) % 4000 AS height",
        "CASE (c_custkey + r) % 7 WHEN 0 THEN 'JPXDecode' WHEN 1 THEN 'unknown' WHEN 2 THEN 'FlateDecode' WHEN 3 THEN 'FlateDecode' ELSE 'DCTDecode' END AS filter",
        "CASE (c_custkey * 3 + r) % 8 WHEN 0 THEN '/DeviceCMYK' WHEN 1 THEN '/Indexed' WHEN 2 THEN '/DeviceGray' ELSE '/DeviceRGB' END AS color_space",
        "CASE WHEN (c_custkey + r) % 19 = 0 THEN 16 ELSE 8 END AS bpc", "(c_custkey + r) % 5 = 0 AS has_smask",
        "(c_custkey + r) % 23 = 0 AS is_mask", "(c_custkey + r) % 29 = 0 AS custom_decode",
        "500 + (c_custkey * 997 + r * 7919) % 90000 AS src_bytes",
    ], {"r": 5}),
    "v_pdf_placements": View("lineitem", [
        "l_orderkey AS doc_id", "l_linenumber AS page", "CAST(l_partkey % 4 AS INTEGER) AS ref",
        "l_quantity * 10 AS a", "l_discount * 100 AS b", "-l_tax * 100 AS c", "l_quantity * 8 AS d",
        "l_extendedprice / 100 AS e", "l_extendedprice / 200 AS f",
        "CASE WHEN l_linenumber = 7 THEN CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS user_unit",
    ]),
    "v_svg": View("part", [
        "p_partkey AS image_id",
        """CASE p_partkey % 8
 WHEN 0 THEN concat('<svg width="', CAST(p_size AS STRING), '" height="7px"></svg>')
 WHEN 1 THEN concat('<svg xmlns="x" viewBox="0 0 ', CAST(p_size AS STRING), ' 20"><g width="3"/></svg>')
 WHEN 2 THEN concat('<svg viewBox="0,0, ', CAST(p_size AS STRING), ',9" width="4"></svg>')
 WHEN 3 THEN '<svg viewBox="0 0 5"></svg>'
 WHEN 4 THEN '<svg width="3"></svg>'
 WHEN 5 THEN '<html width="3" height="4"></html>'
 WHEN 6 THEN concat('<?xml version="1.0"?><svg height="', CAST(p_size AS STRING), '" width="6"/>')
 ELSE 'no markup' END AS svg_text""",
    ]),
    "v_tiles": View("embeddings", ["vec_id AS image_id", "8 AS width", "8 AS height", "embedding"]),
    "v_user_settings": View("part", [
        "p_partkey AS user_id", f"{_SETTINGS} AS settings_json",
    ], cost=50),
}


#: views stored by :func:`stage_views`, by folder of the tables and name
_STAGED: dict[tuple[str, str], str] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    stored = _STAGED.get((sf_dir, name))
    return spark.read.parquet(stored) if stored else VIEWS[name].spark(spark, sf_dir)


def stage_views(spark: SparkSession, sf_dir: str, parts: int) -> None:
    """Stores every view in ``parts`` files by ranges of its first column, so that a bench times operators and not
    the fixtures."""
    for name, v in VIEWS.items():
        path, rows = scratch_folder(spark, name), v.spark(spark, sf_dir)
        rows.repartitionByRange(parts, rows.columns[0]).write.parquet(path)
        _STAGED[sf_dir, name] = path


def with_views(*names: str) -> str:
    """Leading WITH clause of a check query; more tables may follow after a comma."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].sql()})" for n in names)
