from pyspark.sql import functions as F

from assetlane.functions import filetypes, paths
from assetlane.operators import intake
from assetlane.sources.assets import scan_assets


def rows(spark, columns, data):
    return spark.createDataFrame(data, columns)


def test_safe_path_closes_traversal(spark):
    df = rows(spark, "path string", [("C:\\..\\x\\ a .png",), ("/a//./b",), ("../..",), ("a/b.png",)])
    got = [r[0] for r in paths.path_columns(df).select("safe_path").collect()]
    assert got == ["x/a .png", "a/b", "", "a/b.png"]


def test_extension_of_hidden_file_is_empty(spark):
    df = rows(spark, "path string", [(".gitignore",), ("a.PNG",), ("x/y.tar.gz",), ("plain",)])
    got = [tuple(r) for r in paths.path_columns(df).select("ext", "stem").collect()]
    assert got == [("", ".gitignore"), ("png", "a"), ("gz", "y.tar"), ("", "plain")]


def test_magic_beats_labels_and_orders_differ(spark):
    data = [(bytes.fromhex("FFD8FF00"), "image/png", "a.gif"), (b"1234", "image/png", "a.gif"),
            (b"1234", "image/x-odd", ""), (b"%PDF-1.7", "image/png", "a.png"), (b"", "", "")]
    df = rows(spark, "head binary, declared string, name string", data)
    pick = lambda order: [tuple(r) for r in filetypes.resolve_mime(df, order=order).select("mime", "mime_source").collect()]
    assert pick("editor") == [("image/jpeg", "magic-number"), ("image/png", "file-type"), ("", "unknown"),
                              ("", "magic-number"), ("", "unknown")]
    assert pick("exact") == pick("editor")
    odd = rows(spark, "head binary, declared string, name string", [
        (b"1", "image/png; q=1", "a.gif"), (b"1", "IMAGE/PNG", ""), (b"1", " image/png", ""), (None, None, None)])
    assert [tuple(r) for r in filetypes.resolve_mime(odd, order="exact").select("mime", "mime_source").collect()] == [
        ("image/gif", "extension"), ("", "unknown"), ("", "unknown"), ("", "unknown")]
    assert pick("batch")[1:3] == [("image/gif", "extension"), ("image/x-odd", "file-type")]


def test_svg_prolog_and_wildcards_cross_lines(spark):
    data = [(b"  <SVG >",), (b"<?xml version='1'?>\n<svg\n",), (b"RIFF\n\n\n\nWEBPVP8X",), (b"<svgx>",)]
    df = rows(spark, "head binary", data)
    got = [r[0] for r in df.select(filetypes.magic_type(F.col("head"))).collect()]
    assert got == ["image/svg+xml", "image/svg+xml", "image/webp", ""]


def test_hdr_box_must_be_complete_and_boxed(spark):
    box = b"\0\0\0\x18ftypheic" + b"colrnclx" + bytes([0, 9, 0, 18])
    data = [(box, "image/heic"), (box[:-1], "image/heic"), (box, "image/png"),
            (b"xx urn:iso:std:iso:ts:21496", "image/jpeg")]
    df = rows(spark, "head binary, mime string", data)
    got = filetypes.gamut_space(filetypes.hdr_flags(df)).select("hdr_kind", "color_space").collect()
    assert [tuple(r) for r in got] == [("hlg", "display-p3"), (None, "srgb"), (None, "srgb"), ("gainmap", "srgb")]


def test_svg_size_reads_the_root_only(spark):
    data = [('<!-- <svg width="9" height="9"> --><svg viewBox=\'0 0 4 5\'/>',),
            ('<svg data-note="a > b" width="1" height="2">',), ('<svg viewBox="0 0 4,">',)]
    got = filetypes.svg_size(rows(spark, "svg_text string", data)).select("width", "height", "size_error").collect()
    assert [tuple(r) for r in got] == [("4", "5", None), ("1", "2", None), (None, None, "bad-viewbox")]


def test_scan_assets_relative_paths_and_depth(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "x.png").write_bytes(b"1")
    (tmp_path / "a" / "b" / "y.png").write_bytes(b"22")
    got = {r.rel_path: (r.depth, r.bytes) for r in scan_assets(spark, str(tmp_path)).collect()}
    assert got == {"x.png": (0, 1), "a/b/y.png": (2, 2)}
    assert scan_assets(spark, str(tmp_path), max_depth=1).count() == 1
    plan = scan_assets(spark, str(tmp_path)).select("rel_path")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_intake_cap_counts_accepted_rows_in_one_hot_drop(spark):
    df = spark.range(1000).select(
        F.col("id").alias("seq"), F.lit(1).alias("drop_id"),
        F.concat(F.lit("f"), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, ".png").otherwise(".txt")).alias("path"),
        F.lit("").alias("declared"), F.lit(1).cast("bigint").alias("bytes"),
    )
    got = [r.seq for r in intake.intake_filter(df, max_files=5, chunk_rows=3).orderBy("seq").collect()]
    assert got == [0, 2, 4, 6, 8]


def test_size_limit_is_inclusive(spark):
    data = [(intake.MAX_FILE_BYTES, "", "a.png"), (intake.MAX_FILE_BYTES + 1, "", "a.png"),
            (intake.MAX_PDF_BYTES, "application/pdf", "b"), (intake.MAX_PDF_BYTES + 1, "", "b.PDF")]
    df = rows(spark, "bytes bigint, declared string, path string", data)
    assert [r.accepted for r in intake.partition_by_size(df).collect()] == [True, False, True, False]


def test_stale_sessions(spark):
    data = [("session-lr5o0000-a",), ("session-zz",), ("session-UPPER-x",), ("other",)]
    now = F.lit(int("lr5o0000", 36) + intake.STALE_MS).cast("bigint")
    got = {r.name: r.stale for r in intake.sweep_stale_sessions(rows(spark, "name string", data), now, current="other").collect()}
    assert got == {"session-lr5o0000-a": False, "session-zz": True, "session-UPPER-x": True, "other": False}


def test_page_files_are_bounded_and_their_folders_whole(spark, tmp_path):
    import hashlib

    from assetlane.sources.assets import scan_assets
    from assetlane.suite import files as S
    from assetlane.suite import load_cases

    pages = [(i, f"page {i} " + "x" * (i % 50)) for i in range(3000)]
    spark.createDataFrame(pages, "page_id bigint, html string").repartition(5).write.parquet(str(tmp_path / "pages.parquet"))
    folder = S.page_files(spark, str(tmp_path), "bounded")
    texts = [bytes(r.content) for r in scan_assets(spark, folder, glob="*.txt").select("content").collect()]
    assert sum(t.count(b"\n") for t in texts) == 3000 and max(t.count(b"\n") for t in texts) <= S.PAGES_PER_FILE
    want = {}
    for k in range(8):
        text = "".join(h.encode().hex() + "\n" for i, h in pages if i % 8 == k).encode()
        want[f"shard={k}"] = (1, len(text), hashlib.sha256(text).hexdigest())
    for name in ("scan_assets", "intake_stream"):
        rows = load_cases()[name].run(spark, str(tmp_path)).collect()
        assert {r.folder: (r.depth, r.bytes, r.digest) for r in rows} == want and len(rows) == 8
