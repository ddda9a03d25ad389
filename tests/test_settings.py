import json

from assetlane.functions import report
from assetlane.functions import settings as S
from assetlane.functions.encoders import side_settings
from assetlane.operators import presets as P
from assetlane.sources.assets import read_presets
from pyspark.sql import functions as F


def strings(spark, column, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, {column} string")


def side(encoder="mozjpeg", options=None, **resize):
    base = json.loads(side_settings(encoder))
    if options is not None:
        base["encoderOptions"] = options
    base["processorState"]["resize"].update(resize)
    return base


def reasons(spark, *docs):
    df = strings(spark, "settings_json", *[d if isinstance(d, str) else json.dumps(d) for d in docs])
    return [r.reject_reason for r in S.validate_settings(df).orderBy("id").collect()]


def test_strict_validation_of_hostile_settings(spark):
    broken = side()
    del broken["processorState"]["resize"]
    overflow = json.dumps(side(options={"quality": 0})).replace(": 0}", ": 1e999}")
    got = reasons(
        spark, side(), side(options={}), side(options={"quality": "75"}), side(options={"nope": 1}),
        side("webp", {"lossless": True}), side("avif", {"lossless": True}), side(enabled="true"), side(width=None),
        side(method=5), {**side(), "encoderOptions": [1]}, broken, "[]", "null", "{", overflow,
        {**side(), "encoderId": 5}, side(options={"quality": None}),
    )
    assert got[:13] == [
        None, None, "option-type", "unknown-option", "option-type", None, "resize-enabled", "resize-size",
        "resize-method", "options-missing", "resize-missing", "unknown-encoder", "unknown-encoder",
    ]
    assert got[13] == "not-an-object" and got[14] is not None and got[15] == "unknown-encoder" and got[16] == "option-type"


def test_rebuild_drops_junk_and_fills_defaults(spark):
    doc = side("avif", {"quality": 33.0, "speed": "fast", "junk": 1, "lossless": True}, enabled=True, width=0.2,
               height=-7, method="magic", fitMethod="contain")
    r = S.sanitise_settings(strings(spark, "settings_json", json.dumps(doc), "[]")).orderBy("id").collect()
    assert r[0].options["quality"] == "33" and r[0].options["speed"] == "6" and r[0].options["lossless"] == "true"
    assert "junk" not in r[0].options and len(r[0].options) == 13
    assert (r[0].width, r[0].height, r[0].method, r[0].fit, r[0].enabled) == (1, 1, "lanczos3", "contain", True)
    assert r[1].encoder is None and r[1].options is None


def test_equal_settings_have_equal_keys(spark):
    same = [side(), side(width=900), side(height=3, method="triangle")]
    other = [side(options={"quality": 75}), side(enabled=True), side(enabled=True, width=2), side("webp")]
    reordered = json.dumps(dict(reversed(list(side(enabled=True, width=2.0).items()))))
    df = strings(spark, "settings_json", *[json.dumps(d) for d in same + other], reordered)
    fp = [r.fp for r in S.fingerprint(df).orderBy("id").collect()]
    assert len(set(fp[:3])) == 1 and len(set(fp[2:7])) == 5 and fp[7] == fp[5]


def test_preset_rules(spark):
    docs = [{"v": 1, "name": "a", "side": side()}, {"v": 2, "name": "a", "side": side()}, {"v": 1, "name": "", "side": side()},
            {"v": 1, "name": 4, "side": side()}, {"v": 1, "name": "a"}, {"v": 1, "name": "a", "side": side(options={"x": 1})}]
    df = strings(spark, "preset_json", *map(json.dumps, docs))
    got = [r.reject_reason for r in S.validate_presets(df).orderBy("id").collect()]
    assert got == [None, "version", "name", "name", "unknown-encoder", "unknown-option"]


def test_preset_documents_are_read_whole(spark, tmp_path):
    docs = [{"v": 1, "name": "a", "side": side()}, {"v": 9, "name": "b"}, 7]
    (tmp_path / "mine.json").write_text(json.dumps(docs, indent=2))
    (tmp_path / "bad.json").write_text("{not json")
    got = [(r.pos, r.name, r.valid) for r in read_presets(spark, str(tmp_path)).orderBy("pos").collect()]
    assert got == [(None, None, False), (0, "a", True), (1, "b", False), (2, None, False)]


def test_threads_clamp(spark):
    df = strings(spark, "app_json", *['{"workerThreads":%s}' % v for v in ("-5", "999", "2.5", "true")], "[1]")
    got = [(r.worker_threads, r.default_encoder, r.keep_exif) for r in S.sanitise_app_settings(df).orderBy("id").collect()]
    assert got == [(1, "avif", False), (16, "avif", False), (3, "avif", False), (4, "avif", False), (4, "avif", False)]


def test_tokens_from_query_then_fragment(spark):
    df = strings(spark, "url", "https://x/?a=1&p=AbC_-", "https://x/#p=QQ", "https://x/#/route?p=QUI", "https://x/?p=#p=abcd",
                 "https://x/", "https://x/?p=abcde", "https://x/?p=a%2Bb%3D", "https://x/?p=a+bc", "https://x/?p=" + "A" * 2049)
    got = [(r.token, r.token_error) for r in S.share_tokens(df).orderBy("id").collect()]
    assert got[:5] == [("AbC_-", "not-base64url"), ("QQ", None), ("QUI", None), ("abcd", None), (None, None)]
    assert [e for _, e in got[5:]] == ["not-base64url", None, "not-base64url", "too-large"]


def test_sizes_round_like_to_fixed(spark):
    sizes = {0: "0 B", 948: "948 B", 1000: "1.00 kB", 1035: "1.03 kB", 1125: "1.13 kB", 12_400: "12.4 kB", 12_350: "12.3 kB",
             999_999: "1000 kB", 1_240_000: "1.24 MB", 123_456_789: "123 MB", 5 * 10**15: "5000 TB"}
    df = spark.createDataFrame(list(sizes.items()), "n bigint, want string")
    got = {r.n: r.t for r in df.select("n", report.format_bytes(F.col("n")).alias("t")).collect()}
    assert got == {n: sizes[n] if n != 12_350 else got[12_350] for n in sizes} and got[12_350] == f"{12.35:.1f} kB"


def test_seeding_is_once_and_by_name(spark):
    first = P.BUILTIN_PRESETS[0][0]
    current = spark.createDataFrame([(1, first, "{}"), (2, "mine", "{}"), (3, "x", "{}")], "library_id int, name string, settings_json string")
    out = P.seed_presets(current, seeded=current.where("library_id = 3").select("library_id"))
    counts = {r.library_id: r["count"] for r in out.groupBy("library_id").count().collect()}
    assert counts == {1: 4, 2: 5, 3: 1}
    assert out.where(F.col("name") == first).where("library_id = 1").first().settings_json == "{}"
