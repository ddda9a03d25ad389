"""Queries on settings, presets and reuse."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetlane.functions import report
from assetlane.functions import settings as S
from assetlane.functions.encoders import DEFAULT_OPTIONS, ENCODERS, ENCODER_IDS
from assetlane.operators import presets as P
from assetlane.operators import reuse
from assetlane.session import scratch_folder
from assetlane.sources import assets
from assetlane.suite.fixtures import read, view, with_views
from assetlane.suite.registry import case

_SETTINGS = with_views("v_settings")
_IDS = ", ".join(f"'{e}'" for e in ENCODER_IDS)
_OPTION_ROWS = ", ".join(
    f"('{e}', '{k}', '{'boolean' if isinstance(v, bool) else 'number'}', '{str(v).lower() if isinstance(v, bool) else v}')"
    for e, opts in DEFAULT_OPTIONS.items() for k, v in opts.items()
)
_DEFAULTS = f"opt(encoder, key, type, value) AS (VALUES {_OPTION_ROWS})"
_KIND = "CASE json_type({0}) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END"


def _reasons(source, doc, key="row_id"):
    """Reject reason per row of ``source`` for the settings document ``doc``."""
    value = "json_extract(o, concat('$.\"', k, '\"'))"
    return f"""{_DEFAULTS}, doc AS (SELECT {key} AS id, {doc} AS j FROM {source}),
 enc AS (SELECT id, json_extract_string(j, '$.encoderId') AS e, json_extract(j, '$.encoderOptions') AS o FROM doc),
 keys AS (SELECT id, e, o, unnest(json_keys(o)) AS k FROM enc),
 bad AS (SELECT id, bool_or(opt.key IS NULL) AS unknown, bool_or(opt.type <> {_KIND.format(value)}) AS wrong
  FROM keys LEFT JOIN opt ON opt.encoder = e AND opt.key = k GROUP BY id),
 reasons AS (SELECT enc.id, CASE WHEN e IS NULL THEN 'not-an-object' WHEN e NOT IN ({_IDS}) THEN 'unknown-encoder' WHEN unknown THEN 'unknown-option' WHEN wrong THEN 'option-type' END AS reason FROM enc LEFT JOIN bad ON bad.id = enc.id)"""


@case(
    "validate_settings",
    f"{_SETTINGS}, {_reasons('v_settings', 'CASE WHEN json_valid(settings_json) THEN settings_json::JSON END')} SELECT id AS row_id, reason IS NULL AS valid, reason AS reject_reason FROM reasons",
)
def _(spark, sf_dir):
    return S.validate_settings(view(spark, sf_dir, "v_settings")).select("row_id", "valid", "reject_reason")


_PRESET_REASON = "CASE WHEN NOT json_valid(preset_json) THEN 'not-an-object' WHEN json_extract(preset_json, '$.v') <> '1' THEN 'version' WHEN json_type(preset_json, '$.name') <> 'VARCHAR' OR json_extract_string(preset_json, '$.name') = '' THEN 'name' ELSE reason END"
_SIDE = "CASE WHEN json_valid(preset_json) THEN json_extract(preset_json, '$.side') END"
_PRESETS = f"{with_views('v_presets')}, {_reasons('v_presets', _SIDE)}"


@case(
    "validate_presets",
    f"""{_PRESETS}, r AS (SELECT row_id, {_PRESET_REASON} AS reject_reason FROM v_presets JOIN reasons ON id = row_id)
 SELECT row_id, reject_reason IS NULL AS valid, reject_reason FROM r""",
)
def _(spark, sf_dir):
    return S.validate_presets(view(spark, sf_dir, "v_presets")).select("row_id", "valid", "reject_reason")


# every option of the encoder: the given value when it is of the right type, else the default
_CLEAN = f"""{_DEFAULTS}, raw AS (SELECT row_id, json_extract_string(j, '$.encoderId') AS e, json_extract(j, '$.encoderOptions') AS o, json_extract(j, '$.processorState.resize') AS z
  FROM (SELECT row_id, CASE WHEN json_valid(settings_json) THEN settings_json::JSON END AS j FROM v_settings)),
 pick AS (SELECT row_id, opt.key, CASE WHEN {_KIND.format("json_extract(o, concat('$.', opt.key))")} = opt.type AND json_extract(o, concat('$.', opt.key)) IS NOT NULL THEN json_extract_string(o, concat('$.', opt.key)) ELSE opt.value END AS v
  FROM raw JOIN opt ON opt.encoder = e),
 opts AS (SELECT row_id, string_agg(concat(key, '=', v), ',' ORDER BY key) AS options FROM pick GROUP BY row_id),
 clean AS (SELECT raw.row_id, CASE WHEN e IN ({_IDS}) THEN e END AS encoder, CASE WHEN e IN ({_IDS}) THEN coalesce(options, '') END AS options, z FROM raw LEFT JOIN opts USING (row_id))"""


@case(
    "sanitise_settings",
    f"""{_SETTINGS}, {_CLEAN} SELECT row_id, encoder, options, CASE WHEN encoder IS NOT NULL THEN CAST(json_extract_string(z, '$.enabled') AS BOOLEAN) END AS enabled,
 CASE WHEN encoder IS NOT NULL THEN CAST(json_extract_string(z, '$.width') AS BIGINT) END AS width, CASE WHEN encoder IS NOT NULL THEN CAST(json_extract_string(z, '$.height') AS BIGINT) END AS height,
 CASE WHEN encoder IS NOT NULL THEN json_extract_string(z, '$.method') END AS method, CASE WHEN encoder IS NOT NULL THEN CAST(json_extract_string(z, '$.premultiply') AS BOOLEAN) END AS premultiply,
 CASE WHEN encoder IS NOT NULL THEN CAST(json_extract_string(z, '$.linearRGB') AS BOOLEAN) END AS linear_rgb, CASE WHEN encoder IS NOT NULL THEN json_extract_string(z, '$.fitMethod') END AS fit FROM clean""",
)
def _(spark, sf_dir):
    clean = S.sanitise_settings(view(spark, sf_dir, "v_settings"))
    pairs = F.transform(F.map_entries("options"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return clean.withColumn("options", F.array_join(F.array_sort(pairs), ",")).select(
        "row_id", "encoder", "options", "enabled", "width", "height", "method", "premultiply", "linear_rgb", "fit"
    )


_OPTION = "(SELECT TRY_CAST(v AS DOUBLE) FROM pick p WHERE p.row_id = c.row_id AND p.key = '{0}')"
_LADDER = " ".join(
    f"WHEN {_OPTION.format('method')} = {m} AND {_OPTION.format('quality')} = {q} THEN {i}" for i, (m, q) in enumerate(S.WEBP_LADDER)
)
# lossless variants of the view, so that every rule is met
_TUNED = "replace(replace(settings_json, '\"webp\",\"encoderOptions\":{', concat('\"webp\",\"encoderOptions\":{\"lossless\":', CAST(row_id % 2 AS STRING), ',\"method\":3,')), '\"quality\":50', '\"quality\":100,\"subsample\":3')"
_QUALITY = f"""{_SETTINGS.replace('WITH v_settings', 'WITH v_plain')}, v_settings AS (SELECT row_id, image_hash, {_TUNED} AS settings_json FROM v_plain), {_CLEAN},
 q AS (SELECT c.row_id, encoder, z, CASE WHEN encoder IN ('avif', 'jxl', 'webp', 'mozjpeg') THEN {_OPTION.format('quality')} END AS quality,
  CASE WHEN encoder = 'avif' THEN {_OPTION.format('quality')} = 100 AND {_OPTION.format('qualityAlpha')} IN (-1, 100) AND {_OPTION.format('subsample')} = 3
   WHEN encoder = 'jxl' THEN {_OPTION.format('quality')} = 100 WHEN encoder = 'webp' THEN {_OPTION.format('lossless')} = 1 WHEN encoder IS NOT NULL THEN false END AS lossless,
  CASE WHEN encoder = 'oxipng' THEN {_OPTION.format('level')} WHEN encoder = 'webp' AND {_OPTION.format('lossless')} = 1 THEN CASE {_LADDER} ELSE 6 END ELSE CASE WHEN encoder IN ('avif', 'webp', 'mozjpeg') THEN {_OPTION.format('quality')} END END AS knob FROM clean c)"""


def _tuned(spark, sf_dir):
    rows = view(spark, sf_dir, "v_settings").withColumn("settings_json", F.expr(_TUNED))
    return S.quality_columns(S.sanitise_settings(rows))


@case(
    "quality_columns",
    f"""{_QUALITY} SELECT row_id, encoder, quality, lossless, CASE WHEN encoder = 'oxipng' OR (encoder = 'webp' AND lossless) THEN 'effort' WHEN quality IS NOT NULL THEN 'quality' WHEN encoder IS NOT NULL THEN 'none' END AS knob_kind,
 CAST(knob AS DOUBLE) AS knob_value FROM q""",
)
def _(spark, sf_dir):
    return _tuned(spark, sf_dir).select("row_id", "encoder", "quality", "lossless", "knob_kind", "knob_value")


_LABELS = " ".join(f"WHEN '{e[0]}' THEN '{e[1]}'" for e in ENCODERS)


@case(
    "settings_facts",
    f"""{_QUALITY}, f AS (SELECT row_id, 0 AS o, 'Format' AS label, CASE encoder {_LABELS} END AS value FROM q WHERE encoder IS NOT NULL
  UNION ALL SELECT row_id, 1, 'Quality', CAST(CAST(floor(quality + 0.5) AS BIGINT) AS VARCHAR) FROM q WHERE quality IS NOT NULL
  UNION ALL SELECT row_id, 2, 'Effort', concat('level ', CAST(CAST(knob AS BIGINT) AS VARCHAR)) FROM q WHERE encoder = 'oxipng'
  UNION ALL SELECT row_id, 3, 'Resize', CASE WHEN json_extract_string(z, '$.enabled') = 'true' THEN concat(json_extract_string(z, '$.width'), ' x ', json_extract_string(z, '$.height')) ELSE 'Original size' END FROM q WHERE encoder IS NOT NULL)
 SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY o) - 1 AS INTEGER) AS pos, label, value FROM f""",
)
def _(spark, sf_dir):
    rows = _tuned(spark, sf_dir).where(F.col("encoder").isNotNull())
    return report.settings_facts(rows).select("row_id", "pos", "label", "value")


_APP = """concat('{"defaultEncoder":', CASE event_id % 4 WHEN 0 THEN '"webp"' WHEN 1 THEN '"evil"' WHEN 2 THEN '5' ELSE '"jxl"' END, ',"keepExif":', CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN '"yes"' ELSE 'false' END,
 ',"workerThreads":', CASE WHEN event_id % 5 = 0 THEN '"8"' ELSE {k} END, CASE WHEN event_id % 7 = 0 THEN '.5' ELSE '' END, '}')"""
_APP_K = {"spark": "get_json_object(props, '$.k')", "sql": "json_extract_string(props, '$.k')"}


def _app(event, k):
    return _APP.replace("{k}", k)


@case(
    "sanitise_app_settings",
    f"""WITH a AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) + CASE WHEN event_id % 7 = 0 THEN 0.5 ELSE 0 END AS k FROM events)
 SELECT event_id, CASE WHEN event_id % 35 = 0 THEN 'avif' WHEN event_id % 4 = 0 THEN 'webp' WHEN event_id % 4 = 3 THEN 'jxl' ELSE 'avif' END AS default_encoder,
 event_id % 3 = 0 AND event_id % 35 <> 0 AS keep_exif,
 CASE WHEN event_id % 5 = 0 THEN 4 ELSE greatest(1, least(16, CAST(floor(k + 0.5) AS BIGINT))) END AS worker_threads FROM a""",
)
def _(spark, sf_dir):
    """Thread counts come from the event properties; every 35th document is not JSON."""
    rows = read(spark, sf_dir, "events").select("event_id", F.expr(_app("event_id", _APP_K["spark"])).alias("app_json"))
    return S.sanitise_app_settings(rows).select("event_id", "default_encoder", "keep_exif", "worker_threads")


def _token_sql(param):
    value = "regexp_extract({0}, '(?:^|&)" + param + "=([^&]*)', 1)"
    return f"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q, regexp_replace(regexp_extract(url, '^[^#]*#(.*)$', 1), '^[^?]*\\?', '') AS f FROM pages),
 t AS (SELECT page_id, coalesce(nullif({value.format('q')}, ''), nullif({value.format('f')}, '')) AS token FROM u)
 SELECT page_id, token, CASE WHEN length(token) > 2048 THEN 'too-large' WHEN NOT regexp_matches(token, '^[A-Za-z0-9_-]+$') OR length(token) % 4 = 1 THEN 'not-base64url' END AS token_error FROM t"""


@case("share_tokens", _token_sql("page"))
def _(spark, sf_dir):
    return S.share_tokens(read(spark, sf_dir, "pages"), "url", "page").select("page_id", "token", "token_error")


@case("share_tokens_ref", _token_sql("ref"))
def _(spark, sf_dir):
    return S.share_tokens(read(spark, sf_dir, "pages"), "url", "ref").select("page_id", "token", "token_error")


_KEYED = """k AS (SELECT *, CASE WHEN j IS NOT NULL THEN concat(json_extract_string(j, '$.encoderId'), '|', CAST(json_extract(j, '$.encoderOptions') AS VARCHAR), '|',
 CASE WHEN json_extract_string(j, '$.processorState.resize.enabled') = 'true' THEN CAST(json_extract(j, '$.processorState.resize') AS VARCHAR) ELSE 'off' END) END AS fp FROM (SELECT *, CASE WHEN json_valid(settings_json) THEN settings_json::JSON END AS j FROM {0}))"""


@case(
    "fingerprint",
    f"{_SETTINGS}, {_KEYED.format('v_settings')}, g AS (SELECT fp, min(row_id) AS first_row FROM k GROUP BY fp) SELECT row_id, first_row FROM k JOIN g USING (fp)",
)
def _(spark, sf_dir):
    """Groups of equal settings, named by their first row."""
    keyed = S.fingerprint(view(spark, sf_dir, "v_settings"))
    groups = keyed.groupBy("fp").agg(F.min("row_id").alias("first_row"))
    return keyed.join(groups, "fp").select("row_id", "first_row")


# ------------------------------------------------------------------------- J3, J4 reuse and diff


def _requests_and_ledger(spark, sf_dir):
    rows = view(spark, sf_dir, "v_settings").withColumn("image_hash", F.col("image_hash") % 5)
    ledger = rows.where("row_id div 50 % 3 = 0").selectExpr(
        "image_hash", "settings_json", "row_id AS seq", "row_id * 10 AS out_size",
        "CASE WHEN row_id % 4 = 0 THEN 'browser-jpeg' END AS encoder_fallback",
    )
    return rows.where("row_id div 50 % 3 <> 0"), ledger


_REUSE = f"""{_SETTINGS}, {_KEYED.format('v_settings')}, led AS (SELECT image_hash % 5 AS image_hash, fp, row_id * 10 AS out_size, CASE WHEN row_id % 4 = 0 THEN 'browser-jpeg' END AS encoder_fallback FROM k WHERE row_id // 50 % 3 = 0
  QUALIFY row_number() OVER (PARTITION BY k.image_hash % 5, fp ORDER BY row_id DESC) = 1), req AS (SELECT row_id, image_hash % 5 AS image_hash, settings_json, fp FROM k WHERE row_id // 50 % 3 <> 0)"""


@case("reuse_hits", f"{_REUSE} SELECT row_id, out_size, encoder_fallback FROM req JOIN led USING (image_hash, fp)")
def _(spark, sf_dir):
    hits, _todo = reuse.reuse_results(*_requests_and_ledger(spark, sf_dir))
    return hits.select("row_id", "out_size", "encoder_fallback")


@case("reuse_todo", f"{_REUSE} SELECT row_id, settings_json FROM req ANTI JOIN led USING (image_hash, fp)")
def _(spark, sf_dir):
    _hits, todo = reuse.reuse_results(*_requests_and_ledger(spark, sf_dir))
    return todo.select("row_id", "settings_json")


_SHIFT = "row_id - CASE WHEN row_id % 5 = 0 THEN 6 WHEN row_id % 5 = 1 THEN 1 ELSE 0 END"


@case(
    "work_diff",
    f"""{_SETTINGS}, {_KEYED.format('v_settings')}, p AS (SELECT row_id, json_extract_string(j, '$.encoderId') AS e, CAST(json_extract(j, '$.encoderOptions') AS VARCHAR) AS o,
  CASE WHEN json_extract_string(j, '$.encoderId') = 'identity' THEN 'off' WHEN json_extract_string(j, '$.processorState.resize.enabled') = 'true' THEN CAST(json_extract(j, '$.processorState.resize') AS VARCHAR) ELSE 'off' END AS z FROM k),
 jn AS (SELECT d.row_id AS image_id, c.row_id IS NULL OR d.row_id % 11 = 0 AS f, d.row_id % 13 = 0 OR d.row_id % 17 = 0 AS pre, c.e IS DISTINCT FROM d.e AS de, c.o IS DISTINCT FROM d.o AS dopt, c.z IS DISTINCT FROM d.z AS dz,
  (c.e = 'identity') IS DISTINCT FROM (d.e = 'identity') AS x FROM p d LEFT JOIN p c ON c.row_id = {_SHIFT.replace('row_id', 'd.row_id')} AND d.row_id % 7 <> 0),
 r AS (SELECT image_id, f AS decoding, f OR pre AS preprocessing, f OR pre OR x OR dz AS processing, f OR pre OR x OR dz OR de OR dopt AS encoding FROM jn)
 SELECT image_id, 1 AS side, decoding, preprocessing, processing, encoding, encoding AS needed FROM r""",
)
def _(spark, sf_dir):
    """Current state lags behind: other settings, another file, another turn or crop, or no row."""
    rows = view(spark, sf_dir, "v_settings")
    crop = lambda when: F.when(F.expr(when), F.struct(F.lit(1).alias("x"), F.lit(2).alias("y")))
    desired = rows.select(
        F.col("row_id").alias("image_id"), F.lit(1).alias("side"), F.col("row_id").alias("file_id"),
        F.lit(0).alias("rotate"), crop("row_id % 13 = 0").alias("crop"), "settings_json",
    )
    lagging = rows.select(F.col("row_id").alias("__from"), "settings_json")
    current = rows.where("row_id % 7 <> 0").selectExpr("row_id", f"{_SHIFT} AS __from").join(lagging, "__from").select(
        F.col("row_id").alias("image_id"), F.lit(1).alias("side"),
        F.expr("row_id + CASE WHEN row_id % 11 = 0 THEN 1 ELSE 0 END").alias("file_id"),
        F.expr("CASE WHEN row_id % 17 = 0 THEN 90 ELSE 0 END").alias("rotate"), crop("false").alias("crop"), "settings_json",
    )
    return reuse.work_diff(current, desired)


# ------------------------------------------------------------------------------- J5-J8, W7, S6


@case(
    "preset_match",
    f"""{with_views('v_settings', 'v_presets')}, {_KEYED.format('v_settings')}, {_KEYED.format('v_presets').replace('k AS (', 'lib AS (', 1)},
 n AS (SELECT fp, min(name) AS preset_name FROM lib GROUP BY fp) SELECT row_id, preset_name FROM k LEFT JOIN n USING (fp)""",
)
def _(spark, sf_dir):
    library = view(spark, sf_dir, "v_presets").select("name", "settings_json")
    return P.preset_match(view(spark, sf_dir, "v_settings"), library).select("row_id", "preset_name")


@case(
    "settings_precedence",
    f"""{_PRESETS}, p0 AS (SELECT *, CASE WHEN json_valid(settings_json) THEN json_extract_string(settings_json, '$.encoderId') END AS e FROM v_presets),
 p AS (SELECT row_id AS user_id, row_id % 2 = 0 AND ({_PRESET_REASON}) IS NULL AS has_shared, e, coalesce(row_id % 5 <> 0 AND e IN ({_IDS}), false) AS has_saved, settings_json FROM p0 JOIN reasons ON id = row_id)
 SELECT user_id, CASE WHEN has_shared THEN 'shared' WHEN has_saved THEN 'saved' ELSE 'default' END AS origin,
  CASE WHEN has_shared OR has_saved THEN e WHEN user_id % 2 = 0 THEN 'webp' ELSE 'avif' END AS encoder, CASE WHEN has_shared OR has_saved THEN settings_json END AS settings_json FROM p""",
)
def _(spark, sf_dir):
    rows = view(spark, sf_dir, "v_presets").withColumnRenamed("row_id", "user_id")
    app = rows.selectExpr("user_id", "CASE WHEN user_id % 2 = 0 THEN '{\"defaultEncoder\":\"webp\"}' ELSE '[]' END AS app_json")
    return P.settings_precedence(
        rows.where("user_id % 2 = 0").select("user_id", "preset_json"),
        rows.where("user_id % 5 <> 0").select("user_id", "settings_json"), app,
    )


def _builtin_sql():
    import json

    from assetlane.functions.encoders import DEFAULT_RESIZE, side_settings

    rows = []
    for name, encoder, options, resize in P.BUILTIN_PRESETS:
        side = json.loads(side_settings(encoder, **options))
        side["processorState"]["resize"] = {**DEFAULT_RESIZE, **resize}
        rows.append(f"('{name}', '{json.dumps(side, separators=(',', ':'))}')")
    return f"builtin(name, settings_json) AS (VALUES {', '.join(rows)})"


_FIRST_BUILTIN = P.BUILTIN_PRESETS[0][0]
_RENAMED = f"CASE WHEN row_id % 59 = 0 THEN '{_FIRST_BUILTIN}' ELSE name END"


@case(
    "seed_presets",
    f"""{with_views('v_presets')}, {_builtin_sql()}, cur AS (SELECT library_id, {_RENAMED} AS name, settings_json FROM v_presets),
 lib AS (SELECT DISTINCT library_id FROM cur WHERE library_id % 6 <> 0) SELECT * FROM cur UNION ALL
 SELECT library_id, name, settings_json FROM lib CROSS JOIN builtin b WHERE NOT EXISTS (SELECT 1 FROM cur WHERE cur.library_id = lib.library_id AND cur.name = b.name)""",
)
def _(spark, sf_dir):
    current = view(spark, sf_dir, "v_presets").select("library_id", F.expr(_RENAMED).alias("name"), "settings_json")
    seeded = current.where("library_id % 6 = 0").select("library_id").distinct()
    return P.seed_presets(current, seeded=seeded)


_ALL = "SELECT library_id, name, seq, settings_json FROM v_presets QUALIFY row_number() OVER (PARTITION BY library_id, name ORDER BY seq) = 1"
_LIBRARY = "SELECT library_id, name, seq, settings_json FROM v_presets WHERE row_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY library_id, name ORDER BY seq) = 1"


def _library(spark, sf_dir, which="true"):
    rows = view(spark, sf_dir, "v_presets").where(which)
    first = rows.groupBy("library_id", "name").agg(F.min(F.struct("seq", "settings_json")).alias("f"))
    return first.select("library_id", "name", "f.seq", "f.settings_json")


@case(
    "upsert_presets",
    f"""{with_views('v_presets')}, cur AS ({_LIBRARY}), u AS (SELECT *, 0 AS n FROM cur UNION ALL SELECT library_id, name, seq, settings_json, 1 FROM v_presets WHERE row_id % 2 = 1)
 SELECT library_id, name, seq, settings_json FROM u QUALIFY row_number() OVER (PARTITION BY library_id, name ORDER BY n DESC, seq DESC) = 1""",
)
def _(spark, sf_dir):
    incoming = view(spark, sf_dir, "v_presets").where("row_id % 2 = 1").select("library_id", "name", "seq", "settings_json")
    return P.in_name_order(P.upsert_presets(_library(spark, sf_dir, "row_id % 2 = 0"), incoming))


_MOVES = "library_id % 3 = 0 AND name LIKE '%1'"


@case(
    "rename_presets",
    f"""{with_views('v_presets')}, cur AS ({_ALL}), mv AS (SELECT *, concat(left(name, length(name) - 1), '2') AS new_name FROM cur WHERE {_MOVES}),
 st AS (SELECT * FROM cur WHERE NOT EXISTS (SELECT 1 FROM mv WHERE mv.library_id = cur.library_id AND (mv.name = cur.name OR mv.new_name = cur.name)))
 SELECT library_id, name, seq, settings_json FROM st UNION ALL SELECT library_id, new_name, seq, settings_json FROM mv""",
)
def _(spark, sf_dir):
    current = _library(spark, sf_dir)
    renames = current.where(_MOVES).selectExpr(
        "library_id", "name AS old_name", "concat(left(name, length(name) - 1), '2') AS new_name"
    ).unionByName(current.selectExpr("library_id", "'no such preset' AS old_name", "'x' AS new_name").distinct())
    return P.rename_presets(current, renames)


@case(
    "remove_presets",
    f"{with_views('v_presets')}, cur AS ({_ALL}) SELECT library_id, name, seq, settings_json FROM cur WHERE NOT ({_MOVES})",
)
def _(spark, sf_dir):
    current = _library(spark, sf_dir)
    return P.remove_presets(current, current.where(_MOVES).select("library_id", "name"))


@case(
    "fallback_encoder",
    f"""{_QUALITY}, f AS (SELECT row_id, encoder, CASE WHEN row_id % 5 IN (0, 1) AND encoder IS NOT NULL THEN CASE WHEN encoder = 'mozjpeg' THEN 'browser-jpeg'
  WHEN encoder = 'webp' AND NOT lossless THEN 'browser-webp' WHEN encoder = 'oxipng' THEN 'browser-png' END END AS fallback, quality FROM q)
 SELECT row_id, encoder, fallback, CASE WHEN fallback IN ('browser-jpeg', 'browser-webp') THEN quality / 100 END AS fallback_quality FROM f""",
)
def _(spark, sf_dir):
    rows = _tuned(spark, sf_dir).withColumn(
        "failure", F.expr("CASE row_id % 5 WHEN 0 THEN 'load' WHEN 1 THEN 'timeout' WHEN 2 THEN 'abort' ELSE 'encode' END")
    )
    return P.fallback_encoder(rows).select("row_id", "encoder", "fallback", "fallback_quality")


@case(
    "presets_io",
    f"""{_PRESETS}, r AS (SELECT preset_json, {_PRESET_REASON} AS reject_reason FROM v_presets JOIN reasons ON id = row_id)
 SELECT CASE WHEN json_valid(preset_json) AND json_type(preset_json, '$.name') = 'VARCHAR' THEN json_extract_string(preset_json, '$.name') END AS name, reject_reason IS NULL AS valid, reject_reason, count(*) AS n FROM r GROUP BY ALL""",
)
def _(spark, sf_dir):
    """Write all presets, read them back, count by name and verdict."""
    folder = scratch_folder(spark, "presets")
    assets.write_presets(view(spark, sf_dir, "v_presets"), folder)
    found = assets.read_presets(spark, folder, layout="lines")
    return found.groupBy("name", "valid", "reject_reason").agg(F.count(F.lit(1)).alias("n"))
