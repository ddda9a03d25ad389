"""Untrusted settings JSON: validation, rebuilding, equality."""

from __future__ import annotations

import json as jsonlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlane.functions.encoders import DEFAULT_OPTIONS, DEFAULT_RESIZE, ENCODER_IDS, lookup
from assetlane.functions.numbers import clamp, dbl, js_round, plain_number

# Resize methods and fits.
RESIZE_METHODS = [
    "lanczos3", "mitchell", "catrom", "triangle", "browser-high", "browser-pixelated",
]
FIT_METHODS = ["stretch", "contain"]

# Fixed values: (method, quality) pairs of the lossless WebP effort ladder, and its default index.
WEBP_LADDER = [
    (0, 0), (1, 20), (2, 25), (3, 30), (3, 50), (4, 50), (4, 75), (4, 90), (5, 90), (6, 100),
]
WEBP_LADDER_DEFAULT = 6

# Start-up application settings and the thread range.
APP_DEFAULTS = {"defaultEncoder": "avif", "keepExif": False, "workerThreads": 4}
THREAD_RANGE = (1, 16)

MAX_TOKEN = 2048
PRESET_VERSION = 1


def _kind(value) -> str:
    return "boolean" if isinstance(value, bool) else "number"


def _text(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def option_types() -> Column:
    """encoder -> option key -> primitive type; a constant, folded by the optimizer."""
    table = {e: {k: _kind(v) for k, v in opts.items()} for e, opts in DEFAULT_OPTIONS.items()}
    return F.from_json(F.lit(jsonlib.dumps(table)), "map<string,map<string,string>>")


def default_entries() -> Column:
    """encoder -> array of (key, type, default text); a constant, folded by the optimizer."""
    table = {
        e: [{"key": k, "type": _kind(v), "value": _text(v)} for k, v in opts.items()]
        for e, opts in DEFAULT_OPTIONS.items()
    }
    return F.from_json(
        F.lit(jsonlib.dumps(table)), "map<string,array<struct<key:string,type:string,value:string>>>"
    )


# ------------------------------------------------------------------- one pass over the document
#
# A document is parsed once into a VARIANT, and its two objects become maps of (kind, text). All
# rules below are look-ups in those maps.


def json_kind(value: Column) -> Column:
    """'string', 'boolean', 'null', 'object', 'array' or 'number' of a VARIANT."""
    name = F.split_part(F.schema_of_variant(value), F.lit("<"), F.lit(1))
    return F.when(name.isin("STRING", "BOOLEAN", "OBJECT", "ARRAY"), F.lower(name)).when(
        name == "VOID", "null"
    ).otherwise("number")


def typed_members(value: Column, path: str) -> Column:
    """The object at ``path`` as map<string, struct<kind, text>>; null when it is no object."""
    found = F.try_variant_get(value, path, "map<string,variant>")
    return F.transform_values(
        found,
        lambda _k, v: F.struct(
            json_kind(v).alias("kind"), F.try_variant_get(v, "$", "string").alias("text")
        ),
    )


def settings_parts(df: DataFrame, doc: str = "__v", at: str = "$") -> DataFrame:
    """``+__enc, +__opts, +__resize`` of the settings at ``at`` in a VARIANT column."""
    v = F.col(doc)
    return df.withColumns(
        {
            "__enc": F.try_variant_get(v, f"{at}.encoderId", "string"),
            "__opts": typed_members(v, f"{at}.encoderOptions"),
            "__resize": typed_members(v, f"{at}.processorState.resize"),
        }
    )


def parse(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("__v", F.try_parse_json(F.col(source)))


PARTS = ["__v", "__enc", "__opts", "__resize"]


def _finite(text: Column) -> Column:
    """A finite double, else null."""
    n = text.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < dbl(float("inf"))), n)


def member(members: str, key: str, kind: str) -> Column:
    """The text of one member when it is of that kind, else null."""
    found = F.try_element_at(F.col(members), F.lit(key))
    return F.when(found["kind"] == kind, found["text"])


def _not(condition: Column) -> Column:
    return ~F.coalesce(condition, F.lit(False))


# ---------------------------------------------------------------------------------- validation


def shape_reason() -> Column:
    """Why the parts are not recognisably settings; null when they are."""
    given = lambda key, kind: _not(F.try_element_at(F.col("__resize"), F.lit(key))["kind"] == kind)
    return (
        F.when(F.col("__v").isNull(), "not-an-object")
        .when(_not(F.col("__enc").isin(ENCODER_IDS)), "unknown-encoder")
        .when(F.col("__opts").isNull(), "options-missing")
        .when(F.col("__resize").isNull(), "resize-missing")
        .when(given("enabled", "boolean"), "resize-enabled")
        .when(given("width", "number") | given("height", "number"), "resize-size")
        .when(given("method", "string"), "resize-method")
    )


def option_reason() -> Column:
    """Unknown option keys, then values of another type or not finite; null when all fit."""
    types = F.try_element_at(option_types(), F.col("__enc"))
    entries = F.map_entries("__opts")
    unknown = F.exists(F.map_keys("__opts"), lambda k: F.try_element_at(types, k).isNull())

    def wrong(e: Column) -> Column:
        kind = e["value"]["kind"]
        return (kind != F.try_element_at(types, e["key"])) | (
            (kind == "number") & _finite(e["value"]["text"]).isNull()
        )

    return F.when(unknown, "unknown-option").when(F.exists(entries, wrong), "option-type")


def _judge(df: DataFrame, reason: Column) -> DataFrame:
    judged = df.withColumn("reject_reason", reason).drop(*PARTS)
    return judged.withColumn("valid", F.col("reject_reason").isNull())


def validate_settings(df: DataFrame, json: str = "settings_json") -> DataFrame:
    """V1: ``+valid, +reject_reason``, strict (no unknown keys, no type changes)."""
    return _judge(settings_parts(parse(df, json)), F.coalesce(shape_reason(), option_reason()))


def preset_reason(df: DataFrame) -> Column:
    """V3 on rows that went through ``preset_parts``."""
    top = lambda key, kind: member("__top", key, kind)
    return F.coalesce(
        F.when(F.col("__top").isNull(), "not-an-object")
        .when(_not(_finite(top("v", "number")) == dbl(PRESET_VERSION)), "version")
        .when(_not(F.length(top("name", "string")) > 0), "name"),
        shape_reason(), option_reason(),
    )


def preset_parts(df: DataFrame) -> DataFrame:
    """Parts of the preset in ``__v``: its own members in ``__top``, its settings as usual."""
    return settings_parts(df.withColumn("__top", typed_members(F.col("__v"), "$")), "__v", "$.side")


def validate_presets(df: DataFrame, json: str = "preset_json") -> DataFrame:
    """V3: version 1, a non-empty string name, and V1 on ``side``."""
    rows = preset_parts(parse(df, json))
    return _judge(rows, preset_reason(rows)).drop("__top")


# ---------------------------------------------------------------------------------- rebuilding


def sanitise_settings(df: DataFrame, json: str = "settings_json") -> DataFrame:
    """V2: rebuild from defaults; ``+encoder, +options, +enabled, +width, +height, +method,
    +premultiply, +linear_rgb, +fit``. All null when the record is not recognisable.

    ``options`` is map<string,string> with every option of the encoder.
    """
    rows = settings_parts(parse(df, json)).withColumn("__ok", shape_reason().isNull())
    raw, ok = F.col("__opts"), F.col("__ok")

    def kept(e: Column) -> Column:
        given = F.try_element_at(raw, e["key"])
        text = F.when(
            given["kind"] == e["type"],
            F.when(e["type"] == "number", plain_number(_finite(given["text"]))).otherwise(given["text"]),
        )
        return F.struct(e["key"].alias("key"), F.coalesce(text, e["value"]).alias("value"))

    options = F.map_from_entries(
        F.transform(F.try_element_at(default_entries(), F.col("__enc")), kept)
    )

    def size(name: str) -> Column:
        whole = js_round(_finite(member("__resize", name, "number")))
        default = F.lit(DEFAULT_RESIZE[name]).cast("bigint")
        return F.when(whole >= 1, whole).when(whole.isNotNull(), F.lit(1)).otherwise(default)

    def flag(name: str) -> Column:
        return F.coalesce(
            member("__resize", name, "boolean").cast("boolean"), F.lit(DEFAULT_RESIZE[name])
        )

    def choice(name: str, allowed: list[str]) -> Column:
        text = member("__resize", name, "string")
        return F.when(text.isin(allowed), text).otherwise(DEFAULT_RESIZE[name])

    fields = {
        "encoder": F.col("__enc"), "options": options, "enabled": flag("enabled"),
        "width": size("width"), "height": size("height"),
        "method": choice("method", RESIZE_METHODS), "premultiply": flag("premultiply"),
        "linear_rgb": flag("linearRGB"), "fit": choice("fitMethod", FIT_METHODS),
    }
    return rows.withColumns({k: F.when(ok, v) for k, v in fields.items()}).drop(*PARTS, "__ok")


def sanitise_app_settings(df: DataFrame, json: str = "app_json") -> DataFrame:
    """V4: ``+default_encoder, +keep_exif, +worker_threads``."""
    rows = parse(df, json).withColumn("__top", typed_members(F.col("__v"), "$"))
    encoder = member("__top", "defaultEncoder", "string")
    threads = js_round(_finite(member("__top", "workerThreads", "number")))
    low, high = (F.lit(n).cast("bigint") for n in THREAD_RANGE)
    return rows.withColumns(
        {
            "default_encoder": F.when(encoder.isin(ENCODER_IDS), encoder).otherwise(
                APP_DEFAULTS["defaultEncoder"]
            ),
            "keep_exif": F.coalesce(
                member("__top", "keepExif", "boolean").cast("boolean"),
                F.lit(APP_DEFAULTS["keepExif"]),
            ),
            "worker_threads": F.coalesce(
                clamp(threads, low, high), F.lit(APP_DEFAULTS["workerThreads"]).cast("bigint")
            ),
        }
    ).drop("__v", "__top")


def share_tokens(df: DataFrame, url: str = "url", param: str = "p") -> DataFrame:
    """V5: ``+token, +token_error``.

    The parameter is taken from the query string, else from the fragment (after its '?', or the
    whole of it). Tokens over 2048 characters or not base64url are flagged.
    """
    address = F.col(url)
    query = F.regexp_extract(address, r"(?s)^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(address, r"(?s)^[^#]*#(.*)\z", 1)
    inner = F.regexp_replace(fragment, r"(?s)^[^?]*\?", "")

    def value(text: Column) -> Column:
        raw = F.regexp_extract(text, rf"(?:^|&){param}=([^&]*)", 1)
        return F.nullif(F.coalesce(F.try_url_decode(raw), raw), F.lit(""))

    df = df.withColumn("token", F.coalesce(value(query), value(inner)))
    token = F.col("token")
    bare = F.regexp_replace(token, r"={1,2}\z", "")
    padded = F.length(bare) < F.length(token)
    well_formed = bare.rlike(r"^[A-Za-z0-9+/_\-]*\z") & (F.length(bare) % 4 != 1) & (
        ~padded | (F.length(token) % 4 == 0)
    )
    return df.withColumn(
        "token_error",
        F.when(F.length(token) > MAX_TOKEN, "too-large").when(~well_formed, "not-base64url"),
    )


# ------------------------------------------------------------------------------------ equality


def _entry_key(members: Column) -> Column:
    """An object's members, sorted, as a JSON list of (key, kind, text); numbers in one form."""
    def one(e: Column) -> Column:
        kind, text = e["value"]["kind"], e["value"]["text"]
        number = F.when(kind == "number", plain_number(text.try_cast("double")))
        return F.struct(e["key"].alias("k"), kind.alias("t"), F.coalesce(number, text, F.lit("null")).alias("v"))

    return F.to_json(F.array_sort(F.transform(F.map_entries(members), one)))


def settings_keys(df: DataFrame, json: str = "settings_json") -> DataFrame:
    """``+encoder_key, +options_key, +resize_key``: two settings are equal iff all three are.

    A disabled resize is one token, whatever sizes sit behind the switch.
    """
    on = F.coalesce(member("__resize", "enabled", "boolean") == "true", F.lit(False))
    return settings_parts(parse(df, json)).withColumns(
        {
            "encoder_key": F.col("__enc"), "options_key": _entry_key(F.col("__opts")),
            "resize_key": F.when(on, _entry_key(F.col("__resize"))).otherwise("off"),
        }
    ).drop(*PARTS)


def fingerprint(df: DataFrame, settings: str = "settings_json", fp: str = "fp") -> DataFrame:
    """V6: ``+fp``, a 256-bit key that is equal exactly for equal settings; null if unreadable."""
    keyed = settings_keys(df, settings)
    key = F.sha2(F.to_json(F.array("encoder_key", "options_key", "resize_key")), 256)
    return keyed.withColumn(fp, F.when(F.col("encoder_key").isNotNull(), key)).drop(
        "encoder_key", "options_key", "resize_key"
    )


# ------------------------------------------------------------------------------------- quality


def quality_columns(df: DataFrame) -> DataFrame:
    """``+quality, +lossless, +knob_kind, +knob_value`` from sanitised settings columns."""
    enc = F.col("encoder")

    def number(key: str) -> Column:
        return F.try_element_at(F.col("options"), F.lit(key)).cast("double")

    quality = F.when(enc.isin("avif", "jxl", "webp", "mozjpeg"), number("quality")).when(
        enc.isin("browser-jpeg", "browser-webp"), js_round(number("quality") * dbl(100)).cast("double")
    )
    webp_exact = (enc == "webp") & (number("lossless") == dbl(1))
    lossless = (
        F.when(
            enc == "avif",
            (number("quality") == dbl(100)) & number("qualityAlpha").isin(-1.0, 100.0)
            & (number("subsample") == dbl(3)),
        )
        .when(enc == "jxl", number("quality") == dbl(100))
        .when(enc == "webp", number("lossless") == dbl(1))
        .when(enc.isNotNull(), F.lit(False))
    )
    rungs = {f"{m}:{q}": i for i, (m, q) in enumerate(WEBP_LADDER)}
    rung = F.coalesce(
        lookup(rungs, F.concat_ws(":", plain_number(number("method")), plain_number(number("quality")))),
        F.lit(WEBP_LADDER_DEFAULT),
    ).cast("double")
    return df.withColumns(
        {
            "quality": quality,
            "lossless": lossless,
            "knob_kind": F.when(webp_exact | (enc == "oxipng"), "effort")
            .when(quality.isNotNull(), "quality").when(enc.isNotNull(), "none"),
            "knob_value": F.when(webp_exact, rung).when(enc == "oxipng", number("level"))
            .otherwise(quality),
        }
    )
