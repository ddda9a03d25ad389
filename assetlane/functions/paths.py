"""Path and file-name expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlane.functions.encoders import encoder_attr

# Fixed value: the white space that string trimming removes.
WHITE_SPACE = (
    r"[\t-\r \xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)

# Names that are never taken in from a folder.
IGNORED_NAMES = ["__MACOSX", ".DS_Store", "Thumbs.db", "desktop.ini"]


def trim_ws(value: Column) -> Column:
    return F.regexp_replace(value, rf"^{WHITE_SPACE}+|{WHITE_SPACE}+\z", "")


def forward(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def basename(path: Column) -> Column:
    return F.substring_index(forward(path), "/", -1)


def folder_of(path: Column) -> Column:
    """Everything before the last segment, '' when there is none."""
    return F.regexp_extract(forward(path), r"(?s)^(.*)/[^/]*\z", 1)


def join_path(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).otherwise(
        F.concat(F.regexp_replace(folder, r"/+\z", ""), F.lit("/"), name)
    )


def extension_of(name: Column) -> Column:
    """Lower-case extension; a leading dot is a hidden file, not an extension."""
    return F.lower(F.regexp_extract(basename(name), r"(?s).\.([A-Za-z0-9]+)\z", 1))


def safe_path(path: Column) -> Column:
    """Relative path without drive letter, empty, '.' or '..' segments."""
    cleaned = F.regexp_replace(forward(path), r"^[a-zA-Z]:", "")
    segments = F.transform(F.split(cleaned, "/", -1), trim_ws)
    return F.array_join(F.filter(segments, lambda s: ~s.isin("", ".", "..")), "/")


def is_ignored(name: Column) -> Column:
    return name.isin(IGNORED_NAMES) | name.startswith(".")


def path_columns(df: DataFrame, path: str = "path") -> DataFrame:
    """``+basename, +folder, +stem, +ext, +safe_path``."""
    base, ext = basename(F.col(path)), extension_of(F.col(path))
    return df.withColumns(
        {
            "basename": base,
            "folder": folder_of(F.col(path)),
            "stem": F.when(ext == "", base).otherwise(
                F.substring(base, F.lit(1), F.length(base) - F.length(ext) - F.lit(1))
            ),
            "ext": ext,
            "safe_path": safe_path(F.col(path)),
        }
    )


def swap_extension(name: Column, ext: Column) -> Column:
    pattern = r"\.[^./\\]*\z"
    return F.when(
        name.rlike(pattern), F.concat(F.regexp_replace(name, pattern, "."), ext)
    ).otherwise(F.concat(name, F.lit("."), ext))


def output_name(df: DataFrame, name: str = "path", encoder: str = "encoder") -> DataFrame:
    """``+out_name, +out_mime``; identity keeps the source name."""
    ext = encoder_attr(F.col(encoder), "ext")
    base = basename(F.col(name))
    return df.withColumns(
        {
            "out_name": F.when(ext == "", base).otherwise(swap_extension(base, ext)),
            "out_mime": encoder_attr(F.col(encoder), "mime"),
        }
    )


MAX_NAME = 255
MAX_SEGMENT = 180


def safe_names(df: DataFrame, name: str = "path", fallback: str = "image") -> DataFrame:
    """``+safe_name`` for a save dialog, ``+segment`` for one storage entry."""
    text = F.regexp_replace(basename(F.col(name)), r"[\x00-\x1F\x7F]", "")
    text = F.regexp_replace(F.translate(text, ":", "-"), rf"{WHITE_SPACE}+", " ")
    text = trim_ws(text)
    ext = extension_of(text)
    stem = F.substring(text, F.lit(1), F.length(text) - F.length(ext) - F.lit(1))
    capped = F.when(ext == "", F.substring(text, 1, MAX_NAME)).otherwise(
        F.concat(
            F.substring(stem, F.lit(1), F.lit(MAX_NAME - 1) - F.length(ext)), F.lit("."), ext
        )
    )
    segment = F.regexp_replace(F.col(name), r"\p{Cc}", "")
    segment = F.regexp_replace(segment, r'[/\\:*?"<>|]', "_")
    segment = F.substring(trim_ws(F.regexp_replace(segment, r"^\.+", "")), 1, MAX_SEGMENT)
    return df.withColumns(
        {
            "safe_name": F.when(text.isin("", ".", ".."), F.lit(fallback))
            .when(F.length(text) <= MAX_NAME, text)
            .otherwise(capped),
            "segment": F.when(segment == "", F.lit("_")).otherwise(segment),
        }
    )
