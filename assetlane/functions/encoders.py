"""The encoder dimension (C6) and its column look-ups."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values, in display order: id, label, output type, extension, lossy, alpha, worker.
ENCODERS = [
    ("identity", "Original", "", "", False, True, False),
    ("mozjpeg", "MozJPEG", "image/jpeg", "jpg", True, False, True),
    ("oxipng", "OxiPNG", "image/png", "png", False, True, True),
    ("webp", "WebP", "image/webp", "webp", True, True, True),
    ("avif", "AVIF", "image/avif", "avif", True, True, True),
    ("jxl", "JPEG XL", "image/jxl", "jxl", True, True, True),
    ("qoi", "QOI", "image/qoi", "qoi", False, True, True),
    ("browser-jpeg", "Browser JPEG", "image/jpeg", "jpg", True, False, False),
    ("browser-png", "Browser PNG", "image/png", "png", False, True, False),
    ("browser-webp", "Browser WebP", "image/webp", "webp", True, True, False),
]

# Output types that can be decoded back for measuring.
DECODABLE_TYPES = [
    "image/avif", "image/jxl", "image/webp", "image/jpeg", "image/png", "image/qoi", "image/heic",
    "image/heif",
]

# Default options per encoder.
DEFAULT_OPTIONS: dict[str, dict] = {
    "identity": {},
    "mozjpeg": {
        "quality": 75, "baseline": False, "arithmetic": False, "progressive": True,
        "optimize_coding": True, "smoothing": 0, "color_space": 3, "quant_table": 3,
        "trellis_multipass": False, "trellis_opt_zero": False, "trellis_opt_table": False,
        "trellis_loops": 1, "auto_subsample": True, "chroma_subsample": 2,
        "separate_chroma_quality": False, "chroma_quality": 75,
    },
    "oxipng": {"level": 2, "interlace": False, "optimiseAlpha": False},
    "webp": {
        "quality": 75, "target_size": 0, "target_PSNR": 0, "method": 4, "sns_strength": 50,
        "filter_strength": 60, "filter_sharpness": 0, "filter_type": 1, "partitions": 0,
        "segments": 4, "pass": 1, "show_compressed": 0, "preprocessing": 0, "autofilter": 0,
        "partition_limit": 0, "alpha_compression": 1, "alpha_filtering": 1, "alpha_quality": 100,
        "lossless": 0, "exact": 0, "image_hint": 0, "emulate_jpeg_size": 0, "thread_level": 0,
        "low_memory": 0, "near_lossless": 100, "use_delta_palette": 0, "use_sharp_yuv": 0,
    },
    "avif": {
        "quality": 50, "qualityAlpha": -1, "denoiseLevel": 0, "tileColsLog2": 0,
        "tileRowsLog2": 0, "speed": 6, "subsample": 1, "chromaDeltaQ": False, "sharpness": 0,
        "tune": 0, "enableSharpYUV": False, "bitDepth": 8, "lossless": False,
    },
    "jxl": {
        "effort": 7, "quality": 75, "progressive": False, "epf": -1, "lossyPalette": False,
        "decodingSpeedTier": 0, "photonNoiseIso": 0, "lossyModular": False, "lossless": False,
    },
    "qoi": {},
    "browser-jpeg": {"quality": 0.75},
    "browser-png": {},
    "browser-webp": {"quality": 0.75},
}

# The resize part of default settings.
DEFAULT_RESIZE = {
    "enabled": False, "width": 1, "height": 1, "method": "lanczos3", "premultiply": True,
    "linearRGB": True, "fitMethod": "stretch",
}

ENCODER_IDS = [row[0] for row in ENCODERS]
LOSSLESS_ROWS = ["oxipng", "qoi"]

_FIELDS = {
    "ord": {e[0]: i for i, e in enumerate(ENCODERS)},
    "label": {e[0]: e[1] for e in ENCODERS},
    "mime": {e[0]: e[2] for e in ENCODERS},
    "ext": {e[0]: e[3] for e in ENCODERS},
    "lossy": {e[0]: e[4] for e in ENCODERS},
    "alpha": {e[0]: e[5] for e in ENCODERS},
    "worker": {e[0]: e[6] for e in ENCODERS},
    "decodable": {e[0]: e[2] in DECODABLE_TYPES for e in ENCODERS},
}


def literal_map(values: dict) -> Column:
    """A constant map; folded once by the optimizer, so a look-up needs no join."""
    return F.create_map(*[F.lit(part) for item in values.items() for part in item])


def lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(literal_map(values), key)


def encoder_attr(encoder: Column, field: str) -> Column:
    """One attribute of the ten-row encoder dimension; null for an unknown id."""
    return lookup(_FIELDS[field], encoder)


def side_settings(encoder: str, **options) -> str:
    """Full default settings JSON for one encoder with some options replaced."""
    return json.dumps(
        {
            "encoderId": encoder,
            "encoderOptions": {**DEFAULT_OPTIONS[encoder], **options},
            "processorState": {"resize": DEFAULT_RESIZE},
        },
        separators=(",", ":"),
    )


def encoder_dim(spark: SparkSession) -> DataFrame:
    """The dimension as a DataFrame (ten rows, safe to broadcast)."""
    rows = [
        (e[0], i, *e[1:], _FIELDS["decodable"][e[0]],
         json.dumps(DEFAULT_OPTIONS[e[0]], separators=(",", ":")))
        for i, e in enumerate(ENCODERS)
    ]
    return spark.createDataFrame(
        rows,
        "encoder string, ord int, label string, mime string, ext string, lossy boolean, "
        "alpha boolean, worker boolean, decodable boolean, defaults string",
    )
