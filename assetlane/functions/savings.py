"""Savings, verdicts and captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlane.functions.numbers import dbl, js_round

# SSIM cut points and the saving that is worth a change of format, in percent.
LOSSLESS, OVERKILL, EXCELLENT, GOOD, SOFT, VISIBLE = 1.0, 0.998, 0.994, 0.985, 0.96, 0.94
SAVINGS_FLOOR = 5

# Fixed values: (cut, verdict, tone), best first; the last row has no cut.
VERDICTS = [
    (LOSSLESS, "Lossless", "good"),
    (OVERKILL, "Overkill", "ok"),
    (EXCELLENT, "Excellent", "good"),
    (GOOD, "Good", "good"),
    (SOFT, "Soft", "ok"),
    (VISIBLE, "Watch skies", "warn"),
    (None, "Visible loss", "warn"),
]

# Fixed values: (cut, caption, short caption, tone).
CAPTIONS = [
    (LOSSLESS, "Mathematically identical", "Identical", "good"),
    (EXCELLENT, "Below visible threshold", "Looks identical", "good"),
    (GOOD, "Looks identical", "Looks identical", "good"),
    (SOFT, "Minor loss on gradients", "Minor loss", "ok"),
    (VISIBLE, "Visible loss", "Visible loss", "warn"),
    (None, "Heavy loss", "Heavy loss", "warn"),
]
ACCENTS = {"good": "green", "ok": "yellow", "warn": "red"}


def saved_percent(src: Column, out: Column) -> Column:
    """Whole percent saved; 0 for an empty source, null without an output."""
    s, o = src.cast("double"), out.cast("double")
    pct = js_round((s - o) / F.when(s > 0, s) * dbl(100))
    return F.when(out.isNotNull(), F.when(src <= 0, F.lit(0).cast("bigint")).otherwise(pct))


def saved_fraction(src: Column, out: Column) -> Column:
    s, o = src.cast("double"), out.cast("double")
    return F.when(src > 0, dbl(1) - o / F.when(s > 0, s))


def savings(df: DataFrame, src: str = "original_bytes", out: str = "size") -> DataFrame:
    """``+saved_pct, +saved_frac, +ratio, +delta``."""
    s, o = F.col(src), F.col(out)
    whole = F.when(s != 0, s.cast("double"))
    return df.withColumns(
        {
            "saved_pct": saved_percent(s, o),
            "saved_frac": saved_fraction(s, o),
            "ratio": o.cast("double") / whole,
            "delta": s - o,
        }
    )


def _ladder(ssim: Column, table, field: int, unmeasured) -> Column:
    # NaN sorts above every number in Spark, so it is tested first.
    chain = F.when(ssim.isNull() | F.isnan(ssim), unmeasured)
    for row in table:
        if row[0] is None:
            return chain.otherwise(row[field])
        chain = chain.when(ssim >= dbl(row[0]), row[field])
    return chain


def verdict(ssim: Column) -> Column:
    return _ladder(ssim, VERDICTS, 1, "Unmeasured")


def tone(ssim: Column) -> Column:
    return _ladder(ssim, VERDICTS, 2, "ok")


def verdicts(df: DataFrame, ssim: str = "ssim") -> DataFrame:
    """C11: ``+verdict, +tone, +caption, +short, +accent`` (accent is the caption's)."""
    s = F.col(ssim)
    accents = [(row[0], ACCENTS[row[3]]) for row in CAPTIONS]
    return df.withColumns(
        {
            "verdict": verdict(s),
            "tone": tone(s),
            "caption": _ladder(s, CAPTIONS, 1, "Not measured"),
            "short": _ladder(s, CAPTIONS, 2, "Unmeasured"),
            "accent": _ladder(s, accents, 1, "muted"),
        }
    )
