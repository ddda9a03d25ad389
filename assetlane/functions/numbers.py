"""Number rules of the source semantics: rounding, clamping, byte stores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dbl(value: float) -> Column:
    """A DOUBLE literal (a bare Python int would be typed INT)."""
    return F.lit(float(value))


def js_round(value: Column) -> Column:
    """Round half towards +infinity, as a BIGINT."""
    return F.floor(value.cast("double") + dbl(0.5))


def clamp(value: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    # greatest and least pass over nulls, so null is kept by hand
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))


def byte_store(value: Column) -> Column:
    """Clamped byte: half to even, limited to 0..255."""
    return clamp(F.bround(value.cast("double"), 0), dbl(0), dbl(255)).cast("int")


def byte_round(value: Column) -> Column:
    """Nearest byte of a weighted mean, limited to 0..255.

    Halves within 1e-9 go up, so the byte does not hang on the order in which terms were added.
    """
    return clamp(js_round(value + dbl(1e-9)), F.lit(0).cast("bigint"), F.lit(255).cast("bigint")).cast("int")


def int_div(value: Column, by) -> Column:
    """Floor division of non-negative integers, staying an INT."""
    by = by if isinstance(by, Column) else F.lit(by)
    return F.floor(value / by).cast("int")


def plain_number(value: Column) -> Column:
    """A double as JSON prints it: whole numbers without a fraction."""
    whole = (value == F.floor(value)) & (F.abs(value) < dbl(1e15))
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))
