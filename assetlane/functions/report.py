"""Report strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlane.functions.encoders import lookup
from assetlane.functions.numbers import clamp, dbl, js_round
from assetlane.functions.savings import saved_percent

DASH = "—"
MINUS = "−"
TIMES = "×"
DOT = "·"

# Unit names and small numbers as words.
UNITS = ["B", "kB", "MB", "GB", "TB"]
NUMBER_WORDS = [
    "Zero", "One", "Two", "Three", "Four", "Five", "Six", "Seven", "Eight", "Nine", "Ten",
    "Eleven", "Twelve", "Thirteen", "Fourteen", "Fifteen", "Sixteen", "Seventeen", "Eighteen",
    "Nineteen", "Twenty",
]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def to_fixed(value: Column, digits: Column | int) -> Column:
    """A double with ``digits`` (0 to 3) decimals, rounded by its exact binary value, ties upwards.

    ``format_string`` rounds the shortest decimal form instead (1.035, stored a little below that,
    would print as 1.04). The product with 2 * 10^digits is compared in two exact halves.
    """
    digits = digits if isinstance(digits, Column) else F.lit(digits)
    unit = F.element_at(F.array(*[F.lit(10**d).cast("bigint") for d in range(4)]), digits + 1)

    def settle(v: Column) -> Column:
        high = F.floor(v["size"] * dbl(1 << 20)).cast("double") / dbl(1 << 20)
        twice = dbl(2) * v["unit"].cast("double")
        past = lambda limit: (high * twice - limit.cast("double")) + (v["size"] - high) * twice
        near = v["near"]
        return (
            F.when(past(near * 2 - 1) < 0, near - 1).when(past(near * 2 + 1) >= 0, near + 1)
            .otherwise(near)
        )

    def text(n: Column) -> Column:
        whole = F.floor(n / unit).cast("bigint").cast("string")
        rest = F.concat(F.lit("."), F.lpad((n % unit).cast("string"), digits, F.lit("0")))
        return F.concat(F.when(value < 0, "-").otherwise(""), whole, F.when(digits > 0, rest).otherwise(""))

    size = F.abs(value)
    parts = F.struct(
        size.alias("size"), unit.alias("unit"), js_round(size * unit.cast("double")).alias("near")
    )
    return F.when(value.isNotNull(), let(let(parts, settle), text))


def format_bytes(size: Column) -> Column:
    """SI size: ``948 B``, ``12.4 kB``, ``1.24 MB``."""
    n = size.cast("double")
    limits = [dbl(1000.0 ** (i + 1)) for i in range(len(UNITS) - 1)]

    def pick(options: list) -> Column:
        chain = F.when(n < limits[0], options[0])
        for limit, option in zip(limits[1:], options[1:-1], strict=True):
            chain = chain.when(n < limit, option)
        return chain.otherwise(options[-1])

    scaled, value = [n], n
    for _ in UNITS[1:]:
        value = value / dbl(1000)
        scaled.append(value)

    def text(v: Column) -> Column:
        digits = F.when((n < limits[0]) | (v >= 100), 0).when(v < 10, 2).otherwise(1)
        return F.concat(to_fixed(v, digits), F.lit(" "), pick(UNITS))

    empty = size.isNull() | F.isnan(n) | (n <= 0) | (n == dbl(float("inf")))
    return F.when(empty, "0 B").otherwise(let(pick(scaled), text))


def _signed(percent: Column, minus: str) -> Column:
    return (
        F.when(percent.isNull() | (percent == 0), "0%")
        .when(percent > 0, F.concat(F.lit(minus), percent.cast("string"), F.lit("%")))
        .otherwise(F.concat(F.lit("+"), F.abs(percent).cast("string"), F.lit("%")))
    )


def format_saved_pct(percent: Column) -> Column:
    return _signed(percent, "-")


def format_savings(src: Column, out: Column) -> Column:
    """The same with a typographic minus, from two sizes."""
    return _signed(saved_percent(src, out), MINUS)


def format_fraction(fraction: Column) -> Column:
    """A saved fraction as a signed percent, '' when unknown."""
    return F.when(fraction.isNull(), "").otherwise(_signed(js_round(fraction * dbl(100)), "-"))


def format_progress(fraction: Column) -> Column:
    part = F.coalesce(clamp(fraction, dbl(0), dbl(1)), dbl(0))
    return F.concat(js_round(part * dbl(100)).cast("string"), F.lit("%"))


def format_ssim(ssim: Column) -> Column:
    return F.when(ssim.isNull() | F.isnan(ssim), DASH).otherwise(to_fixed(ssim, 3))


def format_seconds(ms: Column) -> Column:
    n = ms.cast("double")
    return F.when(ms.isNull() | (n <= 0), "0.0").otherwise(to_fixed(n / dbl(1000), 1))


def format_dimensions(width: Column, height: Column) -> Column:
    return F.concat_ws(
        f" {TIMES} ", js_round(width).cast("string"), js_round(height).cast("string")
    )


def format_source(size: Column, width: Column, height: Column) -> Column:
    return F.concat(format_bytes(size), F.lit(f" {DOT} "), format_dimensions(width, height))


def format_delta(src: Column, out: Column) -> Column:
    delta = src - out
    return (
        F.when(delta == 0, "same size")
        .when(delta > 0, F.concat(format_bytes(delta), F.lit(" saved")))
        .otherwise(F.concat(format_bytes(-delta), F.lit(" larger")))
    )


def step_short(step: Column, lossless: Column) -> Column:
    return F.concat(F.when(lossless, "e").otherwise("q"), step.cast("string"))


def number_word(value: Column) -> Column:
    words = {i: word for i, word in enumerate(NUMBER_WORDS)}
    return F.coalesce(lookup(words, value.cast("int")), value.cast("string"))


def join_list(items: Column) -> Column:
    """``a``, ``a and b``, ``a, b and c``."""
    n = F.size(items)
    return F.when(n == 0, "").when(n == 1, F.get(items, 0)).otherwise(
        F.concat(
            F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(" and "),
            F.element_at(items, -1),
        )
    )


def report_text(df: DataFrame) -> DataFrame:
    """C13 on sweep cells: ``+size_text, +saved_text, +savings_text, +delta_text, +ssim_text,
    +step_text, +verdict_row``."""
    src, out, ssim = F.col("original_bytes"), F.col("size"), F.col("ssim")
    return df.withColumns(
        {
            "size_text": format_bytes(out),
            "saved_text": format_saved_pct(saved_percent(src, out)),
            "savings_text": format_savings(src, out),
            "delta_text": format_delta(src, out),
            "ssim_text": format_ssim(ssim),
            "step_text": step_short(F.col("step"), F.col("lossless")),
        }
    )


def settings_facts(df: DataFrame) -> DataFrame:
    """The settings of a batch as (label, value) rows, in order.

    Input holds the sanitised settings columns and ``quality`` (see ``sanitise_settings`` and
    ``quality_columns``).
    """
    from assetlane.functions.encoders import encoder_attr

    dims = F.concat_ws(" x ", F.col("width").cast("string"), F.col("height").cast("string"))
    resize = F.when(~F.col("enabled"), "Original size").otherwise(
        F.when(F.col("fit") == "contain", F.concat(dims, F.lit(" contain"))).otherwise(dims)
    )

    def fact(label: str, value: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), value.cast("string").alias("value"))

    facts = F.array_compact(
        F.array(
            fact("Format", encoder_attr(F.col("encoder"), "label")),
            F.when(
                F.col("quality").isNotNull(), fact("Quality", js_round(F.col("quality")))
            ),
            F.when(
                F.col("encoder") == "oxipng",
                fact("Effort", F.concat(F.lit("level "), F.try_element_at(F.col("options"), F.lit("level")))),
            ),
            fact("Resize", resize),
        )
    )
    return (
        df.select("*", F.posexplode(facts).alias("pos", "fact"))
        .select(*df.columns, "pos", "fact.label", "fact.value")
    )
