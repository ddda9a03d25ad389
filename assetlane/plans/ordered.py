"""Running values and spans inside a key without putting the whole key into one task.

A plain window ``partitionBy(key).orderBy(x)`` sorts every row of a key in one task; a key with a
third of all rows would stall the job. Here rows are cut into *chunks* along the order column. The
window runs inside (key, chunk), one small row per (key, chunk) carries the total over to the
next chunk, and only that row is joined back. The result is the exact window result.

``chunk`` is a number of rows (the usual way) or a column that grows with the order column. For a
number, one aggregate over the order column finds its quantiles; the ranges between them hold about
as many rows, so no (key, chunk) holds more, whatever the keys and whatever the scale of the
order column. At most ``POINTS`` chunks are made, which also bounds the rows carried per key.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from assetlane.session import hand_over

CHUNK_ROWS = 1_000_000
POINTS = 4096


def as_number(df: DataFrame, order: Column) -> Column:
    """An order column as a number: microseconds of a timestamp."""
    kind = df.select(order.alias("x")).schema["x"].dataType
    return F.unix_micros(order.cast("timestamp")) if isinstance(kind, (TimestampType, TimestampNTZType)) else order


def cut(df: DataFrame, order: Column, chunk: Column | int) -> tuple[DataFrame, bool]:
    """+__chunk, and whether there is more than one. Equal order values share a chunk, nulls are in the first."""
    if isinstance(chunk, Column):
        return df.withColumn("__chunk", chunk), True
    x = as_number(df, order)
    points = [i / POINTS for i in range(1, POINTS)]
    found = df.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(x, points, 10 * POINTS).alias("at")).first()
    pieces = min(POINTS, math.ceil(found["n"] / chunk))
    bounds = sorted({found["at"][i * POINTS // pieces - 1] for i in range(1, pieces)}) if found["at"] else []
    if not bounds:
        return df.withColumn("__chunk", F.lit(0)), False
    # the number of bounds below x, by bisection: one projection a step, all in generated code
    steps = len(bounds).bit_length()
    kind = "array<bigint>" if isinstance(bounds[0], int) else "array<double>"
    table = F.lit(bounds + [bounds[-1]] * (2 ** steps - 1 - len(bounds))).cast(kind)
    df = df.withColumn("__x", x).withColumn("__chunk", F.lit(0))
    for step in reversed(range(steps)):
        beyond = F.get(table, F.col("__chunk") + (2 ** step - 1)) < F.col("__x")
        df = df.withColumn("__chunk", F.col("__chunk") + F.when(beyond, 2 ** step).otherwise(0))
    return df.withColumn("__chunk", F.least("__chunk", F.lit(len(bounds)))).drop("__x"), True


def by_step(seq: str | Column, rows: int = CHUNK_ROWS) -> Column:
    """Chunk of a dense integer order column: at most ``rows`` distinct values each."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    return F.floor(seq / F.lit(rows)).cast("bigint")


def by_time(ts: str | Column, seconds: int) -> Column:
    """Chunk of an event time column: ``seconds`` of time each."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("bigint")


def _with_totals(rows: DataFrame, totals: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Rows with what is carried to their (key, chunk); null keys are keys."""
    totals = totals.withColumnsRenamed({c: f"__of_{i}" for i, c in enumerate(ids)})
    same = [F.col(c).eqNullSafe(F.col(f"__of_{i}")) for i, c in enumerate(ids)]
    return rows.join(totals, same, "left").drop(*[f"__of_{i}" for i in range(len(ids))])


def _carry(rows: DataFrame, keys: Sequence[str], more: bool, inside: Column, total: Column,
           across: Column, final: Column, name: str) -> DataFrame:
    """``inside`` a chunk, ``total`` of each, ``across`` earlier chunks, and ``final`` of both."""
    ids = [*keys, "__chunk"]
    rows = rows.withColumn("__in", inside)
    if not more:
        return rows.withColumn("__before", F.lit(None).cast("bigint")).withColumn(name, final).drop(
            "__chunk", "__in", "__before", "__value")
    rows = hand_over(rows, "running")
    earlier = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*ids).agg(total.alias("__total")).select(*ids, across.over(earlier).alias("__before"))
    joined = _with_totals(rows, carried.where("__before IS NOT NULL"), ids)
    return joined.withColumn(name, final).drop("__chunk", "__in", "__before", "__value")


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, name: str,
    chunk: Column | int = CHUNK_ROWS,
) -> DataFrame:
    """``+name`` = sum of ``value`` up to and including the row."""
    rows, more = cut(df.withColumn("__value", value), order[0], chunk)
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    zero = F.lit(0).cast("bigint")
    return _carry(rows, keys, more, F.sum("__value").over(inside), F.sum("__value"), F.sum("__total"),
                  F.coalesce("__in", zero) + F.coalesce("__before", zero), name)


def running_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, chunk: Column | int = CHUNK_ROWS
) -> DataFrame:
    """``+name`` = 1-based position of the row inside its key."""
    return running_sum(df, keys, order, F.lit(1).cast("bigint"), name, chunk)


def running_max(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, name: str,
    chunk: Column | int = CHUNK_ROWS, before: bool = False,
) -> DataFrame:
    """``+name`` = largest ``value`` so far; with ``before`` the row itself does not count."""
    rows, more = cut(df.withColumn("__value", value), order[0], chunk)
    last = -1 if before else Window.currentRow
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, last
    )
    return _carry(rows, keys, more, F.max("__value").over(inside), F.max("__value"), F.max("__total"),
                  F.greatest("__in", "__before"), name)


def spans(
    df: DataFrame, keys: Sequence[str], ts: str, gap_seconds: float, first: Mapping[str, Column],
    merge: Mapping[str, Column], order: Sequence[str] = (), closes: Column | None = None,
    chunk: Column | int = CHUNK_ROWS,
) -> DataFrame:
    """Keys and aggregates of every span of events.

    A span goes on while the next event, by ``ts`` and ``order``, comes within the gap; an event for which
    ``closes`` holds is the last of its span. ``first`` aggregates events, ``merge`` the results of
    parts of one span. Rows are shuffled once by (key, chunk) and summed there to parts of spans; of these the
    first of a chunk may go on from the chunk before, which a window over the edges of a key's chunks decides.
    Null times count as before all others, a null ``closes`` as false.
    """
    names, gap = list(first), F.lit(int(round(gap_seconds * 1_000_000)))
    rows, more = cut(df, F.col(ts), chunk)
    rows = rows.withColumns({
        "__t": F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(-(1 << 62))),
        "__shut": F.coalesce(closes, F.lit(False)) if closes is not None else F.lit(False)})
    inside = Window.partitionBy(*keys, "__chunk").orderBy("__t", *order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = F.lag(F.struct("__t", "__shut")).over(inside)
    rows = rows.withColumn("__earlier", earlier).withColumn("__part", F.sum(F.when(
        F.col("__earlier").isNull() | F.col("__earlier.__shut") | (F.col("__t") - F.col("__earlier.__t") > gap), 1
    ).otherwise(0)).over(so_far))
    parts = rows.groupBy(*keys, "__chunk", "__part").agg(
        *[e.alias(n) for n, e in first.items()], F.min("__t").alias("__lo"), F.max("__t").alias("__hi"),
        F.max("__shut").alias("__shut"))
    if not more:
        return parts.select(*keys, *names)
    parts = hand_over(parts, "span-parts")
    edges = parts.groupBy(*keys, "__chunk").agg(
        F.min("__lo").alias("lo"), F.max("__hi").alias("hi"), F.max("__lo").alias("last"), F.max("__part").alias("n"),
        F.max_by("__shut", "__part").alias("shut"))
    along = Window.partitionBy(*keys).orderBy("__chunk")
    edges = edges.withColumn("goes_on", F.coalesce(
        ~F.lag("shut").over(along) & (F.col("lo") - F.lag("hi").over(along) <= gap), F.lit(False)))
    # the part in which the span that is open at a chunk's end began; nothing new where its only part goes on
    began = F.when(~F.col("goes_on") | (F.col("n") > 1), F.struct(F.col("__chunk").alias("chunk"), F.col("n").alias("part")))
    carried = edges.withColumn("__began", F.last(began, ignorenulls=True).over(
        along.rowsBetween(Window.unboundedPreceding, -1))).where("goes_on").select(
        *keys, "__chunk", F.lit(1).cast("bigint").alias("__part"), "__began")
    whole = _with_totals(parts, carried, [*keys, "__chunk", "__part"]).withColumns({
        "__chunk": F.coalesce("__began.chunk", "__chunk"), "__part": F.coalesce("__began.part", "__part")})
    return whole.groupBy(*keys, "__chunk", "__part").agg(*[merge[n].alias(n) for n in names]).select(*keys, *names)


def sessions(
    df: DataFrame, keys: Sequence[str], ts: str, gap_seconds: float, chunk_seconds: int | None = None,
) -> DataFrame:
    """``+session_start``: first event time of the row's session.

    A session goes on while the next event comes within ``gap_seconds``. Previous event and latest
    session start both carry across chunks, so one endless session is no special case.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = F.lit(int(round(gap_seconds * 1_000_000)))
    chunk = by_time(ts, chunk_seconds) if chunk_seconds else CHUNK_ROWS
    flagged = running_max(df, keys, [F.col(ts)], micros, "__prev", chunk, before=True)
    start = F.when(F.col("__prev").isNull() | (micros - F.col("__prev") > gap), micros)
    out = running_max(flagged, keys, [F.col(ts)], start, "__start", chunk)
    return out.withColumn("session_start", F.timestamp_micros("__start")).drop("__prev", "__start")
