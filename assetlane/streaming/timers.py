"""Stateful stream operators with event-time timers.

Each is a ``StatefulProcessor``: rows of a key come as an iterator, state lies in the state store, and a timer
is set for the event time at which something becomes due. Event times are microseconds; timers and
the watermark are milliseconds. The state store must be the RocksDB one, see :func:`timers_enabled`.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: rows written to a state list at once
SLICE = 1000


@contextmanager
def timers_enabled(spark: SparkSession):
    """The state store that timers need, for queries started inside; the session is left as it was."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def micros(length: str) -> int:
    """An interval such as ``100 milliseconds`` in microseconds."""
    number, unit = length.split()
    each = {"microsecond": 1, "millisecond": 1000, "second": 10 ** 6, "minute": 60 * 10 ** 6, "hour": 3600 * 10 ** 6, "day": 86400 * 10 ** 6}
    return round(float(number) * each[unit.removesuffix("s")])


def moment(us: int) -> datetime:
    return datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=us)


def due(us: int) -> int:
    """The first millisecond that is not before a time."""
    return -(-us // 1000)


class PendingEdits(StatefulProcessor):
    """T1. Events wait until the watermark passes them, are then taken in order of (ts, seq), and extend the
    open span; a span ends with an event that fires at once, or when the watermark is a gap beyond it. A key has
    one timer, for the first time at which anything is due; what the watermark passes is taken at once."""

    def __init__(self, key: str, gap: int):
        self.key, self.gap = key, gap

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts bigint, seq bigint, settings string, at_once boolean")
        self.open = handle.getValueState("open", "start bigint, end bigint, settings string, n bigint")
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        part, first = [], None
        for row in rows:
            part.append((row["us"], row["seq"], row["settings"], row["at_once"]))
            first = row["us"] if first is None else min(first, row["us"])
            if len(part) == SLICE:
                self.waiting.appendList(part)
                part = []
        if part:
            self.waiting.appendList(part)
        if first is not None:
            set_to = self.timer.get()[0] if self.timer.exists() else None
            if set_to is None or due(first) < set_to:
                if set_to is not None:
                    self.handle.deleteTimer(set_to)
                self._set(due(first))
        return iter(())

    def _set(self, at: int) -> None:
        self.timer.update((at,))
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], r[1])) if self.waiting.exists() else []
        ready = [r for r in held if r[0] <= now]
        span = list(self.open.get()) if self.open.exists() else None
        was = span is not None
        for ts, _, settings, at_once in ready:
            if span and ts - span[1] > self.gap:
                yield self._row(key, span)
                span = None
            span = [span[0] if span else ts, ts, settings, (span[3] if span else 0) + 1]
            if at_once:
                yield self._row(key, span)
                span = None
        if span and span[1] + self.gap < now:
            yield self._row(key, span)
            span = None
        if ready:
            if len(ready) < len(held):
                self.waiting.put(held[len(ready):])
            else:
                self.waiting.clear()
        nexts = [due(held[len(ready)][0])] if len(ready) < len(held) else []
        if span:
            self.open.update(tuple(span))
            nexts.append(due(span[1] + self.gap) + 1)
        elif was:
            self.open.clear()
        if nexts:
            self._set(min(nexts))
        else:
            self.timer.clear()

    def _row(self, key, span: list) -> Row:
        return Row(**{self.key: key[0], "start": moment(span[0]), "end": moment(span[1]), "last_settings": span[2], "n": span[3]})

    def close(self) -> None:
        pass


def debounce_with_timer(stream: DataFrame, key: str, gap: str, watermark: str, at_once: Column) -> DataFrame:
    """T1 as a state machine: (key, start, end, last_settings, n); see ``debounce_edits``."""
    rows = stream.withWatermark("ts", watermark).select(
        key, "ts", F.unix_micros("ts").alias("us"), F.col("seq").cast("bigint").alias("seq"), "settings",
        F.coalesce(at_once, F.lit(False)).alias("at_once")).where("ts IS NOT NULL")
    kind = dict(stream.dtypes)[key]
    return rows.groupBy(key).transformWithState(
        PendingEdits(key, micros(gap)), f"`{key}` {kind}, start timestamp, end timestamp, last_settings string, n bigint",
        "append", "EventTime")


class CurrentResults(StatefulProcessor):
    """T4. Of a trigger's rows only numbers are held, 17 bytes a row, to take them in order of ``seq``."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "start_seq bigint, last bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seq, start, opens = array("q"), array("q"), array("b")
        before, last = self.newest.get() if self.newest.exists() else (None, 0)
        old = last
        least = np.iinfo(np.int64).min  # stands for null
        for row in rows:
            seq.append(least if row["seq"] is None else row["seq"])
            start.append(least if row["start_seq"] is None else row["start_seq"])
            opens.append(row["kind"] == "start")
            last = max(last, row["us"])
        order = np.argsort(np.frombuffer(seq, dtype=np.int64), kind="stable")
        number, opened = np.frombuffer(start, dtype=np.int64)[order], np.frombuffer(opens, dtype=np.int8)[order] != 0
        top = np.maximum.accumulate(np.where(opened, number, least))
        top = np.maximum(top, least if before is None else before)
        if top[-1] > least:
            self.newest.update((int(top[-1]), last))
            if last != old:
                self.handle.registerTimer(due(last + self.ttl))
        place = np.frombuffer(seq, dtype=np.int64)[order]
        for i in np.flatnonzero(~opened & (number >= top)):
            at, opened_by = (None if x == least else int(x) for x in (place[i], number[i]))
            yield Row(session=key[0], side=key[1], seq=at, kind="result", start_seq=opened_by)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.newest.exists() and due(self.newest.get()[1] + self.ttl) <= expiredTimerInfo.getExpiryTimeInMs():
            self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def current_results(stream: DataFrame, ttl: str, watermark: str) -> DataFrame:
    """T4: the results that still count, in the columns (session, side, seq, kind, start_seq)."""
    columns = ["session", "side", "seq", "kind", "start_seq"]
    rows = stream.withWatermark("ts", watermark).where("kind IN ('start', 'result')").select(
        "session", "side", F.col("seq").cast("bigint").alias("seq"), "kind", F.col("start_seq").cast("bigint").alias("start_seq"),
        F.coalesce(F.unix_micros("ts"), F.lit(0)).alias("us"), "ts")
    return rows.groupBy("session", "side").transformWithState(
        CurrentResults(micros(ttl)), rows.select(*columns).schema, "append", "EventTime")


#: buckets that the calls of a watchdog are dealt to
BUCKETS = 4096


class Watchdog(StatefulProcessor):
    """T6 for a bucket of calls, so that a state call serves many of them. ``open``: starts and ends that wait, in Arrow
    bytes, a piece a trigger; ``told``: calls told of as hung, remembered for ``forget`` in case they end after all. A
    bucket has one timer, for the first time at which a call of it is due; what the watermark passes is settled at
    once, each call at its own deadline. An end without a start goes when the watermark passes it."""

    def __init__(self, forget: int):
        self.forget = forget

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "body binary")
        self.told = handle.getValueState("told", "body binary")
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told = _unpacked(self.told.get()[0]) if self.told.exists() else None
        first, late = None, []
        for part in rows:
            # calls without an id have a bucket of their own, where they are one call
            calls = _calls(part if key[0] >= 0 else part.assign(call_id=0))
            if told is not None:
                known = calls["call_id"].isin(told["call_id"])
                late.append(calls[known & calls["ended"].lt(NEVER)])
                calls = calls[~known]
            if len(calls):
                self.open.appendValue((_packed(calls),))
                least = int(_due_at(calls).min())
                first = least if first is None else min(first, least)
        found = _merged(late).drop(columns="deadline").merge(told, on="call_id") if late else ()
        if len(found):
            yield self._rows(key, found, found["ended"], "late")
            self._remember(told[~told["call_id"].isin(found["call_id"])])
        if first is not None:
            set_to = self.timer.get()[0] if self.timer.exists() else None
            if set_to is None or first < set_to:
                if set_to is not None:
                    self.handle.deleteTimer(set_to)
                self._set(first)

    def _set(self, at: int) -> None:
        self.timer.update((at,))
        self.handle.registerTimer(at)

    def _remember(self, told: pd.DataFrame) -> None:
        if len(told):
            self.told.update((_packed(told),))
        else:
            self.told.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, nexts = timerValues.getCurrentWatermarkInMs(), []
        told = _unpacked(self.told.get()[0]) if self.told.exists() else None
        parts = [_unpacked(r[0]) for r in self.open.get()] if self.open.exists() else []
        if parts:
            calls = _merged(parts)
            ready = _due_at(calls) <= now
            over, rest = calls[ready & calls["deadline"].lt(NEVER)], calls[~ready]
            hung = over[over["ended"] > over["deadline"]]
            ended = hung["ended"].lt(NEVER)
            for found, at, status in ((hung, hung["deadline"], "hung"), (hung[ended], hung["ended"][ended], "late")):
                if len(found):
                    yield self._rows(key, found, at, status)
            new = hung.loc[~ended, ["call_id", "deadline"]]
            told = new if told is None else pd.concat([told, new])
            if len(rest):
                self.open.put([(_packed(rest),)])
                nexts.append(int(_due_at(rest).min()))
            else:
                self.open.clear()
        if told is not None:
            told = told[_due(told["deadline"] + self.forget) > now]
            self._remember(told)
            if len(told):
                nexts.append(int(_due(told["deadline"] + self.forget).min()))
        if nexts:
            self._set(min(nexts))
        else:
            self.timer.clear()

    def _rows(self, key, calls: pd.DataFrame, at: pd.Series, status: str) -> pd.DataFrame:
        ids = calls["call_id"].to_numpy() if key[0] >= 0 else [None] * len(calls)
        return pd.DataFrame({"call_id": ids, "deadline": calls["deadline"].to_numpy(), "reported": _due(at).to_numpy(), "status": status})

    def close(self) -> None:
        pass


#: stands for a deadline or an end that is not known
NEVER = np.iinfo(np.int64).max


def _due(us: pd.Series) -> pd.Series:
    return -(-us // 1000)


def _due_at(calls: pd.DataFrame) -> pd.Series:
    """When each call is settled: at its deadline, or at its end where no start is known."""
    return _due(calls["deadline"].where(calls["deadline"] < NEVER, calls["ended"]))


def _calls(rows: pd.DataFrame) -> pd.DataFrame:
    """(call_id, deadline, ended) of events: the deadline of the first start, the first end."""
    starts = rows["starts"].astype(bool)
    return _merged([pd.DataFrame({
        "call_id": rows["call_id"], "deadline": (rows["us"] + rows["budget"]).where(starts, NEVER), "ended": rows["us"].mask(starts, NEVER)})])


def _merged(parts: list[pd.DataFrame]) -> pd.DataFrame:
    """One row a call; of several deadlines the first counts, of several ends the least."""
    rows = pd.concat(parts, ignore_index=True)
    if not rows["call_id"].duplicated().any():
        return rows
    starts = rows.loc[rows["deadline"] < NEVER, ["call_id", "deadline"]].drop_duplicates("call_id")
    calls = rows.groupby("call_id", sort=False)["ended"].min()
    # filled where missing, as a gap would turn the others into floats
    deadline = starts.set_index("call_id")["deadline"].reindex(calls.index, fill_value=NEVER)
    return pd.DataFrame({"call_id": calls.index, "deadline": deadline.to_numpy(), "ended": calls.to_numpy()})


def _packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False).replace_schema_metadata()
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(body: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(body).read_pandas()


def watchdog(events: DataFrame, watermark: str, forget: str, buckets: int = BUCKETS) -> DataFrame:
    """T6 over (call_id, ts, budget): ``budget`` in microseconds for a start, null for an end."""
    bucket = F.when(F.col("call_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("call_id"), F.lit(buckets))).cast("int")
    rows = events.withWatermark("ts", watermark).select(
        bucket.alias("bucket"), "call_id", "ts", F.unix_micros("ts").alias("us"), F.coalesce("budget", F.lit(0)).alias("budget"),
        F.col("budget").isNotNull().alias("starts")).where("ts IS NOT NULL")
    kind = dict(events.dtypes)["call_id"]
    out = rows.groupBy("bucket").transformWithStateInPandas(
        Watchdog(micros(forget)), f"call_id {kind}, deadline bigint, reported bigint, status string", "append", "EventTime")
    return out.select("call_id", F.timestamp_micros("deadline").alias("deadline"), F.timestamp_millis("reported").alias("reported"), "status")
