"""Calls are watched in buckets: few state calls and one timer a bucket, each call settled at its own deadline."""
import random

import pandas as pd
import pytest

from assetlane.streaming.timers import Watchdog
from tests.test_one_timer import Clock, Handle, List, Value

FORGET = 50_000_000


class Counted(List):
    calls = 0

    def appendValue(self, row):
        Counted.calls += 1
        self.appendList([row])


class Buckets(Handle):
    def getListState(self, *_):
        return Counted()


def frame(rows):
    """(call, us, budget) with no budget for an end."""
    return pd.DataFrame({"bucket": 3, "call_id": [c for c, _, _ in rows], "us": [u for _, u, _ in rows],
                         "budget": [b or 0 for _, _, b in rows], "starts": [b is not None for _, _, b in rows]})


def driven(triggers, key=3, size=7):
    """What comes of triggers (rows, watermark in ms) given to one bucket, and the most timers it had."""
    handle, dog = Buckets(), Watchdog(FORGET)
    dog.init(handle)
    told, timers = [], 0
    for i, (rows, now) in enumerate(triggers):
        found = list(dog.handleInputRows((key,), (frame(rows[j:j + size]) for j in range(0, len(rows), size)), None)) if rows else []
        timers = max(timers, len(handle.timers))
        if any(t <= now for t in handle.timers):
            handle.timers = {t for t in handle.timers if t > now}
            found += dog.handleExpiredTimer((key,), Clock(now), None)
        told += [(i, *r) for f in found for r in f.itertuples(index=False, name=None)]
    return sorted(told, key=repr), timers


def plain(triggers):
    """The same, a call at a time."""
    told, state = [], {}
    up = lambda us: -(-us // 1000)
    for i, (rows, now) in enumerate(triggers):
        for call in dict.fromkeys(c for c, _, _ in rows):
            deadline, ended, known = state.pop(call, (None, None, False))
            for _, us, budget in (r for r in rows if r[0] == call):
                if budget is None:
                    ended = us if ended is None else min(ended, us)
                elif deadline is None:
                    deadline = us + budget
            if known and ended is not None:
                told.append((i, call, deadline, up(ended), "late"))
            else:
                state[call] = (deadline, ended, known)
        for call, (deadline, ended, known) in list(state.items()):
            if deadline is None or known:
                if up(ended if deadline is None else deadline + FORGET) <= now:
                    del state[call]
            elif up(deadline) <= now:
                del state[call]
                if ended is None or ended > deadline:
                    told.append((i, call, deadline, up(deadline), "hung"))
                if ended is None:
                    if up(deadline + FORGET) > now:
                        state[call] = (deadline, None, True)
                elif ended > deadline:
                    told.append((i, call, deadline, up(ended), "late"))
    return sorted(told, key=repr)


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_buckets_equal_a_loop_over_calls(size):
    rng = random.Random(5)
    triggers, now = [], 0
    for _ in range(40):
        rows = [(rng.randrange(60), now * 1000 + rng.randrange(1, 20_000_000), rng.choice([None, None, 0, 7_000_001, 30_000_000]))
                for _ in range(rng.choice([0, 3, 25]))]
        triggers.append((rows, now))
        now += rng.randrange(0, 9_000)
    triggers.append(([], now + 10 ** 9))
    got, timers = driven(triggers, size=size)
    assert got == plain(triggers) and timers == 1
    assert {s for *_, s in got} == {"hung", "late"}


def test_many_calls_of_a_bucket_cost_few_state_calls():
    Counted.calls = 0
    rows = [(i, i, 20_000_000) for i in range(5000)] + [(i, i + 1, None) for i in range(0, 5000, 2)]
    got, timers = driven([(rows, 0), ([], 10 ** 9)], size=10_000)
    assert [r[1] for r in got if r[4] == "hung"] and len(got) == 2500
    assert timers == 1 and Counted.calls == 1


def test_calls_without_an_id_are_one_call():
    got, _ = driven([([(None, 5, 1000), (None, 9, 2000)], 0), ([(None, 3_000_000, None)], 1000)], key=-1)
    assert got == [(1, None, 1005, 2, "hung"), (1, None, 1005, 3000, "late")]
