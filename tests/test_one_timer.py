"""A key has one timer, however many events wait, and its list of events is read once a trigger."""
from pyspark.sql import Row

from assetlane.streaming.timers import PendingEdits


class Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, row):
        self.held = row

    def clear(self):
        self.held = None


class List(Value):
    def appendList(self, rows):
        self.held = (self.held or []) + rows

    def put(self, rows):
        self.held = list(rows)


class Handle:
    def __init__(self):
        self.timers = set()

    def getValueState(self, *_):
        return Value()

    def getListState(self, *_):
        return List()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_key_with_many_edits_has_one_timer():
    handle, edits = Handle(), PendingEdits("key", 1000)
    edits.init(handle)
    edits.handleInputRows((7,), (Row(us=i * 5000, seq=i, settings="s", at_once=False) for i in reversed(range(3000))), None)
    assert handle.timers == {0}
    handle.timers.clear()  # expired timers are gone
    first = list(edits.handleExpiredTimer((7,), Clock(5000), None))
    assert len(first) == 1000 and handle.timers == {5002}
    handle.timers.clear()
    assert len(list(edits.handleExpiredTimer((7,), Clock(10 ** 9), None))) == 2000 and not handle.timers
