"""Rows of many keys wait together: Spark's state is asked a few times for a group of keys, not for each key or row."""

import pandas as pd

from quarryline.streaming import state


class Held:
    """A state of one group, in memory, that counts how often it is asked."""

    def __init__(self):
        self.calls, self.lists, self.value, self.timers = 0, [], None, []

    def getListState(self, *_):
        return self

    def getValueState(self, *_):
        return Value(self)

    def registerTimer(self, at):
        self.timers.append(at)

    def appendValue(self, row):
        self.calls += 1
        self.lists.append(row)

    def get(self):
        self.calls += 1
        return iter(list(self.lists))

    def put(self, rows):
        self.calls += 1
        self.lists = list(rows)

    def clear(self):
        self.calls += 1
        self.lists = []


class Value:
    def __init__(self, held):
        self.held = held

    def exists(self):
        self.held.calls += 1
        return self.held.value is not None

    def get(self):
        self.held.calls += 1
        return self.held.value

    def update(self, value):
        self.held.calls += 1
        self.held.value = value


class Mark:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_few_calls_for_many_keys():
    step = lambda now, value, _: ((value,), (value,))
    waiting, held = state._Waiting((0,), step, ["k", "id", "value"], None, True), Held()
    waiting.init(held)
    rows = [(7, k, None, t * 1000, 10 * (k or 0) + t, t) for t in (3, 1, 2) for k in [*range(500), None]]
    for at in (0, 501, 1002):
        list(waiting.handleInputRows((7,), iter([pd.DataFrame(rows[at : at + 501])]), None))
    out = [r for mark in (1, 2, 3) for df in waiting.handleExpiredTimer((7,), Mark(mark), None) for r in df.itertuples(index=False, name=None)]
    assert sorted(out) == sorted((k, 10 * k + t, t) for k in range(500) for t in (1, 2, 3))
    assert [r[1] % 10 for r in out] == [1] * 500 + [2] * 500 + [3] * 500
    assert held.calls <= 20 and not held.lists and {1, 2, 3} <= set(held.timers)
