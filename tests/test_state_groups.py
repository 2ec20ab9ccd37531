"""The finding machine serves users in groups, so that calls and exchanges with the store follow groups and not events."""

from types import SimpleNamespace

import pandas as pd

from corpuslens.streaming import events


class _Value:
    def __init__(self):
        self.held, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.held

    def update(self, value):
        self.calls += 1
        self.held = value

    def clear(self):
        self.calls, self.held = self.calls + 1, None


def test_exchanges_do_not_follow_events():
    values = {"settled": _Value(), "waiting": _Value()}
    timers = []
    machine = events.FindingMachine()
    machine.init(SimpleNamespace(getValueState=lambda name, schema: values[name], registerTimer=timers.append))
    big = str((1 << 60) + 1)
    rows = [(u, at, at, "error" if at % 2 else "purchase") for at in range(999, 0, -1) for u in ("7", big)] + [("7", 5, 5, "error"), (None, 3, 3, "view")]
    part = pd.DataFrame(rows, columns=["user", "at", "event_id", "event_type"])
    [found] = machine.handleInputRows((0,), iter([part]), None)
    expected = {(7, "open", 499), (int(big), "open", 499), (None, "new", 0)}
    assert {(None if pd.isna(u) else u, s, n) for u, s, n in found.itertuples(index=False)} == expected
    list(machine.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 1), None))  # at is in microseconds
    assert values["waiting"].held is None and set(zip(*values["settled"].held)) == {("7", "open", 499), (big, "open", 499)}
    [found] = machine.handleInputRows((0,), iter([pd.DataFrame([("7", 2_000, 1, "purchase"), ("7", 2_001, 2, "error")], columns=part.columns)]), None)
    assert found.values.tolist() == [[7, "open", 500]]
    assert sum(v.calls for v in values.values()) <= 10 and timers == [1, 3]
