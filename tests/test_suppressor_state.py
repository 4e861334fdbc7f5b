"""What the suppressor asks of its state: a timer for a batch, not one for each signal that waits."""

import pandas as pd

from lakepress.streaming.suppression import Suppressor


class State:
    def __init__(self):
        self.held, self.reads = None, 0

    def exists(self):
        return self.held is not None

    def get(self):
        self.reads += 1
        return iter(self.held) if isinstance(self.held, list) else self.held

    def update(self, x):
        self.held = x

    put = update

    def appendList(self, x):
        self.held = (self.held or []) + x

    def clear(self):
        self.held = None


class Handle:
    def __init__(self):
        self.states, self.timers, self.set = {}, set(), 0

    def getValueState(self, name, schema):
        return self.states.setdefault(name, State())

    getListState = getValueState

    def registerTimer(self, ms):
        self.set += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


class Mark:
    def __init__(self, s):
        self.s = s

    def getCurrentWatermarkInMs(self):
        return self.s * 1000


def fire(s, h, now):
    out, n = [], 0
    while due := sorted(t for t in h.timers if t <= now * 1000):
        for t in due:
            h.timers.discard(t)
            n += 1
            out += [tuple(r) for p in s.handleExpiredTimer(("k",), Mark(now), None) for r in p.itertuples(index=False)]
    return out, n


def test_a_key_with_many_signals_is_read_once_for_a_batch():
    s, h = Suppressor(), Handle()
    s.init(h)
    rows = [((i * 7919) % 5000, 10 if i % 3 else 40) for i in range(5000)] + [(17, 90), (17, 5)]
    for k in range(0, len(rows), 1000):
        list(s.handleInputRows(("k",), iter([pd.DataFrame(rows[k : k + 1000], columns=["at_s", "ttl_s"])]), None))
    got, calls = [], 0
    for now in (2500, 6000):
        out, n = fire(s, h, now)
        got, calls = got + out, calls + n
    want, until, longest = [], None, {}
    for at, ttl in rows:
        longest[at] = max(ttl, longest.get(at, 0))
    for at in sorted(longest):
        if until is None or at >= until:
            until = at + longest[at]
            want.append(("k", at, until))
    assert got == want
    assert calls < 6 and h.set < 12 and h.states["waiting"].reads <= 4  # thousands before
    assert all(not x.exists() for x in h.states.values())
