"""What a stateful processor asks of its store, with a store in memory that counts."""

from __future__ import annotations

import random

import pandas as pd

from provena.streaming.processors import Idempotency


class Store:
    def __init__(self):
        self.calls, self.map, self.value = 0, {}, None

    def getMapState(self, *_):
        return self.Map(self)

    def getValueState(self, *_):
        return self.Value(self)

    class Map:
        def __init__(self, store):
            self.store = store

        def _called(self):
            self.store.calls += 1
            return self.store.map

        def getValue(self, key):
            return self._called().get(key)

        def containsKey(self, key):
            return key in self._called()

        def updateValue(self, key, value):
            self._called()[key] = value

        def removeKey(self, key):
            del self._called()[key]

        def keys(self):
            return iter(list(self._called()))

        def exists(self):
            return bool(self._called())

    class Value:
        def __init__(self, store):
            self.store = store

        def get(self):
            self.store.calls += 1
            return self.store.value

        def exists(self):
            self.store.calls += 1
            return self.store.value is not None

        def update(self, value):
            self.store.calls += 1
            self.store.value = value


def _run(batches, leaf=512, keep=None):
    store, last, calls = Store(), {}, []
    processor = Idempotency(keep)
    processor.LEAF = leaf
    processor.init(store)
    for batch in batches:
        store.calls = 0
        for out in processor.handleInputRows(("k",), iter([pd.DataFrame(batch, columns=["seq", "digest"])]), None):
            last.update({r.seq: r.outcome for r in out.itertuples()})
        calls.append(store.calls)
    return last, calls


def test_a_new_key_asks_once_and_writes_twice():
    last, calls = _run([[(3, "a"), (5, "b"), (7, "a")], [(1, "b")]])
    assert last == {1: "new", 3: "conflict", 5: "replay", 7: "conflict"}
    assert calls[0] <= 3 and calls[1] <= 5


def test_leaves_in_any_order_decide_the_same():
    rng = random.Random(5)
    rows = [(i, rng.choice("ab")) for i in range(200)]
    want = {i: "new" if i == 0 else "replay" if d == rows[0][1] else "conflict" for i, d in rows}
    for leaf in (4, 7, 512):
        mixed = rng.sample(rows, len(rows)) + rng.sample(rows, 20)
        last, _ = _run([mixed[i : i + 17] for i in range(0, len(mixed), 17)], leaf)
        assert last == want
    late, _ = _run([rows[100:], rows[:100]], 4, keep=10)
    assert late[0] == "late" and late[199] == ("replay" if rows[199][1] == rows[100][1] else "conflict")
