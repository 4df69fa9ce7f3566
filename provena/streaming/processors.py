"""Stateful processors: what a ledger decides row by row, whatever order its rows come in.

A key's rows are kept in leaves: runs of rows in order of their number, a few hundred each,
in a map state by the smallest number a leaf may hold. Each leaf knows the fold's state before
and after it. Rows that come later than rows of higher numbers go into their leaf, and the
fold is taken up again there, as far as it comes out differently; decisions that change go out
again with a higher revision. A task holds one leaf at a time, never all rows of a key. What
costs is asking the store, so the leaf at hand is written when another one is needed, and a
key that is new asks once and writes twice.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What tells decisions on one row apart, and which of them holds.
REVISED = "tag bigint, revision bigint"
IDEMPOTENCY_OUT = f"request_key string, seq bigint, outcome string, {REVISED}"
STATE_OUT = f"task_id string, seq bigint, status string, state_before string, state_after string, epoch bigint, outcome string, {REVISED}"
BUDGET_OUT = f"turn bigint, call_no bigint, outcome string, chars_used bigint, {REVISED}"
#: Below every number: where a key's first leaf begins.
LOWEST = -(1 << 63)


class Ordered(StatefulProcessor):
    """Folds the rows of a key in order of their number.

    ``keep``: how many rows of a key stay open to rows that come late; older leaves are folded
    into a base, and a row that belongs before it is reported as ``late`` and changes nothing.
    Without it every row stays open. Equal rows of one number count once; rows without a
    number cannot be put in order and are reported as ``unnumbered``.
    """

    LEAF = 512
    #: Name of the number, of the other columns that are read, of all columns that go out.
    number: str
    payload: tuple[str, ...]
    columns: tuple[str, ...]
    start: list

    def __init__(self, keep: int | None = None) -> None:
        self.keep = keep

    def decide(self, state: list, row: list) -> tuple[list, list]:
        """The state after a row of number and payload, and what was decided."""
        raise NotImplementedError

    def shown(self, key, row: list, decision: list) -> tuple:
        """A row to go out; ``decision`` is a word alone where nothing was decided."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.leaves = handle.getMapState("leaves", "low bigint", "rows string, before string, after string, n int")
        self.base = handle.getValueState("base", "low bigint, state string, revision bigint")
        self.hand, self.unwritten = None, False

    def _leaf(self, low: int) -> tuple[list[list], str | None, str | None]:
        """Rows as [number, payload, tag, decision], and the state before and after them."""
        if self.hand is None or self.hand[0] != low:
            self._put_down()
            rows, before, after, _ = self.leaves.getValue((low,))
            self.hand = (low, json.loads(rows), before, after)
        return self.hand[1:]

    def _store(self, low: int, rows: list[list], before: str | None, after: str | None) -> None:
        if self.hand is not None and self.hand[0] != low:
            self._put_down()
        self.hand, self.unwritten = (low, rows, before, after), True

    def _put_down(self) -> None:
        """Write the leaf at hand, if it changed, and let go of it."""
        if self.unwritten:
            low, rows, before, after = self.hand
            self.leaves.updateValue((low,), (json.dumps(rows), before, after, len(rows)))
        self.hand, self.unwritten = None, False

    def _placed(self, frame: pd.DataFrame, lows: list[int], held: set[int], touched: set[int], floor: int) -> list[tuple[list, str]]:
        """Put a frame's rows into their leaves. Those that no leaf takes come back with why.
        ``held`` are the leaves that there are, the others of ``lows`` have no rows yet."""
        refused, new = [], {}
        for number, *payload in zip(frame[self.number], *(frame[c] for c in self.payload)):
            payload = [None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in payload]
            row = [None if pd.isna(number) else int(number), payload]
            row.append(zlib.crc32(json.dumps(payload).encode()))
            if row[0] is None:
                refused.append((row, "unnumbered"))
            elif row[0] < floor:
                refused.append((row, "late"))
            else:
                new.setdefault(lows[bisect.bisect_right(lows, row[0]) - 1], []).append([*row, None])
        for low, rows in new.items():
            own = self._leaf(low)[0] if low in held else []
            known = {(r[0], r[2]) for r in own}
            for row in rows:
                if (row[0], row[2]) not in known:
                    known.add((row[0], row[2]))
                    own.append(row)
            own.sort(key=lambda r: (r[0], r[2]))
            at = low
            while own:
                cut = len(own) if len(own) <= self.LEAF else self.LEAF // 2
                # Rows of one number stay together.
                while cut < len(own) and own[cut][0] == own[cut - 1][0]:
                    cut += 1
                part, own = own[:cut], own[cut:]
                self._store(at, part, None, None)
                touched.add(at)
                held.add(at)
                if at not in lows:
                    bisect.insort(lows, at)
                at = own[0][0] if own else at
        return refused

    def _folded(self, key, lows: list[int], touched: set[int], state: str, revision: int) -> Iterator[pd.DataFrame]:
        at = lows.index(min(touched))
        if at:
            state = self._leaf(lows[at - 1])[2]
        while at < len(lows):
            low = lows[at]
            rows, before, after = self._leaf(low)
            if low in touched or before != state:
                touched.discard(low)
                now, out = json.loads(state), []
                for row in rows:
                    now, decision = self.decide(now, row)
                    if decision != row[3]:
                        row[3] = decision
                        out.append((*self.shown(key, row, decision), row[2], revision))
                after = json.dumps(now)
                self._store(low, rows, state, after)
                if out:
                    yield pd.DataFrame(out, columns=self.columns)
                at += 1
            elif not touched:
                return
            else:
                # Nothing changes until the next leaf that has new rows.
                at = lows.index(min(touched))
                after = self._leaf(lows[at - 1])[2]
            state = after

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        base = self.base.get()
        floor, state, revision = base or (LOWEST, json.dumps(self.start), 0)
        held, touched = {low for (low,) in self.leaves.keys()} if base else set(), set()
        lows = sorted(held) or [floor]
        for frame in rows:
            refused = self._placed(frame, lows, held, touched, floor)
            if refused:
                yield pd.DataFrame([(*self.shown(key, row, [why]), row[2], revision) for row, why in refused], columns=self.columns)
        if touched:
            yield from self._folded(key, lows, touched, state, revision)
        self._put_down()
        if self.keep is not None:
            sizes = [self.leaves.getValue((low,))[3] for low in lows] if held else []
            while len(sizes) > 1 and sum(sizes[1:]) >= self.keep:
                state, floor = self.leaves.getValue((lows[0],))[2], lows[1]
                self.leaves.removeKey((lows[0],))
                lows, sizes = lows[1:], sizes[1:]
        self.base.update((floor, state, revision + 1))

    def close(self) -> None:
        pass


def _names(schema: str) -> tuple[str, ...]:
    return tuple(part.split()[0] for part in schema.split(", "))


class Idempotency(Ordered):
    """The first digest of a key is stored; the same one replays, another one conflicts."""

    number, payload, columns, start = "seq", ("digest",), _names(IDEMPOTENCY_OUT), [False, None]

    def decide(self, state, row):
        digest = row[1][0]
        if not state[0]:
            return [True, digest], ["new"]
        return state, ["replay" if digest == state[1] else "conflict"]

    def shown(self, key, row, decision):
        return key[0], row[0], decision[0]


class TaskState(Ordered):
    """A task's status and epoch. Requests the table forbids, or made for another epoch,
    change nothing; a user's answer (awaiting to running) starts the next epoch."""

    number, payload, columns, start = "seq", ("status", "expected_epoch"), _names(STATE_OUT), ["created", 1]

    def __init__(self, transitions: dict[str, tuple[str, ...]], keep: int | None = None) -> None:
        super().__init__(keep)
        self.transitions = transitions

    def decide(self, state, row):
        (before, epoch), (asked, expected) = state, row[1]
        if expected is not None and int(expected) != epoch:
            return state, [before, before, epoch, "stale"]
        if asked not in self.transitions[before]:
            return state, [before, before, epoch, "rejected"]
        epoch += before == "awaiting_user" and asked == "running"
        return [asked, epoch], [before, asked, epoch, "applied"]

    def shown(self, key, row, decision):
        before, after, epoch, outcome = decision if len(decision) > 1 else (None, None, None, decision[0])
        return key[0], row[0], row[1][0], before, after, epoch, outcome


class TurnBudget(Ordered):
    """Call and character caps per turn; a pause of ``gap_seconds`` ends the turn.

    A refused read has used a call but no characters.
    """

    number, payload, columns, start = "call_no", ("chars", "at"), _names(BUDGET_OUT), [0, 0, None]

    def __init__(self, max_calls: int, max_chars: int, gap_seconds: float, keep: int | None = None) -> None:
        super().__init__(keep)
        self.max_calls, self.max_chars, self.gap = max_calls, max_chars, gap_seconds

    def decide(self, state, row):
        (calls, chars, last), (size, at) = state, row[1]
        if last is not None and at - last > self.gap:
            calls, chars = 0, 0
        if calls >= self.max_calls:
            return [calls, chars, at], ["refused_calls", None]
        fits = chars + size <= self.max_chars
        chars += size if fits else 0
        return [calls + 1, chars, at], ["admitted" if fits else "refused_chars", chars]

    def shown(self, key, row, decision):
        outcome, used = decision if len(decision) > 1 else (decision[0], None)
        return key[0], row[0], outcome, used
