"""Repair of conversations against a plain search over edits, whole and in pieces."""

from __future__ import annotations

import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from provena.llm import common, conversations
from tests.llm.cases import clashing, frame

BLANKS = " \t\n\x0b\x0c\r"


@pytest.fixture(autouse=True)
def prepared(spark):
    common.prepare(spark)


def plain(rows):
    """Faults, cost, letters and left lines of rows in order, by a best-first search over letters."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.strip(BLANKS)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turn = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, i, last, left = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return faults, cost, letters, "\n".join(left)
        if (i, last) in done:
            continue
        done.add((i, last))
        heapq.heappush(heap, (cost + 5, letters + "I", i, turn[last], (*left, names[turn[last]] + ":")))
        if i == len(rows):
            continue
        role, text = rows[i]
        heapq.heappush(heap, (cost + 2, letters + "D", i + 1, last, left))
        if faults[i] in ("b", "d"):
            continue
        extra = 5 * (faults[i] == "t")
        if role[:1] == turn[last] or (role[:1] == "s" and last == ""):
            heapq.heappush(heap, (cost + extra, letters + "K", i + 1, role[:1], (*left, f"{role}:{text}")))
        heapq.heappush(heap, (cost + 1 + extra, letters + "R", i + 1, turn[last], (*left, f"{names[turn[last]]}:{text}")))


def expected(rows):
    faults, cost, letters, left = plain([(r, t) for _, r, t in rows])
    initials = [r[:1] for _, r, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost, "audit": letters,
        "repaired_sha256": hashlib.sha256(left.encode()).hexdigest(),
    }


def made(seed, n, length):
    rng, rows = random.Random(seed), {}
    for conv in range(n):
        turn, own = 0, []
        for _ in range(rng.randint(1, length)):
            turn += rng.choice([1, 1, 1, 2])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "Assistant", "unknown"])
            text = rng.choice(["", " \n", "Yes.", "No?", "cut off", "a word!", f"t{rng.randint(0, 3)}.", f"open {turn}", "Oui. \t"])
            own.append((turn, role, text))
        rows[conv] = own
    return rows


@pytest.mark.parametrize("p, length", [(conversations.Params(), 12), (conversations.Params(block=3, rows=7), 60), (conversations.Params(rows=40, chars=150), 9)])
def test_against_plain_search(spark, p, length):
    rows = made(length, 60, length)
    flat = [(c, *r) for c, own in rows.items() for r in own]
    random.Random(1).shuffle(flat)
    df = clashing(frame(spark, flat, "conv_id long, turn long, role string, text string")).repartition(3)
    got = {r["conv_id"]: r.asDict() for r in conversations.repair(df, df, p).collect()}
    assert len(got) == len(rows)
    for conv, own in rows.items():
        want = expected(own)
        assert {k: got[conv][k] for k in want} == want, (conv, own)


def test_one_conversation_of_many_pieces(spark):
    own = made(5, 1, 1)[0] + [(t, r, x) for t, (_, r, x) in enumerate(made(6, 40, 40)[3] * 30, 2)]
    df = frame(spark, [(9, *r) for r in own], "conv_id long, turn long, role string, text string")
    row = conversations.repair(df, df, conversations.Params(rows=50)).collect()[0].asDict()
    want = expected(own)
    assert {k: row[k] for k in want} == want


def test_blocks_are_what_single_symbols_make(spark):
    rng = random.Random(3)
    one, four = conversations.tables(1), conversations.tables(4)
    assert len(four.vectors) < 200
    for n in (0, 1, 3, 4, 5, 8, 31):
        symbols = bytes(rng.randrange(9) for _ in range(n))
        for end in (one.end, *one.units):
            a, b = one.read(symbols, end), four.read(symbols, end)
            assert a[:2] == b[:2]
            for state in range(4):
                if one.vectors[a[1]][state] < conversations.NEVER:
                    assert one.trace(symbols, a[2], state, end == one.end) == four.trace(symbols, b[2], state, end == one.end)


def test_odd_rows(spark):
    big = (1 << 53) + 1
    rows = [
        (None, 1, "user", "Hi."), (None, None, None, None), (1, None, "user", "Hi."), (1, None, "assistant", "Yo."), (2, 5, "user", None), (3, 1, "", "Text."), (4, 1, "user", "x." * 200_000),
        (4, 2, "assistant", "y."), (5, 1, "user", "Same."), (5, 1, "user", "Same."), (5, 1, "user", "Same."), (big, 1, "user", "A."), (big, 2, "assistant", "B."), (7, -(1 << 63), "user", "A."), (7, (1 << 63) - 1, "assistant", "B."),
    ]
    df = clashing(frame(spark, rows, "conv_id long, turn long, role string, text string"))
    ids = frame(spark, [(c,) for c, *_ in rows] + [(99,)], "conv_id long")
    for p in (conversations.Params(), conversations.Params(rows=2)):
        got = {r["conv_id"]: r for r in conversations.repair(df, ids, p).collect()}
        assert set(got) == {None, 1, 2, 3, 4, 5, 7, 99, big}
        assert (got[None]["audit"], got[None]["blank"], got[None]["gaps"], got[None]["cost"]) == ("DD", 1, 0, 4)
        assert got[1]["gaps"] == 0 and len(got[1]["audit"]) >= 2
        assert (got[2]["audit"], got[2]["cost"], got[2]["repaired_sha256"]) == ("D", 2, hashlib.sha256(b"").hexdigest())
        assert (got[3]["audit"], got[3]["illegal"]) == ("D", 0)
        assert got[4]["audit"] == "KK" and got[4]["repaired_sha256"] == hashlib.sha256(("user:" + "x." * 200_000 + "\nassistant:y.").encode()).hexdigest()
        assert (got[5]["duplicate"], got[5]["gaps"], got[5]["audit"]) == (2, 0, "DDD")
        assert (got[big]["audit"], got[7]["gaps"]) == ("KK", (1 << 63) - 1)
        assert tuple(got[99])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversations.repair(df.limit(0), ids.limit(0)).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(30) for t in range(8)] + [(None, None, None, None), (None, 3, "assistant", "Y?")]
    got = conversations.damage(frame(spark, rows, "conv_id long, turn long, role string, text string")).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    got = {(r["conv_id"], r["turn"]): (r["role"], r["text"], r["n"]) for r in got.collect()}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or " ", text or " "
        want = {0: None, 1: (role, "", 1), 2: (role, text.translate({ord(c): None for c in ".!?"}), 1), 3: (role, text, 2), 4: ("user", text, 1)}.get(kind, (role, text, 1))
        assert got.get((conv, turn)) == want
