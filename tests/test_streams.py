"""Streams over shuffled files, one a trigger: results as if the rows had come in order."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from provena.operators.ledger import TRANSITIONS
from provena.streaming import feeds, processors

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def shuffled(spark, tmp_path):
    """Writes rows as many files in an order of their own and reads them one a trigger."""

    def stream(rows, schema, files=20, seed=1):
        rows = list(rows)
        random.Random(seed).shuffle(rows)
        path = f"{tmp_path}/rows{seed}-{len(rows)}"
        for k in range(files):
            spark.createDataFrame(rows[k::files], schema).coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)

    return stream


def test_idempotency_of_shuffled_files(shuffled, monkeypatch):
    monkeypatch.setattr(processors.Ordered, "LEAF", 8)
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, rng.choice("abc")) for i in range(240)]
    got = feeds.settled_decisions(feeds.idempotency(shuffled(rows, "request_key string, seq long, digest string")), "t", ["request_key", "seq"]).collect()
    first: dict = {}
    for key, _, digest in rows:
        first.setdefault(key, digest)
    new: set = set()
    want = set()
    for key, seq, digest in rows:
        want.add((key, seq, "new" if key not in new else "replay" if digest == first[key] else "conflict"))
        new.add(key)
    assert {(r["request_key"], r["seq"], r["outcome"]) for r in got} == want and len(got) == len(rows)


def fold(rows):
    status, epoch, out = defaultdict(lambda: "created"), defaultdict(lambda: 1), set()
    for task, seq, asked, expected in sorted(rows, key=lambda r: r[1]):
        before, outcome = status[task], "rejected"
        if expected is not None and expected != epoch[task]:
            outcome = "stale"
        elif asked in TRANSITIONS[before]:
            outcome = "applied"
            epoch[task] += before == "awaiting_user" and asked == "running"
            status[task] = asked
        out.add((task, seq, before, status[task], epoch[task], outcome))
    return out


def test_task_state_of_shuffled_files(shuffled, monkeypatch):
    monkeypatch.setattr(processors.Ordered, "LEAF", 8)
    rng = random.Random(3)
    rows = [("hot" if i % 2 else f"t{i % 9}", i * 7 - 500, rng.choice(["running", "awaiting_user", "parked", "running"]), rng.choice([None, None, 1, 2])) for i in range(240)]
    stream = shuffled(rows, "task_id string, seq long, status string, expected_epoch long")
    got = feeds.settled_decisions(feeds.task_state(stream), "t", ["task_id", "seq"]).collect()
    assert {(r["task_id"], r["seq"], r["state_before"], r["state_after"], r["epoch"], r["outcome"]) for r in got} == fold(rows)


def test_budget_of_shuffled_files(shuffled, monkeypatch):
    monkeypatch.setattr(processors.Ordered, "LEAF", 8)
    rng, at, rows = random.Random(4), START, []
    for i in range(200):
        at += timedelta(minutes=rng.choice([1, 5, 400]))
        rows.append((i % 3, i, rng.randint(1, 300), at))
    stream = shuffled(rows, "turn long, call_no long, chars long, created_at timestamp")
    got = feeds.settled_decisions(feeds.budget(stream, 4, 600, 6 * 3600), "t", ["turn", "call_no"]).collect()
    want, held = set(), {}
    for turn, number, size, at in rows:
        calls, chars, last = held.get(turn, (0, 0, None))
        if last is not None and (at - last).total_seconds() > 6 * 3600:
            calls, chars = 0, 0
        if calls >= 4:
            want.add((turn, number, "refused_calls", None))
        else:
            fits = chars + size <= 600
            calls, chars = calls + 1, chars + (size if fits else 0)
            want.add((turn, number, "admitted" if fits else "refused_chars", chars))
        held[turn] = (calls, chars, at)
    assert {(r["turn"], r["call_no"], r["outcome"], r["chars_used"]) for r in got} == want


def test_rows_before_what_is_kept_are_listed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(processors.Ordered, "LEAF", 4)
    schema, path = "request_key string, seq long, digest string", str(tmp_path / "in")
    for rows in ([("k", i, "a") for i in range(10, 60)], [("k", 1, "b"), ("k", None, "a"), ("k", 60, "b"), ("k", 59, "a")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {(r["seq"], r["outcome"]) for r in feeds.settled_decisions(feeds.idempotency(stream, keep=8), "t", ["request_key", "seq"]).collect()}
    assert got == {(10, "new"), *((i, "replay") for i in range(11, 60)), (1, "late"), (None, "unnumbered"), (60, "conflict")}


def logged(n=300):
    rng = random.Random(6)
    return [(i, f"u{rng.randint(0, 5)}", rng.choice("xy"), START + timedelta(minutes=37 * i)) for i in range(n)]


LOG = "seq long, user_id string, event_code string, created_at timestamp"


def test_no_late_event_is_lost(shuffled):
    rows = [*logged(), (9_000, "u1", "x", None)]
    stream = shuffled([*rows, *rows[::5]], LOG)
    got = feeds.dedup_all(stream, "t", ["event_code"]).collect()
    assert {(r["seq"], r["event_code"]) for r in got} == {(s, c) for s, _, c, _ in rows} and len(got) == len(rows)
    split = feeds.split_late(shuffled(rows, LOG, seed=2), "t")
    assert split.late.count() > 100 and split.late.count() + split.settled.count() == len(rows)
    assert {r["seq"] for r in split.late.unionByName(split.settled).collect()} == {r[0] for r in rows}


def test_windows_and_sessions_of_shuffled_files(spark, shuffled):
    rows = logged()
    top = max(r[3] for r in rows) - timedelta(hours=1)
    split = feeds.split_late(shuffled(rows, LOG), "t")
    day = lambda t: t.replace(hour=0, minute=0)
    daily: dict = defaultdict(int)
    for _, _, code, at in rows:
        daily[day(at), code] += 1
    of = lambda df: {(r["window_start"].astimezone(timezone.utc), r["event_code"]): r["n"] for r in df.collect()}
    assert of(feeds.counts_all(split, "t", F.window("created_at", "1 day"), ["event_code"])) == {k: n for k, n in daily.items() if k[0] + timedelta(days=1) <= top}
    assert of(feeds.counts_so_far(split, "t", F.window("created_at", "1 day"), ["event_code"])) == dict(daily)
    by, sessions = defaultdict(list), set()
    for _, user, _, at in rows:
        by[user].append(at)
    for user, times in by.items():
        run = [times[0]]
        for at in [*times[1:], None]:
            if at is None or at - run[-1] > timedelta(hours=3):
                if run[-1] + timedelta(hours=3) <= top:
                    sessions.add((user, run[0], len(run)))
                run = []
            run.append(at)
    got = feeds.sessions_all(split, "t", F.session_window("created_at", "3 hours"), ["user_id"]).collect()
    assert {(r["user_id"], r["window_start"].astimezone(timezone.utc), r["n"]) for r in got} == sessions and len(got) == len(sessions)
