"""Ledger operators against row-at-a-time Python, with hot keys and many small buckets."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from provena.operators import ledger, ranking, web


def hot_log(n=3000, seed=7):
    """A log in which one task holds a third of all rows."""
    rng = random.Random(seed)
    states = list(ledger.TRANSITIONS)
    return [
        ("hot" if rng.random() < 0.34 else f"t{rng.randrange(40)}", seq, rng.choice(states[1:4] * 8 + states[4:]))
        for seq in rng.sample(range(n * 3), n)
    ]


def test_row_numbers_and_previous_rows_over_buckets(spark):
    log = hot_log()
    frame = spark.createDataFrame(log, "task_id string, seq bigint, status string")
    bucket = ranking.bucket_of(F.col("seq"), 64)
    numbered = ranking.row_numbers(frame, ["task_id"], [F.col("seq")], bucket, "n")
    shifted = ranking.previous_rows(numbered, ["task_id"], [F.col("seq")], bucket, {"status": "before"})
    got = {(r.task_id, r.seq): (r.n, r.before) for r in shifted.collect()}
    want, seen = {}, {}
    for task, seq, status in sorted(log, key=lambda r: r[1]):
        n, before = seen.get(task, (0, None))
        want[task, seq] = (n + 1, before)
        seen[task] = (n + 1, status)
    assert got == want


def test_hot_keys_are_cut_at_measured_quantiles(spark):
    rows = [("hot", i * i) for i in range(5000)] + [("cold", i) for i in range(90)] + [("tie", 7)] * 300 + [("hot", None)]
    frame = spark.createDataFrame(rows, "k string, seq bigint")
    cut = ranking.measured_buckets(frame, ["k"], "seq", rows=100).collect()
    sizes = {}
    for r in cut:
        sizes[r.k, r._piece] = sizes.get((r.k, r._piece), 0) + 1
    hot = [n for (k, _), n in sizes.items() if k == "hot"]
    assert len(hot) > 40 and max(hot) < 200 and sizes["cold", 0] == 90 and len([k for k, _ in sizes if k == "tie"]) == 1
    ordered = [r._piece for r in sorted((r for r in cut if r.k == "hot"), key=lambda r: -1 if r.seq is None else r.seq)]
    assert ordered == sorted(ordered)
    numbered = ranking.row_numbers(
        ranking.measured_buckets(frame.filter("k != 'tie'"), ["k"], "seq", rows=100), ["k"], [F.col("seq")], F.col("_piece"), "n"
    )
    got = sorted((r.k, r.n, -1 if r.seq is None else r.seq) for r in numbered.collect())
    hot_want = [("hot", i + 1, v) for i, v in enumerate([-1] + [i * i for i in range(5000)])]
    assert got == [("cold", i + 1, i) for i in range(90)] + hot_want
    assert ranking.measured_buckets(frame.limit(0), ["k"], "seq").count() == 0


def test_row_numbers_without_keys(spark):
    frame = spark.createDataFrame([(i * 3,) for i in range(500)], "v bigint")
    rows = ranking.row_numbers(frame, [], [F.col("v")], ranking.bucket_of(F.col("v"), 10), "n").collect()
    assert {r.v: r.n for r in rows} == {i * 3: i + 1 for i in range(500)}


def test_state_machine_folds_over_levels(spark):
    log = hot_log()
    frame = spark.createDataFrame(log, "task_id string, seq bigint, status string")
    got = {(r.task_id, r.seq): (r.state_before, r.state_after, r.outcome) for r in ledger.replay_states(frame, width=8).collect()}
    state, want = {}, {}
    for task, seq, asked in sorted(log, key=lambda r: r[1]):
        before = state.get(task, "created")
        after = asked if asked in ledger.TRANSITIONS[before] else before
        want[task, seq] = (before, after, "applied" if asked in ledger.TRANSITIONS[before] else "rejected")
        state[task] = after
    assert got == want


def test_idempotency_with_a_hot_key(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(50)}", rng.choice("ab")) for i in range(1500)]
    frame = spark.createDataFrame(rows, "seq bigint, key string, digest string")
    got = {r.seq: r.outcome for r in ledger.idempotency(frame, ["key"], "digest", "seq").collect()}
    stored, want = {}, {}
    for seq, key, digest in rows:
        want[seq] = "new" if key not in stored else "replay" if stored[key] == digest else "conflict"
        stored.setdefault(key, digest)
    assert got == want


def test_top_rows_limits_before_the_exchange(spark):
    frame = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    plan = ranking.top_rows(frame, ["k"], [F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_operations_commit_and_abandon(spark):
    commands = [
        ("a", 1, "intent", ""), ("a", 2, "commit", "x"), ("a", 3, "commit", "x"), ("a", 4, "commit", "y"), ("a", 5, "abandon", ""),
        ("b", 1, "intent", ""), ("b", 2, "abandon", ""), ("b", 3, "abandon", ""), ("b", 4, "commit", "x"),
    ]
    frame = spark.createDataFrame(commands, "operation_id string, seq bigint, command string, outputs string")
    got = {(r.operation_id, r.seq): r.outcome for r in ledger.operation_outcomes(frame).collect()}
    assert [got["a", i] for i in range(1, 6)] == ["intent", "committed", "replay", "conflict", "error_committed"]
    assert [got["b", i] for i in range(1, 5)] == ["intent", "abandoned", "replay", "error_abandoned"]


def test_respond_equals_row_at_a_time(spark):
    rng = random.Random(11)
    tasks = [("t1", 1, "awaiting_user", "v"), ("t2", 2, "running", "v")]
    waits = [("e1", "t1", 1, False, ["risks", "plan"]), ("e2", "t2", 2, False, ["risks"])]
    slots = [("v", "risks", True), ("v", "plan", False)]
    decisions = []
    for seq in range(300):
        event = rng.choice(["e1", "e1", "e1", "e2", "e9"])
        decisions.append(
            (seq, f"d{rng.randrange(60)}", rng.choice(["t1", "t1", "t1", "t2"]), event, rng.choice([1, 1, 1, 2]),
             rng.choice(["omit_slot", "provide_material"]), rng.choice(["plan", "plan", "sales", None, "risks" if seq > 150 else "plan"]),
             0 if seq < 150 else rng.choice([0, 1]), rng.choice("xy"))
        )
    frame = spark.createDataFrame(
        decisions, "seq bigint, decision_id string, task_id string, awaiting_event_id string, expected_epoch int, action string, "
        "slot_id string, n_materials int, payload_digest string",
    )
    got = {
        r.seq: (r.outcome, r.epoch_after)
        for r in ledger.respond(
            frame, spark.createDataFrame(waits, "awaiting_event_id string, task_id string, epoch int, resolved boolean, missing_slot_ids array<string>"),
            spark.createDataFrame(tasks, "task_id string, epoch int, status string, template_version_id string"),
            spark.createDataFrame(slots, "template_version_id string, slot_id string, allow_user_omit boolean"),
        ).collect()
    }
    events, stored, resolved, want = {w[0]: w for w in waits}, {}, set(), {}
    by_task = {t[0]: t for t in tasks}
    for seq, ident, task, event, expected, action, slot, n, digest in decisions:
        _, epoch, status, _ = by_task[task]
        held = events.get(event)
        if ident in stored:
            want[seq] = ("replay" if stored[ident] == digest else "conflict", None)
            continue
        if held is None or held[1] != task:
            outcome = "wrong_task"
        elif held[2] != expected or epoch != expected:
            outcome = "already_resolved" if event in resolved else "stale_epoch"
        elif status != "awaiting_user":
            outcome = "wrong_state"
        elif event in resolved:
            outcome = "already_resolved"
        else:
            stored[ident] = digest
            if action == "provide_material":
                outcome = "accepted" if n else "no_material"
            elif slot is None:
                outcome = "no_slot"
            elif slot not in held[4]:
                outcome = "slot_not_listed"
            else:
                outcome = "accepted" if slot == "risks" else "omit_not_allowed"
            if outcome == "accepted":
                resolved.add(event)
        want[seq] = (outcome, epoch + (action == "provide_material") if outcome == "accepted" else None)
    soft = {"stale_epoch", "already_resolved"}
    for seq, pair in want.items():
        assert got[seq] == pair or {got[seq][0], pair[0]} <= soft, (seq, got[seq], pair)
    assert "accepted" in {o for o, _ in want.values()} and "conflict" in {o for o, _ in want.values()}


def test_sources_cap_counts_program_texts(spark):
    rows = [("t", i, f"http://h/{i % 17}", "  " if i == 3 else f"text {i}") for i in range(30)]
    rows += [("t", 100 + i, f"program://d{i}", "digest") for i in range(3)] + [("t", 5, "program://early", "x")]
    rows = [(t, a * 2 + u.startswith("program"), u, x) for t, a, u, x in rows]
    frame = spark.createDataFrame(rows, "task_id string, arrival bigint, url string, text string")
    got = {(r.arrival, r.url): (r.outcome, r.filename) for r in web.register_sources(frame).collect()}
    held, want = [], {}
    for _, arrival, url, text in sorted(rows, key=lambda r: r[1]):
        if url in held:
            want[arrival, url] = "reused"
        elif not url.startswith("program") and len(held) >= 12:
            want[arrival, url] = "refused_budget"
        elif not text.strip():
            want[arrival, url] = "refused_empty"
        else:
            want[arrival, url] = "registered"
            assert got[arrival, url][1].startswith(f"research_{len(held):03d}_")
            held.append(url)
    assert {k: v[0] for k, v in got.items()} == want


def test_lineage_over_diamonds(spark):
    edges = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("r2", "c")], "child string, parent string")
    roots = spark.createDataFrame([("r1",), ("r2",)], "node string")
    got = {(r.root, r.ancestor, r.depth) for r in ledger.lineage(edges, roots).collect()}
    assert got == {("r1", "a", 1), ("r1", "b", 1), ("r1", "c", 2), ("r1", "d", 3), ("r2", "c", 1), ("r2", "d", 2)}


def test_lineage_moves_a_root_once_and_holds_cycles(spark, monkeypatch):
    """Against a plain search, over graphs that thin out, chains and cycles. A graph that thins
    out upwards is no longer walked level by level over all its edges."""
    thin = [(f"l{i}", f"o{i // 2}") for i in range(40)] + [(f"l{i}", f"s{i % 3}") for i in range(40)]
    thin += [(f"o{i}", f"c{i % 4}") for i in range(20)] + [(f"c{i}", f"s{i % 3}") for i in range(4)] + [("s0", "n"), ("s1", "n"), ("n", "r")]
    chain = [(f"v{i}", f"v{i + 1}") for i in range(9)] + [("v3", "v7")]
    cycle = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("x", "x"), ("y", "x"), ("y", None), ("y", "x")]
    steps = []
    plain = ledger._steps
    monkeypatch.setattr(ledger, "_steps", lambda links: steps.append(links.count()) or plain(links))
    for pairs, roots, walked in ((thin, [f"l{i}" for i in range(38)] + ["l1", "c2", "none"], []), (chain, ["v0", "v4"], [9]), (cycle, ["y", "b"], [7])):
        edges = spark.createDataFrame(pairs, "child string, parent string")
        want = set()
        for root in set(roots):
            depth, seen, level = 1, {}, {p for c, p in pairs if c == root}
            while level:
                seen.update({node: depth for node in level if node not in seen})
                depth, level = depth + 1, {p for c, p in pairs if c in level} - set(seen)
            want |= {(root, node, at) for node, at in seen.items()}
        steps.clear()
        got = [tuple(r) for r in ledger.lineage(edges, spark.createDataFrame([(r,) for r in roots], "node string")).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert (not steps) if not walked else steps
