"""The append-only ledger in batch: replays, versions, transitions, lineage, reconciling.

What a row-at-a-time ledger decides with its stored state is decided here from the first
row per key that counts, found by a partial aggregation and joined back. A key with very
many rows is therefore reduced before it moves, and AQE splits its join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.operators.ranking import bucket_of, latest_rows, previous_rows, row_numbers
from provena.session import settle

#: Status changes a task may make (fixed values).
TRANSITIONS = {
    "created": ("running", "failed", "cancelled"),
    "running": ("awaiting_user", "parked", "completed", "failed", "cancelled"),
    "awaiting_user": ("running", "parked", "cancelled", "failed"),
    "parked": ("running", "cancelled"),
    "completed": (),
    "failed": (),
    "cancelled": (),
}

#: Files a template version consists of (fixed values).
TEMPLATE_FILES = ("template.docx", "contract.json", "styles.json", "static-map.json")

#: What an event code is called when shown (fixed values).
EVENT_LABELS = {
    "task_submitted": "任务已提交",
    "inventory": "盘点材料",
    "tool_call": "工具调用",
    "plan": "生成内容计划",
    "researched": "联网采集完成",
    "research_failed": "联网采集失败（已跳过，非任务失败）",
    "assembled": "装配槽位绑定",
    "binding_committed": "绑定已提交",
    "awaiting_user": "等待补充材料",
    "decision_provide_material": "已补充材料，任务继续",
    "decision_omit_slot": "已豁免槽位，任务继续",
    "exported": "交付物已导出",
    "execution_failed": "执行失败",
    "task_cancelled": "任务已取消",
    "task_recovered": "任务已恢复",
}
EVENT_NOTES = {"research_failed": "采集失败不阻断装配：任务继续执行，缺槽时由门禁提示补充材料"}


def allowed(before: Column, after: Column) -> Column:
    """Whether a status change is allowed."""
    pairs = [f"{a}>{b}" for a, targets in TRANSITIONS.items() for b in targets]
    return F.concat(before, F.lit(">"), after).isin(*pairs)


def idempotency(
    rows: DataFrame, key: Sequence[str], digest: str, order: str, counts: Column | None = None, refused: str = "refused"
) -> DataFrame:
    """Each row as ``new``, ``replay`` or ``conflict``: the first write of a key wins.

    With ``counts`` only rows for which it holds can be the first write; others that find
    nothing stored yet are ``refused`` and store nothing.
    """
    key = list(key)
    storable = rows if counts is None else rows.filter(counts)
    firsts = storable.groupBy(*key).agg(
        F.min(order).alias("_first"), F.min_by(F.col(digest), F.col(order)).alias("_stored")
    )
    outcome = (
        F.when(F.col("_first").isNull() | (F.col(order) < F.col("_first")), refused)
        .when(F.col(order) == F.col("_first"), "new")
        .when(F.col(digest) == F.col("_stored"), "replay")
        .otherwise("conflict")
    )
    return rows.join(firsts, key, "left").withColumn("outcome", outcome).drop("_first", "_stored")


def order_versions(orders: DataFrame) -> DataFrame:
    """Orders as versions of their customer: 1, 2, … by date and key."""
    day = F.unix_date(F.to_date("o_orderdate")).cast("bigint")
    return row_numbers(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], day, "version")


def next_version(keys: DataFrame, rows: DataFrame, key: str, row_key: str, version: str) -> DataFrame:
    """``max + 1`` per key, 1 for keys without rows."""
    newest = rows.groupBy(F.col(row_key).alias(key)).agg(F.max(version).alias("_max"))
    return keys.join(newest, key, "left").select(
        key, (F.coalesce(F.col("_max"), F.lit(0)) + 1).cast("bigint").alias("next_version")
    )


def illegal_transitions(log: DataFrame) -> DataFrame:
    """Recorded status changes (task_id, seq, status) the transition table does not allow."""
    seen = previous_rows(log, ["task_id"], [F.col("seq")], bucket_of(F.col("seq")), {"status": "_before"})
    before = F.coalesce(F.col("_before"), F.lit("created"))
    return seen.withColumn("before", before).filter(~allowed(F.col("before"), F.col("status"))).drop("_before")


def epoch_breaks(log: DataFrame, key: str, order: Sequence[Column], bucket: Column) -> DataFrame:
    """Epoch changes that do not advance by exactly one; the first epoch is one."""
    seen = previous_rows(log, [key], order, bucket, {"epoch": "_before"})
    expected = F.coalesce(F.col("_before"), F.lit(0)) + 1
    return seen.withColumn("expected", expected.cast("bigint")).filter(F.col("epoch") != F.col("expected")).drop("_before")


def operation_outcomes(commands: DataFrame) -> DataFrame:
    """What each command (operation_id, seq, command, outputs) does to its operation.

    The first commit or abandon settles an operation for good, so later commands are
    judged against it alone.
    """
    settling = commands.filter(F.col("command").isin("commit", "abandon"))
    settled = settling.groupBy("operation_id").agg(
        F.min("seq").alias("_at"),
        F.min_by("command", "seq").alias("_command"),
        F.min_by("outputs", "seq").alias("_outputs"),
    )
    command, open_ = F.col("command"), F.col("_at").isNull() | (F.col("seq") < F.col("_at"))
    committed = F.col("_command") == "commit"
    outcome = (
        F.when(open_, "intent")
        .when(F.col("seq") == F.col("_at"), F.when(committed, "committed").otherwise("abandoned"))
        .when(command == "intent", "replay")
        .when((command == "commit") & committed, F.when(F.col("outputs") == F.col("_outputs"), "replay").otherwise("conflict"))
        .when(command == "commit", "error_abandoned")
        .when(committed, "error_committed")
        .otherwise("replay")
    )
    return commands.join(settled, "operation_id", "left").select("operation_id", "seq", "command", outcome.alias("outcome"))


def latest_versions(versions: DataFrame, meta: DataFrame) -> DataFrame:
    """Newest version per template, shown by its name or, without one, by its id."""
    newest = latest_rows(versions, ["template_id"], [F.col("version")], ["version", "template_version_id", "created_at"])
    return newest.join(meta, "template_id", "left").withColumn(
        "display_name", F.coalesce(F.col("display_name"), F.col("template_id").cast("string"))
    )


def feed(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """Events after each task's cursor (task_id, after_seq)."""
    return log.join(cursors, "task_id").filter(F.col("seq") > F.col("after_seq"))


def last_seqs(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """Where each task's cursor stands after the feed: its last event, or where it was."""
    seen = feed(log, cursors).groupBy("task_id").agg(F.max("seq").alias("_last"), F.count("*").alias("n_events"))
    return cursors.join(seen, "task_id", "left").select(
        "task_id", "after_seq",
        F.coalesce(F.col("_last"), F.col("after_seq")).alias("last_seq"),
        F.coalesce(F.col("n_events"), F.lit(0)).alias("n_events"),
    )


def appended(log: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """A batch of new events with the sequence numbers they get after the log's last one."""
    last = log.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_last"))
    numbered = row_numbers(batch, [], [F.col(order)], bucket_of(F.col(order)), "_pos")
    return numbered.withColumn("seq", last.scalar() + F.col("_pos")).drop("_pos")


def reconcile(files: DataFrame, register: DataFrame, checked_at: Column) -> DataFrame:
    """Stored files (path, sha256) against the register; the first corrupt time is kept."""
    found = files.select("path", F.col("sha256").alias("_found"))
    kept = register.select("path", F.col("sha256").alias("_kept"), "corrupt_at")
    state = (
        F.when(F.col("_kept").isNull(), "adopt")
        .when(F.col("_found").isNull(), "missing")
        .when(F.col("_found") != F.col("_kept"), "corrupt")
        .otherwise("ok")
    )
    joined = found.join(kept, "path", "full_outer").withColumn("state", state)
    at = F.coalesce(F.col("corrupt_at"), F.when(F.col("state") == "corrupt", checked_at))
    return joined.select("path", "state", at.alias("corrupt_at"), F.coalesce("_found", "_kept").alias("sha256"))


def manifest_problems(manifests: DataFrame, register: DataFrame, digests: Sequence[str]) -> DataFrame:
    """Manifests against the register: digests that disagree, files without one."""
    recorded = register.select("template_version_id", *[F.col(d).alias(f"_{d}") for d in digests])
    joined = manifests.join(recorded, "template_version_id", "left")
    unknown = F.when(F.col(f"_{digests[0]}").isNull(), F.lit("version not registered"))
    differ = [
        F.when(~F.col(d).eqNullSafe(F.col(f"_{d}")) & F.col(f"_{d}").isNotNull(), F.lit(f"manifest {d} disagrees"))
        for d in digests
    ]
    wanted = F.array(*[F.lit(f) for f in TEMPLATE_FILES])
    lacking = F.transform(F.array_except(wanted, "files"), lambda f: F.concat(F.lit("lacks digest for "), f))
    problems = F.concat(F.array_compact(F.array(unknown, *differ)), lacking)
    return joined.select("template_version_id", F.explode(problems).alias("problem"))


def decision_guard(decisions: DataFrame, waits: DataFrame, tasks: DataFrame, slots: DataFrame) -> DataFrame:
    """Decisions with the first rule of the ledger they break, as ``guard`` and ``slot_guard``.

    ``guard`` is about the awaiting event and the task, ``slot_guard`` about the slot to
    omit or the material supplied and is NULL where ``guard`` already failed.
    """
    event = waits.select(
        "awaiting_event_id", F.col("task_id").alias("_event_task"), F.col("epoch").alias("_event_epoch"),
        F.col("resolved").alias("_resolved"), "missing_slot_ids",
    )
    task = tasks.select("task_id", F.col("epoch").alias("_epoch"), F.col("status").alias("_status"), "template_version_id")
    omit = slots.select("template_version_id", "slot_id", "allow_user_omit")
    expected, omits = F.col("expected_epoch"), F.col("action") == "omit_slot"
    guard = (
        F.when(F.col("_status").isNull(), "task_not_found")
        .when(F.col("_event_task").isNull() | (F.col("_event_task") != F.col("task_id")), "wrong_task")
        .when(F.col("_resolved"), "already_resolved")
        .when((F.col("_event_epoch") != expected) | (F.col("_epoch") != expected), "stale_epoch")
        .when(F.col("_status") != "awaiting_user", "wrong_state")
        .otherwise("ok")
    )
    slot_guard = (
        F.when(~omits & (F.col("n_materials") < 1), "no_material")
        .when(omits & F.col("slot_id").isNull(), "no_slot")
        .when(omits & ~F.coalesce(F.array_contains(F.col("missing_slot_ids"), F.col("slot_id")), F.lit(False)), "slot_not_listed")
        .when(omits & ~F.coalesce(F.col("allow_user_omit"), F.lit(False)), "omit_not_allowed")
        .otherwise("ok")
    )
    joined = (
        decisions.join(event, "awaiting_event_id", "left")
        .join(task, "task_id", "left")
        .join(omit, ["template_version_id", "slot_id"], "left")
    )
    return joined.withColumn("guard", guard).withColumn("slot_guard", F.when(F.col("guard") == "ok", slot_guard)).drop(
        "_event_task", "_event_epoch", "_resolved", "_status", "missing_slot_ids", "template_version_id", "allow_user_omit"
    )


def respond(decisions: DataFrame, waits: DataFrame, tasks: DataFrame, slots: DataFrame) -> DataFrame:
    """The outcome of decisions arriving in ``seq`` order, and the epoch each leads to.

    A decision that passes the guard is stored, and the first stored one whose slot also
    passes resolves the event. Repeats of a stored id are replays or conflicts.
    """
    judged = decision_guard(decisions, waits, tasks, slots)
    passing = judged.filter(F.col("guard") == "ok")
    by_id = passing.groupBy("decision_id").agg(
        F.min("seq").alias("_id_first"), F.min_by("payload_digest", "seq").alias("_id_digest")
    )
    named = judged.join(by_id, "decision_id", "left")
    effective = named.filter(
        (F.col("guard") == "ok") & (F.col("slot_guard") == "ok") & (F.col("seq") == F.col("_id_first"))
    )
    resolving = effective.groupBy("awaiting_event_id").agg(F.min("seq").alias("_resolved_by"))
    # An id counts as stored when its first passing row came before its event was resolved.
    home = passing.groupBy("decision_id").agg(F.min_by("awaiting_event_id", "seq").alias("awaiting_event_id"))
    settled = home.join(resolving, "awaiting_event_id", "left").select(
        "decision_id", F.col("_resolved_by").alias("_home_resolved")
    )
    joined = named.join(resolving, "awaiting_event_id", "left").join(settled, "decision_id", "left")
    seq, end = F.col("seq"), F.col("_resolved_by")
    stored = F.col("_id_first").isNotNull() & (F.col("_home_resolved").isNull() | (F.col("_id_first") <= F.col("_home_resolved")))
    outcome = (
        F.when(stored & (seq > F.col("_id_first")), F.when(F.col("payload_digest") == F.col("_id_digest"), "replay").otherwise("conflict"))
        .when(F.col("guard") != "ok", F.col("guard"))
        .when(end.isNotNull() & (seq > end), "already_resolved")
        .when(F.col("slot_guard") != "ok", F.col("slot_guard"))
        .otherwise("accepted")
    )
    bumped = (F.col("outcome") == "accepted") & (F.col("action") == "provide_material")
    return joined.withColumn("outcome", outcome).select(
        "seq", "decision_id", "task_id", "action", "outcome",
        F.when(F.col("outcome") == "accepted", F.col("_epoch") + F.when(bumped, 1).otherwise(0)).alias("epoch_after"),
        ((F.col("outcome") == "accepted") & (F.col("action") == "omit_slot")).alias("override_recorded"),
    )


def reconcile_status(tasks: DataFrame, deliveries: DataFrame, commands: DataFrame) -> DataFrame:
    """What recovering, running or cancelling a task does to its status."""
    done = deliveries.select("task_id", F.lit(True).alias("_delivered")).distinct()
    status, command = F.col("status"), F.col("command")
    delivered = F.coalesce(F.col("_delivered"), F.lit(False))
    terminal = status.isin("completed", "failed", "cancelled")
    after = (
        F.when((command == "cancel") & ~terminal, "cancelled")
        .when((command == "recover") & delivered & (status == "running"), "completed")
        .when((command == "run") & (status == "created"), "running")
        .otherwise(status)
    )
    note = (
        F.when((command == "run") & (status == "cancelled"), "cannot run a cancelled task")
        .when((status == "completed") & ~delivered, "completed without a delivery")
        .otherwise("ok")
    )
    return commands.join(tasks, "task_id").join(done, "task_id", "left").select(
        "task_id", "command", "status", after.alias("status_after"), note.alias("note")
    )


def lineage(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """All ancestors of each root over (child, parent) edges, with the smallest depth; without
    ``roots`` those of every child.

    Roots share most of their ancestry. So the closure is built over the edges whose child is
    itself somebody's parent, each of those with its ancestors in one row, and a root's edges
    are joined to it once: what moves is two rows per edge, not one per ancestor and level.
    The closure is the same question over fewer edges, until they no longer shrink by half;
    from there on it is built step by step.
    """
    child = F.col("child")
    # Everything lies by child: one exchange per side, the joins below need no other.
    links = edges.select("child", "parent").repartition(child).distinct()
    parents = edges.select(F.col("parent").alias("child")).distinct().withColumn("upper", F.lit(True))
    marked = links.join(parents, "child", "left").withColumn("upper", F.col("upper").isNotNull())
    if roots is None:
        marked = marked.withColumn("root", F.lit(True))
    else:
        named = roots.select(F.col(roots.columns[0]).alias("child")).distinct().withColumn("root", F.lit(True))
        marked = marked.join(named, "child", "left").withColumn("root", F.col("root").isNotNull()).filter("root OR upper")
    marked = settle(marked, "lineage-edges")
    upper = marked.filter("upper").select("child", "parent")
    before, after = marked.count(), upper.count()
    first = marked.filter("root").select(child.alias("root"), "parent")
    if after == 0:
        return first.select("root", F.col("parent").alias("ancestor"), F.lit(1).cast("bigint").alias("depth"))
    closure = lineage(upper) if 2 * after <= before else _steps(upper)
    above = closure.groupBy(F.col("root").alias("_node")).agg(
        F.collect_list(F.struct("ancestor", (F.col("depth") + 1).alias("depth"))).alias("_above")
    )
    joined = first.join(above, F.col("parent") == F.col("_node"), "left").select("root", "parent", "_above").repartition("root")
    own = F.array(F.struct(F.col("parent").alias("ancestor"), F.lit(1).cast("bigint").alias("depth")))
    every = joined.select("root", F.inline(F.when(F.col("_above").isNull(), own).otherwise(F.concat(own, F.col("_above")))))
    return every.groupBy("root", "ancestor").agg(F.min("depth").alias("depth"))


def _steps(links: DataFrame) -> DataFrame:
    """All ancestors of every child of distinct (child, parent) links. Each round goes one step
    on from the pairs that the last one found, and leaves out those known, so it ends at the
    last ancestor, cycles or not."""
    step = links.select(F.col("child").alias("parent"), F.col("parent").alias("_next"))
    closure = level = links.select("child", "parent", F.lit(1).cast("bigint").alias("depth"))
    depth = 1
    while not level.isEmpty():
        depth += 1
        onward = level.join(step, "parent").select("child", F.col("_next").alias("parent")).distinct()
        new = onward.join(closure, ["child", "parent"], "left_anti")
        level = settle(new.withColumn("depth", F.lit(depth).cast("bigint")), "lineage-level")
        closure = closure.unionByName(level)
    return closure.select(F.col("child").alias("root"), F.col("parent").alias("ancestor"), "depth")


def event_label(code: Column) -> Column:
    pairs = [F.lit(x) for pair in EVENT_LABELS.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), code)


def event_note(code: Column) -> Column:
    pairs = [F.lit(x) for pair in EVENT_NOTES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit(""))


def sorted_pairs(values: Column) -> Column:
    """A map printed as ``k=v`` pairs in key order."""
    entries = F.array_sort(F.map_entries(values))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), " ")


def usage(calls: DataFrame) -> DataFrame:
    """Tokens per task and node over all attempts; NULL stays NULL when no call reported any."""
    return calls.groupBy("task_id", "node_name").agg(
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count("*").alias("n_calls")
    )


def submissions(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """Requests in arrival order: created, replay, conflict, or for an unknown template.

    A request for an unknown template stores nothing, so it cannot be replayed.
    """
    known = versions.select("template_version_id").distinct().withColumn("_known", F.lit(True))
    checked = requests.join(known, "template_version_id", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    judged = idempotency(checked, ["request_id"], "payload_digest", "arrival", F.col("_known"), "unknown_template")
    return judged.withColumn("outcome", F.when(F.col("outcome") == "new", "created").otherwise(F.col("outcome"))).drop("_known")


#: Events of one task that are folded in one row; one such row per task and level.
FOLD_WIDTH = 1 << 9


def replay_states(log: DataFrame, width: int = FOLD_WIDTH) -> DataFrame:
    """Run each task's state machine over its requested statuses (task_id, seq, status).

    A request that the table forbids is rejected and changes nothing, so the state is a
    fold, not a lag. A stretch of the log maps each start state to an end state; such maps
    compose, so stretches of ``width`` sequence numbers are folded apart, then stretches
    of stretches, until one spans the log. No row holds more than ``width`` entries.
    """
    last = log.agg(F.max("seq")).first()[0] or 0
    levels = 1
    while width**levels <= last:
        levels += 1
    states = F.array(*[F.lit(s) for s in TRANSITIONS])

    def step(state: Column, request: Column) -> Column:
        return F.when(allowed(state, request), request).otherwise(state)

    requests = log.groupBy("task_id", bucket_of(F.col("seq"), width).alias("_b0")).agg(
        F.array_sort(F.collect_list(F.struct("seq", "status"))).alias("_log")
    )
    stretch = requests.select(
        "task_id", "_b0",
        F.transform(states, lambda s: F.aggregate("_log", s, lambda a, r: step(a, r["status"]))).alias("_map"),
    )

    def jump(state: Column, mapping: Column) -> Column:
        return F.element_at(mapping, F.array_position(states, state).cast("int"))

    # Upwards: one map per stretch of stretches.
    maps = [stretch]
    for level in range(1, levels):
        below = maps[-1].select("task_id", F.col(f"_b{level - 1}").alias("_pos"), "_map")
        grouped = below.groupBy("task_id", bucket_of(F.col("_pos"), width).alias(f"_b{level}")).agg(
            F.array_sort(F.collect_list(F.struct("_pos", "_map"))).alias("_maps")
        )
        maps.append(
            grouped.select(
                "task_id", f"_b{level}",
                F.transform(states, lambda s: F.aggregate("_maps", s, lambda a, m: jump(a, m["_map"]))).alias("_map"),
            )
        )
    # Downwards: the state each stretch starts in.
    starts = maps[-1].select("task_id", F.col(f"_b{levels - 1}").alias("_up"), F.lit("created").alias("_start"))
    for level in range(levels - 2, -1, -1):
        children = maps[level].select(
            "task_id", F.col(f"_b{level}").alias("_pos"), bucket_of(F.col(f"_b{level}"), width).alias("_up"), "_map"
        )
        grouped = children.groupBy("task_id", "_up").agg(F.array_sort(F.collect_list(F.struct("_pos", "_map"))).alias("_maps"))
        opened = grouped.join(starts, ["task_id", "_up"]).select(
            "task_id", F.explode(_prefixes(F.col("_maps"), F.col("_start"), lambda a, m: jump(a, m["_map"]), "_pos")).alias("_p")
        )
        starts = opened.select("task_id", F.col("_p.at").alias("_up"), F.col("_p.before").alias("_start"))
    placed = requests.join(starts.withColumnRenamed("_up", "_b0"), ["task_id", "_b0"])
    rows = placed.select(
        "task_id",
        F.explode(_prefixes(F.col("_log"), F.col("_start"), lambda a, r: step(a, r["status"]), "seq", "status")).alias("_p"),
    )
    return rows.select(
        "task_id", F.col("_p.at").alias("seq"), F.col("_p.asked").alias("status"),
        F.col("_p.before").alias("state_before"), F.col("_p.after").alias("state_after"),
        F.when(allowed(F.col("_p.before"), F.col("_p.asked")), "applied").otherwise("rejected").alias("outcome"),
    )


def _prefixes(items: Column, start: Column, step, at: str, asked: str | None = None) -> Column:
    """The state before and after each item of an ordered array of at most FOLD_WIDTH items."""
    kind = "array<struct<at:bigint,before:string,after:string,asked:string>>"

    def merge(acc: Column, item: Column) -> Column:
        after = step(acc["state"], item)
        entry = F.struct(
            item[at].alias("at"), acc["state"].alias("before"), after.alias("after"),
            (item[asked] if asked else F.lit(None).cast("string")).alias("asked"),
        )
        return F.struct(after.alias("state"), F.concat(acc["seen"], F.array(entry)).alias("seen"))

    begin = F.struct(start.alias("state"), F.array().cast(kind).alias("seen"))
    return F.aggregate(items, begin, merge)["seen"]
