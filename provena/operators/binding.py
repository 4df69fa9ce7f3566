"""Binding material sections to template slots, and what a binding still lacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.functions import text as tx
from provena.functions.digest import sha
from provena.operators import materials as mat
from provena.operators.ranking import first_rows
from provena.operators.spans import ref_status

#: Why a slot may be left unbound (fixed values).
MISSING_REASONS = ("no_material", "ambiguous", "budget_exceeded", "policy_blocked")
TERMINAL = ("completed", "failed", "cancelled")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once, for use inside higher-order functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slot_markers(slots: DataFrame) -> DataFrame:
    """Each slot's heading marker: its first known marker that its semantics mention."""
    known = F.filter("markers", lambda m: F.contains(F.col("semantic_requirement"), m))
    return slots.withColumn("marker", F.try_element_at(known, F.lit(1)))


def sections(materials: DataFrame) -> DataFrame:
    """Every section of every material: heading, body span, kept only when not empty.

    A section runs from after its heading line to the next heading or the end. The window
    holds the pieces of one material; bodies stay behind, lengths travel.
    """
    pieces = materials.select(
        "task_id", "artifact_id",
        tx.code_points(F.col("text")).alias("_total"),
        F.posexplode(F.split("text", "\n(?=#)")).alias("_pos", "_piece"),
    )
    narrow = pieces.select(
        "task_id", "artifact_id", "_total", "_pos",
        F.length("_piece").alias("_len"),
        F.element_at(F.split("_piece", "\n"), 1).alias("heading"),
    )
    before = Window.partitionBy("artifact_id").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("_len") + 1).over(before), F.lit(0)).cast("bigint")
    placed = narrow.withColumn("section_start", start).filter(F.col("heading").startswith("#"))
    body_start = F.col("section_start") + F.length("heading") + 1
    body_end = F.least(F.col("section_start") + F.col("_len") + 1, F.col("_total"))
    return placed.select(
        "task_id", "artifact_id", "heading", "section_start",
        body_start.alias("span_start"), body_end.alias("span_end"),
    ).filter(F.col("span_start") < F.col("span_end"))


def marker_headings(materials: DataFrame, slots: DataFrame) -> DataFrame:
    """Heading lines that carry a slot's marker, for slots of the material's template."""
    heads = materials.select(
        "task_id", "template_version_id", "artifact_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    ).filter(F.col("line").startswith("#"))
    marked = slot_markers(slots).select("template_version_id", "slot_id", "marker")
    return heads.join(marked, "template_version_id").filter(F.contains(F.col("line"), F.col("marker")))


def first_sections(materials: DataFrame, slots: DataFrame) -> DataFrame:
    """Per task and slot, the first material whose first marked section has a body.

    Within a material only the first heading with the marker counts; when its body is
    empty the next material is tried, never the next heading. Positions and hash are
    found on the row of the text, in one pass per slot; what is shuffled is a span.
    """
    marked = (
        slot_markers(slots)
        .filter(F.col("marker").isNotNull())
        .groupBy("template_version_id")
        .agg(F.collect_list(F.struct("slot_id", "marker")).alias("_slots"))
    )
    split = materials.select(
        "task_id", "template_version_id", "artifact_id", "created_at", "text",
        F.split("text", "\n(?=#)").alias("_pieces"),
    )
    pieces, total = F.col("_pieces"), tx.code_points(F.col("text"))

    def first_section(slot: Column) -> Column:
        fits = F.transform(
            pieces, lambda p: p.startswith("#") & F.contains(F.substring_index(p, "\n", 1), slot["marker"])
        )
        return let(F.array_position(fits, F.lit(True)).cast("int") - 1, lambda at: section_at(slot, at))

    def section_at(slot: Column, at: Column) -> Column:
        before = F.slice(pieces, F.lit(1), F.greatest(at, F.lit(0)))
        start = F.aggregate(before, F.lit(0).cast("bigint"), lambda acc, p: acc + F.length(p) + 1)
        piece = F.get(pieces, at)
        heading = F.length(F.substring_index(piece, "\n", 1))
        return F.struct(
            slot["slot_id"].alias("slot_id"),
            (start + heading + 1).alias("span_start"),
            F.least(start + F.length(piece) + 1, total).alias("span_end"),
        )

    # Slots per template are few, so they ride along as an array and the text is looked at
    # once per material. A slot without a marked section gets NULL ends and is dropped.
    found = F.filter(
        F.transform("_slots", first_section),
        lambda f: f["span_end"].isNotNull() & (f["span_start"] < f["span_end"]),
    )
    spans = split.join(marked, "template_version_id").select(
        "task_id", "artifact_id", "created_at", "text", F.explode(found).alias("_f")
    ).select(
        "task_id", "_f.slot_id", "artifact_id", "created_at", "_f.span_start", "_f.span_end",
        sha(F.col("text")).alias("canonical_sha256"),
        sha(tx.slice_points(F.col("text"), F.col("_f.span_start"), F.col("_f.span_end"))).alias("span_sha256"),
    )
    return first_rows(
        spans, ["task_id", "slot_id"], [F.col("created_at"), F.col("artifact_id")],
        ["artifact_id", "span_start", "span_end", "canonical_sha256", "span_sha256"],
    )


def auto_bind(tasks: DataFrame, materials: DataFrame, slots: DataFrame) -> DataFrame:
    """Every slot of every task, bound to a section or missing for want of material."""
    wanted = tasks.select("task_no", "task_id", "epoch", "template_version_id").join(
        slots.select("template_version_id", "slot_id", "slot_pos", "style_key", "placeholder"), "template_version_id"
    )
    found = first_sections(materials, slots)
    bound = F.col("artifact_id").isNotNull()
    return wanted.join(found, ["task_id", "slot_id"], "left").withColumn(
        "binding_status", F.when(bound, "bound").otherwise("missing")
    ).withColumn("reason_code", F.when(~bound, "no_material"))


def gaps(tasks: DataFrame, slots: DataFrame, bindings: DataFrame, overrides: DataFrame) -> DataFrame:
    """Required slots neither bound nor omitted by the user, per task and epoch.

    Bound slots of all binding versions of the epoch count; pass only the newest rows to
    look at the newest version alone.
    """
    required = tasks.select("task_id", "epoch", "template_version_id").join(
        slots.filter("required").select("template_version_id", "slot_id", "slot_pos"), "template_version_id"
    )
    key = ["task_id", "epoch", "slot_id"]
    bound = bindings.filter(F.col("binding_status") == "bound").select(*key)
    return required.join(bound, key, "left_anti").join(overrides.select(*key), key, "left_anti")


def completed(proposals: DataFrame, tasks: DataFrame, slots: DataFrame) -> DataFrame:
    """Proposals plus an explicit missing row for each required slot they never mention."""
    required = tasks.join(slots.filter("required").select("template_version_id", "slot_id"), "template_version_id")
    silent = required.join(proposals, ["task_id", "slot_id"], "left_anti").select(
        "task_id", "slot_id", F.lit("missing").alias("binding_status"), F.lit("no_material").alias("reason_code")
    )
    return proposals.select("task_id", "slot_id", "binding_status", "reason_code").unionByName(silent)


def status_counts(bindings: DataFrame, keys: list[str]) -> DataFrame:
    status = F.col("binding_status")
    return bindings.groupBy(*keys).agg(
        F.count("*").alias("slots"),
        F.count_if(status == "bound").alias("bound"),
        F.count_if(status == "missing").alias("missing"),
        F.count_if(status == "invalid").alias("invalid"),
    )


def proposal_violations(proposals: DataFrame, slots: DataFrame) -> DataFrame:
    """Rule breaks of proposals (task_id, template_version_id, pos, slot_id, binding_status,
    span_handles, reason_code, error_code), one row per violation."""
    known = slots.select("template_version_id", "slot_id", F.lit(True).alias("_known"))
    firsts = proposals.groupBy("task_id", "slot_id").agg(F.min("pos").alias("_first"))
    checked = proposals.join(known, ["template_version_id", "slot_id"], "left").join(firsts, ["task_id", "slot_id"])
    status, handles = F.col("binding_status"), F.col("span_handles")
    reason, error = F.col("reason_code"), F.col("error_code")
    bound, missing = status == "bound", status == "missing"
    invalid = ~bound & ~missing
    rules = {
        "unknown slot": F.col("_known").isNull(),
        "duplicate slot entry": F.col("pos") > F.col("_first"),
        "bound slot has no span_handles": bound & (F.size(handles) == 0),
        "bound slot repeats a span_handle": bound & (F.size(F.array_distinct(handles)) < F.size(handles)),
        "bound slot must not carry reason_code": bound & reason.isNotNull(),
        "bound slot must not carry error_code": bound & error.isNotNull(),
        "missing slot must have empty span_handles": missing & (F.size(handles) > 0),
        "missing slot lacks reason_code": missing & reason.isNull(),
        "missing slot has unknown reason_code": missing & ~reason.isin(*MISSING_REASONS),
        "missing slot must not carry error_code": missing & error.isNotNull(),
        "invalid slot must have empty span_handles": invalid & (F.size(handles) > 0),
        "invalid slot lacks error_code": invalid & (F.coalesce(error, F.lit("")) == ""),
        "invalid slot must not carry reason_code": invalid & reason.isNotNull(),
    }
    broken = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))
    return checked.select("task_id", "pos", "slot_id", F.explode(broken).alias("violation"))


def commit_guard(epoch: Column) -> Column:
    """Why a task takes no binding now; NULL when it may."""
    return (
        F.when(F.col("status").isNull(), "task_not_found")
        .when(F.col("status").isin(*TERMINAL), "terminal")
        .when(F.col("epoch") != epoch, "stale_epoch")
        .when(F.col("template_version_id").isNull(), "no_template")
    )


def plan_faults(plans: DataFrame, tasks: DataFrame, slots: DataFrame) -> DataFrame:
    """(task_id, plan_fault): why the plan that comes with a task's proposal is not that task's.

    ``plans`` is (task_id, plan_task_id, plan_version_id, slot_id), a row for each slot of the
    plan, one with a NULL slot for a plan without any. What is not known does not pass;
    ``plan_fault`` is NULL for a plan that does. Tasks without a plan have no row.
    """
    template = tasks.select("task_id", F.col("template_version_id").alias("_version"))
    known = slots.select(F.col("template_version_id").alias("_version"), "slot_id", F.lit(True).alias("_known")).distinct()
    joined = plans.join(template, "task_id", "left").join(known, ["_version", "slot_id"], "left")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    fault = (
        F.when(F.bool_or(~same("plan_task_id", "task_id")), "plan_of_another_task")
        .when(F.bool_or(~same("plan_version_id", "_version")), "plan_of_another_version")
        .when(F.bool_or(F.col("slot_id").isNotNull() & F.col("_known").isNull()), "plan_slot_unknown")
    )
    return joined.groupBy("task_id").agg(fault.alias("plan_fault"))


def commit(
    tasks: DataFrame, proposals: DataFrame, materials: DataFrame, slots: DataFrame, prior: DataFrame, plans: DataFrame
) -> DataFrame:
    """One row per task with proposals: what was committed, or why nothing was.

    ``proposals`` is (task_id, proposal_epoch, slot_id, binding_status, reason_code, error_code,
    artifact_id, span_start, span_end, canonical_sha256, span_sha256). Any slot the template
    lacks, bad ref, missing slot without one of the known reasons or invalid slot without an
    error code rejects the task's whole proposal. ``prior`` is (task_id, epoch,
    binding_version), ``plans`` as in ``plan_faults``.
    """
    held = materials.select(
        "artifact_id", F.col("task_id").alias("_holder"), "text",
        sha(F.col("text")).alias("_sha"), tx.code_points(F.col("text")).alias("_total"),
    )
    refs = proposals.join(held, "artifact_id", "left")
    ref_ok = (
        (F.col("_holder") == F.col("task_id"))
        & (ref_status(F.col("text"), F.col("_sha"), F.col("_total")) == "ok")
    )
    status, yes = F.col("binding_status"), lambda c: F.coalesce(c, F.lit(False))
    neither = ~yes(status.isin("bound", "missing"))
    judged = refs.select(
        "task_id", "proposal_epoch", "slot_id", "binding_status",
        (yes(status == "bound") & ~yes(ref_ok)).alias("_bad_ref"),
        (yes(status == "missing") & ~yes(F.col("reason_code").isin(*MISSING_REASONS))).alias("_no_reason"),
        (neither & (F.coalesce("error_code", F.lit("")) == "")).alias("_no_error"),
    )
    template = tasks.select("task_id", "template_version_id")
    known = slots.select("template_version_id", "slot_id", F.lit(True).alias("_known"), "required")
    named = judged.join(template, "task_id", "left").join(known, ["template_version_id", "slot_id"], "left")
    per_task = named.groupBy("task_id").agg(
        F.max("proposal_epoch").alias("_epoch"),
        F.bool_or(F.col("_known").isNull()).alias("_unknown_slot"),
        F.bool_or("_bad_ref").alias("_bad_refs"),
        F.bool_or("_no_reason").alias("_no_reason"),
        F.bool_or("_no_error").alias("_no_error"),
        F.count("*").alias("_slots"),
        F.count_if(status == "bound").alias("bound"),
        F.count_if(status == "missing").alias("_missing"),
        F.count_if(status == "invalid").alias("invalid"),
        F.count_distinct(F.when(F.col("required"), F.col("slot_id"))).alias("_said"),
    )
    required = slots.filter("required").groupBy("template_version_id").agg(F.count_distinct("slot_id").alias("_required"))
    versions = prior.groupBy("task_id", "epoch").agg(F.max("binding_version").alias("_version"))
    digests = mat.set_digests(materials.withColumn("sha256", sha(F.col("text"))))
    joined = (
        per_task.join(tasks.select("task_id", "status", "epoch", "template_version_id"), "task_id", "left")
        .join(required, "template_version_id", "left")
        .join(versions, ["task_id", "epoch"], "left")
        .join(digests, "task_id", "left")
        .join(plan_faults(plans, tasks, slots), "task_id", "left")
    )
    silent = F.coalesce("_required", F.lit(0)) - F.col("_said")
    outcome = F.coalesce(
        commit_guard(F.col("_epoch")),
        F.col("plan_fault"),
        F.when(F.col("_unknown_slot"), "unknown_slot").when(F.col("_bad_refs"), "ref_rejected")
        .when(F.col("_no_reason"), "unknown_reason").when(F.col("_no_error"), "no_error_code"),
        F.lit("committed"),
    )
    done = F.col("outcome") == "committed"
    return joined.withColumn("outcome", outcome).select(
        "task_id", "outcome",
        F.when(done, F.coalesce(F.col("_version"), F.lit(0)) + 1).cast("bigint").alias("binding_version"),
        F.when(done, F.coalesce("set_digest", mat.empty_set_digest())).alias("set_digest"),
        F.when(done, F.col("_slots") + silent).cast("bigint").alias("slots"),
        F.when(done, F.col("bound")).alias("bound"),
        F.when(done, F.col("_missing") + silent).cast("bigint").alias("missing"),
        F.when(done, F.col("invalid")).alias("invalid"),
    )
