"""Assembly of a document from bindings, and the gates before and after it.

Every gate returns findings for all tasks at once. A document is compared paragraph by
paragraph with a positional join; windows hold the paragraphs of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.functions import text as tx
from provena.functions import tokens as tk
from provena.functions.digest import operation_key, ordered_digests, payload_digest, sha, stable_id
from provena.operators import materials as mat
from provena.operators.findings import finding, listed_messages, union_all
from provena.operators.ranking import first_rows

GATE_A = "provenance_precheck"
GATE_B = "provenance_gate"
FORMAT_GATE = "format_gate"
IMPLEMENTATION = "provena/1"
REQUIRED_GATES = (GATE_A, GATE_B, FORMAT_GATE)

#: Problems that one finding spells out; it also says how many more there are, and all of
#: them are rows of the checks' own tables.
SHOWN = 1000


def build_render_slots(bindings: DataFrame, slots: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bindings to (slots to render, refused tasks).

    Refused: a slot the contract lacks, an invalid binding, or a missing slot the user did
    not omit. The first two name the first such slot, the last names all of them.
    """
    spec = slots.select("template_version_id", "slot_id", F.col("style_key").alias("_style"))
    waived = overrides.select("task_id", "epoch", "slot_id", F.col("reason_artifact_id").alias("override_artifact_id"))
    joined = (
        bindings.drop("style_key")
        .join(spec, ["template_version_id", "slot_id"], "left")
        .join(waived, ["task_id", "epoch", "slot_id"], "left")
    )
    status = F.col("binding_status")
    trouble = (
        F.when(F.col("_style").isNull(), "unknown slot")
        .when(status == "invalid", "invalid binding")
        .when((status == "missing") & F.col("override_artifact_id").isNull(), "still missing")
    )
    judged = joined.withColumn("_trouble", trouble)
    bad = judged.filter(F.col("_trouble").isNotNull())
    # Slots per task are bounded by its template.
    per_task = bad.groupBy("task_id").agg(
        F.min(F.when(F.col("_trouble") != "still missing", F.struct("slot_pos", "_trouble", "slot_id"))).alias("_hard"),
        F.array_sort(F.collect_list(F.when(F.col("_trouble") == "still missing", F.col("slot_id")))).alias("_missing"),
    )
    problem = F.when(
        F.col("_hard").isNotNull(), F.concat(F.col("_hard._trouble"), F.lit(": "), F.col("_hard.slot_id"))
    ).otherwise(F.concat(F.lit("still missing: "), F.array_join("_missing", ", ")))
    refusals = per_task.select("task_id", problem.alias("problem"))
    ready = judged.join(refusals.select("task_id"), "task_id", "left_anti").withColumn(
        "override_artifact_id", F.when(status == "missing", F.col("override_artifact_id"))
    )
    return ready.withColumnRenamed("_style", "style_key").drop("_trouble"), refusals


def assemble(template: DataFrame, spans: DataFrame, render_slots: DataFrame) -> DataFrame:
    """The paragraphs a rendered document must have, with their positions.

    ``template`` is (task_id, idx, text, slot_id) where slot_id marks a placeholder;
    ``render_slots`` (task_id, slot_id, override_artifact_id); ``spans`` (task_id, slot_id,
    span_no, text). A placeholder becomes one paragraph per span, one empty paragraph when
    omitted, none when the slot is not rendered. Rows of the latter carry no position.
    """
    per_slot = spans.groupBy("task_id", "slot_id").agg(F.count("*").alias("_n"))
    filled = render_slots.select("task_id", "slot_id", "override_artifact_id", F.lit(True).alias("_ir")).join(
        per_slot, ["task_id", "slot_id"], "left"
    )
    sized = template.join(filled, ["task_id", "slot_id"], "left").withColumn(
        "n_expected",
        F.when(F.col("slot_id").isNull(), 1)
        .when(F.col("override_artifact_id").isNotNull(), 1)
        .otherwise(F.coalesce(F.col("_n"), F.lit(0)))
        .cast("bigint"),
    )
    before = Window.partitionBy("task_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("first_pos", F.coalesce(F.sum("n_expected").over(before), F.lit(0)).cast("bigint"))
    steps = F.when(F.col("n_expected") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("n_expected") - 1))
    rows = placed.select(
        "task_id", "idx", "slot_id", "text", "first_pos", "n_expected",
        F.coalesce(F.col("_ir"), F.lit(False)).alias("in_ir"),
        F.col("override_artifact_id").isNotNull().alias("omitted"),
        F.explode_outer(steps).alias("span_no"),
    )
    worded = rows.join(
        spans.select("task_id", "slot_id", "span_no", F.col("text").alias("_span_text")), ["task_id", "slot_id", "span_no"], "left"
    )
    text = F.when(F.col("slot_id").isNull(), F.col("text")).when(F.col("omitted"), F.lit("")).otherwise(F.col("_span_text"))
    return worded.select(
        "task_id", "idx", "slot_id", "span_no", "first_pos", "n_expected", "in_ir",
        (F.col("first_pos") + F.col("span_no")).alias("pos"),
        F.when(F.col("span_no").isNotNull(), text).alias("text"),
    )


def paragraph_diff(expected: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """Compare paragraphs by position; the comparison never realigns after a difference."""
    mine = expected.select(*keys, "pos", F.col("text").alias("_expected"), "slot_id")
    theirs = candidate.select(*keys, "pos", F.col("text").alias("_actual"))
    verdict = (
        F.when(F.col("_actual").isNull(), "ended")
        .when(F.col("_expected").isNull(), "extra")
        .when(F.col("_expected") == F.col("_actual"), "same")
        .when(F.col("slot_id").isNotNull(), "slot_mismatch")
        .otherwise("changed")
    )
    return mine.join(theirs, [*keys, "pos"], "full_outer").withColumn("verdict", verdict)


def document_diff(pairs: DataFrame, key: str) -> DataFrame:
    """The same comparison for whole texts on one row (key, expected, actual).

    Counts and first positions come from the two line arrays themselves, so the bodies
    are joined once and nothing but the verdicts moves on.
    """
    mine, theirs = F.split("expected", "\n"), F.split("actual", "\n")

    def verdict(i: Column) -> Column:
        a, b = F.get("_mine", i), F.get("_theirs", i)
        return F.when(b.isNull(), "ended").when(a.isNull(), "extra").when(a == b, "same").otherwise("changed")

    lined = pairs.select(key, mine.alias("_mine"), theirs.alias("_theirs"))
    steps = F.sequence(F.lit(0), F.greatest(F.size("_mine"), F.size("_theirs")) - 1)
    judged = lined.select(key, F.transform(steps, verdict).alias("_v"))

    def summary(name: str) -> Column:
        count = F.size(F.filter("_v", lambda v: v == name)).cast("bigint")
        return F.struct(F.lit(name).alias("verdict"), count.alias("n"), (F.array_position("_v", name) - 1).alias("first_pos"))

    found = F.filter(F.array(*[summary(v) for v in ("same", "changed", "ended", "extra")]), lambda s: s["n"] > 0)
    return judged.select(key, F.inline(found))


def sequence_problems(expected: DataFrame, candidate: DataFrame) -> DataFrame:
    """Problems of a candidate against what was expected, in the order a reader meets them."""
    sizes = candidate.groupBy("task_id").agg(F.count("*").alias("_n"))
    placed = expected.filter(F.col("pos").isNotNull())
    diff = paragraph_diff(placed, candidate, ["task_id"])
    pos = F.col("pos").cast("string")
    wrong = diff.filter(F.col("verdict").isin("changed", "slot_mismatch")).select(
        "task_id", F.col("pos").alias("at"), F.lit(0).alias("step"),
        F.when(F.col("slot_id").isNull(), F.concat(F.lit("static paragraph "), pos, F.lit(" changed")))
        .otherwise(F.concat(F.lit("slot "), F.col("slot_id"), F.lit(" paragraph "), pos, F.lit(" mismatch")))
        .alias("message"),
    )
    # A task without a candidate paragraph has none of what was expected.
    units = expected.filter(F.coalesce(F.col("span_no"), F.lit(0)) == 0).join(sizes, "task_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    first, n = F.col("first_pos"), F.col("_n")
    unfilled = units.filter(F.col("slot_id").isNotNull() & ~F.col("in_ir") & (first < n)).select(
        "task_id", first.alias("at"), F.lit(1).alias("step"),
        F.concat(F.lit("placeholder of "), F.col("slot_id"), F.lit(" was not rendered")).alias("message"),
    )
    inside = units.filter(F.col("slot_id").isNotNull() & (first < n) & (first + F.col("n_expected") > n)).select(
        "task_id", n.alias("at"), F.lit(2).alias("step"),
        F.concat(F.lit("candidate ends within slot "), F.col("slot_id")).alias("message"),
    )
    unread = units.filter(first >= n).groupBy("task_id").agg(F.min("_n").alias("at"), F.min("idx").alias("_idx")).select(
        "task_id", "at", F.lit(3).alias("step"),
        F.concat(F.lit("template left over from paragraph "), F.col("_idx").cast("string")).alias("message"),
    )
    extra = diff.filter(F.col("verdict") == "extra").groupBy("task_id").agg(F.min("pos").alias("at"), F.count("*").alias("_x")).select(
        "task_id", "at", F.lit(4).alias("step"),
        F.concat(F.lit("candidate has "), F.col("_x").cast("string"), F.lit(" more paragraph(s) than expected")).alias("message"),
    )
    return union_all([wrong, unfilled, inside, unread, extra])


def part_problems(template_parts: DataFrame, candidate_parts: DataFrame) -> DataFrame:
    """Header and footer parts (task_id, part, text): equal text, and no new parts."""
    mine = template_parts.select("task_id", "part", F.col("text").alias("_expected"))
    theirs = candidate_parts.select("task_id", "part", F.col("text").alias("_actual"))
    message = F.when(
        F.col("_expected").isNull(), F.concat(F.lit("part not in template: "), F.col("part"))
    ).otherwise(F.concat(F.lit("part "), F.col("part"), F.lit(" is not the template's text")))
    joined = mine.join(theirs, ["task_id", "part"], "full_outer")
    return joined.filter(~F.col("_expected").eqNullSafe(F.col("_actual"))).select("task_id", "part", message.alias("message"))


def placements(expected: DataFrame, candidate: DataFrame) -> DataFrame:
    """How many paragraphs of each rendered slot the candidate has room for."""
    sizes = candidate.groupBy("task_id").agg(F.count("*").alias("_n"))
    slots = expected.filter(F.col("slot_id").isNotNull() & F.col("in_ir")).join(sizes, "task_id", "left")
    return slots.groupBy("task_id", "slot_id").agg(
        F.count_if(F.col("pos") < F.coalesce(F.col("_n"), F.lit(0))).alias("found"),
        F.count("pos").alias("expected"),
        F.min(F.when(F.col("pos") < F.col("_n"), F.col("pos"))).alias("first_found"),
        F.max(F.when(F.col("pos") < F.col("_n"), F.col("pos"))).alias("last_found"),
    )


def residue(paragraphs: DataFrame, parts: DataFrame) -> DataFrame:
    """The first place of each document that still holds template syntax.

    Its ``paragraphs`` (task_id, pos, text) come first, then its headers and footers ``parts``
    (task_id, part, text) by name.
    """
    body = paragraphs.select("task_id", F.lit(0).alias("_rank"), F.lit("document").alias("part"), F.col("pos").cast("bigint").alias("pos"), "text")
    rest = parts.select("task_id", F.lit(1).alias("_rank"), "part", F.lit(0).cast("bigint").alias("pos"), "text")
    rows = body.unionByName(rest)
    left = rows.filter(F.col("text").contains("{{") | F.col("text").contains("{%"))
    return first_rows(left, ["task_id"], [F.col("_rank"), F.col("part"), F.col("pos")], ["part", "pos", "text"])


def anchor_problems(placed: DataFrame, candidate: DataFrame, anchors: DataFrame) -> DataFrame:
    """Located slots whose first paragraph lost its bookmark (name or id)."""
    first = placed.filter(F.col("first_found").isNotNull()).select("task_id", "slot_id", F.col("first_found").alias("pos"))
    wanted = first.join(anchors.select("task_id", "slot_id", "bookmark_id"), ["task_id", "slot_id"])
    marked = wanted.join(candidate.select("task_id", "pos", "bookmarks"), ["task_id", "pos"], "left")
    held = F.coalesce(F.array_contains("bookmarks", F.col("bookmark_id")), F.lit(False))
    return marked.filter(~held).select(
        "task_id", "slot_id",
        F.concat(F.col("slot_id"), F.lit(": anchor "), F.col("bookmark_id"), F.lit(" missing on output")).alias("message"),
    )


def region_digests(paragraphs: DataFrame, members: DataFrame) -> DataFrame:
    """Digest and token count of static regions.

    ``paragraphs`` is (doc, idx, tokens), ``members`` (doc, region_id, idx). A region's
    paragraphs are joined in order and hashed as they pass, whatever a region's size; a
    region lies within one document part.
    """
    stream = tk.digest_stream(F.col("tokens"))
    owned = members.join(paragraphs, ["doc", "idx"])
    digests = ordered_digests(owned, ["doc", "region_id"], [F.col("idx"), stream], stream, tk.PARAGRAPH_SEP, F.size("tokens"))
    return digests.select("doc", "region_id", F.col("digest").alias("text_sha256"), F.col("total").alias("token_count"))


def region_problems(recomputed: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recomputed region digests (task_id, region_id, text_sha256) against the contract's."""
    held = recorded.select("task_id", "region_id", F.col("text_sha256").alias("_held"))
    name = F.concat(F.lit("region "), F.col("region_id"))
    message = F.when(F.col("_held").isNull(), F.concat(name, F.lit(" is not in the contract"))).otherwise(
        F.concat(name, F.lit(" has another digest"))
    )
    joined = recomputed.join(held, ["task_id", "region_id"], "left")
    return joined.filter(~F.col("text_sha256").eqNullSafe(F.col("_held"))).select("task_id", "region_id", message.alias("message"))


# Gate A: before rendering


def unequal(a: Column, b: Column) -> Column:
    """Differing, or not known on either side: what is not known does not pass."""
    return ~F.coalesce(a == b, F.lit(False))


def scope_problems(ir_spans: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Spans of artifacts that are unknown, another task's, or whose text has moved on; a hash
    that either side lacks counts as moved on."""
    held = artifacts.select("artifact_id", F.col("task_id").alias("_owner"), F.col("sha256").alias("_sha"))
    joined = ir_spans.join(held, "artifact_id", "left")
    name = F.coalesce("artifact_id", F.lit("-"))
    message = (
        F.when(F.col("_owner").isNull(), F.concat(name, F.lit(": not registered")))
        .when(unequal(F.col("_owner"), F.col("task_id")), F.concat(name, F.lit(": held by task "), F.col("_owner")))
        .when(unequal(F.col("_sha"), F.col("canonical_sha256")), F.concat(name, F.lit(": text has changed")))
    )
    return joined.withColumn("message", message).filter(F.col("message").isNotNull()).select(
        "task_id", "slot_id", "span_no", "message"
    )


def span_problems(ir_spans: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Spans that do not verify against the text, or that hold control characters. What has no
    text, hash or place to verify does not."""
    held = artifacts.select(
        "artifact_id", F.col("text").alias("_text"), F.col("sha256").alias("_registered"),
        sha(F.col("text")).alias("_actual"),
    )
    piece = tx.slice_points(F.col("_text"), F.col("span_start"), F.col("span_end"))
    joined = ir_spans.join(held, "artifact_id").withColumn("_piece", piece)
    end = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    place = F.concat(F.lit("["), end("span_start"), F.lit(","), end("span_end"), F.lit(")"))
    tampered = unequal(F.col("_actual"), F.col("_registered"))
    moved = unequal(F.col("_actual"), F.col("canonical_sha256"))
    sound = ~tampered & ~moved
    found = F.array_compact(
        F.array(
            F.when(tampered, F.concat(F.col("artifact_id"), F.lit(": stored text differs from its hash"))),
            F.when(~tampered & moved, F.concat(F.col("artifact_id"), F.lit(": hash differs from the bound one"))),
            F.when(sound & unequal(sha(F.col("_piece")), F.col("span_sha256")), F.concat(place, F.lit(": span text has changed"))),
            F.when(sound & F.col("_piece").rlike(tx.CONTROLS), F.concat(place, F.lit(": holds control characters"))),
        )
    )
    return joined.select("task_id", "slot_id", "span_no", F.explode(found).alias("message"))


def coverage_problems(ir_regions: DataFrame, contract_regions: DataFrame, irs: DataFrame) -> DataFrame:
    """Static refs (task_id, template_version_id, region_id, ref_version) against the contract.

    ``irs`` is (task_id, template_version_id): one that names no region at all covers none.
    """
    foreign = ir_regions.filter(F.col("ref_version") != F.col("template_version_id")).select(
        "task_id", F.lit(0).alias("kind"), F.col("region_id"),
        F.concat(F.lit("region "), F.col("region_id"), F.lit(": of another template version")).alias("message"),
    )
    plans = irs.select("task_id", "template_version_id").unionByName(ir_regions.select("task_id", "template_version_id")).distinct()
    wanted = plans.join(contract_regions.select("template_version_id", "region_id"), "template_version_id").withColumn("_c", F.lit(True))
    seen = ir_regions.select("task_id", "template_version_id", "region_id").withColumn("_i", F.lit(True))
    both = wanted.join(seen, ["task_id", "template_version_id", "region_id"], "full_outer")
    uneven = both.filter(F.col("_c").isNull() | F.col("_i").isNull()).select(
        "task_id", F.when(F.col("_i").isNull(), 1).otherwise(2).alias("kind"), "region_id",
        F.concat(
            F.when(F.col("_i").isNull(), F.lit("region left out: ")).otherwise(F.lit("region not in contract: ")), F.col("region_id")
        ).alias("message"),
    )
    return foreign.unionByName(uneven)


def override_problems(ir_slots: DataFrame, tasks: DataFrame, overrides: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Omitted slots: a recorded omission of this epoch, and an artifact of this task.

    All omitted slots come back, with a NULL message when nothing is wrong.
    """
    omitted = ir_slots.filter(F.col("override_artifact_id").isNotNull()).select("task_id", "slot_id", "override_artifact_id")
    active = overrides.select("task_id", "epoch", "slot_id", F.lit(True).alias("_active"))
    held = artifacts.select(F.col("artifact_id").alias("override_artifact_id"), F.col("task_id").alias("_owner"))
    joined = (
        omitted.join(tasks.select("task_id", "epoch"), "task_id")
        .join(active, ["task_id", "epoch", "slot_id"], "left")
        .join(held, "override_artifact_id", "left")
    )
    message = (
        F.when(F.col("_active").isNull(), F.lit("no omission recorded in this epoch"))
        .when(F.col("_owner").isNull(), F.lit("omission artifact unknown"))
        .when(F.col("_owner") != F.col("task_id"), F.concat(F.lit("omission artifact held by "), F.col("_owner")))
    )
    return joined.select("task_id", "slot_id", message.alias("message"))


def per_slot_findings(slots: DataFrame, problems: DataFrame, check: str) -> DataFrame:
    messages = listed_messages(problems, ["task_id", "slot_id"], "span_no", "message", SHOWN)
    joined = slots.join(messages, ["task_id", "slot_id"], "left")
    return finding(
        joined, GATE_A, F.concat(F.lit(check + ":"), F.col("slot_id")), F.col("messages"),
        locator=F.concat(F.lit("slot "), F.col("slot_id")),
    )


def gate_a(
    tasks: DataFrame, irs: DataFrame, ir_slots: DataFrame, ir_spans: DataFrame, ir_regions: DataFrame,
    contract_regions: DataFrame, artifacts: DataFrame, overrides: DataFrame,
) -> DataFrame:
    """All checks before rendering.

    ``irs`` is (task_id, ir_version, ir_epoch, binding_version_id, binding_epoch,
    binding_digest, registered, docx_matches, viz_slots), one row per task to render.
    """
    base = irs.join(tasks.select("task_id", "epoch", "template_version_id"), "task_id")
    mine, target, no = F.col("template_version_id"), F.col("ir_version"), F.lit(False)

    def shown(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit("-"))

    identity = (
        F.when(unequal(mine, target), F.concat(F.lit("task bound to "), shown(mine), F.lit(", IR targets "), shown(target)))
        .when(
            unequal(F.col("binding_version_id"), target),
            F.concat(F.lit("binding targets "), shown(F.col("binding_version_id")), F.lit(", IR targets "), shown(target)),
        )
        .when(~F.coalesce("registered", no), F.concat(F.lit("template version "), target, F.lit(" not registered")))
        .when(~F.coalesce("docx_matches", no), F.lit("contract docx hash differs from the registered template version"))
    )
    epochs = F.concat(F.lit("ir="), shown(F.col("ir_epoch")), F.lit(", binding="), shown(F.col("binding_epoch")))
    out_of_step = unequal(F.col("epoch"), F.col("ir_epoch")) | unequal(F.col("epoch"), F.col("binding_epoch"))
    live = mat.set_digests(artifacts)
    # A task without materials holds the empty set, which has a digest too.
    fresh = base.join(live, "task_id", "left").withColumn("set_digest", F.coalesce("set_digest", mat.empty_set_digest()))
    head = F.substr(F.col("set_digest"), F.lit(1), F.lit(12))
    stale = F.when(unequal(F.col("set_digest"), F.col("binding_digest")), head)
    coverage = listed_messages(coverage_problems(ir_regions, contract_regions, base), ["task_id"], "kind", "message", SHOWN)
    viz = F.when(F.size("viz_slots") > 0, F.concat(F.lit("viz producers: "), F.array_join(F.array_sort("viz_slots"), ", ")))
    with_spans = ir_spans.select("task_id", "slot_id").distinct()
    omissions = override_problems(ir_slots, tasks, overrides, artifacts)
    return union_all(
        [
            finding(base, GATE_A, F.lit("template_identity"), identity, locator=F.lit("task/ir/binding/contract")),
            finding(
                base, GATE_A, F.lit("epoch_match"), F.when(out_of_step, epochs),
                expected=F.concat(F.lit("epoch "), shown(F.col("epoch"))), actual=epochs,
            ),
            per_slot_findings(ir_slots.select("task_id", "slot_id"), scope_problems(ir_spans, artifacts), "scope"),
            per_slot_findings(with_spans, span_problems(ir_spans, artifacts), "spans"),
            finding(
                fresh, GATE_A, F.lit("binding_freshness"), stale,
                expected=F.substr(F.col("binding_digest"), F.lit(1), F.lit(12)), actual=head,
            ),
            finding(base.join(coverage, "task_id", "left"), GATE_A, F.lit("static_regions"), F.col("messages")),
            finding(
                omissions, GATE_A, F.concat(F.lit("override:"), F.col("slot_id")), F.col("message"),
                locator=F.concat(F.lit("slot "), F.col("slot_id")),
            ),
            finding(base, GATE_A, F.lit("producer_profile"), viz),
        ]
    )


# Gate B: after rendering


def gate_b(
    irs: DataFrame, expected: DataFrame, candidate: DataFrame, template_parts: DataFrame, candidate_parts: DataFrame,
    anchors: DataFrame, unsupported: DataFrame, recomputed: DataFrame, recorded: DataFrame,
) -> DataFrame:
    """All checks of a rendered candidate: sequence, placement, residue, anchors, regions."""
    tasks = irs.select("task_id")
    parts = part_problems(template_parts, candidate_parts).select(
        "task_id", F.lit(None).cast("bigint").alias("at"), F.lit(5).alias("step"), "message", "part"
    )
    sequence = sequence_problems(expected, candidate).withColumn("part", F.lit("")).unionByName(parts)
    far = F.lit((1 << 62)).cast("bigint")
    ordered = sequence.withColumn("_order", F.struct(F.coalesce("at", far), F.col("step"), F.col("part")))
    placed = placements(expected, candidate)
    lost = anchor_problems(placed, candidate, anchors)
    drift = region_problems(recomputed, recorded)

    def first_five(problems: DataFrame, order: str) -> DataFrame:
        return tasks.join(listed_messages(problems, ["task_id"], order, "message", 5), "task_id", "left")

    left = tasks.join(residue(candidate, candidate_parts), "task_id", "left")
    place = F.concat(F.lit("paragraphs "), F.col("first_found").cast("string"), F.lit(" to "), F.col("last_found").cast("string"))
    listed = unsupported.withColumn("message", F.concat_ws("@", "code", "locator"))
    return union_all(
        [
            finding(first_five(ordered, "_order"), GATE_B, F.lit("content_sequence"), F.col("messages"), locator=F.lit("document")),
            finding(
                placed, GATE_B, F.concat(F.lit("slot_placement:"), F.col("slot_id")),
                F.when(F.col("found") != F.col("expected"), F.col("found").cast("string")),
                expected=F.concat(F.col("expected").cast("string"), F.lit(" paragraph(s)")), actual=F.col("found").cast("string"),
                locator=F.coalesce(place, F.lit("no paragraph")),
            ),
            finding(
                left, GATE_B, F.lit("placeholder_residue"),
                F.when(F.col("text").isNotNull(), F.concat(F.col("part"), F.lit(":"), F.substr(F.col("text"), F.lit(1), F.lit(50)))),
            ),
            finding(first_five(listed, "code"), GATE_B, F.lit("unsupported_containers"), F.col("messages")),
            finding(first_five(lost, "slot_id"), GATE_B, F.lit("anchors"), F.col("messages")),
            finding(first_five(drift, "region_id"), GATE_B, F.lit("static_region_integrity"), F.col("messages")),
        ]
    )


# Delivery


def subject_problems(irs: DataFrame, reports: DataFrame) -> DataFrame:
    """Required gate reports that are missing, not passed, or about something else.

    ``irs`` is (task_id, render_ir_sha256, ir_version, candidate_sha256), ``reports``
    (task_id, gate, overall_status, render_ir_sha256, template_version_id, candidate_sha256).
    A digest or version that either side lacks counts as another one.
    """
    wanted = irs.select(
        "task_id", F.col("render_ir_sha256").alias("_ir"), "ir_version", F.col("candidate_sha256").alias("_candidate"),
        F.posexplode(F.array(*[F.lit(g) for g in REQUIRED_GATES])).alias("gate_no", "gate"),
    )
    joined = wanted.join(reports, ["task_id", "gate"], "left")
    absent = F.col("overall_status").isNull()

    def say(condition: Column, what: Column) -> Column:
        return F.when(condition, F.concat(F.col("gate"), F.lit(": "), what))

    found = F.array_compact(
        F.array(
            say(absent, F.lit("report missing")),
            say(~absent & (F.col("overall_status") != "pass"), F.col("overall_status")),
            say(~absent & unequal(F.col("render_ir_sha256"), F.col("_ir")), F.lit("judged another rendering plan")),
            say(~absent & unequal(F.col("template_version_id"), F.col("ir_version")), F.lit("judged another template version")),
            say(
                ~absent & (F.col("gate") != GATE_A) & unequal(F.col("candidate_sha256"), F.col("_candidate")),
                F.lit("judged another output"),
            ),
        )
    )
    return joined.select("task_id", "gate_no", "gate", F.posexplode(found).alias("problem_no", "problem"))


def finalize(tasks: DataFrame, irs: DataFrame, reports: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Per task: delivered now, already delivered, or why not. A task is delivered once, and
    only if its epoch and template version are known to be those of its plan."""
    problems = subject_problems(irs, reports).withColumn("_order", F.struct("gate_no", "problem_no"))
    gates = listed_messages(problems, ["task_id"], "_order", "problem", 5 * len(REQUIRED_GATES))
    done = deliveries.select("task_id", F.col("delivery_id").alias("_done"))
    joined = (
        irs.join(tasks.select("task_id", "status", "epoch", "template_version_id"), "task_id", "left")
        .join(gates, "task_id", "left")
        .join(done, "task_id", "left")
    )
    outcome = (
        F.when(F.col("status").isNull(), "task_vanished")
        .when(F.col("status") == "cancelled", "cancelled")
        .when(unequal(F.col("epoch"), F.col("ir_epoch")), "stale_ir")
        .when(unequal(F.col("template_version_id"), F.col("ir_version")), "template_changed")
        .when(F.col("messages").isNotNull(), "gates_failed")
        .when(F.col("_done").isNotNull(), "already_delivered")
        .otherwise("delivered")
    )
    delivered = F.col("outcome").isin("delivered", "already_delivered")
    digest = payload_digest(F.col("candidate_sha256"), F.col("render_ir_sha256"))
    key = operation_key(F.col("task_id"), F.col("ir_epoch"), F.lit("finalize"), digest, F.lit(IMPLEMENTATION))
    return joined.withColumn("outcome", outcome).select(
        "task_id", "outcome",
        F.when(F.col("outcome") == "gates_failed", F.col("messages")).alias("gate_problems"),
        F.when(delivered, F.coalesce(F.col("_done"), stable_id("dlv", key))).alias("delivery_id"),
    )


#: Form of a manifest (fixed value).
MANIFEST_VERSION = 1


def manifests(
    delivered: DataFrame, irs: DataFrame, tasks: DataFrame, materials: DataFrame, reports: DataFrame, overrides: DataFrame,
    versions: DataFrame, operations: DataFrame,
) -> DataFrame:
    """One manifest per delivered task; its parts as columns and as JSON.

    A manifest names every material of its task (artifact_id, sha256, kind), every gate report
    with the rules it was judged by, the template version with the hashes of its files
    (template_version_id, template_id, version, hashes) and the operations that led to the
    delivery (task_id, operation_id), however many there are.
    """

    def named(rows: DataFrame, name: str, *fields: str) -> DataFrame:
        return rows.groupBy("task_id").agg(F.array_sort(F.collect_set(F.struct(*fields))).alias(name))

    held = versions.select("template_version_id", F.struct("template_id", "version", "template_version_id", "hashes").alias("template"))
    done = operations.groupBy("task_id").agg(F.array_sort(F.collect_set("operation_id")).alias("operation_ids"))
    whole = (
        delivered.filter(F.col("delivery_id").isNotNull()).select("task_id", "delivery_id")
        .join(irs.select("task_id", "render_ir_sha256", "candidate_sha256"), "task_id")
        .join(tasks.select("task_id", "epoch", "template_version_id"), "task_id")
        .join(held, "template_version_id", "left")
        .join(named(materials, "materials", "artifact_id", "sha256", "kind"), "task_id", "left")
        .join(named(reports, "gates", "gate", "overall_status", "rule_version"), "task_id", "left")
        .join(named(overrides, "overrides", "slot_id", "decision_id"), "task_id", "left")
        .join(done, "task_id", "left")
        .withColumn("schema_version", F.lit(MANIFEST_VERSION))
        .withColumn("implementation", F.lit(IMPLEMENTATION))
    )
    return whole.withColumn("manifest", F.to_json(F.struct(*[F.col(c) for c in sorted(whole.columns)])))
