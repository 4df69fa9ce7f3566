"""Binding, plans, gates and styles: one defect, one finding."""

from __future__ import annotations

import hashlib
import random

import pytest

from provena.functions import checks
from provena.operators import binding, findings, gates, planning, styling
from provena.operators import evaluation
from pyspark.sql import functions as F

SLOTS = (
    "template_version_id string, slot_id string, slot_pos int, placeholder string, kind string, required boolean, "
    "allow_user_omit boolean, semantic_requirement string, style_key string, markers array<string>"
)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slots(spark):
    rows = [("v", name, i, "{{ %s }}" % name, "text_block", True, name == "risks", f"about {mark}", "body", [mark])
            for i, (name, mark) in enumerate((("sales", "Sales"), ("risks", "Risk")))]
    return spark.createDataFrame(rows, SLOTS)


def test_auto_bind_follows_the_rules(spark):
    texts = {
        "m1": "# Sales\n# Other\nbody",             # first marked section is empty: the next material is tried
        "m2": "intro\n# Sales now\nline é\n\n# Risk",  # a heading on the last line binds nothing
        "m3": "# Sales\nlate\n## Risk\nr1\nr2",
    }
    materials = spark.createDataFrame([("t", "v", k, i, x) for i, (k, x) in enumerate(texts.items())],
                                      "task_id string, template_version_id string, artifact_id string, created_at bigint, text string")
    tasks = spark.createDataFrame([(0, "t", 1, "v"), (1, "empty", 1, "v")], "task_no bigint, task_id string, epoch int, template_version_id string")
    got = {(r.task_id, r.slot_id): r for r in binding.auto_bind(tasks, materials, slots(spark)).collect()}
    sales, risks = got["t", "sales"], got["t", "risks"]
    assert (sales.artifact_id, texts["m2"][sales.span_start:sales.span_end]) == ("m2", "line é\n\n")
    assert sales.span_sha256 == sha("line é\n\n")
    assert (risks.artifact_id, texts["m3"][risks.span_start:risks.span_end]) == ("m3", "r1\nr2")
    assert got["empty", "sales"].reason_code == "no_material"
    missing = binding.gaps(tasks, slots(spark), binding.auto_bind(tasks, materials, slots(spark)),
                           spark.createDataFrame([("empty", 1, "risks")], "task_id string, epoch int, slot_id string")).collect()
    assert [(r.task_id, r.slot_id) for r in missing] == [("empty", "sales")]


@pytest.mark.parametrize(
    "slot, plan, outcome",
    [
        ({}, {}, "committed"),
        ({}, None, "committed"),
        ({}, {"plan_task_id": "u"}, "plan_of_another_task"),
        ({}, {"plan_task_id": None}, "plan_of_another_task"),
        ({}, {"plan_version_id": "w"}, "plan_of_another_version"),
        ({}, {"slot_id": "annex"}, "plan_slot_unknown"),
        ({}, {"slot_id": None}, "committed"),
        ({"slot_id": "annex"}, {"slot_id": "annex"}, "plan_slot_unknown"),
        ({"slot_id": "annex"}, {}, "unknown_slot"),
        ({"binding_status": "bound"}, {}, "ref_rejected"),
        ({"reason_code": "unsure"}, {}, "unknown_reason"),
        ({"reason_code": None}, {}, "unknown_reason"),
        ({"binding_status": "invalid"}, {}, "no_error_code"),
        ({"binding_status": "invalid", "error_code": ""}, {}, "no_error_code"),
        ({"binding_status": "invalid", "error_code": "E1"}, {}, "committed"),
        ({"proposal_epoch": 2, "reason_code": None}, {"plan_task_id": "u"}, "stale_epoch"),
    ],
)
def test_a_commit_is_guarded(spark, slot, plan, outcome):
    one = {"task_id": "t", "proposal_epoch": 1, "slot_id": "sales", "binding_status": "missing", "reason_code": "ambiguous", "error_code": None,
           "artifact_id": None, "span_start": None, "span_end": None, "canonical_sha256": None, "span_sha256": None, **slot}
    proposals = spark.createDataFrame([tuple(one.values())], "task_id string, proposal_epoch int, slot_id string, binding_status string, reason_code string, "
                                      "error_code string, artifact_id string, span_start bigint, span_end bigint, canonical_sha256 string, span_sha256 string")
    its = {"task_id": "t", "plan_task_id": "t", "plan_version_id": "v", "slot_id": "risks", **(plan or {})}
    plans = spark.createDataFrame([] if plan is None else [tuple(its.values())], "task_id string, plan_task_id string, plan_version_id string, slot_id string")
    tasks = spark.createDataFrame([("t", "running", 1, "v")], "task_id string, status string, epoch int, template_version_id string")
    prior = spark.createDataFrame([("t", 1, 4)], "task_id string, epoch int, binding_version int")
    materials = spark.createDataFrame([], "task_id string, artifact_id string, text string")
    row = binding.commit(tasks, proposals, materials, slots(spark), prior, plans).first()
    assert row.outcome == outcome
    if outcome == "committed":
        assert (row.binding_version, row.slots, row.bound, row.set_digest) == (5, 2, 0, sha(""))
        assert row.missing + row.invalid == 2


@pytest.mark.parametrize(
    "edges, cycle",
    [({"sales": ["risks"], "risks": ["sales"]}, "sales -> risks -> sales"), ({"risks": ["risks"]}, "risks -> risks"),
     ({"a": ["b", "c"], "b": ["d"], "c": ["d"], "d": []}, None), ({"a": ["x"], "b": ["c"], "c": ["b"]}, "b -> c -> b")],
)
def test_dependency_cycles(spark, edges, cycle):
    rows = [("t", i, s, d) for i, (s, d) in enumerate(edges.items())]
    plan = spark.createDataFrame(rows, "task_id string, plan_pos int, slot_id string, depends_on array<string>")
    assert [r.cycle for r in planning.dependency_cycles(plan).collect()] == ([cycle] if cycle else [])


def first_cycle(names, deps):
    """The cycle a walk in order meets first, told by recursion."""
    done = set()

    def visit(node, trail):
        if node in trail:
            return [*trail[trail.index(node) :], node]
        if node in done or node not in deps:
            return None
        for dep in deps[node]:
            if found := visit(dep, [*trail, node]):
                return found
        done.add(node)

    return next((" -> ".join(c) for n in names if (c := visit(n, []))), None)


def test_first_cycles_of_random_plans(spark):
    pick = random.Random(5)
    rows, want = [], {}
    for t in range(150):
        names = [f"s{i}" for i in range(pick.randint(1, 9))]
        deps = {n: pick.sample([*names, "ghost"], min(len(names), pick.choice([0, 0, 1, 1, 2, 3]))) for n in names}
        rows += [(str(t), i, n, deps[n]) for i, n in enumerate(names)]
        want[str(t)] = first_cycle(names, deps)
    rows += [("null", 0, "a", None), ("twice", 0, "a", ["b"]), ("twice", 1, "b", ["a"]), ("twice", 2, "a", [])]
    plan = spark.createDataFrame(rows, "task_id string, plan_pos int, slot_id string, depends_on array<string>")
    got = {r.task_id: r.cycle for r in planning.dependency_cycles(plan).collect()}
    assert got == {t: c for t, c in want.items() if c} and len(got) > 20
    assert planning.dependency_cycles(plan.limit(0)).count() == 0


def test_oversized_plan_is_walked_to_its_end(spark):
    size = 1500
    deps = F.when(F.col("id") == size - 1, F.array(F.lit("9"))).otherwise(F.array((F.col("id") + 1).cast("string")))
    plan = spark.range(size).select(F.lit("t").alias("task_id"), F.col("id").alias("plan_pos"), F.col("id").cast("string").alias("slot_id"), deps.alias("depends_on"))
    cycle = planning.dependency_cycles(plan).first().cycle.split(" -> ")
    assert cycle[0] == cycle[-1] == "9" and len(cycle) == size - 9 + 1


def test_a_repeated_style_counts_once(spark):
    fields = {**dict.fromkeys(styling.FIELDS, None)}
    rows = [("t", "a", "b", True, *fields.values()), ("t", "a", "b", True, *fields.values()), ("t", "b", None, False, *fields.values())]
    schema = "task_id string, style_id string, based_on string, is_default boolean, " + ", ".join(f"{f} {t}" for f, t in styling.FIELDS.items())
    got = {r.anchor: r.path for r in styling.chains(spark.createDataFrame(rows, schema), paths=True).collect()}
    assert got == {"a": ["a", "b"], "b": ["b"]}


def walked(defs, anchor):
    """A chain followed style by style: its styles, what they set first, and how it ends."""
    path, current = [], anchor
    while current is not None:
        if current in path:
            return path, f"basedOn cycle at {current}"
        if current not in defs:
            return path, f"style not found: {current}"
        path.append(current)
        current = defs[current][0]
    return path, None


def test_long_chains_cycles_and_equal_parts(spark):
    schema = "task_id string, style_id string, based_on string, is_default boolean, def_pos int, " + ", ".join(f"{f} {t}" for f, t in styling.FIELDS.items())
    defs = {f"s{i}": (f"s{i + 1}" if i < 4999 else None, str(i) if i % 701 == 700 else None) for i in range(5000)}
    odd = {"a": ("b", "1"), "b": ("c", None), "c": ("d", "3"), "d": ("b", None), "e": ("e", None), "f": ("gone", "6"), "g": ("f", None), "h": (None, None)}
    none = dict.fromkeys(styling.FIELDS)
    make = lambda task, own: [(task, s, base, s == "h", 0, *{**none, "size": size}.values()) for s, (base, size) in own.items()]
    again = [("odd1", "h", "a", False, 1, *none.values())]  # a later definition counts for nothing
    rows = make("long", defs) + make("odd1", odd) + make("odd2", odd) + again
    got = {(r.task_id, r.anchor): r for r in styling.chains(spark.createDataFrame(rows, schema), paths=False).collect()}
    assert len(got) == 5000 + 2 * len(odd)
    for task, own in (("long", defs), ("odd1", odd), ("odd2", odd)):
        for anchor in own if len(own) < 100 else ["s0", "s1", "s700", "s701", "s4999", "s2500"]:
            path, note = walked(own, anchor)
            size = next((own[s][1] for s in path if own[s][1] is not None), None)
            assert (got[task, anchor].note, got[task, anchor].levels[0].size) == (note, size), (task, anchor)
            assert got[task, anchor].is_default is (None if task == "long" else anchor == "h")
    some = spark.createDataFrame([r for r in rows if r[0] == "odd2"], schema)
    assert {r.anchor: r.path for r in styling.chains(some, paths=True).collect()} == {s: walked(odd, s)[0] for s in odd}
    assert styling.chains(some.limit(0)).count() == 0


def test_the_first_run_with_text_gives_the_direct_formatting(spark):
    paragraphs = spark.createDataFrame([(1, "own", "left"), (2, "own", None), (3, "own", None), (4, "own", None)], "id long, font_latin string, jc string")
    runs = [(1, 0, "", "skipped"), (1, 1, "text", "A"), (1, 2, "more", "A"), (2, 5, "x", "B"), (2, 2, "y", None), (3, 0, None, "C")]
    df = styling.with_text_runs(paragraphs, spark.createDataFrame(runs, "id long, run_no int, text string, font_latin string"), ["id"])
    got = {r.id: (r.font_latin, r.jc, r.run_note is not None) for r in df.collect()}
    assert got == {1: ("A", "left", False), 2: (None, None, True), 3: (None, None, False), 4: (None, None, False)}


def documents(spark, candidate):
    template = [("t", 0, "Title", None), ("t", 1, "{{ sales }}", "sales"), ("t", 2, "Mid", None), ("t", 3, "{{ risks }}", "risks"), ("t", 4, "End", None)]
    tpl = spark.createDataFrame(template, "task_id string, idx bigint, text string, slot_id string")
    spans = spark.createDataFrame([("t", "sales", 0, "one"), ("t", "sales", 1, "two")], "task_id string, slot_id string, span_no bigint, text string")
    ir = spark.createDataFrame([("t", "sales", None), ("t", "risks", "art_x")], "task_id string, slot_id string, override_artifact_id string")
    have = spark.createDataFrame([("t", i, x, []) for i, x in enumerate(candidate)], "task_id string, pos bigint, text string, bookmarks array<string>")
    return gates.assemble(tpl, spans, ir), have


WHOLE = ["Title", "one", "two", "Mid", "", "End"]


@pytest.mark.parametrize(
    "candidate, messages",
    [
        (WHOLE, []),
        (WHOLE + ["more"], ["candidate has 1 more paragraph(s) than expected"]),
        (WHOLE[:-1], ["template left over from paragraph 4"]),
        (WHOLE[:2], ["candidate ends within slot sales", "template left over from paragraph 2"]),
        (["Title", "one", "2", "Mid", "", "end"], ["slot sales paragraph 2 mismatch", "static paragraph 5 changed"]),
    ],
)
def test_output_sequence(spark, candidate, messages):
    want, have = documents(spark, candidate)
    rows = gates.sequence_problems(want, have).orderBy("at", "step").collect()
    assert [r.message for r in rows] == messages


def test_unrendered_slot_has_no_paragraph(spark):
    template = spark.createDataFrame([("t", 0, "{{ sales }}", "sales"), ("t", 1, "End", None)], "task_id string, idx bigint, text string, slot_id string")
    spans = spark.createDataFrame([], "task_id string, slot_id string, span_no bigint, text string")
    ir = spark.createDataFrame([], "task_id string, slot_id string, override_artifact_id string")
    have = spark.createDataFrame([("t", 0, "End")], "task_id string, pos bigint, text string")
    rows = gates.sequence_problems(gates.assemble(template, spans, ir), have).collect()
    assert [r.message for r in rows] == ["placeholder of sales was not rendered"]


def test_span_problems_see_controls_and_tampering(spark):
    texts = {"a": "ok\x07bell", "b": "plain", "c": "changed"}
    artifacts = spark.createDataFrame([(k, "t", v, sha("before" if k == "c" else v)) for k, v in texts.items()], "artifact_id string, task_id string, text string, sha256 string")
    rows = [("t", "s", i, k, 0, len(v), sha(v), sha(v)) for i, (k, v) in enumerate(texts.items())] + [("t", "s", 3, "b", 0, 2, sha("plain"), sha("x"))]
    ir = spark.createDataFrame(rows, "task_id string, slot_id string, span_no int, artifact_id string, span_start bigint, span_end bigint, canonical_sha256 string, span_sha256 string")
    got = {(r.span_no, r.message) for r in gates.span_problems(ir, artifacts).collect()}
    assert got == {(0, "[0,7): holds control characters"), (2, "c: stored text differs from its hash"), (3, "[0,2): span text has changed")}


def test_overall_status_looks_at_required_checks(spark):
    rows = [("g", "a", "pass", True), ("g", "a", "fail", False), ("g", "b", "unknown", True), ("g", "b", "pass", True), ("g", "c", "unknown", True), ("g", "c", "fail", True)]
    frame = spark.createDataFrame(rows, "gate string, task_id string, status string, required boolean")
    assert {r.task_id: r.overall_status for r in findings.overall(frame).collect()} == {"a": "pass", "b": "unknown", "c": "fail"}


def styled(spark, direct=None, style="Body", numbering=(("3", [0, 1]),)):
    def row(**values):
        return {f: values.get(f) for f in styling.FIELDS}

    kinds = ", ".join(f"{f} {k}" for f, k in styling.FIELDS.items())
    defs = [("Normal", None, True, row()), ("Body", "Normal", False, row(font_latin="Cambria", size="24")),
            ("Centered", "Body", False, row(jc="center")), ("A", "B", False, row()), ("B", "A", False, row(size="x"))]
    style_defs = spark.createDataFrame([("t", s, b, d, *r.values()) for s, b, d, r in defs], f"task_id string, style_id string, based_on string, is_default boolean, {kinds}")
    defaults = spark.createDataFrame([("t", *row(font_latin_theme="minor", font_east_asia_theme="minor", size="22").values())], f"task_id string, {kinds}")
    paragraph = spark.createDataFrame([("t", style, *row(**(direct or {})).values())], f"task_id string, style_id string, {kinds}")
    defined = spark.createDataFrame([("t", n, levels) for n, levels in numbering], "task_id string, num_id string, levels array<int>")
    return styling.effective(paragraph, styling.chains(style_defs), defaults, defined).first()


def test_effective_style_levels(spark):
    plain = styled(spark, style=None)
    assert (plain.font_latin, plain.font_size, plain.paragraph_style) == (None, 22, "Normal")
    body = styled(spark)
    assert (body.font_latin, body.font_size, body.font_east_asia) == ("Cambria", 24, None)
    centered = styled(spark, style="Centered")
    assert (centered.alignment, centered.font_latin) == ("center", "Cambria")
    assert styled(spark, {"font_latin_theme": "major"}).font_latin is None
    assert styled(spark, {"bold_present": True, "bold_val": "off"}).bold is False
    assert "cycle" in styled(spark, style="A").style_note and styled(spark, style="A").font_size is None


@pytest.mark.parametrize("num, ilvl, want", [("3", "1", ("3", 1)), ("3", None, ("3", 0)), ("3", "7", (None, None)), ("99", "0", (None, None)), ("0", "0", (None, None))])
def test_numbering_must_be_defined(spark, num, ilvl, want):
    row = styled(spark, {"num_id": num, "ilvl": ilvl})
    assert (row.numbering_id, row.numbering_level) == want


def test_detector_metrics_count_unknowns_apart(spark):
    cases = [("bad", True, "fail"), ("bad", True, "unknown"), ("bad", True, "pass"), ("clean", False, "pass"), ("clean", False, "unknown"), ("clean", False, "fail")]
    rows = {r["class"]: r for r in evaluation.detector_metrics(spark.createDataFrame(cases, "label string, expect_fail boolean, predicted string")).collect()}
    every = rows["overall"]
    assert (every.tp, every.fp, every.fn, every.tn, every.unknown_clean, every.unknown_bad) == (2, 1, 1, 1, 1, 1)
    assert (rows["bad"].detected, rows["clean"].detected) == (2, 1)


def test_placeholder_shapes(spark):
    cases = {"{{ a_b }}": True, "{{ 1a }}": False, "{{ __ }}": False, "{ a }": False, "{{é}}": True, "{{a b}}": False, "{{}}": False, "{{ _1a }}": False}
    frame = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.ok for r in frame.select("p", checks.placeholder_valid(F.col("p")).alias("ok")).collect()} == cases


def _irs(spark, **changed):
    row = {"task_id": "t", "ir_version": "v1", "ir_epoch": 1, "binding_version_id": "v1", "binding_epoch": 1, "binding_digest": None, "registered": True, "docx_matches": True, "viz_slots": []}
    row |= changed
    return spark.createDataFrame(
        [tuple(row.values())],
        "task_id string, ir_version string, ir_epoch bigint, binding_version_id string, binding_epoch bigint, binding_digest string, registered boolean, docx_matches boolean, viz_slots array<string>",
    )


def _gate_a(spark, irs, task=("t", 1, "v1"), regions=(), materials=()):
    frame = spark.createDataFrame
    found = gates.gate_a(
        frame([task], "task_id string, epoch bigint, template_version_id string"), irs,
        frame([], "task_id string, slot_id string, override_artifact_id string"),
        frame([], "task_id string, slot_id string, span_no int, artifact_id string, canonical_sha256 string, span_start bigint, span_end bigint, span_sha256 string"),
        frame(list(regions), "task_id string, template_version_id string, region_id string, ref_version string"),
        frame([("v1", "r0")], "template_version_id string, region_id string"),
        frame(list(materials), "task_id string, artifact_id string, sha256 string, text string"),
        frame([], "task_id string, epoch bigint, slot_id string, decision_id string, reason_artifact_id string"),
    )
    return {r.check_id for r in found.filter("status = 'fail'").collect()}


def test_gate_a_fails_closed(spark):
    import hashlib

    empty = hashlib.sha256(b"").hexdigest()
    whole = [("t", "v1", "r0", "v1")]
    assert _gate_a(spark, _irs(spark, binding_digest=empty), regions=whole) == set()
    assert _gate_a(spark, _irs(spark, binding_digest=empty)) == {"static_regions"}
    assert _gate_a(spark, _irs(spark), regions=whole) == {"binding_freshness"}
    assert _gate_a(spark, _irs(spark, binding_digest=empty, ir_epoch=None), regions=whole) == {"epoch_match"}
    assert _gate_a(spark, _irs(spark, binding_digest=empty), task=("t", None, "v1"), regions=whole) == {"epoch_match"}
    assert "template_identity" in _gate_a(spark, _irs(spark, binding_digest=empty), task=("t", 1, None), regions=whole)
    assert _gate_a(spark, _irs(spark, binding_digest=empty, registered=None), regions=whole) == {"template_identity"}
    held = [("t", f"a{i}", "s", "x") for i in range(60)]
    assert _gate_a(spark, _irs(spark, binding_digest=empty), regions=whole, materials=held) == {"binding_freshness"}


def test_an_empty_candidate_is_a_problem(spark):
    expected = spark.createDataFrame(
        [("t", 0, None, 0, True, 0, 1, 0, "text")],
        "task_id string, idx int, slot_id string, span_no int, in_ir boolean, first_pos bigint, n_expected bigint, pos bigint, text string",
    )
    candidate = spark.createDataFrame([], "task_id string, pos bigint, text string, bookmarks array<string>")
    found = gates.sequence_problems(expected, candidate).collect()
    assert [r.message for r in found] == ["template left over from paragraph 0"]


def test_cut_messages_say_how_many_more(spark):
    from provena.operators.findings import listed_messages

    rows = spark.range(7).selectExpr("'k' AS key", "id AS n", "concat('m', id) AS message")
    assert listed_messages(rows, ["key"], "n", "message", 5).collect()[0].messages == "m0; m1; m2; m3; m4; and 2 more"


def test_what_is_not_known_does_not_pass(spark):
    ok, sha_a = "pass", sha("abc")
    irs = spark.createDataFrame(
        [("good", "ir", "v1", "c", 1), ("nulls", None, "v1", None, 1), ("epochless", "ir", "v1", "c", None), ("versionless", "ir", None, "c", 1)],
        "task_id string, render_ir_sha256 string, ir_version string, candidate_sha256 string, ir_epoch long",
    )
    reports = spark.createDataFrame(
        [(t, g, ok, None if t == "nulls" else "ir", "v1", None if t == "nulls" else "c") for t in ("good", "nulls", "epochless", "versionless") for g in gates.REQUIRED_GATES],
        "task_id string, gate string, overall_status string, render_ir_sha256 string, template_version_id string, candidate_sha256 string",
    )
    tasks = spark.createDataFrame([(t, "running", None if t == "epochless" else 1, None if t == "versionless" else "v1") for t in ("good", "nulls", "epochless", "versionless")], "task_id string, status string, epoch long, template_version_id string")
    none = spark.createDataFrame([], "task_id string, delivery_id string")
    problems = {r["task_id"] for r in gates.subject_problems(irs, reports).collect()}
    assert problems == {"nulls", "versionless"}
    outcomes = {r["task_id"]: r["outcome"] for r in gates.finalize(tasks, irs, reports, none).collect()}
    assert outcomes == {"good": "delivered", "nulls": "gates_failed", "epochless": "stale_ir", "versionless": "template_changed"}
    artifacts = spark.createDataFrame([("a", "t", "abc", sha_a), ("n", "t", "abc", None), ("x", "t", None, sha_a)], "artifact_id string, task_id string, text string, sha256 string")
    piece = sha("ab")
    spans_ = [("a", sha_a, 0, 2, piece), ("a", None, 0, 2, piece), ("a", sha_a, 0, 2, None), ("a", sha_a, None, 2, piece), ("n", sha_a, 0, 2, piece), ("x", sha_a, 0, 2, piece), (None, sha_a, 0, 2, piece)]
    ir = spark.createDataFrame([("t", "s", k, *s) for k, s in enumerate(spans_)], "task_id string, slot_id string, span_no int, artifact_id string, canonical_sha256 string, span_start long, span_end long, span_sha256 string")
    assert {r["span_no"] for r in gates.scope_problems(ir, artifacts).collect()} == {1, 4, 6}
    assert {r["span_no"] for r in gates.span_problems(ir, artifacts).collect()} == {1, 2, 3, 4, 5}


def test_residue_is_looked_for_in_every_part(spark):
    paragraphs = spark.createDataFrame([("a", 0, "ok"), ("a", 3, "{{ x }}"), ("b", 0, "ok"), ("c", 0, None)], "task_id string, pos int, text string")
    parts = spark.createDataFrame([("a", "footer1", "{% if %}"), ("b", "header2", "{{ p }}"), ("b", "footer9", "{{ q }}"), ("c", "header1", None)], "task_id string, part string, text string")
    got = {r.task_id: (r.part, r.pos, r.text) for r in gates.residue(paragraphs, parts).collect()}
    assert got == {"a": ("document", 3, "{{ x }}"), "b": ("footer9", 0, "{{ q }}")}
