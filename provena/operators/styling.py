"""Effective formatting of paragraphs, and the format gate.

What a style inherits is merged into one level by pointer doubling over its document's styles,
once for all documents with the same ones. Paragraphs then join the level of their style;
resolving an attribute looks at three levels: direct, inherited, the document's defaults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions import checks
from provena.operators.findings import finding
from provena.operators.gates import FORMAT_GATE
from provena.operators.ranking import first_rows
from provena.session import settle

#: What one level of formatting may set.
FIELDS = {
    "font_latin": "string", "font_latin_theme": "string", "font_east_asia": "string", "font_east_asia_theme": "string",
    "size": "string", "bold_present": "boolean", "bold_val": "string", "jc": "string", "num_id": "string", "ilvl": "string",
}


def level(prefix: str = "", style: Column | None = None) -> Column:
    """The formatting columns of a row as one level."""
    name = F.lit(None).cast("string") if style is None else style
    parts = [F.col(prefix + f).cast(kind).alias(f) for f, kind in FIELDS.items()]
    return F.struct(name.alias("style_id"), *parts)


def _parts(style_defs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(task_id, part) and the definitions (part, style_id, ...) of each different styles part.

    Documents made from one template have equal styles; a part is known by two sums of
    hashes of its definitions and stands for all its documents under the smallest task id.
    """
    row = [F.col(c) for c in sorted(style_defs.columns) if c != "task_id"]
    marks = [F.sum(F.xxhash64(F.lit(seed), *row).cast("decimal(38,0)")).alias(f"_m{seed}") for seed in (1, 2)]
    marked = style_defs.groupBy("task_id").agg(*marks, F.count("*").alias("_n"))
    same = ["_m1", "_m2", "_n"]
    heads = marked.groupBy(*same).agg(F.min("task_id").alias("part"))
    of = settle(marked.join(heads, same).select("task_id", "part"), "style-parts")
    return of, style_defs.join(of.select(F.col("part").alias("task_id")).distinct(), "task_id", "left_semi").withColumnRenamed("task_id", "part")


def _merged(near: str, far: str) -> Column:
    """One level of two: what the nearer sets, else what the farther does. A font and its
    theme, bold and its value, a list and its level go together."""

    def of(name: str, sets: Column) -> Column:
        return F.when(sets, F.col(f"{near}.{name}")).otherwise(F.col(f"{far}.{name}")).alias(name)

    has = lambda name: F.col(f"{near}.{name}").isNotNull()
    latin, asian = has("font_latin") | has("font_latin_theme"), has("font_east_asia") | has("font_east_asia_theme")
    bold = F.coalesce(F.col(f"{near}.bold_present"), F.lit(False))
    sets = {
        "font_latin": latin, "font_latin_theme": latin, "font_east_asia": asian, "font_east_asia_theme": asian, "size": has("size"),
        "bold_present": bold, "bold_val": bold, "jc": has("jc"), "num_id": has("num_id"), "ilvl": has("num_id"),
    }
    return F.struct(F.col(f"{near}.style_id").alias("style_id"), *[of(name, sets[name]) for name in FIELDS])


def _doubled(nodes: DataFrame, carried: dict, most: int) -> DataFrame:
    """Nodes (part, style_id, next, ...) after jumps of 1, 2, 4, ... until each has come to its
    end or passed ``most`` nodes. ``carried`` says what a column becomes of its value here and
    at the node jumped to (given as ``far_<column>``)."""
    keep = lambda c, new: F.when(F.col("next").isNull(), F.col(c)).otherwise(new).alias(c)

    def jumped(nodes: DataFrame) -> DataFrame:
        """A node at its end meets nothing and stays as it is."""
        far = nodes.select("part", F.col("style_id").alias("next"), F.col("next").alias("far_next"), *[F.col(c).alias(f"far_{c}") for c in carried])
        return nodes.join(far, ["part", "next"], "left").select("part", "style_id", F.col("far_next").alias("next"), *[keep(c, new) for c, new in carried.items()])

    span = 1
    while span < most:
        # Two rounds are one job: short chains are done in it, and rows are few beside what a job costs.
        nodes = settle(jumped(jumped(nodes)), "style-jumps")
        span *= 4
        if 1 < span < most and nodes.where("next IS NOT NULL").isEmpty():
            break
    return nodes


def chains(style_defs: DataFrame, paths: bool = False) -> DataFrame:
    """(task_id, anchor, levels, note, is_default): each style with what it inherits.

    ``levels`` holds one level, merged of the style and all it is based on, nearest first;
    with ``paths`` a column ``path`` lists the styles. A style is visited once; a cycle or a
    missing base ends the chain with a note. Of a style id that a document defines again the
    first definition counts, by the column ``def_pos`` if there is one, else the smallest.
    The anchor of paragraphs without a style is the default style, given as ``is_default``.

    Chains are followed by pointer doubling, once for each different styles part: rounds of
    joins as many as the logarithm of the longest chain, whatever number of styles there is.
    """
    if "def_pos" in style_defs.columns:
        rest = [c for c in style_defs.columns if c not in ("task_id", "style_id", "def_pos")]
        single = first_rows(style_defs, ["task_id", "style_id"], [F.col("def_pos"), F.struct(*rest)], rest)
    else:
        rest = [c for c in style_defs.columns if c not in ("task_id", "style_id")]
        single = first_rows(style_defs, ["task_id", "style_id"], [F.struct(*rest)], rest)
    of, defs = _parts(settle(single, "style-definitions"))
    known = defs.select("part", F.col("style_id").alias("based_on"), F.lit(True).alias("_known"))
    joined = defs.select("part", "style_id", "based_on", "is_default", level(style=F.col("style_id")).alias("level")).join(known, ["part", "based_on"], "left")
    path = F.array("style_id") if paths else F.lit(None).cast("array<string>")
    nodes = settle(
        joined.select(
            "part", "style_id", F.when(F.col("_known"), F.col("based_on")).alias("next"), F.when(F.col("_known").isNull(), F.col("based_on")).alias("missing"),
            "level", path.alias("path"), F.coalesce("is_default", F.lit(False)).alias("is_default"),
        ), "styles",
    )
    most = nodes.groupBy("part").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    carried = {"missing": F.coalesce("missing", "far_missing"), "level": _merged("level", "far_level"), "path": F.array_distinct(F.concat("path", "far_path")), "is_default": F.col("is_default")}
    walked = _doubled(nodes, carried if paths else {**carried, "path": F.col("path")}, most)
    # Who still has somewhere to go after that many jumps is led round a cycle, by a node of it.
    round_ = walked.where("next IS NOT NULL").select("part", F.col("next").alias("style_id")).distinct()
    if round_.isEmpty():
        entered = walked.select("part", "style_id").limit(0).withColumn("entry", F.col("style_id"))
    else:
        inside = nodes.select("part", "style_id", "next").join(round_.withColumn("_in", F.lit(True)), ["part", "style_id"], "left")
        ends = inside.select("part", "style_id", F.when(F.col("_in").isNull(), F.col("next")).alias("next"), F.when(F.col("_in"), F.col("style_id")).alias("entry"))
        entered = _doubled(ends, {"entry": F.coalesce("entry", "far_entry")}, most).select("part", "style_id", "entry").where("entry IS NOT NULL")
    note = F.when(F.col("entry").isNotNull(), F.concat(F.lit("basedOn cycle at "), F.col("entry"))).when(
        F.col("missing").isNotNull(), F.concat(F.lit("style not found: "), F.col("missing"))
    )
    first = walked.where("is_default").groupBy("part").agg(F.max("style_id").alias("_default"))
    done = walked.join(entered, ["part", "style_id"], "left").join(first, "part", "left").select(
        "part", F.col("style_id").alias("anchor"), F.array("level").alias("levels"), note.alias("note"), (F.col("style_id") == F.col("_default")).alias("is_default"), *(["path"] if paths else [])
    )
    return of.join(done, "part").drop("part")


def with_text_runs(paragraphs: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """``paragraphs`` with the direct formatting of their first run that holds text, and
    ``run_note`` where another such run differs from it.

    ``runs`` is (keys, run_no, text) and columns of FIELDS. What the runs do not carry stays as the
    paragraph has it; a paragraph without text in any run keeps none of a run's formatting.
    """
    own = [f for f in FIELDS if f in runs.columns]
    held = F.struct(*[F.col(f).cast(FIELDS[f]).alias(f) for f in own])
    texts = runs.where(F.coalesce("text", F.lit("")) != "").select(*keys, "run_no", held.alias("_held"))
    chosen = texts.groupBy(*keys).agg(F.min_by("_held", "run_no").alias("_first"), F.min(F.to_json("_held")).alias("_low"), F.max(F.to_json("_held")).alias("_high"))
    joined = paragraphs.drop(*own).join(chosen, keys, "left")
    note = F.when(F.col("_low") != F.col("_high"), F.lit("text runs differ in direct formatting"))
    return joined.select(*[c for c in paragraphs.columns if c not in own], *[F.col(f"_first.{f}").alias(f) for f in own], note.alias("run_note"))


def effective(paragraphs: DataFrame, chained: DataFrame, defaults: DataFrame, numbering: DataFrame) -> DataFrame:
    """Paragraphs with direct formatting to their effective style; NULL means undecidable.

    ``paragraphs`` carries task_id, style_id and the columns of FIELDS; ``defaults`` one
    row of FIELDS per task; ``numbering`` (task_id, num_id, levels).
    """
    anchors = chained.filter("is_default").select("task_id", F.col("anchor").alias("_default"))
    base = defaults.select("task_id", level().alias("_doc"))
    placed = paragraphs.join(anchors, "task_id", "left").withColumn("anchor", F.coalesce("style_id", "_default"))
    joined = placed.join(chained.select("task_id", "anchor", "levels", "note"), ["task_id", "anchor"], "left").join(
        base, "task_id", "left"
    )
    inherited = F.coalesce("levels", F.slice(F.array(level()), 1, 0))
    documents = F.when(F.col("_doc").isNotNull(), F.array("_doc")).otherwise(F.slice(F.array(level()), 1, 0))
    stacked = joined.withColumn("_levels", F.concat(F.array(level()), inherited, documents))

    def first(test) -> Column:
        return F.get(F.filter("_levels", test), F.lit(0))

    def font(name: str) -> Column:
        return first(lambda s: s[name].isNotNull() | s[f"{name}_theme"].isNotNull())[name]

    bold = first(lambda s: s["bold_present"])
    numbered = first(lambda s: s["num_id"].isNotNull())
    note = F.when(
        F.col("levels").isNull(), F.concat(F.lit("style not found: "), F.col("anchor"))
    ).otherwise(F.col("note"))
    resolved = stacked.select(
        *[c for c in paragraphs.columns if c not in FIELDS],
        F.col("anchor").alias("paragraph_style"),
        font("font_latin").alias("font_latin"),
        font("font_east_asia").alias("font_east_asia"),
        first(lambda s: s["size"].isNotNull())["size"].try_cast("int").alias("font_size"),
        checks.truth(bold["bold_present"], bold["bold_val"]).alias("bold"),
        checks.alignment(first(lambda s: s["jc"].isNotNull())["jc"]).alias("alignment"),
        numbered["num_id"].alias("_num"),
        F.when(numbered.isNotNull(), F.coalesce(numbered["ilvl"].try_cast("int"), F.lit(0))).alias("_ilvl"),
        note.alias("style_note"),
    )
    defined = numbering.select("task_id", F.col("num_id").alias("_num"), F.col("levels").alias("_defined"))
    known = F.array_contains("_defined", F.col("_ilvl")) & (F.col("_num") != "0")
    return (
        resolved.join(defined, ["task_id", "_num"], "left")
        .withColumn("numbering_id", F.when(known, F.col("_num")))
        .withColumn("numbering_level", F.when(known, F.col("_ilvl")))
        .drop("_num", "_ilvl", "_defined")
    )


def with_specs(slots: DataFrame, specs: DataFrame) -> DataFrame:
    """Slots joined to the spec of their style key; ``declared`` is false without one."""
    renamed = specs.select("style_key", *[F.col(c).alias(f"spec_{c}") for c in specs.columns if c != "style_key"])
    return slots.join(renamed.withColumn("declared", F.lit(True)), "style_key", "left").withColumn(
        "declared", F.coalesce("declared", F.lit(False))
    )


def _say(condition: Column, *parts: Column | str) -> Column:
    words = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.when(condition, F.concat(*words))


def paragraph_problems() -> tuple[Column, Column]:
    """(problems, unknowns) of a row holding an effective style and ``spec_`` columns.

    An absent direct indent meets any spec, and bold that cannot be decided passes.
    """

    def spec(name: str) -> Column:
        return F.col(f"spec_{name}")

    indent = F.coalesce(F.col("indent_left"), spec("indent_left"))
    problems = [
        _say(
            spec("indent_left").isNotNull() & ~checks.within(indent, spec("indent_left"), spec("indent_tolerance")),
            "indent_left ", indent, " outside tolerance of ", spec("indent_left"), "±", spec("indent_tolerance"),
        ),
        _say(
            spec("numbering_id").isNull() & spec("numbering_level").isNull() & F.col("numbering_id").isNotNull(),
            "undeclared numbering ", F.col("numbering_id"), " on a slot styled ", F.col("style_key"),
        ),
    ]
    unknowns = [_say(spec("paragraph_style").isNotNull() & F.col("paragraph_style").isNull(), "paragraph_style unresolved")]
    for name in ("font_latin", "font_east_asia"):
        problems.append(_say(F.col(name) != spec(name), f"{name} ", F.col(name), " != ", spec(name)))
        unknowns.append(_say(spec(name).isNotNull() & F.col(name).isNull(), f"{name} unresolved (theme-indirect)"))
    size, wanted, slack = F.col("font_size"), spec("font_size"), spec("size_tolerance")
    problems.append(_say(~checks.within(size, wanted, slack), "font_size ", size, " outside tolerance of ", wanted, "±", slack))
    unknowns.append(_say(wanted.isNotNull() & size.isNull(), "font_size unresolved"))
    problems.append(_say(F.col("bold") != spec("bold"), "bold ", F.col("bold"), " != ", spec("bold")))
    judged = spec("alignment").isNotNull() & (spec("alignment") != "unknown")
    problems.append(_say(judged & (F.col("alignment") != spec("alignment")), "alignment ", F.col("alignment"), " != ", spec("alignment")))
    unknowns.append(_say(judged & F.col("alignment").isNull(), "alignment unresolved"))
    return F.array_compact(F.array(*problems)), F.array_compact(F.array(*unknowns))


def check_paragraphs(styled: DataFrame) -> DataFrame:
    """Styled paragraphs with ``status`` and ``detail``: fail over unknown over pass."""
    problems, unknowns = paragraph_problems()
    judged = styled.withColumn("_p", problems).withColumn("_u", unknowns)
    bad, unsure = F.size("_p") > 0, F.size("_u") > 0
    status = F.when(~F.col("declared"), "unknown").when(bad, "fail").when(unsure, "unknown").otherwise("pass")
    detail = (
        F.when(~F.col("declared"), F.lit("no StyleSpec declared for this style key"))
        .when(bad, F.array_join("_p", "; "))
        .when(unsure, F.array_join("_u", "; "))
    )
    return judged.withColumn("status", status).withColumn("detail", detail).drop("_p", "_u")


def check_margins(sections: DataFrame, specs: DataFrame) -> DataFrame:
    """Section margins (task_id, has_section, has_margins, top, bottom) against the first
    spec, in declared order, that names any."""
    declared = specs.filter(F.col("margin_top").isNotNull() | F.col("margin_bottom").isNotNull())
    first = declared.agg(F.min_by(F.struct("margin_top", "margin_bottom", "indent_tolerance"), "spec_pos").alias("s"))
    wanted = sections.withColumn("_s", first.scalar())
    top, bottom, slack = F.col("_s.margin_top"), F.col("_s.margin_bottom"), F.col("_s.indent_tolerance")
    problems = F.array_compact(
        F.array(
            _say(~checks.within(F.col("top"), top, slack), "margin_top ", F.col("top"), " != ", top),
            _say(~checks.within(F.col("bottom"), bottom, slack), "margin_bottom ", F.col("bottom"), " != ", bottom),
        )
    )
    missing = F.when(~F.col("has_section"), "no sectPr found").when(~F.col("has_margins"), "no pgMar in sectPr")
    status = F.when(missing.isNotNull(), "unknown").when(F.size(problems) > 0, "fail").otherwise("pass")
    detail = F.coalesce(missing, F.when(F.size(problems) > 0, F.array_join(problems, "; ")))
    return wanted.filter(F.col("_s").isNotNull()).withColumn("status", status).withColumn("detail", detail).drop("_s")


def format_gate(styled: DataFrame, sections: DataFrame, specs: DataFrame) -> DataFrame:
    """Findings for styled paragraphs (slot_id, idx) and for each document's margins."""
    checked = check_paragraphs(styled)
    place = F.col("idx").cast("string")
    check = F.concat(F.lit("style:"), F.col("slot_id"), F.when(F.col("declared"), F.concat(F.lit(":"), place)).otherwise(F.lit("")))
    locator = F.when(F.col("declared"), F.concat(F.lit("document:"), place)).otherwise(F.concat(F.lit("style_key "), F.col("style_key")))
    margins = check_margins(sections, specs)
    return finding(checked, FORMAT_GATE, check, F.col("detail"), locator=locator, status=F.col("status")).unionByName(
        finding(margins, FORMAT_GATE, F.lit("section_margins"), F.col("detail"), status=F.col("status"))
    )
