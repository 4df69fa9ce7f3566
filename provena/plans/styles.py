"""Queries on styles, the format gate and its benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.functions import checks
from provena.operators import evaluation, styling
from provena.plans.registry import query
from provena.plans.shared_sql import define, stating
from provena.sources import tables as tb

SPEC_SCHEMA = (
    "spec_pos int, style_key string, paragraph_style string, font_latin string, font_east_asia string, font_size int, "
    "bold boolean, alignment string, indent_left int, margin_top int, margin_bottom int, numbering_id string, "
    "numbering_level int, size_tolerance int, indent_tolerance int"
)

define(
    "style_defs",
    """
SELECT task_id, style_id, based_on, style_id = 'Normal' AS is_default, fl, fe, CASE WHEN style_id = 'Body' THEN (20 + task_no % 5)::VARCHAR ELSE size END AS size, bold, jc, num, ilvl
FROM tasks, (VALUES ('Normal', NULL, NULL, NULL, NULL, FALSE, NULL, NULL, NULL), ('Body', 'Normal', 'Cambria', NULL, 'x', FALSE, NULL, NULL, NULL),
  ('Centered', 'Body', NULL, NULL, NULL, FALSE, 'center', NULL, NULL), ('Heading2', 'Normal', 'Arial', 'SimHei', '36', TRUE, NULL, NULL, NULL),
  ('LoopA', 'LoopB', 'Loop', NULL, NULL, FALSE, NULL, NULL, NULL), ('LoopB', 'LoopA', NULL, NULL, NULL, FALSE, 'end', NULL, NULL),
  ('Ghost', 'Nowhere', NULL, NULL, '24', FALSE, NULL, '1', '1')) v(style_id, based_on, fl, fe, size, bold, jc, num, ilvl)""",
    "tasks",
)
define(
    "chain",
    """
SELECT task_id, anchor, depth, style_id, fl, fe, size, bold, jc, num, ilvl, based_on FROM (
  WITH RECURSIVE walk AS (
    SELECT task_id, style_id AS anchor, 0 AS depth, style_id, fl, fe, size, bold, jc, num, ilvl, based_on, [style_id] AS seen FROM style_defs
    UNION ALL
    SELECT w.task_id, w.anchor, w.depth + 1, d.style_id, d.fl, d.fe, d.size, d.bold, d.jc, d.num, d.ilvl, d.based_on, list_concat(w.seen, [d.style_id])
    FROM walk w JOIN style_defs d ON d.task_id = w.task_id AND d.style_id = w.based_on WHERE NOT list_contains(w.seen, d.style_id))
  SELECT * FROM walk)""",
    "style_defs",
)
define(
    "paragraphs",
    """
SELECT task_no, task_id, doc_id, ['Body','Centered','Heading2','LoopA','Ghost',NULL,'Unknown','Normal'][(doc_id % 8 + 1)::INT] AS style_id,
       CASE WHEN doc_id % 9 = 1 THEN 'InjectedFont' END AS fl, CASE WHEN doc_id % 9 = 2 THEN 'majorHAnsi' END AS flt,
       CASE doc_id % 10 WHEN 3 THEN '44' WHEN 4 THEN 'abc' END AS size, doc_id % 7 IN (1, 2) AS bold_present, CASE WHEN doc_id % 7 = 2 THEN 'false' END AS bold_val,
       CASE doc_id % 11 WHEN 5 THEN 'center' WHEN 6 THEN 'distribute' END AS jc, CASE doc_id % 6 WHEN 1 THEN '1' WHEN 2 THEN '0' WHEN 3 THEN '99' WHEN 4 THEN '3' END AS num,
       CASE WHEN doc_id % 12 = 1 THEN '5' END AS ilvl, CASE doc_id % 13 WHEN 2 THEN 4320 WHEN 3 THEN 15 END AS indent_left,
       ['body', 'title', 'plain', 'nospec'][(doc_id % 4 + 1)::INT] AS style_key
FROM materials""",
    "materials",
)
define(
    "styled",
    """
SELECT p.task_no, p.task_id, p.doc_id, p.style_key, p.indent_left, coalesce(p.style_id, 'Normal') AS paragraph_style,
       CASE WHEN flt IS NOT NULL THEN NULL ELSE coalesce(fl, chain_fl) END AS font_latin, chain_fe AS font_east_asia,
       TRY_CAST(coalesce(size, chain_size, '22') AS INT) AS font_size,
       CASE WHEN bold_present THEN coalesce(bold_val NOT IN ('false', '0', 'off'), TRUE) WHEN chain_bold THEN TRUE END AS bold,
       CASE coalesce(jc, chain_jc) WHEN 'center' THEN 'center' WHEN 'end' THEN 'right' END AS alignment,
       CASE WHEN coalesce(num, chain_num) = '1' AND coalesce(CASE WHEN num IS NOT NULL THEN ilvl ELSE chain_ilvl END, '0') IN ('0', '1') THEN '1' END AS numbering_id,
       CASE WHEN coalesce(num, chain_num) = '1' AND coalesce(CASE WHEN num IS NOT NULL THEN ilvl ELSE chain_ilvl END, '0') IN ('0', '1')
            THEN coalesce(CASE WHEN num IS NOT NULL THEN ilvl ELSE chain_ilvl END, '0')::INT END AS numbering_level,
       CASE WHEN style_id = 'Unknown' THEN 'style not found: Unknown' WHEN style_id = 'LoopA' THEN 'basedOn cycle at LoopA' WHEN style_id = 'Ghost' THEN 'style not found: Nowhere' END AS style_note
FROM paragraphs p LEFT JOIN (SELECT task_id, anchor, arg_min(fl, depth) FILTER (fl IS NOT NULL) AS chain_fl, arg_min(fe, depth) FILTER (fe IS NOT NULL) AS chain_fe,
    arg_min(size, depth) FILTER (size IS NOT NULL) AS chain_size, bool_or(bold) AS chain_bold, arg_min(jc, depth) FILTER (jc IS NOT NULL) AS chain_jc,
    arg_min(num, depth) FILTER (num IS NOT NULL) AS chain_num, arg_min(ilvl, depth) FILTER (num IS NOT NULL) AS chain_ilvl FROM chain GROUP BY ALL) c
  ON c.task_id = p.task_id AND c.anchor = coalesce(p.style_id, 'Normal')""",
    "paragraphs", "chain",
)
define(
    "specs",
    """
SELECT * FROM (VALUES ('body', 'Body', 'Cambria', NULL, 22, NULL, NULL, 0), ('title', NULL, 'Arial', 'SimHei', 36, TRUE, NULL, NULL), ('plain', NULL, NULL, NULL, NULL, FALSE, 'center', 10))
  v(style_key, s_style, s_fl, s_fe, s_size, s_bold, s_align, s_indent)""",
)
define(
    "judged_paragraphs",
    """
SELECT *, CASE WHEN undeclared THEN 'unknown' WHEN len(problems) > 0 THEN 'fail' WHEN len(unknowns) > 0 THEN 'unknown' ELSE 'pass' END AS status,
       CASE WHEN undeclared THEN 'no StyleSpec declared for this style key' WHEN len(problems) > 0 THEN array_to_string(problems, '; ') WHEN len(unknowns) > 0 THEN array_to_string(unknowns, '; ') END AS detail
FROM (SELECT p.*, s.style_key IS NULL AS undeclared, list_filter([
   CASE WHEN s_indent IS NOT NULL AND abs(coalesce(indent_left, s_indent) - s_indent) > 20 THEN 'indent_left ' || indent_left::VARCHAR || ' outside tolerance of ' || s_indent::VARCHAR || '±20' END,
   CASE WHEN numbering_id IS NOT NULL THEN 'undeclared numbering ' || numbering_id || ' on a slot styled ' || p.style_key END,
   CASE WHEN font_latin <> s_fl THEN 'font_latin ' || font_latin || ' != ' || s_fl END, CASE WHEN font_east_asia <> s_fe THEN 'font_east_asia ' || font_east_asia || ' != ' || s_fe END,
   CASE WHEN abs(font_size - s_size) > 2 THEN 'font_size ' || font_size::VARCHAR || ' outside tolerance of ' || s_size::VARCHAR || '±2' END,
   CASE WHEN bold <> s_bold THEN 'bold ' || bold::VARCHAR || ' != ' || s_bold::VARCHAR END, CASE WHEN alignment <> s_align THEN 'alignment ' || alignment || ' != ' || s_align END], lambda v: v IS NOT NULL) AS problems,
  list_filter([CASE WHEN s_fl IS NOT NULL AND font_latin IS NULL THEN 'font_latin unresolved (theme-indirect)' END, CASE WHEN s_fe IS NOT NULL AND font_east_asia IS NULL THEN 'font_east_asia unresolved (theme-indirect)' END,
   CASE WHEN s_size IS NOT NULL AND font_size IS NULL THEN 'font_size unresolved' END, CASE WHEN s_align IS NOT NULL AND alignment IS NULL THEN 'alignment unresolved' END], lambda v: v IS NOT NULL) AS unknowns
  FROM styled p LEFT JOIN specs s USING (style_key))""",
    "styled", "specs",
)


def _nulls(df: DataFrame) -> DataFrame:
    """Add the formatting columns a table does not set."""
    for name, kind in styling.FIELDS.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def style_defs(spark, sf_dir) -> DataFrame:
    """The styles of each task's document; the size of Body varies, two styles form a loop."""
    rows = [
        ("Normal", None, None, None, None, False, None, None, None),
        ("Body", "Normal", "Cambria", None, "x", False, None, None, None),
        ("Centered", "Body", None, None, None, False, "center", None, None),
        ("Heading2", "Normal", "Arial", "SimHei", "36", True, None, None, None),
        ("LoopA", "LoopB", "Loop", None, None, False, None, None, None),
        ("LoopB", "LoopA", None, None, None, False, "end", None, None),
        ("Ghost", "Nowhere", None, None, "24", False, None, "1", "1"),
        ("Clean", "Normal", "Calibri", "SimSun", "21", False, "left", None, None),
    ]
    names = ("style_id", "based_on", "font_latin", "font_east_asia", "size", "bold_present", "jc", "num_id", "ilvl")

    def typed(value, name):
        return F.lit(value).cast("boolean" if name == "bold_present" else "string").alias(name)

    listed = F.array(*[F.struct(*[typed(v, n) for v, n in zip(row, names)]) for row in rows])
    defs = tb.tasks(spark, sf_dir).select("task_no", "task_id", F.inline(listed))
    size = F.when(F.col("style_id") == "Body", (20 + F.col("task_no") % 5).cast("string")).otherwise(F.col("size"))
    return _nulls(defs.withColumn("size", size).withColumn("is_default", F.col("style_id") == "Normal"))


def doc_defaults(spark, sf_dir) -> DataFrame:
    return _nulls(
        tb.tasks(spark, sf_dir).select(
            "task_id", F.lit("minorHAnsi").alias("font_latin_theme"), F.lit("minorEastAsia").alias("font_east_asia_theme"),
            F.lit("22").alias("size"),
        )
    )


def numbering(spark, sf_dir) -> DataFrame:
    """Numbering definitions of each task: 1 has two levels, 3 lacks its abstract definition."""
    one = F.struct(F.lit("1").alias("num_id"), F.array(F.lit(0), F.lit(1)).alias("levels"))
    three = F.struct(F.lit("3").alias("num_id"), F.lit(None).cast("array<int>").alias("levels"))
    return tb.tasks(spark, sf_dir).select("task_id", F.inline(F.array(one, three)))


def paragraphs(spark, sf_dir) -> DataFrame:
    """One paragraph per document with direct formatting of all kinds."""
    doc = F.col("doc_id")
    styles = [F.lit(s) for s in ("Body", "Centered", "Heading2", "LoopA", "Ghost")] + [F.lit(None), F.lit("Unknown"), F.lit("Normal")]
    keys = [F.lit(k) for k in ("body", "title", "plain", "nospec")]
    return _nulls(
        tb.materials(spark, sf_dir).select(
            "task_no", "task_id", "doc_id",
            F.get(F.array(*styles), (doc % 8).cast("int")).alias("style_id"),
            F.when(doc % 9 == 1, "InjectedFont").alias("font_latin"),
            F.when(doc % 9 == 2, "majorHAnsi").alias("font_latin_theme"),
            F.when(doc % 10 == 3, "44").when(doc % 10 == 4, "abc").alias("size"),
            (doc % 7).isin(1, 2).alias("bold_present"),
            F.when(doc % 7 == 2, "false").alias("bold_val"),
            F.when(doc % 11 == 5, "center").when(doc % 11 == 6, "distribute").alias("jc"),
            F.when(doc % 6 == 1, "1").when(doc % 6 == 2, "0").when(doc % 6 == 3, "99").when(doc % 6 == 4, "3").alias("num_id"),
            F.when(doc % 12 == 1, "5").alias("ilvl"),
            F.when(doc % 13 == 2, 4320).when(doc % 13 == 3, 15).alias("indent_left"),
            F.get(F.array(*keys), (doc % 4).cast("int")).alias("style_key"),
        )
    )


def style_specs(spark) -> DataFrame:
    rows = [
        (0, "body", "Body", "Cambria", None, 22, None, None, 0, None, None, None, None, 2, 20),
        (1, "title", None, "Arial", "SimHei", 36, True, None, None, 1440, 1440, None, None, 2, 20),
        (2, "plain", None, None, None, None, False, "center", 10, None, None, None, None, 2, 20),
    ]
    return tb.literal(spark, rows, SPEC_SCHEMA)


def styled(spark, sf_dir) -> DataFrame:
    chained = styling.chains(style_defs(spark, sf_dir))
    return styling.effective(
        paragraphs(spark, sf_dir), chained, doc_defaults(spark, sf_dir), numbering(spark, sf_dir)
    )


@query(
    "style_chain",
    stating(
        "chain",
        """
SELECT task_id, anchor, string_agg(style_id, ' > ' ORDER BY depth) AS chain,
       CASE anchor WHEN 'LoopA' THEN 'basedOn cycle at LoopA' WHEN 'LoopB' THEN 'basedOn cycle at LoopB' WHEN 'Ghost' THEN 'style not found: Nowhere' END AS note FROM chain GROUP BY task_id, anchor
UNION ALL SELECT task_id, 'Clean', 'Clean > Normal', NULL FROM tasks""",
    ),
)
def style_chain(spark, sf_dir):
    chained = styling.chains(style_defs(spark, sf_dir), paths=True)
    return chained.select("task_id", "anchor", F.array_join("path", " > ").alias("chain"), "note")


@query(
    "effective_style",
    stating(
        "styled",
        "SELECT doc_id, paragraph_style, font_latin, font_east_asia, font_size, bold, alignment, numbering_id, numbering_level, style_note FROM styled",
    ),
)
def effective_style(spark, sf_dir):
    return styled(spark, sf_dir).select(
        "doc_id", "paragraph_style", "font_latin", "font_east_asia", "font_size", "bold", "alignment",
        "numbering_id", "numbering_level", "style_note",
    )


@query(
    "truth_value",
    stating(
        "paragraphs",
        "SELECT doc_id, CASE WHEN bold_present THEN coalesce(bold_val NOT IN ('false', '0', 'off'), TRUE) END AS bold FROM paragraphs",
    ),
)
def truth_value(spark, sf_dir):
    return paragraphs(spark, sf_dir).select("doc_id", checks.truth(F.col("bold_present"), F.col("bold_val")).alias("bold"))


@query(
    "alignment_map",
    """
SELECT doc_id, jc, CASE jc WHEN 'left' THEN 'left' WHEN 'start' THEN 'left' WHEN 'center' THEN 'center' WHEN 'right' THEN 'right' WHEN 'end' THEN 'right' WHEN 'both' THEN 'both' END AS alignment
FROM (SELECT doc_id, ['left', 'start', 'center', 'right', 'end', 'both', 'distribute'][(doc_id % 7 + 1)::INT] AS jc FROM documents)""",
)
def alignment_map(spark, sf_dir):
    values = F.array(*[F.lit(v) for v in ("left", "start", "center", "right", "end", "both", "distribute")])
    jc = F.get(values, (F.col("doc_id") % 7).cast("int"))
    return tb.read(spark, sf_dir, "documents").select("doc_id", jc.alias("jc")).withColumn(
        "alignment", checks.alignment(F.col("jc"))
    )


@query(
    "tolerance",
    "SELECT p_partkey, abs(p_size - 25) <= 2 AS size_ok, abs(p_retailprice - 1000) <= 20 AS indent_ok FROM part",
)
def tolerance(spark, sf_dir):
    return tb.read(spark, sf_dir, "part").select(
        "p_partkey",
        checks.within(F.col("p_size"), F.lit(25), F.lit(2)).alias("size_ok"),
        checks.within(F.col("p_retailprice"), F.lit(1000), F.lit(20)).alias("indent_ok"),
    )


@query(
    "style_spec_join",
    stating(
        "paragraphs specs",
        "SELECT p.doc_id, p.style_key, s.style_key IS NOT NULL AS declared, s.s_fl AS font_latin, CASE WHEN s.style_key IS NULL THEN 'STYLE_KEY_UNKNOWN' END AS finding "
        "FROM paragraphs p LEFT JOIN specs s USING (style_key)",
    ),
)
def style_spec_join(spark, sf_dir):
    joined = styling.with_specs(paragraphs(spark, sf_dir).select("doc_id", "style_key"), style_specs(spark))
    return joined.select(
        "doc_id", "style_key", "declared", F.col("spec_font_latin").alias("font_latin"),
        F.when(~F.col("declared"), "STYLE_KEY_UNKNOWN").alias("finding"),
    )


def sections(spark, sf_dir) -> DataFrame:
    """Page margins of each task's document; some lack them."""
    number = F.col("task_no")
    has = (number % 8 != 7) & (number % 7 != 6)
    return tb.tasks(spark, sf_dir).select(
        "task_id", (number % 8 != 7).alias("has_section"), has.alias("has_margins"),
        F.when(has, 1440 + number % 7 * 10).cast("int").alias("top"), F.when(has & (number % 3 > 0), 1440).alias("bottom"),
    )


@query(
    "format_gate",
    stating(
        "judged_paragraphs tasks",
        """
SELECT 'format_gate' AS gate, task_id, 'style:p' || CASE WHEN undeclared THEN '' ELSE ':' || doc_id::VARCHAR END AS check_id, status, TRUE AS required,
       CASE WHEN undeclared THEN 'style_key nospec' ELSE 'document:' || doc_id::VARCHAR END AS locator, NULL AS expected, detail AS actual FROM judged_paragraphs
UNION ALL
SELECT 'format_gate', task_id, 'section_margins', CASE WHEN task_no % 8 = 7 OR task_no % 7 = 6 THEN 'unknown' WHEN task_no % 7 * 10 > 20 THEN 'fail' ELSE 'pass' END, TRUE, NULL, NULL,
       CASE WHEN task_no % 8 = 7 THEN 'no sectPr found' WHEN task_no % 7 = 6 THEN 'no pgMar in sectPr' WHEN task_no % 7 * 10 > 20 THEN 'margin_top ' || (1440 + task_no % 7 * 10)::VARCHAR || ' != 1440' END
FROM tasks""",
    ),
)
def format_gate(spark, sf_dir):
    specs = style_specs(spark)
    rows = styling.with_specs(styled(spark, sf_dir), specs).withColumn("slot_id", F.lit("p")).withColumn("idx", F.col("doc_id"))
    return styling.format_gate(rows, sections(spark, sf_dir), specs)


#: Defects that the format benchmark injects (fixed values).
MUTATIONS = ("font", "font_size", "alignment", "numbering", "indent", "style_drift", "placeholder_residue", "margins")


def corpus(spark, sf_dir) -> DataFrame:
    """Every document as it is and once per defect injected into its opening, classified.

    Template syntax is looked for in the whole text, where it is scanned; what goes on is the opening.
    """
    kinds = F.array(*[F.lit(m) for m in ("clean", *MUTATIONS)])
    kind, whole = F.col("label"), F.col("text")
    cases = tb.materials(spark, sf_dir).select(
        "task_id", "doc_id", F.substring_index(whole, "\n", 1).alias("line"),
        (whole.contains("{{") | whole.contains("{%")).alias("residue"), F.explode(kinds).alias("label"),
    )

    def injected(mutation, value):
        return F.when(kind == mutation, F.lit(value))

    mutated = _nulls(
        cases.select(
            "task_id", "doc_id", "label", "residue",
            F.when(kind == "placeholder_residue", "{{ injected }}").otherwise(F.col("line")).alias("text"),
            F.when(kind == "style_drift", "Heading2").otherwise("Clean").alias("style_id"),
            injected("font", "InjectedFont").alias("font_latin"), injected("font", "InjectedFont").alias("font_east_asia"),
            injected("font_size", "44").alias("size"), injected("alignment", "center").alias("jc"),
            injected("numbering", "1").alias("num_id"), injected("numbering", "0").alias("ilvl"),
            injected("indent", 4320).alias("indent_left"), F.lit("body").alias("style_key"),
            F.when(kind == "margins", 100).otherwise(1440).alias("top"),
        )
    )
    specs = tb.literal(
        spark, [(0, "body", "Normal", "Calibri", "SimSun", 21, None, "left", 0, 1440, 1440, None, None, 2, 20)], SPEC_SCHEMA
    )
    chained = styling.chains(style_defs(spark, sf_dir))
    resolved = styling.effective(mutated, chained, doc_defaults(spark, sf_dir), numbering(spark, sf_dir))
    checked = styling.check_paragraphs(styling.with_specs(resolved, specs)).withColumnRenamed("status", "_style")
    pages = checked.withColumns(
        {"has_section": F.lit(True), "has_margins": F.lit(True), "bottom": F.lit(1440)}
    ).drop("detail")
    both = styling.check_margins(pages, specs)
    left = F.col("residue") | F.col("text").contains("{{") | F.col("text").contains("{%")
    verdicts = F.array(F.col("_style"), F.col("status"), F.when(left, "fail").otherwise("pass"))
    predicted = F.when(F.array_contains(verdicts, "fail"), "fail").when(F.array_contains(verdicts, "unknown"), "unknown").otherwise("pass")
    return both.select("doc_id", "label", (kind != "clean").alias("expect_fail"), predicted.alias("predicted"))


_CORPUS = """
SELECT doc_id, label, label <> 'clean' AS expect_fail, CASE WHEN label <> 'clean' OR residue THEN 'fail' ELSE 'pass' END AS predicted
FROM (SELECT doc_id, contains(text, '{{') OR contains(text, '{%') AS residue,
      unnest(['clean', 'font', 'font_size', 'alignment', 'numbering', 'indent', 'style_drift', 'placeholder_residue', 'margins']) AS label FROM documents)"""
_METRICS = """
SELECT class, n, detected, tp, fp, fn, tn, unknown_clean, unknown_bad, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0 END AS "precision",
       CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0 END AS recall, CASE WHEN fp + tn > 0 THEN round(fp / (fp + tn), 6) ELSE 0 END AS fpr
FROM (SELECT coalesce(label, 'overall') AS class, count(*) AS n, count(*) FILTER (expect_fail = (predicted <> 'pass')) AS detected,
   count(*) FILTER (expect_fail AND predicted <> 'pass') AS tp, count(*) FILTER (NOT expect_fail AND predicted = 'fail') AS fp, count(*) FILTER (expect_fail AND predicted = 'pass') AS fn,
   count(*) FILTER (NOT expect_fail AND predicted = 'pass') AS tn, count(*) FILTER (NOT expect_fail AND predicted = 'unknown') AS unknown_clean,
   count(*) FILTER (expect_fail AND predicted = 'unknown') AS unknown_bad FROM ({cases}) GROUP BY GROUPING SETS ((), (label)))"""


@query("format_corpus", _CORPUS)
def format_corpus(spark, sf_dir):
    return corpus(spark, sf_dir)


@query("format_benchmark", _METRICS.format(cases=_CORPUS))
def format_benchmark(spark, sf_dir):
    return evaluation.detector_metrics(corpus(spark, sf_dir))


@query(
    "detector_metrics",
    _METRICS.format(
        cases="""
SELECT d.lang AS label, l.quality = 0 AS expect_fail, CASE WHEN length(d.text) < 60 THEN 'unknown' WHEN len(list_distinct(string_split(d.text, chr(10)))) < len(string_split(d.text, chr(10)))
  OR (length(d.text) - length(replace(d.text, '|', ''))) > 5 THEN 'fail' ELSE 'pass' END AS predicted FROM labels l JOIN documents d USING (doc_id)"""
    ),
)
def detector_metrics(spark, sf_dir):
    """A plain junk detector against the quality labels."""
    lines, text = F.split("text", "\n"), F.col("text")
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    repeated = F.size(F.array_distinct(lines)) < F.size(lines)
    said = F.when(F.length(text) < 60, "unknown").when(repeated | (bars > 5), "fail").otherwise("pass")
    docs = tb.read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label"), said.alias("predicted"))
    gold = tb.read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("expect_fail"))
    return evaluation.detector_metrics(docs.join(gold, "doc_id"))
