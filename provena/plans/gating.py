"""Queries on assembly, gates and delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena import session
from provena.functions import digest
from provena.operators import findings as fd
from provena.operators import gates, ledger
from provena.operators import materials as mat
from provena.operators.ranking import first_rows
from provena.plans import bindings as bp
from provena.plans.registry import query
from provena.plans.shared_sql import define, stating
from provena.sources import tables as tb

define(
    "flawed_bindings",
    """
SELECT * REPLACE (CASE WHEN task_no % 13 = 12 AND slot_pos = 2 THEN 'appendix' ELSE slot_id END AS slot_id,
       CASE WHEN (task_no + slot_pos) % 11 = 10 THEN 'invalid' ELSE binding_status END AS binding_status) FROM auto_bind""",
    "auto_bind",
)
define(
    "ir_ready",
    """
SELECT a.*, CASE WHEN a.binding_status = 'missing' THEN o.reason_artifact_id END AS override_artifact_id
FROM auto_bind a LEFT JOIN overrides o ON o.task_id = a.task_id AND o.epoch = a.epoch AND o.slot_id = a.slot_id
WHERE a.task_id NOT IN (SELECT b.task_id FROM auto_bind b LEFT JOIN overrides p ON p.task_id = b.task_id AND p.epoch = b.epoch AND p.slot_id = b.slot_id
                        WHERE b.binding_status = 'missing' AND p.slot_id IS NULL)""",
    "auto_bind", "overrides",
)
define("ir_tasks", "SELECT DISTINCT task_no, task_id, epoch, template_version_id FROM ir_ready", "ir_ready")
define(
    "ir_spans",
    """
SELECT task_no, task_id, slot_id, slot_pos, artifact_id, canonical_sha256, n AS span_no, s AS span_start, e AS span_end,
       substring(span_text, s - span_start + 1, e - s) AS text, sha256(substring(span_text, s - span_start + 1, e - s)) AS span_sha256
FROM (SELECT *, CASE WHEN split AND n = 1 THEN mid ELSE span_start END AS s, CASE WHEN split AND n = 0 THEN mid ELSE span_end END AS e
      FROM (SELECT *, (task_no + slot_pos) % 3 = 0 AND span_end - span_start >= 2 AS split, span_start + (span_end - span_start) // 2 AS mid
            FROM ir_ready WHERE binding_status = 'bound'), (VALUES (0), (1)) v(n) WHERE n = 0 OR split)""",
    "ir_ready",
)
define(
    "template",
    """
SELECT p.task_no, p.task_id, p.idx, p.text, s.slot_id FROM (
  SELECT task_no, task_id, template_version_id, unnest(t) AS text, generate_subscripts(t, 1) - 1 AS idx FROM (
    SELECT i.task_no, i.task_id, i.template_version_id, list_concat([coalesce(l[1], ''), '{{ sales_summary }}', coalesce(l[2], ''), '{{ risks }}', coalesce(l[3], ''), '{{ next_plan }}'], l[4:]) AS t
    FROM ir_tasks i JOIN (SELECT task_id, string_split(arg_min(text, doc_id), chr(10)) AS l FROM materials GROUP BY task_id) USING (task_id))) p
LEFT JOIN contract_slots s ON s.template_version_id = p.template_version_id AND s.placeholder = trim(p.text)""",
    "ir_tasks", "materials", "contract_slots",
)
define(
    "expected",
    """
SELECT t.task_no, t.task_id, t.idx, t.slot_id, v.span_no, t.first_pos, t.n_expected, t.first_pos + v.span_no AS pos,
       CASE WHEN t.slot_id IS NULL THEN t.text WHEN t.override_artifact_id IS NOT NULL THEN '' ELSE s.text END AS text
FROM (SELECT *, coalesce(sum(n_expected) OVER (PARTITION BY task_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_pos
      FROM (SELECT p.*, r.override_artifact_id, CASE WHEN p.slot_id IS NULL OR r.override_artifact_id IS NOT NULL THEN 1 ELSE coalesce(n.n, 0) END AS n_expected
            FROM template p LEFT JOIN ir_ready r ON r.task_id = p.task_id AND r.slot_id = p.slot_id
            LEFT JOIN (SELECT task_id, slot_id, count(*) AS n FROM ir_spans GROUP BY ALL) n ON n.task_id = p.task_id AND n.slot_id = p.slot_id)) t
JOIN range(1000) v(span_no) ON v.span_no < t.n_expected
LEFT JOIN ir_spans s ON s.task_id = t.task_id AND s.slot_id = t.slot_id AND s.span_no = v.span_no""",
    "template", "ir_ready", "ir_spans",
)
define(
    "candidate",
    """
SELECT e.task_no, e.task_id, e.pos, CASE WHEN e.task_no % 5 = 3 AND e.pos = 0 THEN 'Changed' WHEN e.task_no % 5 = 4 AND e.pos = 1 THEN '{{ sales_summary }}' ELSE e.text END AS text,
       CASE WHEN e.slot_id IS NOT NULL AND e.span_no = 0 AND e.task_no % 6 <> 4 THEN e.slot_id END AS bookmark
FROM expected e JOIN (SELECT task_id, max(pos) + 1 AS n FROM expected GROUP BY 1) m USING (task_id) WHERE e.task_no % 5 <> 2 OR e.pos < m.n - 2
UNION ALL
SELECT task_no, task_id, max(pos) + 1, 'Extra paragraph', NULL FROM expected WHERE task_no % 5 = 1 GROUP BY ALL""",
    "expected",
)


def renderable(spark, sf_dir) -> DataFrame:
    """Slots of the tasks whose bindings can be rendered."""
    ready, _ = gates.build_render_slots(bp.bound(spark, sf_dir), tb.contract_slots(spark), bp.overrides(spark, sf_dir))
    return session.settle(ready, "render-slots")


def ir_spans(spark, sf_dir, ready: DataFrame) -> DataFrame:
    """Spans of the bound slots; every third slot is filled from two spans."""
    start, end = F.col("span_start"), F.col("span_end")
    mid = (start + F.floor((end - start) / 2)).cast("bigint")

    def span(no, s, e):
        return F.struct(F.lit(no).cast("bigint").alias("span_no"), s.alias("s"), e.alias("e"))

    split = ((F.col("task_no") + F.col("slot_pos")) % 3 == 0) & (end - start >= 2)
    parts = F.when(split, F.array(span(0, start, mid), span(1, mid, end))).otherwise(F.array(span(0, start, end)))
    listed = ready.filter(F.col("binding_status") == "bound").select(
        "task_no", "task_id", "slot_id", "slot_pos", "artifact_id", "canonical_sha256", F.explode(parts).alias("_p")
    )
    held = tb.headed_materials(spark, sf_dir).select("artifact_id", F.col("text").alias("_text"))
    worded = listed.join(held, "artifact_id")
    piece = F.substr("_text", (F.col("_p.s") + 1).cast("int"), (F.col("_p.e") - F.col("_p.s")).cast("int"))
    return worded.select(
        "task_no", "task_id", "slot_id", "slot_pos", "artifact_id", "canonical_sha256", "_p.span_no",
        F.col("_p.s").alias("span_start"), F.col("_p.e").alias("span_end"), piece.alias("text"),
    ).withColumn("span_sha256", digest.sha(F.col("text")))


def template(spark, sf_dir, ready: DataFrame) -> DataFrame:
    """A template per task: its first document's lines with a placeholder after each of the first three."""
    lines = F.split("text", "\n")
    openings = first_rows(
        tb.materials(spark, sf_dir).select("task_id", "doc_id", "text"), ["task_id"], [F.col("doc_id")], ["text"]
    )

    def line(i):
        return F.coalesce(F.get(lines, F.lit(i)), F.lit(""))

    head = F.array(
        line(0), F.lit("{{ sales_summary }}"), line(1), F.lit("{{ risks }}"), line(2), F.lit("{{ next_plan }}")
    )
    whole = F.concat(head, F.slice(lines, F.lit(4), F.greatest(F.size(lines) - 3, F.lit(0))))
    tasks = ready.select("task_no", "task_id", "template_version_id").distinct()
    paragraphs = tasks.join(openings, "task_id").select(
        "task_no", "task_id", "template_version_id", F.posexplode(whole).alias("idx", "text")
    )
    slots = tb.contract_slots(spark).select("template_version_id", "slot_id", F.col("placeholder").alias("_placeholder"))
    marked = paragraphs.withColumn("_placeholder", F.trim("text"))
    return marked.join(slots, ["template_version_id", "_placeholder"], "left").select(
        "task_no", "task_id", F.col("idx").cast("bigint").alias("idx"), "text", "slot_id"
    )


def expected(spark, sf_dir, ready, spans) -> DataFrame:
    return gates.assemble(template(spark, sf_dir, ready), spans, ready)


def candidate(want: DataFrame) -> DataFrame:
    """Rendered documents with a flaw that depends on the task."""
    number = F.substring("task_id", 6, 32).cast("bigint")
    placed = want.filter(F.col("pos").isNotNull()).withColumn("_no", number)
    sizes = placed.groupBy("task_id").agg((F.max("pos") + 1).alias("_n"))
    kept = placed.join(sizes, "task_id").filter((F.col("_no") % 5 != 2) | (F.col("pos") < F.col("_n") - 2))
    text = (
        F.when((F.col("_no") % 5 == 3) & (F.col("pos") == 0), "Changed")
        .when((F.col("_no") % 5 == 4) & (F.col("pos") == 1), "{{ sales_summary }}")
        .otherwise(F.col("text"))
    )
    anchored = F.col("slot_id").isNotNull() & (F.col("span_no") == 0) & (F.col("_no") % 6 != 4)
    bookmarks = F.when(anchored, F.array("slot_id")).otherwise(F.array().cast("array<string>"))
    extra = sizes.filter(number % 5 == 1).select(
        "task_id", F.col("_n").alias("pos"), F.lit("Extra paragraph").alias("text"),
        F.array().cast("array<string>").alias("bookmarks"),
    )
    return kept.select("task_id", "pos", text.alias("text"), bookmarks.alias("bookmarks")).unionByName(extra)


define(
    "flawed",
    """
SELECT * FROM (SELECT f.task_id, f.slot_id, f.slot_pos, CASE WHEN f.slot_id = 'appendix' THEN 'unknown slot' WHEN f.binding_status = 'invalid' THEN 'invalid binding'
   WHEN f.binding_status = 'missing' AND o.slot_id IS NULL THEN 'still missing' END AS trouble
FROM flawed_bindings f LEFT JOIN overrides o ON o.task_id = f.task_id AND o.epoch = f.epoch AND o.slot_id = f.slot_id) WHERE trouble IS NOT NULL""",
    "flawed_bindings", "overrides",
)
@query(
    "build_assembly",
    stating(
        "flawed",
        """
SELECT f.task_id, f.slot_id, f.style_key, f.artifact_id, CASE WHEN f.binding_status = 'missing' THEN o.reason_artifact_id END AS override_artifact_id, NULL AS problem
FROM flawed_bindings f LEFT JOIN overrides o ON o.task_id = f.task_id AND o.epoch = f.epoch AND o.slot_id = f.slot_id
WHERE f.task_id NOT IN (SELECT task_id FROM flawed) UNION ALL
SELECT task_id, NULL, NULL, NULL, NULL, coalesce(arg_min(trouble || ': ' || slot_id, slot_pos) FILTER (trouble <> 'still missing'),
       'still missing: ' || string_agg(slot_id, ', ' ORDER BY slot_id)) FROM flawed GROUP BY task_id""",
    ),
)
def build_assembly(spark, sf_dir):
    number = F.col("task_no")
    flawed = bp.bound(spark, sf_dir).withColumn(
        "slot_id", F.when((number % 13 == 12) & (F.col("slot_pos") == 2), "appendix").otherwise(F.col("slot_id"))
    ).withColumn(
        "binding_status", F.when((number + F.col("slot_pos")) % 11 == 10, "invalid").otherwise(F.col("binding_status"))
    )
    ready, refused = gates.build_render_slots(flawed, tb.contract_slots(spark), bp.overrides(spark, sf_dir))
    nothing = F.lit(None).cast("string")
    return ready.select(
        "task_id", "slot_id", "style_key", "artifact_id", "override_artifact_id", nothing.alias("problem")
    ).unionByName(
        refused.select(
            "task_id", nothing.alias("slot_id"), nothing.alias("style_key"), nothing.alias("artifact_id"),
            nothing.alias("override_artifact_id"), "problem",
        )
    )


@query(
    "assembled_sequence",
    stating("expected", "SELECT task_id, pos, idx, slot_id, sha256(text) AS text_sha256 FROM expected"),
)
def assembled_sequence(spark, sf_dir):
    ready = renderable(spark, sf_dir)
    want = expected(spark, sf_dir, ready, ir_spans(spark, sf_dir, ready)).filter(F.col("pos").isNotNull())
    return want.select("task_id", "pos", "idx", "slot_id", digest.sha(F.col("text")).alias("text_sha256"))


@query(
    "paragraph_diff",
    """
SELECT doc_id, verdict, count(*) AS n, min(pos) AS first_pos FROM (
  SELECT coalesce(e.doc_id, c.doc_id) AS doc_id, coalesce(e.pos, c.pos) AS pos,
         CASE WHEN c.pos IS NULL THEN 'ended' WHEN e.pos IS NULL THEN 'extra' WHEN e.line = c.line THEN 'same' ELSE 'changed' END AS verdict
  FROM (SELECT d.doc_id, generate_subscripts(string_split(h.text, chr(10)), 1) - 1 AS pos, unnest(string_split(h.text, chr(10))) AS line
        FROM documents d JOIN (SELECT string_split(text, chr(10))[1] AS title, min(doc_id) AS head_id, arg_min(text, doc_id) AS text FROM documents GROUP BY 1) h
          ON h.title = string_split(d.text, chr(10))[1] WHERE d.doc_id > h.head_id) e
  FULL OUTER JOIN (SELECT d.doc_id, generate_subscripts(string_split(d.text, chr(10)), 1) - 1 AS pos, unnest(string_split(d.text, chr(10))) AS line
        FROM documents d JOIN (SELECT string_split(text, chr(10))[1] AS title, min(doc_id) AS head_id FROM documents GROUP BY 1) h
          ON h.title = string_split(d.text, chr(10))[1] WHERE d.doc_id > h.head_id) c ON e.doc_id = c.doc_id AND e.pos = c.pos)
GROUP BY doc_id, verdict""",
)
def paragraph_diff(spark, sf_dir):
    """Every document against the first one with the same title line, never all pairs."""
    docs = tb.read(spark, sf_dir, "documents").select(
        "doc_id", "text", digest.sha(F.substring_index("text", "\n", 1)).alias("title")
    )
    # One head per title; a title with very many documents is split by the join, not gathered.
    heads = first_rows(docs, ["title"], [F.col("doc_id")], ["doc_id", "text"])
    pairs = docs.select("doc_id", "title", F.col("text").alias("actual")).join(
        heads.select("title", F.col("doc_id").alias("head_id"), F.col("text").alias("expected")), "title"
    )
    return gates.document_diff(pairs.filter(F.col("doc_id") > F.col("head_id")), "doc_id")


define(
    "parts_diff",
    """
SELECT task_id, part, CASE WHEN part = 'footer2' THEN 'part not in template: footer2' ELSE 'part ' || part || ' is not the template''s text' END AS message
FROM (SELECT task_id, 'header1' AS part FROM ir_tasks WHERE task_no % 8 = 5 UNION ALL SELECT task_id, 'footer1' FROM ir_tasks WHERE task_no % 7 = 3
      UNION ALL SELECT task_id, 'footer2' FROM ir_tasks WHERE task_no % 9 = 4)""",
    "ir_tasks",
)


def parts(want: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Header and footer texts of templates and of rendered documents."""
    number = F.substring("task_id", 6, 32).cast("bigint")
    tasks = want.select("task_id").distinct()

    def part(rows, name, text):
        return rows.select("task_id", F.lit(name).alias("part"), text.alias("text"))

    fixed = F.concat(F.lit("Report of "), F.col("task_id"))
    mine = part(tasks, "header1", fixed).unionByName(part(tasks, "footer1", F.lit("Page")))
    theirs = (
        part(tasks, "header1", F.when(number % 8 == 5, F.lit("Other")).otherwise(fixed))
        .unionByName(part(tasks.filter(number % 7 != 3), "footer1", F.lit("Page")))
        .unionByName(part(tasks.filter(number % 9 == 4), "footer2", F.lit("New {{ page }}")))
    )
    return mine, theirs


@query("part_diff", stating("parts_diff", "SELECT * FROM parts_diff"))
def part_diff(spark, sf_dir):
    return gates.part_problems(*parts(renderable(spark, sf_dir)))


define(
    "placed",
    """
SELECT e.task_no, e.task_id, e.slot_id, count(*) AS expected, count(*) FILTER (e.pos < n.n) AS found, min(e.pos) FILTER (e.pos < n.n) AS first_found, max(e.pos) FILTER (e.pos < n.n) AS last_found
FROM expected e JOIN (SELECT task_id, count(*) AS n FROM candidate GROUP BY 1) n USING (task_id) WHERE e.slot_id IS NOT NULL GROUP BY ALL""",
    "expected", "candidate",
)


def rendered(spark, sf_dir, ready: DataFrame | None = None):
    """(slots, spans, expected paragraphs, candidate paragraphs) of the renderable tasks."""
    ready = renderable(spark, sf_dir) if ready is None else ready
    spans = session.settle(ir_spans(spark, sf_dir, ready), "render-spans")
    want = session.settle(expected(spark, sf_dir, ready, spans), "expected")
    return ready, spans, want, candidate(want)


@query("slot_placement", stating("placed", "SELECT task_id, slot_id, found, expected, first_found, last_found FROM placed"))
def slot_placement(spark, sf_dir):
    _, _, want, have = rendered(spark, sf_dir)
    return gates.placements(want, have)


_RESIDUE = """
SELECT task_id, 'document' AS part, min(pos) AS pos, arg_min(text, pos) AS text FROM candidate WHERE contains(text, '{{') OR contains(text, '{%') GROUP BY task_id
UNION ALL SELECT task_id, 'footer2', 0, 'New {{ page }}' FROM ir_tasks WHERE task_no % 9 = 4
   AND NOT EXISTS (SELECT 1 FROM candidate c WHERE c.task_id = ir_tasks.task_id AND (contains(text, '{{') OR contains(text, '{%')))"""


@query("placeholder_residue", stating("candidate ir_tasks", _RESIDUE))
def placeholder_residue(spark, sf_dir):
    ready, _, _, have = rendered(spark, sf_dir)
    return gates.residue(have, parts(ready)[1])


_ANCHORS = """
SELECT p.task_id, p.slot_id, p.slot_id || ': anchor ' || p.slot_id || ' missing on output' AS message FROM placed p
JOIN candidate c ON c.task_id = p.task_id AND c.pos = p.first_found WHERE c.bookmark IS NULL OR c.bookmark <> p.slot_id"""


@query("anchor_check", stating("placed", _ANCHORS))
def anchor_check(spark, sf_dir):
    ready, _, want, have = rendered(spark, sf_dir)
    anchors = ready.select("task_id", "slot_id", F.col("slot_id").alias("bookmark_id"))
    return gates.anchor_problems(gates.placements(want, have), have, anchors)


@query(
    "region_digest",
    """
SELECT doc_id, region_id, sha256(string_agg(stream, chr(29) ORDER BY idx)) AS text_sha256, sum(n)::BIGINT AS token_count FROM (
  SELECT doc_id, 'r' || (idx // 4)::VARCHAR AS region_id, idx, len(string_split(line, ' ')) AS n,
         array_to_string(list_transform(string_split(line, ' '), lambda w, i: CASE WHEN (i - 1) % 5 = 4 THEN 'tab' WHEN (i - 1) % 7 = 6 THEN 'br' ELSE 't' || chr(31) || w END || chr(30)), '') AS stream
  FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx, unnest(string_split(text, chr(10))) AS line FROM documents))
GROUP BY doc_id, region_id""",
)
def region_digest(spark, sf_dir):
    def token(word, i):
        kind = F.when(i % 5 == 4, "tab").when(i % 7 == 6, "break").otherwise("text")
        return F.struct(kind.alias("kind"), F.when(kind == "text", word).alias("text"))

    lines = tb.read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("idx", "line")
    )
    paragraphs = lines.select("doc", "idx", F.transform(F.split("line", " "), token).alias("tokens"))
    members = lines.select("doc", F.concat(F.lit("r"), F.floor(F.col("idx") / 4).cast("string")).alias("region_id"), "idx")
    return gates.region_digests(paragraphs, members).withColumnRenamed("doc", "doc_id")


_DRIFT = """
SELECT task_id, 'r' || idx::VARCHAR AS region_id, CASE WHEN idx = 2 THEN 'region r2 is not in the contract' ELSE 'region r0 has another digest' END AS message
FROM template WHERE (idx = 0 AND task_no % 12 = 7) OR (idx = 2 AND task_no % 12 = 8)"""


def regions(paragraphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every paragraph of each template as a region, recomputed and as the contract has them."""
    token = F.struct(F.lit("text").alias("kind"), F.col("text").alias("text"))
    rows = paragraphs.select(F.col("task_id").alias("doc"), "idx", F.array(token).alias("tokens"))
    members = rows.select("doc", F.concat(F.lit("r"), F.col("idx").cast("string")).alias("region_id"), "idx")
    recomputed = gates.region_digests(rows, members).withColumnRenamed("doc", "task_id")
    number = F.substring("task_id", 6, 32).cast("bigint")
    recorded = recomputed.filter((F.col("region_id") != "r2") | (number % 12 != 8)).withColumn(
        "text_sha256",
        F.when((F.col("region_id") == "r0") & (number % 12 == 7), digest.sha(F.lit("older"))).otherwise(F.col("text_sha256")),
    )
    return recomputed, recorded


@query("region_integrity", stating("template", _DRIFT))
def region_integrity(spark, sf_dir):
    return gates.region_problems(*regions(template(spark, sf_dir, renderable(spark, sf_dir))))


define(
    "sequence_messages",
    """
SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY place, step, part, message) AS n FROM (
  SELECT e.task_id, e.pos AS place, 0 AS step, '' AS part, CASE WHEN e.slot_id IS NULL THEN 'static paragraph ' || e.pos::VARCHAR || ' changed'
         ELSE 'slot ' || e.slot_id || ' paragraph ' || e.pos::VARCHAR || ' mismatch' END AS message
  FROM expected e JOIN candidate c ON c.task_id = e.task_id AND c.pos = e.pos WHERE c.text <> e.text
  UNION ALL
  SELECT DISTINCT e.task_id, n.n, 2, '', 'candidate ends within slot ' || e.slot_id FROM expected e JOIN (SELECT task_id, count(*) AS n FROM candidate GROUP BY 1) n USING (task_id)
  WHERE e.slot_id IS NOT NULL AND e.first_pos < n.n AND e.first_pos + e.n_expected > n.n
  UNION ALL
  SELECT e.task_id, n.n, 3, '', 'template left over from paragraph ' || min(e.idx)::VARCHAR FROM expected e JOIN (SELECT task_id, count(*) AS n FROM candidate GROUP BY 1) n USING (task_id)
  WHERE e.first_pos >= n.n GROUP BY e.task_id, n.n
  UNION ALL
  SELECT task_id, max(pos), 4, '', 'candidate has 1 more paragraph(s) than expected' FROM candidate WHERE task_no % 5 = 1 GROUP BY task_id
  UNION ALL
  SELECT task_id, 4611686018427387904, 5, part, message FROM parts_diff)""",
    "expected", "candidate", "parts_diff",
)
define(
    "gate_b",
    f"""
SELECT task_id, 'content_sequence' AS check_id, (SELECT string_agg(message, '; ' ORDER BY n) FROM sequence_messages s WHERE s.task_id = t.task_id AND n <= 5) AS problem, 'document' AS locator, NULL AS expected, NULL AS shown FROM ir_tasks t
UNION ALL
SELECT task_id, 'slot_placement:' || slot_id, CASE WHEN found <> expected THEN found::VARCHAR END, coalesce('paragraphs ' || first_found::VARCHAR || ' to ' || last_found::VARCHAR, 'no paragraph'), expected::VARCHAR || ' paragraph(s)', found::VARCHAR FROM placed
UNION ALL
SELECT t.task_id, 'placeholder_residue', r.part || ':' || substring(r.text, 1, 50), NULL, NULL, NULL FROM ir_tasks t LEFT JOIN ({_RESIDUE}) r USING (task_id)
UNION ALL
SELECT task_id, 'unsupported_containers', CASE WHEN task_no % 10 = 9 THEN 'UNSUPPORTED_FIELD@word/document.xml:fldSimple; UNSUPPORTED_REVISION@word/document.xml:ins' END, NULL, NULL, NULL FROM ir_tasks
UNION ALL
SELECT task_id, 'anchors', (SELECT string_agg(message, '; ' ORDER BY slot_id) FROM ({_ANCHORS}) a WHERE a.task_id = t.task_id), NULL, NULL, NULL FROM ir_tasks t
UNION ALL
SELECT task_id, 'static_region_integrity', (SELECT string_agg(message, '; ' ORDER BY region_id) FROM ({_DRIFT}) d WHERE d.task_id = t.task_id), NULL, NULL, NULL FROM ir_tasks t""",
    "ir_tasks", "sequence_messages", "placed", "template",
)


def gate_b_findings(spark, sf_dir, ready: DataFrame | None = None) -> DataFrame:
    ready, _, want, have = rendered(spark, sf_dir, ready)
    number = F.substring("task_id", 6, 32).cast("bigint")
    tasks = ready.select("task_id").distinct()
    anchors = ready.select("task_id", "slot_id", F.col("slot_id").alias("bookmark_id"))
    found = F.array(
        F.struct(F.lit("UNSUPPORTED_FIELD").alias("code"), F.lit("word/document.xml:fldSimple").alias("locator")),
        F.struct(F.lit("UNSUPPORTED_REVISION").alias("code"), F.lit("word/document.xml:ins").alias("locator")),
    )
    unsupported = tasks.filter(number % 10 == 9).select("task_id", F.inline(found))
    return gates.gate_b(
        tasks, want, have, *parts(tasks), anchors, unsupported, *regions(template(spark, sf_dir, ready))
    )


_FINDING = """
SELECT '{gate}' AS gate, task_id, check_id, CASE WHEN problem IS NULL THEN 'pass' ELSE 'fail' END AS status, TRUE AS required, locator, expected, coalesce(shown, problem) AS actual FROM {name}"""


@query("gate_b", stating("gate_b", _FINDING.format(gate="provenance_gate", name="gate_b")))
def gate_b(spark, sf_dir):
    return gate_b_findings(spark, sf_dir)


# Gate A


define(
    "a_spans",
    """
SELECT s.task_no, s.task_id, s.slot_id, s.slot_pos, s.span_no,
       CASE WHEN s.task_no % 7 = 2 AND s.slot_pos = 0 THEN 'art_' || lpad(((s.task_no + 1) * 20)::VARCHAR, 32, '0') ELSE s.artifact_id END AS artifact_id,
       CASE WHEN s.task_no % 7 = 3 AND s.slot_pos = 1 THEN sha256('drift') ELSE s.canonical_sha256 END AS canonical_sha256,
       s.span_start, s.span_end, CASE WHEN s.task_no % 7 = 4 AND s.slot_pos = 2 THEN sha256('forged') ELSE s.span_sha256 END AS span_sha256
FROM ir_spans s""",
    "ir_spans",
)
define("registered", "SELECT *, sha256(text) AS sha256 FROM headed", "headed")
define(
    "a_scope",
    """
SELECT * FROM (SELECT a.task_id, a.slot_id, a.span_no, CASE WHEN r.artifact_id IS NULL THEN a.artifact_id || ': not registered'
   WHEN r.task_id <> a.task_id THEN a.artifact_id || ': held by task ' || r.task_id WHEN r.sha256 <> a.canonical_sha256 THEN a.artifact_id || ': text has changed' END AS message
FROM a_spans a LEFT JOIN registered r USING (artifact_id)) WHERE message IS NOT NULL""",
    "a_spans", "registered",
)
define(
    "a_verify",
    """
SELECT * FROM (SELECT a.task_id, a.slot_id, a.span_no, CASE WHEN r.sha256 <> a.canonical_sha256 THEN a.artifact_id || ': hash differs from the bound one'
   WHEN sha256(substring(r.text, a.span_start + 1, a.span_end - a.span_start)) <> a.span_sha256 THEN '[' || a.span_start::VARCHAR || ',' || a.span_end::VARCHAR || '): span text has changed' END AS message
FROM a_spans a JOIN registered r USING (artifact_id)) WHERE message IS NOT NULL""",
    "a_spans", "registered",
)
define(
    "a_regions",
    """
SELECT task_no, task_id, template_version_id, region_id, CASE WHEN region_id = 'r0' AND task_no % 10 = 7 THEN 'tver_' || repeat('f', 32) ELSE template_version_id END AS ref_version
FROM ir_tasks, (VALUES ('r0'), ('r1'), ('r2'), ('r9')) v(region_id) WHERE CASE region_id WHEN 'r1' THEN task_no % 5 <> 2 WHEN 'r9' THEN task_no % 5 = 4 ELSE TRUE END AND task_no % 9 <> 4""",
    "ir_tasks",
)
define(
    "a_coverage",
    """
SELECT task_id, 0 AS kind, region_id, 'region ' || region_id || ': of another template version' AS message FROM a_regions WHERE ref_version <> template_version_id
UNION ALL SELECT task_id, 1, c.region_id, 'region left out: ' || c.region_id FROM ir_tasks t, (VALUES ('r0'), ('r1'), ('r2')) c(region_id)
   WHERE NOT EXISTS (SELECT 1 FROM a_regions a WHERE a.task_id = t.task_id AND a.region_id = c.region_id)
UNION ALL SELECT task_id, 2, region_id, 'region not in contract: ' || region_id FROM a_regions WHERE region_id NOT IN ('r0', 'r1', 'r2')""",
    "a_regions", "ir_tasks",
)
define(
    "a_override",
    """
SELECT task_id, slot_id, CASE WHEN task_no % 20 = 13 THEN 'no omission recorded in this epoch'
   WHEN task_no % 20 = 3 AND NOT EXISTS (SELECT 1 FROM materials m WHERE m.doc_id = (i.task_no + 1) * 20) THEN 'omission artifact unknown'
   WHEN task_no % 20 = 3 THEN 'omission artifact held by task_' || lpad((task_no + 1)::VARCHAR, 32, '0') END AS message
FROM ir_ready i WHERE override_artifact_id IS NOT NULL""",
    "ir_ready", "materials",
)
define(
    "a_fresh",
    """
SELECT t.task_no, t.task_id, d.live, CASE WHEN t.task_no % 6 = 1 THEN sha256('stale') ELSE d.live END AS held
FROM ir_tasks t JOIN (SELECT task_id, sha256(string_agg(artifact_id || ':' || sha256, chr(10) ORDER BY artifact_id)) AS live FROM registered GROUP BY 1) d USING (task_id)""",
    "ir_tasks", "registered",
)
define(
    "gate_a",
    """
SELECT task_id, 'template_identity' AS check_id, CASE WHEN task_no % 13 = 6 THEN 'task bound to ' || template_version_id || ', IR targets tver_' || repeat('9', 32)
   WHEN task_no % 13 = 7 THEN 'template version ' || template_version_id || ' not registered' WHEN task_no % 13 = 8 THEN 'contract docx hash differs from the registered template version' END AS problem,
   'task/ir/binding/contract' AS locator, NULL AS expected, NULL AS shown FROM ir_tasks
UNION ALL
SELECT task_id, 'epoch_match', CASE WHEN task_no % 11 = 5 THEN 'x' END, NULL, 'epoch ' || epoch::VARCHAR, 'ir=' || (epoch + CASE WHEN task_no % 11 = 5 THEN 1 ELSE 0 END)::VARCHAR || ', binding=' || epoch::VARCHAR FROM ir_tasks
UNION ALL
SELECT task_id, 'scope:' || slot_id, (SELECT string_agg(message, '; ' ORDER BY span_no) FROM a_scope s WHERE s.task_id = r.task_id AND s.slot_id = r.slot_id), 'slot ' || slot_id, NULL, NULL FROM ir_ready r
UNION ALL
SELECT task_id, 'spans:' || slot_id, (SELECT string_agg(message, '; ' ORDER BY span_no) FROM a_verify s WHERE s.task_id = r.task_id AND s.slot_id = r.slot_id), 'slot ' || slot_id, NULL, NULL FROM ir_ready r WHERE binding_status = 'bound'
UNION ALL
SELECT task_id, 'binding_freshness', CASE WHEN live <> held THEN 'x' END, NULL, substring(held, 1, 12), substring(live, 1, 12) FROM a_fresh
UNION ALL
SELECT task_id, 'static_regions', (SELECT string_agg(message, '; ' ORDER BY kind, message) FROM a_coverage c WHERE c.task_id = t.task_id), NULL, NULL, NULL FROM ir_tasks t
UNION ALL
SELECT task_id, 'override:' || slot_id, message, 'slot ' || slot_id, NULL, NULL FROM a_override
UNION ALL
SELECT task_id, 'producer_profile', CASE WHEN task_no % 9 = 8 THEN 'viz producers: sales_summary' END, NULL, NULL, NULL FROM ir_tasks""",
    "ir_tasks", "ir_ready", "a_scope", "a_verify", "a_fresh", "a_coverage", "a_override",
)


class Precheck:
    """The tables gate A looks at, with a flaw per task number."""

    def __init__(self, spark, sf_dir, whole: bool = True, ready: DataFrame | None = None):
        number = F.col("task_no")
        ready = renderable(spark, sf_dir) if ready is None else ready
        self.artifacts = tb.hashed(tb.headed_materials(spark, sf_dir))
        spans = ir_spans(spark, sf_dir, ready)
        self.spans = spans.select(
            "task_no", "task_id", "slot_id", "span_no", "span_start", "span_end",
            F.when((number % 7 == 2) & (F.col("slot_pos") == 0), tb.padded_id("art", (number + 1) * tb.TASK_SIZE))
            .otherwise(F.col("artifact_id")).alias("artifact_id"),
            F.when((number % 7 == 3) & (F.col("slot_pos") == 1), digest.sha(F.lit("drift")))
            .otherwise(F.col("canonical_sha256")).alias("canonical_sha256"),
            F.when((number % 7 == 4) & (F.col("slot_pos") == 2), digest.sha(F.lit("forged")))
            .otherwise(F.col("span_sha256")).alias("span_sha256"),
        )
        if whole:
            self.spans = session.settle(self.spans, "gate-a-spans")
        self.slots = ready.withColumn(
            "override_artifact_id",
            F.when(
                F.col("override_artifact_id").isNotNull() & (number % 20 == 3), tb.padded_id("art", (number + 1) * tb.TASK_SIZE)
            ).otherwise(F.col("override_artifact_id")),
        )
        self.tasks = ready.select("task_no", "task_id", "epoch", "template_version_id").distinct()
        self.overrides = bp.overrides(spark, sf_dir).filter(F.substring("task_id", 6, 32).cast("bigint") % 20 != 13)
        names = F.array(*[F.lit(r) for r in ("r0", "r1", "r2", "r9")])
        listed = self.tasks.select("task_no", "task_id", "template_version_id", F.explode(names).alias("region_id"))
        region = F.col("region_id")
        self.regions = listed.filter(
            ((region != "r1") | (number % 5 != 2)) & ((region != "r9") | (number % 5 == 4)) & (number % 9 != 4)
        ).withColumn(
            "ref_version",
            F.when((region == "r0") & (number % 10 == 7), F.lit("tver_" + "f" * 32)).otherwise(F.col("template_version_id")),
        )
        self.contract_regions = tb.literal(
            spark, [(f"tver_{v:032d}", f"r{i}") for v in range(3) for i in range(3)], "template_version_id string, region_id string"
        )
        live = mat.set_digests(self.artifacts).select("task_id", "set_digest")
        target = F.when(number % 13 == 6, F.lit("tver_" + "9" * 32)).otherwise(F.col("template_version_id"))
        self.irs = self.tasks.join(live, "task_id").select(
            "task_no", "task_id", target.alias("ir_version"),
            (F.col("epoch") + F.when(number % 11 == 5, 1).otherwise(0)).alias("ir_epoch"),
            F.col("template_version_id").alias("binding_version_id"), F.col("epoch").alias("binding_epoch"),
            F.when(number % 6 == 1, digest.sha(F.lit("stale"))).otherwise(F.col("set_digest")).alias("binding_digest"),
            (number % 13 != 7).alias("registered"), (number % 13 != 8).alias("docx_matches"),
            F.when(number % 9 == 8, F.array(F.lit("sales_summary"))).otherwise(F.array().cast("array<string>")).alias("viz_slots"),
        )

    def findings(self) -> DataFrame:
        return gates.gate_a(
            self.tasks, self.irs, self.slots, self.spans, self.regions, self.contract_regions, self.artifacts, self.overrides
        )


@query("gate_a", stating("gate_a", _FINDING.format(gate="provenance_precheck", name="gate_a")))
def gate_a(spark, sf_dir):
    return Precheck(spark, sf_dir).findings()


@query("artifact_scope", stating("a_scope", "SELECT * FROM a_scope"))
def artifact_scope(spark, sf_dir):
    table = Precheck(spark, sf_dir, whole=False)
    return gates.scope_problems(table.spans, table.artifacts)


@query("static_coverage", stating("a_coverage", "SELECT * FROM a_coverage"))
def static_coverage(spark, sf_dir):
    table = Precheck(spark, sf_dir, whole=False)
    return gates.coverage_problems(table.regions, table.contract_regions, table.tasks)


@query("override_check", stating("a_override", "SELECT * FROM a_override"))
def override_check(spark, sf_dir):
    table = Precheck(spark, sf_dir, whole=False)
    return gates.override_problems(table.slots, table.tasks, table.overrides, table.artifacts)


@query("material_set_equal", stating("a_fresh", "SELECT task_id, live = held AS fresh, live AS live_digest, held AS binding_digest FROM a_fresh"))
def material_set_equal(spark, sf_dir):
    table = Precheck(spark, sf_dir, whole=False)
    live = mat.set_digests(table.artifacts).select("task_id", F.col("set_digest").alias("live_digest"))
    return table.irs.join(live, "task_id").select(
        "task_id", (F.col("live_digest") == F.col("binding_digest")).alias("fresh"), "live_digest", "binding_digest"
    )


_ALL_FINDINGS = f"{_FINDING.format(gate='provenance_precheck', name='gate_a')} UNION ALL {_FINDING.format(gate='provenance_gate', name='gate_b')}"


def both_gates(spark, sf_dir) -> DataFrame:
    ready = renderable(spark, sf_dir)
    return fd.union_all([Precheck(spark, sf_dir, ready=ready).findings(), gate_b_findings(spark, sf_dir, ready)])


@query("findings_union", stating("gate_a gate_b", f"SELECT gate, check_id, status, count(*) AS n FROM ({_ALL_FINDINGS}) GROUP BY ALL"))
def findings_union(spark, sf_dir):
    return both_gates(spark, sf_dir).groupBy("gate", "check_id", "status").agg(F.count("*").alias("n"))


@query(
    "gate_status",
    stating(
        "gate_a gate_b",
        f"""
SELECT gate, task_id, CASE WHEN bool_or(status = 'fail') THEN 'fail' ELSE 'pass' END AS overall_status, count(*) FILTER (status = 'fail') AS n_fail, 0 AS n_unknown, count(*) AS n_checks
FROM ({_ALL_FINDINGS}) GROUP BY ALL""",
    ),
)
def gate_status(spark, sf_dir):
    return fd.overall(both_gates(spark, sf_dir))


@query(
    "finding_messages",
    stating(
        "gate_a",
        """
SELECT task_id, count(*) AS n_messages, string_agg(message, '; ' ORDER BY n) FILTER (n <= 5) AS messages
FROM (SELECT task_id, check_id || ': ' || coalesce(shown, problem) AS message, row_number() OVER (PARTITION BY task_id ORDER BY check_id) AS n FROM gate_a WHERE problem IS NOT NULL) GROUP BY task_id""",
    ),
)
def finding_messages(spark, sf_dir):
    failed = Precheck(spark, sf_dir).findings().filter(F.col("status") == "fail")
    worded = failed.withColumn("message", F.concat_ws(": ", "check_id", "actual"))
    return fd.joined_messages(worded, ["task_id"], "check_id", "message", 5)


# Delivery


define(
    "irs",
    """
SELECT task_no, task_id, epoch + CASE WHEN task_no % 8 = 7 THEN 1 ELSE 0 END AS ir_epoch, CASE WHEN task_no % 11 = 10 THEN 'tver_' || repeat('9', 32) ELSE template_version_id END AS ir_version,
       sha256('ir' || task_id) AS render_ir_sha256, sha256('doc' || task_id) AS candidate_sha256 FROM tasks""",
    "tasks",
)
define(
    "reports",
    """
SELECT task_id, ['provenance_precheck', 'provenance_gate', 'format_gate'][g + 1] AS gate, g, CASE WHEN (task_no + g) % 9 = 8 THEN 'fail' WHEN (task_no + g) % 9 = 7 THEN 'unknown' ELSE 'pass' END AS overall_status,
       CASE WHEN (task_no + 2 * g) % 21 = 10 THEN sha256('x') ELSE render_ir_sha256 END AS render_ir_sha256, CASE WHEN (task_no + g) % 24 = 13 THEN 'tver_' || repeat('8', 32) ELSE ir_version END AS template_version_id,
       CASE WHEN (task_no + 3 * g) % 22 = 11 THEN sha256('y') ELSE candidate_sha256 END AS candidate_sha256
FROM irs, (VALUES (0), (1), (2)) v(g) WHERE (task_no + g) % 10 <> 9""",
    "irs",
)
define(
    "subject_problems",
    """
SELECT task_id, gate_no, gate, row_number() OVER (PARTITION BY task_id, gate ORDER BY k) - 1 AS problem_no, gate || ': ' || what AS problem FROM (
  SELECT i.task_id, v.g AS gate_no, v.gate, unnest([
     {'k': 0, 'what': CASE WHEN r.gate IS NULL THEN 'report missing' END}, {'k': 1, 'what': CASE WHEN r.overall_status <> 'pass' THEN r.overall_status END},
     {'k': 2, 'what': CASE WHEN r.gate IS NOT NULL AND (r.render_ir_sha256 = i.render_ir_sha256) IS NOT TRUE THEN 'judged another rendering plan' END},
     {'k': 3, 'what': CASE WHEN r.gate IS NOT NULL AND (r.template_version_id = i.ir_version) IS NOT TRUE THEN 'judged another template version' END},
     {'k': 4, 'what': CASE WHEN r.gate IS NOT NULL AND v.g > 0 AND (r.candidate_sha256 = i.candidate_sha256) IS NOT TRUE THEN 'judged another output' END}], recursive := true)
  FROM irs i, (VALUES (0, 'provenance_precheck'), (1, 'provenance_gate'), (2, 'format_gate')) v(g, gate) LEFT JOIN reports r ON r.task_id = i.task_id AND r.gate = v.gate)
WHERE what IS NOT NULL""",
    "irs", "reports",
)
define(
    "finals",
    """
SELECT task_no, task_id, outcome, CASE WHEN outcome = 'gates_failed' THEN problems END AS gate_problems,
       CASE outcome WHEN 'already_delivered' THEN 'dlv_' || lpad(task_no::VARCHAR, 32, '0')
            WHEN 'delivered' THEN 'dlv_' || substring(sha256(concat_ws(':', task_id, ir_epoch::VARCHAR, 'finalize', sha256(candidate_sha256 || chr(31) || render_ir_sha256), 'provena/1')), 1, 32) END AS delivery_id
FROM (SELECT i.*, CASE WHEN t.status = 'cancelled' THEN 'cancelled' WHEN t.epoch <> i.ir_epoch THEN 'stale_ir' WHEN t.template_version_id <> i.ir_version THEN 'template_changed'
        WHEN p.problems IS NOT NULL THEN 'gates_failed' WHEN t.task_no % 5 = 0 THEN 'already_delivered' ELSE 'delivered' END AS outcome, p.problems
      FROM irs i JOIN tasks t USING (task_id) LEFT JOIN (SELECT task_id, string_agg(problem, '; ' ORDER BY gate_no, problem_no) AS problems FROM subject_problems GROUP BY 1) p USING (task_id))""",
    "irs", "tasks", "subject_problems",
)


def deliveries_input(spark, sf_dir):
    """(tasks, IRs, gate reports, deliveries made before) of every task."""
    tasks, number = tb.tasks(spark, sf_dir), F.col("task_no")
    irs = tasks.select(
        "task_no", "task_id", (F.col("epoch") + F.when(number % 8 == 7, 1).otherwise(0)).alias("ir_epoch"),
        F.when(number % 11 == 10, F.lit("tver_" + "9" * 32)).otherwise(F.col("template_version_id")).alias("ir_version"),
        digest.sha(F.concat(F.lit("ir"), "task_id")).alias("render_ir_sha256"),
        digest.sha(F.concat(F.lit("doc"), "task_id")).alias("candidate_sha256"),
    )
    g = F.col("g")
    each = irs.select("*", F.posexplode(F.array(*[F.lit(n) for n in gates.REQUIRED_GATES])).alias("g", "gate"))
    reports = each.filter((number + g) % 10 != 9).select(
        "task_id", "gate",
        F.when((number + g) % 9 == 8, "fail").when((number + g) % 9 == 7, "unknown").otherwise("pass").alias("overall_status"),
        F.when((number + 2 * g) % 21 == 10, digest.sha(F.lit("x"))).otherwise(F.col("render_ir_sha256")).alias("render_ir_sha256"),
        F.when((number + g) % 24 == 13, F.lit("tver_" + "8" * 32)).otherwise(F.col("ir_version")).alias("template_version_id"),
        F.when((number + 3 * g) % 22 == 11, digest.sha(F.lit("y"))).otherwise(F.col("candidate_sha256")).alias("candidate_sha256"),
    )
    done = tasks.filter(number % 5 == 0).select("task_id", tb.padded_id("dlv", number).alias("delivery_id"))
    return tasks, irs, reports, done


@query("gate_subjects", stating("subject_problems", "SELECT task_id, gate_no, gate, problem_no, problem FROM subject_problems"))
def gate_subjects(spark, sf_dir):
    _, irs, reports, _ = deliveries_input(spark, sf_dir)
    return gates.subject_problems(irs, reports)


@query("finalize_deliveries", stating("finals", "SELECT task_id, outcome, gate_problems, delivery_id FROM finals"))
def finalize_deliveries(spark, sf_dir):
    return gates.finalize(*deliveries_input(spark, sf_dir))


@query(
    "delivery_manifest",
    stating(
        "finals reports overrides materials",
        """
SELECT f.delivery_id, f.task_id, t.epoch, t.template_version_id, i.candidate_sha256, (SELECT count(*) FROM materials m WHERE m.task_id = f.task_id) AS n_materials,
       (SELECT sha256(string_agg(artifact_id || ':' || sha256(text) || ':' || CASE WHEN doc_id % 7 = 3 THEN 'research' ELSE 'material' END, chr(10) ORDER BY artifact_id)) FROM materials m WHERE m.task_id = f.task_id) AS materials_digest,
       (SELECT string_agg(gate || '=' || overall_status || '=rules/' || (g + 1)::VARCHAR, ',' ORDER BY gate) FROM reports r WHERE r.task_id = f.task_id) AS gates,
       (SELECT string_agg(slot_id || '=' || decision_id, ',' ORDER BY slot_id) FROM overrides o WHERE o.task_id = f.task_id) AS overrides,
       'tpl_' || substring(t.template_version_id, 6) AS template_id, sha256(t.template_version_id || 'contract.json') AS contract_sha256,
       (SELECT string_agg(sha256(r.task_id || gate), ',' ORDER BY sha256(r.task_id || gate)) FROM reports r WHERE r.task_id = f.task_id) AS operation_ids, 1 AS schema_version, TRUE AS json_reads_back
FROM finals f JOIN tasks t USING (task_id) JOIN irs i ON i.task_id = f.task_id WHERE f.delivery_id IS NOT NULL""",
    ),
)
def delivery_manifest(spark, sf_dir):
    tasks, irs, reports, done = deliveries_input(spark, sf_dir)
    final = gates.finalize(tasks, irs, reports, done)
    kind = F.when(F.col("doc_id") % 7 == 3, "research").otherwise("material")
    materials = tb.hashed(tb.materials(spark, sf_dir).withColumn("kind", kind))
    version = F.col("template_version_id")
    hashes = F.struct(*[digest.sha(F.concat(version, F.lit(f))).alias(f.split(".")[0].replace("-", "_") + "_sha256") for f in ledger.TEMPLATE_FILES])
    versions = tasks.select("template_version_id").distinct().select(
        "template_version_id", F.concat(F.lit("tpl_"), F.substring(version, 6, 32)).alias("template_id"), F.lit(1).alias("version"), hashes.alias("hashes")
    )
    rules = F.array_position(F.array(*[F.lit(g) for g in gates.REQUIRED_GATES]), F.col("gate"))
    judged = reports.withColumn("rule_version", F.concat(F.lit("rules/"), rules.cast("string")))
    operations = reports.select("task_id", digest.sha(F.concat("task_id", "gate")).alias("operation_id"))
    manifests = gates.manifests(final, irs, tasks, materials, judged, bp.overrides(spark, sf_dir), versions, operations)

    def joined(column, sep, *fields):
        return F.transform(column, lambda x: F.concat_ws(sep, *[x[f] for f in fields]))

    def said(path):
        return F.get_json_object("manifest", path)

    return manifests.select(
        "delivery_id", "task_id", "epoch", "template_version_id", "candidate_sha256",
        F.size("materials").cast("bigint").alias("n_materials"),
        digest.set_digest(joined(F.col("materials"), ":", "artifact_id", "sha256", "kind")).alias("materials_digest"),
        F.array_join(joined(F.col("gates"), "=", "gate", "overall_status", "rule_version"), ",").alias("gates"),
        F.array_join(joined(F.col("overrides"), "=", "slot_id", "decision_id"), ",").alias("overrides"),
        said("$.template.template_id").alias("template_id"), said("$.template.hashes.contract_sha256").alias("contract_sha256"),
        F.array_join("operation_ids", ",").alias("operation_ids"), "schema_version",
        (said("$.delivery_id") == F.col("delivery_id")).alias("json_reads_back"),
    )
