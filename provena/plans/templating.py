"""Queries on template contracts. Documents serve as templates with placeholders put in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions import checks, digest
from provena.functions.digest import sha
from provena.operators import templates
from provena.operators.findings import union_all
from provena.plans import ledgers
from provena.plans.registry import query
from provena.plans.shared_sql import define, stating
from provena.sources import tables as tb

_LINE = """
CASE WHEN i = 1 THEN CASE doc_id % 6 WHEN 1 THEN line WHEN 2 THEN 'x {{ sales_summary }}' ELSE '{{ sales_summary }}' END
     WHEN i = 2 THEN '{{ risks }}' WHEN i = 3 THEN CASE WHEN doc_id % 8 = 1 THEN '{{ next' ELSE '{{ next_plan }}' END
     WHEN i = 4 AND doc_id % 8 = 1 THEN '_plan }}' WHEN i = 4 AND doc_id % 7 = 1 THEN '{{ risks }}'
     WHEN i = 5 THEN CASE doc_id % 10 WHEN 1 THEN 'see {{ other }}' WHEN 2 THEN '{{ a.b }}' WHEN 3 THEN '{% if x %}' WHEN 4 THEN '{{r x }}' WHEN 5 THEN '{{ x|upper }}' ELSE line END
     ELSE line END"""
define(
    "tpl",
    f"""
SELECT doc_id, i, {_LINE} AS text FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS line FROM documents)""",
)
define("tpl_full", "SELECT doc_id, string_agg(text, '' ORDER BY i) AS full_text FROM tpl GROUP BY doc_id", "tpl")
define(
    "tpl_slots",
    "SELECT doc_id, slot_id, '{{ ' || slot_id || ' }}' AS p FROM documents, (VALUES ('sales_summary'), ('risks'), ('next_plan')) s(slot_id)",
)
define(
    "tpl_offsets",
    "SELECT doc_id, i, text, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM tpl",
    "tpl",
)


def _changed(doc: Column, line: Column, i: Column) -> Column:
    first = F.when(doc % 6 == 1, line).when(doc % 6 == 2, F.lit("x {{ sales_summary }}")).otherwise(F.lit("{{ sales_summary }}"))
    third = F.when(doc % 8 == 1, F.lit("{{ next")).otherwise(F.lit("{{ next_plan }}"))
    fifth = (
        F.when(doc % 10 == 1, F.lit("see {{ other }}")).when(doc % 10 == 2, F.lit("{{ a.b }}")).when(doc % 10 == 3, F.lit("{% if x %}"))
        .when(doc % 10 == 4, F.lit("{{r x }}")).when(doc % 10 == 5, F.lit("{{ x|upper }}")).otherwise(line)
    )
    return (
        F.when(i == 1, first).when(i == 2, F.lit("{{ risks }}")).when(i == 3, third)
        .when((i == 4) & (doc % 8 == 1), F.lit("_plan }}")).when((i == 4) & (doc % 7 == 1), F.lit("{{ risks }}"))
        .when(i == 5, fifth).otherwise(line)
    )


def template_docs(spark, sf_dir) -> DataFrame:
    """Documents as templates: an array of paragraphs with runs and bookmarks."""
    doc = F.col("doc_id")

    def paragraph(line: Column, i: Column) -> Column:
        text = _changed(doc, line, i)
        split = F.array(F.substr(text, F.lit(1), F.lit(6)), F.substr(text, F.lit(7)))
        runs = F.when((doc % 6 == 3) & (i == 1), split).otherwise(F.array(text))
        name = F.when(i == 1, "sales_summary").when(i == 2, "risks").when(i == 3, "next_plan")
        mark = F.struct(i.cast("string").alias("id"), name.alias("name"), (doc % 5 != 3).alias("closed"))
        marks = F.when(name.isNotNull() & (doc % 9 != 4), F.array(mark)).otherwise(F.slice(F.array(mark), 1, 0))
        return F.struct(i.alias("idx"), text.alias("text"), runs.alias("run_texts"), marks.alias("bookmarks"))

    lines = tb.read(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("_lines"))
    return lines.select("doc_id", F.col("doc_id").cast("string").alias("template_id"), F.transform("_lines", paragraph).alias("paragraphs"))


def paragraph_rows(spark, sf_dir) -> DataFrame:
    return template_docs(spark, sf_dir).select("doc_id", "template_id", F.explode("paragraphs").alias("_p")).select(
        "doc_id", "template_id", F.col("_p.idx").cast("bigint").alias("idx"), "_p.text", "_p.run_texts", "_p.bookmarks"
    )


def template_slots(spark, sf_dir) -> DataFrame:
    names = F.array(*[F.lit(s) for s in ("sales_summary", "risks", "next_plan")])
    doc = F.col("doc_id")
    rows = tb.read(spark, sf_dir, "documents").select("doc_id", doc.cast("string").alias("template_id"), F.explode(names).alias("slot_id"))
    return rows.withColumn("placeholder", F.concat(F.lit("{{ "), F.col("slot_id"), F.lit(" }}"))).withColumn(
        "style_key", F.when((doc % 12 == 5) & (F.col("slot_id") == "risks"), "wild").otherwise("body")
    )


@query(
    "placeholder_shape",
    """
SELECT doc_id, placeholder, CASE doc_id % 8 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN FALSE WHEN 3 THEN FALSE WHEN 4 THEN TRUE WHEN 5 THEN FALSE WHEN 6 THEN FALSE ELSE TRUE END AS valid
FROM (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '{{ slot_' || doc_id::VARCHAR || ' }}' WHEN 1 THEN '{{ ' || doc_id::VARCHAR || 'a }}' WHEN 2 THEN '{{  }}' WHEN 3 THEN '{ slot }' WHEN 4 THEN ' {{_a' || doc_id::VARCHAR || '}} '
   WHEN 5 THEN '{{ a b }}' WHEN 6 THEN '{{ __ }}' ELSE '{{été}}' END AS placeholder FROM documents)""",
)
def placeholder_shape(spark, sf_dir):
    doc, turn = F.col("doc_id"), F.col("doc_id") % 8
    name = doc.cast("string")
    text = (
        F.when(turn == 0, F.concat(F.lit("{{ slot_"), name, F.lit(" }}"))).when(turn == 1, F.concat(F.lit("{{ "), name, F.lit("a }}")))
        .when(turn == 2, F.lit("{{  }}")).when(turn == 3, F.lit("{ slot }")).when(turn == 4, F.concat(F.lit(" {{_a"), name, F.lit("}} ")))
        .when(turn == 5, F.lit("{{ a b }}")).when(turn == 6, F.lit("{{ __ }}")).otherwise(F.lit("{{été}}"))
    )
    rows = tb.read(spark, sf_dir, "documents").select("doc_id", text.alias("placeholder"))
    return rows.withColumn("valid", checks.placeholder_valid(F.col("placeholder")))


@query(
    "discover_placeholders",
    stating(
        "tpl",
        "SELECT doc_id, i AS idx, trim(trim(text)[3:-3]) AS name FROM tpl WHERE trim(text) LIKE '{{%}}' AND regexp_matches(replace(trim(trim(text)[3:-3]), '_', ''), '^[\\p{L}\\p{N}]+$')",
    ),
)
def discover_placeholders(spark, sf_dir):
    return templates.discovered(paragraph_rows(spark, sf_dir), "doc_id")


_STRAY = """
SELECT doc_id::VARCHAR AS template_id, CASE WHEN doc_id % 10 = 1 THEN 'PLACEHOLDER_UNDECLARED' ELSE 'PLACEHOLDER_NOT_VARIABLE' END AS code, 'document:para[5]' AS locator,
   CASE doc_id % 10 WHEN 1 THEN '{{ other }}' WHEN 2 THEN '{{ a.b }}' WHEN 4 THEN '{{r x }}' ELSE '{{ x|upper }}' END AS detail FROM tpl WHERE i = 5 AND doc_id % 10 IN (1, 2, 4, 5)
UNION ALL
SELECT doc_id::VARCHAR, CASE doc_id % 10 WHEN 3 THEN 'JINJA_CONTROL_SYNTAX' WHEN 4 THEN 'JINJA_RICH_TEXT_TAG' ELSE 'JINJA_FILTER' END, 'document',
   CASE doc_id % 10 WHEN 3 THEN 'control syntax is' WHEN 4 THEN 'rich-text tags are' ELSE 'filters are' END || ' outside the supported subset' FROM tpl WHERE i = 5 AND doc_id % 10 IN (3, 4, 5)"""
_DECLARED = """
SELECT doc_id::VARCHAR AS template_id, u.code AS code, u.locator AS locator, u.detail AS detail FROM (SELECT doc_id, unnest(list_filter([
   CASE WHEN times = 0 THEN {'code': 'PLACEHOLDER_MISSING', 'locator': 'document:' || slot_id, 'detail': p} END,
   CASE WHEN times > 1 THEN {'code': 'PLACEHOLDER_DUPLICATE', 'locator': 'document:' || slot_id, 'detail': p || ' occurs ' || times::VARCHAR || ' times'} END,
   CASE WHEN times > 0 AND i IS NULL THEN {'code': 'PLACEHOLDER_FRAGMENTED', 'locator': 'document:' || slot_id, 'detail': p} END,
   CASE WHEN times > 0 AND trim(text) <> p THEN {'code': 'PLACEHOLDER_NOT_ALONE', 'locator': 'document:para[' || i::VARCHAR || ']', 'detail': text} END,
   CASE WHEN times > 0 AND trim(text) = p AND doc_id % 6 = 3 AND i = 1 THEN {'code': 'PLACEHOLDER_SPLIT_RUN', 'locator': 'document:para[' || i::VARCHAR || ']', 'detail': p} END,
   CASE WHEN times > 0 AND i IS NOT NULL AND (doc_id % 9 = 4 OR doc_id % 5 = 3) THEN {'code': 'PLACEHOLDER_MISSING_ANCHOR', 'locator': 'document:para[' || i::VARCHAR || ']', 'detail': slot_id} END
  ], lambda x: x IS NOT NULL)) AS u
 FROM (SELECT s.doc_id, s.slot_id, s.p, (length(f.full_text) - length(replace(f.full_text, s.p, ''))) // length(s.p) AS times, o.i, o.text
       FROM tpl_slots s JOIN tpl_full f USING (doc_id)
       LEFT JOIN (SELECT doc_id, slot_id, min(i) AS i, arg_min(text, i) AS text FROM tpl JOIN tpl_slots USING (doc_id) WHERE contains(text, p) GROUP BY ALL) o ON o.doc_id = s.doc_id AND o.slot_id = s.slot_id))"""


@query("placeholder_syntax", stating("tpl", _STRAY))
def placeholder_syntax(spark, sf_dir):
    found = templates.placeholder_findings(template_docs(spark, sf_dir), template_slots(spark, sf_dir))
    own = F.col("code").startswith("JINJA") | F.col("code").isin("PLACEHOLDER_UNDECLARED", "PLACEHOLDER_NOT_VARIABLE")
    return found.filter(own)


def _styles(spark, sf_dir) -> DataFrame:
    doc = F.col("doc_id")
    size = F.when(doc % 14 == 6, 0).otherwise(21)
    align = F.when(doc % 15 == 7, "justify").otherwise("left")
    return tb.read(spark, sf_dir, "documents").select(
        doc.cast("string").alias("template_id"), F.lit("body").alias("style_key"), align.alias("alignment"),
        size.alias("font_size"), F.lit(2).alias("tolerance"),
    )


_FINDINGS = f"""
{_STRAY} UNION ALL {_DECLARED}
UNION ALL SELECT doc_id::VARCHAR, 'PLACEHOLDER_IN_HEADER_FOOTER', 'header1', 'dynamic placeholders are only allowed in the document part' FROM documents WHERE doc_id % 16 = 9
UNION ALL SELECT doc_id::VARCHAR, 'STYLES_SPEC_INVALID', 'styles_spec.body', CASE WHEN doc_id % 14 = 6 THEN 'font_size below 1' ELSE 'alignment unknown' END FROM documents WHERE doc_id % 14 = 6 OR doc_id % 15 = 7
UNION ALL SELECT doc_id::VARCHAR, 'STYLE_KEY_UNKNOWN', 'slot:risks', 'wild' FROM documents WHERE doc_id % 12 = 5"""


@query("template_contract", stating("tpl tpl_slots tpl_full", _FINDINGS))
def template_contract(spark, sf_dir):
    slots = template_slots(spark, sf_dir)
    doc = F.col("doc_id")
    head = F.when(doc % 16 == 9, F.lit("{{ page }}")).otherwise(F.lit("Report"))
    parts = tb.read(spark, sf_dir, "documents").select(doc.cast("string").alias("template_id"), F.lit("header1").alias("part"), head.alias("text"))
    return union_all(
        [
            templates.placeholder_findings(template_docs(spark, sf_dir), slots),
            templates.header_findings(parts),
            templates.style_findings(slots, _styles(spark, sf_dir)),
        ]
    )


define(
    "contract_anchors",
    """
SELECT doc_id, slot_id, i, sha256(text) AS signature, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS slot_order FROM tpl JOIN tpl_slots USING (doc_id)
WHERE contains(text, p) AND i = CASE slot_id WHEN 'sales_summary' THEN 1 WHEN 'risks' THEN 2 ELSE 3 END AND doc_id % 5 <> 3 AND doc_id % 9 <> 4""",
    "tpl", "tpl_slots",
)
_CONTRACTS = f"""
SELECT template_id, version, sha256(contract) AS contract_sha256, n_slots, n_anchored, n_regions, n_findings, n_findings = 0 AS activatable, NULL AS problem FROM (
  SELECT d.doc_id::VARCHAR AS template_id, 1 AS version, 3 AS n_slots, s.n_anchored, coalesce(r.n, 0) AS n_regions, coalesce(f.n, 0) AS n_findings,
    '{{"extractor_version":"provena/1","hashes":{{"docx_sha256":"' || sha256(d.text) || '","static_map_sha256":"' || sha256('{{"regions":["' || d.doc_id::VARCHAR || '"]}}') ||
    '","styles_sha256":"' || sha256('{{"body":{{"font_size":' || (d.doc_id % 7)::VARCHAR || ',"name":null}}}}') || '"}},"schema_version":1,"sections":[{{"section_id":"root","slot_ids":["sales_summary","risks","next_plan"],"title":null}}],"slots":[' ||
    s.slots || '],"static_regions":[' || coalesce(r.regions, '') || '],"template_id":"' || d.doc_id::VARCHAR || '","unsupported_findings":[' || coalesce(f.found, '') || '],"version":1}}' AS contract
  FROM documents d
  JOIN (SELECT t.doc_id, count(a.slot_id) AS n_anchored, string_agg('{{"allow_user_omit":false,"anchor":' || coalesce('{{"bookmark_id":"' || a.i::VARCHAR || '","cell_locator":null,"in_table":false,"part":"document","slot_order":' ||
            a.slot_order::VARCHAR || ',"structure_signature":"' || a.signature || '"}}', 'null') || ',"kind":"text_block","placeholder":"' || t.p || '","required":true,"semantic_requirement":"about ' || t.slot_id ||
            '","slot_id":"' || t.slot_id || '","style_key":"' || CASE WHEN t.slot_id = 'risks' AND t.doc_id % 12 = 5 THEN 'wild' ELSE 'body' END || '"}}', ',' ORDER BY CASE t.slot_id WHEN 'sales_summary' THEN 0 WHEN 'risks' THEN 1 ELSE 2 END) AS slots
        FROM tpl_slots t LEFT JOIN contract_anchors a ON a.doc_id = t.doc_id AND a.slot_id = t.slot_id GROUP BY t.doc_id) s USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg('{{"locator":"document:para[' || i::VARCHAR || ']","part":"document","region_id":"r' || i::VARCHAR || '","text_sha256":"' || sha256(text) || '","token_count":1}}', ',' ORDER BY 'r' || i::VARCHAR) AS regions
        FROM tpl WHERE i IN (0, 6) GROUP BY doc_id) r USING (doc_id)
  LEFT JOIN (SELECT template_id, count(*) AS n, string_agg('{{"code":"' || code || '","detail":' || to_json(detail)::VARCHAR || ',"locator":"' || locator || '"}}', ',' ORDER BY code, locator, detail) AS found
        FROM ({_FINDINGS}) GROUP BY template_id) f ON f.template_id = d.doc_id::VARCHAR
  WHERE d.doc_id % 17 <> 3)
UNION ALL SELECT doc_id::VARCHAR, 1, NULL, NULL, NULL, NULL, NULL, NULL, 'slot in no section: next_plan' FROM documents WHERE doc_id % 17 = 3"""


@query("contract_rows", stating("tpl tpl_slots tpl_full contract_anchors", _CONTRACTS))
def contract_rows(spark, sf_dir):
    """Each document's template contract with its digest; some sidecars leave a slot out of all sections."""
    doc, no_text = F.col("doc_id"), F.lit(None).cast("string")
    docs = tb.read(spark, sf_dir, "documents").withColumn("template_id", doc.cast("string"))
    styles = F.to_json(F.struct(F.struct(no_text.alias("name"), (doc % 7).alias("font_size")).alias("body")), {"ignoreNullFields": "false"})
    headers = docs.select(
        "template_id", F.lit(1).alias("version"), F.lit("provena/1").alias("extractor_version"), sha(F.col("text")).alias("docx_sha256"),
        styles.alias("styles"), F.concat(F.lit('{ "regions" : ["'), "template_id", F.lit('"]}')).alias("static_map"),
    )
    all_slots = F.array(*[F.lit(n) for n in ("sales_summary", "risks", "next_plan")])
    listed = F.when(doc % 17 == 3, F.slice(all_slots, 1, 2)).otherwise(all_slots)
    sections = docs.select("template_id", F.lit(0).alias("section_pos"), F.lit("root").alias("section_id"), no_text.alias("title"), listed.alias("slot_ids"))
    slots = template_slots(spark, sf_dir).select(
        "template_id", "slot_id", "placeholder", "style_key", F.array_position(all_slots, F.col("slot_id")).alias("slot_pos"),
        F.lit("text_block").alias("kind"), F.lit(True).alias("required"), F.lit(False).alias("allow_user_omit"),
        F.concat(F.lit("about "), F.col("slot_id")).alias("semantic_requirement"),
    )
    rows = paragraph_rows(spark, sf_dir)
    marks = rows.select("template_id", "idx", "text", F.explode("bookmarks").alias("_b")).filter("_b.closed")
    anchors = marks.filter(F.contains("text", F.concat(F.lit("{{ "), F.col("_b.name"), F.lit(" }}")))).select(
        "template_id", F.col("_b.name").alias("slot_id"), "idx", F.col("_b.id").alias("bookmark_id"), F.lit(False).alias("in_table"),
        no_text.alias("cell_locator"), sha(F.col("text")).alias("structure_signature"),
    )
    name = F.col("idx").cast("string")
    regions = rows.filter(F.col("idx").isin(0, 6)).select(
        "template_id", F.concat(F.lit("r"), name).alias("region_id"), F.concat(F.lit("document:para["), name, F.lit("]")).alias("locator"),
        sha(F.col("text")).alias("text_sha256"), F.lit(1).alias("token_count"),
    )
    made, refused = templates.contracts(headers, sections, slots, anchors, regions, template_contract(spark, sf_dir))
    blank = refused.select("template_id", F.lit(1).alias("version"), "problem")
    return made.drop("contract").withColumn("problem", no_text).unionByName(blank, allowMissingColumns=True)


@query(
    "slot_order",
    stating(
        "tpl",
        """
SELECT doc_id::VARCHAR AS template_id, slot_id, i AS idx, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS slot_order
FROM (SELECT doc_id, i, CASE i WHEN 1 THEN 'sales_summary' WHEN 2 THEN 'risks' ELSE 'next_plan' END AS slot_id FROM tpl WHERE i IN (1, 2, 3) AND doc_id % 9 <> 4 AND doc_id % 5 <> 3)""",
    ),
)
def slot_order(spark, sf_dir):
    marks = paragraph_rows(spark, sf_dir).select("template_id", "idx", F.explode("bookmarks").alias("_b")).filter("_b.closed")
    return templates.slot_order(marks.select("template_id", F.col("_b.name").alias("slot_id"), "idx"))


@query(
    "offset_to_paragraph",
    stating(
        "tpl_offsets",
        """
SELECT q.doc_id, q.off AS "offset", o.i AS idx, CASE WHEN o.i IS NULL THEN 'document' ELSE 'document:para[' || o.i::VARCHAR || ']' END AS locator
FROM (SELECT doc_id, doc_id * 31 % 700 AS off FROM documents) q LEFT JOIN tpl_offsets o ON o.doc_id = q.doc_id AND q.off >= o.start AND q.off < o.start + length(o.text)""",
    ),
)
def offset_to_paragraph(spark, sf_dir):
    rows = paragraph_rows(spark, sf_dir).select(F.col("doc_id").alias("doc"), "idx", "text")
    asked = tb.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), (F.col("doc_id") * 31 % 700).alias("offset"))
    return templates.offset_owners(asked, rows).withColumnRenamed("doc", "doc_id")


define(
    "placed_regions",
    """
SELECT doc_id, n, r.region_id, CASE r.k WHEN 0 THEN 0 WHEN 1 THEN doc_id % 4 WHEN 2 THEN 3 END AS first, CASE r.k WHEN 0 THEN 1 WHEN 1 THEN doc_id % 4 + 2 WHEN 2 THEN 2 END AS last,
   CASE r.k WHEN 3 THEN 'tbl[0]' WHEN 4 THEN 'tbl[1]' END AS table_ref
FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents), (VALUES (0, 'head'), (1, 'body'), (2, 'back'), (3, 'grid'), (4, 'none'), (5, 'lost')) r(k, region_id)""",
)


@query(
    "region_members",
    stating(
        "placed_regions",
        """
SELECT doc_id, region_id, 'member' AS kind, i AS idx, NULL AS problem FROM placed_regions JOIN range(100000) r(i) ON i < n AND (i BETWEEN first AND last OR (table_ref = 'tbl[0]' AND i % 5 = 4)) WHERE first IS NULL OR (last >= first AND last < n)
UNION ALL SELECT doc_id, region_id, 'problem', NULL, 'paragraph_range [' || first::VARCHAR || ', ' || last::VARCHAR || '] out of part bounds' FROM placed_regions WHERE last < first OR last >= n
UNION ALL SELECT doc_id, region_id, 'problem', NULL, 'no table cells match ' || table_ref FROM placed_regions WHERE table_ref = 'tbl[1]' OR (table_ref = 'tbl[0]' AND n < 5)
UNION ALL SELECT doc_id, region_id, 'problem', NULL, 'region needs a range or a table' FROM placed_regions WHERE first IS NULL AND table_ref IS NULL""",
    ),
)
def region_members(spark, sf_dir):
    doc = F.col("doc")
    whole, text = F.lit(None).cast("bigint"), F.lit(None).cast("string")

    def region(name, first, last, table):
        return F.struct(F.lit(name).alias("region_id"), first.cast("bigint").alias("first"), last.cast("bigint").alias("last"), table.alias("table_ref"))

    listed = F.array(
        region("head", F.lit(0), F.lit(1), text), region("body", doc % 4, doc % 4 + 2, text), region("back", F.lit(3), F.lit(2), text),
        region("grid", whole, whole, F.lit("tbl[0]")), region("none", whole, whole, F.lit("tbl[1]")), region("lost", whole, whole, text),
    )
    docs = tb.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    regions = docs.select("doc", F.inline(listed))
    cell = F.when(F.col("idx") % 5 == 4, F.concat(F.lit("tbl[0]/tr["), F.floor(F.col("idx") / 5).cast("string"), F.lit("]/tc[0]")))
    paragraphs = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("idx", "_t")).select("doc", F.col("idx").cast("bigint").alias("idx"), cell.alias("cell_locator"))
    members, problems = templates.region_members(regions, paragraphs)
    inside = members.select("doc", "region_id", F.lit("member").alias("kind"), "idx", text.alias("problem"))
    outside = problems.select("doc", "region_id", F.lit("problem").alias("kind"), whole.alias("idx"), "problem")
    return inside.unionByName(outside).withColumnRenamed("doc", "doc_id")


@query(
    "scaffold_templates",
    stating(
        "tpl",
        """
SELECT doc_id, kind, idx, name, detail FROM (
  SELECT p.doc_id, 'slot' AS kind, p.i AS idx, p.name, 'about ' || p.name AS detail FROM names p WHERE p.doc_id NOT IN (SELECT doc_id FROM refused)
  UNION ALL SELECT doc_id, 'region', i, 'static_' || i::VARCHAR, NULL FROM tpl WHERE trim(text) <> '' AND NOT trim(text) LIKE '{{%}}' AND doc_id NOT IN (SELECT doc_id FROM refused)
  UNION ALL SELECT doc_id, 'refused', NULL, NULL, problem FROM refused)""",
    ).replace(
        "\n\nSELECT doc_id, kind, idx, name, detail",
        """,
names AS (SELECT doc_id, i, trim(trim(text)[3:-3]) AS name FROM tpl WHERE trim(text) LIKE '{{%}}' AND regexp_matches(replace(trim(trim(text)[3:-3]), '_', ''), '^[\\p{L}\\p{N}]+$')),
refused AS (SELECT doc_id, 'placeholders without semantics: ' || string_agg(DISTINCT name, ', ' ORDER BY name) AS problem FROM names WHERE name = 'next_plan' AND doc_id % 4 = 2 GROUP BY doc_id
  UNION ALL SELECT doc_id, 'no placeholder found' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM names))
SELECT doc_id, kind, idx, name, detail""",
    ),
)
def scaffold_templates(spark, sf_dir):
    doc = F.col("doc_id")
    names = F.array(*[F.lit(s) for s in ("sales_summary", "risks", "next_plan")])
    semantics = tb.read(spark, sf_dir, "documents").select("doc_id", F.explode(names).alias("name")).select(
        "doc_id", "name",
        F.when((doc % 4 == 2) & (F.col("name") == "next_plan"), F.lit(" ")).otherwise(F.concat(F.lit("about "), F.col("name"))).alias("semantic"),
        (F.col("name") == "risks").alias("allow_omit"),
    )
    slots, regions, refusals = templates.scaffold(paragraph_rows(spark, sf_dir).select("doc_id", "idx", "text"), semantics, "doc_id")
    text = F.lit(None).cast("string")
    return (
        slots.select("doc_id", F.lit("slot").alias("kind"), "idx", F.col("slot_id").alias("name"), F.col("semantic_requirement").alias("detail"))
        .unionByName(regions.select("doc_id", F.lit("region").alias("kind"), F.col("first").alias("idx"), F.col("region_id").alias("name"), text.alias("detail")))
        .unionByName(
            refusals.select("doc_id", F.lit("refused").alias("kind"), F.lit(None).cast("bigint").alias("idx"), text.alias("name"), F.col("problem").alias("detail"))
        )
    )


@query(
    "ensure_registered",
    stating(
        "versions",
        """
SELECT c.c_custkey AS template_id, CASE WHEN v.version IS NULL THEN 1 WHEN c.c_custkey % 4 = 1 THEN v.version + 1 ELSE v.version END AS version, v.version IS NULL OR c.c_custkey % 4 = 1 AS newly_registered,
   CASE WHEN v.version IS NULL THEN 'tver_' || substring(sha256(concat_ws(chr(31), c.c_custkey::VARCHAR, '1')), 1, 32) WHEN c.c_custkey % 4 = 1 THEN 'tver_' || substring(sha256(concat_ws(chr(31), c.c_custkey::VARCHAR, (v.version + 1)::VARCHAR)), 1, 32)
        ELSE v.template_version_id END AS template_version_id
FROM customer c LEFT JOIN (SELECT template_id, max(version) AS version, arg_max(template_version_id, version) AS template_version_id FROM versions GROUP BY 1) v ON v.template_id = c.c_custkey""",
    ),
)
def ensure_registered(spark, sf_dir):
    names = ("docx_sha256", "contract_sha256", "styles_sha256", "static_map_sha256")
    key = F.col("template_id")

    def digests(changed):
        return [
            digest.sha(F.concat_ws(":", F.lit(n), key.cast("string"), F.when(changed & F.lit(n == "styles_sha256"), "new").otherwise("old"))).alias(n)
            for n in names
        ]

    versions = ledgers.versions(spark, sf_dir).select("template_id", "version", "template_version_id", *digests(F.lit(False)))
    incoming = tb.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("template_id")).select("template_id", *digests(key % 4 == 1))
    return templates.ensure_registered(incoming, versions, names)


@query(
    "contract_tables",
    stating(
        "tasks",
        """
SELECT task_no, kind, locator, value FROM (
  SELECT task_no, 'slot' AS kind, p AS locator, s AS value FROM (SELECT task_no, unnest(['sales_summary', 'risks', 'next_plan']) AS s, unnest(['0', '1', '2']) AS p FROM tasks WHERE task_no % 7 <> 6) WHERE NOT (s = 'risks' AND task_no % 5 = 2) AND NOT (s = 'next_plan' AND task_no % 3 = 1)
  UNION ALL SELECT task_no, 'section', '0', 'main' FROM tasks WHERE task_no % 4 <> 3
  UNION ALL SELECT task_no, 'SIDECAR_SLOT_INVALID', 'sidecar.slots[1]', 'placeholder malformed' FROM tasks WHERE task_no % 5 = 2 AND task_no % 7 <> 6
  UNION ALL SELECT task_no, 'SIDECAR_SLOT_INVALID', 'sidecar.slots[2]', 'semantic_requirement missing' FROM tasks WHERE task_no % 3 = 1 AND task_no % 7 <> 6
  UNION ALL SELECT task_no, 'SIDECAR_SECTION_INVALID', 'sidecar.sections[0]', 'slot_ids empty' FROM tasks WHERE task_no % 4 = 3
  UNION ALL SELECT task_no, 'SIDECAR_INCOMPLETE', 'sidecar.slots', 'must not be empty' FROM tasks WHERE task_no % 7 = 6
  UNION ALL SELECT task_no, 'SIDECAR_SCHEMA_VERSION', 'sidecar.schema_version', 'expected 1.1, got 1.0' FROM tasks WHERE task_no % 6 = 1
  UNION ALL SELECT task_no, 'SIDECAR_TEMPLATE_ID_MISMATCH', 'sidecar.template_id', 'sidecar declares other' FROM tasks WHERE task_no % 8 = 2)""",
    ),
)
def contract_tables(spark, sf_dir):
    number = F.col("task_no")

    def slot(name, placeholder, semantic):
        return F.struct(
            F.lit(name).alias("slot_id"), placeholder.alias("placeholder"), F.lit("text_block").alias("kind"), F.lit(True).alias("required"),
            semantic.alias("semantic_requirement"), F.lit("body").alias("style_key"),
        )

    slots = F.array(
        slot("sales_summary", F.lit("{{ sales_summary }}"), F.lit("sales")),
        slot("risks", F.when(number % 5 == 2, F.lit("risks")).otherwise(F.lit("{{ risks }}")), F.lit("risk")),
        slot("next_plan", F.lit("{{ next_plan }}"), F.when(number % 3 == 1, F.lit("")).otherwise(F.lit("plan"))),
    )
    used = F.when(number % 4 == 3, F.slice(F.array(F.lit("risks")), 1, 0)).otherwise(F.array(F.lit("risks")))
    sections = F.array(F.struct(F.lit("main").alias("section_id"), used.alias("slot_ids")))
    sidecar = F.to_json(
        F.struct(
            F.when(number % 6 == 1, "1.0").otherwise("1.1").alias("schema_version"),
            F.when(number % 8 == 2, "other").otherwise(number.cast("string")).alias("template_id"),
            F.when(number % 7 != 6, slots).otherwise(F.slice(slots, 1, 0)).alias("slots"), sections.alias("sections"),
        )
    )
    sidecars = tb.tasks(spark, sf_dir).select(number.cast("string").alias("template_id"), sidecar.alias("sidecar"))
    good_slots, good_sections, findings = templates.sidecar_tables(sidecars)
    mine = F.col("template_id").cast("bigint").alias("task_no")
    return (
        good_slots.select(mine, F.lit("slot").alias("kind"), F.col("slot_pos").cast("string").alias("locator"), F.col("slot_id").alias("value"))
        .unionByName(good_sections.select(mine, F.lit("section").alias("kind"), F.col("section_pos").cast("string").alias("locator"), F.col("section_id").alias("value")))
        .unionByName(findings.select(mine, F.col("code").alias("kind"), "locator", F.col("detail").alias("value")))
    )


@query(
    "canonical_json",
    """
SELECT c_custkey, sha256('{"c_custkey":' || c_custkey::VARCHAR || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","c_nationkey":' || c_nationkey::VARCHAR || '}') AS contract_sha256, TRUE AS order_free
FROM customer""",
)
def canonical_json(spark, sf_dir):
    """Digest of each customer's canonical JSON; key order of the source does not matter."""
    rows = tb.read(spark, sf_dir, "customer").drop("c_acctbal")
    fields = list(rows.columns)
    digested = templates.contract_digest(fields)
    return rows.select(
        "c_custkey", digested.alias("contract_sha256"), (digested == templates.contract_digest(fields[::-1])).alias("order_free")
    )
