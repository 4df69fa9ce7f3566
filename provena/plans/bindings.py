"""Queries on slots, bindings, proposals and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.functions.digest import sha
from provena.operators import binding, planning
from provena.plans.registry import query
from provena.plans.shared_sql import define, stating
from provena.sources import tables as tb

define(
    "headings",
    """
SELECT * , line_start + length(line) + 1 AS body_start,
       coalesce(lead(line_start) OVER (PARTITION BY artifact_id ORDER BY line_no), total) AS body_end
FROM (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY artifact_id ORDER BY line_no
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line_start
      FROM (SELECT task_no, task_id, artifact_id, doc_id, text, length(text) AS total, unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM headed))
WHERE line LIKE '#%'""",
    "headed",
)
define(
    "marked",
    """
SELECT h.*, s.slot_id, row_number() OVER (PARTITION BY h.artifact_id, s.slot_id ORDER BY h.line_no) AS nth
FROM headings h JOIN contract_slots s
  ON s.template_version_id = 'tver_' || lpad((h.task_no % 3)::VARCHAR, 32, '0') AND contains(h.line, s.marker)""",
    "headings", "contract_slots",
)
define(
    "first_match",
    """
SELECT task_id, slot_id, artifact_id, body_start AS span_start, body_end AS span_end, sha256(text) AS canonical_sha256,
       substring(text, body_start + 1, body_end - body_start) AS span_text,
       sha256(substring(text, body_start + 1, body_end - body_start)) AS span_sha256
FROM (SELECT *, row_number() OVER (PARTITION BY task_id, slot_id ORDER BY doc_id) AS pick
      FROM marked WHERE nth = 1 AND body_start < body_end) WHERE pick = 1""",
    "marked",
)
define(
    "auto_bind",
    """
SELECT t.task_no, t.task_id, t.epoch, t.template_version_id, s.slot_id, s.slot_pos, s.style_key, s.placeholder,
       CASE WHEN f.artifact_id IS NULL THEN 'missing' ELSE 'bound' END AS binding_status,
       CASE WHEN f.artifact_id IS NULL THEN 'no_material' END AS reason_code,
       f.artifact_id, f.span_start, f.span_end, f.canonical_sha256, f.span_sha256, f.span_text
FROM tasks t JOIN contract_slots s USING (template_version_id) LEFT JOIN first_match f ON f.task_id = t.task_id AND f.slot_id = s.slot_id""",
    "tasks", "contract_slots", "first_match",
)
define(
    "overrides",
    "SELECT task_id, epoch, 'risks' AS slot_id, 'dec_' || lpad(task_no::VARCHAR, 32, '0') AS decision_id, "
    "'art_' || lpad((task_no * 20)::VARCHAR, 32, '0') AS reason_artifact_id FROM tasks WHERE task_no % 5 = 3 AND task_no % 2 = 1",
    "tasks",
)


def headed(spark, sf_dir) -> DataFrame:
    """Headed materials with the template version of their task."""
    return tb.headed_materials(spark, sf_dir).withColumn("template_version_id", tb.template_of(F.col("task_no")))


def bound(spark, sf_dir) -> DataFrame:
    return binding.auto_bind(tb.tasks(spark, sf_dir), headed(spark, sf_dir), tb.contract_slots(spark))


def overrides(spark, sf_dir) -> DataFrame:
    """Omissions of the risks slot that users of some tasks decided on."""
    number = F.col("task_no")
    return tb.tasks(spark, sf_dir).filter((number % 5 == 3) & (number % 2 == 1)).select(
        "task_id", "epoch", F.lit("risks").alias("slot_id"),
        tb.padded_id("dec", number).alias("decision_id"),
        tb.padded_id("art", number * tb.TASK_SIZE).alias("reason_artifact_id"),
    )


@query(
    "marker_headings",
    stating("marked", "SELECT artifact_id, slot_id, line_no, line FROM marked"),
)
def marker_headings(spark, sf_dir):
    found = binding.marker_headings(headed(spark, sf_dir), tb.contract_slots(spark))
    return found.select("artifact_id", "slot_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


@query(
    "section_spans",
    stating(
        "headings",
        "SELECT artifact_id, line AS heading, line_start AS section_start, body_start AS span_start, body_end AS span_end "
        "FROM headings WHERE body_start < body_end",
    ),
)
def section_spans(spark, sf_dir):
    return binding.sections(headed(spark, sf_dir)).drop("task_id")


@query(
    "first_match",
    stating("first_match", "SELECT task_id, slot_id, artifact_id, span_start, span_end FROM first_match"),
)
def first_match(spark, sf_dir):
    found = binding.first_sections(headed(spark, sf_dir), tb.contract_slots(spark))
    return found.select("task_id", "slot_id", "artifact_id", "span_start", "span_end")


@query(
    "auto_bind",
    stating(
        "auto_bind",
        "SELECT task_id, slot_id, binding_status, reason_code, artifact_id, span_start, span_end, canonical_sha256, span_sha256 FROM auto_bind",
    ),
)
def auto_bind(spark, sf_dir):
    return bound(spark, sf_dir).select(
        "task_id", "slot_id", "binding_status", "reason_code", "artifact_id",
        "span_start", "span_end", "canonical_sha256", "span_sha256",
    )


#: Two binding versions per task: the first binds what it can but skips one slot of three.
_VERSIONS = """
SELECT task_id, epoch, slot_id, 1 AS binding_version, CASE WHEN (task_no + slot_pos) % 3 = 1 THEN 'invalid' ELSE binding_status END AS binding_status FROM auto_bind
UNION ALL
SELECT task_id, epoch, slot_id, 2, CASE WHEN (task_no + slot_pos) % 3 = 2 THEN 'missing' ELSE binding_status END FROM auto_bind WHERE task_no % 2 = 0"""


def binding_versions(spark, sf_dir) -> DataFrame:
    rows = bound(spark, sf_dir)
    turn = (F.col("task_no") + F.col("slot_pos")) % 3
    key = ["task_id", "epoch", "slot_id"]
    first = rows.select(
        *key, F.lit(1).alias("binding_version"),
        F.when(turn == 1, "invalid").otherwise(F.col("binding_status")).alias("binding_status"),
    )
    second = rows.filter(F.col("task_no") % 2 == 0).select(
        *key, F.lit(2).alias("binding_version"),
        F.when(turn == 2, "missing").otherwise(F.col("binding_status")).alias("binding_status"),
    )
    return first.unionByName(second)


_GAPS = """
SELECT t.task_id, t.epoch, s.slot_id, s.slot_pos FROM tasks t JOIN contract_slots s USING (template_version_id)
WHERE s.required AND NOT EXISTS (SELECT 1 FROM ({rows}) b WHERE b.task_id = t.task_id AND b.epoch = t.epoch AND b.slot_id = s.slot_id AND b.binding_status = 'bound')
  AND NOT EXISTS (SELECT 1 FROM overrides o WHERE o.task_id = t.task_id AND o.epoch = t.epoch AND o.slot_id = s.slot_id)"""


@query("gap_check", stating("auto_bind overrides", _GAPS.format(rows=_VERSIONS)))
def gap_check(spark, sf_dir):
    found = binding.gaps(
        tb.tasks(spark, sf_dir), tb.contract_slots(spark), binding_versions(spark, sf_dir), overrides(spark, sf_dir)
    )
    return found.select("task_id", "epoch", "slot_id", "slot_pos")


@query(
    "gap_check_latest",
    stating(
        "auto_bind overrides",
        _GAPS.format(
            rows=f"SELECT * FROM ({_VERSIONS}) v WHERE binding_version = (SELECT max(binding_version) FROM ({_VERSIONS}) w "
            "WHERE w.task_id = v.task_id AND w.epoch = v.epoch)"
        ),
    ),
)
def gap_check_latest(spark, sf_dir):
    versions = binding_versions(spark, sf_dir)
    newest = versions.groupBy("task_id", "epoch").agg(F.max("binding_version").alias("binding_version"))
    latest = versions.join(newest, ["task_id", "epoch", "binding_version"], "left_semi")
    found = binding.gaps(tb.tasks(spark, sf_dir), tb.contract_slots(spark), latest, overrides(spark, sf_dir))
    return found.select("task_id", "epoch", "slot_id", "slot_pos")


define(
    "mentions",
    """
SELECT task_no, task_id, epoch, template_version_id,
       CASE WHEN task_no % 9 = 7 AND slot_id = 'risks' THEN 'appendix' ELSE slot_id END AS slot_id, binding_status, reason_code,
       artifact_id, span_start, span_end, canonical_sha256,
       CASE WHEN task_no % 8 = 6 AND slot_pos = 0 THEN sha256('forged') ELSE span_sha256 END AS span_sha256,
       span_sha256 AS true_sha256
FROM auto_bind WHERE (task_no + slot_pos) % 4 <> 1""",
    "auto_bind",
)


def mentions(spark, sf_dir) -> DataFrame:
    """Proposals made from the bindings: some slots unsaid, some names unknown, some hashes forged."""
    rows = bound(spark, sf_dir).filter((F.col("task_no") + F.col("slot_pos")) % 4 != 1)
    number = F.col("task_no")
    return rows.select(
        "task_no", "task_id", "epoch", "template_version_id",
        F.when((number % 9 == 7) & (F.col("slot_id") == "risks"), "appendix").otherwise(F.col("slot_id")).alias("slot_id"),
        "binding_status", "reason_code", "artifact_id", "span_start", "span_end", "canonical_sha256",
        F.when((number % 8 == 6) & (F.col("slot_pos") == 0), sha(F.lit("forged")))
        .otherwise(F.col("span_sha256")).alias("span_sha256"),
    )


_COMPLETED = """
SELECT task_id, slot_id, binding_status, reason_code FROM mentions
UNION ALL
SELECT t.task_id, s.slot_id, 'missing', 'no_material' FROM tasks t JOIN contract_slots s USING (template_version_id)
WHERE s.required AND NOT EXISTS (SELECT 1 FROM mentions m WHERE m.task_id = t.task_id AND m.slot_id = s.slot_id)"""


@query("complete_bindings", stating("mentions", _COMPLETED))
def complete_bindings(spark, sf_dir):
    return binding.completed(mentions(spark, sf_dir), tb.tasks(spark, sf_dir), tb.contract_slots(spark))


@query(
    "binding_counts",
    stating(
        "auto_bind",
        f"""
SELECT task_id, epoch, binding_version::BIGINT AS binding_version, count(*) AS slots, count(*) FILTER (binding_status = 'bound') AS bound,
       count(*) FILTER (binding_status = 'missing') AS missing, count(*) FILTER (binding_status = 'invalid') AS invalid
FROM ({_VERSIONS}) GROUP BY ALL""",
    ),
)
def binding_counts(spark, sf_dir):
    versions = binding_versions(spark, sf_dir).withColumn("binding_version", F.col("binding_version").cast("bigint"))
    return binding.status_counts(versions, ["task_id", "epoch", "binding_version"])


@query(
    "next_version",
    """
SELECT c.c_custkey, coalesce(max(o.version), 0) + 1 AS next_version FROM customer c
LEFT JOIN (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders) o
  ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey""",
)
def next_version(spark, sf_dir):
    from provena.operators import ledger

    versions = ledger.order_versions(tb.read(spark, sf_dir, "orders"))
    return ledger.next_version(tb.read(spark, sf_dir, "customer").select("c_custkey"), versions, "c_custkey", "o_custkey", "version")


_PRIOR = "SELECT task_id, epoch, v AS binding_version FROM tasks, (VALUES (1), (2)) n(v) WHERE v <= task_no % 3"


define(
    "proposals",
    """
SELECT * REPLACE (CASE WHEN task_no % 7 = 5 AND slot_id = 'risks' THEN 'invalid' ELSE binding_status END AS binding_status,
       CASE WHEN task_no % 7 = 5 AND slot_id = 'risks' THEN NULL WHEN task_no % 5 = 4 AND binding_status = 'missing' THEN 'unsure' ELSE reason_code END AS reason_code),
       CASE WHEN task_no % 7 = 5 AND slot_id = 'risks' THEN CASE task_no % 2 WHEN 0 THEN 'E1' ELSE '' END END AS error_code,
       epoch + CASE WHEN task_no % 6 = 5 THEN 1 ELSE 0 END AS proposal_epoch
FROM mentions""",
    "mentions",
)


def proposals(spark, sf_dir) -> DataFrame:
    """The mentions with epochs, reasons and errors as a commit takes them, wrong in places."""
    number, failed = F.col("task_no"), (F.col("task_no") % 7 == 5) & (F.col("slot_id") == "risks")
    unsure = (number % 5 == 4) & (F.col("binding_status") == "missing")
    return mentions(spark, sf_dir).select(
        "task_id", "slot_id", "artifact_id", "span_start", "span_end", "canonical_sha256", "span_sha256",
        (F.col("epoch") + F.when(number % 6 == 5, 1).otherwise(0)).alias("proposal_epoch"),
        F.when(failed, "invalid").otherwise(F.col("binding_status")).alias("binding_status"),
        F.when(failed, None).when(unsure, "unsure").otherwise(F.col("reason_code")).alias("reason_code"),
        F.when(failed, F.when(number % 2 == 0, "E1").otherwise("")).alias("error_code"),
    )


define(
    "commit_plans",
    """
SELECT t.task_id, CASE WHEN t.task_no % 11 = 4 THEN 'task_other' ELSE t.task_id END AS plan_task_id,
       CASE WHEN t.task_no % 11 = 6 THEN 'tver_other' ELSE s.template_version_id END AS plan_version_id,
       CASE WHEN t.task_no % 11 = 8 AND s.slot_id = 'risks' THEN 'annex' ELSE s.slot_id END AS slot_id
FROM tasks t JOIN contract_slots s USING (template_version_id) WHERE t.task_no % 11 <> 3""",
    "tasks", "contract_slots",
)


def commit_plans(spark, sf_dir) -> DataFrame:
    """The plans that come with the proposals; some tasks have none, some another's."""
    number, rows = F.col("task_no"), tb.tasks(spark, sf_dir).join(tb.contract_slots(spark).select("template_version_id", "slot_id"), "template_version_id")
    return rows.filter(number % 11 != 3).select(
        "task_id", F.when(number % 11 == 4, "task_other").otherwise(F.col("task_id")).alias("plan_task_id"),
        F.when(number % 11 == 6, "tver_other").otherwise(F.col("template_version_id")).alias("plan_version_id"),
        F.when((number % 11 == 8) & (F.col("slot_id") == "risks"), "annex").otherwise(F.col("slot_id")).alias("slot_id"),
    )


@query(
    "commit_bindings",
    stating(
        "proposals commit_plans materials",
        f"""
SELECT task_id, outcome, CASE WHEN outcome = 'committed' THEN version + 1 END AS binding_version,
       CASE WHEN outcome = 'committed' THEN set_digest END AS set_digest, CASE WHEN outcome = 'committed' THEN n + silent END AS slots,
       CASE WHEN outcome = 'committed' THEN bound END AS bound, CASE WHEN outcome = 'committed' THEN missing + silent END AS missing,
       CASE WHEN outcome = 'committed' THEN invalid END AS invalid
FROM (SELECT p.*, CASE WHEN t.status IN ('completed','failed','cancelled') THEN 'terminal'
             WHEN p.proposal_epoch <> t.epoch THEN 'stale_epoch'
             WHEN EXISTS (SELECT 1 FROM commit_plans c WHERE c.task_id = t.task_id AND c.plan_task_id <> t.task_id) THEN 'plan_of_another_task'
             WHEN EXISTS (SELECT 1 FROM commit_plans c WHERE c.task_id = t.task_id AND c.plan_version_id <> t.template_version_id) THEN 'plan_of_another_version'
             WHEN EXISTS (SELECT 1 FROM commit_plans c WHERE c.task_id = t.task_id AND c.slot_id NOT IN (SELECT slot_id FROM contract_slots)) THEN 'plan_slot_unknown'
             WHEN p.unknown_slot THEN 'unknown_slot' WHEN p.bad_ref THEN 'ref_rejected'
             WHEN p.no_reason THEN 'unknown_reason' WHEN p.no_error THEN 'no_error_code' ELSE 'committed' END AS outcome,
             coalesce((SELECT max(binding_version) FROM ({_PRIOR}) v WHERE v.task_id = t.task_id AND v.epoch = t.epoch), 0) AS version, d.set_digest,
             3 - p.known_slots AS silent
      FROM (SELECT task_id, max(proposal_epoch) AS proposal_epoch, count(*) AS n, count(*) FILTER (binding_status = 'bound') AS bound,
                   count(*) FILTER (binding_status = 'missing') AS missing, count(*) FILTER (binding_status = 'invalid') AS invalid,
                   bool_or(slot_id = 'appendix') AS unknown_slot, coalesce(bool_or(binding_status = 'bound' AND span_sha256 <> true_sha256), FALSE) AS bad_ref,
                   bool_or(binding_status = 'missing' AND reason_code = 'unsure') AS no_reason, coalesce(bool_or(error_code = ''), FALSE) AS no_error,
                   count(*) FILTER (slot_id <> 'appendix') AS known_slots FROM proposals GROUP BY task_id) p
      JOIN tasks t USING (task_id)
      JOIN (SELECT task_id, sha256(string_agg(artifact_id || ':' || sha256(text), chr(10) ORDER BY artifact_id)) AS set_digest FROM headed GROUP BY task_id) d USING (task_id))""",
    ),
)
def commit_bindings(spark, sf_dir):
    tasks = tb.tasks(spark, sf_dir)
    prior = tasks.select(
        "task_id", "epoch", F.explode(F.filter(F.array(F.lit(1), F.lit(2)), lambda v: v <= F.col("task_no") % 3)).alias("binding_version")
    )
    return binding.commit(tasks, proposals(spark, sf_dir), headed(spark, sf_dir), tb.contract_slots(spark), prior, commit_plans(spark, sf_dir))


define(
    "entries",
    """
SELECT task_id, 'tver_' || lpad((task_no % 3)::VARCHAR, 32, '0') AS template_version_id, doc_id AS pos,
       CASE doc_id % 5 WHEN 0 THEN 'sales_summary' WHEN 1 THEN 'risks' WHEN 2 THEN 'next_plan' WHEN 3 THEN 'slot_' || doc_id::VARCHAR ELSE 'risks' END AS slot_id,
       CASE WHEN doc_id % 7 < 4 THEN 'bound' WHEN doc_id % 7 < 6 THEN 'missing' ELSE 'invalid' END AS binding_status,
       CASE doc_id % 6 WHEN 0 THEN [] WHEN 1 THEN ['a', 'a'] WHEN 2 THEN ['a', 'b'] WHEN 3 THEN [] ELSE ['a'] END AS span_handles,
       CASE doc_id % 4 WHEN 0 THEN 'no_material' WHEN 1 THEN 'whatever' END AS reason_code,
       CASE doc_id % 3 WHEN 1 THEN 'E1' WHEN 2 THEN '' END AS error_code
FROM materials""",
    "materials",
)


def entries(spark, sf_dir) -> DataFrame:
    """Proposal entries, one per document, that break every rule somewhere."""
    doc = F.col("doc_id")
    handles = (
        F.when(doc % 6 == 1, F.array(F.lit("a"), F.lit("a")))
        .when(doc % 6 == 2, F.array(F.lit("a"), F.lit("b")))
        .when(doc % 6 > 3, F.array(F.lit("a")))
        .otherwise(F.array().cast("array<string>"))
    )
    slot = (
        F.when(doc % 5 == 0, F.lit("sales_summary"))
        .when(doc % 5 == 2, F.lit("next_plan"))
        .when(doc % 5 == 3, F.concat(F.lit("slot_"), doc.cast("string")))
        .otherwise(F.lit("risks"))
    )
    return tb.materials(spark, sf_dir).select(
        "task_id", tb.template_of(F.col("task_no")).alias("template_version_id"), doc.alias("pos"), slot.alias("slot_id"),
        F.when(doc % 7 < 4, "bound").when(doc % 7 < 6, "missing").otherwise("invalid").alias("binding_status"),
        handles.alias("span_handles"),
        F.when(doc % 4 == 0, "no_material").when(doc % 4 == 1, "whatever").alias("reason_code"),
        F.when(doc % 3 == 1, "E1").when(doc % 3 == 2, "").alias("error_code"),
    )


@query(
    "validate_proposal",
    stating(
        "entries",
        """
SELECT task_id, pos, slot_id, unnest(list_filter([
   CASE WHEN slot_id LIKE 'slot%' THEN 'unknown slot' END,
   CASE WHEN pos > min(pos) OVER (PARTITION BY task_id, slot_id) THEN 'duplicate slot entry' END,
   CASE WHEN binding_status = 'bound' AND len(span_handles) = 0 THEN 'bound slot has no span_handles' END,
   CASE WHEN binding_status = 'bound' AND len(list_distinct(span_handles)) < len(span_handles) THEN 'bound slot repeats a span_handle' END,
   CASE WHEN binding_status = 'bound' AND reason_code IS NOT NULL THEN 'bound slot must not carry reason_code' END,
   CASE WHEN binding_status = 'bound' AND error_code IS NOT NULL THEN 'bound slot must not carry error_code' END,
   CASE WHEN binding_status = 'missing' AND len(span_handles) > 0 THEN 'missing slot must have empty span_handles' END,
   CASE WHEN binding_status = 'missing' AND reason_code IS NULL THEN 'missing slot lacks reason_code' END,
   CASE WHEN binding_status = 'missing' AND reason_code NOT IN ('no_material','ambiguous','budget_exceeded','policy_blocked') THEN 'missing slot has unknown reason_code' END,
   CASE WHEN binding_status = 'missing' AND error_code IS NOT NULL THEN 'missing slot must not carry error_code' END,
   CASE WHEN binding_status = 'invalid' AND len(span_handles) > 0 THEN 'invalid slot must have empty span_handles' END,
   CASE WHEN binding_status = 'invalid' AND coalesce(error_code, '') = '' THEN 'invalid slot lacks error_code' END,
   CASE WHEN binding_status = 'invalid' AND reason_code IS NOT NULL THEN 'invalid slot must not carry reason_code' END
  ], lambda v: v IS NOT NULL)) AS violation FROM entries""",
    ),
)
def validate_proposal(spark, sf_dir):
    return binding.proposal_violations(entries(spark, sf_dir), tb.contract_slots(spark))


define(
    "plan_slots",
    """
SELECT task_no, task_id, template_version_id, doc_id AS plan_pos, section_id,
       CASE WHEN j = 1 AND task_no % 4 = 1 THEN 'risk_list' ELSE name END AS slot_id, kind, required, style_key, depends_on
FROM (SELECT task_no, task_id, 'tver_' || lpad((task_no % 3)::VARCHAR, 32, '0') AS template_version_id, doc_id, doc_id % 20 AS j,
             CASE WHEN doc_id % 6 = 5 THEN 'annex' ELSE 'main' END AS section_id,
             CASE doc_id % 20 WHEN 0 THEN 'sales_summary' WHEN 1 THEN 'risks' WHEN 2 THEN 'next_plan' ELSE 'topic_' || (doc_id % 20)::VARCHAR END AS name,
             CASE WHEN doc_id % 31 = 0 THEN 'table' ELSE 'text_block' END AS kind,
             CASE WHEN doc_id % 23 = 7 THEN doc_id % 20 >= 3 ELSE doc_id % 20 < 3 END AS required,
             CASE WHEN doc_id % 29 = 3 THEN 'wild' ELSE 'body' END AS style_key,
             CASE WHEN doc_id % 37 = 5 THEN ['ghost'] WHEN doc_id % 3 = 0 THEN []
                  ELSE ['topic_' || ((doc_id % 20 * 7 + task_no) % 20)::VARCHAR] END AS depends_on
      FROM materials)""",
    "materials",
)
define(
    "plan_contract",
    """
SELECT 'tver_' || lpad(v::VARCHAR, 32, '0') AS template_version_id,
       CASE j WHEN 0 THEN 'sales_summary' WHEN 1 THEN 'risks' WHEN 2 THEN 'next_plan' ELSE 'topic_' || j::VARCHAR END AS slot_id,
       'text_block' AS kind, j < 3 AS required, 'body' AS style_key
FROM (VALUES (0), (1), (2)) vs(v), range(18) js(j)""",
)


def plan_slots(spark, sf_dir) -> DataFrame:
    """A plan per task with one slot per document; names, attributes and edges go wrong in places."""
    doc, number = F.col("doc_id"), F.col("task_no")
    j = doc % tb.TASK_SIZE
    name = (
        F.when((j == 1) & (number % 4 == 1), F.lit("risk_list"))
        .when(j == 0, F.lit("sales_summary"))
        .when(j == 1, F.lit("risks"))
        .when(j == 2, F.lit("next_plan"))
        .otherwise(F.concat(F.lit("topic_"), j.cast("string")))
    )
    deps = (
        F.when(doc % 37 == 5, F.array(F.lit("ghost")))
        .when(doc % 3 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(F.lit("topic_"), ((j * 7 + number) % 20).cast("string"))))
    )
    return tb.materials(spark, sf_dir).select(
        "task_no", "task_id", tb.template_of(number).alias("template_version_id"), doc.alias("plan_pos"),
        F.when(doc % 6 == 5, "annex").otherwise("main").alias("section_id"), name.alias("slot_id"),
        F.when(doc % 31 == 0, "table").otherwise("text_block").alias("kind"),
        F.when(doc % 23 == 7, j >= 3).otherwise(j < 3).alias("required"),
        F.when(doc % 29 == 3, "wild").otherwise("body").alias("style_key"),
        deps.alias("depends_on"),
    )


def plan_contract(spark) -> tuple[DataFrame, DataFrame]:
    """Slots and sections of the three contracts the plans are checked against."""
    names = ["sales_summary", "risks", "next_plan"] + [f"topic_{j}" for j in range(3, 18)]
    slots = tb.literal(
        spark, [(f"tver_{v:032d}", n, "text_block", i < 3, "body") for v in range(3) for i, n in enumerate(names)],
        "template_version_id string, slot_id string, kind string, required boolean, style_key string",
    )
    sections = tb.literal(
        spark, [(f"tver_{v:032d}", "main", names[: 10 + v] + (["stray"] if v == 1 else [])) for v in range(3)],
        "template_version_id string, section_id string, slot_ids array<string>",
    )
    return slots, sections


_MEMBERSHIP = """
SELECT DISTINCT task_id, 'unknown section: ' || section_id AS violation FROM plan_slots WHERE section_id <> 'main'
UNION ALL
SELECT DISTINCT p.task_id, 'unknown slot: ' || p.slot_id FROM plan_slots p
WHERE NOT EXISTS (SELECT 1 FROM plan_contract c WHERE c.template_version_id = p.template_version_id AND c.slot_id = p.slot_id)
UNION ALL
SELECT t.task_id, 'required slot missing from plan: ' || c.slot_id FROM (SELECT DISTINCT task_id, template_version_id FROM plan_slots) t
JOIN plan_contract c USING (template_version_id)
WHERE c.required AND NOT EXISTS (SELECT 1 FROM plan_slots p WHERE p.task_id = t.task_id AND p.slot_id = c.slot_id)"""


@query("plan_membership", stating("plan_slots plan_contract", _MEMBERSHIP))
def plan_membership(spark, sf_dir):
    return planning.membership(plan_slots(spark, sf_dir), *plan_contract(spark))


_CYCLES = """
SELECT task_id, arg_min(array_to_string(list_concat(path[list_position(path, dep):], [dep]), ' -> '), start_pos) AS cycle
FROM (WITH RECURSIVE edges AS (SELECT p.task_id, p.slot_id, p.plan_pos, p.depends_on[1] AS dep FROM plan_slots p
           WHERE len(p.depends_on) > 0 AND EXISTS (SELECT 1 FROM plan_slots q WHERE q.task_id = p.task_id AND q.slot_id = p.depends_on[1])),
      walk AS (SELECT task_id, plan_pos AS start_pos, [slot_id] AS path, dep FROM edges
               UNION ALL
               SELECT w.task_id, w.start_pos, list_concat(w.path, [w.dep]), e.dep FROM walk w JOIN edges e ON e.task_id = w.task_id AND e.slot_id = w.dep
               WHERE NOT list_contains(w.path, w.dep))
      SELECT * FROM walk WHERE list_contains(path, dep))
GROUP BY task_id"""


@query("dependency_cycles", stating("plan_slots", _CYCLES))
def dependency_cycles(spark, sf_dir):
    return planning.dependency_cycles(plan_slots(spark, sf_dir))


_VALIDATE_PLAN = f"""
{_MEMBERSHIP}
UNION ALL
SELECT p.task_id, unnest(list_filter([
   CASE WHEN p.kind <> c.kind THEN 'slot ' || p.slot_id || ' kind mismatch: plan=' || p.kind || ' contract=' || c.kind END,
   CASE WHEN p.required <> c.required THEN 'slot ' || p.slot_id || ' required mismatch: plan=' || p.required::VARCHAR || ' contract=' || c.required::VARCHAR END,
   CASE WHEN p.style_key <> c.style_key THEN 'slot ' || p.slot_id || ' style_key mismatch: plan=' || p.style_key || ' contract=' || c.style_key END],
   lambda v: v IS NOT NULL))
FROM plan_slots p JOIN plan_contract c USING (template_version_id, slot_id)
UNION ALL
SELECT p.task_id, 'slot ' || p.slot_id || ' depends_on unknown slot: ' || p.depends_on[1] FROM plan_slots p
WHERE len(p.depends_on) > 0 AND NOT EXISTS (SELECT 1 FROM plan_slots q WHERE q.task_id = p.task_id AND q.slot_id = p.depends_on[1])
UNION ALL
SELECT task_id, 'depends_on cycle: ' || cycle FROM ({_CYCLES})"""


@query("validate_plan", stating("plan_slots plan_contract", _VALIDATE_PLAN))
def validate_plan(spark, sf_dir):
    return planning.validate(plan_slots(spark, sf_dir), *plan_contract(spark))


define(
    "declared_sections",
    """
SELECT task_id, section_id, list(CASE WHEN doc_id % 20 = 7 THEN 'stray_' || doc_id::VARCHAR ELSE slot_id END) AS slot_ids
FROM (SELECT task_id, plan_pos AS doc_id, slot_id, CASE WHEN plan_pos % 20 = 11 THEN NULL ELSE section_id END AS section_id FROM plan_slots)
WHERE section_id IS NOT NULL GROUP BY ALL""",
    "plan_slots",
)


@query(
    "contract_coverage",
    stating(
        "declared_sections",
        """
SELECT task_id AS template_version_id, 'section ' || section_id || ' references unknown slot ' || s AS problem
FROM (SELECT task_id, section_id, unnest(slot_ids) AS s FROM declared_sections) n
WHERE NOT EXISTS (SELECT 1 FROM plan_slots p WHERE p.task_id = n.task_id AND p.slot_id = n.s)
UNION ALL
SELECT task_id, 'slot not covered by any section: ' || slot_id FROM plan_slots p
WHERE NOT EXISTS (SELECT 1 FROM (SELECT task_id, unnest(slot_ids) AS s FROM declared_sections) n WHERE n.task_id = p.task_id AND n.s = p.slot_id)""",
    ),
)
def contract_coverage(spark, sf_dir):
    plans = plan_slots(spark, sf_dir).withColumn("template_version_id", F.col("task_id"))
    pos = F.col("plan_pos")
    # A contract's sections name at most its own slots, so the list is bounded by a task's documents.
    sections = (
        plans.filter(pos % tb.TASK_SIZE != 11)
        .withColumn("_name", F.when(pos % tb.TASK_SIZE == 7, F.concat(F.lit("stray_"), pos.cast("string"))).otherwise(F.col("slot_id")))
        .groupBy("template_version_id", "section_id")
        .agg(F.collect_list("_name").alias("slot_ids"))
    )
    return planning.coverage(sections, plans)


@query(
    "duplicates",
    stating(
        "entries",
        """
SELECT task_id AS owner, 'slot' AS kind, slot_id AS value, count(*) AS n FROM entries GROUP BY ALL HAVING count(*) > 1
UNION ALL
SELECT source, 'text', sha256(text), count(*) FROM documents GROUP BY ALL HAVING count(*) > 1""",
    ),
)
def duplicates(spark, sf_dir):
    texts = tb.read(spark, sf_dir, "documents").select("source", sha(F.col("text")).alias("text_sha"))
    return planning.duplicates(entries(spark, sf_dir), "task_id", "slot", "slot_id").unionByName(
        planning.duplicates(texts, "source", "text", "text_sha")
    )
