"""Queries on the ledger: feeds, replays, versions, transitions, decisions, lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena import session
from provena.functions import checks, digest
from provena.functions import text as tx
from provena.operators import binding, ledger, ranking
from provena.operators import materials as mat
from provena.plans import bindings as bp
from provena.plans.registry import query
from provena.plans.shared_sql import define, stating
from provena.sources import tables as tb

define(
    "status_log",
    """
SELECT seq, task_id, CASE event_code WHEN 'signup' THEN 'running' WHEN 'view' THEN 'awaiting_user' WHEN 'click' THEN 'running'
       WHEN 'error' THEN 'parked' ELSE CASE WHEN seq % 40 = 0 THEN 'completed' ELSE 'running' END END AS status FROM log""",
    "log",
)
define(
    "versions",
    """
SELECT o_custkey AS template_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version,
       'tver_' || lpad(o_orderkey::VARCHAR, 32, '0') AS template_version_id, strftime(o_orderdate, '%Y-%m-%d') AS created_at,
       o_orderstatus, o_orderpriority, o_totalprice FROM orders""",
)


def status_log(spark, sf_dir) -> DataFrame:
    """Events as requested status changes."""
    code, seq = F.col("event_code"), F.col("seq")
    status = (
        F.when(code.isin("signup", "click"), "running")
        .when(code == "view", "awaiting_user")
        .when(code == "error", "parked")
        .otherwise(F.when(seq % 40 == 0, "completed").otherwise("running"))
    )
    return tb.events(spark, sf_dir).select("seq", "task_id", status.alias("status"))


def versions(spark, sf_dir) -> DataFrame:
    """Orders as template versions of a customer."""
    return ledger.order_versions(tb.read(spark, sf_dir, "orders")).select(
        F.col("o_custkey").alias("template_id"), "o_orderkey", "version",
        tb.padded_id("tver", F.col("o_orderkey")).alias("template_version_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"),
        "o_orderstatus", "o_orderpriority", "o_totalprice",
    )


_CURSORS = "SELECT DISTINCT user_id, 'task_' || lpad(user_id::VARCHAR, 32, '0') AS task_id, user_id * 37 % 5000 AS after_seq FROM events"


def cursors(spark, sf_dir) -> DataFrame:
    users = tb.read(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(tb.padded_id("task", F.col("user_id")).alias("task_id"), (F.col("user_id") * 37 % 5000).alias("after_seq"))


@query(
    "event_feed",
    stating("log", f"SELECT l.seq, l.task_id, l.event_code, l.props AS refs FROM log l JOIN ({_CURSORS}) c USING (task_id) WHERE l.seq > c.after_seq"),
)
def event_feed(spark, sf_dir):
    return ledger.feed(tb.events(spark, sf_dir), cursors(spark, sf_dir)).select(
        "seq", "task_id", "event_code", F.col("props").alias("refs")
    )


@query(
    "event_cursor",
    stating(
        "log",
        f"""
SELECT c.task_id, c.after_seq, coalesce(max(l.seq) FILTER (l.seq > c.after_seq), c.after_seq) AS last_seq, count(*) FILTER (l.seq > c.after_seq) AS n_events
FROM ({_CURSORS}) c LEFT JOIN log l USING (task_id) GROUP BY c.task_id, c.after_seq""",
    ),
)
def event_cursor(spark, sf_dir):
    return ledger.last_seqs(tb.events(spark, sf_dir), cursors(spark, sf_dir))


@query(
    "append_event",
    "SELECT o_orderkey, (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY o_orderkey) AS seq FROM orders",
)
def append_event(spark, sf_dir):
    """The orders as events written behind the log. The batch is run twice, as after a crash."""
    from provena.sources import sinks

    log, path = tb.events(spark, sf_dir).select("seq"), session.work_dir(spark, "log")
    batch = tb.read(spark, sf_dir, "orders").select("o_orderkey")
    sinks.append_log(log, batch, path, "o_orderkey", "o_orderkey")
    return sinks.append_log(log, batch, path, "o_orderkey", "o_orderkey")


def title_key(text):
    """A request's key: the digest of the whole title line."""
    return digest.sha(F.substring_index(text, "\n", 1))


_KEYED = "SELECT doc_id, sha256(string_split(text, chr(10))[1]) AS request_key, sha256(text) AS payload FROM documents"


def keyed(spark, sf_dir) -> DataFrame:
    """Documents as requests: the opening is the key, the whole text the payload."""
    return tb.read(spark, sf_dir, "documents").select(
        "doc_id", title_key(F.col("text")).alias("request_key"), digest.sha(F.col("text")).alias("payload")
    )


@query(
    "idempotent_replay",
    f"""
SELECT doc_id, payload, CASE WHEN doc_id = first_value(doc_id) OVER w THEN 'new' WHEN payload = first_value(payload) OVER w THEN 'replay' ELSE 'conflict' END AS outcome
FROM ({_KEYED}) WINDOW w AS (PARTITION BY request_key ORDER BY doc_id)""",
)
def idempotent_replay(spark, sf_dir):
    return ledger.idempotency(keyed(spark, sf_dir), ["request_key"], "payload", "doc_id").drop("request_key")


@query(
    "content_addressed_sink",
    f"""
SELECT k.doc_id, CASE WHEN s.payload IS NULL AND k.doc_id = first_value(k.doc_id) OVER w THEN 'write'
         WHEN k.payload = coalesce(s.payload, first_value(k.payload) OVER w) THEN 'reuse' ELSE 'refuse' END AS outcome,
       coalesce(s.payload, first_value(k.payload) OVER w) AS held
FROM (SELECT * FROM ({_KEYED}) WHERE doc_id % 3 > 0) k
LEFT JOIN (SELECT request_key, arg_min(payload, doc_id) AS payload FROM ({_KEYED}) WHERE doc_id % 3 = 0 GROUP BY 1) s USING (request_key)
WINDOW w AS (PARTITION BY k.request_key ORDER BY k.doc_id)""",
)
def content_addressed_sink(spark, sf_dir):
    """A third of the documents is in the store; the others are written to it and read back."""
    from provena.sources import sinks

    rows, path = keyed(spark, sf_dir), session.work_dir(spark, "store")
    sinks.store(rows.filter(F.col("doc_id") % 3 == 0), path, "request_key", "payload", "doc_id")
    outcomes = sinks.store(rows.filter(F.col("doc_id") % 3 > 0), path, "request_key", "payload", "doc_id")
    held = sinks.stored_rows(spark, path, rows.schema).select("request_key", F.col("payload").alias("held"))
    return outcomes.join(held, "request_key", "left").select("doc_id", "outcome", "held")


@query(
    "export_delivery",
    """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'no_delivery' WHEN o_orderkey % 3 = 0 THEN 'replay' WHEN o_orderkey % 3 = 1 THEN 'refuse' ELSE 'new' END AS outcome,
       CASE WHEN o_orderstatus = 'F' THEN sha256(o_orderkey::VARCHAR) END AS final_sha256 FROM orders""",
)
def export_delivery(spark, sf_dir):
    from provena.sources import sinks

    orders, key = tb.read(spark, sf_dir, "orders"), F.col("o_orderkey")
    requests = orders.select("o_orderkey", tb.padded_id("task", key).alias("task_id"), F.concat(F.lit("out/"), key.cast("string")).alias("target"))
    deliveries = orders.filter(F.col("o_orderstatus") == "F").select(
        tb.padded_id("task", key).alias("task_id"), digest.sha(key.cast("string")).alias("final_sha256")
    )
    targets = orders.filter(key % 3 < 2).select(
        F.concat(F.lit("out/"), key.cast("string")).alias("target"),
        digest.sha(F.when(key % 3 == 0, key.cast("string")).otherwise(F.lit("older"))).alias("target_sha256"),
    )
    return sinks.plan_exports(requests, deliveries, targets).select("o_orderkey", "outcome", "final_sha256")


@query(
    "latest_rows",
    """
SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY 1""",
)
def latest_rows(spark, sf_dir):
    order = [F.col("o_orderdate"), F.col("o_orderkey")]
    return ranking.latest_rows(tb.read(spark, sf_dir, "orders"), ["o_custkey"], order, ["o_orderkey", "o_orderstatus"])


@query(
    "latest_templates",
    stating(
        "versions",
        """
SELECT v.template_id, v.version, v.template_version_id, v.created_at, coalesce(c.c_name, v.template_id::VARCHAR) AS display_name
FROM versions v LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) c ON c.c_custkey = v.template_id
WHERE version = (SELECT max(version) FROM versions w WHERE w.template_id = v.template_id)""",
    ),
)
def latest_templates(spark, sf_dir):
    meta = tb.read(spark, sf_dir, "customer").filter(F.col("c_custkey") % 3 > 0).select(
        F.col("c_custkey").alias("template_id"), F.col("c_name").alias("display_name")
    )
    return ledger.latest_versions(versions(spark, sf_dir), meta)


@query(
    "transitions",
    stating(
        "status_log",
        """
SELECT seq, task_id, before, status FROM (SELECT *, coalesce(lag(status) OVER (PARTITION BY task_id ORDER BY seq), 'created') AS before FROM status_log)
WHERE before || '>' || status NOT IN ('created>running','created>failed','created>cancelled','running>awaiting_user','running>parked','running>completed','running>failed','running>cancelled',
 'awaiting_user>running','awaiting_user>parked','awaiting_user>cancelled','awaiting_user>failed','parked>running','parked>cancelled')""",
    ),
)
def transitions(spark, sf_dir):
    return ledger.illegal_transitions(status_log(spark, sf_dir)).select("seq", "task_id", "before", "status")


STATE_FOLD = """
SELECT task_id, seq, status, state_before, state_after, CASE WHEN state_before || '>' || status IN (SELECT p FROM allowed_pairs) THEN 'applied' ELSE 'rejected' END AS outcome
FROM (WITH RECURSIVE asked AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq) AS n FROM status_log),
      allowed_pairs AS (SELECT unnest(['created>running','created>failed','created>cancelled','running>awaiting_user','running>parked','running>completed','running>failed','running>cancelled',
        'awaiting_user>running','awaiting_user>parked','awaiting_user>cancelled','awaiting_user>failed','parked>running','parked>cancelled']) AS p),
      fold AS (SELECT task_id, seq, n, status, 'created' AS state_before, CASE WHEN 'created>' || status IN (SELECT p FROM allowed_pairs) THEN status ELSE 'created' END AS state_after FROM asked WHERE n = 1
        UNION ALL
        SELECT a.task_id, a.seq, a.n, a.status, f.state_after, CASE WHEN f.state_after || '>' || a.status IN (SELECT p FROM allowed_pairs) THEN a.status ELSE f.state_after END
        FROM fold f JOIN asked a ON a.task_id = f.task_id AND a.n = f.n + 1)
      SELECT * FROM fold),
     (SELECT 1) one"""
STATE_FOLD = STATE_FOLD.replace(
    "IN (SELECT p FROM allowed_pairs) THEN 'applied'",
    "IN ('created>running','created>failed','created>cancelled','running>awaiting_user','running>parked','running>completed','running>failed','running>cancelled',"
    "'awaiting_user>running','awaiting_user>parked','awaiting_user>cancelled','awaiting_user>failed','parked>running','parked>cancelled') THEN 'applied'",
)


@query("task_states", stating("status_log", STATE_FOLD))
def task_states(spark, sf_dir):
    return ledger.replay_states(status_log(spark, sf_dir))


@query(
    "epoch_cas",
    stating(
        "versions",
        """
SELECT o_orderkey, template_id, epoch, expected FROM (SELECT *, coalesce(lag(epoch) OVER (PARTITION BY template_id ORDER BY version), 0) + 1 AS expected
FROM (SELECT o_orderkey, template_id, version, version + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS epoch FROM versions)) WHERE epoch <> expected""",
    ),
)
def epoch_cas(spark, sf_dir):
    log = versions(spark, sf_dir).select(
        "o_orderkey", "template_id", "version", (F.col("version") + F.when(F.col("o_orderkey") % 13 == 0, 1).otherwise(0)).alias("epoch")
    )
    log = ranking.measured_buckets(log, ["template_id"], "version")
    breaks = ledger.epoch_breaks(log, "template_id", [F.col("version")], F.col("_piece"))
    return breaks.select("o_orderkey", "template_id", "epoch", "expected")


_COMMANDS = """
SELECT user_id::VARCHAR || ':' || strftime(ts, '%Y-%m-%d') AS operation_id, event_id AS seq,
       CASE event_type WHEN 'signup' THEN 'intent' WHEN 'error' THEN 'abandon' ELSE 'commit' END AS command, event_type AS outputs FROM events"""


@query(
    "operation_lifecycle",
    f"""
SELECT c.operation_id, c.seq, c.command, CASE WHEN s.at IS NULL OR c.seq < s.at THEN 'intent'
   WHEN c.seq = s.at THEN CASE WHEN s.command = 'commit' THEN 'committed' ELSE 'abandoned' END
   WHEN c.command = 'intent' THEN 'replay'
   WHEN c.command = 'commit' AND s.command = 'commit' THEN CASE WHEN c.outputs = s.outputs THEN 'replay' ELSE 'conflict' END
   WHEN c.command = 'commit' THEN 'error_abandoned' WHEN s.command = 'commit' THEN 'error_committed' ELSE 'replay' END AS outcome
FROM ({_COMMANDS}) c LEFT JOIN (SELECT operation_id, min(seq) AS at, arg_min(command, seq) AS command, arg_min(outputs, seq) AS outputs
   FROM ({_COMMANDS}) WHERE command <> 'intent' GROUP BY 1) s USING (operation_id)""",
)
def operation_lifecycle(spark, sf_dir):
    code = F.col("event_code")
    commands = tb.events(spark, sf_dir).select(
        F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("created_at", "yyyy-MM-dd")).alias("operation_id"),
        "seq", F.when(code == "signup", "intent").when(code == "error", "abandon").otherwise("commit").alias("command"),
        code.alias("outputs"),
    )
    return ledger.operation_outcomes(commands)


@query(
    "orphan_reconcile",
    stating(
        "materials",
        """
SELECT relative_path AS path, CASE doc_id % 10 WHEN 1 THEN 'adopt' WHEN 2 THEN 'missing' WHEN 3 THEN 'corrupt' ELSE 'ok' END AS state,
       CASE WHEN doc_id % 20 = 3 THEN doc_id WHEN doc_id % 10 = 3 THEN 1000000 END AS corrupt_at,
       CASE WHEN doc_id % 10 = 2 THEN sha256(text) ELSE sha256(text) END AS sha256 FROM materials""",
    ),
)
def orphan_reconcile(spark, sf_dir):
    held, doc = tb.hashed(tb.materials(spark, sf_dir)), F.col("doc_id")
    files = held.filter(doc % 10 != 2).select(F.col("relative_path").alias("path"), "sha256")
    register = held.filter(doc % 10 != 1).select(
        F.col("relative_path").alias("path"),
        F.when(doc % 10 == 3, digest.sha(F.lit("older"))).otherwise(F.col("sha256")).alias("sha256"),
        F.when(doc % 20 == 3, doc).alias("corrupt_at"),
    )
    return ledger.reconcile(files, register, F.lit(1000000).cast("bigint"))


_DIGESTS = ("docx_sha256", "contract_sha256", "styles_sha256", "static_map_sha256")


@query(
    "manifest_crosscheck",
    """
SELECT o_orderkey, unnest(list_filter([
   CASE WHEN o_orderkey % 19 = 0 THEN 'version not registered' END,
   CASE WHEN o_orderkey % 19 > 0 AND o_orderkey % 7 = 1 THEN 'manifest docx_sha256 disagrees' END,
   CASE WHEN o_orderkey % 19 > 0 AND o_orderkey % 7 = 2 THEN 'manifest styles_sha256 disagrees' END,
   CASE WHEN o_orderkey % 5 = 0 THEN 'lacks digest for styles.json' END,
   CASE WHEN o_orderkey % 5 = 0 THEN 'lacks digest for static-map.json' END], lambda v: v IS NOT NULL)) AS problem FROM orders""",
)
def manifest_crosscheck(spark, sf_dir):
    key = F.col("o_orderkey")
    base = tb.read(spark, sf_dir, "orders").select(
        "o_orderkey", tb.padded_id("tver", key).alias("template_version_id"),
        *[digest.sha(F.concat_ws(":", F.lit(d), key.cast("string"))).alias(d) for d in _DIGESTS],
    )
    other = digest.sha(F.lit("other"))
    files = F.array(*[F.lit(f) for f in ledger.TEMPLATE_FILES])
    manifests = base.select(
        "template_version_id",
        F.when(key % 7 == 1, other).otherwise(F.col("docx_sha256")).alias("docx_sha256"),
        "contract_sha256",
        F.when(key % 7 == 2, other).otherwise(F.col("styles_sha256")).alias("styles_sha256"),
        "static_map_sha256",
        F.when(key % 5 == 0, F.slice(files, 1, 2)).otherwise(files).alias("files"),
    )
    problems = ledger.manifest_problems(manifests, base.filter(key % 19 > 0), _DIGESTS)
    return problems.select(F.substring("template_version_id", 6, 32).cast("bigint").alias("o_orderkey"), "problem")


define(
    "waits",
    """
SELECT task_no, 'awev_' || lpad(task_no::VARCHAR, 32, '0') AS awaiting_event_id, task_id, epoch, task_no % 6 = 5 AS resolved,
       ['risks', 'next_plan'] AS missing_slot_ids FROM tasks""",
    "tasks",
)
define(
    "decided",
    """
SELECT doc_id AS seq, 'dec_' || lpad((doc_id - doc_id % 2)::VARCHAR, 32, '0') AS decision_id, task_no,
       'task_' || lpad((CASE WHEN doc_id % 17 = 3 THEN task_no + 1 ELSE task_no END)::VARCHAR, 32, '0') AS task_id,
       'awev_' || lpad(task_no::VARCHAR, 32, '0') AS awaiting_event_id, 1 + task_no % 2 + CASE WHEN doc_id % 9 = 4 THEN 1 ELSE 0 END AS expected_epoch,
       CASE WHEN (doc_id // 2) % 3 = 0 THEN 'provide_material' ELSE 'omit_slot' END AS action,
       CASE (doc_id // 2) % 7 WHEN 1 THEN 'risks' WHEN 2 THEN 'next_plan' WHEN 3 THEN 'sales_summary' WHEN 4 THEN 'risks' END AS slot_id,
       (doc_id // 2) % 4 AS n_materials, sha256(((doc_id // 2) * 2 + CASE WHEN doc_id % 5 = 1 THEN 1 ELSE 0 END)::VARCHAR) AS payload_digest
FROM materials""",
    "materials",
)
define(
    "judged",
    """
SELECT d.*, t.epoch AS task_epoch, CASE WHEN t.task_id IS NULL THEN 'task_not_found' WHEN w.task_id <> d.task_id THEN 'wrong_task' WHEN w.resolved THEN 'already_resolved'
         WHEN w.epoch <> d.expected_epoch OR t.epoch <> d.expected_epoch THEN 'stale_epoch' WHEN t.status <> 'awaiting_user' THEN 'wrong_state' ELSE 'ok' END AS guard,
       CASE WHEN t.task_id IS NULL OR w.task_id <> d.task_id OR w.resolved OR w.epoch <> d.expected_epoch OR t.epoch <> d.expected_epoch OR t.status <> 'awaiting_user' THEN NULL
            WHEN action = 'provide_material' THEN CASE WHEN n_materials < 1 THEN 'no_material' ELSE 'ok' END
            WHEN d.slot_id IS NULL THEN 'no_slot' WHEN d.slot_id NOT IN ('risks', 'next_plan') THEN 'slot_not_listed' WHEN d.slot_id <> 'risks' THEN 'omit_not_allowed' ELSE 'ok' END AS slot_guard
FROM decided d LEFT JOIN tasks_waiting t USING (task_id) JOIN waits w USING (awaiting_event_id)""",
    "decided", "waits", "tasks_waiting",
)
define(
    "tasks_waiting",
    "SELECT * REPLACE (CASE WHEN task_no % 4 = 3 THEN status ELSE 'awaiting_user' END AS status) FROM tasks",
    "tasks",
)


def waiting_tasks(spark, sf_dir) -> DataFrame:
    return tb.tasks(spark, sf_dir).withColumn("status", F.when(F.col("task_no") % 4 == 3, F.col("status")).otherwise("awaiting_user"))


def waits(spark, sf_dir) -> DataFrame:
    """One awaiting event per task; some are resolved already."""
    return tb.tasks(spark, sf_dir).select(
        tb.padded_id("awev", F.col("task_no")).alias("awaiting_event_id"), "task_id", "epoch",
        (F.col("task_no") % 6 == 5).alias("resolved"), F.array(F.lit("risks"), F.lit("next_plan")).alias("missing_slot_ids"),
    )


def decisions(spark, sf_dir) -> DataFrame:
    """A decision per document; ids come in pairs whose payloads agree or not."""
    doc, number = F.col("doc_id"), F.col("task_no")
    pair = F.floor(doc / 2)
    slot = F.when(pair % 7 == 1, "risks").when(pair % 7 == 2, "next_plan").when(pair % 7 == 3, "sales_summary").when(pair % 7 == 4, "risks")
    return tb.materials(spark, sf_dir).select(
        doc.alias("seq"), tb.padded_id("dec", doc - doc % 2).alias("decision_id"),
        tb.padded_id("task", F.when(doc % 17 == 3, number + 1).otherwise(number)).alias("task_id"),
        tb.padded_id("awev", number).alias("awaiting_event_id"),
        (1 + number % 2 + F.when(doc % 9 == 4, 1).otherwise(0)).alias("expected_epoch"),
        F.when(pair % 3 == 0, "provide_material").otherwise("omit_slot").alias("action"), slot.alias("slot_id"),
        (pair % 4).alias("n_materials"),
        digest.sha((pair * 2 + F.when(doc % 5 == 1, 1).otherwise(0)).cast("string")).alias("payload_digest"),
    )


@query("decision_guard", stating("judged", "SELECT seq, decision_id, guard, slot_guard FROM judged"))
def decision_guard(spark, sf_dir):
    judged = ledger.decision_guard(
        decisions(spark, sf_dir), waits(spark, sf_dir), waiting_tasks(spark, sf_dir), tb.contract_slots(spark)
    )
    return judged.select("seq", "decision_id", "guard", "slot_guard")


@query(
    "respond_flow",
    stating(
        "judged",
        """
SELECT seq, decision_id, task_id, action, outcome, CASE WHEN outcome = 'accepted' THEN task_epoch + CASE WHEN action = 'provide_material' THEN 1 ELSE 0 END END AS epoch_after,
       outcome = 'accepted' AND action = 'omit_slot' AS override_recorded
FROM (SELECT j.*, CASE WHEN i.id_first IS NOT NULL AND (e.resolved_by IS NULL OR i.id_first <= e.resolved_by) AND j.seq > i.id_first
              THEN CASE WHEN j.payload_digest = i.id_digest THEN 'replay' ELSE 'conflict' END
         WHEN j.guard <> 'ok' THEN j.guard WHEN e.resolved_by IS NOT NULL AND j.seq > e.resolved_by THEN 'already_resolved'
         WHEN j.slot_guard <> 'ok' THEN j.slot_guard ELSE 'accepted' END AS outcome
      FROM judged j LEFT JOIN (SELECT decision_id, min(seq) AS id_first, arg_min(payload_digest, seq) AS id_digest FROM judged WHERE guard = 'ok' GROUP BY 1) i USING (decision_id)
      LEFT JOIN (SELECT awaiting_event_id, min(j.seq) AS resolved_by FROM judged j JOIN (SELECT decision_id, min(seq) AS id_first FROM judged WHERE guard = 'ok' GROUP BY 1) f USING (decision_id)
                 WHERE j.guard = 'ok' AND j.slot_guard = 'ok' AND j.seq = f.id_first GROUP BY 1) e USING (awaiting_event_id))""",
    ),
)
def respond_flow(spark, sf_dir):
    return ledger.respond(
        decisions(spark, sf_dir), waits(spark, sf_dir), waiting_tasks(spark, sf_dir), tb.contract_slots(spark)
    )


@query(
    "submit_requests",
    stating(
        "materials",
        """
SELECT arrival, payload_digest, CASE WHEN first IS NULL OR arrival < first THEN 'unknown_template' WHEN arrival = first THEN 'created'
   WHEN payload_digest = stored THEN 'replay' ELSE 'conflict' END AS outcome
FROM (SELECT r.*, min(arrival) FILTER (known) OVER (PARTITION BY request_id) AS first,
             arg_min(payload_digest, arrival) FILTER (known) OVER (PARTITION BY request_id) AS stored
      FROM (SELECT doc_id AS arrival, sha256(string_split(text, chr(10))[1]) AS request_id, length(text) % 4 < 3 AS known,
                   sha256(concat_ws(chr(31), sha256(string_split(text, chr(10))[1]), 'tver_' || lpad((length(text) % 4)::VARCHAR, 32, '0'), 'report', 'local_only',
                     string_split(relative_path, '/')[1] || ':' || sha256(text))) AS payload_digest FROM materials) r)""",
    ),
)
def submit_requests(spark, sf_dir):
    text = F.col("text")
    version = tb.padded_id("tver", F.length(text) % 4)
    key = title_key(text)
    named = F.concat_ws(":", F.element_at(F.split("relative_path", "/"), 1), digest.sha(text))
    requests = tb.materials(spark, sf_dir).select(
        F.col("doc_id").alias("arrival"), key.alias("request_id"), version.alias("template_version_id"),
        digest.payload_digest(key, version, F.lit("report"), F.lit("local_only"), named).alias("payload_digest"),
    )
    return ledger.submissions(requests, tb.contract_slots(spark)).select("arrival", "payload_digest", "outcome")


@query(
    "reconcile_status",
    stating(
        "tasks",
        """
SELECT task_id, command, status, CASE WHEN command = 'cancel' AND status NOT IN ('completed','failed','cancelled') THEN 'cancelled'
   WHEN command = 'recover' AND delivered AND status = 'running' THEN 'completed' WHEN command = 'run' AND status = 'created' THEN 'running' ELSE status END AS status_after,
   CASE WHEN command = 'run' AND status = 'cancelled' THEN 'cannot run a cancelled task' WHEN status = 'completed' AND NOT delivered THEN 'completed without a delivery' ELSE 'ok' END AS note
FROM (SELECT task_id, status, unnest(['run', 'cancel', 'recover']) AS command, task_no % 3 = 1 AS delivered FROM tasks)""",
    ),
)
def reconcile_status(spark, sf_dir):
    tasks = tb.tasks(spark, sf_dir)
    deliveries = tasks.filter(F.col("task_no") % 3 == 1).select("task_id")
    commands = tasks.select("task_id", F.explode(F.array(F.lit("run"), F.lit("cancel"), F.lit("recover"))).alias("command"))
    return ledger.reconcile_status(tasks.select("task_id", "status"), deliveries, commands)


@query(
    "task_board",
    stating(
        "auto_bind overrides",
        f"""
SELECT t.task_id, t.status, t.epoch, t.data_policy, t.material_count, CASE WHEN g.missing IS NOT NULL THEN 'awev_' || lpad(t.task_no::VARCHAR, 32, '0') END AS awaiting_event_id,
       g.missing AS missing_slots, g.omissible AS omissible_slots, CASE WHEN t.status = 'completed' THEN 'dlv_' || lpad(t.task_no::VARCHAR, 32, '0') END AS delivery_id
FROM tasks t LEFT JOIN (SELECT task_id, string_agg(slot_id, ',' ORDER BY slot_pos) AS missing, coalesce(string_agg(slot_id, ',' ORDER BY slot_pos) FILTER (slot_id = 'risks'), '') AS omissible
   FROM ({bp._GAPS.format(rows="SELECT * FROM auto_bind")}) GROUP BY task_id) g USING (task_id)""",
    ),
)
def task_board(spark, sf_dir):
    tasks, slots = tb.tasks(spark, sf_dir), tb.contract_slots(spark)
    gaps = binding.gaps(tasks, slots, bp.bound(spark, sf_dir), bp.overrides(spark, sf_dir))
    omit = slots.select("template_version_id", "slot_id", "allow_user_omit")
    # Gaps per task are bounded by the slots of its template.
    open_events = gaps.join(omit, ["template_version_id", "slot_id"]).groupBy("task_id").agg(
        F.array_sort(F.collect_list(F.struct("slot_pos", "slot_id", "allow_user_omit"))).alias("_g")
    )
    delivered = tasks.filter(F.col("status") == "completed").select("task_id", tb.padded_id("dlv", F.col("task_no")).alias("delivery_id"))
    counted = mat.counts(tasks.drop("material_count"), tb.materials(spark, sf_dir))
    joined = counted.join(open_events, "task_id", "left").join(delivered, "task_id", "left")
    return joined.select(
        "task_id", "status", "epoch", "data_policy", "material_count",
        F.when(F.col("_g").isNotNull(), tb.padded_id("awev", F.col("task_no"))).alias("awaiting_event_id"),
        F.array_join("_g.slot_id", ",").alias("missing_slots"),
        F.array_join(F.transform(F.filter("_g", lambda g: g["allow_user_omit"]), lambda g: g["slot_id"]), ",").alias("omissible_slots"),
        "delivery_id",
    )


@query(
    "recent_rows",
    "SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50",
)
def recent_rows(spark, sf_dir):
    newest = tb.read(spark, sf_dir, "orders").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(50)
    return newest.select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"))


@query(
    "message_history",
    """
SELECT conv_id, turn, role, message_no, last_turn FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS message_no,
       max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM conversations)""",
)
def message_history(spark, sf_dir):
    messages = tb.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    pieces = ranking.measured_buckets(messages, ["conv_id"], "turn")
    numbered = ranking.row_numbers(pieces, ["conv_id"], [F.col("turn")], F.col("_piece"), "message_no").drop("_piece")
    touched = messages.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    return numbered.join(touched, "conv_id")


@query(
    "usage_rollup",
    """
SELECT 'task_' || lpad(conv_id::VARCHAR, 32, '0') AS task_id, role AS node_name, sum(CASE WHEN role = 'user' THEN length(text) END)::BIGINT AS tokens_in,
       sum(CASE WHEN turn % 4 = 1 THEN length(text) END)::BIGINT AS tokens_out, count(*) AS n_calls FROM conversations GROUP BY 1, 2""",
)
def usage_rollup(spark, sf_dir):
    calls = tb.read(spark, sf_dir, "conversations").select(
        tb.padded_id("task", F.col("conv_id")).alias("task_id"), F.col("role").alias("node_name"),
        F.when(F.col("role") == "user", tx.code_points(F.col("text"))).alias("tokens_in"),
        F.when(F.col("turn") % 4 == 1, tx.code_points(F.col("text"))).alias("tokens_out"),
    )
    return ledger.usage(calls)


@query(
    "id_shape_check",
    """
SELECT o_orderkey, unnest(list_filter([
   CASE WHEN o_orderkey % 7 = 1 THEN 'id_shape' END, CASE WHEN o_orderkey % 11 = 2 THEN 'sha256_shape' END,
   CASE WHEN o_orderstatus = 'P' THEN 'status_value' END, CASE WHEN o_orderkey % 5 = 0 THEN 'epoch_range' END,
   CASE WHEN o_orderkey % 13 = 3 THEN 'size_range' END, CASE WHEN o_orderkey % 17 = 4 THEN 'cost_positive' END,
   CASE WHEN o_orderkey % 19 IN (5, 6) THEN 'spans_xor_override' END], lambda v: v IS NOT NULL)) AS rule FROM orders""",
)
def id_shape_check(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = tb.read(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(key % 7 == 1, F.concat(F.lit("Task-"), key.cast("string"))).otherwise(tb.padded_id("task", key)).alias("task_id"),
        F.when(key % 11 == 2, F.lit("ABC")).otherwise(digest.sha(key.cast("string"))).alias("sha256"),
        F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"),
        (key % 5).alias("epoch"),
        F.when(key % 13 == 3, -1).otherwise(key).alias("size"),
        F.when(key % 17 == 4, 0.0).when(key % 17 == 5, F.lit(None)).otherwise(F.col("o_totalprice")).alias("cost"),
        F.when(key % 19 == 5, 0).when(key % 19 == 6, 2).otherwise(1).alias("sources"),
    )
    rules = {
        "id_shape": F.col("task_id").rlike(checks.ID_SHAPE),
        "sha256_shape": F.col("sha256").rlike(checks.SHA_SHAPE),
        "status_value": F.col("status").isin(*tb.STATUSES),
        "epoch_range": F.col("epoch") >= 1,
        "size_range": F.col("size") >= 0,
        "cost_positive": F.col("cost").isNull() | (F.col("cost") > 0),
        "spans_xor_override": F.col("sources") == 1,
    }
    broken = F.array_compact(F.array(*[F.when(~holds, F.lit(name)) for name, holds in rules.items()]))
    return rows.select("o_orderkey", F.explode(broken).alias("rule"))


@query(
    "lineage_closure",
    """
SELECT ancestor, depth, count(*) AS n_roots FROM (SELECT root, ancestor, min(depth) AS depth FROM (
  SELECT root, s.a AS ancestor, s.d AS depth FROM (SELECT root, unnest([{'a': 'order:' || o_orderkey::VARCHAR, 'd': 1}, {'a': 'supplier:' || l_suppkey::VARCHAR, 'd': 1}, {'a': 'customer:' || o_custkey::VARCHAR, 'd': 2},
     {'a': 'nation:' || s_nationkey::VARCHAR, 'd': 2}, {'a': 'nation:' || c_nationkey::VARCHAR, 'd': 3}, {'a': 'region:' || sn.n_regionkey::VARCHAR, 'd': 3},
     {'a': 'region:' || cn.n_regionkey::VARCHAR, 'd': 4}]) AS s
  FROM (SELECT DISTINCT 'line:' || l_orderkey::VARCHAR || ':' || l_suppkey::VARCHAR AS root, l_orderkey, l_suppkey FROM lineitem)
  JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation sn ON sn.n_nationkey = s_nationkey JOIN nation cn ON cn.n_nationkey = c_nationkey)) GROUP BY root, ancestor)
GROUP BY ancestor, depth""",
)
def lineage_closure(spark, sf_dir):
    def node(kind, column):
        return F.concat(F.lit(kind + ":"), F.col(column).cast("string"))

    def edge(table, child, parent):
        return tb.read(spark, sf_dir, table).select(child.alias("child"), parent.alias("parent"))

    line = F.concat_ws(":", F.lit("line"), F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string"))
    edges = (
        edge("lineitem", line, node("order", "l_orderkey"))
        .unionByName(edge("lineitem", line, node("supplier", "l_suppkey")))
        .unionByName(edge("orders", node("order", "o_orderkey"), node("customer", "o_custkey")))
        .unionByName(edge("customer", node("customer", "c_custkey"), node("nation", "c_nationkey")))
        .unionByName(edge("supplier", node("supplier", "s_suppkey"), node("nation", "s_nationkey")))
        .unionByName(edge("nation", node("nation", "n_nationkey"), node("region", "n_regionkey")))
    )
    roots = tb.read(spark, sf_dir, "lineitem").select(line.alias("node"))
    closure = ledger.lineage(edges, roots)
    return closure.groupBy("ancestor", "depth").agg(F.count("*").alias("n_roots"))


@query(
    "event_labels",
    stating(
        "log",
        """
SELECT seq, code, CASE code WHEN 'task_submitted' THEN '任务已提交' WHEN 'tool_call' THEN '工具调用' WHEN 'research_failed' THEN '联网采集失败（已跳过，非任务失败）' ELSE code END AS label,
       CASE code WHEN 'research_failed' THEN '采集失败不阻断装配：任务继续执行，缺槽时由门禁提示补充材料' ELSE '' END AS note,
       'a=' || seq::VARCHAR || ' k=' || json_extract_string(props, '$.k') AS refs
FROM (SELECT *, CASE event_code WHEN 'signup' THEN 'task_submitted' WHEN 'click' THEN 'tool_call' WHEN 'error' THEN 'research_failed' ELSE event_code END AS code FROM log)""",
    ),
)
def event_labels(spark, sf_dir):
    raw = F.col("event_code")
    code = F.when(raw == "signup", "task_submitted").when(raw == "click", "tool_call").when(raw == "error", "research_failed").otherwise(raw)
    refs = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("a"), F.col("seq").cast("string")))
    return tb.events(spark, sf_dir).withColumn("code", code).select(
        "seq", "code", ledger.event_label(F.col("code")).alias("label"), ledger.event_note(F.col("code")).alias("note"),
        ledger.sorted_pairs(refs).alias("refs"),
    )
