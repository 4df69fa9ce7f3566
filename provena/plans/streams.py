"""Streaming queries. Each runs over all that is there and reads its sink back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.functions import digest
from provena.functions import text as tx
from provena.plans import ledgers
from provena.plans.registry import query
from provena.plans.shared_sql import stating
from provena.sources import tables as tb
from provena.streaming import feeds


def log_stream(spark, sf_dir) -> DataFrame:
    """The event log as a stream. Event time needs a zoned timestamp."""
    return feeds.table_stream(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), tb.padded_id("task", F.col("user_id")).alias("task_id"), "user_id",
        F.col("event_type").alias("event_code"), F.col("ts").cast("timestamp").alias("created_at"), "value",
    )


@query(
    "stream_feed",
    stating("log", f"SELECT l.seq, l.task_id, l.event_code FROM log l JOIN ({ledgers._CURSORS}) c USING (task_id) WHERE l.seq > c.after_seq"),
)
def stream_feed(spark, sf_dir):
    rows = feeds.feed(log_stream(spark, sf_dir), ledgers.cursors(spark, sf_dir)).select("seq", "task_id", "event_code")
    return feeds.run_append(rows, "feed")


@query("stream_dedup", "SELECT event_id AS seq, event_type AS event_code FROM events")
def stream_dedup(spark, sf_dir):
    log = log_stream(spark, sf_dir).select("seq", "event_code", "created_at")
    tries = F.when(F.col("seq") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    replayed = log.select("seq", "event_code", "created_at", F.explode(tries).alias("_try")).drop("_try")
    return feeds.dedup_all(replayed, "dedup", ["event_code"])


@query(
    "stream_idempotency",
    f"""
SELECT request_key, doc_id AS seq, CASE WHEN doc_id = first_value(doc_id) OVER w THEN 'new' WHEN payload = first_value(payload) OVER w THEN 'replay' ELSE 'conflict' END AS outcome
FROM ({ledgers._KEYED}) WINDOW w AS (PARTITION BY request_key ORDER BY doc_id)""",
)
def stream_idempotency(spark, sf_dir):
    requests = feeds.table_stream(spark, sf_dir, "documents").select(
        ledgers.title_key(F.col("text")).alias("request_key"), F.col("doc_id").alias("seq"), digest.sha(F.col("text")).alias("digest")
    )
    return feeds.settled_decisions(feeds.idempotency(requests), "idempotency", ["request_key", "seq"])


def _status(code, seq):
    return (
        F.when(code.isin("signup", "click"), "running").when(code == "view", "awaiting_user").when(code == "error", "parked")
        .otherwise(F.when(seq % 40 == 0, "completed").otherwise("running"))
    )


@query("stream_task_state", stating("status_log", ledgers.STATE_FOLD))
def stream_task_state(spark, sf_dir):
    seq = F.col("seq")
    requests = log_stream(spark, sf_dir).select(
        "task_id", "seq", _status(F.col("event_code"), seq).alias("status"), F.lit(None).cast("bigint").alias("expected_epoch")
    )
    return feeds.settled_decisions(feeds.task_state(requests), "task-state", ["task_id", "seq"]).drop("epoch")


_ALLOWED = (
    "'created>running','created>failed','created>cancelled','running>awaiting_user','running>parked','running>completed','running>failed',"
    "'running>cancelled','awaiting_user>running','awaiting_user>parked','awaiting_user>cancelled','awaiting_user>failed','parked>running','parked>cancelled'"
)


@query(
    "stream_stale",
    stating(
        "status_log",
        f"""
SELECT task_id, seq, status, state, epoch FROM (
  WITH RECURSIVE asked AS (SELECT *, CASE WHEN seq % 3 = 0 THEN 1 + seq % 4 END AS expected, row_number() OVER (PARTITION BY task_id ORDER BY seq) AS n FROM status_log),
  fold AS (
    SELECT task_id, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS status, 'created' AS state, 1::BIGINT AS epoch, FALSE AS stale FROM (SELECT DISTINCT task_id FROM status_log)
    UNION ALL
    SELECT a.task_id, a.n, a.seq, a.status,
      CASE WHEN a.expected IS NOT NULL AND a.expected <> f.epoch THEN f.state WHEN f.state || '>' || a.status IN ({_ALLOWED}) THEN a.status ELSE f.state END,
      f.epoch + CASE WHEN (a.expected IS NULL OR a.expected = f.epoch) AND f.state = 'awaiting_user' AND a.status = 'running' THEN 1 ELSE 0 END,
      coalesce(a.expected <> f.epoch, FALSE)
    FROM fold f JOIN asked a ON a.task_id = f.task_id AND a.n = f.n + 1)
  SELECT * FROM fold) WHERE stale""",
    ),
)
def stream_stale(spark, sf_dir):
    seq = F.col("seq")
    requests = log_stream(spark, sf_dir).select(
        "task_id", "seq", _status(F.col("event_code"), seq).alias("status"), F.when(seq % 3 == 0, 1 + seq % 4).alias("expected_epoch")
    )
    late = feeds.settled_decisions(feeds.task_state(requests), "stale", ["task_id", "seq"]).filter(F.col("outcome") == "stale")
    return late.select("task_id", "seq", "status", F.col("state_after").alias("state"), "epoch")


@query("stream_ingest", "SELECT DISTINCT sha256(text) AS sha256, length(text) AS code_points FROM documents")
def stream_ingest(spark, sf_dir):
    return feeds.ingest(feeds.table_stream(spark, sf_dir, "documents").select("text"))


_CLOSED = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)"


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("window_start", tx.display_time(F.col("window_start"))).withColumn("window_end", tx.display_time(F.col("window_end")))


@query(
    "stream_counts",
    f"""
SELECT 'tumbling' AS kind, strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(s + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, event_type AS event_code, count(*) AS n
FROM (SELECT date_trunc('day', ts) AS s, event_type FROM events) WHERE s + INTERVAL 1 DAY <= {_CLOSED} GROUP BY ALL
UNION ALL
SELECT 'sliding', strftime(s, '%Y-%m-%d %H:%M:%S'), strftime(s + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S'), event_type, count(*)
FROM (SELECT time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2000-01-01') - k * INTERVAL 12 HOUR AS s, event_type FROM events, (VALUES (0), (1)) v(k)) WHERE s + INTERVAL 1 DAY <= {_CLOSED} GROUP BY ALL""",
)
def stream_counts(spark, sf_dir):
    split = feeds.split_late(log_stream(spark, sf_dir), "counts")
    tumbling = feeds.counts_all(split, "tumbling", F.window("created_at", "1 day"), ["event_code"])
    sliding = feeds.counts_all(split, "sliding", F.window("created_at", "1 day", "12 hours"), ["event_code"])
    return _shown(tumbling.withColumn("kind", F.lit("tumbling")).unionByName(sliding.withColumn("kind", F.lit("sliding"))))


@query(
    "stream_sessions",
    f"""
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, count(*) AS n
FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events))
GROUP BY user_id, session HAVING max(ts) + INTERVAL 6 HOUR <= {_CLOSED}""",
)
def stream_sessions(spark, sf_dir):
    split = feeds.split_late(log_stream(spark, sf_dir), "sessions-split")
    return _shown(feeds.sessions_all(split, "sessions", F.session_window("created_at", "6 hours"), ["user_id"]))


@query(
    "event_counts",
    "SELECT event_type AS event_code, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM events GROUP BY ALL",
)
def event_counts(spark, sf_dir):
    """Counts so far, open windows included: update mode."""
    split = feeds.split_late(log_stream(spark, sf_dir), "event-counts-split")
    return _shown(feeds.counts_so_far(split, "event-counts", F.window("created_at", "1 day"), ["event_code"])).select(
        "event_code", "window_start", "n"
    )


@query(
    "stream_budget",
    """
SELECT turn, call_no, CASE WHEN pos > 4 THEN 'refused_calls' WHEN fits THEN 'admitted' ELSE 'refused_chars' END AS outcome, CASE WHEN pos <= 4 THEN used END AS chars_used
FROM (WITH RECURSIVE gaps AS (SELECT user_id AS turn, event_id AS call_no, (value * 10)::INT::BIGINT AS chars, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events),
   sessions AS (SELECT *, sum(new) OVER (PARTITION BY turn ORDER BY call_no) AS session FROM gaps),
   calls AS (SELECT *, row_number() OVER (PARTITION BY turn, session ORDER BY call_no) AS pos FROM sessions),
   fold AS (SELECT turn, session, call_no, pos, chars <= 600 AS fits, CASE WHEN chars <= 600 THEN chars ELSE 0 END AS used FROM calls WHERE pos = 1
      UNION ALL
      SELECT c.turn, c.session, c.call_no, c.pos, f.used + c.chars <= 600, CASE WHEN f.used + c.chars <= 600 THEN f.used + c.chars ELSE f.used END
      FROM fold f JOIN calls c ON c.turn = f.turn AND c.session = f.session AND c.pos = f.pos + 1 WHERE f.pos < 4)
   SELECT c.turn, c.call_no, c.pos, f.fits, f.used FROM calls c LEFT JOIN fold f ON f.turn = c.turn AND f.session = c.session AND f.pos = c.pos)""",
)
def stream_budget(spark, sf_dir):
    calls = log_stream(spark, sf_dir).select(
        F.col("user_id").alias("turn"), F.col("seq").alias("call_no"), F.bround(F.col("value") * 10).cast("bigint").alias("chars"), "created_at"
    )
    return feeds.settled_decisions(feeds.budget(calls, max_calls=4, max_chars=600, gap_seconds=6 * 3600), "budget", ["turn", "call_no"])
