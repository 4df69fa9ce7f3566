"""Queries on texts, materials and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.functions import checks, digest
from provena.functions import text as tx
from provena.operators import materials as mat
from provena.operators import search, spans
from provena.operators.ranking import first_rows
from provena.plans.registry import query
from provena.plans.shared_sql import define, stating
from provena.session import settle
from provena.sources import tables as tb

define(
    "span_requests",
    """
SELECT doc_id AS request_id, task_no,
       'task_' || lpad((CASE WHEN doc_id % 11 = 4 THEN task_no + 1 ELSE task_no END)::VARCHAR, 32, '0') AS task_id,
       artifact_id, doc_id * 7 % 40 - 1 AS span_start, doc_id * 7 % 40 - 1 + doc_id % 90 AS span_end
FROM materials""",
    "materials",
)
define(
    "resolved",
    """
SELECT r.*, m.text, sha256(m.text) AS text_sha,
       CASE WHEN m.text IS NULL THEN 'not_found' WHEN span_start >= span_end THEN 'empty'
            WHEN span_start < 0 OR span_end > length(m.text) THEN 'out_of_range' ELSE 'ok' END AS status,
       CASE WHEN m.text IS NOT NULL AND span_start < span_end AND span_start >= 0 AND span_end <= length(m.text)
            THEN substring(m.text, span_start + 1, span_end - span_start) END AS exact_text
FROM span_requests r LEFT JOIN materials m ON m.task_id = r.task_id AND m.artifact_id = r.artifact_id""",
    "span_requests",
)


def span_requests(spark, sf_dir) -> DataFrame:
    m = tb.materials(spark, sf_dir)
    doc, number = F.col("doc_id"), F.col("task_no")
    start = doc * 7 % 40 - 1
    return m.select(
        doc.alias("request_id"), "task_no",
        tb.padded_id("task", F.when(doc % 11 == 4, number + 1).otherwise(number)).alias("task_id"),
        "artifact_id", start.alias("span_start"), (start + doc % 90).alias("span_end"),
    )


@query(
    "ingest_materials",
    stating(
        "raw",
        """
SELECT artifact_id, 'canonical' AS row_kind, sha256(t) AS sha256, length(t) AS code_points, strlen(t) AS size_bytes
FROM (SELECT artifact_id, regexp_replace(nfc_normalize(raw_text), '\\r\\n?', chr(10), 'g') AS t FROM raw WHERE NOT broken)
UNION ALL
SELECT artifact_id, 'raw', sha256(raw_text), NULL, strlen(raw_text) FROM raw WHERE NOT broken
UNION ALL
SELECT artifact_id, 'rejected', NULL, NULL, strlen(raw_text) + 1 FROM raw WHERE broken""",
    ),
)
def ingest_materials(spark, sf_dir):
    uploads = tb.raw_materials(spark, sf_dir).withColumn("raw_size", F.octet_length("content").cast("bigint"))
    canonical, rejected = mat.ingest(uploads)
    nothing = F.lit(None)
    return (
        canonical.select("artifact_id", F.lit("canonical").alias("row_kind"), "sha256", "code_points", "size_bytes")
        .unionByName(
            canonical.select(
                "artifact_id", F.lit("raw").alias("row_kind"), F.col("raw_sha256").alias("sha256"),
                nothing.cast("bigint").alias("code_points"), F.col("raw_size").alias("size_bytes"),
            )
        )
        .unionByName(
            rejected.select(
                "artifact_id", F.lit("rejected").alias("row_kind"), nothing.cast("string").alias("sha256"),
                nothing.cast("bigint").alias("code_points"), F.col("raw_size").alias("size_bytes"),
            )
        )
    )


@query(
    "canonicalize",
    stating(
        "raw",
        """
SELECT artifact_id, sha256(t) AS sha256, length(t) AS code_points, strlen(t) AS size_bytes,
       strlen(raw_text) - strlen(t) AS bytes_removed
FROM (SELECT artifact_id, raw_text, regexp_replace(nfc_normalize(raw_text), '\\r\\n?', chr(10), 'g') AS t
      FROM raw WHERE NOT broken)""",
    ),
)
def canonicalize(spark, sf_dir):
    canonical, _ = mat.ingest(
        tb.raw_materials(spark, sf_dir).withColumn("_raw_size", F.octet_length("content").cast("bigint"))
    )
    return canonical.select(
        "artifact_id", "sha256", "code_points", "size_bytes",
        (F.col("_raw_size") - F.col("size_bytes")).alias("bytes_removed"),
    )


_POSITIONS = """
SELECT artifact_id, list_filter(list_transform(string_split(text, ''), lambda c, i:
         CASE WHEN ascii(c) < 32 AND ascii(c) NOT IN (9, 10, 13) THEN i - 1 END), lambda p: p IS NOT NULL) AS positions
FROM controlled"""


@query(
    "illegal_positions",
    stating(
        "controlled",
        f"SELECT artifact_id, len(positions) AS n_illegal, array_to_string(positions, ',') AS positions "
        f"FROM ({_POSITIONS})",
    ),
)
def illegal_positions(spark, sf_dir):
    found = tb.controlled_materials(spark, sf_dir).withColumn("_p", tx.illegal_positions(F.col("text")))
    return found.select(
        "artifact_id",
        F.size("_p").cast("bigint").alias("n_illegal"),
        F.array_join(F.col("_p").cast("array<string>"), ",").alias("positions"),
    )


@query(
    "renderable_check",
    stating(
        "controlled",
        f"""
SELECT artifact_id, len(positions) = 0 AS renderable,
       CASE WHEN len(positions) > 0 THEN 'text contains forbidden control characters: ' ||
         array_to_string(list_transform(positions[1:5], lambda p: 'index ' || p::VARCHAR || ' (U+0007)'), ', ')
       END AS problem
FROM ({_POSITIONS})""",
    ),
)
def renderable_check(spark, sf_dir):
    found = tb.controlled_materials(spark, sf_dir).withColumn("_p", tx.illegal_positions(F.col("text")))
    return found.select(
        "artifact_id",
        (F.size("_p") == 0).alias("renderable"),
        tx.offence_message(F.col("text"), F.col("_p")).alias("problem"),
    )


@query(
    "first_problems",
    stating(
        "controlled",
        f"""
SELECT task_id, count(*) AS n_bad, string_agg(message, '; ' ORDER BY artifact_id) FILTER (WHERE rn <= 5) AS first_messages
FROM (SELECT c.task_id, c.artifact_id, c.artifact_id || '@' || p.positions[1]::VARCHAR AS message,
             row_number() OVER (PARTITION BY c.task_id ORDER BY c.artifact_id) AS rn
      FROM controlled c JOIN ({_POSITIONS}) p USING (artifact_id) WHERE len(p.positions) > 0)
GROUP BY task_id""",
    ),
)
def first_problems(spark, sf_dir):
    from provena.operators.findings import joined_messages

    found = tb.controlled_materials(spark, sf_dir).withColumn("_p", tx.illegal_positions(F.col("text")))
    bad = found.filter(F.size("_p") > 0).select(
        "task_id", "artifact_id",
        F.concat("artifact_id", F.lit("@"), F.element_at("_p", 1).cast("string")).alias("message"),
    )
    messages = joined_messages(bad, ["task_id"], "artifact_id", "message", limit=5)
    return messages.select("task_id", F.col("n_messages").alias("n_bad"), F.col("messages").alias("first_messages"))


@query(
    "material_scope",
    stating(
        "materials",
        """
SELECT l.request_id, l.task_id, l.artifact_id,
       CASE WHEN m.artifact_id IS NULL THEN 'not_found' ELSE 'ok' END AS scope, m.kind, m.created_at AS arrival
FROM (SELECT doc_id AS request_id, artifact_id,
             'task_' || lpad((CASE WHEN doc_id % 9 = 2 THEN task_no + 1 ELSE task_no END)::VARCHAR, 32, '0') AS task_id
      FROM materials) l LEFT JOIN materials m USING (task_id, artifact_id)""",
    ),
)
def material_scope(spark, sf_dir):
    m = tb.materials(spark, sf_dir)
    number = F.when(F.col("doc_id") % 9 == 2, F.col("task_no") + 1).otherwise(F.col("task_no"))
    lookups = m.select(F.col("doc_id").alias("request_id"), "artifact_id", tb.padded_id("task", number).alias("task_id"))
    return mat.scoped(m, lookups).select(
        "request_id", "task_id", "artifact_id", "scope", "kind", F.col("created_at").alias("arrival")
    )


@query(
    "read_slices",
    stating(
        "materials",
        """
SELECT request_id, task_id, artifact_id, start, problem,
       CASE WHEN problem IS NULL THEN stop END AS "end", CASE WHEN problem IS NULL THEN total END AS total,
       CASE WHEN problem IS NULL THEN sha256(substring(text, start + 1, stop - start)) END AS slice_sha256,
       CASE WHEN problem IS NULL THEN stop < least(start + wanted, total) END AS truncated
FROM (SELECT *, start + least(wanted, 8000, total - start) AS stop FROM (
  SELECT r.*, m.text, length(m.text) AS total, coalesce(r.len, length(m.text) - r.start) AS wanted,
       CASE WHEN m.text IS NULL THEN 'not_found' WHEN start < 0 THEN 'negative start'
            WHEN start > length(m.text) THEN 'start beyond end' WHEN r.len < 0 THEN 'negative length' END AS problem
  FROM (SELECT doc_id AS request_id, artifact_id, doc_id * 37 % 500 - 3 AS start,
               CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id * 13 % 9000 - 2 END AS len,
               'task_' || lpad((CASE WHEN doc_id % 11 = 4 THEN task_no + 1 ELSE task_no END)::VARCHAR, 32, '0') AS task_id
        FROM materials) r LEFT JOIN materials m USING (task_id, artifact_id)))""",
    ),
)
def read_slices(spark, sf_dir):
    m = tb.materials(spark, sf_dir)
    doc = F.col("doc_id")
    requests = m.select(
        doc.alias("request_id"), "artifact_id",
        tb.padded_id("task", F.when(doc % 11 == 4, F.col("task_no") + 1).otherwise(F.col("task_no"))).alias("task_id"),
        (doc * 37 % 500 - 3).alias("start"),
        F.when(doc % 5 != 0, doc * 13 % 9000 - 2).alias("length"),
    )
    return search.read_slices(m, requests).select(
        "request_id", "task_id", "artifact_id", "start", "problem", "end", "total",
        digest.sha(F.col("slice")).alias("slice_sha256"), "truncated",
    )


@query(
    "snippets",
    """
SELECT doc_id, CASE WHEN n <= 60 THEN text ELSE
         CASE WHEN l > 0 THEN '…' ELSE '' END || substring(text, l + 1, 58) || CASE WHEN l + 58 < n THEN '…' ELSE '' END
       END AS snippet, CASE WHEN n <= 3 THEN text ELSE '…' END AS narrow_snippet
FROM (SELECT doc_id, text, n, greatest(0, least(p, n - 58)) AS l FROM (
  SELECT doc_id, text, length(text) AS n, position('. ' IN text) - 1 AS p FROM documents)
  WHERE p >= 0)""",
)
def snippets(spark, sf_dir):
    docs = tb.read(spark, sf_dir, "documents").withColumn("_p", tx.literal_position(F.col("text"), F.lit(". ")))
    return docs.filter(F.col("_p") >= 0).select(
        "doc_id",
        tx.snippet(F.col("text"), F.col("_p"), 60).alias("snippet"),
        tx.snippet(F.col("text"), F.col("_p"), 3).alias("narrow_snippet"),
    )


_DAMAGED_PATH = """
SELECT doc_id, CASE doc_id % 8 WHEN 1 THEN '/' || relative_path WHEN 2 THEN replace(relative_path, '/', chr(92))
   WHEN 3 THEN replace(relative_path, '/inbox/', '//') WHEN 4 THEN replace(relative_path, '/inbox/', '/./')
   WHEN 5 THEN replace(relative_path, '/inbox/', '/../') WHEN 6 THEN '' ELSE relative_path END AS path
FROM materials"""


def _damaged_path():
    path, turn = F.col("relative_path"), F.col("doc_id") % 8
    return (
        F.when(turn == 1, F.concat(F.lit("/"), path))
        .when(turn == 2, F.replace(path, F.lit("/"), F.lit("\\")))
        .when(turn == 3, F.replace(path, F.lit("/inbox/"), F.lit("//")))
        .when(turn == 4, F.replace(path, F.lit("/inbox/"), F.lit("/./")))
        .when(turn == 5, F.replace(path, F.lit("/inbox/"), F.lit("/../")))
        .when(turn == 6, F.lit(""))
        .otherwise(path)
    )


@query(
    "safe_paths",
    stating(
        "materials",
        f"""
SELECT doc_id, path, CASE WHEN path = '' THEN 'empty' WHEN path LIKE '/%' THEN 'absolute'
         WHEN contains(path, chr(92)) THEN 'backslash'
         WHEN len(list_filter(string_split(path, '/'), lambda p: p IN ('', '.', '..'))) > 0 THEN 'component' END AS reason
FROM ({_DAMAGED_PATH})""",
    ),
)
def safe_paths(spark, sf_dir):
    paths = tb.materials(spark, sf_dir).select("doc_id", _damaged_path().alias("path"))
    return paths.withColumn("reason", checks.path_problem(F.col("path")))


@query(
    "code_point_slice",
    "SELECT doc_id, sha256(substring(text, doc_id % 30 + 1, doc_id % 50 + 5)) AS slice_sha256, "
    "length(substring(text, doc_id % 30 + 1, doc_id % 50 + 5)) AS slice_points FROM documents",
)
def code_point_slice(spark, sf_dir):
    start = F.col("doc_id") % 30
    piece = tx.slice_points(F.col("text"), start, start + F.col("doc_id") % 50 + 5)
    return tb.read(spark, sf_dir, "documents").select(
        "doc_id", digest.sha(piece).alias("slice_sha256"), tx.code_points(piece).alias("slice_points")
    )


@query("sha256_text", "SELECT doc_id, sha256(text) AS sha256, strlen(text) AS size_bytes FROM documents")
def sha256_text(spark, sf_dir):
    return tb.read(spark, sf_dir, "documents").select(
        "doc_id", digest.sha(F.col("text")).alias("sha256"), tx.size_bytes(F.col("text")).alias("size_bytes")
    )


@query(
    "line_split",
    """
SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, chr(10))) END AS n_lines,
       length(string_split(t, chr(10))[-1]) AS last_length
FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN '' WHEN doc_id % 10 = 4 THEN text || chr(10) ELSE text END AS t
      FROM documents)""",
)
def line_split(spark, sf_dir):
    doc, text = F.col("doc_id"), F.col("text")
    varied = F.when(doc % 10 == 3, F.lit("")).when(doc % 10 == 4, F.concat(text, F.lit("\n"))).otherwise(text)
    split = tb.read(spark, sf_dir, "documents").select("doc_id", tx.lines(varied).alias("_l"))
    return split.select(
        "doc_id",
        F.size("_l").cast("bigint").alias("n_lines"),
        F.length(F.coalesce(F.try_element_at("_l", F.lit(-1)), F.lit(""))).cast("bigint").alias("last_length"),
    )


@query(
    "literal_count",
    """
SELECT doc_id, (length(text) - length(replace(text, 'en', ''))) // 2 AS n_en,
       (length(text) - length(replace(text, 'éé', ''))) // 2 AS n_accents, position('on' IN text) - 1 AS first_on
FROM documents""",
)
def literal_count(spark, sf_dir):
    text = F.col("text")
    return tb.read(spark, sf_dir, "documents").select(
        "doc_id",
        tx.literal_count(text, F.lit("en")).alias("n_en"),
        tx.literal_count(text, F.lit("éé")).alias("n_accents"),
        tx.literal_position(text, F.lit("on")).alias("first_on"),
    )


@query(
    "basename",
    stating(
        "materials",
        """
SELECT doc_id, string_split(relative_path, '/')[-1] AS display_name,
       CASE WHEN trim(string_split(replace(upload, chr(92), '/'), '/')[-1]) = '' THEN 'material'
            ELSE trim(string_split(replace(upload, chr(92), '/'), '/')[-1]) END AS upload_name
FROM (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'C:' || chr(92) || 'docs' || chr(92) || ' ' || doc_id::VARCHAR || '.txt '
                     WHEN doc_id % 4 = 1 THEN 'a/b/' ELSE relative_path END AS upload FROM materials)""",
    ),
)
def basename(spark, sf_dir):
    doc = F.col("doc_id")
    upload = (
        F.when(doc % 4 == 0, F.concat(F.lit("C:\\docs\\ "), doc.cast("string"), F.lit(".txt ")))
        .when(doc % 4 == 1, F.lit("a/b/"))
        .otherwise(F.col("relative_path"))
    )
    return tb.materials(spark, sf_dir).select(
        "doc_id", tx.basename(F.col("relative_path")).alias("display_name"), tx.upload_name(upload).alias("upload_name")
    )


@query(
    "paragraph_text",
    """
SELECT doc_id, count(*) AS n_tokens, sha256(array_to_string(list(
         CASE kind WHEN 'tab' THEN chr(9) WHEN 'break' THEN chr(10) ELSE word END ORDER BY pos), '')) AS text_sha256
FROM (SELECT doc_id, pos, word, CASE WHEN pos % 9 = 5 THEN 'tab' WHEN pos % 13 = 7 THEN 'break' ELSE 'text' END AS kind
      FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos
            FROM documents))
GROUP BY doc_id""",
)
def paragraph_text(spark, sf_dir):
    from provena.functions.tokens import plain_text

    def token(word, i):
        kind = F.when(i % 9 == 5, "tab").when(i % 13 == 7, "break").otherwise("text")
        return F.struct(kind.alias("kind"), F.when(kind == "text", word).alias("text"))

    tokens = F.transform(F.split("text", " "), token)
    return (
        tb.read(spark, sf_dir, "documents")
        .select("doc_id", tokens.alias("_t"))
        .select(
            "doc_id",
            F.size("_t").cast("bigint").alias("n_tokens"),
            digest.sha(plain_text(F.col("_t"))).alias("text_sha256"),
        )
    )


@query(
    "query_normalise",
    """
SELECT conv_id, turn, length(q) AS sent_length, len(terms) AS n_terms, array_to_string(terms, '|') AS terms
FROM (SELECT conv_id, turn, q, list_transform(list_sort(list_transform(list_distinct(w), lambda x: [lpad(list_position(w, x)::VARCHAR, 9, '0'), x])), lambda p: p[2]) AS terms
      FROM (SELECT conv_id, turn, q, list_filter(regexp_split_to_array(q, '[\\s\\x{3000}]+'), lambda x: x <> '') AS w
            FROM (SELECT conv_id, turn, regexp_replace(CASE turn % 3 WHEN 0 THEN replace(text, ' ', chr(12288)) WHEN 1 THEN replace(text, ' ', chr(9)) ELSE text END,
                         '^[\\s\\x{3000}]+|[\\s\\x{3000}]+$', '', 'g') AS q
                  FROM conversations WHERE role = 'user')))
WHERE q <> ''""",
)
def query_normalise(spark, sf_dir):
    asked = tb.read(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    # Typed with ideographic blanks or tabs in some turns.
    turn = F.col("turn") % 3
    typed = F.when(turn == 0, F.replace("text", F.lit(" "), F.lit("\u3000"))).when(turn == 1, F.replace("text", F.lit(" "), F.lit("\t"))).otherwise(F.col("text"))
    sent = asked.select("conv_id", "turn", tx.query_text(typed).alias("_q")).filter(F.col("_q") != "")
    terms = tx.query_terms(F.col("_q"))
    return sent.select(
        "conv_id", "turn",
        tx.code_points(F.col("_q")).alias("sent_length"),
        F.size(terms).cast("bigint").alias("n_terms"),
        F.array_join(terms, "|").alias("terms"),
    )


@query(
    "utc_iso",
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS stored, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown, "
    "TRUE AS round_trip FROM events",
)
def utc_iso(spark, sf_dir):
    stamped = tb.events(spark, sf_dir).withColumn("stored", tx.utc_iso(F.col("created_at")))
    return stamped.select(
        F.col("seq").alias("event_id"), "stored", tx.display_time(F.col("created_at")).alias("shown"),
        (F.to_timestamp("stored") == F.col("created_at")).alias("round_trip"),
    )


@query(
    "material_inventory",
    stating(
        "materials",
        """
SELECT task_id, artifact_id, kind, string_split(relative_path, '/')[-1] AS display_name, strlen(text) AS size_bytes,
       CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS line_count,
       len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '\\S'))) AS paragraph_count
FROM materials""",
    ),
)
def material_inventory(spark, sf_dir):
    return search.inventory(tb.materials(spark, sf_dir))


@query(
    "material_set_digest",
    stating(
        "materials",
        """
SELECT task_id, sha256(string_agg(artifact_id || ':' || sha256(text), chr(10) ORDER BY artifact_id)) AS set_digest,
       'ok' AS set_status FROM materials GROUP BY task_id""",
    ),
)
def material_set_digest(spark, sf_dir):
    return mat.set_digests(tb.hashed(tb.materials(spark, sf_dir)))


@query(
    "payload_digest",
    """
SELECT o_orderkey, sha256(concat_ws(chr(31), o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus, o_orderpriority)) AS payload_digest,
       concat_ws(':', o_custkey::VARCHAR, '1', o_orderstatus, sha256(o_orderpriority), 'v1') AS operation_key
FROM orders""",
)
def payload_digest(spark, sf_dir):
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return tb.read(spark, sf_dir, "orders").select(
        "o_orderkey",
        digest.payload_digest(key, customer, status, priority).alias("payload_digest"),
        digest.operation_key(customer, F.lit(1), status, digest.sha(priority), F.lit("v1")).alias("operation_key"),
    )


@query(
    "resolve_spans",
    stating(
        "resolved",
        """
SELECT request_id, artifact_id, span_start, span_end, status, CASE WHEN status = 'ok' THEN text_sha END AS canonical_sha256,
       sha256(exact_text) AS span_sha256, exact_text FROM resolved""",
    ),
)
def resolve_spans(spark, sf_dir):
    return spans.resolve(tb.materials(spark, sf_dir), span_requests(spark, sf_dir)).select(
        "request_id", "artifact_id", "span_start", "span_end", "status", "canonical_sha256", "span_sha256", "exact_text"
    )


def _refs(spark, sf_dir):
    """Refs of whole first lines; some are forged, moved past the end, or of an older text."""
    m = tb.materials(spark, sf_dir)
    doc, text = F.col("doc_id"), F.col("text")
    end = F.length(F.element_at(F.split(text, "\n"), 1)).cast("bigint")
    return m.select(
        "artifact_id", "doc_id",
        F.lit(0).cast("bigint").alias("span_start"),
        F.when(doc % 6 == 3, F.length(text) + 1).when(doc % 6 == 4, F.lit(0)).otherwise(end).cast("bigint").alias("span_end"),
        digest.sha(F.when(doc % 6 == 1, F.concat(text, F.lit("edit"))).otherwise(text)).alias("canonical_sha256"),
        digest.sha(
            F.when(doc % 6 == 2, F.lit("forged")).otherwise(F.element_at(F.split(text, "\n"), 1))
        ).alias("span_sha256"),
    )


define(
    "refs",
    """
SELECT artifact_id, doc_id, 0 AS span_start,
       CASE doc_id % 6 WHEN 3 THEN length(text) + 1 WHEN 4 THEN 0 ELSE length(string_split(text, chr(10))[1]) END AS span_end,
       sha256(CASE WHEN doc_id % 6 = 1 THEN text || 'edit' ELSE text END) AS canonical_sha256,
       sha256(CASE WHEN doc_id % 6 = 2 THEN 'forged' ELSE string_split(text, chr(10))[1] END) AS span_sha256
FROM materials""",
    "materials",
)


@query(
    "verify_spans",
    stating(
        "refs",
        """
SELECT r.doc_id, r.span_start, r.span_end, CASE WHEN m.text IS NULL THEN 'not_found'
         WHEN r.canonical_sha256 <> sha256(m.text) THEN 'canonical_mismatch'
         WHEN r.span_start < 0 OR r.span_end > length(m.text) THEN 'out_of_range'
         WHEN r.span_start >= r.span_end THEN 'empty'
         WHEN r.span_sha256 <> sha256(substring(m.text, r.span_start + 1, r.span_end - r.span_start)) THEN 'span_mismatch'
         ELSE 'ok' END AS status
FROM refs r LEFT JOIN materials m USING (artifact_id)""",
    ),
)
def verify_spans(spark, sf_dir):
    checked = spans.verify(tb.materials(spark, sf_dir), _refs(spark, sf_dir))
    return checked.select("doc_id", "span_start", "span_end", "status")


_HANDLES = """
SELECT r.task_id, r.artifact_id, r.span_start, r.span_end,
       CASE WHEN r.request_id % 3 = 1 THEN 'reused' WHEN r.request_id % 3 = 2 AND r.request_id % 4 = 1 THEN 'corrupt' ELSE 'issued' END AS handle_status,
       CASE WHEN r.request_id % 3 = 2 AND r.request_id % 4 = 1 THEN NULL
            WHEN r.request_id % 3 = 1 THEN 'span_' || lpad(r.request_id::VARCHAR, 32, '0')
            ELSE 'span_' || substring(sha256(concat_ws(chr(31), r.task_id, r.artifact_id, r.span_start::VARCHAR, r.span_end::VARCHAR)), 1, 32) END AS span_handle
FROM resolved r WHERE r.status = 'ok'"""


def issued_spans(spark, sf_dir, resolved):
    """Handles issued before: a third of the spans as they are, some more with moved hashes."""
    request = F.col("request_id")
    stale = (request % 3 == 2) & (request % 4 == 1)
    return resolved.filter((F.col("status") == "ok") & ((request % 3 == 1) | stale)).select(
        "task_id", "artifact_id", "span_start", "span_end",
        tb.padded_id("span", request).alias("span_handle"), "canonical_sha256",
        F.when(stale, digest.sha(F.lit("old"))).otherwise(F.col("span_sha256")).alias("span_sha256"),
    )


@query("span_handles", stating("resolved", _HANDLES))
def span_handles(spark, sf_dir):
    resolved = spans.resolve(tb.materials(spark, sf_dir), span_requests(spark, sf_dir))
    # Each request names a span once and its text once more; the repeat must not issue twice.
    twice = resolved.unionByName(resolved)
    return spans.handles(twice, issued_spans(spark, sf_dir, resolved)).select(
        "task_id", "artifact_id", "span_start", "span_end", "handle_status", "span_handle"
    )


@query(
    "verified_refs",
    stating(
        "resolved",
        """
SELECT request_id, span_handle, CASE WHEN request_id % 10 = 7 THEN 'never_issued'
         WHEN request_id % 10 = 8 THEN 'other_task' WHEN request_id % 10 = 3 THEN 'no_longer_canonical'
         WHEN request_id % 10 = 5 THEN 'span_mismatch' ELSE 'ok' END AS status
FROM (SELECT request_id, CASE WHEN request_id % 10 = 7 THEN 'span_' || repeat('0', 31) || 'f'
             ELSE 'span_' || lpad(request_id::VARCHAR, 32, '0') END AS span_handle FROM resolved WHERE status = 'ok')""",
    ),
)
def verified_refs(spark, sf_dir):
    m = tb.materials(spark, sf_dir)
    resolved = spans.resolve(m, span_requests(spark, sf_dir)).filter(F.col("status") == "ok")
    turn = F.col("request_id") % 10
    issued = resolved.select(
        tb.padded_id("span", F.col("request_id")).alias("span_handle"), "task_id", "artifact_id",
        "span_start", "span_end", "canonical_sha256",
        F.when(turn == 5, digest.sha(F.lit("old"))).otherwise(F.col("span_sha256")).alias("span_sha256"),
    )
    used = resolved.select(
        "request_id",
        F.when(turn == 8, F.concat(F.lit("task_"), F.lit("f" * 32))).otherwise(F.col("task_id")).alias("task_id"),
        F.when(turn == 7, F.lit("span_" + "0" * 31 + "f"))
        .otherwise(tb.padded_id("span", F.col("request_id"))).alias("span_handle"),
    )
    registered = tb.hashed(m).withColumn(
        "sha256", F.when(F.col("doc_id") % 10 == 3, digest.sha(F.lit("old"))).otherwise(F.col("sha256"))
    )
    return spans.verified_refs(used, issued, registered).select("request_id", "span_handle", "status")


@query(
    "locate_quotes",
    stating(
        "materials",
        """
SELECT passage_id, artifact_id, unnest(places) AS span_start, unnest(places) + n AS span_end, canonical_sha256, span_sha256
FROM (SELECT b.item_id AS passage_id, m.artifact_id, length(b.text) AS n, sha256(m.text) AS canonical_sha256, sha256(b.text) AS span_sha256,
             list_filter(range(0, length(m.text) - length(b.text) + 1), lambda i: substr(m.text, i + 1, length(b.text)) = b.text) AS places
      FROM materials m JOIN benchmark b ON contains(m.text, b.text))""",
    ),
)
def locate_quotes(spark, sf_dir):
    quotes = tb.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("passage_id"), F.col("text").alias("quote"))
    return spans.locate(tb.materials(spark, sf_dir), quotes)


@query(
    "list_materials",
    stating(
        "materials",
        """
SELECT task_id, artifact_id, list_pos, total_matched, total_matched > 8 AS truncated
FROM (SELECT task_id, artifact_id, row_number() OVER (PARTITION BY task_id ORDER BY created_at, artifact_id) AS list_pos,
             count(*) OVER (PARTITION BY task_id) AS total_matched FROM materials) WHERE list_pos <= 8""",
    ),
)
def list_materials(spark, sf_dir):
    listed = search.listing(tb.materials(spark, sf_dir), limit=8)
    return listed.select(
        "task_id", "artifact_id", F.col("list_pos").cast("bigint").alias("list_pos"), "total_matched", "truncated"
    )


define(
    "asked",
    """
SELECT min(doc_id) AS query_id, task_id, arg_min(array_to_string(string_split(text, ' ')[1:3], ' '), doc_id) AS query
FROM materials GROUP BY task_id""",
    "materials",
)
define(
    "hits",
    """
SELECT query_id, task_id, artifact_id, total + len(list_filter(counts, lambda c: c > 0)) AS score, total AS match_count,
       CASE WHEN n <= 200 THEN text ELSE CASE WHEN l > 0 THEN '…' ELSE '' END || substring(text, l + 1, 198) ||
            CASE WHEN l + 198 < n THEN '…' ELSE '' END END AS snippet
FROM (SELECT *, list_sum(counts)::BIGINT AS total, length(text) AS n,
             greatest(0, least(list_min(list_filter(places, lambda p: p >= 0)), length(text) - 198)) AS l
      FROM (SELECT q.query_id, m.task_id, m.artifact_id, m.text,
                   list_transform(terms, lambda t: (length(m.text) - length(replace(m.text, t, ''))) // length(t)) AS counts,
                   list_transform(terms, lambda t: position(t IN m.text) - 1) AS places
            FROM materials m JOIN (SELECT query_id, task_id, list_filter(list_distinct(regexp_split_to_array(query, '\\s+')), lambda x: x <> '') AS terms FROM asked) q
            ON q.task_id = m.task_id))
WHERE total > 0""",
    "asked",
)


def asked(spark, sf_dir):
    """One query per task: the first words of its first material."""
    opening = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    openings = tb.materials(spark, sf_dir).select("task_id", F.col("doc_id").alias("query_id"), opening.alias("query"))
    # Queries of known size: few are broadcast to the bodies, many are joined to them.
    return settle(first_rows(openings, ["task_id"], [F.col("query_id")], ["query_id", "query"]), "queries")


@query("search_materials", stating("hits", "SELECT query_id, task_id, artifact_id, score, match_count, snippet FROM hits"))
def search_materials(spark, sf_dir):
    return search.score(tb.materials(spark, sf_dir), asked(spark, sf_dir))


@query(
    "search_topk",
    stating(
        "hits",
        """
SELECT query_id, artifact_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, artifact_id) AS rank
FROM hits) WHERE rank <= 5""",
    ),
)
def search_topk(spark, sf_dir):
    best = search.search(tb.materials(spark, sf_dir), asked(spark, sf_dir), top_k=5)
    return best.select("query_id", "artifact_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(
    "line_offsets",
    stating(
        "materials",
        """
SELECT artifact_id, line_no, coalesce(sum(line_length + 1) OVER (PARTITION BY artifact_id ORDER BY line_no
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line_start, line_length
FROM (SELECT artifact_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no,
             length(unnest(string_split(text, chr(10)))) AS line_length FROM materials WHERE text <> '')""",
    ),
)
def line_offsets(spark, sf_dir):
    return mat.line_offsets(tb.materials(spark, sf_dir))


@query(
    "adaptive_budget",
    stating(
        "tasks",
        "SELECT task_id, least(20 + 6 * greatest(0, material_count - 1), 80) AS max_calls, "
        "least(40000 + 8000 * greatest(0, material_count - 1), 160000) AS max_chars FROM tasks",
    ),
)
def adaptive_budget(spark, sf_dir):
    return search.adaptive_budget(tb.tasks(spark, sf_dir))


@query(
    "material_count",
    stating(
        "materials",
        """
SELECT t.task_id, count(m.artifact_id) AS material_count
FROM (SELECT DISTINCT 'task_' || lpad(user_id::VARCHAR, 32, '0') AS task_id FROM events) t LEFT JOIN materials m USING (task_id)
GROUP BY t.task_id""",
    ),
)
def material_count(spark, sf_dir):
    known = tb.events(spark, sf_dir).select("task_id").distinct()
    return mat.counts(known, tb.materials(spark, sf_dir)).select("task_id", "material_count")


_CALLS = "SELECT user_id AS turn, event_id AS call_no, (value * 10)::INT::BIGINT AS chars FROM events"


def tool_calls(spark, sf_dir):
    """Events as tool calls: the user's turn, the call's order and the characters it would return."""
    return tb.read(spark, sf_dir, "events").select(
        F.col("user_id").alias("turn"), F.col("event_id").alias("call_no"),
        F.bround(F.col("value") * 10).cast("bigint").alias("chars"),
    )


@query(
    "budget_admission",
    f"""
SELECT turn, call_no, CASE WHEN pos > 20 THEN 'refused_calls' WHEN fits THEN 'admitted' ELSE 'refused_chars' END AS outcome,
       CASE WHEN pos <= 20 THEN used END AS chars_used
FROM (WITH RECURSIVE calls AS (SELECT *, row_number() OVER (PARTITION BY turn ORDER BY call_no) AS pos FROM ({_CALLS})),
      fold AS (SELECT turn, call_no, pos, chars <= 3000 AS fits, CASE WHEN chars <= 3000 THEN chars ELSE 0 END AS used FROM calls WHERE pos = 1
               UNION ALL
               SELECT c.turn, c.call_no, c.pos, f.used + c.chars <= 3000, CASE WHEN f.used + c.chars <= 3000 THEN f.used + c.chars ELSE f.used END
               FROM fold f JOIN calls c ON c.turn = f.turn AND c.pos = f.pos + 1 WHERE f.pos < 20)
      SELECT c.turn, c.call_no, c.pos, f.fits, f.used FROM calls c LEFT JOIN fold f ON f.turn = c.turn AND f.pos = c.pos)""",
)
def budget_admission(spark, sf_dir):
    return search.admit(tool_calls(spark, sf_dir), F.lit(20), F.lit(3000))


@query(
    "call_cap",
    f"""
SELECT turn, call_no, call_pos, sum(chars) OVER (PARTITION BY turn ORDER BY call_no)::BIGINT AS running_chars
FROM (SELECT *, row_number() OVER (PARTITION BY turn ORDER BY call_no) AS call_pos FROM ({_CALLS})) WHERE call_pos <= 20""",
)
def call_cap(spark, sf_dir):
    kept = search.within_calls(tool_calls(spark, sf_dir), 20)
    return kept.select("turn", "call_no", F.col("call_pos").cast("bigint").alias("call_pos"), "running_chars")
