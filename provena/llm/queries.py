"""The registered queries of this subpackage, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm import bpe, common, conversations, decontamination, hardneg, htmltext, idindex, jaccard, langid, licenses, neighbours, quality, topk, toxicity
from provena.llm.common import ORACLE, QUERIES, query  # noqa: F401


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labels outside part 0 of 5."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return docs.select(
        "doc_id", (common.fold(F.col("doc_id"), 5) == 0).alias("held_out"), toxicity.score(F.col("text"), model).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op6_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from rows outside part 2 of 4."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    return docs.select(
        "doc_id", (common.fold(F.col("doc_id"), 4) == 2).alias("held_out"), langid.identify(F.col("text"), model).alias("p")
    ).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", "p.rejected")


@query("op10_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from labels outside part 2 of 4."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    return docs.select(
        "doc_id", (common.fold(F.col("doc_id"), 4) == 2).alias("held_out"), quality.score(F.col("text"), model).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query("op4_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, its numbers, names and units exchanged or not."""
    found = decontamination.find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "windows", "share", "exact")


def _licence_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in licenses.KNOWN)

    def form(text: str) -> str:
        out = f"regexp_replace(lower({text}), {quoted(licenses.COPYRIGHT)}, '\\1', 'g')"
        out = f"' ' || regexp_replace({out}, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', '  ', 'g') || ' '"
        for other, usual in licenses.SPELLINGS:
            out = f"replace({out}, ' {other} ', ' {usual} ')"
        return f"sha256(trim(regexp_replace({out}, ' +', ' ', 'g'), ' '))"

    return f"""
    WITH known AS (SELECT {form('text')} AS digest, min(license_id) AS license_id FROM (VALUES {known}) k(license_id, text) GROUP BY 1),
    units AS (
      SELECT doc_id, 0 AS line_no, text AS unit FROM documents WHERE text IS NOT NULL
      UNION ALL
      SELECT doc_id, unnest(range(1, len(lines) + 1))::INT AS line_no, unnest(lines) AS unit
      FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text LIKE '%' || chr(10) || '%')
    )
    SELECT doc_id, line_no, license_id, digest FROM (SELECT doc_id, line_no, {form('unit')} AS digest FROM units WHERE trim(unit, ' ') <> '' OR line_no = 0)
    JOIN known USING (digest)
    """


@query("op8_licenses", _licence_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and lines that are a known licence text."""
    return licenses.scan(common.table(spark, sf_dir, "documents"), licenses.built_in(spark))


@query("op7_jaccard")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by word 5-grams with a Jaccard similarity of 0.75 or more."""
    return jaccard.join(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op5_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as ids of the many-language vocabulary, and back."""
    ranks = common.resource(common.tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    both = bpe.encode(common.table(spark, sf_dir, "documents"), ranks, decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_idindex")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written in order of the ids and read back through the index."""
    docs = common.table(spark, sf_dir, "documents")
    path = idindex.folder(spark)
    idindex.write(docs, common.resource(common.tokenizer_path("byte_bpe_50k.json")).decode("utf-8"), path)
    return idindex.read(spark, path, docs).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op2_neighbours")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every vector whose id is divisible by 20."""
    return neighbours.search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op9_pagetext")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = common.table(spark, sf_dir, "pages")
    return htmltext.extract(pages, htmltext.fit(pages))


def _whole_vectors(scale: int, label: str = "1") -> str:
    """SQL: the rows that take part, their components as whole doubles."""
    return f"""whole AS (
      SELECT vec_id, {label} AS label, list_transform(embedding, lambda c: floor({scale} * c::DOUBLE)) AS x FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND {label} IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    )"""


TOPK_SQL = f"""
    WITH {_whole_vectors(1024)},
    scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM whole q JOIN whole c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
    )
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored
    QUALIFY rank <= 10
"""


@query("op13_topk", TOPK_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest inner products for every vector whose id is divisible by 100."""
    return topk.search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


HARD_SQL = f"""
    WITH {_whole_vectors(256, "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")},
    scored AS (
      SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.x, c.x)::BIGINT AS score
      FROM whole a JOIN whole c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
    ),
    positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INT AS rank,
           n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
    QUALIFY rank <= 10
"""


@query("op12_hardneg", HARD_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100, a seventh of the labels wrong."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(common.table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


CONVERSATIONS_SQL = r"""
    WITH RECURSIVE keyed AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS bytes
      FROM conversations
    ),
    kinds AS (
      SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b:
             list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS kind
      FROM keyed
    ),
    damaged AS (
      SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
      FROM kinds
    ),
    placed AS (
      SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
             rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
      FROM damaged
    ),
    marked AS (
      SELECT *, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd'
                     WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, left(role, 1) AS initial,
             lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before, count(*) OVER (PARTITION BY conv_id) AS n
      FROM placed
    ),
    counts AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
             count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
             count(*) FILTER (pos > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
      FROM marked GROUP BY conv_id
    ),
    moves(src, n, mid, lines) AS (VALUES
      (0, 0, 0, []::VARCHAR[]), (0, 1, 2, ['user:']), (0, 2, 3, ['user:', 'assistant:']), (1, 0, 1, []), (1, 1, 2, ['user:']), (1, 2, 3, ['user:', 'assistant:']),
      (2, 0, 2, []), (2, 1, 3, ['assistant:']), (2, 2, 2, ['assistant:', 'user:']), (3, 0, 3, []), (3, 1, 2, ['user:']), (3, 2, 3, ['user:', 'assistant:'])
    ),
    walk AS (
      SELECT DISTINCT conv_id, 0::BIGINT AS pos, 0 AS state, {'cost': 0::BIGINT, 'audit': ''::VARCHAR, 'lines': []::VARCHAR[]} AS best FROM marked
      UNION ALL
      SELECT conv_id, pos, state, min(best) AS best
      FROM (
        SELECT r.conv_id, r.pos, e.dst AS state,
               {'cost': w.best.cost + 5 * m.n + e.cost + CASE WHEN e.letter <> 'D' AND r.fault = 't' THEN 5 ELSE 0 END, 'audit': w.best.audit || repeat('I', m.n) || e.letter,
                'lines': list_concat(w.best.lines, m.lines, CASE e.letter WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text]
                         ELSE [CASE e.dst WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || r.text] END)} AS best
        FROM walk w JOIN marked r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.pos = w.pos + 1
        JOIN moves m ON m.src = w.state
        JOIN (VALUES ('D', NULL, 0, 0, 2), ('D', NULL, 1, 1, 2), ('D', NULL, 2, 2, 2), ('D', NULL, 3, 3, 2), ('R', NULL, 0, 2, 1), ('R', NULL, 1, 2, 1), ('R', NULL, 2, 3, 1), ('R', NULL, 3, 2, 1),
              ('K', 's', 0, 1, 0), ('K', 'u', 0, 2, 0), ('K', 'u', 1, 2, 0), ('K', 'a', 2, 3, 0), ('K', 'u', 3, 2, 0)) e(letter, initial, mid, dst, cost)
          ON e.mid = m.mid AND (e.letter <> 'K' OR e.initial = r.initial) AND (e.letter = 'D' OR r.fault NOT IN ('b', 'd'))
      ) GROUP BY conv_id, pos, state
    ),
    ended AS (
      SELECT w.conv_id, min({'cost': w.best.cost + 5 * m.n, 'audit': w.best.audit || repeat('I', m.n), 'lines': list_concat(w.best.lines, m.lines)}) AS best
      FROM walk w JOIN (SELECT DISTINCT conv_id, n FROM marked) t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.pos JOIN moves m ON m.src = w.state AND m.mid IN (0, 3) GROUP BY w.conv_id
    )
    SELECT i.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
           coalesce(e.best.cost, 0) AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(array_to_string(e.best.lines, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM i.conv_id
"""


@query("op11_conversations", CONVERSATIONS_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and the cheapest repair of every conversation, after damage."""
    rows = common.table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damage(rows), rows)
