"""Canonical text, spans, search and budgets on small literal cases and against plain Python."""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provena.functions import digest
from provena.functions import text as tx
from provena.operators import materials as mat
from provena.operators import search, spans

TEXTS = st.lists(
    st.text(st.characters(exclude_categories=["Cs"]), max_size=40) | st.text("ab é́e\r\n\x07# 가\u1100\u1161", max_size=40),
    min_size=1, max_size=30,
)
FEW = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def texts_frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, text string")


def column(df, expression):
    return [r[1] for r in sorted(df.select("i", expression.alias("x")).collect())]


@FEW
@given(TEXTS)
def test_canonical_equals_python(spark, values):
    got = column(texts_frame(spark, values), tx.canonical(F.col("text")))
    want = [unicodedata.normalize("NFC", v).replace("\r\n", "\n").replace("\r", "\n") for v in values]
    assert got == want


@FEW
@given(TEXTS)
def test_illegal_positions_equal_python(spark, values):
    got = column(texts_frame(spark, values), tx.illegal_positions(F.col("text")))
    assert got == [[i for i, c in enumerate(v) if ord(c) < 32 and c not in "\t\n\r"] for v in values]


def test_illegal_positions_when_there_are_many(spark):
    noisy = "\x07a\x01" * 2000
    got = column(texts_frame(spark, [noisy]), tx.illegal_positions(F.col("text")))[0]
    assert got == [i for i, c in enumerate(noisy) if ord(c) < 32]


@FEW
@given(TEXTS, st.integers(0, 30), st.integers(0, 40))
def test_slices_and_snippets_equal_python(spark, values, start, limit):
    frame = texts_frame(spark, values)
    assert column(frame, tx.slice_points(F.col("text"), F.lit(start), F.lit(start + 7))) == [v[start:start + 7] for v in values]

    def snippet(v):
        if len(v) <= limit:
            return v
        if limit <= 3:
            return "…"
        left = max(0, min(start, len(v) - (limit - 2)))
        right = left + limit - 2
        return ("…" if left else "") + v[left:right] + ("…" if right < len(v) else "")

    assert column(frame, tx.snippet(F.col("text"), F.lit(start), limit)) == [snippet(v) for v in values]


@FEW
@given(TEXTS, st.text("ab é", min_size=1, max_size=3))
def test_counts_equal_python(spark, values, term):
    frame = texts_frame(spark, values)
    assert column(frame, tx.literal_count(F.col("text"), F.lit(term))) == [v.count(term) for v in values]
    assert column(frame, tx.literal_position(F.col("text"), F.lit(term))) == [v.find(term) for v in values]


def test_canonical_literals(spark):
    frame = texts_frame(spark, ["a\r\nb\rc\n\rd", "e\u0301", "\U00010000"])
    assert column(frame, tx.canonical(F.col("text"))) == ["a\nb\nc\n\nd", "\u00e9", "\U00010000"]
    assert column(frame, tx.size_bytes(F.col("text")))[2] == 4


def test_ingest_rejects_bad_bytes_and_keeps_controls(spark):
    uploads = spark.createDataFrame([("a", bytearray(b"ok\x07text")), ("b", bytearray(b"\xff\xfe")), ("c", bytearray(b"\x80"))], "id string, content binary")
    canonical, rejected = mat.ingest(uploads)
    assert [(r.id, r.illegal_positions) for r in canonical.collect()] == [("a", [2])]
    assert {r.id for r in rejected.collect()} == {"b", "c"}


def test_resolve_span_statuses(spark):
    materials = spark.createDataFrame([("t", "m", "a\U0001f600b"), ("t", "h", "hello")], "task_id string, artifact_id string, text string")
    asked = [(1, "t", "m", 1, 2), (2, "t", "h", 2, 2), (3, "t", "h", 3, 2), (4, "t", "h", 0, 6), (5, "t", "h", -1, 3), (6, "u", "h", 0, 1)]
    requests = spark.createDataFrame(asked, "request_id int, task_id string, artifact_id string, span_start bigint, span_end bigint")
    rows = {r.request_id: r for r in spans.resolve(materials, requests).collect()}
    assert rows[1].exact_text == "\U0001f600" and rows[1].span_sha256 == hashlib.sha256("\U0001f600".encode()).hexdigest()
    assert [rows[i].status for i in range(1, 7)] == ["ok", "empty", "empty", "out_of_range", "out_of_range", "not_found"]


def test_quotes_of_every_length_are_found(spark):
    words = [f"w{i}" for i in range(40)]
    docs = [(f"d{i}", "x" + " ".join(words[i:i + 30]) + "y\nz") for i in range(8)]
    materials = spark.createDataFrame(docs, "artifact_id string, text string")
    quotes = [(n * 10 + k, " ".join(words[k:k + n])) for n in (1, 2, 3, 4, 6, 7, 9, 20) for k in (5, 11)] + [(990, "7 w8 w"), (991, "30"), (992, "absent words here now ok yes no")]
    passages = spark.createDataFrame(quotes, "passage_id int, quote string")
    got = {(r.passage_id, r.artifact_id, r.span_start, r.span_end) for r in spans.locate(materials, passages).collect()}
    want = {(p, a, t.find(q), t.find(q) + len(q)) for p, q in quotes for a, t in docs if q in t}
    assert got == want and want


def test_search_scores_and_order(spark):
    materials = spark.createDataFrame(
        [("t", "b", "销售 华东 华东 销售 华东"), ("t", "a", "会议 销售"), ("u", "c", "销售")], "task_id string, artifact_id string, text string"
    )
    queries = spark.createDataFrame([(1, "t", " 华东 销售 华东 "), (2, "t", "  ")], "query_id int, task_id string, query string")
    rows = search.search(materials, queries, top_k=5).orderBy("rank").collect()
    assert [(r.query_id, r.artifact_id, r.score, r.match_count) for r in rows] == [(1, "b", 7, 5), (1, "a", 2, 1)]
    assert len(search.search(materials, queries, top_k=5, cap=1).collect()) == 1
    many = spark.range(15).select(F.lit("t").alias("task_id"), F.col("id").cast("string").alias("artifact_id"), F.lit("华东").alias("text"))
    assert search.search(many, queries, top_k=12).count() == 12
    with pytest.raises(ValueError):
        search.search(materials, queries, top_k=0)


def test_budget_refusals_use_calls_but_no_characters(spark):
    calls = spark.createDataFrame([(1, 1, 40), (1, 2, 14), (1, 3, 10), (1, 4, 1)], "turn bigint, call_no bigint, chars bigint")
    rows = {r.call_no: (r.outcome, r.chars_used) for r in search.admit(calls, F.lit(3), F.lit(50)).collect()}
    assert rows == {1: ("admitted", 40), 2: ("refused_chars", 40), 3: ("admitted", 50), 4: ("refused_calls", None)}


def test_digests_of_sets_of_any_size_have_one_form(spark):
    rows = spark.range(200).select(F.lit("hot").alias("task_id"), F.col("id").cast("string").alias("artifact_id"), F.lit("s").alias("sha256"))
    small = spark.createDataFrame([("ok", "b", "2"), ("ok", "a", "1"), (None, "c", "3")], "task_id string, artifact_id string, sha256 string")
    want = hashlib.sha256("\n".join(f"{i}:s" for i in sorted(map(str, range(200)))).encode()).hexdigest()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.task_id: r.set_digest for r in mat.set_digests(rows.unionByName(small).orderBy(F.desc("artifact_id"))).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {"hot": want, "ok": hashlib.sha256(b"a:1\nb:2").hexdigest(), None: hashlib.sha256(b"c:3").hexdigest()}
    assert mat.set_digests(rows.limit(0)).collect() == []


def test_ordered_digests_leave_null_lines_out(spark):
    rows = spark.createDataFrame(
        [(1, 2, "b", 2), (1, 1, None, None), (1, 3, "é", 1), (None, 1, "x", 4), (2, 1, None, 1)], "k long, pos int, line string, n int"
    )
    got = {r.k: (r.digest, r.total) for r in digest.ordered_digests(rows, ["k"], [F.col("pos")], F.col("line"), "|", F.col("n")).collect()}
    want = {1: ("b|é", 3), None: ("x", 4), 2: ("", 1)}
    assert got == {k: (hashlib.sha256(t.encode()).hexdigest(), n) for k, (t, n) in want.items()}


def test_quotes_are_found_at_every_place(spark):
    texts = {
        "a": "one two three four one two three four one two three four", "b": "concatenate the cat, cat", "c": "aaaa", "d": r"a \E b \Q a \E b", "e": "x  \n y\n\nz", "f": "", "g": "la la la la la la la",
        "h": "quoted (regex) [here]* +? $^", "i": None, "j": "foo barn, snafoo bard",
    }
    quotes = ["one two three four one", "cat", "aa", r"a \E b", "\n", " ", "la la la", "la la la la la", "(regex) [here]* +?", "", "foo bar", "absent words here", "a", None, "é"]
    materials = spark.createDataFrame(list(texts.items()), "artifact_id string, text string")
    passages = spark.createDataFrame(list(enumerate(quotes)), "passage_id long, quote string")
    want = {
        (p, a, i, i + len(q)) for p, q in enumerate(quotes) if q for a, t in texts.items() if t for i in range(len(t)) if t.startswith(q, i)
    }
    got = spans.locate(materials, passages).collect()
    assert {(r["passage_id"], r["artifact_id"], r["span_start"], r["span_end"]) for r in got} == want and len(got) == len(want)


def test_composing_holds_few_texts_at_a_time(monkeypatch):
    """Long batches are composed in runs of bytes, and what is composed already is not copied."""
    values = pa.array(["é" * 9, None, "é" * 40, "", "plain", "å"] * 50)
    want = [None if v is None else unicodedata.normalize("NFC", v) for v in values.to_pylist()]
    sizes = [sum(len(v.encode()) for v in part.to_pylist() if v) for part in tx.slices(values, 100)]
    assert len(sizes) > 50 and max(sizes) <= 100
    monkeypatch.setattr(tx, "SLICE_BYTES", 100)
    for part in (values, values.slice(7, 90), values.slice(0, 0), values.cast(pa.large_string())):
        assert tx.composed(part).to_pylist() == [None if v is None else unicodedata.normalize("NFC", v) for v in part.to_pylist()]
    assert tx.composed(values).to_pylist() == want
    whole = pa.array(["été", None, "x"])
    assert tx.composed(whole) is whole
