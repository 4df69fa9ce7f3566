"""Archives, web pages, sinks and streams."""

from __future__ import annotations

import hashlib
import html
import json
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from provena import session
from provena.functions import web as wf
from provena.operators import packages, templates, web
from provena.sources import sinks
from provena.streaming import feeds


def test_listings_over_a_limit(spark):
    rows = spark.createDataFrame([("f", "a", 10, 5), ("f", "b", 10, 6), ("g", "a", 99, 1), ("h", None, 1, None)], "file string, entry string, file_bytes bigint, declared_size bigint")
    got = {(r.file, r.code, r.detail) for r in packages.limits(rows, max_entries=1, max_bytes=50, max_expanded=10).collect()}
    assert got == {
        ("f", "ZIP_TOO_MANY_ENTRIES", "has 2 entries, 1 allowed"), ("f", "ZIP_EXPANSION_OVER_LIMIT", "has 11 declared bytes, 10 allowed"),
        ("g", "ZIP_OVERSIZED", "has 99 bytes, 50 allowed"),
    }


@pytest.mark.parametrize(
    "name, text", [("gbk", "风险　计划"), ("Big5", "計劃"), ("shift_jis", "計画です"), ("windows-1252", "“é” €"), ("utf-8", "é"), ("iso-8859-1", "é"), ("no-such", "plain"), (None, "é")]
)
def test_bodies_decode_by_any_charset(spark, name, text):
    raw = text.encode(name if name and name != "no-such" else "utf-8")
    kind = "text/html" + (f"; charset={name}" if name else "")
    row = spark.createDataFrame([(bytearray(raw), kind)], "body binary, kind string").select(wf.decode_body(F.col("body"), F.col("kind")).alias("t")).first()
    assert row.t == text


class Stripper(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


PAGES = [
    "<p>Fresh &amp; clean</p><script>x = '<p>';</script><style>p{}</style>", "a < b &lt; c &eacute; &#x41; &amp;lt; AT&T",
    '<!doctype html><a title="x > y">t</a><!-- <b>no</b> -->tail', "<SCRIPT type=x>1</SCRIPT >after<br/>", "plain", "1 &copy; 2 &nbsp;&hellip;",
]


def test_html_to_text_equals_a_parser(spark):
    rows = spark.createDataFrame(list(enumerate(PAGES)), "i int, html string")
    got = [r.text for r in wf.html_to_text(rows, "html", "text").orderBy("i").collect()]
    want = []
    for page in PAGES:
        stripper = Stripper()
        stripper.feed(page)
        stripper.close()
        want.append("".join(stripper.out))
    assert got == want


def test_result_blocks_of_both_layouts(spark):
    listing = (
        '<li class="b_algo"><h2><a href="http://a/?x=1&amp;y">T <b>1</b></a></h2><p>s &quot;1&quot;</p></li><li class="b_algo"><h2>none</h2></li>'
        '<li  class="b_algo"><h2><a href="http://b"> </a></h2></li><li class="b_algo"><div href="https://c">Any</a></div></li>'
    )
    heads = '<h3 class="vr-title"><a href="/link?u=1">One</a></h3><p>p1</p><h3 class="x vr-title y"><a href="http://two">Two</a></h3>tail<h3>plain</h3>'
    rows = spark.createDataFrame([(1, listing)], "k int, markup string")
    got = [(r.url, r.title, r.snippet) for r in web.result_blocks(rows, "k", web.LIST_LAYOUT, 10).orderBy("block_no").collect()]
    assert got == [("http://a/?x=1&y", "T 1", 's "1"'), ("https://c", "Any", "")]
    rows = spark.createDataFrame([(1, heads)], "k int, markup string")
    got = [(r.url, r.title, r.snippet) for r in web.result_blocks(rows, "k", web.HEADING_LAYOUT, 10).orderBy("block_no").collect()]
    assert got == [("https://www.sogou.com/link?u=1", "One", "p1"), ("http://two", "Two", "")]


def test_unescape_equals_the_library(spark):
    cases = ["&amp;lt;", "&lt;&gt;", "&#39;&#x27;", "&unknown; &ampx", "& b", "&eacute", "&amp;amp;"]
    rows = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r.x for r in rows.select(wf.unescape(F.col("t")).alias("x")).collect()] == [html.unescape(c) for c in cases]


def test_sink_writes_once(spark):
    path = session.work_dir(spark, "sink")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "sha256 string, code_points bigint")
    for _ in range(2):
        sinks.store(rows, path, "sha256", "code_points")
    sinks.store(spark.createDataFrame([("c", 3), ("a", 1)], rows.schema), path, "sha256", "code_points")
    assert sorted(r.sha256 for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_a_store_keeps_one_row_a_key_and_refuses_conflicts(spark, tmp_path):
    path, schema = str(tmp_path / "store"), "name string, digest string, at bigint"

    def put(rows):
        return sorted((tuple(r) for r in sinks.store(spark.createDataFrame(rows, schema), path, "name", "digest", "at").collect()), key=repr)

    first = [("a", "1", 1), ("b", "2", 2), ("b", "2", 3), ("b", "9", 4), ("b", "2", 2)]
    assert put(first) == [("a", "1", 1, "write"), ("b", "2", 2, "write"), ("b", "2", 2, "write"), ("b", "2", 3, "reuse"), ("b", "9", 4, "refuse")]
    assert {r[3] for r in put(first)} == {"reuse", "refuse"}
    rows = [("a", "5", 1), ("a", "1", 2), ("c", "3", 9), (None, "1", 1), ("d", None, 1)]
    assert sorted(r[3] for r in put(rows)) == ["refuse", "refuse", "refuse", "reuse", "write"]
    assert put([]) == []
    held = sinks.stored_rows(spark, path, spark.createDataFrame([], schema).schema)
    assert sorted(tuple(r) for r in held.collect()) == [("a", "1", 1), ("b", "2", 2), ("c", "3", 9)]


def test_a_write_that_broke_off_is_finished_when_run_again(spark, tmp_path):
    path, rows = str(tmp_path / "store"), spark.range(200).select(F.col("id").cast("string").alias("name"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    sinks.store(rows.filter("name % 3 = 0"), path, "name", "digest")
    outcomes = {r.outcome: r["count"] for r in sinks.store(rows, path, "name", "digest").groupBy("outcome").count().collect()}
    assert outcomes == {"reuse": 67, "write": 133}
    held = sinks.stored_rows(spark, path, rows.schema)
    assert held.count() == held.distinct().count() == 200 and held.exceptAll(rows).count() == 0


def test_a_log_is_appended_to_once(spark, tmp_path):
    path, log = str(tmp_path / "log"), spark.createDataFrame([(4,), (7,)], "seq bigint")

    def batch(*keys):
        return spark.createDataFrame([(k,) for k in keys], "k bigint")

    sinks.append_log(log, batch(30, 10, 10), path, "k", "k")
    sinks.append_log(log, batch(30, 10), path, "k", "k")
    rows = sinks.append_log(log, batch(5, 30, 20), path, "k", "k").collect()
    assert sorted((r.seq, r.k) for r in rows) == [(8, 10), (9, 30), (10, 5), (11, 20)]
    assert sinks.append_log(log.limit(0), batch(1), str(tmp_path / "new"), "k", "k").first().seq == 0


def test_stream_state_survives_a_restart(spark, tmp_path):
    """Two runs over one checkpoint: the second sees what the first stored."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = "request_key string, seq bigint, digest string"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = feeds.idempotency(spark.readStream.schema(schema).parquet(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return {r.seq: r.outcome for r in spark.read.parquet(out).collect()}

    assert run([("k", 1, "x"), ("k", 2, "x"), ("j", 3, "y")]) == {1: "new", 2: "replay", 3: "new"}
    assert run([("k", 4, "z"), ("j", 5, "y"), ("n", 6, "q")]) == {1: "new", 2: "replay", 3: "new", 4: "conflict", 5: "replay", 6: "new"}


def test_template_findings(spark):
    def paragraph(idx, text, runs=None, name=None, closed=True):
        marks = [{"id": "1", "name": name, "closed": closed}] if name else []
        return {"idx": idx, "text": text, "run_texts": runs or [text], "bookmarks": marks}

    kind = "array<struct<idx:int,text:string,run_texts:array<string>,bookmarks:array<struct<id:string,name:string,closed:boolean>>>>"
    docs = {
        "fine": [paragraph(0, "{{ s }}", name="s")], "missing": [paragraph(0, "text")], "twice": [paragraph(0, "{{ s }}", name="s"), paragraph(1, "{{ s }}")],
        "torn": [paragraph(0, "{{ s"), paragraph(1, " }}")], "beside": [paragraph(0, "see {{ s }}", name="s")],
        "runs": [paragraph(0, "{{ s }}", ["{{ ", "s }}"], "s")], "bare": [paragraph(0, "{{ s }}")], "open": [paragraph(0, "{{ s }}", name="s", closed=False)],
        "stray": [paragraph(0, "{{ s }}", name="s"), paragraph(1, "x {{ other }} {{ a.b }}")], "jinja": [paragraph(0, "{{ s }}", name="s"), paragraph(1, "{% if %}")],
    }
    frame_ = spark.createDataFrame(list(docs.items()), f"template_id string, paragraphs {kind}")
    slots = spark.createDataFrame([(d, "s", "{{ s }}") for d in docs], "template_id string, slot_id string, placeholder string")
    got: dict = {d: set() for d in docs}
    for r in templates.placeholder_findings(frame_, slots).collect():
        got[r.template_id].add(r.code)
    assert got == {
        "fine": set(), "missing": {"PLACEHOLDER_MISSING"}, "twice": {"PLACEHOLDER_DUPLICATE"}, "torn": {"PLACEHOLDER_FRAGMENTED"},
        "beside": {"PLACEHOLDER_NOT_ALONE"}, "runs": {"PLACEHOLDER_SPLIT_RUN"}, "bare": {"PLACEHOLDER_MISSING_ANCHOR"},
        "open": {"PLACEHOLDER_MISSING_ANCHOR"}, "stray": {"PLACEHOLDER_UNDECLARED", "PLACEHOLDER_NOT_VARIABLE"}, "jinja": {"JINJA_CONTROL_SYNTAX"},
    }


def test_odd_items_and_charsets_spoil_nothing(spark):
    payloads = [
        (1, '{"results":["x",{"title":"T","url":"u","content":"","snippet":"s"},null,[1],7,{"title":5}]}'), (2, '{"results":["x",null]}'), (3, '{"results":{}}'), (4, "[]"), (5, None), (6, '{"results":[{"url":"a"},{"url":"b"}]}'),
    ]
    df = spark.createDataFrame(payloads, "id long, payload string")
    got = {(r["id"], r["problem"], r["result_no"], r["title"], r["url"], r["snippet"]) for r in web.json_results(df, "id").collect()}
    assert got >= {(1, None, 1, "T", "u", "s"), (1, None, 5, "5", "", ""), (3, "no 'results' array", None, None, None, None), (4, "not a JSON object", None, None, None, None), (6, None, 0, "", "a", ""), (6, None, 1, "", "b", "")}
    assert not {g for g in got if g[0] == 2}
    assert {r["result_no"] for r in web.json_results(df.where("id = 6"), "id", 1).collect()} == {0}
    bodies = [(n, bytearray(b"caf\xc3\xa9 ok")) for n in ("idna", "undefined", "none\x00such", "nosuch", "rot13", "utf-8", "hex", "zip")]
    read = spark.createDataFrame([(f"text/html; charset={n}", b) for n, b in bodies], "kind string, body binary").select("kind", wf.decode_body(F.col("body"), F.col("kind")).alias("text"))
    assert all(r["text"] is not None and "ok" in r["text"] for r in read.collect())


def test_pages_are_whole_unless_a_limit_is_set(spark):
    body = "<p>" + "ä" * 30000 + "</p>"
    pages = spark.createDataFrame([("http://a.example/", 200, "text/html; charset=utf-8", body.encode()), ("http://a.example/", 500, "text/html", b"x")], "url string, status int, content_type string, body binary")
    assert [(r.text, r.truncated) for r in web.page_text(pages).orderBy("status").collect()] == [("ä" * 30000, False), (None, False)]
    assert [(r.text, r.truncated) for r in web.page_text(pages, max_chars=5).orderBy("status").collect()] == [("ä" * 5, True), (None, False)]
    assert [(r.text, r.truncated) for r in web.page_text(pages, max_chars=50, max_bytes=9).orderBy("status").collect()] == [("ä" * 3, True), (None, False)]


def test_sources_that_differ_late_have_digests_of_their_own(spark):
    long = "x" * 50000
    rows = spark.createDataFrame([("t", 1, "http://a.example/", long + "a"), ("t", 2, "http://b.example/", long + "b")], "task_id string, arrival bigint, url string, text string")
    whole, cut = web.register_sources(rows).collect(), web.register_sources(rows, max_chars=100).collect()
    assert len({r.sha256 for r in whole}) == 2 and {(r.code_points, r.truncated) for r in whole} == {(50001, False)}
    assert len({r.sha256 for r in cut}) == 1 and {(r.code_points, r.truncated) for r in cut} == {(100, True)}


def test_a_listing_gives_all_its_results(spark):
    block = '<li class="b_algo"><h2><a href="http://r.example/{0}">title {0}</a></h2><p>s</p></li>'
    pages = spark.createDataFrame([(1, "".join(block.format(i) for i in range(14)))], "id int, markup string")
    found = lambda n: web.result_blocks(pages, "id", web.LIST_LAYOUT, n).count()
    assert [found(None), found(12), found(0)] == [14, 12, 1]


def test_offsets_and_regions_of_a_long_document(spark, monkeypatch):
    monkeypatch.setattr(templates, "BIN", 16)
    monkeypatch.setattr(templates, "RUN", 4)
    rng = random.Random(3)
    texts = {d: ["x" * rng.choice([0, 0, 1, 5, 40, 200]) for _ in range(n)] for d, n in ((1, 300), (2, 1), (3, 17))}
    rows = [(d, i, t, f"tbl[{i % 3}]/tr[{i}]/tc[0]" if i % 4 == 1 else None) for d, ts in texts.items() for i, t in enumerate(ts)]
    paragraphs = spark.createDataFrame(rows, "doc bigint, idx bigint, text string, cell_locator string")
    asked = [(d, o) for d, ts in texts.items() for o in range(-2, sum(map(len, ts)) + 3, 7)] + [(4, 0), (1, None)]
    owners = {(r.doc, r.offset): r.idx for r in templates.offset_owners(spark.createDataFrame(asked, "doc bigint, offset bigint"), paragraphs).collect()}
    assert owners == {
        (d, o): next((i for i, _ in enumerate(texts.get(d, [])) if o is not None and o >= 0 and sum(map(len, texts[d][: i + 1])) > o), None)
        for d, o in asked
    }
    wanted = [(d, f"r{k}", a, a + rng.randrange(9), None) for d in texts for k, a in enumerate(rng.sample(range(-3, 300), 40))]
    wanted += [(1, "t", None, None, "tbl[1]"), (1, "deep", None, None, "tbl[1]/tr[1]"), (1, "no", None, None, "tbl[9]"), (2, "e", None, None, None)]
    regions = spark.createDataFrame(wanted, "doc bigint, region_id string, first bigint, last bigint, table_ref string")
    members, problems = templates.region_members(regions, paragraphs)
    want, bad = set(), set()
    for d, name, first, last, ref in wanted:
        cells = [(i, c) for dd, i, _, c in rows if dd == d]
        inside = [i for i, c in cells if (c or "").startswith(f"{ref}/")] if first is None else range(first, last + 1)
        if (first is not None and (first < 0 or last >= len(cells))) or not list(inside):
            bad.add((d, name))
        else:
            want |= {(d, name, i) for i in inside}
    got = [tuple(r) for r in members.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {(r.doc, r.region_id) for r in problems.collect()} == bad


def test_canonical_json_of_any_shape(spark):
    texts = ['{"b": [ {"z":1, "a":null} ], "a" : {"d":"x\\ny", "c":[true,2]}}', '{"a":{"c":[true,2],"d":"x\\ny"},"b":[{"a":null,"z":1}]}', '"é"', "[ ]", "no json", '{"a":1,"a":2}', "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.c for r in rows.select("i", templates.canonical_json(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == [texts[1], texts[1], '"é"', "[]", None, None, None, None]


def test_contracts_are_digested_without_their_digest(spark):
    def frame(rows, schema):
        return spark.createDataFrame(rows, schema)

    def slot(template, pos, name, placeholder=None):
        return (template, pos, name, placeholder or "{{ %s }}" % name, "text_block", True, False, "says", "body")

    names = ["ok", "twice", "same", "stray", "orphan", "bare"]
    headers = frame([(t, 2, "x/1", "d" * 64, '{"b":1,"a":2}', "{}") for t in names], "template_id string, version int, extractor_version string, docx_sha256 string, styles string, static_map string")
    rows = [slot("ok", 1, "b"), slot("ok", 0, "a"), slot("twice", 0, "a"), slot("twice", 1, "a", "{{ z }}"), slot("same", 0, "a"), slot("same", 1, "b", " {{ a }} ")]
    rows += [slot("stray", 0, "a"), slot("orphan", 0, "a"), slot("orphan", 1, "b")]
    slots = frame(rows, "template_id string, slot_pos int, slot_id string, placeholder string, kind string, required boolean, allow_user_omit boolean, semantic_requirement string, style_key string")
    listed = [("ok", ["b", "a"]), ("twice", ["a"]), ("same", ["a", "b"]), ("stray", ["a", "q"]), ("orphan", ["a"])]
    sections = frame([(t, 0, "s", None, ids) for t, ids in listed], "template_id string, section_pos int, section_id string, title string, slot_ids array<string>")
    anchors = frame([("ok", "b", 7, "17", True, "tbl[0]/tr[1]/tc[2]", "e" * 64)], "template_id string, slot_id string, idx int, bookmark_id string, in_table boolean, cell_locator string, structure_signature string")
    regions = frame([("ok", "r", "document:para[0]", "f" * 64, 3)], "template_id string, region_id string, locator string, text_sha256 string, token_count int")
    nothing = frame([], "template_id string, code string, locator string, detail string")
    made, refused = templates.contracts(headers, sections, slots, anchors, regions, nothing)
    (row,) = made.collect()
    plain = json.loads(row.contract)
    assert row.contract == json.dumps(plain, sort_keys=True, separators=(",", ":")) and hashlib.sha256(row.contract.encode()).hexdigest() == row.contract_sha256
    assert [s["slot_id"] for s in plain["slots"]] == ["a", "b"] and plain["slots"][0]["anchor"] is None and plain["slots"][1]["anchor"]["bookmark_id"] == "17"
    assert plain["hashes"]["styles_sha256"] == hashlib.sha256(b'{"a":2,"b":1}').hexdigest() and "contract_sha256" not in plain["hashes"]
    assert (row.n_slots, row.n_anchored, row.n_regions, row.n_findings, row.activatable, plain["unsupported_findings"]) == (2, 1, 1, 0, True, [])
    assert {(r.template_id, r.problem) for r in refused.collect()} == {
        ("twice", "slot declared twice: a"), ("same", "placeholder of two slots: {{ a }}"), ("stray", "section names an unknown slot: q"),
        ("orphan", "slot in no section: b"), ("bare", "no slots"), ("bare", "no sections"),
    }
    found = frame([("ok", "C", "l", 'say "x"'), ("ok", "A", "l", None)], nothing.schema)
    other = templates.contracts(headers, sections, slots, anchors, regions.limit(0), found)[0].first()
    assert not other.activatable and [f["code"] for f in json.loads(other.contract)["unsupported_findings"]] == ["A", "C"] and json.loads(other.contract)["static_regions"] == []
