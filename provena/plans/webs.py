"""Queries on web pages, listings and sources."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.functions import digest
from provena.functions import text as tx
from provena.functions import web as wf
from provena.operators import web
from provena.plans.registry import query
from provena.plans.shared_sql import define, stating
from provena.sources import tables as tb


def _quoted(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def _point(character: str) -> str:
    return f"chr({ord(character)})"


define(
    "damaged_urls",
    """
SELECT page_id, CASE page_id % 9 WHEN 1 THEN 'ftp' || substring(url, 5) WHEN 2 THEN 'http:///only/path' WHEN 3 THEN replace(url, '://', '://user:pw@')
   WHEN 4 THEN 'http://127.0.0.1:8080/search' WHEN 5 THEN 'HTTPS://LOCALHOST/x' WHEN 6 THEN 'http://[::1]:9/' ELSE url END AS url, page_id % 2 = 0 AS local_only,
   CASE page_id % 7 WHEN 3 THEN 'model' WHEN 4 THEN 'web_search' ELSE 'web_fetch' END AS category FROM pages""",
)
_SCHEME = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
_AUTHORITY = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_PARSED = f"""
SELECT *, CASE WHEN scheme NOT IN ('http', 'https') THEN 'scheme not http/https: ' || scheme WHEN host = '' THEN 'no host component' WHEN contains(authority, '@') THEN 'embedded credentials' END AS problem
FROM (SELECT *, lower(CASE WHEN place LIKE '[%' THEN regexp_extract(place, '^\\[([^\\]]*)\\]', 1) ELSE regexp_extract(place, '^([^:]*)', 1) END) AS host
      FROM (SELECT *, {_SCHEME} AS scheme, {_AUTHORITY} AS authority, regexp_replace({_AUTHORITY}, '^.*@', '') AS place FROM {{table}}))"""
define("parsed_urls", _PARSED.replace("{table}", "damaged_urls"), "damaged_urls")


def damaged_urls(spark, sf_dir) -> DataFrame:
    url, turn = F.col("url"), F.col("page_id") % 9
    changed = (
        F.when(turn == 1, F.concat(F.lit("ftp"), F.substr(url, F.lit(5))))
        .when(turn == 2, F.lit("http:///only/path"))
        .when(turn == 3, F.replace(url, F.lit("://"), F.lit("://user:pw@")))
        .when(turn == 4, F.lit("http://127.0.0.1:8080/search"))
        .when(turn == 5, F.lit("HTTPS://LOCALHOST/x"))
        .when(turn == 6, F.lit("http://[::1]:9/"))
        .otherwise(url)
    )
    kind = F.when(F.col("page_id") % 7 == 3, "model").when(F.col("page_id") % 7 == 4, "web_search").otherwise("web_fetch")
    return tb.read(spark, sf_dir, "pages").select("page_id", changed.alias("url"), kind.alias("category"))


@query("url_shape", stating("parsed_urls", "SELECT page_id, scheme, host, problem FROM parsed_urls"))
def url_shape(spark, sf_dir):
    url = F.col("url")
    return damaged_urls(spark, sf_dir).select(
        "page_id", wf.scheme(url).alias("scheme"), wf.host(url).alias("host"), wf.url_problem(url).alias("problem")
    )


@query(
    "web_policy",
    stating(
        "parsed_urls",
        """
SELECT page_id, category <> 'model' AND problem IS NULL AND (NOT local_only OR host IN ('127.0.0.1', 'localhost', '::1')) AS allowed,
   CASE WHEN category = 'model' THEN 'unknown category model' WHEN problem IS NOT NULL THEN problem || ' (' || category || ')' WHEN NOT local_only THEN category || ' to ' || host || ' permitted by llm_allowed'
        WHEN host IN ('127.0.0.1', 'localhost', '::1') THEN category || ' loopback ' || host || ' allowed under local_only' ELSE category || ' to ' || host || ' denied under local_only' END AS reason FROM parsed_urls""",
    ),
)
def web_policy(spark, sf_dir):
    rule = F.when(F.col("page_id") % 2 == 0, "local_only").otherwise("llm_allowed")
    return web.policy(damaged_urls(spark, sf_dir), F.col("category"), rule).select("page_id", "allowed", "reason")


define(
    "responses",
    """
SELECT page_id, url, html, CASE page_id % 11 WHEN 3 THEN 404 WHEN 4 THEN 301 ELSE 200 END AS status,
   CASE page_id % 8 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'Text/HTML; Charset=''UTF-8''' WHEN 2 THEN 'text/html; charset=bogus' WHEN 3 THEN 'image/png' WHEN 4 THEN '' WHEN 5 THEN 'application/json'
        WHEN 6 THEN 'application/xhtml+xml; q=1; charset="utf-8"' ELSE 'application/pdf' END AS content_type FROM pages""",
)
define("response_urls", f"SELECT page_id, problem FROM ({_PARSED.replace('{table}', 'pages')})")


def responses(spark, sf_dir) -> DataFrame:
    page, turn = F.col("page_id"), F.col("page_id") % 8
    kind = (
        F.when(turn == 0, "text/html; charset=utf-8").when(turn == 1, "Text/HTML; Charset='UTF-8'")
        .when(turn == 2, "text/html; charset=bogus").when(turn == 3, "image/png").when(turn == 4, "")
        .when(turn == 5, "application/json").when(turn == 6, 'application/xhtml+xml; q=1; charset="utf-8"').otherwise("application/pdf")
    )
    return tb.read(spark, sf_dir, "pages").select(
        "page_id", "url", F.encode("html", "UTF-8").alias("body"),
        F.when(page % 11 == 3, 404).when(page % 11 == 4, 301).otherwise(200).alias("status"), kind.alias("content_type"),
    )


@query(
    "media_filter",
    stating(
        "responses",
        """
SELECT page_id, media, media = '' OR media LIKE 'text/%' OR media IN ('application/json', 'application/xhtml+xml') AS accepted, status BETWEEN 200 AND 299 AS success
FROM (SELECT *, lower(trim(string_split(content_type, ';')[1])) AS media FROM responses)""",
    ),
)
def media_filter(spark, sf_dir):
    kind = F.col("content_type")
    return responses(spark, sf_dir).select(
        "page_id", wf.media_type(kind).alias("media"), wf.media_accepted(kind).alias("accepted"), wf.success(F.col("status")).alias("success")
    )


@query(
    "charset_of",
    stating(
        "responses",
        "SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-8' WHEN 2 THEN 'bogus' WHEN 6 THEN 'utf-8' END AS charset FROM responses",
    ),
)
def charset_of(spark, sf_dir):
    return responses(spark, sf_dir).select("page_id", wf.charset(F.col("content_type")).alias("charset"))


# Markup off: script and style elements, comments, declarations, tags whose quoted attributes may hold
# ">", tags with an unpaired quote. Letters, white space and word ends are spelled as the query takes them.
_NOT_WORD, _BLANK = r"[^\p{L}\p{Nd}\p{Mn}_>]", r"[ \t\n\x0B\f\r]"
_ELEMENTS = "|".join(
    f"<{tag}(?:{_NOT_WORD}[^>]*)?>.*?</{tag}{_BLANK}*>" for tag in ("[sS][cC][rR][iI][pP][tT]", "[sS][tT][yY][lL][eE]")
)
_STRIPPED = "html"
for _pattern in (
    _ELEMENTS, "<!--.*?-->", "<[!?][^>]*>", """</?[A-Za-z](?:[^"'>]|"[^"]*"|'[^']*')*>""", "</?[A-Za-z][^>]*>",
):
    _STRIPPED = f"regexp_replace({_STRIPPED}, {_quoted(_pattern)}, '', 'gs')"

# Character references as HTML 5 reads them: every name, names that need no semicolon as the longest
# beginning of what stands there, numbers with the replacements of the standard.
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_REPLACED = {0: "\ufffd", 13: "\r"} | {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
define("named", "SELECT * FROM (VALUES " + ", ".join(f"({_quoted(n)}, {_quoted(c)})" for n, c in html5.items()) + ") v(name, value)")
define("replaced", "SELECT * FROM (VALUES " + ", ".join(f"({n}, {_point(c)})" for n, c in _REPLACED.items()) + ") v(code, value)")
define("stripped", f"SELECT page_id, url, {_STRIPPED} AS bare FROM pages")
define(
    "decoded",
    f"""
SELECT ref, CASE WHEN ref NOT LIKE '&#%' THEN coalesce(value || substring(ref, size + 2), ref) WHEN code IS NULL OR code > 1114111 OR code BETWEEN 55296 AND 57343 THEN chr(65533)
   WHEN point IS NOT NULL THEN point
   WHEN code BETWEEN 1 AND 8 OR code = 11 OR code BETWEEN 14 AND 31 OR code = 127 OR code BETWEEN 64976 AND 65007 OR code % 65536 >= 65534 THEN '' ELSE chr(code::INT) END AS value
FROM (SELECT r.ref, r.code, n.value, n.size, p.value AS point
      FROM (SELECT ref, CASE WHEN ref LIKE '&#x%' OR ref LIKE '&#X%' THEN TRY_CAST('0x' || coalesce(nullif(ltrim(rtrim(substring(ref, 4), ';'), '0'), ''), '0') AS BIGINT)
                    WHEN ref LIKE '&#%' THEN TRY_CAST(rtrim(substring(ref, 3), ';') AS HUGEINT) END AS code
            FROM (SELECT DISTINCT unnest(regexp_extract_all(bare, {_quoted(_REFERENCE)})) AS ref FROM stripped)) r
      LEFT JOIN (SELECT name, value, length(name) AS size FROM named) n ON starts_with(substring(r.ref, 2), n.name)
      LEFT JOIN replaced p ON p.code = r.code
      QUALIFY row_number() OVER (PARTITION BY r.ref ORDER BY n.size DESC NULLS LAST) = 1)""",
    "stripped", "named", "replaced",
)
define(
    "page_texts",
    f"""
SELECT page_id, url, pieces[1] || array_to_string(list_transform(refs, lambda r, i: values[r] || pieces[i + 1]), '') AS text
FROM (SELECT page_id, url, string_split_regex(bare, {_quoted(_REFERENCE)}) AS pieces, regexp_extract_all(bare, {_quoted(_REFERENCE)}) AS refs FROM stripped),
     (SELECT coalesce(map(list(ref), list(value)), map([]::VARCHAR[], []::VARCHAR[])) AS values FROM decoded)""",
    "stripped", "decoded",
)


@query("html_to_text", stating("page_texts", "SELECT page_id, sha256(text) AS sha256, length(text) AS code_points FROM page_texts"))
def html_to_text(spark, sf_dir):
    stripped = wf.html_to_text(tb.read(spark, sf_dir, "pages"), "html", "text")
    return stripped.select("page_id", digest.sha(F.col("text")).alias("sha256"), tx.code_points(F.col("text")).alias("code_points"))


@query(
    "page_text",
    stating(
        "responses response_urls page_texts",
        """
SELECT page_id, problem, CASE WHEN problem IS NULL THEN sha256(text) END AS sha256, CASE WHEN problem IS NULL THEN length(text) END AS code_points
FROM (SELECT page_id, text, CASE WHEN u.problem IS NOT NULL THEN u.problem WHEN status NOT BETWEEN 200 AND 299 THEN 'HTTP ' || status::VARCHAR WHEN page_id % 8 = 3 THEN 'unsupported content type image/png' WHEN page_id % 8 = 7 THEN 'unsupported content type application/pdf' END AS problem
      FROM responses JOIN page_texts USING (page_id) JOIN response_urls u USING (page_id))""",
    ),
)
def page_text(spark, sf_dir):
    texts = web.page_text(responses(spark, sf_dir))
    return texts.select(
        "page_id", "problem", digest.sha(F.col("text")).alias("sha256"), tx.code_points(F.col("text")).alias("code_points")
    )


@query(
    "squash_tags",
    "SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g') AS squashed FROM pages",
)
def squash_tags(spark, sf_dir):
    return tb.read(spark, sf_dir, "pages").select("page_id", wf.squash(F.col("html")).alias("squashed"))


_SLUG = "regexp_replace(substring(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), 1, 40), '^-+|-+$', '', 'g')"


@query(
    "filename_slug",
    f"""
SELECT page_id, 'research_' || lpad((page_id % 1000)::VARCHAR, 3, '0') || '_' || CASE WHEN {_SLUG} = '' THEN 'page' ELSE {_SLUG} END || '.txt' AS filename
FROM (SELECT page_id, CASE WHEN page_id % 10 = 9 THEN '://?' ELSE url END AS url FROM pages)""",
)
def filename_slug(spark, sf_dir):
    url = F.when(F.col("page_id") % 10 == 9, "://?").otherwise(F.col("url"))
    return tb.read(spark, sf_dir, "pages").select("page_id", wf.source_filename(url, F.col("page_id") % 1000).alias("filename"))


define(
    "results",
    """
SELECT task_no, doc_id, doc_id % 20 AS block_no, regexp_replace(replace(string_split(text, chr(10))[1], '<', ''), '\\s+', ' ', 'g') AS line,
   regexp_replace(replace(coalesce(string_split(text, chr(10))[2], ''), '<', ''), '\\s+', ' ', 'g') AS more FROM materials""",
    "materials",
)


def listings(spark, sf_dir, heading: bool) -> DataFrame:
    """A result listing per task with a block per document; some blocks are unusable."""
    doc = F.col("doc_id")
    no = (doc % tb.TASK_SIZE).cast("bigint")

    def clean(line):
        return F.regexp_replace(F.replace(line, F.lit("<"), F.lit("")), r"\s+", " ")

    def shown(value):
        return F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))

    lines = F.split("text", "\n")
    title, more = clean(F.get(lines, F.lit(0))), clean(F.coalesce(F.get(lines, F.lit(1)), F.lit("")))
    marked = F.when(doc % 7 == 3, F.lit("<b> </b>")).otherwise(F.concat(F.lit("<b>"), shown(title), F.lit("</b>")))
    link = F.concat(F.lit("http://r.example/"), doc.cast("string"), F.lit("?a=1&amp;b=2"))
    if heading:
        link = F.when(doc % 5 == 1, F.concat(F.lit("/link?u="), doc.cast("string"))).when(doc % 5 == 2, F.lit("javascript:void")).otherwise(link)
        block = F.concat(
            F.lit('<h3 class="vr-title x"> <a target="_blank" href="'), link, F.lit('">'), marked, F.lit("</a></h3>"),
            F.when(doc % 3 > 0, F.concat(F.lit('<p class="t">'), shown(more), F.lit("</p>"))).otherwise(F.lit("<div>none</div>")),
        )
    else:
        opened = F.when(doc % 6 == 2, F.lit("<h2>no link</h2>")).otherwise(
            F.concat(F.when(doc % 4 == 1, F.lit("<div><a ")).otherwise(F.lit("<h2 ><a id=1 ")), F.lit('href="'), link, F.lit('">'), marked, F.lit("</a></h2>"))
        )
        block = F.concat(
            F.lit('<li class="b_algo" >'), opened,
            F.when(doc % 3 > 0, F.concat(F.lit("<p>"), shown(more), F.lit("</p>"))).otherwise(F.lit("")), F.lit("</li>"),
        )
    blocks = tb.materials(spark, sf_dir).select("task_no", no.alias("_no"), block.alias("_block"))
    # A task owns at most TASK_SIZE documents, so its listing is bounded.
    return blocks.groupBy("task_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_no", "_block"))), lambda b: b["_block"]), "\n").alias("markup")
    )


_SHOWN = "trim(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'))"


@query(
    "result_blocks",
    stating(
        "results",
        f"""
SELECT 'list' AS layout, task_no, block_no, 'http://r.example/' || doc_id::VARCHAR || '?a=1&b=2' AS url, {_SHOWN.format(x='line')} AS title, CASE WHEN doc_id % 3 > 0 THEN {_SHOWN.format(x='more')} ELSE '' END AS snippet
FROM results WHERE block_no < 8 AND doc_id % 6 <> 2 AND doc_id % 7 <> 3 AND {_SHOWN.format(x='line')} <> ''
UNION ALL
SELECT 'heading', task_no, block_no, CASE WHEN doc_id % 5 = 1 THEN 'https://www.sogou.com/link?u=' || doc_id::VARCHAR ELSE 'http://r.example/' || doc_id::VARCHAR || '?a=1&b=2' END,
   {_SHOWN.format(x='line')}, CASE WHEN doc_id % 3 > 0 THEN {_SHOWN.format(x='more')} ELSE '' END
FROM results WHERE block_no < 8 AND doc_id % 5 <> 2 AND doc_id % 7 <> 3 AND {_SHOWN.format(x='line')} <> ''""",
    ),
)
def result_blocks(spark, sf_dir):
    found = []
    for name, layout in (("list", web.LIST_LAYOUT), ("heading", web.HEADING_LAYOUT)):
        rows = web.result_blocks(listings(spark, sf_dir, name == "heading"), "task_no", layout, 8)
        found.append(rows.select(F.lit(name).alias("layout"), "task_no", F.col("block_no").cast("bigint").alias("block_no"), "url", "title", "snippet"))
    return found[0].unionByName(found[1])


@query(
    "serp_limit",
    stating(
        "results",
        f"""
SELECT task_no, count(*) AS n_results FROM results WHERE block_no < least(greatest(3, 1), 10) AND doc_id % 6 <> 2 AND doc_id % 7 <> 3 AND {_SHOWN.format(x='line')} <> '' GROUP BY task_no""",
    ),
)
def serp_limit(spark, sf_dir):
    rows = web.result_blocks(listings(spark, sf_dir, False), "task_no", web.LIST_LAYOUT, 3)
    return rows.groupBy("task_no").agg(F.count("*").alias("n_results"))


@query(
    "json_results",
    stating(
        "results",
        """
SELECT task_no, NULL AS problem, block_no AS result_no, line AS title, CASE WHEN doc_id % 4 = 1 THEN '' ELSE 'http://j.example/' || doc_id::VARCHAR END AS url,
   CASE WHEN doc_id % 3 = 0 THEN more WHEN doc_id % 3 = 1 THEN line ELSE '' END AS snippet FROM results WHERE block_no < 6 AND task_no % 7 < 5
UNION ALL SELECT DISTINCT task_no, CASE WHEN task_no % 7 = 5 THEN 'not a JSON object' ELSE 'no ''results'' array' END, NULL, NULL, NULL, NULL FROM results WHERE task_no % 7 >= 5""",
    ),
)
def json_results(spark, sf_dir):
    doc = F.col("doc_id")

    def clean(line):
        return F.regexp_replace(F.replace(line, F.lit("<"), F.lit("")), r"\s+", " ")

    lines = F.split("text", "\n")
    title, more = clean(F.get(lines, F.lit(0))), clean(F.coalesce(F.get(lines, F.lit(1)), F.lit("")))
    item = F.struct(
        (doc % tb.TASK_SIZE).alias("no"), title.alias("title"),
        F.when(doc % 4 != 1, F.concat(F.lit("http://j.example/"), doc.cast("string"))).alias("url"),
        F.when(doc % 3 == 0, more).when(doc % 3 == 1, F.lit("")).alias("content"),
        F.when(doc % 3 == 1, title).alias("snippet"),
    )
    grouped = tb.materials(spark, sf_dir).groupBy("task_no").agg(F.array_sort(F.collect_list(item)).alias("results"))
    number = F.col("task_no")
    payload = (
        F.when(number % 7 == 5, F.lit(" []"))
        .when(number % 7 == 6, F.lit('{"other": 1}'))
        .otherwise(F.to_json(F.struct("results")))
    )
    found = web.json_results(grouped.select("task_no", payload.alias("payload")), "task_no", 6)
    return found.withColumn("result_no", F.col("result_no").cast("bigint"))


# Blank is white space of any script.
_SOLID = r"regexp_matches(text, '[^\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]')"
_CANONICAL = r"regexp_replace(nfc_normalize({text}), '\r\n?', chr(10), 'g')"
define(
    "fetched",
    f"""
SELECT 'task_' || lpad((page_id // 20)::VARCHAR, 32, '0') AS task_id, page_id * 2 + r AS arrival, CASE WHEN page_id % 20 = 15 THEN 'program://digest-' || page_id::VARCHAR ELSE url END AS url,
   CASE WHEN page_id % 13 = 7 AND r = 0 THEN '   ' ELSE {_CANONICAL.format(text='text')} END AS text FROM page_texts, (VALUES (0), (1)) v(r) WHERE r = 0 OR page_id % 4 = 0 OR page_id % 26 = 7""",
    "page_texts",
)
define(
    "firsts",
    f"""
SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY first, url) AS rank FROM (SELECT task_id, url, min(arrival) AS first FROM fetched WHERE {_SOLID} GROUP BY ALL)""",
    "fetched",
)


def fetched(spark, sf_dir) -> DataFrame:
    """Pages as fetched for tasks: some blank, some fetched twice, one synthesised text per task."""
    page = F.col("page_id")
    again = (page % 4 == 0) | (page % 26 == 7)
    tries = F.when(again, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    texts = wf.html_to_text(tb.read(spark, sf_dir, "pages"), "html", "_text")
    rows = texts.select("page_id", "url", "_text", F.explode(tries).alias("_r"))
    return rows.select(
        tb.padded_id("task", F.floor(page / 20)).alias("task_id"), (page * 2 + F.col("_r")).alias("arrival"),
        F.when(page % 20 == 15, F.concat(F.lit("program://digest-"), page.cast("string"))).otherwise(F.col("url")).alias("url"),
        F.when((page % 13 == 7) & (F.col("_r") == 0), F.lit("   ")).otherwise(F.col("_text")).alias("text"),
    )


@query(
    "register_sources",
    stating(
        "firsts",
        f"""
SELECT task_id, arrival, url, outcome, CASE WHEN outcome = 'registered' THEN 'research_' || lpad(idx::VARCHAR, 3, '0') || '_' || CASE WHEN {_SLUG} = '' THEN 'page' ELSE {_SLUG} END || '.txt' END AS filename,
   CASE WHEN outcome = 'registered' THEN sha256(body) END AS sha256, CASE WHEN outcome = 'registered' THEN length(body) END AS code_points
FROM (SELECT r.task_id, r.arrival, r.url, r.text AS body,
        CASE WHEN f.rank <= 12 THEN f.rank - 1 ELSE 12 + (SELECT count(*) FROM firsts p WHERE p.task_id = f.task_id AND p.url LIKE 'program://%' AND p.rank > 12 AND p.rank < f.rank) END AS idx,
        CASE WHEN (f.rank <= 12 OR r.url LIKE 'program://%') AND r.arrival = f.first THEN 'registered'
             WHEN (f.rank <= 12 OR r.url LIKE 'program://%') AND r.arrival > f.first AND (r.url NOT LIKE 'program://%' OR {_SOLID}) THEN 'reused'
             WHEN l.first IS NOT NULL AND r.arrival > l.first AND r.url NOT LIKE 'program://%' THEN 'refused_budget' ELSE 'refused_empty' END AS outcome
      FROM fetched r LEFT JOIN firsts f ON f.task_id = r.task_id AND f.url = r.url LEFT JOIN (SELECT task_id, first FROM firsts WHERE rank = 12) l ON l.task_id = r.task_id)""",
    ),
)
def register_sources(spark, sf_dir):
    return web.register_sources(fetched(spark, sf_dir)).drop("truncated")


@query(
    "source_cap",
    stating(
        "fetched",
        """
SELECT task_id, url, arrival, source_no FROM (SELECT task_id, url, min(arrival) AS arrival, row_number() OVER (PARTITION BY task_id ORDER BY min(arrival), url) AS source_no
FROM fetched WHERE url NOT LIKE 'program://%' GROUP BY task_id, url) WHERE source_no <= 12""",
    ),
)
def source_cap(spark, sf_dir):
    kept = web.source_cap(fetched(spark, sf_dir).select("task_id", "arrival", "url"))
    return kept.withColumn("source_no", F.col("source_no").cast("bigint"))


@query(
    "existing_sources",
    """
SELECT page_id, CASE WHEN EXISTS (SELECT 1 FROM pages held WHERE held.page_id % 4 = 1 AND held.url = p.url) THEN 'reuse' ELSE 'new' END AS outcome FROM pages p""",
)
def existing_sources(spark, sf_dir):
    pages = tb.read(spark, sf_dir, "pages").select("page_id", F.lit("task").alias("task_id"), "url")
    old, new = web.known_sources(pages, pages.filter(F.col("page_id") % 4 == 1))
    return old.select("page_id", F.lit("reuse").alias("outcome")).unionByName(new.select("page_id", F.lit("new").alias("outcome")))
