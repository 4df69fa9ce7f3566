"""Web pages as sources: stored pages, result listings, registration under a cap."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions import text as tx
from provena.functions import web as wf
from provena.functions.digest import sha
from provena.operators.ranking import bucket_of, row_numbers, top_rows

MAX_SOURCES = 12
PROGRAM = "program://"


@dataclass(frozen=True)
class Layout:
    """How a listing page marks up its results.

    ``block`` finds one result; ``links`` are tried in turn within it and give address
    and title; ``relative`` names an address prefix that ``base`` makes absolute.
    """

    block: str
    links: tuple[str, ...]
    snippet: str
    relative: str | None = None
    base: str = ""


#: The two listing layouts (fixed values).
LIST_LAYOUT = Layout(
    block=r'(?s)<li\s+class="b_algo".*?</li>',
    links=(
        r'(?s)<h2[^>]*>\s*<a[^>]+href="([^"]+)"[^>]*>(.*?)</a>',
        r'(?s)href="(https?://[^"]+)"[^>]*>(.*?)</a>',
    ),
    snippet=r"(?s)<p[^>]*>(.*?)</p>",
)
HEADING_LAYOUT = Layout(
    block=r'(?s)<h3[^>]*class="[^"]*vr-title[^"]*"[^>]*>\s*<a[^>]+href="[^"]+"[^>]*>.*?</a>.*?(?=<h3[^>]*|$)',
    links=(r'(?s)<h3[^>]*>\s*<a[^>]+href="([^"]+)"[^>]*>(.*?)</a>',),
    snippet=r"(?s)</a>.*?<p[^>]*>(.*?)</p>",
    relative="/link?",
    base="https://www.sogou.com",
)


def page_text(pages: DataFrame, max_chars: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Stored responses (url, status, content_type, body) to text, or why they are refused.

    Bodies and texts are whole unless the caller sets a limit; ``truncated`` tells where one cut.
    """
    problem = (
        F.when(wf.url_problem(F.col("url")).isNotNull(), wf.url_problem(F.col("url")))
        .when(~wf.success(F.col("status")), F.concat(F.lit("HTTP "), F.col("status").cast("string")))
        .when(~wf.media_accepted(F.col("content_type")), F.concat(F.lit("unsupported content type "), wf.media_type(F.col("content_type"))))
    )
    body = F.col("body") if max_bytes is None else F.substring(F.col("body"), 1, max_bytes)
    usable = pages.withColumn("problem", problem).withColumn(
        "_markup", F.when(F.col("problem").isNull(), wf.decode_body(body, F.col("content_type")))
    )
    texts = wf.html_to_text(usable, "_markup", "_text")
    cut = F.lit(False)
    if max_bytes is not None:
        cut = cut | (F.octet_length("body") > max_bytes)
    if max_chars is not None:
        cut = cut | (F.char_length("_text") > max_chars)
    text = F.col("_text") if max_chars is None else F.substr("_text", F.lit(1), F.lit(max_chars))
    truncated = F.col("problem").isNull() & F.coalesce(cut, F.lit(False))
    return texts.withColumn("text", text).withColumn("truncated", truncated).drop("_markup", "_text")


def result_blocks(listings: DataFrame, key: str, layout: Layout, limit: int | None = None) -> DataFrame:
    """Results of listing pages (key, markup): the first ``limit`` blocks, at least one, then the
    usable ones; without a limit all blocks."""
    blocks = F.regexp_extract_all("markup", F.lit(layout.block), F.lit(0))
    if limit is not None:
        blocks = F.slice(blocks, 1, max(1, limit))
    rows = listings.select(key, F.posexplode(blocks).alias("block_no", "_block"))
    url, title = F.lit(""), F.lit("")
    for pattern in reversed(layout.links):
        hit = F.regexp_extract("_block", pattern, 1)
        url = F.when(hit != "", hit).otherwise(url)
        title = F.when(hit != "", F.regexp_extract("_block", pattern, 2)).otherwise(title)
    shown = rows.select(
        key, "block_no",
        F.regexp_replace(wf.unescape(url), r"(?U)^\s+|\s+$", "").alias("url"),
        wf.label(title).alias("title"),
        wf.label(F.regexp_extract("_block", layout.snippet, 1)).alias("snippet"),
    ).filter((F.col("url") != "") & (F.col("title") != ""))
    if layout.relative is None:
        return shown
    absolute = F.when(F.col("url").startswith(layout.relative), F.concat(F.lit(layout.base), F.col("url"))).otherwise(F.col("url"))
    return shown.withColumn("url", absolute).filter(F.col("url").rlike("^https?://"))


def json_results(payloads: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Results of provider answers (key, payload): one row each, or one row with the problem.

    An item that is no object gives no row and takes none from the others. ``limit`` counts
    the items of an answer; without it all of them are read.
    """
    shape = "title string, url string, content string, snippet string"
    body = F.ltrim(F.regexp_replace("payload", r"^\s+", ""))
    parsed = payloads.select(key, body.alias("_body"), F.from_json("payload", "results array<string>").alias("_p"))
    # Items are texts first, so that an odd one does not spoil the array they stand in.
    items = F.col("_p.results") if limit is None else F.slice("_p.results", 1, max(1, limit))
    problem = F.when(~F.col("_body").startswith("{"), "not a JSON object").when(F.col("_p.results").isNull(), "no 'results' array")
    listed = parsed.select(key, problem.alias("problem"), F.posexplode_outer(items).alias("result_no", "_item")).withColumn(
        "_r", F.when(F.startswith(F.ltrim("_item"), F.lit("{")), F.from_json("_item", shape))
    )
    content = F.coalesce(F.nullif(F.col("_r.content"), F.lit("")), F.col("_r.snippet"), F.lit(""))
    present = F.col("_r").isNotNull()
    return listed.filter(present | F.col("problem").isNotNull()).select(
        key, "problem", "result_no",
        F.when(present, F.coalesce("_r.title", F.lit(""))).alias("title"),
        F.when(present, F.coalesce("_r.url", F.lit(""))).alias("url"),
        F.when(present, content).alias("snippet"),
    )


def known_sources(requests: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (task_id, url) split into (already registered, new)."""
    key = ["task_id", "url"]
    held = existing.select(*key).distinct()
    return requests.join(held, key, "left_semi"), requests.join(held, key, "left_anti")


def register_sources(requests: DataFrame, cap: int = MAX_SOURCES, max_chars: int | None = None) -> DataFrame:
    """Requests (task_id, arrival, url, text) in arrival order: registered, reused or refused.

    A page is registered once per task and address, when its canonical text is not blank
    and fewer than ``cap`` sources are there. Texts the program wrote (``program://``)
    are always registered and count once present. Only the first ``cap`` sources of a
    task decide on all its requests, so a task with very many of them stays cheap.

    Texts are registered and hashed whole. With ``max_chars`` they are cut first, those of
    the program at twice that length, and ``truncated`` tells which ones were.
    """
    program = F.col("url").startswith(PROGRAM)
    cut, truncated = F.col("text"), F.lit(False)
    if max_chars is not None:
        most = F.when(program, F.lit(2 * max_chars)).otherwise(F.lit(max_chars))
        cut, truncated = F.substr("text", F.lit(1), most), F.coalesce(F.char_length("text") > most, F.lit(False))
    ready = requests.withColumn("_canonical", tx.canonical(cut)).withColumn("_program", program)
    narrow = ready.select(
        "task_id", "arrival", "url", "_program", tx.non_blank(F.col("_canonical")).alias("_solid"),
        sha(F.col("_canonical")).alias("sha256"), tx.code_points(F.col("_canonical")).alias("code_points"), truncated.alias("truncated"),
    )
    firsts = narrow.filter("_solid").groupBy("task_id", "url").agg(
        F.min("arrival").alias("_first"), F.first("_program").alias("_program")
    )
    early = top_rows(firsts, ["task_id"], [F.col("_first"), F.col("url")], cap, "_rank")
    full = early.filter(F.col("_rank") == cap).select("task_id", F.col("_first").alias("_full_at"))
    late = firsts.join(full, "task_id").filter(F.col("_program") & (F.col("_first") > F.col("_full_at")))
    numbered = row_numbers(late, ["task_id"], [F.col("_first")], bucket_of(F.col("_first")), "_after")
    held = early.select("task_id", "url", "_first", (F.col("_rank") - 1).cast("bigint").alias("_index")).unionByName(
        numbered.select("task_id", "url", "_first", (F.col("_after") + cap - 1).alias("_index"))
    )
    joined = narrow.join(held, ["task_id", "url"], "left").join(full, "task_id", "left")
    mine = F.col("_first").isNotNull()
    over = F.col("_full_at").isNotNull() & (F.col("arrival") > F.col("_full_at")) & ~F.col("_program")
    outcome = (
        F.when(mine & (F.col("arrival") == F.col("_first")), "registered")
        .when(mine & (F.col("arrival") > F.col("_first")) & (~F.col("_program") | F.col("_solid")), "reused")
        .when(over, "refused_budget")
        .otherwise("refused_empty")
    )
    registered = F.col("outcome") == "registered"
    return joined.withColumn("outcome", outcome).select(
        "task_id", "arrival", "url", "outcome",
        F.when(registered, wf.source_filename(F.col("url"), F.col("_index"))).alias("filename"),
        F.when(registered, F.col("sha256")).alias("sha256"),
        F.when(registered, F.col("code_points")).alias("code_points"),
        F.when(registered, F.col("truncated")).alias("truncated"),
    )


def source_cap(requests: DataFrame, cap: int = MAX_SOURCES) -> DataFrame:
    """The first ``cap`` addresses of each task in arrival order."""
    web = requests.filter(~F.col("url").startswith(PROGRAM))
    firsts = web.groupBy("task_id", "url").agg(F.min("arrival").alias("arrival"))
    return top_rows(firsts, ["task_id"], [F.col("arrival"), F.col("url")], cap, "source_no")


def policy(urls: DataFrame, category: Column, data_policy: Column) -> DataFrame:
    allowed, reason = wf.policy_decision(F.col("url"), category, data_policy)
    return urls.withColumn("allowed", allowed).withColumn("reason", reason)
