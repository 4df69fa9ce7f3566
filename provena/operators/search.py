"""Material tools: inventory, literal search, bounded reads, turn budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.functions import text as tx
from provena.operators.ranking import top_rows

SNIPPET_CHARS = 200
READ_CHARS = 8000


def inventory(materials: DataFrame) -> DataFrame:
    """Size, lines and non-blank lines of each material; column maths, no shuffle."""
    lines = tx.lines(F.col("text"))
    return materials.select(
        "task_id", "artifact_id", "kind",
        tx.basename(F.col("relative_path")).alias("display_name"),
        tx.size_bytes(F.col("text")).alias("size_bytes"),
        F.size(lines).cast("bigint").alias("line_count"),
        F.size(F.filter(lines, tx.non_blank)).cast("bigint").alias("paragraph_count"),
    )


def listing(materials: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` materials of each task in arrival order, with the full count."""
    totals = materials.groupBy("task_id").agg(F.count("*").alias("total_matched"))
    first = top_rows(
        materials.select("task_id", "artifact_id", "created_at"),
        ["task_id"], [F.col("created_at"), F.col("artifact_id")], limit, "list_pos",
    )
    return first.join(totals, "task_id").withColumn("truncated", F.col("total_matched") > limit)


def query_problem(query: Column, top_k: Column) -> Column:
    return F.when(~tx.non_blank(query), "blank query").when(top_k < 1, "top_k below 1")


def score(materials: DataFrame, queries: DataFrame, snippet: int = SNIPPET_CHARS) -> DataFrame:
    """Score each query (query_id, task_id, query) against its own task's materials.

    Score is the number of occurrences of all terms plus the number of distinct terms
    hit. Counting happens on the row of the text; only the hit leaves it.
    """
    text = F.col("text")
    wanted = queries.select("query_id", "task_id", tx.query_terms(F.col("query")).alias("_terms"))
    joined = materials.select("task_id", "artifact_id", "text").join(wanted, "task_id")
    counts = F.transform("_terms", lambda t: tx.literal_count(text, t))
    counted = joined.withColumn("_counts", counts).withColumn(
        "match_count", F.aggregate("_counts", F.lit(0).cast("bigint"), lambda a, c: a + c)
    )
    hits = counted.filter(F.col("match_count") > 0)
    places = F.filter(F.transform("_terms", lambda t: tx.literal_position(text, t)), lambda p: p >= 0)
    distinct = F.size(F.filter("_counts", lambda c: c > 0))
    return hits.select(
        "query_id", "task_id", "artifact_id",
        (F.col("match_count") + distinct).cast("bigint").alias("score"),
        "match_count",
        tx.snippet(text, F.array_min(places), snippet).alias("snippet"),
    )


def search(materials: DataFrame, queries: DataFrame, top_k: int = 5, cap: int | None = None) -> DataFrame:
    """The ``top_k`` best hits per query, by score and then artifact id; at most ``cap`` if a service sets one."""
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    usable = queries.filter(tx.non_blank(F.col("query")))
    order = [F.col("score").desc(), F.col("artifact_id")]
    return top_rows(score(materials, usable), ["query_id"], order, top_k if cap is None else min(top_k, cap))


def read_slices(materials: DataFrame, requests: DataFrame, cap: int = READ_CHARS) -> DataFrame:
    """Exact slices for requests (request_id, task_id, artifact_id, start, length or NULL)."""
    held = materials.select("task_id", "artifact_id", "text", tx.code_points(F.col("text")).alias("total"))
    start, length, total = F.col("start"), F.col("length"), F.col("total")
    problem = (
        F.when(F.col("text").isNull(), "not_found")
        .when(start < 0, "negative start")
        .when(start > total, "start beyond end")
        .when(length < 0, "negative length")
    )
    wanted = F.coalesce(length, total - start)
    end = start + F.least(wanted, F.lit(cap), total - start)
    joined = requests.join(held, ["task_id", "artifact_id"], "left").withColumn("problem", problem)
    fine = F.col("problem").isNull()
    return joined.select(
        "request_id", "task_id", "artifact_id", "start", "problem",
        F.when(fine, end).alias("end"),
        F.when(fine, total).alias("total"),
        F.when(fine, tx.slice_points(F.col("text"), start, end)).alias("slice"),
        F.when(fine, end < F.least(start + wanted, total)).alias("truncated"),
    )


def admit(calls: DataFrame, max_calls: Column, max_chars: Column) -> DataFrame:
    """Which tool calls of a turn are admitted (turn, call_no, chars).

    A call beyond the call cap is refused. A read that would pass the character cap is
    refused too: it has used a call but no characters, so a running sum would be wrong
    after the first refusal and the calls are folded in order. Only as many calls of a turn
    as the largest cap allows are folded; all later ones are refused by comparison with
    the last of these.
    """
    capped = calls.withColumn("_calls", max_calls).withColumn("_chars", max_chars)
    bound = max(1, capped.agg(F.max("_calls")).first()[0] or 1)
    head = top_rows(capped, ["turn"], [F.col("call_no")], bound, "_pos").filter(F.col("_pos") <= F.col("_calls"))
    turns = head.groupBy("turn").agg(
        F.array_sort(F.collect_list(F.struct("call_no", "chars"))).alias("_list"),
        F.max("_chars").alias("_cap"),
        F.max("call_no").alias("_last"),
    )

    def step(acc: Column, call: Column) -> Column:
        fits = acc["used"] + call["chars"] <= F.col("_cap")
        used = F.when(fits, acc["used"] + call["chars"]).otherwise(acc["used"])
        entry = F.struct(call["call_no"].alias("call_no"), fits.alias("fits"), used.alias("used"))
        return F.struct(used.alias("used"), F.concat(acc["seen"], F.array(entry)).alias("seen"))

    empty = F.array().cast("array<struct<call_no:bigint,fits:boolean,used:bigint>>")
    start = F.struct(F.lit(0).cast("bigint").alias("used"), empty.alias("seen"))
    folded = turns.select("turn", F.explode(F.aggregate("_list", start, step)["seen"]).alias("_s")).select(
        "turn", "_s.call_no",
        F.when(F.col("_s.fits"), "admitted").otherwise("refused_chars").alias("outcome"),
        F.col("_s.used").alias("chars_used"),
    )
    late = (
        calls.join(turns.select("turn", "_last"), "turn")
        .filter(F.col("call_no") > F.col("_last"))
        .select("turn", "call_no", F.lit("refused_calls").alias("outcome"), F.lit(None).cast("bigint").alias("chars_used"))
    )
    return folded.unionByName(late)


def adaptive_budget(counts: DataFrame) -> DataFrame:
    """Caps of a turn by material count (task_id, material_count)."""
    extra = F.greatest(F.lit(0), F.col("material_count") - 1)
    return counts.select(
        "task_id",
        F.least(F.lit(20) + 6 * extra, F.lit(80)).cast("bigint").alias("max_calls"),
        F.least(F.lit(40000) + 8000 * extra, F.lit(160000)).cast("bigint").alias("max_chars"),
    )


def within_calls(calls: DataFrame, cap: int) -> DataFrame:
    """The call-count half of the budget alone, with the running total of characters."""
    run = Window.partitionBy("turn").orderBy("call_no").rowsBetween(Window.unboundedPreceding, 0)
    return top_rows(calls, ["turn"], [F.col("call_no")], cap, "call_pos").withColumn(
        "running_chars", F.sum("chars").over(run)
    )
