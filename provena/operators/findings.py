"""Findings: one row per check, with pass, fail or unknown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.operators.ranking import top_rows

#: Columns of every findings table.
COLUMNS = ("gate", "task_id", "check_id", "status", "required", "locator", "expected", "actual")


def finding(
    df: DataFrame,
    gate: str,
    check: Column,
    problem: Column,
    locator: Column | None = None,
    expected: Column | None = None,
    actual: Column | None = None,
    status: Column | None = None,
) -> DataFrame:
    """Rows of ``df`` as findings: they fail where ``problem`` is set."""
    blank = F.lit(None).cast("string")
    return df.select(
        F.lit(gate).alias("gate"),
        "task_id",
        check.alias("check_id"),
        (F.when(problem.isNotNull(), "fail").otherwise("pass") if status is None else status).alias("status"),
        F.lit(True).alias("required"),
        (blank if locator is None else locator).alias("locator"),
        (blank if expected is None else expected).alias("expected"),
        (problem if actual is None else actual).cast("string").alias("actual"),
    )


def overall(findings: DataFrame, keys: Sequence[str] = ("gate", "task_id")) -> DataFrame:
    """Fail over unknown over pass, looking at required checks only."""
    needed = F.col("required")
    return findings.groupBy(*keys).agg(
        F.when(F.bool_or(needed & (F.col("status") == "fail")), "fail")
        .when(F.bool_or(needed & (F.col("status") == "unknown")), "unknown")
        .otherwise("pass")
        .alias("overall_status"),
        F.count_if(F.col("status") == "fail").alias("n_fail"),
        F.count_if(F.col("status") == "unknown").alias("n_unknown"),
        F.count("*").alias("n_checks"),
    )


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _first_messages(df: DataFrame, keys: Sequence[str], order: str, message: str, limit: int) -> DataFrame:
    first = top_rows(df.select(*keys, order, message), keys, [F.col(order), F.col(message)], limit, "_n")
    return first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_n", message))).alias("_m"))


def listed_messages(df: DataFrame, keys: Sequence[str], order: str, message: str, limit: int) -> DataFrame:
    """The first ``limit`` messages per key joined with ``"; "``, and how many more there are."""
    listed = _first_messages(df, keys, order, message, limit)
    more = df.groupBy(*keys).agg((F.count("*") - limit).alias("_more")).filter(F.col("_more") > 0)
    text = F.array_join(F.transform("_m", lambda m: m[message]), "; ")
    rest = F.when(F.col("_more").isNotNull(), F.concat(F.lit("; and "), F.col("_more").cast("string"), F.lit(" more"))).otherwise("")
    return listed.join(more, list(keys), "left").select(*keys, F.concat(text, rest).alias("messages"))


def joined_messages(df: DataFrame, keys: Sequence[str], order: str, message: str, limit: int) -> DataFrame:
    """The first ``limit`` messages per key, and in a column of its own how many there are in all."""
    totals = df.groupBy(*keys).agg(F.count("*").alias("n_messages"))
    listed = _first_messages(df, keys, order, message, limit).select(*keys, F.array_join(F.transform("_m", lambda m: m[message]), "; ").alias("messages"))
    return totals.join(listed, list(keys))
