"""Judging archives by a listing of their entries (file, entry, file_bytes, declared_size)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ENTRIES = 2000
MAX_FILE_BYTES = 20 * 1024 * 1024
MAX_EXPANDED_BYTES = 100 * 1024 * 1024


def limits(
    entries: DataFrame, max_entries: int = MAX_ENTRIES, max_bytes: int = MAX_FILE_BYTES, max_expanded: int = MAX_EXPANDED_BYTES
) -> DataFrame:
    """Archives with too many entries, too many bytes, or too large a declared content."""
    totals = entries.groupBy("file").agg(
        F.count_if(F.col("entry").isNotNull()).alias("_n"), F.max("file_bytes").alias("_bytes"), F.sum("declared_size").alias("_total")
    )

    def over(what: str, value: str, limit: int, noun: str) -> Column:
        text = F.concat(F.lit("has "), F.col(value).cast("bigint").cast("string"), F.lit(f" {noun}, {limit} allowed"))
        return F.when(F.col(value) > limit, F.struct(F.lit(what).alias("code"), text.alias("detail")))

    found = F.array_compact(
        F.array(
            over("ZIP_OVERSIZED", "_bytes", max_bytes, "bytes"),
            over("ZIP_TOO_MANY_ENTRIES", "_n", max_entries, "entries"),
            over("ZIP_EXPANSION_OVER_LIMIT", "_total", max_expanded, "declared bytes"),
        )
    )
    return totals.select("file", F.inline(found)).select("file", "code", F.lit("package").alias("locator"), "detail")
