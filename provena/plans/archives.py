"""Queries on the listings of archives."""

from __future__ import annotations

from pyspark.sql import functions as F

from provena.operators import packages
from provena.plans.registry import query
from provena.sources import tables as tb


@query(
    "archive_limits",
    """
SELECT l_orderkey::VARCHAR AS file, u.code AS code, 'package' AS locator, u.detail AS detail FROM (
  SELECT l_orderkey, unnest(list_filter([
    CASE WHEN max(b) > 900000 THEN {'code': 'ZIP_OVERSIZED', 'detail': 'has ' || max(b)::VARCHAR || ' bytes, 900000 allowed'} END,
    CASE WHEN count(*) > 6 THEN {'code': 'ZIP_TOO_MANY_ENTRIES', 'detail': 'has ' || count(*)::VARCHAR || ' entries, 6 allowed'} END,
    CASE WHEN sum(s) > 200 THEN {'code': 'ZIP_EXPANSION_OVER_LIMIT', 'detail': 'has ' || sum(s)::BIGINT::VARCHAR || ' declared bytes, 200 allowed'} END], lambda x: x IS NOT NULL)) AS u
  FROM (SELECT l_orderkey, (l_extendedprice * 10)::BIGINT AS b, l_quantity::BIGINT AS s FROM lineitem) GROUP BY l_orderkey)""",
)
def archive_limits(spark, sf_dir):
    entries = tb.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("file"), F.col("l_partkey").cast("string").alias("entry"),
        F.bround(F.col("l_extendedprice") * 10).cast("bigint").alias("file_bytes"),
        F.bround("l_quantity").cast("bigint").alias("declared_size"),
    )
    return packages.limits(entries, max_entries=6, max_bytes=900000, max_expanded=200)
