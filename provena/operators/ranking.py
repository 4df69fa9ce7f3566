"""Per-key ordering that survives a key holding a third of all rows.

A window partitioned by such a key would sort it in one task. The helpers here split
every key into ranges of a monotone ``bucket``: rows are numbered or shifted inside a
bucket, and only one summary row per (key, bucket) is ordered across buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.session import settle

#: Width of a bucket of sequence numbers; rows that a measured bucket aims at.
BUCKET = 1 << 20

#: A hot key is cut into up to the square of this many measured buckets.
FAN = 32


def bucket_of(seq: Column, width: int = BUCKET) -> Column:
    return F.floor(seq / width).cast("bigint")


def measured_buckets(df: DataFrame, keys: Sequence[str], seq: str, name: str = "_piece", rows: int = BUCKET) -> DataFrame:
    """Add the bucket ``name`` of each row for an order that starts with ``seq``, by measured quantiles.

    Numbers that count up inside each key all lie in one bucket of fixed width. Here the rows
    of each key are counted, and keys of more than ``rows`` rows are cut at quantiles of their
    ``seq`` into buckets of about ``rows`` rows, at most 1024. All other rows are in bucket 0,
    as are rows without ``seq``, which sort first. Equal ``seq`` share a bucket. Only hot keys
    have cuts, at least ``rows`` rows each, and the cuts are written down before they are joined.
    """
    keys = list(keys)
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows)
    parts = FAN * FAN
    quantiles = F.percentile_approx(seq, [i / parts for i in range(1, parts)], 10_000)
    found = df.select(*keys, seq).join(hot, keys).groupBy(*keys).agg(quantiles.alias("_all"), F.first("_n").alias("_n"))
    each = F.greatest(F.lit(1), F.floor(F.lit(parts) * rows / F.col("_n")))
    cuts = settle(found.select(*keys, F.filter("_all", lambda q, i: (i + 1) % each == 0).alias("_cuts")), "cuts")

    def below(values: Column) -> Column:
        return F.coalesce(F.size(F.filter(values, lambda q: q <= F.col(seq))), F.lit(0))

    # Two short looks in place of one through all cuts: which run of cuts, then where in it.
    coarse = below(F.filter("_cuts", lambda q, i: i % FAN == FAN - 1)) * FAN
    fine = below(F.slice("_cuts", coarse + 1, F.lit(FAN)))
    piece = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(coarse + fine)
    return df.join(cuts, keys, "left").withColumn(name, piece.cast("bigint")).drop("_cuts")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """The first row per key, as a partial aggregation rather than a window."""
    picked = F.min_by(F.struct(*cols), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(picked).select(*keys, "_first.*")


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """The last row per key."""
    picked = F.max_by(F.struct(*cols), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(picked).select(*keys, "_last.*")


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, name: str = "rank") -> DataFrame:
    """The first ``limit`` rows per key with their rank.

    The rank filter becomes a group limit that runs before the exchange too, so a hot
    key sends at most ``limit`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= limit)


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, name: str
) -> DataFrame:
    """1-based position of each row in its key. ``bucket`` must not fall as ``order`` grows."""
    keys = list(keys)
    tagged = df.withColumn("_bucket", bucket)
    sizes = tagged.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        tagged.withColumn("_inside", F.row_number().over(inside))
        .join(bases, [*keys, "_bucket"])
        .withColumn(name, (F.col("_base") + F.col("_inside")).cast("bigint"))
        .drop("_bucket", "_inside", "_base")
    )


def previous_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, cols: dict[str, str]
) -> DataFrame:
    """Add the previous row's values per key: ``cols`` maps source column to new column."""
    keys = list(keys)
    packed = F.struct(*cols)
    tagged = df.withColumn("_bucket", bucket)
    tails = tagged.groupBy(*keys, "_bucket").agg(F.max_by(packed, F.struct(*order)).alias("_tail"))
    across = Window.partitionBy(*keys).orderBy("_bucket")
    heads = tails.select(*keys, "_bucket", F.lag("_tail").over(across).alias("_head"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    joined = tagged.withColumn("_lag", F.lag(packed).over(inside)).join(heads, [*keys, "_bucket"])
    before = F.coalesce(F.col("_lag"), F.col("_head"))
    for source, target in cols.items():
        joined = joined.withColumn(target, before[source])
    return joined.drop("_bucket", "_lag", "_head")
