"""Connected components of a table of links, by rounds of joins on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena import session


def connected(links: DataFrame) -> DataFrame:
    """node and comp (the smallest node of its component) for every node of ``links(a, b)``.

    Alternates the large-star and small-star steps until the links no longer change. Each
    round is written to the shared folder. A star's centre is a key of many rows, but rows
    are two numbers and minima are aggregated before the exchange.
    """
    own = session.settle(links.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), "links")
    while True:
        both = own.unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = session.settle(small.select("e.v", "e.u").where("u <> v").distinct(), "links")
        # Equal sizes and an equal sum of mixed rows: the same links, seen without a join.
        mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if mark(new) == mark(own):
            break
        own = new
    return own.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(own.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
