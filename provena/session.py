"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Also split a hot key when that costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Broadcast on measured sizes. Before anything ran there are only guesses from file
    # sizes, so a planned broadcast must be tiny even after unpacking; AQE turns a join
    # into a broadcast later, once it has counted the bytes of a side.
    "spark.sql.autoBroadcastJoinThreshold": "2m",
    "spark.sql.sources.fileCompressionFactor": "5.0",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    # A union that keeps its inputs' partitioning fails in Spark 4.1 when AQE has given the
    # inputs different numbers of partitions ("Can't zip RDDs").
    "spark.sql.unionOutputPartitioning": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_stand_in: str | None = None


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to an existing session."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Another value of a setting for what runs inside, and the former one after it."""
    former = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if former is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, former)


def build(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "provena") -> SparkSession:
    """A local session, for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    Only where the session names none, as in local tests, a temporary folder stands in.
    """
    global _stand_in
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        _stand_in = _stand_in or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        root = _stand_in
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several checks read to the shared folder and read it back.

    It is computed once, and a lost executor costs nothing: the files are not local.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
