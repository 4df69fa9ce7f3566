"""Idempotent writers. Parquet tables have no MERGE, so what is new is decided first and then appended."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.operators.ledger import appended, idempotency
from provena.session import settle


def plan_writes(incoming: DataFrame, stored: DataFrame, name: str, digest: str, order: str) -> DataFrame:
    """Each incoming row as ``write``, ``reuse`` or ``refuse`` against (name, digest) in store."""
    held = stored.select(name, F.col(digest).alias("_held"))
    judged = idempotency(incoming, [name], digest, order).join(held, name, "left")
    found = F.col("_held").isNotNull()
    outcome = (
        F.when(found, F.when(F.col(digest) == F.col("_held"), "reuse").otherwise("refuse"))
        .when(F.col("outcome") == "new", "write")
        .when(F.col("outcome") == "replay", "reuse")
        .otherwise("refuse")
    )
    return judged.withColumn("outcome", outcome).drop("_held")


def plan_exports(requests: DataFrame, deliveries: DataFrame, targets: DataFrame) -> DataFrame:
    """Export requests (task_id, target): only committed deliveries leave, nothing is overwritten."""
    joined = requests.join(deliveries.select("task_id", "final_sha256"), "task_id", "left").join(
        targets.select("target", "target_sha256"), "target", "left"
    )
    outcome = (
        F.when(F.col("final_sha256").isNull(), "no_delivery")
        .when(F.col("target_sha256").isNull(), "new")
        .when(F.col("target_sha256") == F.col("final_sha256"), "replay")
        .otherwise("refuse")
    )
    return joined.withColumn("outcome", outcome)


def existing(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The table at ``path``, empty when nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], schema)


#: Hexadecimal digits of a key's hash that name the partition of a store the key lies in.
PREFIX_DIGITS = 2


def store(incoming: DataFrame, path: str, key: str, digest: str, order: str | None = None) -> DataFrame:
    """Write the rows of new keys to the store at ``path``; each row's outcome comes back.

    A store keeps one row per key. A row is a ``write`` when its key is new, ``reuse`` when the
    key is held with the same ``digest``, and ``refuse`` when it is held with another one or
    when its key or digest is NULL. Within a batch the first by ``order`` is stored, or the
    smallest digest. Decisions are written down before rows are, and a run that broke off is
    run again as it was: what it had stored is then reused. Files lie in folders by the start
    of the key's hash, and only folders that a batch has keys in are looked at. One writer at
    a time.
    """
    spark, columns = incoming.sparkSession, incoming.columns
    prefix = F.substring(F.sha2(F.col(key).cast("string"), 256), 1, PREFIX_DIGITS)
    batch = settle(incoming.withColumn("_prefix", prefix), "batch")
    known = F.col(key).isNotNull() & F.col(digest).isNotNull()
    touched = [r[0] for r in batch.filter(known).select("_prefix").distinct().collect()]
    stored = existing(spark, path, batch.schema).filter(F.col("_prefix").isin(touched))
    judged = plan_writes(batch.filter(known), stored, key, digest, order or digest)
    unknown = batch.filter(~known).withColumn("outcome", F.lit("refuse"))
    decided = settle(judged.select(*batch.columns, "outcome").unionByName(unknown), "decided")
    fresh = decided.filter(F.col("outcome") == "write").dropDuplicates([key]).drop("outcome")
    fresh.hint("rebalance", "_prefix").write.partitionBy("_prefix").mode("append").parquet(path)
    return decided.select(*columns, "outcome")


def stored_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What a store holds; ``schema`` is that of the rows given to it."""
    return existing(spark, path, T.StructType([*schema.fields, T.StructField("_prefix", T.StringType())])).drop("_prefix")


def append_log(log: DataFrame, batch: DataFrame, path: str, key: str, order: str) -> DataFrame:
    """Append a batch to the part of a log that lies at ``path``, numbered on from its last ``seq``.

    ``log`` holds the events before that part. Events whose ``key`` is there already are left
    out, so a batch that is run again adds nothing and keeps its numbers. The part comes back.
    One writer at a time.
    """
    spark = batch.sparkSession
    schema = T.StructType([*batch.schema.fields, T.StructField("seq", T.LongType())])
    stored = existing(spark, path, schema)
    fresh = batch.dropDuplicates([key]).join(stored.select(key), key, "left_anti")
    before = log.select("seq").unionByName(stored.select("seq"))
    settle(appended(before, fresh, order).select(*schema.fieldNames()), "appended").write.mode("append").parquet(path)
    return existing(spark, path, schema)
