"""Ingest and scope of materials, and digests over the set a task holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.functions import text as tx
from provena.functions.digest import ordered_digests, sha


def ingest(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Uploads with ``content`` bytes to (canonical materials, rejected uploads).

    Bytes that are not UTF-8 are rejected. Control characters are reported and kept.
    """
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    decoded = uploads.filter(valid).withColumn("raw_sha256", sha(F.col("content")))
    text = tx.canonical(F.col("content").cast("string"))
    kept = decoded.withColumn("text", text).drop("content")
    canonical = (
        kept.withColumn("sha256", sha(F.col("text")))
        .withColumn("code_points", tx.code_points(F.col("text")))
        .withColumn("size_bytes", tx.size_bytes(F.col("text")))
        .withColumn("illegal_positions", tx.illegal_positions(F.col("text")))
    )
    rejected = uploads.filter(~valid).withColumn("reason", F.lit("invalid_utf8"))
    return canonical, rejected


def scoped(materials: DataFrame, lookups: DataFrame) -> DataFrame:
    """Look up (task_id, artifact_id); other tasks' artifacts look the same as unknown ones."""
    held = materials.select("task_id", "artifact_id", "kind", "created_at", F.lit(True).alias("_held"))
    return (
        lookups.join(held, ["task_id", "artifact_id"], "left")
        .withColumn("scope", F.when(F.col("_held"), "ok").otherwise("not_found"))
        .drop("_held")
    )


def set_digests(materials: DataFrame) -> DataFrame:
    """Digest of the material set of each task, from (task_id, artifact_id, sha256).

    The lines ``id:sha256`` in order of the ids, one form for sets of every size. They are
    hashed as they pass, so no list grows with the task.
    """
    pair = F.concat_ws(":", "artifact_id", "sha256")
    digests = ordered_digests(materials, ["task_id"], [F.col("artifact_id"), F.col("sha256")], pair, "\n")
    return digests.select("task_id", F.col("digest").alias("set_digest"), F.lit("ok").alias("set_status"))


def empty_set_digest() -> Column:
    """The digest of a task that holds no materials, for which ``set_digests`` has no row."""
    return sha(F.lit(""))


def counts(tasks: DataFrame, materials: DataFrame) -> DataFrame:
    """Materials per task, zero for tasks without any."""
    held = materials.groupBy("task_id").agg(F.count("*").alias("_n"))
    return tasks.join(held, "task_id", "left").withColumn(
        "material_count", F.coalesce(F.col("_n"), F.lit(0)).cast("bigint")
    ).drop("_n")


def line_offsets(materials: DataFrame) -> DataFrame:
    """Code-point start of every line. The window holds one material, never a group."""
    exploded = materials.filter(F.col("text") != "").select(
        "artifact_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )
    before = Window.partitionBy("artifact_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    narrow = exploded.select("artifact_id", "pos", F.length("line").alias("_len"))
    start = F.coalesce(F.sum(F.col("_len") + 1).over(before), F.lit(0))
    return narrow.select(
        "artifact_id", F.col("pos").cast("bigint").alias("line_no"),
        start.cast("bigint").alias("line_start"), F.col("_len").cast("bigint").alias("line_length"),
    )
