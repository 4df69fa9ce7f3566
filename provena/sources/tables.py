"""The given tables seen as the engine's own: tasks, materials, templates, events.

A task owns ``TASK_SIZE`` consecutive documents, below the limit of 50 materials per
task, so anything gathered per task is bounded however large the corpus is.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from provena.functions import text as tx
from provena.functions.digest import sha

TASK_SIZE = 20

#: Statuses of a task, in the order used to spread them over task numbers.
STATUSES = ("created", "running", "awaiting_user", "parked", "completed", "failed", "cancelled")

SLOT_SCHEMA = (
    "template_version_id string, slot_id string, slot_pos int, placeholder string, kind string, "
    "required boolean, allow_user_omit boolean, semantic_requirement string, style_key string, "
    "markers array<string>"
)


#: Tables of long texts, and the key by which a scan of too few parts is spread.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(rows, TEXT_TABLES[table]) if table in TEXT_TABLES else rows


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a scan over all cores when the files give fewer parts than that.

    One small file is one task, whatever is computed on its texts. A large table scans in
    many more parts than there are cores and is left as it is, so no body is shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table. As a local relation its exact size is known to the planner, so
    joining it never moves the other side."""
    fields = T.StructType.fromDDL(schema)
    named = [dict(zip(fields.names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(named, to_arrow_schema(fields)), fields)


def padded_id(prefix: str, number: Column) -> Column:
    """An id of the usual shape that spells a number."""
    return F.concat(F.lit(prefix + "_"), F.lpad(number.cast("string"), 32, "0"))


def task_no(doc_id: Column) -> Column:
    return F.floor(doc_id / TASK_SIZE).cast("bigint")


def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as canonical materials of tasks."""
    docs = read(spark, sf_dir, "documents")
    number = task_no(F.col("doc_id"))
    return docs.select(
        number.alias("task_no"),
        padded_id("task", number).alias("task_id"),
        padded_id("art", F.col("doc_id")).alias("artifact_id"),
        "doc_id",
        F.lit("canonical_text").alias("kind"),
        F.concat(
            F.lit("tasks/"), number.cast("string"), F.lit("/inbox/"), F.col("source"),
            F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt"),
        ).alias("relative_path"),
        F.col("doc_id").alias("created_at"),
        "text",
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per task number that owns a document."""
    numbers = (
        read(spark, sf_dir, "documents")
        .select(task_no(F.col("doc_id")).alias("task_no"))
        .groupBy("task_no")
        .agg(F.count("*").alias("material_count"))
    )
    return numbers.select(
        "task_no",
        padded_id("task", F.col("task_no")).alias("task_id"),
        F.element_at(
            F.array(*[F.lit(s) for s in STATUSES]), (F.col("task_no") % 7 + 1).cast("int")
        ).alias("status"),
        F.when(F.col("task_no") % 2 == 0, "local_only").otherwise("llm_allowed").alias("data_policy"),
        (1 + F.col("task_no") % 2).cast("bigint").alias("epoch"),
        template_of(F.col("task_no")).alias("template_version_id"),
        "material_count",
    )


def template_of(number: Column) -> Column:
    return padded_id("tver", number % 3)


def contract_slots(spark: SparkSession) -> DataFrame:
    """Three template versions of three slots each. The last one's final slot names no marker."""
    slots = (
        ("sales_summary", "weekly sales summary", True, False, ["本周销售", "销售情况", "sales"]),
        ("risks", "open risk and dependency list", True, True, ["风险", "依赖", "risk"]),
        ("next_plan", "plan for the coming week", True, False, ["下周计划", "计划", "plan"]),
    )
    rows = []
    for version in range(3):
        for pos, (slot, semantic, required, omit, markers) in enumerate(slots):
            if version == 2 and slot == "next_plan":
                semantic = "next steps"
            rows.append(
                (f"tver_{version:032d}", slot, pos, "{{ " + slot + " }}", "text_block",
                 required, omit, semantic, "body" if version < 2 or pos < 2 else "note", markers)
            )
    return literal(spark, rows, SLOT_SCHEMA)


def headed_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materials in which every third line has become a section heading."""
    base = materials(spark, sf_dir)
    doc, number = F.col("doc_id"), F.col("task_no")

    def mark(line: Column, i: Column) -> Column:
        turn = (doc + i) % 4
        word = (
            F.when(turn == 0, "sales")
            .when(turn == 1, F.when(number % 5 == 3, "notes").otherwise("risk"))
            .when(turn == 2, "plan")
            .otherwise("notes")
        )
        return F.when(i % 3 == 0, F.concat(F.lit("## "), word, F.lit(" "), line)).otherwise(line)

    headed = F.array_join(F.transform(F.split("text", "\n"), mark), "\n")
    return base.withColumn("text", headed)


def raw_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materials as uploaded: mixed line ends, some decomposed accents, some bad bytes."""
    base = materials(spark, sf_dir)
    pieces = F.split("text", "\n")

    def ended(line: Column, i: Column) -> Column:
        end = (
            F.when(i == F.size(pieces) - 1, "")
            .when(i % 7 == 6, "\r\n")
            .when(i % 11 == 10, "\r")
            .otherwise("\n")
        )
        return F.concat(line, end)

    mixed = F.array_join(F.transform(pieces, ended), "")
    loose = F.when(F.col("doc_id") % 3 == 0, F.replace(mixed, F.lit("\u00e9"), F.lit("e\u0301"))).otherwise(mixed)
    content = F.encode(loose, "UTF-8")
    broken = F.when(F.col("doc_id") % 17 == 5, F.concat(F.unhex(F.lit("FF")), content)).otherwise(content)
    return base.withColumn("content", broken).drop("text")


def controlled_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materials with a BEL before some lines."""
    base = materials(spark, sf_dir)
    ringing = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.when((F.col("doc_id") + i) % 13 == 0, F.concat(F.lit("\x07"), line)).otherwise(line),
    )
    return base.withColumn("text", F.array_join(ringing, "\n"))


def hashed(df: DataFrame) -> DataFrame:
    """Add the text's digest and length."""
    return df.withColumn("sha256", sha(F.col("text"))).withColumn("code_points", tx.code_points(F.col("text")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as an append-only log of tasks (one per user)."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        padded_id("task", F.col("user_id")).alias("task_id"),
        "user_id",
        F.col("event_type").alias("event_code"),
        F.col("ts").cast("timestamp").alias("created_at"),
        "value",
        "props",
    )
