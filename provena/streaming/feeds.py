"""Streams over the ledger's tables, and how a finished run is read back.

Sources are file streams; the checkpoint's offset is the cursor. ``files_per_trigger``
bounds a micro-batch, and with it what one key can bring at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena import session
from provena.functions.digest import sha
from provena.functions import text as tx
from provena.operators.ledger import TRANSITIONS
from provena.operators.ranking import first_rows, latest_rows
from provena.sources import sinks
from provena.streaming import processors

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark: SparkSession, sf_dir: str, table: str, files_per_trigger: int = 64) -> DataFrame:
    """A given table as a file stream of its own schema.

    A plain path must be a folder for a stream; the pattern also takes a table that is one file.
    """
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{sf_dir}/{table}.parque[t]")


def run_append(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there into Parquet and read the result."""
    spark = stream.sparkSession
    out, checkpoint = session.work_dir(spark, name), session.work_dir(spark, f"{name}-checkpoint")
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_update(stream: DataFrame, name: str, keys: list[str], values: list[str]) -> DataFrame:
    """Run an aggregation in update mode; the last micro-batch that touched a key holds."""
    spark = stream.sparkSession
    out, checkpoint = session.work_dir(spark, name), session.work_dir(spark, f"{name}-checkpoint")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return latest_rows(spark.read.parquet(out), keys, [F.col("_batch")], values)


def stateful(spark: SparkSession) -> None:
    """The processors keep their state in RocksDB."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def feed(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """Events after each task's cursor; the cursors are a static table."""
    return log.join(cursors, "task_id").filter(F.col("seq") > F.col("after_seq"))


@dataclass(frozen=True)
class Split:
    """A stream cut in two by a bound of its own: what came within ``delay`` of the latest
    event of earlier batches, as a stream that no watermark of that delay drops rows of, and
    what came later than that."""

    on_time: DataFrame
    settled: DataFrame
    late: DataFrame
    delay: str

    def bound(self, at: str = "created_at") -> Column:
        """The watermark after everything on time was read, as a column of one value."""
        top = self.settled.agg(F.date_trunc("millisecond", F.max(at)).alias("top")).first()["top"]
        return F.lit(top).cast("timestamp") - F.expr(f"INTERVAL {self.delay}")


def split_late(stream: DataFrame, name: str, delay: str = "1 hour", at: str = "created_at") -> Split:
    """Cut ``stream`` into rows on time and late rows, so that none is lost to a watermark.

    Each batch writes its rows and its latest event under its own number; a batch that runs
    again writes the same files again. Rows without a time are late. A batch is judged by the
    batches before it alone, so the cut is the same after a restart.
    """
    spark = stream.sparkSession
    out, checkpoint = session.work_dir(spark, name), session.work_dir(spark, f"{name}-checkpoint")
    schema = stream.schema

    def cut(batch: DataFrame, batch_id: int) -> None:
        tops = sinks.existing(spark, f"{out}/tops", "top timestamp, batch bigint").where(F.col("batch") < batch_id)
        bound = F.lit(tops.agg(F.max("top")).first()[0]).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        on_time = F.coalesce(F.col(at) >= bound, F.col(at).isNotNull())
        batch.persist()
        batch.where(on_time).write.mode("overwrite").parquet(f"{out}/on_time/part-{batch_id:09d}")
        batch.where(~on_time).write.mode("overwrite").parquet(f"{out}/late/part-{batch_id:09d}")
        batch.agg(F.max(at).alias("top")).write.mode("overwrite").parquet(f"{out}/tops/batch={batch_id}")
        batch.unpersist()

    query = stream.writeStream.foreachBatch(cut).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    read = lambda part: spark.read.schema(schema).parquet(f"{out}/{part}/part-*")
    return Split(spark.readStream.schema(schema).parquet(f"{out}/on_time/part-*"), read("on_time"), read("late"), delay)


def dedup(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Replays of an event within the delay are dropped; state older than it goes."""
    return log.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["seq"])


def dedup_all(log: DataFrame, name: str, columns: list[str], delay: str = "1 hour") -> DataFrame:
    """Every event once, however late it or its replay comes.

    The stream drops replays within the delay; late rows, and replays further apart, are
    settled by number against what the stream let through.
    """
    split = split_late(log, f"{name}-split", delay)
    seen = run_append(dedup(split.on_time, delay).select("seq", *columns), name)
    late = split.late.select("seq", *columns).join(seen.select("seq"), "seq", "left_anti")
    return first_rows(seen.unionByName(late), ["seq"], [F.col(c) for c in columns], columns)


def settled_decisions(decisions: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run a stream of decisions and keep the last one on each row; earlier ones were corrected."""
    rows, key = run_append(decisions, name), [*keys, "tag"]
    values = [c for c in rows.columns if c not in (*key, "revision")]
    return latest_rows(rows, key, [F.col("revision")], values).drop("tag")


def idempotency(requests: DataFrame, keep: int | None = None) -> DataFrame:
    """(request_key, seq, digest) to new, replay or conflict, with corrections."""
    stateful(requests.sparkSession)
    return requests.groupBy("request_key").transformWithStateInPandas(
        statefulProcessor=processors.Idempotency(keep), outputStructType=processors.IDEMPOTENCY_OUT,
        outputMode="Append", timeMode="None",
    )


def task_state(requests: DataFrame, keep: int | None = None) -> DataFrame:
    """(task_id, seq, status, expected_epoch) through each task's state machine, with corrections."""
    stateful(requests.sparkSession)
    return requests.groupBy("task_id").transformWithStateInPandas(
        statefulProcessor=processors.TaskState(TRANSITIONS, keep), outputStructType=processors.STATE_OUT,
        outputMode="Append", timeMode="None",
    )


def budget(calls: DataFrame, max_calls: int, max_chars: int, gap_seconds: float, keep: int | None = None) -> DataFrame:
    """(turn, call_no, chars, created_at) through the caps of each turn, with corrections."""
    stateful(calls.sparkSession)
    timed = calls.withColumn("at", F.unix_micros("created_at") / 1e6)
    return timed.groupBy("turn").transformWithStateInPandas(
        statefulProcessor=processors.TurnBudget(max_calls, max_chars, gap_seconds, keep),
        outputStructType=processors.BUDGET_OUT, outputMode="Append", timeMode="None",
    )


def _windowed(window: Column, keys: list[str], log: DataFrame) -> DataFrame:
    return log.groupBy(window.alias("_w"), *keys).agg(F.count("*").alias("n")).select(
        F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, "n"
    )


def counts(log: DataFrame, window: Column, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Events per window and keys; a window is final once the watermark has passed it."""
    return _windowed(window, keys, log.withWatermark("created_at", delay))


def counts_all(split: Split, name: str, window: Column, keys: list[str]) -> DataFrame:
    """Counts of closed windows in which late rows are counted too, in windows of their own
    where nothing came on time."""
    closed = run_append(counts(split.on_time, window, keys, split.delay), name)
    late = _windowed(window, keys, split.late).where(F.col("window_end") <= split.bound())
    return closed.unionByName(late).groupBy("window_start", "window_end", *keys).agg(F.sum("n").alias("n"))


def counts_so_far(split: Split, name: str, window: Column, keys: list[str]) -> DataFrame:
    """Counts of all windows, open ones and late rows included."""
    now = run_update(counts(split.on_time, window, keys, split.delay), name, [*keys, "window_start"], ["window_end", "n"])
    late = _windowed(window, keys, split.late).select(*keys, "window_start", "window_end", "n")
    return now.unionByName(late).groupBy(*keys, "window_start", "window_end").agg(F.sum("n").alias("n"))


def sessions_all(split: Split, name: str, window: Column, keys: list[str]) -> DataFrame:
    """Closed sessions. A late row may join two of them, so the sessions of a key that has
    late rows are cut anew from all its rows; those of other keys are the stream's."""
    closed = run_append(counts(split.on_time, window, keys, split.delay), name)
    touched = split.late.select(*keys).distinct()
    anew = split.settled.join(touched, keys, "left_semi").unionByName(split.late)
    # Written before the filter, which would else be applied to rows whose sessions are not joined yet.
    again = session.settle(_windowed(window, keys, anew), f"{name}-anew").where(F.col("window_end") <= split.bound())
    return closed.join(touched, keys, "left_anti").unionByName(again)


def ingest(documents: DataFrame, name: str = "ingested") -> DataFrame:
    """Content-addressed sink: each text is written once, whatever is replayed.

    A batch looks only at the folders of the store that its keys lie in. Rows that the store
    refuses stop the stream: a digest that stands for two texts is no replay.
    """
    spark = documents.sparkSession
    out, checkpoint = session.work_dir(spark, name), session.work_dir(spark, f"{name}-checkpoint")
    hashed = documents.select(sha(F.col("text")).alias("sha256"), tx.code_points(F.col("text")).alias("code_points"))

    def write(batch: DataFrame, batch_id: int) -> None:
        outcomes = sinks.store(batch.where(F.col("sha256").isNotNull()), out, "sha256", "code_points")
        refused = outcomes.where(F.col("outcome") == "refuse").first()
        if refused is not None:
            raise ValueError(f"{refused.sha256} is held with another length than {refused.code_points}")

    query = hashed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sinks.stored_rows(spark, out, hashed.schema)
