"""What the operators of this subpackage share: tables, folds, bounded samples, worker sizing."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena import session

#: Rows that travel to a Python worker at once. Texts may be long, so batches are small.
BATCH_ROWS = 512

Run = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Run] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query of this subpackage, with its SQL where there is a faithful one."""

    def keep(run: Run) -> Run:
        @functools.wraps(run)
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return run(spark, sf_dir)

        QUERIES[key] = call
        if sql is not None:
            ORACLE[key] = sql
        return call

    return keep


def prepare(spark: SparkSession) -> SparkSession:
    """The library's settings, and small batches for the Python workers."""
    session.configure(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != str(BATCH_ROWS):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``. A missing id falls into part -1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts, F.lit(-1)).cast("int")


def fresh(df: DataFrame, *used: str) -> list[str]:
    """Names that no column of ``df`` has, one for each wanted name, whatever the case."""
    taken, names = {c.lower() for c in df.columns}, []
    for name in used:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        names.append(name)
    return names


def smallest_ids(ids: DataFrame, limit: int, seed: int) -> list[int]:
    """At most ``limit`` distinct ids, those with the smallest seeded hash: a sample that is
    the same on every run and whatever the partitions are."""
    key = ids.columns[0]
    rows = (
        ids.where(F.col(key).isNotNull())
        .select(F.xxhash64(F.lit(seed), F.col(key)).alias("h"), F.col(key).alias("id"))
        .distinct()
        .orderBy("h", "id")
        .limit(limit)
        .collect()
    )
    return [int(r["id"]) for r in rows]


def having(df: DataFrame, key: str, ids: list[int]) -> DataFrame:
    """Rows of a bounded list of ids; the list is part of the scan's filter."""
    return df.where(F.col(key).isin(ids)) if ids else df.limit(0)


def per_worker(key: tuple, make: Callable):
    """What ``make`` gives, made once in each Python worker process and kept for its later tasks.

    Functions travel to the workers by value, so what they hold ends with a task; this lies
    among the modules of the process. Keys are few: an operator's name and its resources.
    """
    import sys
    import types

    held = sys.modules.setdefault("_provena_kept", types.ModuleType("_provena_kept")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def give_back() -> None:
    """Hand freed memory of this process back to the system, where its C library and Arrow can."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def as_id(text: Column) -> Column:
    """An id that went to Python as a string, where nulls beside it would make it a float."""
    return text.cast("long")


def resource(path: str) -> bytes:
    """A vocabulary file, read where the driver runs; its content travels to the tasks."""
    with open(path, "rb") as file:
        return file.read()


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files lie: the package of that name, or its folder."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ModuleNotFoundError:
        return os.path.join("/opt/tokenizers", name)


#: Words of any script, digits included.
WORD = re.compile(r"\w+")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


#: Rows up to which a written table of a few numbers a row may be broadcast: at most some 50 MB.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if its counted rows are within ``limit``.

    For written tables of narrow rows, whose count costs next to nothing. Beyond the limit
    the join is left to Spark, which shuffles both sides and splits hot keys.
    """
    return F.broadcast(df) if df.count() <= limit else df
