"""A stated set of query rows against every row of a table of vectors, block by block.

Rows are dealt to blocks by a hash of their id, so that no block grows with a hot label or a
common vector, and queries to turns of bounded size. A task sees one block and one turn.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena import session

#: Products and sums of integers below this are exact in double precision.
EXACT = float(1 << 53)


def scaled(vectors: DataFrame, scale: int, **more: Column) -> DataFrame:
    """vec_id, x (the floors of ``scale`` times each component, as doubles) and ``more`` of the
    rows that take part: an id, a vector, and components that are known and finite, scaled too."""
    e = F.col("embedding").cast("array<double>")
    x = F.transform(e, lambda c: F.lit(float(scale)) * c)
    fit = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # Doubles from 2**52 on are whole numbers already, and may be no longs.
    whole = F.transform(x, lambda c: F.when(F.abs(c) < float(1 << 52), F.floor(c).cast("double")).otherwise(c))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fit, F.lit(False)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"), *[c.alias(n) for n, c in more.items()])


def dealt(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """``rows``, written down, with their width and block, and how many blocks there are. Rows
    of one id are in one block."""
    kept = session.settle(rows, name)
    blocks = max(1, -(-kept.count() // size))
    return kept.withColumn("width", F.size("x")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")), blocks


def dealt_by_axis(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """As ``dealt``, but rows whose largest component is the same signed axis share blocks, so
    that near rows mostly do. Small axes share a block, large ones are split by the id's hash.
    The counts that steer it are two numbers for each dimension."""
    most = F.array_position(F.transform("x", lambda c: F.abs(c)), F.array_max(F.transform("x", lambda c: F.abs(c)))).cast("int")
    axis = F.coalesce(F.when(F.get("x", most - 1) < 0, -most).otherwise(most), F.lit(0))
    kept = session.settle(rows.withColumn("axis", axis), name)
    spans, first, room = [], -1, 0
    for axis, count in sorted((r["axis"], r["n"]) for r in kept.groupBy("axis").agg(F.count("*").alias("n")).collect()):
        if count > room:
            parts = -(-count // size)
            first, room = (spans[-1][1] + spans[-1][2] if spans else 0), (size - count if parts == 1 else 0)
            spans.append((axis, first, parts))
        else:
            room -= count
            spans.append((axis, first, 1))
    where = F.broadcast(rows.sparkSession.createDataFrame(spans, "axis int, first int, parts int").coalesce(1))
    block = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    placed = kept.join(where, "axis").withColumn("width", F.size("x")).withColumn("block", block.cast("int")).drop("axis", "first", "parts")
    return placed, max([f + n for _, f, n in spans], default=1)


def met(points: DataFrame, queries: DataFrame, blocks: int, turn: int, run: Callable, schema: str) -> DataFrame:
    """``run(block, queries)`` for every block and turn of one width.

    ``queries`` has query_id, own_width and ``home``, the only block it goes to, or null for
    all but ``away``; it shares no column with ``points``. Each row of ``points`` goes out once for each turn.
    """
    turns = max(1, -(-queries.count() // turn))
    sent = points.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    goes = F.when(F.col("home").isNotNull(), F.array("home")).otherwise(F.array_except(F.sequence(F.lit(0), F.lit(blocks - 1)), F.array("away")))
    asked = queries.withColumn("own_block", F.explode(goes)).withColumn("own_turn", F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int")).drop("home", "away")

    def both(block: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        return run(block, asks) if len(block) and len(asks) else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    return sent.groupBy("width", "block", "turn").cogroup(asked.groupBy("own_width", "own_block", "own_turn")).applyInPandas(both, schema)


def matrix(arrays: pd.Series) -> np.ndarray:
    return np.array([np.asarray(a, np.float64) for a in arrays]).reshape(len(arrays), -1)


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; beyond doubles in Python's integers."""
    if not x.size:
        return np.zeros(len(x))
    if np.abs(x).max() * np.abs(q).sum() < EXACT:
        return x @ q
    whole = [int(v) for v in q]
    return np.array([sum(int(a) * b for a, b in zip(row, whole)) for row in x] or [0], object)[: len(x)]


def first(ids: np.ndarray, found: np.ndarray, top: int, repeats: bool = False) -> np.ndarray:
    """Places of the ``top`` highest, ties by smaller id, in order; with ``repeats`` only the
    best of each id counts."""
    if repeats:
        order = first(ids, found, len(ids))
        return order[np.sort(np.unique(ids[order], return_index=True)[1])][:top]
    if found.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-found[i], ids[i]))[:top], np.int64)
    if len(ids) > top:
        near = np.flatnonzero(found >= np.partition(found, len(ids) - top)[len(ids) - top])
        return near[np.lexsort((ids[near], -found[near]))[:top]]
    return np.lexsort((ids, -found))[:top]


def long(found: np.ndarray) -> np.ndarray:
    """Scores as longs; those beyond them end at the smallest or largest long."""
    if found.dtype == object:
        return np.array([max(-(1 << 63), min((1 << 63) - 1, int(v))) for v in found], np.int64)
    return found.astype(np.int64)
