"""Exact top-k by inner product with the threshold algorithm over sorted lists.

Every block of vectors has one list per dimension, sorted by that component. A query reads the
lists from the end that its own sign favours; what it meets is scored exactly at once. What it
has not met lies below the place reached in every list, and within the longest norm of the
block; when no such vector can reach the k-th result, the search of the block is over. A
query's own block is searched first, and its k-th score there lets the others stop sooner.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena import session
from provena.llm import blocks


@dataclass(frozen=True)
class Params:
    """top: results of a query. scale: components become floor(scale * x). block, turn: vectors
    and queries that a task holds. step: entries read from a list at first; later reads grow
    with what was read before."""

    top: int = 10
    scale: int = 1024
    block: int = 10_000
    turn: int = 10_000
    step: int = 32


class Lists:
    """Vectors of a block with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.repeats = ids, x, len(np.unique(ids)) < len(ids)
        self.order = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)
        self.values = np.take_along_axis(x.T, self.order, 1)
        # Above the true longest norm, whatever the rounding.
        self.norm = float(np.sqrt((x**2).sum(1)).max(initial=0.0)) * (1 + 1e-9)

    def _bound(self, q: np.ndarray, reached: np.ndarray) -> tuple[float, float]:
        """No vector with components of at most ``reached`` (for q >= 0), within the longest
        norm, scores more; and the multiplier of the norm that says so. For every multiplier
        m > 0 the Lagrangian m r^2 / 2 + sum of max(q x - m x^2 / 2) is such a bound."""
        open_ = float(q @ reached)
        if self.norm <= 0 or not (reached**2).sum() > self.norm**2:
            return open_, 0.0
        low, high = 0.0, float(np.sqrt((q**2).sum())) / self.norm + 1e-300
        best, at = open_, 0.0
        for _ in range(24):
            m = (low + high) / 2
            if m <= 0:
                break
            x = np.minimum(reached, q / m)
            value = m * self.norm**2 / 2 + float(q @ x) - m * float(x @ x) / 2
            if value < best:
                best, at = value, m
            if float(x @ x) > self.norm**2:
                low = m
            else:
                high = m
        return best, at

    def search(self, query: np.ndarray, own: int, floor: float | None, p: Params) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and exact scores of the ``top`` best, and how many vectors were scored. Only
        scores of at least ``floor``, if there is one, need to be among them."""
        n, width = self.x.shape
        q, flip = np.abs(query), query < 0
        dims = np.flatnonzero(q)
        # More than rounding can add to a bound.
        slack = 1e-9 * float(np.sqrt((q**2).sum())) * self.norm + 1e-6
        seen = np.zeros(n, bool)
        read = np.zeros(width, np.int64)
        ids, found = np.zeros(0, np.int64), np.zeros(0)
        while not seen.all():
            # The next entry of every list; a list read to its end has nothing below it.
            reached = np.where(flip, -self.values[np.arange(width), np.minimum(read, n - 1)], self.values[np.arange(width), np.maximum(n - 1 - read, 0)])
            bound, m = self._bound(q[dims], reached[dims]) if len(dims) else (0.0, 0.0)
            limit = found[-1] if len(found) == p.top else None
            limit = floor if limit is None or (floor is not None and floor > limit) else limit
            if limit is not None and bound + slack < limit:
                break
            if len(dims) == 0 or read.sum() >= n:
                # The lists were read for as many entries as there are vectors: the rest at once.
                new = np.flatnonzero(~seen)
            else:
                new = self._next(q, flip, dims, reached, read, m, max(p.step, int(read.sum()) // 3))
                new = np.unique(new[~seen[new]])
            seen[new] = True
            other = new[self.ids[new] != own]
            if len(other):
                score = blocks.scores(self.x[other], query)
                ids, found = np.concatenate([ids, self.ids[other]]), np.concatenate([found, score])
                keep = blocks.first(ids, found, p.top, self.repeats)
                ids, found = ids[keep], found[keep]
        return ids, found, int(seen.sum())

    def _next(self, q, flip, dims, reached, read, m, step) -> np.ndarray:
        """Reads the list that lowers the bound most for each entry read."""
        n = len(self.ids)
        steps = np.array([step, 4 * step, 16 * step])
        to = np.minimum(read[dims, None] + steps, n)
        at = np.where(flip[dims, None], np.minimum(to, n - 1), np.maximum(n - 1 - to, 0))
        after = np.where(flip[dims, None], -1, 1) * self.values[dims[:, None], at]

        def share(b):
            x = np.minimum(b, q[dims, None] / m) if m > 0 else b
            return q[dims, None] * x - m * x * x / 2

        gain = (share(reached[dims, None]) - share(after)) / np.maximum(to - read[dims, None], 1)
        gain[read[dims] >= n] = -1.0
        d, s = divmod(int(np.argmax(gain)), len(steps))
        d, begin, end = dims[d], int(read[dims[d]]), int(to[d, s])
        read[d] = end
        return self.order[d, begin:end] if flip[d] else self.order[d, n - end : n - begin]


FOUND = "query_id long, vec_id long, score long, scored long"


def _searched(p: Params):
    def run(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        lists = Lists(block["vec_id"].to_numpy(np.int64), blocks.matrix(block["x"]))
        out = []
        for query_id, x, floor in zip(asked["query_id"].tolist(), asked["own_x"], asked["floor"]):
            ids, found, scored = lists.search(np.asarray(x, np.float64), query_id, None if pd.isna(floor) else float(floor), p)
            out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids, "score": blocks.long(found), "scored": scored}))
        return pd.concat(out)

    return run


def found(vectors: DataFrame, is_query: Column, p: Params = Params()) -> DataFrame:
    """What ``search`` ranks: query_id, vec_id, score, and how many vectors of the block were scored."""
    points, n = blocks.dealt_by_axis(blocks.scaled(vectors, p.scale, asks=F.coalesce(is_query, F.lit(False))), p.block, "sorted-lists")
    asks = points.where("asks").select(F.col("vec_id").alias("query_id"), F.col("width").alias("own_width"), F.col("x").alias("own_x"), F.col("block").alias("away"))
    points = points.select("width", "block", "vec_id", "x")
    home = asks.withColumn("home", F.col("away")).withColumn("floor", F.lit(None).cast("double"))
    near = session.settle(blocks.met(points, home, n, p.turn, _searched(p), FOUND), "own-block")
    if n == 1:
        return near
    pairs = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    # Ten rows for each query: the k-th of the own block, where it has so many.
    floors = pairs.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    floors = floors.select("query_id", F.when((F.size("s") >= p.top) & (F.abs(F.get("s", p.top - 1)) < 1 << 62), F.get("s", p.top - 1).cast("double")).alias("floor"))
    far = asks.join(floors, "query_id", "left").withColumn("home", F.lit(None).cast("int"))
    return near.unionByName(blocks.met(points, far, n, p.turn, _searched(p), FOUND))


def search(vectors: DataFrame, is_query: Column, p: Params = Params()) -> DataFrame:
    """The ``top`` rows with the highest integer inner products for every row that ``is_query``
    holds for.

    ``vectors`` has vec_id and embedding; other columns are not read. query_id, rank from 1,
    vec_id and score; ties go to the smaller vec_id. Rows without an id or vector, or with a
    component that is null or not finite (also times ``scale``), take no part. A row is no
    candidate of rows of its own id; of repeated ids the best score counts. Vectors meet those
    of their own width only; empty ones have scores of 0 among themselves. Scores beyond a
    long, which are compared exactly within a block, come out as the nearest long.
    """
    best = found(vectors, is_query, p).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.top).select("query_id", "rank", "vec_id", "score")
