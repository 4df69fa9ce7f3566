"""Approximate nearest neighbours by inner product: cross-polytope hashing with probes.

Vectors are split into bands of similar norm. Within a band one more coordinate makes up for
the band's longest; queries are brought to unit length with none of it, so that the largest
inner product is the smallest angle. A table turns them by three rounds of random signs and a
fast Hadamard transform; the nearest signed axis is the cell. A query looks into the cells of
its nearest axes in every table of every band, and what lies there is ranked by exact inner
products of the original vectors in double precision.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena import session
from provena.llm import common


@dataclass(frozen=True)
class Params:
    """tables, probes: hash tables, and cells of each that a query looks into.

    single: a band of up to so many vectors is one cell, searched exactly. cell: vectors
        in a cell on average while one polytope can be cut that fine. group: vectors that a
        task holds at once; a cell of more is split over groups that all its queries visit.
    second: from so many vectors for each cell of one polytope on, a second one cuts the
        cells of the first.
    ratio: the longest norm of a larger band is at most so many times its shortest.
    """

    top: int = 20
    tables: int = 14
    probes: int = 6
    single: int = 1000
    cell: int = 80
    group: int = 50_000
    second: int = 20_000
    seed: int = 3
    ratio: float = 1.5


@dataclass(frozen=True)
class Band:
    """Vectors of similar norm. axes: of the first and second polytope. first: the number of
    its first cell among those of all bands."""

    count: int
    shortest: float
    longest: float
    lift: bool
    axes: tuple[int, int]
    cells: int
    probes: int
    first: int


@dataclass(frozen=True)
class Shape:
    """What hashing needs to know of all vectors; bands from the longest norm down."""

    count: int
    width: int
    bands: tuple[Band, ...]

    @property
    def axes(self) -> tuple[int, int]:
        """The finest polytopes of any band."""
        return max((b.axes for b in self.bands), key=lambda a: (a[1], a[0]), default=(0, 0))


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part: no null id or vector, and components
    that are all finite and not all zero."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & e.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(e, lambda x: x != 0))


def _matrix(arrays, width: int) -> np.ndarray:
    return np.array([np.asarray(a, np.float64) for a in arrays]).reshape(-1, width)


def _norms(x: np.ndarray) -> np.ndarray:
    """Lengths of the rows, which are not all zero; squares neither overflow nor vanish."""
    most = np.abs(x).max(1)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(1))


def _band(count: int, shortest: float, longest: float, width: int, first: int, p: Params) -> Band:
    lift = shortest < longest * (1 - 1e-4)
    if count <= p.single:
        return Band(count, shortest, longest, lift, (0, 0), 1, 1, first)
    full = 1 << int(np.ceil(np.log2(width + lift)))
    one = min(full, 1 << max(0, int(np.log2(count / p.cell / 2))))
    two, probes = 0, min(p.probes, 2 * one)
    if count > p.second * 2 * one:
        two = min(full, 1 << int(np.ceil(np.log2(count / (p.second * 2 * one)))))
        probes = int(np.ceil(p.probes * two**0.75))
    return Band(count, shortest, longest, lift, (one, two), 2 * one * max(1, 2 * two), probes, first)


def measure(vectors: DataFrame, p: Params) -> Shape:
    """Counts and norms over every vector, in steps of a hundredth; the commonest width wins."""

    def run(batches):
        for batch in batches:
            widths = batch["embedding"].map(len).to_numpy()
            for width in np.unique(widths):
                norm = _norms(_matrix(batch["embedding"][widths == width], int(width)))
                yield pd.DataFrame({"width": int(width), "step": np.floor(100 * np.log(norm)).astype(int), "norm": norm})

    steps = vectors.select("embedding").mapInPandas(run, "width int, step int, norm double").groupBy("width", "step")
    steps = steps.agg(F.count("*").alias("n"), F.min("norm").alias("low"), F.max("norm").alias("high"))
    # So many steps as norms have hundredths of a logarithm.
    row = steps.groupBy("width").agg(F.sum("n").alias("n"), F.collect_list(F.struct("step", "n", "low", "high")).alias("steps")).orderBy(F.desc("n"), "width").first()
    if row is None:
        return Shape(0, 0, ())
    joined = []
    for step in sorted(row["steps"], key=lambda r: -r["step"]):
        if joined and (step["low"] * p.ratio >= joined[-1][2] or joined[-1][0] + step["n"] <= p.single):
            joined[-1] = (joined[-1][0] + step["n"], step["low"], joined[-1][2])
        else:
            joined.append((step["n"], step["low"], step["high"]))
    bands, first = [], 0
    for count, low, high in joined:
        bands.append(_band(count, low, high, row["width"], first, p))
        first += bands[-1].cells
    return Shape(row["n"], row["width"], tuple(bands))


def _turned(x: np.ndarray, number: int, seed: int) -> np.ndarray:
    """Vectors at unit length, turned by the pseudo-rotation of that number."""
    full = 1 << int(np.ceil(np.log2(x.shape[1])))
    y = np.zeros((len(x), full))
    y[:, : x.shape[1]] = x
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    rng = np.random.default_rng([seed, number])
    for _ in range(3):
        y *= rng.choice([-1.0, 1.0], full)
        h = 1
        while h < full:
            z = y.reshape(len(y), -1, 2, h)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], 2).reshape(len(y), full)
            h *= 2
        y /= np.sqrt(full)
    return y


def _signed(y: np.ndarray, axes: int) -> np.ndarray:
    return np.concatenate([y[:, :axes], -y[:, :axes]], 1)


def _nearest(far: list[np.ndarray], probes: int) -> np.ndarray:
    """The nearest ``probes`` cells of a table, nearest first, by the signed axes of one or two polytopes."""
    # How much farther an axis is than the nearest; cells of both polytopes add theirs up.
    gaps = [v.max(1, keepdims=True) - v for v in far]
    if len(far) == 1:
        return np.argsort(gaps[0], axis=1, kind="stable")[:, :probes]
    near = [np.argsort(g, axis=1, kind="stable")[:, : min(probes, g.shape[1])] for g in gaps]
    cost = [np.take_along_axis(g, k, 1) for g, k in zip(gaps, near)]
    both = (cost[0][:, :, None] + cost[1][:, None, :]).reshape(len(far[0]), -1)
    best = np.argsort(both, axis=1, kind="stable")[:, :probes]
    first, second = best // near[1].shape[1], best % near[1].shape[1]
    return np.take_along_axis(near[0], first, 1) * far[1].shape[1] + np.take_along_axis(near[1], second, 1)


def _cells(plain: np.ndarray, lifted: np.ndarray, bands: tuple[Band, ...], p: Params, one: bool) -> np.ndarray:
    """Cells of every table of ``bands``, only the nearest or all to look into. A number
    holds the table as its remainder by ``tables``."""
    out = []
    for t in range(p.tables):
        turned = functools.cache(lambda lift, number: _turned(lifted if lift else plain, number, p.seed))
        for band in bands:
            if band.cells > 1:
                far = [_signed(turned(band.lift, 2 * t + k), axes) for k, axes in enumerate(band.axes) if axes]
                out.append((band.first + _nearest(far, 1 if one else band.probes)) * p.tables + t)
            elif t == 0:
                out.append(np.full((len(plain), 1), band.first * p.tables))
    return np.hstack(out)


def point_cells(x: np.ndarray, shape: Shape, p: Params) -> list[np.ndarray]:
    """Of each row its cell in every table of its band."""
    out, norm = [None] * len(x), _norms(x)
    own = (norm[:, None] < [b.shortest for b in shape.bands[:-1]]).sum(1)
    for k in np.unique(own):
        rows, band = np.flatnonzero(own == k), shape.bands[k]
        plain = x[rows] / band.longest
        rest = np.sqrt(np.maximum(0, 1 - (plain**2).sum(1, keepdims=True)))
        for r, cells in zip(rows, _cells(plain, np.hstack([plain, rest]), (band,), p, True)):
            out[r] = cells
    return out


def query_cells(x: np.ndarray, shape: Shape, p: Params) -> list[np.ndarray]:
    """Of each row the cells that it looks into, in every band."""
    plain = x / _norms(x)[:, None]
    return list(_cells(plain, np.hstack([plain, np.zeros((len(x), 1))]), shape.bands, p, False)) if len(x) else []


def _hashed(vectors: DataFrame, shape: Shape, cells_of, column: str, p: Params) -> DataFrame:
    """id, the vector as bytes, and the cells of all tables in one row."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch["embedding"], shape.width)
            yield pd.DataFrame({column: batch["vec_id"], "vector": [r.tobytes() for r in x], "cells": cells_of(x, shape, p)})

    sized = vectors.where(F.size("embedding") == shape.width)
    return sized.mapInPandas(run, f"{column} long, vector binary, cells array<long>")


def _best(ids: np.ndarray, scores: np.ndarray, top: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:top]


def search(vectors: DataFrame, is_query: Column, p: Params = Params()) -> DataFrame:
    """The ``top`` nearest found for every row that ``is_query`` holds for.

    ``vectors`` has vec_id and embedding; other columns are not read. query_id, rank from 1,
    vec_id and score; ties go to the smaller vec_id. A row is no neighbour of rows of its
    own id; of repeated ids the best score counts. Rows that ``valid`` leaves out, and rows
    of another width than most, take no part.
    """
    all_ = valid(vectors)
    shape = measure(all_, p)
    schema = "query_id long, rank int, vec_id long, score double"
    if shape.count == 0:
        return vectors.sparkSession.createDataFrame([], schema)
    groups = max(1, -(-shape.count // p.group))
    points = _hashed(all_, shape, point_cells, "vec_id", p)
    queries = _hashed(all_.where(is_query), shape, query_cells, "query_id", p)
    placed = [F.pmod("at", F.lit(p.tables)).cast("int").alias("table"), F.floor(F.col("at") / p.tables).alias("cell")]

    spread = points.select("vec_id", "vector", F.explode("cells").alias("at")).select("vec_id", "vector", *placed)
    # Cells of more vectors than a task should hold, split so that each part has few enough.
    crowded = session.settle(
        spread.groupBy("table", "cell").agg(F.count("*").alias("n")).where(F.col("n") > p.group)
        .select("table", "cell", F.ceil(F.col("n") / p.group).cast("int").alias("splits"), F.ceil(F.col("n") / (p.group * 20)).cast("int").alias("turns")), "crowded-cells"
    )
    hot = common.sized(crowded)
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    group = F.when(F.col("splits").isNull(), F.pmod("cell", F.lit(groups))).otherwise(F.col("cell") + groups).alias("part")
    spread = spread.join(hot, ["table", "cell"], "left").select(
        "table", group, F.pmod(F.xxhash64("vec_id"), one("splits")).cast("int").alias("split"), F.explode(F.sequence(F.lit(0), one("turns") - 1)).alias("turn"), "cell", "vec_id", "vector"
    )
    looks = queries.select("query_id", F.explode("cells").alias("at")).select("query_id", *placed)
    looks = looks.join(hot, ["table", "cell"], "left").select(
        "table", group, F.explode(F.sequence(F.lit(0), one("splits") - 1)).alias("split"), F.pmod(F.xxhash64("query_id"), one("turns")).cast("int").alias("turn"), "cell", "query_id"
    )
    place = ["table", "part", "split", "turn"]
    # At most as many cells as the probes of all bands stand in each of these sets.
    looks = looks.groupBy(*place, "query_id").agg(F.collect_set("cell").alias("cells")).join(queries.select("query_id", "vector"), "query_id")

    def ranked(near, asked):
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        if not len(near) or not len(asked):
            return none
        ids, cell = near["vec_id"].to_numpy(), near["cell"].to_numpy()
        x = np.frombuffer(b"".join(near["vector"]), np.float64).reshape(len(near), -1)
        q = np.frombuffer(b"".join(asked["vector"]), np.float64).reshape(len(asked), -1)
        q_ids = asked["query_id"].to_numpy()
        counts = [len(c) for c in asked["cells"]]
        who, where = np.repeat(np.arange(len(asked)), counts), np.concatenate(list(asked["cells"]))
        found = [([], []) for _ in range(len(asked))]
        for c in np.unique(where):
            here, rows = np.flatnonzero(cell == c), who[where == c]
            if not len(here):
                continue
            own = x[here]
            step = max(1, 2_000_000 // len(here))
            for low in range(0, len(rows), step):
                some = rows[low : low + step]
                rough = q[some] @ own.T
                k = min(p.top + 1, len(here))
                least = np.partition(rough, len(here) - k, axis=1)[:, len(here) - k]
                for r, values, limit in zip(some, rough, least):
                    # All that may be among the best; their exact scores decide.
                    close = np.flatnonzero(values >= limit - 1e-9 * (1 + abs(limit)))
                    close = close[ids[here[close]] != q_ids[r]]
                    exact = np.einsum("ij,j->i", own[close], q[r])
                    keep = _best(ids[here[close]], exact, p.top)
                    found[r][0].append(ids[here[close[keep]]])
                    found[r][1].append(exact[keep])
        rows = []
        for r, (i, s) in enumerate(found):
            if i:
                i, s = np.concatenate(i), np.concatenate(s)
                keep = _best(i, s, p.top)
                rows.append(pd.DataFrame({"query_id": q_ids[r], "vec_id": i[keep], "score": s[keep]}))
        return pd.concat(rows) if rows else none

    pairs = spread.groupBy(*place).cogroup(looks.groupBy(*place)).applyInPandas(ranked, "query_id long, vec_id long, score double")
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.top).select("query_id", "rank", "vec_id", "score")
