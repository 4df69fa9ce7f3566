"""Hard-negative mining with angles to reference directions.

Every row stores its norm and its angles to a few reference directions. The angle between two
rows is at least the difference and at most the sum of their angles to any one direction
(the triangle inequality on the sphere), which gives an interval of cosines and, times the
norms, of scores. Only rows whose interval meets a window of wanted scores are scored, in
integers. Each anchor first takes its positives, then the negatives within their windows.
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
    """positives, negatives: of an anchor, and of each of its positives. low, high: a negative's
    score lies between so many hundredths of the positive's. scale: components become
    floor(scale * x). directions: reference directions, chosen from the ``sample`` rows with
    the smallest hashes; they steer how much is scored, never what is found. block, turn: rows
    and anchors that a task holds. step: rows scored at once at first, then twice as many."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256
    directions: int = 16
    sample: int = 512
    block: int = 10_000
    turn: int = 10_000
    step: int = 256


def directions(rows: DataFrame, p: Params) -> np.ndarray:
    """Unit vectors far from one another: the first of the sample, then always the one whose
    nearest chosen direction is farthest. Of the commonest width in the sample."""
    some = rows.where(F.exists("x", lambda v: v != 0)).select(F.xxhash64(F.lit(12), "vec_id").alias("h"), "vec_id", "x").orderBy("h", "vec_id", "x").limit(p.sample)
    found = [np.asarray(r["x"], np.float64) for r in some.collect()]
    if not found:
        return np.zeros((0, 0))
    widths = [len(v) for v in found]
    width = max(sorted(set(widths)), key=widths.count)
    x = np.array([v / np.abs(v).max() for v in found if len(v) == width])
    x /= np.sqrt((x**2).sum(1, keepdims=True))
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(p.directions, len(x)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


def _with_angles(rows: DataFrame, refs: np.ndarray) -> DataFrame:
    """``rows`` with ``norm`` and ``angles``; those of another width than the directions' have
    no angles, and those of length 0 right ones, as all their scores are 0."""

    def run(batches):
        for batch in batches:
            norms, angles = [], []
            for v in batch["x"]:
                v = np.asarray(v, np.float64)
                norm = float(np.linalg.norm(v))
                norms.append(norm)
                if len(v) != refs.shape[1] or not np.isfinite(norm):
                    angles.append(np.zeros(0))
                else:
                    angles.append(np.arccos(np.clip(refs @ v / norm, -1, 1)) if norm else np.full(len(refs), np.pi / 2))
            yield batch.assign(norm=norms, angles=angles)

    return rows.mapInPandas(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, norm double, angles array<double>")


class Block:
    """Rows of a block with what was stored of them."""

    def __init__(self, rows: pd.DataFrame):
        self.ids, self.labels = rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
        self.x, self.norms = blocks.matrix(rows["x"]), rows["norm"].to_numpy(np.float64)
        self.angles = blocks.matrix(rows["angles"])
        self.repeats = len(np.unique(self.ids)) < len(self.ids)

    def bounds(self, norm: float, angles: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """No score of ``rows`` with a vector of these angles lies outside; wider than any
        rounding of angles (1e-7, as a cosine near 1 has no better angle) and products."""
        both = self.norms[rows] * norm
        if not len(angles) or not np.isfinite(both).all():
            return np.full(len(rows), -np.inf), np.full(len(rows), np.inf)
        own = self.angles[rows]
        least = np.abs(own - angles).max(1) - 1e-7
        total = own + angles
        most = np.minimum(total, 2 * np.pi - total).min(1) + 1e-7
        slack = both * 1e-9 + 1e-6
        return both * np.cos(np.minimum(most, np.pi)) - slack, both * np.cos(np.maximum(least, 0)) + slack

    def best(self, rows: np.ndarray, x: np.ndarray, norm: float, angles: np.ndarray, windows: list[tuple[float, float]], top: int, step: int):
        """For each window of scores the ``top`` highest of ``rows`` within it, as places and
        scores; and how many rows were scored."""
        low, high = self.bounds(norm, angles, rows)
        meets = np.zeros(len(rows), bool)
        for least, most in windows:
            meets |= (high >= least) & (low <= most)
        order = np.flatnonzero(meets)
        order = order[np.argsort(-high[order], kind="stable")]
        kept = [(np.zeros(0, np.int64), np.zeros(0)) for _ in windows]
        at = 0
        while at < len(order):
            # A row yet to come must reach the last kept one of some window, or its lower end.
            wanted = min(found[-1] if len(found) == top else least for (least, _), (_, found) in zip(windows, kept))
            if high[order[at]] < wanted:
                break
            some = rows[order[at : at + step]]
            at, step = at + step, 2 * step
            score = blocks.scores(self.x[some], x)
            for k, (least, most) in enumerate(windows):
                inside = np.array((score >= least) & (score <= most), bool)
                if inside.any():
                    places, found = np.concatenate([kept[k][0], some[inside]]), np.concatenate([kept[k][1], score[inside]])
                    first = blocks.first(self.ids[places], found, top, self.repeats)
                    kept[k] = places[first], found[first]
        return kept, min(at, len(order))


POSITIVE = "query_id long, positive_id long, score long, scored long"
NEGATIVE = "query_id long, positive_id long, positive_score long, negative_id long, score long, scored long"


def _positives(p: Params):
    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        block, out = Block(rows), []
        for a in asked.itertuples():
            same = np.flatnonzero((block.labels == a.own_label) & (block.ids != a.query_id))
            [(places, score)], scored = block.best(same, np.asarray(a.own_x), a.own_norm, np.asarray(a.own_angles), [(-np.inf, np.inf)], p.positives, p.step)
            out.append(pd.DataFrame({"query_id": a.query_id, "positive_id": block.ids[places], "score": blocks.long(score), "scored": scored}))
        return pd.concat(out)

    return run


def _negatives(p: Params):
    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        block, out = Block(rows), []
        for a in asked.itertuples():
            other = np.flatnonzero((block.labels != a.own_label) & (block.ids != a.query_id))
            # Whole scores between the hundredths: the least and the greatest.
            windows = [(-((-p.low * int(s)) // 100), (p.high * int(s)) // 100) for s in a.positive_scores]
            kept, scored = block.best(other, np.asarray(a.own_x), a.own_norm, np.asarray(a.own_angles), windows, p.negatives, p.step)
            for positive, own, (places, score) in zip(a.positive_ids, a.positive_scores, kept):
                out.append(pd.DataFrame({
                    "query_id": a.query_id, "positive_id": positive, "positive_score": own, "negative_id": block.ids[places], "score": blocks.long(score), "scored": scored,
                }))
        return pd.concat(out)

    return run


def _ranked(found: DataFrame, by: list[str], other: str, top: int) -> DataFrame:
    best = found.groupBy(*by, other).agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), other))).where(F.col("rank") <= top)


def mine(vectors: DataFrame, is_anchor: Column, p: Params = Params()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, embedding and label (a whole number); other columns are read by
    ``is_anchor`` alone. An anchor's positives are its first rows of the same label, their
    negatives the first rows of other labels with positive_score * low <= 100 *
    negative_score <= positive_score * high, both by highest score, ties by smaller vec_id.
    rank counts the negatives of each anchor and positive from 1; a positive without any
    gives no row. Rows without an id, vector or label, or with a component that is null or
    not finite (also times ``scale``), take no part. A row of the anchor's own id is neither;
    an anchor id that stands in several rows is mined with each, and of equal pairs the best
    score counts. Vectors meet those of their own width only. Scores beyond a long come out
    as the nearest long.
    """
    rows = blocks.scaled(vectors.where(F.col("label").isNotNull()), p.scale, label=F.col("label").cast("long"), asks=F.coalesce(is_anchor, F.lit(False)))
    rows = session.settle(rows, "labelled-vectors")
    points, n = blocks.dealt(_with_angles(rows, directions(rows, p)), p.block, "stored-angles")
    null = F.lit(None).cast("int")
    anchors = points.where("asks").select(F.col("vec_id").alias("query_id"), *[F.col(c).alias(f"own_{c}") for c in ("width", "x", "label", "norm", "angles")], null.alias("home"), null.alias("away"))
    points = points.select("width", "block", "vec_id", "x", "label", "norm", "angles")
    positives = session.settle(_ranked(blocks.met(points, anchors, n, p.turn, _positives(p), POSITIVE), ["query_id"], "positive_id", p.positives), "positives")
    # As many as ``positives`` in each of these arrays.
    wanted = positives.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "score"))).alias("w"))
    wanted = wanted.select("query_id", F.col("w.positive_id").alias("positive_ids"), F.col("w.score").alias("positive_scores"))
    negatives = blocks.met(points, anchors.join(wanted, "query_id"), n, p.turn, _negatives(p), NEGATIVE)
    best = _ranked(negatives, ["query_id", "positive_id", "positive_score"], "negative_id", p.negatives)
    return best.select(F.col("query_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))
