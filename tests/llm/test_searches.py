"""Exact top-k and hard negatives against brute force in Python's integers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from provena.llm import common, hardneg, topk
from tests.llm.cases import clashing, frame


@pytest.fixture(autouse=True)
def prepared(spark):
    common.prepare(spark)


def whole(rows, scale):
    """Rows that take part, with their components as integers."""
    return [(r[0], [math.floor(scale * float(np.float32(c))) for c in r[1]], *r[2:]) for r in rows if r[0] is not None and r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def best(pairs, top):
    found = {}
    for i, s in pairs:
        found[i] = max(s, found.get(i, s))
    return sorted(found.items(), key=lambda p: (-p[1], p[0]))[:top]


def plain_topk(rows, asks, top, scale):
    rows, out = whole(rows, scale), {}
    for i, x in rows:
        if asks(i):
            out.setdefault(i, []).extend((j, dot(x, y)) for j, y in rows if j != i and len(y) == len(x))
    return {(i, k, j, s) for i, pairs in out.items() for k, (j, s) in enumerate(best(pairs, top), 1)}


def plain_mine(rows, asks, p):
    rows, out = whole([r for r in rows if r[2] is not None], p.scale), set()
    for i, x, label in rows:
        if asks(i):
            others = [(j, dot(x, y), own) for j, y, own in rows if j != i]
            for positive, s in best([(j, t) for j, t, own in others if own == label], p.positives):
                negatives = best([(j, t) for j, t, own in others if own != label and p.low * s <= 100 * t <= p.high * s], p.negatives)
                out |= {(i, positive, k, j, s, t) for k, (j, t) in enumerate(negatives, 1)}
    return out


def clustered(seed, n, width):
    """Groups of copies of many sizes, ties, repeated vectors, and some far from all."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    x = centres[rng.integers(0, 12, n)] + rng.choice([0.0, 0.05, 0.8], (n, 1)) * rng.normal(size=(n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[: n // 3] = x[0]
    x[n // 2 : n // 2 + 20] *= rng.uniform(0, 3, (20, 1))
    x[n // 2] = 0
    return [[float(v) for v in row] for row in x.astype(np.float32)]


@pytest.mark.parametrize("block, turn, scale", [(10_000, 10_000, 1024), (90, 7, 1024), (150, 4, 3)])
def test_topk_is_exact(spark, block, turn, scale):
    rows = list(enumerate(clustered(1, 700, 24)))
    df = frame(spark, rows, "vec_id long, embedding array<float>").repartition(5)
    got = topk.search(df, F.col("vec_id") % 25 == 0, topk.Params(block=block, turn=turn, scale=scale, step=4))
    assert {tuple(r) for r in got.collect()} == plain_topk(rows, lambda i: i % 25 == 0, 10, scale)


def test_topk_stops_before_the_end(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(400, 64))
    x = np.repeat(centres / np.linalg.norm(centres, axis=1, keepdims=True), 20, axis=0) + 0.005 * rng.normal(size=(8000, 64))
    df = frame(spark, [(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    found = topk.found(df, F.col("vec_id") % 400 == 0, topk.Params(block=2500))
    row = found.groupBy("query_id").agg(F.max("scored").alias("scored")).agg(F.avg("scored").alias("mean")).first()
    assert row["mean"] < 2500 / 2


def odd(spark, extra):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [0.5, 0.5]), (7, [0.6, 0.0]), (8, [1.0, 0.0, 0.0]), (9, []), (11, []),
        (0, [1.0, 0.0]), (0, [0.0, 1.0]), ((1 << 53) + 1, [0.9, 0.0]), (12, [1e30, 0.0]), (13, [-1e30, 1.0]), (10, [3e38, 3e38]),
    ]
    return [(*r, *extra(k)) for k, r in enumerate(rows)]


def test_topk_odd_rows(spark):
    rows = odd(spark, lambda k: ())
    asks = lambda i: i in (0, 9, 8, 11)
    for block in (10_000, 3):
        got = topk.search(clashing(frame(spark, rows, "vec_id long, embedding array<float>")), F.col("vec_id").isin(0, 9, 8, 11), topk.Params(block=block))
        clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
        want = {(i, j): clip(s) for i, _, j, s in plain_topk(rows, asks, 100, 1024)}
        assert {(r["query_id"], r["vec_id"]): r["score"] for r in got.collect()} == {k: want[k] for k in want if k[0] != 0 or k[1] != -1}
    assert topk.search(frame(spark, rows[:1], "vec_id long, embedding array<float>"), F.col("vec_id") == 0).count() == 0
    assert topk.search(frame(spark, [], "vec_id long, embedding array<float>"), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("block, scale, sample", [(10_000, 256, 512), (110, 256, 512), (200, 4, 3)])
def test_negatives_are_exact(spark, block, scale, sample):
    vectors = clustered(2, 600, 16)
    rows = [(i, v, (i * i) % 3 if i % 11 else None) for i, v in enumerate(vectors)]
    p = hardneg.Params(block=block, turn=9, scale=scale, sample=sample, step=16)
    df = clashing(frame(spark, rows, "vec_id long, embedding array<float>, label int")).repartition(4)
    got = hardneg.mine(df, F.col("vec_id") % 20 == 0, p).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert {tuple(r) for r in got.collect()} == plain_mine(rows, lambda i: i % 20 == 0, p)


def test_score_bounds_hold():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(300, 8)))
    x[:100] = x[0] * rng.integers(1, 9, (100, 1))  # parallel: angles of nothing
    refs = x[::40] / np.linalg.norm(x[::40], axis=1, keepdims=True)
    norms = np.linalg.norm(x, axis=1)
    angles = np.arccos(np.clip(x @ refs.T / norms[:, None], -1, 1))
    block = hardneg.Block(__import__("pandas").DataFrame({"vec_id": range(300), "label": 0, "x": list(x), "norm": norms, "angles": list(angles)}))
    tight = 0
    for i in range(0, 300, 7):
        low, high = block.bounds(norms[i], angles[i], np.arange(300))
        true = x @ x[i]
        assert (low <= true).all() and (true <= high).all()
        tight += ((high - low) < 0.5 * norms * norms[i]).sum()
    assert tight


def test_negatives_odd_rows(spark):
    rows = odd(spark, lambda k: (None if k == 1 else k % 2,))
    rows = [r for r in rows if r[0] not in (10, 12, 13)] + [(20 + k, [0.1 * k, 0.2], k % 2) for k in range(6)]
    p = hardneg.Params()
    got = hardneg.mine(clashing(frame(spark, rows, "vec_id long, embedding array<float>, label int")), F.col("vec_id").isin(20, 23, 8))
    assert {tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()} == {
        t for t in plain_mine([r for r in rows if r[1] is not None and len(r[1]) == 2], lambda i: i in (20, 23), p)
    }
    assert hardneg.mine(frame(spark, [], "vec_id long, embedding array<float>, label int"), F.col("vec_id") == 0).count() == 0
