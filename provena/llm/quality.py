"""Quality scores: a Gaussian kernel over document statistics, by random Fourier features.

Random cosines of the scaled statistics stand for the kernel; every partition sums its part
of the normal equations, the sums are added up and the ridge solution is read off. The
ridge's scores are turned into probabilities by isotonic regression on rows that the ridge
has not seen. All labelled rows outside the held-out part take part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena import session
from provena.llm import common


@dataclass(frozen=True)
class Params:
    """features: random cosines. ridge: penalty per row. bins: of the ridge's scores, each
    counted exactly, on which the isotonic fit works. sums: partial sums that are left
    for the last addition, whatever the number of partitions."""

    features: int = 256
    ridge: float = 1e-4
    scale: float = 0.35
    bins: int = 2000
    sums: int = 8
    seed: int = 5


STATISTICS = (
    "log characters", "log words", "mean word length", "spread of word lengths", "share of different words",
    "share of the commonest word", "share of ASCII letters", "share of ASCII upper case", "share of digits",
    "share of symbols", "share of sentence punctuation", "share of exclamation marks", "share of bars",
    "share of bytes beyond ASCII", "share of white space", "log mean line length", "share of different lines",
    "share of short words", "share of words with a symbol", "compressibility",
)

_KIND = np.zeros((8, 256), np.float64)
for _row, _chars in enumerate((
    "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789",
    "#$%&*+/<=>@\\^_`{}~[]|", ".,;:?'\"()-", "!", "|", " \t\n\r\f\v",
)):
    _KIND[_row, [ord(c) for c in _chars]] = 1
_SYMBOLS = frozenset("#$%&*+/<=>@\\^_`{}~[]|!")


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one whole text; an empty or null text has zeros."""
    if not text:
        return np.zeros(len(STATISTICS))
    raw = text.encode("utf-8", "replace")
    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    shares = _KIND @ histogram / n
    words, lines = text.split(), text.split("\n")
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    counts: dict[str, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    count = max(len(words), 1)
    symbols = sum(c for w, c in counts.items() if not w.isalpha() and not _SYMBOLS.isdisjoint(w))
    # Deflate sees 32 KiB at a time; the whole text goes through it.
    packed = len(zlib.compress(raw, 1))
    return np.array([
        np.log1p(len(text)), np.log1p(len(words)), lengths.mean() if len(words) else 0.0, lengths.std() if len(words) else 0.0,
        len(counts) / count, max(counts.values(), default=0) / count, shares[0], shares[1], shares[2], shares[3], shares[4],
        shares[5], shares[6], histogram[128:].sum() / n, shares[7], np.log1p(n / len(lines)), len(set(lines)) / len(lines),
        (lengths <= 3).sum() / count, symbols / count, packed / n,
    ])


@dataclass(frozen=True)
class Model:
    """Scaling, random directions, ridge weights, and the calibration as a step line."""

    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def cosines(self, x: np.ndarray) -> np.ndarray:
        scaled = np.clip((x - self.mean) / self.spread, -6, 6)
        z = np.sqrt(2 / len(self.phases)) * np.cos(scaled @ self.directions + self.phases)
        return np.hstack([z, np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.zeros(len(x))
        return np.interp(self.cosines(x) @ self.weights, self.knots, self.levels)


def isotonic(x: np.ndarray, good: np.ndarray, all_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ascending ``x`` with ``good`` of ``all_`` rows each."""
    blocks: list[list[float]] = []
    for at, g, n in zip(x, good, all_):
        if n:
            blocks.append([at * n, g, n])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    b = np.array(blocks).reshape(-1, 3)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def _stats_table(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "x": [statistics(t) for t in batch["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, x array<double>")


def _summed(rows: DataFrame, part, sums: int) -> np.ndarray:
    """Add ``part(batch)`` over all batches: in each partition, then in ``sums`` groups."""

    def run(batches):
        total = None
        for batch in batches:
            if len(batch):
                now = part(batch)
                total = now if total is None else total + now
        if total is not None:
            yield pd.DataFrame({"s": [total.tobytes()]})

    def fold(batches):
        total = None
        for batch in batches:
            for s in batch["s"]:
                total = np.frombuffer(s) if total is None else total + np.frombuffer(s)
        if total is not None:
            yield pd.DataFrame({"s": [total.tobytes()]})

    first = rows.mapInPandas(run, "s binary")
    parts = first.repartition(sums).mapInPandas(fold, "s binary").collect()
    return np.sum([np.frombuffer(r["s"]) for r in parts], axis=0) if parts else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, p: Params = Params()) -> Model:
    """Learn ``labels.quality`` from rows outside the held-out part of ids.

    One more part of the ids sets the calibration; where it is empty, the ridge's own rows
    do. A repeated id has the lowest of its labels. Without labels every score is 0.
    """
    part = common.fold(F.col("doc_id"), parts)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (part != held)).groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    learn = docs.where(F.col("doc_id").isNotNull() & (part != held))
    # Only numbers meet the labels; texts stay where they are read.
    rows = session.settle(
        _stats_table(learn).join(known, "doc_id").withColumn("calibrates", common.fold(F.col("doc_id"), parts) == (held + 1) % parts), "quality-statistics"
    )
    d = len(STATISTICS)
    moments = _summed(rows, lambda b: np.concatenate([[len(b)], np.stack(b["x"]).sum(0), (np.stack(b["x"]) ** 2).sum(0)]), p.sums)
    rng = np.random.default_rng(p.seed)
    directions, phases = rng.normal(0, p.scale, (d, p.features)), rng.uniform(0, 2 * np.pi, p.features)
    none = np.zeros(0)
    if not len(moments):
        return Model(np.zeros(d), np.ones(d), directions, phases, np.zeros(p.features + 1), none, none)
    mean = moments[1 : d + 1] / moments[0]
    spread = np.sqrt(np.maximum(moments[d + 1 :] / moments[0] - mean**2, 1e-6))
    blank = Model(mean, spread, directions, phases, none, none, none)
    size = p.features + 1

    def normal(batch):
        z = blank.cosines(np.stack(batch["x"]))
        return np.concatenate([(z.T @ z).ravel(), z.T @ batch["y"].to_numpy(), [len(batch)]])

    fitted = rows.where(~F.col("calibrates"))
    sums = _summed(fitted, normal, p.sums)
    apart = len(sums) > 0
    if not apart:
        sums = _summed(rows, normal, p.sums)
    penalty = p.ridge * sums[-1] * np.eye(size)
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(sums[: size * size].reshape(size, size) + penalty, sums[size * size : -1])
    ridge = Model(mean, spread, directions, phases, weights, none, none)
    low, high = -0.5, 1.5

    def binned(batch):
        s = ridge.cosines(np.stack(batch["x"])) @ weights
        at = np.clip(((s - low) / (high - low) * p.bins).astype(int), 0, p.bins - 1)
        y = batch["y"].to_numpy()
        return np.concatenate([np.bincount(at, y, p.bins), np.bincount(at, minlength=p.bins).astype(float)])

    counts = _summed(rows.where("calibrates"), binned, p.sums) if apart else np.zeros(0)
    if not len(counts):
        counts = _summed(rows, binned, p.sums)
    centres = low + (np.arange(p.bins) + 0.5) * (high - low) / p.bins
    knots, levels = isotonic(centres, counts[: p.bins], counts[p.bins :])
    return Model(mean, spread, directions, phases, weights, knots, np.clip(levels, 0, 1))


def score(text: Column, model: Model) -> Column:
    """The calibrated quality of each whole text, 0 to 1; null texts count as empty."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.stack([statistics(t) for t in texts]) if len(texts) else np.zeros((0, len(STATISTICS)))
            yield pd.Series(model.score(x))

    return scored.asNondeterministic()(text)
