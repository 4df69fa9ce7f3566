"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; any other text is unlabelled, toxic or not. With
the class prior p, the risk of calling clean what is unlabelled, less p times the risk of
calling clean what is toxic, estimates the risk on clean texts. It can only go below zero
by overfitting; where it does, the step undoes that part instead (the non-negative rule).
Several linear classifiers over the presence of words are trained that way in numpy, each on
its own unlabelled texts, and their margins are averaged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm import common


@dataclass(frozen=True)
class Params:
    """Bounds of the training sample and of the training.

    positives, unlabelled: most texts of each kind that one classifier is fitted on, those
        with the smallest seeded hash of their id.
    members: classifiers whose margins are averaged.
    min_texts: a word must stand in so many different sampled texts to be a feature.
    prior: share of toxic texts in the corpus; None takes the share among labelled rows.
    """

    positives: int = 2500
    unlabelled: int = 6000
    members: int = 2
    min_texts: int = 4
    prior: float | None = None
    rounds: int = 250
    rate: float = 0.08
    l1: float = 2e-4
    seed: int = 11


@dataclass(frozen=True)
class Model:
    """Weights by crc32 of a word; the margin of a text without known words is ``bias``."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float


def words_of(text: str | None) -> set[str]:
    return set(common.WORD.findall(text.lower())) if text else set()


def features(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, and the sorted crc32 of its different words."""

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch["text"]:
                rows.append(np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in words_of(text)), np.int64)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "digest": batch["digest"], "words": rows})

    return docs.select("doc_id", "text", F.xxhash64("text").alias("digest")).mapInPandas(run, "doc_id long, digest long, words array<long>")


def _fit_member(pos: list[np.ndarray], unl: list[np.ndarray], vocab: np.ndarray, prior: float, p: Params) -> np.ndarray:
    """Full-batch proximal Adam on the non-negative risk, logistic loss."""

    def csr(rows):
        cols = [np.searchsorted(vocab, r[np.isin(r, vocab, assume_unique=True)]) for r in rows]
        return np.concatenate(cols).astype(np.int64) if cols else np.zeros(0, np.int64), np.repeat(np.arange(len(cols)), [len(c) for c in cols])

    d = len(vocab)
    (pc, pr), (uc, ur) = csr(pos), csr(unl)
    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    w[d] = np.log(prior / (1 - prior))
    for step in range(1, p.rounds + 1):
        mp = np.bincount(pr, w[pc], len(pos)) + w[d]
        mu = np.bincount(ur, w[uc], len(unl)) + w[d]
        sp, su = common.sigmoid(mp), common.sigmoid(mu)
        negative = np.logaddexp(0, mu).mean() - prior * np.logaddexp(0, mp).mean()
        # Derivatives by the margins: log(1 + exp(m)) for "clean", log(1 + exp(-m)) for "toxic".
        gp_pos, gp_neg, gu_neg = prior * (sp - 1) / len(pos), -prior * sp / len(pos), su / len(unl)
        gp, gu = (gp_pos + gp_neg, gu_neg) if negative >= 0 else (-gp_neg, -gu_neg)
        g = np.append(np.bincount(pc, gp[pr], d) + np.bincount(uc, gu[ur], d), gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        rate = p.rate * (1 - step / (p.rounds + 1))
        move = rate / (np.sqrt(v / (1 - 0.999**step)) + 1e-4)
        w = w - move * m / (1 - 0.9**step)
        w[:d] = np.sign(w[:d]) * np.maximum(0, np.abs(w[:d]) - move[:d] * p.l1)
    return w


def fit(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, p: Params = Params()) -> Model:
    """Learn from labelled rows outside the held-out part.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic; other columns are not read.
    Repeated ids or texts count once. Without a toxic text nothing can be learnt: every
    text then scores 0.
    """
    open_ids = lambda df: df.select("doc_id").where(F.col("doc_id").isNotNull() & (common.fold(F.col("doc_id"), parts) != held))
    known = open_ids(labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic = 1"))
    counted = labels.where(F.col("toxic").isNotNull() & (common.fold(F.col("doc_id"), parts) != held)).agg(F.avg(F.col("toxic").cast("double")).alias("prior")).first()
    prior = float(np.clip((counted["prior"] or 0.0) if p.prior is None else p.prior, 0.005, 0.5))
    pos_ids = common.smallest_ids(known, p.positives, p.seed)
    if not pos_ids:
        return Model(np.zeros(0, np.int64), np.zeros(0), -40.0, prior)
    # Unlabelled texts are any texts outside the held-out part, known toxic ones among them:
    # that is what the risk estimate assumes.
    unl_ids = common.smallest_ids(open_ids(docs), p.unlabelled * p.members, p.seed + 1)
    rows = features(common.having(docs, "doc_id", sorted({*pos_ids, *unl_ids}))).toPandas()
    rows = rows.drop_duplicates("doc_id").set_index("doc_id")
    pos = rows[rows.index.isin(pos_ids)].drop_duplicates("digest")["words"].tolist()
    if not pos:
        return Model(np.zeros(0, np.int64), np.zeros(0), -40.0, prior)
    total: dict[int, float] = {}
    bias = 0.0
    for k in range(p.members):
        unl = rows[rows.index.isin(unl_ids[k :: p.members])].drop_duplicates("digest")["words"].tolist() or pos
        keys, seen = np.unique(np.concatenate([*pos, *unl]), return_counts=True)
        vocab = keys[seen >= p.min_texts]
        w = _fit_member(pos, unl, vocab, prior, p)
        bias += w[-1] / p.members
        for key, value in zip(vocab[w[:-1] != 0].tolist(), w[:-1][w[:-1] != 0].tolist()):
            total[key] = total.get(key, 0.0) + value / p.members
    keys = np.array(sorted(total), np.int64)
    return Model(keys, np.array([total[k] for k in keys.tolist()]), float(bias), prior)


def score(text: Column, model: Model) -> Column:
    """The probability that each whole text is toxic; null texts count as empty."""
    known, bias = dict(zip(model.keys.tolist(), model.weights.tolist())), model.bias

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, float] = {}
        for texts in batches:
            if len(cache) > 400_000:
                cache.clear()
            margins = []
            for text in texts:
                total = bias
                for word in words_of(text):
                    weight = cache.get(word)
                    if weight is None:
                        weight = cache[word] = known.get(zlib.crc32(word.encode("utf-8", "replace")), 0.0)
                    total += weight
                margins.append(total)
            yield pd.Series(common.sigmoid(np.array(margins, float)))

    return scored.asNondeterministic()(text)
