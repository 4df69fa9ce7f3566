"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is lower-cased and seen as UTF-8 bytes; each run of three and of four bytes, word
ends included, is a subword and falls into a hashed bucket. The text's vector is the mean
of its buckets' embeddings; a linear softmax over it gives a probability per language. Both
layers are trained by stochastic gradient descent in numpy on a bounded sample. A
temperature and the confidence below which a text is rejected are set on texts that the
descent has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm import common

UNKNOWN = "und"


@dataclass(frozen=True)
class Params:
    """sample: most texts that the model is fitted on, a fifth of them for calibration.

    rejected: the largest share of calibration texts that the rejection threshold may turn
        away; the threshold itself is at most ``most``.
    """

    sample: int = 4000
    bits: int = 15
    width: int = 16
    epochs: int = 4
    batch: int = 16
    rate: float = 1.5
    rejected: float = 0.001
    most: float = 0.5
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """``table`` holds embedding times softmax weights for each bucket: averaging logits of
    buckets equals the logits of the averaged embedding."""

    languages: list[str] = field(default_factory=list)
    table: np.ndarray | None = None
    bias: np.ndarray | None = None
    temperature: float = 1.0
    threshold: float = 0.0
    bits: int = 15


#: Bytes of text that numpy works on at once.
PIECE = 1 << 20


def _buckets(blob: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket of each run of ``n`` bytes; runs of another length never meet in one."""
    code = blob[: len(blob) - n + 1].astype(np.uint32)
    for k in range(1, n):
        code = (code << np.uint32(8)) | blob[k : len(blob) - n + 1 + k]
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x9E3779B1)
    code = (code ^ (code >> np.uint32(13))) * np.uint32(0x85EBCA6B)
    return (code >> np.uint32(32 - bits)) + np.uint32((n - 3) << bits)


def _bytes(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").split()) + b"   "


def subwords(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text and how often each occurs."""
    blob = np.frombuffer(_bytes(text), np.uint8)
    counts = np.zeros(2 << bits, np.int64)
    for at in range(0, len(blob), PIECE):
        for n in (3, 4):
            part = blob[at : at + PIECE + n - 1]
            if len(part) >= n:
                counts += np.bincount(_buckets(part, n, bits), minlength=2 << bits)
    keys = np.flatnonzero(counts)
    return keys, counts[keys]


def _features(docs: DataFrame, bits: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [subwords(t or "", bits) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "lang": batch["lang"],
                "keys": [r[0].astype(np.int32) for r in rows], "counts": [r[1].astype(np.int32) for r in rows],
            })

    return docs.select("doc_id", "lang", "text").mapInPandas(run, "doc_id long, lang string, keys array<int>, counts array<int>")


def _descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    emb = rng.normal(0, 0.3, (2 << p.bits, p.width))
    out, bias = np.zeros((p.width, classes)), np.zeros(classes)
    shares = [(keys, counts / counts.sum()) for keys, counts in rows]
    steps, step = p.epochs * (len(rows) // p.batch + 1), 0
    for _ in range(p.epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), p.batch):
            some = order[at : at + p.batch]
            rate = p.rate * (1 - step / (steps + 1))
            step += 1
            hidden = np.stack([shares[i][1] @ emb[shares[i][0]] for i in some])
            z = hidden @ out + bias
            prob = np.exp(z - z.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            prob[np.arange(len(some)), y[some]] -= 1
            back = prob @ out.T
            out -= rate * hidden.T @ prob
            bias -= rate * 0.1 * prob.mean(0)
            for row, i in zip(back, some):
                emb[shares[i][0]] -= rate * 20 * shares[i][1][:, None] * row
    return emb @ out, bias


def fit(docs: DataFrame, parts: int = 4, held: int = 2, p: Params = Params()) -> Model:
    """Learn from text and lang of documents outside the held-out part of ids.

    Texts without a letter and rows without lang or id teach nothing; without any other
    row the model knows no language and answers ``und`` for every text.
    """
    model = _fitted(docs, parts, held, p)
    # The driver goes on without the sample and what the descent took.
    common.give_back()
    return model


def _fitted(docs: DataFrame, parts: int, held: int, p: Params) -> Model:
    learn = docs.select("doc_id", "text", "lang").where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (common.fold(F.col("doc_id"), parts) != held)
    )
    ids = common.smallest_ids(learn.select("doc_id"), p.sample, p.seed)
    chosen = common.having(learn, "doc_id", sorted(ids)).where(F.col("text").rlike(r"\p{L}"))
    rows = _features(chosen, p.bits).toPandas().drop_duplicates(["doc_id", "lang"]).sort_values(["doc_id", "lang"])
    if rows.empty:
        return Model(bits=p.bits)
    languages = sorted(set(rows["lang"]))
    y = np.array([languages.index(x) for x in rows["lang"]])
    pairs = list(zip(rows["keys"], rows["counts"]))
    calibration = np.arange(len(pairs)) % 5 == 4
    if calibration.sum() < 20:
        calibration[:] = False
    table, bias = _descend([r for r, c in zip(pairs, calibration) if not c], y[~calibration], len(languages), p)
    model = Model(languages, table.astype(np.float32), bias, 1.0, 0.0, p.bits)
    if not calibration.any():
        return model
    z = np.stack([(c / c.sum()) @ table[k] + bias for (k, c), held_back in zip(pairs, calibration) if held_back])
    truth = y[calibration]
    best, loss = 1.0, np.inf
    # Never much sharper than the softmax was trained: a clean sample would ask for certainty.
    for temperature in 2.0 ** np.arange(-1, 4.25, 0.25):
        scaled = z / temperature
        now = (np.logaddexp.reduce(scaled, axis=1) - scaled[np.arange(len(truth)), truth]).mean()
        if now < loss - 1e-6:
            best, loss = float(temperature), now
    top = np.sort(_softmax(z / best).max(1))
    return Model(languages, table.astype(np.float32), bias, best, float(min(p.most, top[int(p.rejected * len(top))])), p.bits)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _means(texts: list[str], model: Model) -> np.ndarray:
    """Mean logits of each text's subwords, a few texts or a piece of one at a time."""
    blobs = [_bytes(t) for t in texts]
    sums, seen = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    columns = [np.ascontiguousarray(model.table[:, c]) for c in range(len(model.languages))]
    at = 0
    while at < len(blobs):
        end, size = at, 0
        while end < len(blobs) and (end == at or size + len(blobs[end]) <= PIECE):
            size += len(blobs[end])
            end += 1
        joined = np.frombuffer(b"".join(blobs[at:end]), np.uint8)
        lengths = np.array([len(b) for b in blobs[at:end]])
        starts = np.cumsum(lengths) - lengths
        for n in (3, 4):
            if end - at == 1:
                for low in range(0, size - n + 1, PIECE):
                    keys = _buckets(joined[low : low + PIECE + n - 1], n, model.bits)
                    sums[at] += [col[keys].sum(dtype=np.float64) for col in columns]
                    seen[at] += len(keys)
            else:
                keys = _buckets(joined, n, model.bits)
                # Runs that begin in the last bytes of a text would reach into the next one.
                cuts = np.stack([starts, starts + lengths - n + 1], 1).ravel()
                cuts = cuts[:-1] if cuts[-1] >= len(keys) else cuts
                for c, col in enumerate(columns):
                    sums[at:end, c] += np.add.reduceat(col[keys], cuts, dtype=np.float64)[::2]
                seen[at:end] += lengths - n + 1
        at = end
    return sums / np.maximum(seen, 1)[:, None] + model.bias


def identify(text: Column, model: Model) -> Column:
    """A struct of lang, score and rejected for each whole text.

    Null, empty and letterless texts are ``und`` with score 0, and rejected.
    """

    @F.pandas_udf("lang string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lang = np.full(len(texts), UNKNOWN, object)
            score = np.zeros(len(texts))
            good = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model.languages else []
            if good:
                prob = _softmax(_means([texts.iloc[i] for i in good], model) / model.temperature)
                lang[good] = np.array(model.languages, object)[prob.argmax(1)]
                score[good] = prob.max(1)
            yield pd.DataFrame({"lang": lang, "score": score, "rejected": (lang == UNKNOWN) | (score < model.threshold)})

    return predict.asNondeterministic()(text)
