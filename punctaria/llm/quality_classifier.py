"""Supervised quality score from hashed subword embeddings.

Character n-grams inside words (white space marks a word's ends), words and pairs of neighbouring words, which are word n-grams, are hashed into the
``BUCKETS`` rows of one table of vectors. A document is the mean of the vectors of each of the three kinds, weighted by ``SHARES``; a softmax layer over that
gives its class. Vectors and layer are learned together by stochastic gradient descent in numpy, with a step size of each row that falls with the gradients it
has seen, on a bounded sample: at most ``MAX_TRAIN`` labelled documents, those with the smallest id hashes. Scoring covers every whole text: as
the layer is linear, each row folds into one number, and a document's score is a sum of three means of these.

Defined results: a null, empty or featureless text has the score of an empty mean, which is the layer's bias alone; a kind without features leaves its
share to the others; without labelled rows, or with one class only, every score is the share of class 1 (0.5 without rows); rows with null labels are not
learned from; repeated rows score alike; labels of repeated ids count once, the largest, with the smallest of their texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, small_batches, tidy

MAX_TRAIN, MAX_TRAIN_BYTES = 8000, 100_000
DIM, BUCKETS, GRAMS, EPOCHS, RATE = 12, 1 << 18, (3, 4, 5), 4, 0.3
THRESHOLD = 0.3
#: Weights of the means of character n-grams, words and word pairs.
SHARES = (0.2, 0.2, 0.6)
_ODD = np.uint32(0x9E3779B1)
_PIECE = 1 << 18


def _points(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a text between two spaces, and which are white."""
    cp = np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, (cp == 32) | ((cp >= 9) & (cp <= 13))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _ODD
    return h ^ (h >> np.uint32(15))


def character_grams(text: str) -> np.ndarray:
    """Bucket of each character n-gram of a whole text, repeats included."""
    cp, _ = _points(text)
    out = [np.empty(0, np.uint32)]
    for at in range(0, max(1, len(cp) - 1), _PIECE):  # pieces overlap by the longest n-gram
        piece = cp[at : at + _PIECE + max(GRAMS) - 1]
        white = (piece == 32) | ((piece >= 9) & (piece <= 13))
        before = np.concatenate([[0], np.cumsum(white)])
        h = np.full(len(piece), 0x811C9DC5, np.uint32)
        for n in range(1, max(GRAMS) + 1):
            m = len(piece) - n + 1
            if m <= 0:
                break
            h = _mixed(h[:m] ^ piece[n - 1 :])
            if n in GRAMS:
                own = min(m, _PIECE)
                inner = before[n - 1 : n - 1 + own] - before[1 : 1 + own]
                out.append(h[:own][inner == 0] % np.uint32(BUCKETS))
    return np.concatenate(out)


def word_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each lower-case word, and of each pair of neighbouring words, of a whole text."""
    cp, white = _points(text.lower())
    edge = np.flatnonzero(white)
    lo, hi = edge[:-1] + 1, edge[1:]
    lo, hi = lo[hi > lo], hi[hi > lo]
    # Sums of mixed characters with place weights within the word.
    mixed = (cp * _ODD) ^ (cp >> np.uint32(7))
    place = (np.arange(len(cp), dtype=np.uint32) - np.repeat(np.concatenate([[0], edge]), np.diff(np.concatenate([[0], edge, [len(cp)]]))).astype(np.uint32)) * np.uint32(2) + np.uint32(1)
    sums = np.concatenate([np.zeros(1, np.uint32), np.cumsum(mixed * place * place, dtype=np.uint32)])
    w = _mixed((sums[hi] - sums[lo]) ^ np.uint32(0x5BD1E995))
    pairs = _mixed((w[:-1] * np.uint32(0x85EBCA6B)) ^ w[1:])
    return w % np.uint32(BUCKETS), pairs % np.uint32(BUCKETS)


def features(text: str) -> tuple[np.ndarray, ...]:
    """Buckets by kind, as ``SHARES`` lists them."""
    return character_grams(text), *word_grams(text)


def weighted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares) of a text's features: shares add up to 1, or are none."""
    kinds = [(f, s) for f, s in zip(features(text), SHARES, strict=True) if len(f)]
    if not kinds:
        return np.empty(0, np.uint32), np.empty(0, np.float32)
    ids, place = np.unique(np.concatenate([f for f, _ in kinds]), return_inverse=True)
    share = np.bincount(place, np.concatenate([np.full(len(f), s / len(f)) for f, s in kinds]))
    return ids, (share / share.sum()).astype(np.float32)


def fit(texts: list[str], labels: list[int], seed: int = 11) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias): the log odds of class 1 are the weighted means of a document's features plus the bias."""
    y = np.array(labels, dtype=int)
    if len(set(labels)) < 2:
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return np.zeros(BUCKETS), float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    docs = [weighted(t) for t in texts]
    table = rng.uniform(-0.05 / DIM, 0.05 / DIM, (BUCKETS, DIM))
    layer, bias = rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
    seen, seen_layer, seen_bias = np.full(BUCKETS, 1e-8), np.full((DIM, 2), 1e-8), 1e-8
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            ids, share = docs[i]
            mean = share @ table[ids]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1.0  # the loss's gradient by z
            back, step = layer @ p, np.outer(mean, p)
            seen_bias += p[0] ** 2
            bias = bias - 0.3 * RATE * p / np.sqrt(seen_bias)
            seen_layer += step * step
            layer -= RATE * step / np.sqrt(seen_layer)
            # The gradient by a row is its share of the gradient by the mean.
            seen[ids] += share * share * (back @ back / DIM)
            table[ids] -= RATE * np.outer(share / np.sqrt(seen[ids]), back)
    weight = table @ (layer[:, 1] - layer[:, 0])
    return weight, float(bias[1] - bias[0])


def log_odds(text: str, weight: np.ndarray, bias: float) -> float:
    kinds = [(f, s) for f, s in zip(features(text), SHARES, strict=True) if len(f)]
    return bias + sum(s * float(weight[f].mean(dtype=np.float64)) for f, s in kinds) / sum(s for _, s in kinds) if kinds else bias


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, float]:
    """Fit on the bounded sample of labelled rows for which ``learn`` holds."""
    small_batches(docs.sparkSession)
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).filter(learn)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # At most max_train ids and texts of MAX_TRAIN_BYTES each: longer documents are scored, not learned from.
    few = docs.select("doc_id", "text").filter(F.octet_length("text") <= MAX_TRAIN_BYTES).join(F.broadcast(chosen), "doc_id")
    sample = few.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).toPandas().sort_values("doc_id")
    return fit(sample["text"].tolist(), sample["y"].tolist())


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, score) of each row: the probability of class 1."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        weight, bias = held.value
        for batch in batches:
            z = [log_odds(t.as_py() or "", weight, bias) for t in batch.column(1)]
            p = 1 / (1 + np.exp(-np.clip(np.array(z), -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, score double")


FOLDS, HELD_OUT = 5, 0


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    model = train(docs, labels, "quality", ~held_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
