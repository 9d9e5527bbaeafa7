"""Quality classifier (operator 9): positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text train a small network by the non-negative unbiased
risk  pi * R+(f, 1) + max(0, Ru(f, 0) - pi * R+(f, 0)).  Rows labelled 0 are never used as negatives; they
are part of the unlabelled text like any other row.  The class prior pi is estimated from the two samples:
an ordinary positive-against-unlabelled model orders the texts, and pi is the smallest ratio of the share of
unlabelled to the share of positive texts above a threshold (taken where at least a tenth of the
positives lie above).

Features are shares and shapes of a text: classes of characters and of neighbouring characters, word
lengths, repetition, lines, hashed characters; whole texts, nothing but the text.

Fitting collects at most SAMPLE feature vectors of either kind (the rows with the lowest hash of their
id); everything else is one narrow pass, and texts are never shuffled.  Training is deterministic.

Edge cases: null texts count as empty; empty texts are scored like others; rows without label or with a
null label are unlabelled; without positives the score is 0.5 throughout; repeated rows count as often as
they occur; ids are hashed only to draw the sample.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of

SAMPLE = 6000
HIDDEN = 16
EPOCHS = 12
BATCH = 512
RATE = 5e-3
DECAY = 1e-3
CHAR_BUCKETS = 64


def _classes() -> np.ndarray:
    """Of a UTF-8 byte: lower, upper, digit, space, line end, sentence mark, other mark, beyond ASCII."""
    kind = np.full(256, 6, np.uint8)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 0, 1, 2, 7
    kind[[32, 9]], kind[[10, 13]], kind[[44, 46, 59, 58, 63, 39, 45]] = 3, 4, 5
    return kind


_CLASS = _classes()


def features(text: str) -> np.ndarray:
    b = np.frombuffer(text.encode(), np.uint8)
    kinds = _CLASS[b]
    n = max(1, len(b))
    shares = np.bincount(kinds, minlength=8) / n
    pairs = np.bincount(kinds[:-1].astype(np.int64) * 8 + kinds[1:], minlength=64) / n if len(b) > 1 else np.zeros(64)
    chars = np.sqrt(np.bincount((b.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(26), minlength=CHAR_BUCKETS) / n)
    words = text.split()
    m = max(1, len(words))
    often = Counter(words)
    top = [c / m for _, c in often.most_common(3)]
    lines = [x for x in text.split("\n") if x.strip()]
    # words as spans of bytes: their sizes, first and last bytes, and what they consist of
    dark = np.flatnonzero(np.diff(np.concatenate([[1], (kinds == 3) | (kinds == 4), [1]])))
    begin, end = dark[::2], dark[1::2]
    sizes = end - begin if len(begin) else np.zeros(1)
    first, last = (kinds[begin], b[end - 1]) if len(begin) else (kinds[:0], b[:0])
    lower, letters = ((np.add.reduceat(np.append(x, 0), begin) if len(begin) else np.zeros(0)) for x in (kinds == 0, (kinds < 3) | (kinds == 7)))
    again = sum(map(str.__eq__, words, words[1:])) / m
    shape = [
        np.log1p(len(b)), np.log1p(len(words)), np.log1p(len(lines)), m / max(1, len(lines)) / 50, sizes.mean() / 5, sizes.std() / 5, sizes.max() / 20,
        len(often) / m, np.log1p(len(often)) / np.log1p(m), again, np.sqrt(again), len(set(lines)) / max(1, len(lines)), *(top + [0.0] * 3)[:3],
        (first == 1).sum() / m, ((first == 1) & (lower == 0)).sum() / m, (letters == 0).sum() / m,
        ((last == 33) | (last == 46) | (last == 63)).sum() / m, float(not words),
    ]
    return np.concatenate([shares, np.sqrt(shares), pairs, chars, shape]).astype(np.float32)


WIDTH = len(features(""))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(x), 0.5)
        a, b, c, d = self.weights
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return _sigmoid(np.tanh(z @ a + b) @ c + d)


def _train(pos: np.ndarray, unl: np.ndarray, prior: float | None) -> list[np.ndarray]:
    """Adam on the non-negative PU risk; with prior None on plain positive against unlabelled."""
    rng = np.random.default_rng(7)
    w = [rng.normal(0, 1 / np.sqrt(pos.shape[1]), (pos.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(())]
    m, v, t = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    for _ in range(EPOCHS):
        rounds = max(1, len(unl) // BATCH)
        for part in np.array_split(rng.permutation(len(unl)), rounds):
            p = pos[rng.integers(0, len(pos), min(len(pos), BATCH))]
            x = np.concatenate([p, unl[part]])
            hidden = np.tanh(x @ w[0] + w[1])
            s = _sigmoid(hidden @ w[2] + w[3])
            n, k = len(p), len(part)
            # d/dz of the log losses: s - 1 for the label 1, s for the label 0
            g = np.zeros(len(x))
            if prior is None:
                g[:n], g[n:] = (s[:n] - 1) / n, s[n:] / k
            else:
                negative = -np.log(1 - s[n:] + 1e-9).mean() - prior * -np.log(1 - s[:n] + 1e-9).mean()
                if negative >= 0:
                    g[:n], g[n:] = (prior * (s[:n] - 1) - prior * s[:n]) / n, s[n:] / k
                else:  # the empirical risk fell below its bound: step back on this part
                    g[:n], g[n:] = prior * s[:n] / n, -s[n:] / k
            back = np.outer(g, w[2]) * (1 - hidden**2)
            grads = [x.T @ back + DECAY * w[0], back.sum(0), hidden.T @ g + DECAY * w[2], np.asarray(g.sum())]
            t += 1
            for i, grad in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad**2
                w[i] = w[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """pos, unl: scores of a positive-against-unlabelled model."""
    at = np.quantile(pos, np.linspace(0.005, 0.9, 60))
    ratio = [(unl >= t).mean() / max((pos >= t).mean(), 1e-9) for t in at]
    return float(np.clip(min(ratio), 0.05, 0.99))


@F.arrow_udf(T.BinaryType())
def _features(texts: pa.Array) -> pa.Array:
    return pa.array([features(t or "").tobytes() for t in texts.to_pylist()], pa.binary())


def _sampled(rows: DataFrame, among: DataFrame) -> np.ndarray:
    """Feature vectors of the SAMPLE rows of the lowest hash of those `among` (h) names; they are found on narrow rows, and only
    theirs are the texts that are read: a broadcast of at most SAMPLE hashes, no text is dealt out."""
    chosen = among.sort("h").limit(SAMPLE).distinct()
    picked = rows.join(F.broadcast(chosen), "h").select("h", "t").sort("h", "t").limit(SAMPLE)
    got = [np.frombuffer(r.f, np.float32) for r in picked.select(_features("t").alias("f")).collect()]
    return np.array(got, np.float64).reshape(-1, WIDTH)


def fit(positives: DataFrame, unlabelled: DataFrame, text: str = "text", id_: str = "doc_id") -> Model:
    """unlabelled: the rows to learn from; positives: the ids of those that are trusted (other columns are not read)."""
    rows = unlabelled.select(F.xxhash64(F.col(id_)).alias("h"), text_of(text).alias("t"))
    ids = unlabelled.select(F.col(id_).alias("i")).join(positives.select(F.col(id_).alias("i")).distinct(), "i", "left_semi")
    pos, unl = _sampled(rows, ids.select(F.xxhash64("i").alias("h"))), _sampled(rows, rows.select("h"))
    if not len(pos) or not len(unl):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), [], 1.0)
    mean, scale = unl.mean(0), unl.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (pos, unl))
    # halves: the prior is read off texts that the ordering model was not trained on
    halves = [(Model(mean, scale, _train(p[i::2], u[i::2], None), 1.0), 1 - i) for i in (0, 1) if len(p) > 1 and len(u) > 1]
    prior = float(np.mean([estimate_prior(m.score(pos[j::2]), m.score(unl[j::2])) for m, j in halves] or [0.5]))
    return Model(mean, scale, _train(p, u, prior), prior)


def score(model: Model, spark, text: Column) -> Column:
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        x = np.array([features(t or "") for t in texts.to_pylist()], np.float64).reshape(-1, WIDTH)
        return pa.array(sent.value.score(x), pa.float64())

    return scored(F.coalesce(text.cast("string"), F.lit("")))
