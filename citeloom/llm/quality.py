"""Quality classifier: naive Bayes support vectors (Wang and Manning 2012).

Indicators of character n-grams and of neighbouring words are scaled by the log-count ratio of the two classes, and a linear
hinge-loss model is fitted to them by dual coordinate descent (Hsieh et al. 2008). Margins become probabilities by
a logistic curve fitted to out-of-fold margins. The model is a weight for every bucket, so scoring a text is a sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm import common, features

#: Documented bound of the labelled sample that the model is fitted on, rows of each class.
PER_CLASS = 2_500
BITS, LONGEST, WORDS, SHAPES = 17, 4, 2, 4
#: Buckets of characters, of words, and of the shapes of neighbouring words.
SIZE = (2 << BITS) + 4096
#: Numbers of a log-count ratio are smoothed by this.
ALPHA = 1.0


def buckets(text: str | None) -> np.ndarray:
    """Buckets of the n-grams of a whole text: of its characters, its words, and its words' shapes.

    A shape says whether a word repeats the one before it, whether it is in capitals, and what it ends with.
    """
    if not text:
        return np.empty(0, dtype=np.int64)
    chars = features.gram_buckets(features.codes(text), LONGEST, BITS)
    split = text.split()
    words = np.array([hash_word(w) for w in split], dtype=np.uint64)
    shape = words >> np.uint64(60)
    shape[1:] |= np.where(words[1:] << np.uint64(4) == words[:-1] << np.uint64(4), np.uint64(16), np.uint64(0))
    pairs = features.gram_buckets(words, WORDS, BITS) + (1 << BITS)
    return np.concatenate([chars, pairs, features.gram_buckets(shape, SHAPES, 12) + (2 << BITS)])


_words: dict[str, int] = {}


def hash_word(word: str) -> int:
    """A hash of the word below four bits of its shape; the same in every process, unlike ``hash``."""
    found = _words.get(word)
    if found is None:
        if len(_words) > 300_000:
            _words.clear()
        shape = (len(word) > 1 and word.isupper()) | (word.islower() << 1) | ((not word[-1].isalnum() and word[-1] not in ".,;:?") << 2) | ((not any(c.isalnum() for c in word)) << 3)
        found = _words[word] = shape << 60 | xxhash.xxh64_intdigest(word.lower()) >> 4
    return found


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, text: str | None) -> float:
        found = buckets(text)
        margin = self.bias + (self.weights[found].sum() / np.sqrt(len(found)) if len(found) else 0.0)
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -30.0, 30.0))))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    pos, neg = np.full(size, ALPHA), np.full(size, ALPHA)
    for r, label in zip(rows, y, strict=True):
        (pos if label > 0 else neg)[r] += 1
    return np.log(pos / pos.sum()) - np.log(neg / neg.sum())


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 3) -> tuple[np.ndarray, float]:
    """L2-regularised L1-hinge loss; each row is its scaled indicators over the root of their number, and a bias of 1."""
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    share = np.bincount((y > 0).astype(int), minlength=2) / len(y)
    bound = cost * 0.5 / np.maximum(share[(y > 0).astype(int)], 1e-9)  # the rarer class weighs as much as the other
    values = [ratio[r] / np.sqrt(max(len(r), 1)) for r in rows]
    norm = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            grad = y[i] * (w[rows[i]] @ values[i] + bias) - 1.0
            new = min(max(alpha[i] - grad / norm[i], 0.0), bound[i])
            step = (new - alpha[i]) * y[i]
            if step:
                most = max(most, abs(step))
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
        if most < 1e-3:
            break
    return w * ratio, bias


def _margins(rows: list[np.ndarray], w: np.ndarray, bias: float) -> np.ndarray:
    return np.array([bias + (w[r].sum() / np.sqrt(len(r)) if len(r) else 0.0) for r in rows])


def logistic(margin: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and shift of the logistic curve of largest likelihood (Newton steps with a small ridge; Platt's targets)."""
    n_pos, n_neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2))
    x, theta = np.column_stack([margin, np.ones(len(margin))]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (p - target) + 1e-3 * theta
        theta = theta - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
    return float(theta[0]), float(theta[1])


def fit(texts: list[str | None], labels: list[int]) -> Model:
    """Fit to labels 0 and 1. With one class only the model always says that class; with none it says 0.5."""
    size, y = SIZE, np.where(np.asarray(labels, dtype=float) > 0, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(size), 0.0, 0.0, 0.0 if not len(y) else 6.0 * float(y[0]))
    rows = [buckets(t) for t in texts]
    fold = np.arange(len(rows)) % 3
    out = np.zeros(len(rows))
    for k in range(3):
        own, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        if len(set(y[rest].tolist())) < 2:
            continue
        part = [rows[i] for i in rest]
        w, bias = dual_descent(part, y[rest], log_count_ratio(part, y[rest], size))
        out[own] = _margins([rows[i] for i in own], w, bias)
    slope, shift = logistic(out, y)
    w, bias = dual_descent(rows, y, log_count_ratio(rows, y, size))
    return Model(w.astype(np.float32), bias, slope, shift)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", per_class: int = PER_CLASS) -> Model:
    """Fit to a sample of the labelled rows, ``per_class`` rows of each class at most; null labels are ignored."""
    rows = labels.where(F.col(label).isin(0, 1)).select(F.col(key), F.col(label).cast("int").alias("_y"))
    picked = common.class_sample(rows, "_y", per_class, key)
    sample = common.join_small(docs.select(F.col(key), F.col(text).alias("_t")), picked, [key])
    # a repeated id may bring more rows than were picked, so the bound is set here as well
    found = sample.orderBy(F.xxhash64(key), key, "_t").limit(2 * per_class).collect()
    return fit([r["_t"] for r in found], [r["_y"] for r in found])


def score_texts(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability of label 1 for every whole text; null and empty texts get that of a text without n-grams.

    An existing column ``out`` is replaced. The weights (4 MB) are broadcast; nothing is shuffled.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            yield pd.Series([m.score(t) for t in texts], dtype="float64")

    kept = [F.col(f"`{c}`") for c in df.columns if c != out]
    return df.select(*kept, run(F.col(f"`{text}`")).alias(out))
