"""Language identification by string kernels.

A text is the set of its character n-grams of several lengths (a blended spectrum, presence only); the kernel of two
texts is the number of n-grams they share over the root of the product of their numbers. Nyström landmarks turn the
kernel into features (Williams and Seeger 2001), and one ridge regression per language is fitted to them. A batch is
scored by matrix products: its presence matrix with the landmarks' one gives kernels, which meet the coefficients.
As both products are linear, the second one is carried out once, at fitting.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm import common, features

#: Documented bounds of the labelled sample, rows of each language, and of the landmarks among them.
PER_CLASS, LANDMARKS = 1_000, 256
BITS, LONGEST, RIDGE = 15, 4, 1e-2
UNKNOWN = "und"


def presence(text: str) -> np.ndarray:
    return features.gram_buckets(features.codes(text.lower()), LONGEST, BITS)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


@dataclass
class Model:
    langs: list[str]
    folded: np.ndarray  # buckets x languages: landmark presences times their coefficients
    bias: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The best language and the share of it in the softmax of the scores; ``und`` and 0 without any letter."""
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if has_letter(t)]
        if not at or not self.langs:
            return langs, scores
        rows = [presence(texts[i]) for i in at]
        starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]])
        # the product of the sparse presence matrix with the folded one, row sums over the buckets that are present
        z = np.add.reduceat(self.folded[np.concatenate(rows)], starts, axis=0) / np.sqrt([[len(r)] for r in rows]) + self.bias
        p = np.exp(4.0 * (z - z.max(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        for i, k, row in zip(at, z.argmax(axis=1), p, strict=True):
            langs[i], scores[i] = self.langs[k], float(row[k])
        return langs, scores


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit to labelled texts; texts without a letter are left out. Without any text there is no language to predict."""
    pairs = [(presence(t), lang) for t, lang in zip(texts, langs, strict=True) if has_letter(t) and lang]
    names = sorted({lang for _, lang in pairs})
    if not names:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0))

    def matrix(rows: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(rows), 1 << BITS), dtype=np.float32)
        for i, r in enumerate(rows):
            x[i, r] = 1.0 / np.sqrt(len(r))
        return x

    y = np.array([[1.0 if lang == n else -1.0 for n in names] for _, lang in pairs])
    each = max(1, landmarks // len(names))
    picked = np.concatenate([[i for i, (_, lang) in enumerate(pairs) if lang == n][:each] for n in names]).astype(int)
    z = matrix([pairs[i][0] for i in picked])
    kernel = np.concatenate([matrix([r for r, _ in pairs[i : i + 256]]) @ z.T for i in range(0, len(pairs), 256)]).astype(np.float64)
    vals, vecs = np.linalg.eigh((z @ z.T).astype(np.float64))
    good = vals > 1e-6 * vals.max()
    root = vecs[:, good] / np.sqrt(vals[good])
    phi = np.column_stack([kernel @ root, np.ones(len(pairs))])
    weight = len(pairs) / (len(names) * np.array([sum(lang == n for _, lang in pairs) for n in names]))
    row_weight = np.array([weight[names.index(lang)] for _, lang in pairs])[:, None]  # rare languages weigh as much as others
    reg = ridge * len(pairs) * np.eye(phi.shape[1])
    reg[-1, -1] = 1e-9
    coef = np.linalg.solve(phi.T @ (phi * row_weight) + reg, phi.T @ (y * row_weight))
    return Model(names, z.T.astype(np.float64) @ (root @ coef[:-1]), coef[-1])


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_class: int = PER_CLASS) -> Model:
    """Fit to a sample of the rows with a language, ``per_class`` rows of each at most."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.col(lang).alias("_l"), F.col(text).alias("_t"))
    counted = rows.select("_k", "_l")
    n_langs = max(1, counted.select("_l").distinct().count())
    found = common.class_sample(rows, "_l", per_class, "_k").orderBy(F.xxhash64("_k"), "_k", "_t").limit(2 * per_class * n_langs).collect()
    return fit([r["_t"] for r in found], [r["_l"] for r in found])


def identify(df: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language and its score for every whole text; nothing is shuffled.

    Null texts and texts without a letter get ``und`` and 0. Existing columns of the two names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def start():
        m = shared.value

        def turn(texts: list) -> list[pa.Array]:
            langs, scores = [], []
            for k in range(0, len(texts), 64):
                a, b = m.predict(texts[k : k + 64])
                langs += a
                scores += b
            return [pa.array(langs, type=pa.string()), pa.array(scores, type=pa.float64())]

        return turn

    return common.map_texts(df, text, f"`{lang_pred}` string, `{score}` double", start)
