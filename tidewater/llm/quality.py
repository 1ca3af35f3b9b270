"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams (one token and two) over three readings of a text: its words, their
shapes (so that shouting, symbols and tables show in any language), and whether a word is new, seen
before, or that of the place before. N-grams of shapes and of repeats are few, so each has one
indicator for being there and one for each step of its share that it passes. Each indicator is scaled by
its log-count ratio between the classes; a linear hinge-loss model is then fitted by dual coordinate
descent, and its margin is mapped to a probability.

Defined cases: null and empty texts score by the bias alone; no training rows, or one class, give a
constant score; extra columns are ignored; repeated rows each get their row; whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, labelled_sample, small_batches

BUCKETS = 1 << 18
SAMPLE_ROWS = 4000
THRESHOLD = 0.3
COST = 0.05
EPOCHS = 25
#: Shares of all places beyond which an n-gram of shapes or repeats has a further indicator.
STEPS = (0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75)

#: Kinds of characters: white space, upper case, lower case (and letters beyond the table), digit; others are each their own.
_SPACE, _UPPER, _LOWER, _DIGIT = range(4)
_KIND = np.array(
    [_SPACE if chr(c).isspace() else _UPPER if chr(c).isupper() else _LOWER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else c + 4 for c in range(0x250)] + [_LOWER],
    np.int64,
)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number."""
    x = x.astype(np.uint64) * _M1
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(29))


def features(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of the n-gram indicators of the whole text.

    A shape is the word with each run of a kind of character as one, such as ``Aa!`` for ``Haus!!``.
    Words and shapes are known by 64-bit hashes, summed over places, so all of it is array work.
    """
    chars = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _KIND[np.minimum(chars, len(_KIND) - 1)]
    solid = kind != _SPACE
    if not solid.any():
        return np.zeros(0, np.int64)
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n, length = len(start), end - start
    at = np.flatnonzero(solid)
    word = np.repeat(np.arange(n), length)
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    kind, chars = kind[at], chars[at]
    place = at - start[word]
    folded = np.where((chars >= 65) & (chars <= 90), chars + 32, chars)
    own = np.add.reduceat(mixed((folded.astype(np.uint64) << np.uint64(20)) + place.astype(np.uint64)), first)
    new_run = np.ones(len(at), bool)
    new_run[1:] = kind[1:] != kind[:-1]
    new_run[first] = True
    runs = np.cumsum(new_run)
    run = np.minimum(runs - runs[first][word], 11)
    shape = np.add.reduceat(np.where(new_run, mixed((kind << 8) + run + 1), np.uint64(0)), first)
    # 0: a new word, 1: seen before, 2: that of the place before.
    _, where = np.unique(own, return_index=True)
    again = np.ones(n, np.uint64)
    again[where] = 0
    again[1:][own[1:] == own[:-1]] = 2
    found = [own, mixed(own[:-1] * _M1 + own[1:])]
    for kind_of, tokens in enumerate((shape, mixed(again + np.uint64(1)))):
        for grams in (tokens, mixed(tokens[:-1] * _M1 + tokens[1:])):
            gram, count = np.unique(grams, return_counts=True)
            for level, least in enumerate(STEPS):
                found.append(mixed(gram[count > least * n] + np.uint64(1 + level + 16 * kind_of)))
    return np.unique((np.concatenate(found) % np.uint64(BUCKETS)).astype(np.int64))


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> float:
        return float(self.weight[x].sum()) + self.bias

    def score(self, texts: Iterator[str | None]) -> np.ndarray:
        z = np.array([self.margin(features(t)) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))


def descend(xs: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, cost: float, seed: int = 5) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for min |w|^2/2 + cost * sum of hinge losses, bias included."""
    w, bias = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(y))
    norm = np.array([(ratio[x] ** 2).sum() + 1 for x in xs])
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            x = xs[i]
            g = y[i] * ((w[x] * ratio[x]).sum() + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost)
            if step := (new - alpha[i]) * y[i]:
                w[x] += step * ratio[x]
                bias += step
                alpha[i] = new
    return w, bias


def fit(rows: list[tuple[str, int]]) -> Model:
    """Fit on (text, 0/1) rows; the probability line is fitted on margins of a held-out fifth."""
    y01 = np.array([r[1] for r in rows], float)
    if not len(y01) or y01.min() == y01.max():
        p = float(y01.mean()) if len(y01) else 0.5
        return Model(np.zeros(BUCKETS), 0.0, 0.0, float(np.log((p + 0.01) / (1.01 - p))))
    xs = [features(t) for t, _ in rows]
    y = 2 * y01 - 1

    def svm(keep: np.ndarray) -> Model:
        hit = {c: np.ones(BUCKETS) for c in (-1, 1)}
        for i in keep:
            hit[int(y[i])][xs[i]] += 1
        ratio = np.log(hit[1] / hit[1].sum()) - np.log(hit[-1] / hit[-1].sum())
        w, bias = descend([xs[i] for i in keep], ratio, y[keep], COST)
        return Model(w * ratio, bias)

    fold = np.arange(len(y)) % 5
    z = np.zeros(len(y))
    for k in range(5):
        part = np.flatnonzero(fold != k)
        if len(set(y[part])) == 2:
            m = svm(part)
            for i in np.flatnonzero(fold == k):
                z[i] = m.margin(xs[i])
    model = svm(np.arange(len(y)))
    x = np.stack([z, np.ones_like(z)], 1)
    v = np.array([1.0, 0.0])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        v -= np.clip(np.linalg.solve(h, x.T @ (p - y01) + 1e-2 * (v - [1, 0])), -1, 1)
    model.scale, model.shift = float(max(v[0], 1e-3)), float(v[1])
    return model


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a bounded sample of the labelled rows whose crc32(doc_id) mod 5 is not 0."""
    keep = crc_mod(F.col("doc_id"), 5) != 0
    return fit(labelled_sample(docs, labels, "quality", keep, sample_rows))


def scorer(docs: DataFrame, model: Model):
    """Arrow UDF text -> score, with the model broadcast (256 Ki floats)."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(sent.value.score(texts))

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    rate = scorer(docs, train(docs, labels))
    out = docs.select("doc_id", rate("text").alias("score"))
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score the threshold or more, with their own columns."""
    rate = scorer(docs, train(docs, labels))
    return docs.where(rate("text") >= THRESHOLD)
