"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its hashed character (UTF-8 byte) n-grams, so a misspelling shares most vectors with the
word it hides. The vectors of the bag are averaged and go through a linear softmax; a document is as toxic
as its worst bag, so length does not dilute it. Vectors and softmax weights are fitted together by
full-batch Adam with a pooled cross-entropy. Three folds inside the training rows of sf0.1 chose the
settings: bags of two, three and four words in a row found 224, 214 and 202 of 305, those of one word 261, and 269 with the decay below.

Defined cases: a null or wordless text has the score of an empty bag (the bias alone); an empty or
one-class training set gives a constant score; extra columns are ignored; repeated rows each get
their row; whole texts are scored, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, labelled_sample, small_batches

BITS = 16
BUCKETS = 1 << BITS
#: Lengths of the character n-grams.
SIZES = (3, 4)
DIM = 8
SAMPLE_ROWS = 3000
EPOCHS = 60
#: Weight decay of the vectors.
DECAY = 1e-5
THRESHOLD = 0.7

_SPLIT = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def spaced(text: str | None) -> bytes:
    """Lower-cased UTF-8 of the text, between spaces; all but ASCII letters, digits and what is beyond ASCII is a space."""
    return b" " + (text or "").lower().encode("utf-8", "replace").translate(_SPLIT) + b" "


def grams(text: bytes) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Starts and ends of words, and for each n-gram length (buckets, whether it lies in one word) by place.

    The n-grams are of bytes, at one by the place of their second; the space before and after a word
    takes part, and so marks beginnings and ends.
    """
    b = np.frombuffer(text, np.uint8)
    inner = b != 32
    edge = np.diff(inner.astype(np.int8))
    start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    x, out = b.astype(np.uint32), []
    for n in SIZES:
        m = max(len(b) - n + 1, 0)
        h, ok = np.full(m, n, np.uint32), np.ones(m, bool)
        for i in range(n):
            h = (h + x[i : i + m]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            if 0 < i < n - 1:
                ok &= inner[i : i + m]
        out.append(((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS), ok))
    return start, end, out


@dataclass
class Model:
    """Per-bucket logit (vector times weights), bias, and a line from pooled logit to probability."""

    logit: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def words(self, text: str | None) -> np.ndarray:
        """Mean logit of the n-grams of each word."""
        start, end, sizes = grams(spaced(text))
        total, count = np.zeros(len(start)), np.zeros(len(start))
        for bucket, ok in sizes:
            # The n-grams of a word are those that start from the space before it to n - 1 before its end.
            c = np.concatenate([[0.0], np.cumsum(np.where(ok, self.logit[bucket], 0), dtype=np.float64)])
            k = np.concatenate([[0], np.cumsum(ok)])
            stop = np.minimum(end - 1, len(ok))
            first = np.minimum(start - 1, stop)
            total += c[stop] - c[first]
            count += k[stop] - k[first]
        return total / np.maximum(count, 1)

    def score(self, texts: Iterator[str | None]) -> np.ndarray:
        z = np.array([self.bias + (w.max() if len(w := self.words(t)) else 0.0) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))


def fit(rows: list[tuple[str, int]], seed: int = 7) -> Model:
    """Fit vectors and softmax on (text, 0/1) rows."""
    y = np.array([r[1] for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(np.log((p + 0.01) / (1.01 - p))))
    index: dict[bytes, int] = {}
    ids, owner = [], []
    for k, (text, _) in enumerate(rows):
        w = [index.setdefault(x, len(index)) for x in spaced(text).split()] or [index.setdefault(b"", len(index))]
        ids.append(np.array(w, np.int32))
        owner.append(np.full(len(w), k))
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    bag, bag_at, bag_len = bags_of(list(index))
    del index
    doc_at = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    word_of_gram = np.repeat(np.arange(len(bag_len), dtype=np.int32), bag_len.astype(int))
    rng = np.random.default_rng(seed)
    vec = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.array([np.log(1 - y.mean()), np.log(y.mean())], np.float32)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (vec, out, bias)]
    for epoch in range(1, EPOCHS + 1):
        sharp = min(1.0, epoch / (EPOCHS * 0.5))
        # Averages are linear, so the softmax weights can be applied to the vectors before averaging.
        d = out[:, 1] - out[:, 0]
        word = np.add.reduceat((vec @ d)[bag], bag_at) / bag_len
        diff = word[ids]
        top = np.maximum.reduceat(diff, doc_at)
        soft = np.exp((1 + 9 * sharp) * (diff - top[owner]))
        soft /= np.add.reduceat(soft, doc_at)[owner]
        z = np.add.reduceat(soft * diff, doc_at) + bias[1] - bias[0]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g_doc = (p - y) / len(y)
        g_place = (g_doc[owner] * soft).astype(np.float32)
        g_word = np.bincount(ids, g_place, minlength=len(bag_len)) / bag_len
        g_bucket = np.bincount(bag, g_word[word_of_gram], minlength=BUCKETS).astype(np.float32)
        g_d = g_bucket @ vec
        g_vec = g_bucket[:, None] * d + DECAY * vec
        g_bias = np.array([-g_doc.sum(), g_doc.sum()], np.float32)
        for q, g, (m, v), rate in zip((vec, out, bias), (g_vec, np.stack([-g_d, g_d], 1), g_bias), state, (0.05, 0.02, 0.02), strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-6)
    model = Model((vec @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))
    return calibrated(model, rows, y)


def calibrated(model: Model, rows: list[tuple[str, int]], y: np.ndarray) -> Model:
    """Fit the line from pooled logit to probability by Newton steps on the training rows."""
    s = model.score(t for t, _ in rows)
    z = np.log(np.clip(s, 1e-9, 1 - 1e-9) / np.clip(1 - s, 1e-9, 1))
    x = np.stack([z, np.ones_like(z)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w -= np.clip(np.linalg.solve(h, x.T @ (p - y) + 1e-3 * (w - [1, 0])), -1, 1)
    model.scale, model.shift = float(max(w[0], 1e-3)), float(w[1])
    return model


def bags_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all words one after another, where each word's begin, and how many it has; no word's bag is empty."""
    start, _, sizes = grams(b" " + b" ".join(w or b"0" for w in words) + b" ")
    place = np.concatenate([np.flatnonzero(ok) for _, ok in sizes])
    found = np.concatenate([bucket[ok] for bucket, ok in sizes])
    owner = np.searchsorted(start, place + 1, side="right") - 1
    order = np.argsort(owner, kind="stable")
    count = np.bincount(owner, minlength=len(words))
    return found[order].astype(np.int32), np.cumsum(count) - count, count.astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a bounded sample of the labelled rows whose crc32(doc_id) mod 3 is not 1."""
    keep = crc_mod(F.col("doc_id"), 3) != 1
    return fit(labelled_sample(docs, labels, "toxic", keep, sample_rows))


def scorer(docs: DataFrame, model: Model):
    """Arrow UDF text -> score, with the model broadcast (64 Ki floats)."""
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
    held = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score under the threshold, with their own columns."""
    rate = scorer(docs, train(docs, labels))
    return docs.where(rate("text") < THRESHOLD)
