"""A quality classifier of supervised subword embeddings.

A text's features are its words, its pairs of words in a row (where pairs of one
word twice share a feature), and the character n-grams of its words (long ones in pieces), each hashed
to a vector. The text's vector is their mean, and a softmax layer gives the
probability of each label. Vectors and layer are trained together by stochastic
gradient descent in numpy, on the bounded sample of training_sample(). Scoring
reads every whole text where it lies, with no exchange: the mean and the layer
are linear, so a feature's share of the logit is computed once for each bucket.

Defined cases: null and empty texts have no features and get the bias's score;
with no labelled row to learn from every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .kernels import U, mix
from .labels import Words, fit_in_task, held_out, training_sample, words_in

BITS, DIM, GRAMS = 18, 16, (3, 4)
EPOCHS, RATE, SEED = 6, 0.5, 7


def _bucket(h: np.ndarray, kind: int, bits: int) -> np.ndarray:
    return (mix(h ^ U(0x9E37 * (kind + 1))) >> U(64 - bits)).astype(np.int64)


def features(w: Words, bits: int = BITS):
    """(buckets of distinct words, their grams' owners and buckets, buckets of pairs, text of each pair, texts' words)."""
    owner, gram = w.grams(GRAMS, lambda keys: _bucket(keys, 1, bits))
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    a, b = w.hashes[:-1], w.hashes[1:]
    pair = np.where(a == b, U(1), a * U(0xD6E8FEB86659FD93) + b)
    same = text[:-1] == text[1:] if len(text) else np.zeros(0, bool)
    return _bucket(w.distinct, 0, bits), owner, gram, _bucket(pair[same], 2, bits), text[:-1][same] if len(text) else text, text


class QualityModel:
    """Vectors of all buckets and a softmax layer of two labels."""

    def __init__(self, bits: int = BITS, dim: int = DIM, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.bits = bits
        self.vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
        self.layer = np.zeros((dim, 2), np.float32)
        self.bias = np.zeros(2, np.float32)

    def fit(self, texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> QualityModel:
        bags, y = [], []
        for first, w in words_in(texts):
            word, owner, gram, pair, pair_text, text = features(w, self.bits)
            by_word = np.searchsorted(owner, np.arange(len(word) + 1))
            cuts = np.searchsorted(pair_text, np.arange(len(w.first)))
            for i in range(len(w.first) - 1):
                mine = w.of[w.first[i] : w.first[i + 1]]
                if not len(mine):
                    continue
                distinct, times = np.unique(mine, return_counts=True)
                n = by_word[distinct + 1] - by_word[distinct]
                at = np.repeat(by_word[distinct] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                ids = np.concatenate([word[distinct], gram[at], pair[cuts[i] : cuts[i + 1]]])
                weight = np.concatenate([times, np.repeat(times, n), np.ones(cuts[i + 1] - cuts[i])])
                ids, back = np.unique(ids, return_inverse=True)
                weight = np.bincount(back, weight).astype(np.float32)
                bags.append((ids.astype(np.int32), weight / weight.sum()))
                y.append(int(labels[first + i]))
        if not bags:
            return self
        rng, steps, step = np.random.default_rng(seed), epochs * len(bags), 0
        for _ in range(epochs):
            for i in rng.permutation(len(bags)):
                ids, weight = bags[i]
                lr = rate * (1 - step / steps)
                step += 1
                rows = self.vectors[ids]
                mean = weight @ rows
                logit = mean @ self.layer + self.bias
                p = np.exp(logit - logit.max())
                p /= p.sum()
                p[y[i]] -= 1
                back = self.layer @ p
                self.layer -= lr * np.outer(mean, p)
                self.bias -= np.float32(lr) * p
                # Each bucket's gradient is its weight times `back`; scaled to the text's length so that rare words move.
                self.vectors[ids] = rows - (lr * min(len(ids), 200.0)) * weight[:, None] * back
        return self

    def shares(self) -> tuple[np.ndarray, float]:
        """Each bucket's share of the logit of label 1, and the bias's."""
        return self.vectors @ (self.layer[:, 1] - self.layer[:, 0]), float(self.bias[1] - self.bias[0])

    def score(self, texts: pa.Array) -> np.ndarray:
        return score_with(*self.shares(), self.bits, texts)


def score_with(share: np.ndarray, bias: float, bits: int, texts: pa.Array) -> np.ndarray:
    """The probability of label 1 of each text."""
    out = np.empty(len(texts))
    for first, w in words_in(texts):
        word, owner, gram, pair, pair_text, text = features(w, bits)
        m, n = len(w.first) - 1, len(word)
        total = share[word] + np.bincount(owner, share[gram], n)
        count = 1 + np.bincount(owner, minlength=n)
        s = np.bincount(text, total[w.of], m) + np.bincount(pair_text, share[pair], m)
        c = np.bincount(text, count[w.of], m) + np.bincount(pair_text, minlength=m)
        out[first : first + m] = 1 / (1 + np.exp(-(s / np.maximum(c, 1) + bias)))
    return out


def with_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", as_col: str = "quality_score") -> DataFrame:
    """docs with the probability of label 1."""
    share, bias = model.shares()
    shared, bits = docs.sparkSession.sparkContext.broadcast((share, bias)), model.bits
    names = [c for c in docs.columns if c != as_col]
    out = docs.select(*names)

    def run(batches):
        for batch in batches:
            score = score_with(*shared.value, bits, batch.column(batch.schema.get_field_index(text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, as_col])

    return out.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField(as_col, T.DoubleType())]))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> QualityModel:
    return fit_in_task(training_sample(docs, labels, label), lambda texts, y: QualityModel().fit(texts, y))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")), as_col="score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
