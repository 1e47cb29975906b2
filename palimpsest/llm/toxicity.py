"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is a hashed word vector beside the mean of the hashed vectors of
its character n-grams, so that a stem counts in words never seen; a long word is
read as pieces that overlap. Two gated
recurrent layers read a window of words, one from each end; attention pools
their states, and a logistic unit scores the window. A text's score is its
highest window's, over windows of WIDTH words every STRIDE words and one that
ends with the text.

Training is numpy back-propagation through time on the bounded sample of
training_sample(), all windows of it. Labels are of texts, so it starts from some
windows of each text with the text's label, and goes on with the window of each
toxic text that scores highest, and of the others with the highest and some more.
These later steps also read some windows that hold a word or two of a clean window
over and over, since few samples show the states that such runs lead to. Scoring reads
every whole text where it lies, with no exchange.

Defined cases: null and empty texts have no window and score 0; with no labelled
row of both labels to learn from every score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .kernels import U, mix, ragged
from .labels import Words, fit_in_task, held_out, training_sample, words_in

WIDTH, STRIDE = 48, 32
WORD_BITS, GRAM_BITS, WORD_DIM, GRAM_DIM, HIDDEN, ATTENTION = 15, 16, 6, 10, 8, 8
GRAMS = (3, 4, 5)
#: Share of words whose own vectors a step leaves out. Steps of either kind at least, within MOST_PASSES. Windows of runs in a step of the later kind.
WORD_DROP, STEPS, MOST_PASSES, RUNS = 0.5, (80, 160), 60, 12
#: Windows of a step; windows of any text that a pass takes at first; highest windows of a text that isn't toxic that later
#: passes take; passes of either kind; highest weight of a toxic window.
BATCH, NOISY, HARD, EPOCHS, MOST_WEIGHT, RATE, SEED = 256, 6, 2, (2, 6), 4, 0.015, 11
TOXIC = 0.7


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sum_rows(x: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows of x that go to each of n places; every place gets some."""
    order = np.argsort(to, kind="stable")
    return np.add.reduceat(x[order], np.searchsorted(to[order], np.arange(n)), axis=0)


def windows_of(first: np.ndarray, width: int = WIDTH, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, text) of all windows of texts whose words are first[i] to first[i + 1]."""
    n = np.diff(first)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - width) // stride)), 0)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(k * stride, np.maximum(0, n[text] - width))
    return first[text] + start, np.minimum(width, n[text]), text


class Inputs:
    """Hashed features of the distinct words of some texts."""

    def __init__(self, w: Words | None):
        if w is not None:
            self.word = (mix(w.distinct) >> U(64 - WORD_BITS)).astype(np.int32)
            owner, self.gram = w.grams(GRAMS, lambda keys: mix(keys) >> U(64 - GRAM_BITS))
            self._count(np.bincount(owner, minlength=len(self.word)))

    def _count(self, n: np.ndarray) -> None:
        self.count, self.off = n.astype(np.float32), np.concatenate([[0], np.cumsum(n, dtype=np.int64)])

    def only(self, words: np.ndarray) -> Inputs:
        """The features of some of the words."""
        out, n = Inputs(None), self.off[words + 1] - self.off[words]
        out.word, out.gram = self.word[words], self.gram[ragged(self.off[words], n)]
        out._count(n)
        return out

    @staticmethod
    def joined(parts: list[Inputs]) -> Inputs:
        out = Inputs(None)
        out.word, out.gram = (np.concatenate([getattr(p, k) for p in parts]) for k in ("word", "gram"))
        out._count(np.concatenate([np.diff(p.off) for p in parts]))
        return out


class ToxicModel:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + GRAM_DIM, HIDDEN

        def weights(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {"word": (rng.standard_normal((1 << WORD_BITS, WORD_DIM)) * 0.1).astype(np.float32), "gram": (rng.standard_normal((1 << GRAM_BITS, GRAM_DIM)) * 0.3).astype(np.float32), "att": weights(2 * h, ATTENTION), "key": weights(ATTENTION), "out": weights(2 * h), "bias": np.zeros(1, np.float32)}
        for way in "fb":  # gates: update, reset, new state
            self.p |= {f"x{way}": weights(d, 3 * h), f"h{way}": weights(h, 3 * h), f"c{way}": np.zeros(3 * h, np.float32)}

    def vectors(self, x: Inputs) -> np.ndarray:
        """One input for each distinct word."""
        n = len(x.word)
        gram = np.zeros((n, GRAM_DIM), self.p["gram"].dtype)
        for a in range(0, n, 16384):  # a word has some twenty n-grams
            off = x.off[a : a + 16385]
            some = a + np.flatnonzero(np.diff(off))
            if len(some):
                gram[some] = np.add.reduceat(self.p["gram"][x.gram[off[0] : off[-1]]], x.off[some] - off[0], axis=0) / x.count[some, None]
        return np.concatenate([self.p["word"][x.word], gram], axis=1)

    def read(self, table: dict[str, np.ndarray], at: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; table: each way's gate inputs by word; at: words of windows by place; mask: 1 where there is one."""
        t, n = at.shape
        h, p, states, kept = HIDDEN, self.p, np.empty((t, n, 2 * HIDDEN), np.float32), []
        full = bool(mask.all())
        for k, way in enumerate("fb"):
            s, hh = np.zeros((n, h), np.float32), p[f"h{way}"]
            for i in range(t) if way == "f" else range(t - 1, -1, -1):
                x = table[way][at[i]]
                zr = _sigmoid(x[:, : 2 * h] + s @ hh[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                rs = r * s
                c = np.tanh(x[:, 2 * h :] + rs @ hh[:, 2 * h :])
                new = s + z * (c - s)
                if not full:
                    new = np.where(mask[i][:, None], new, s)
                if keep:
                    kept.append((k, i, s, z, r, c, rs))
                s = new
                states[i, :, k * h : k * h + h] = s
        u = np.tanh(states @ p["att"])
        e = np.where(mask, u @ p["key"], np.float32(-1e9))
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tn,tnh->nh", a, states)
        logit = pooled @ p["out"] + p["bias"]
        return (logit, states, u, a, pooled, kept) if keep else logit

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {way: x @ self.p[f"x{way}"] + self.p[f"c{way}"] for way in "fb"}

    def _step(self, x: Inputs, at: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray, adam: dict, rate: float) -> None:
        p, h = self.p, HIDDEN
        words, back = np.unique(at, return_inverse=True)
        back = back.reshape(at.shape)
        part = x.only(words)
        v = self.vectors(part)
        # Words' own vectors are left out at random, so that their characters learn to tell too.
        own = (adam["rng"].random((len(words), 1)) >= WORD_DROP).astype(v.dtype) / (1 - WORD_DROP) if WORD_DROP and "rng" in adam else np.ones((len(words), 1), v.dtype)
        v[:, :WORD_DIM] *= own
        logit, states, u, a, pooled, kept = self.read(self.gates(v), back, mask, keep=True)
        g = {k: np.zeros_like(q) for k, q in p.items() if k not in ("word", "gram")}
        dl = ((_sigmoid(logit) - y) * weight / weight.sum()).astype(np.float32)
        g["out"], g["bias"] = pooled.T @ dl, dl.sum(keepdims=True)
        dpool = dl[:, None] * p["out"]
        da = np.einsum("nh,tnh->tn", dpool, states)
        de = a * (da - (a * da).sum(0))
        du = de[:, :, None] * p["key"] * (1 - u * u)
        g["key"] = np.einsum("tn,tnk->k", de, u)
        g["att"] = np.einsum("tnh,tnk->hk", states, du)
        ds = a[:, :, None] * dpool + du @ p["att"].T
        dv = np.zeros_like(v)
        for k, way in enumerate("fb"):
            hh, dx, carry = p[f"h{way}"], np.empty((*at.shape, 3 * h), np.float32), np.zeros((at.shape[1], h), np.float32)
            for _, i, s, z, r, c, rs in reversed([q for q in kept if q[0] == k]):
                d = carry + ds[i, :, k * h : k * h + h]
                live = mask[i][:, None]
                dn = np.where(live, d, 0)
                dc = dn * z * (1 - c * c)
                drs = dc @ hh[:, 2 * h :].T
                dz = dn * (c - s) * z * (1 - z)
                dr = drs * s * r * (1 - r)
                dzr = np.concatenate([dz, dr], 1)
                g[f"h{way}"][:, : 2 * h] += s.T @ dzr
                g[f"h{way}"][:, 2 * h :] += rs.T @ dc
                dx[i, :, : 2 * h], dx[i, :, 2 * h :] = dzr, dc
                carry = np.where(live, dn * (1 - z) + drs * r + dzr @ hh[:, : 2 * h].T, d)
            flat = dx.reshape(-1, 3 * h)
            g[f"c{way}"] = flat.sum(0)
            by_word = _sum_rows(flat, back.ravel(), len(words))
            g[f"x{way}"] = v.T @ by_word
            dv += by_word @ p[f"x{way}"].T
        adam["t"] += 1
        fix = np.sqrt(1 - 0.999 ** adam["t"]) / (1 - 0.9 ** adam["t"])

        def update(name, rows, grad):
            m, s = adam.setdefault(name, (np.zeros_like(p[name]), np.zeros_like(p[name])))
            m[rows] = 0.9 * m[rows] + 0.1 * grad
            s[rows] = 0.999 * s[rows] + 0.001 * grad * grad
            p[name][rows] -= rate * fix * m[rows] / (np.sqrt(s[rows]) + 1e-8)

        for name, grad in g.items():
            update(name, slice(None), grad)
        for name, ids, grad in (("word", part.word, dv[:, :WORD_DIM] * own), ("gram", part.gram, (dv[:, WORD_DIM:] / np.maximum(part.count, 1)[:, None])[np.repeat(np.arange(len(words)), np.diff(part.off))])):
            rows, where = np.unique(ids, return_inverse=True)
            update(name, rows, _sum_rows(grad, where, len(rows)))

    def fit(self, texts: list[str], labels: np.ndarray, epochs: tuple[int, int] = EPOCHS, seed: int = SEED) -> ToxicModel | None:
        """None if either label is missing."""
        if len(set(labels.tolist())) < 2:
            return None
        rng = np.random.default_rng(seed)
        at, mask, text, parts, base = [], [], [], [], 0
        for first, x in words_in(texts):
            start, n, of = windows_of(x.first)
            place = np.arange(WIDTH)[:, None]
            ok = place < n
            at.append((np.where(ok, x.of[np.where(ok, start + place, 0)], 0) + base).astype(np.int32))
            mask.append(ok)
            text.append(of + first)
            parts.append(Inputs(x))
            base += len(x.distinct)
        whole = Inputs.joined(parts)
        at, mask, text = np.concatenate(at, 1), np.concatenate(mask, 1), np.concatenate(text)
        y, adam = labels[text].astype(np.float32), {"t": 0, "rng": rng}
        # A small sample is gone through more often.
        a_pass = max(1, min(len(y), NOISY * len(labels)) // BATCH)
        epochs = tuple(max(e, min(MOST_PASSES, -(-n // a_pass))) for e, n in zip(epochs, STEPS, strict=True))
        steps = sum(epochs)
        for epoch in range(steps):
            order = rng.permutation(len(y))
            if epoch >= epochs[0]:
                score = self._scores(whole, at, mask)
                order = order[np.argsort(-score[order], kind="stable")]
            order = order[np.argsort(text[order], kind="stable")]
            rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
            if epoch < epochs[0]:
                use = order[rank < NOISY]
            else:
                # Of toxic texts the highest window; of others their highest, and as many more of any height.
                mine = y[order] == 1
                spare = rng.permutation(np.flatnonzero(~mine & (rank >= HARD)))[: int((~mine & (rank < HARD)).sum())]
                use = order[np.concatenate([np.flatnonzero(mine & (rank == 0)), np.flatnonzero(~mine & (rank < HARD)), spare])]
            share = (y[use] == 0).sum() / max(1, (y[use] == 1).sum())
            weight = np.where(y == 1, min(share, MOST_WEIGHT), 1).astype(np.float32)
            use = use[rng.permutation(len(use))]
            for i in range(0, len(use), BATCH):
                b = use[i : i + BATCH]
                clean = b[y[b] == 0][: RUNS * (epoch >= epochs[0])]
                pair = at[:, clean][rng.integers(0, np.maximum(1, mask[:, clean].sum(0)), (2, len(clean))), np.arange(len(clean))]
                pair[1, ::2] = pair[0, ::2]
                runs = pair[np.arange(WIDTH) % 2]
                self._step(whole, np.concatenate([at[:, b], runs], 1), np.concatenate([mask[:, b], np.ones(runs.shape, bool)], 1), np.append(y[b], np.zeros(len(clean))), np.append(weight[b], np.ones(len(clean), np.float32)), adam, RATE * (1 - 0.8 * epoch / steps))
        return self

    def _scores(self, x: Inputs, at: np.ndarray, mask: np.ndarray, block: int = 2048) -> np.ndarray:
        gates = self.gates(self.vectors(x))
        return np.concatenate([self.read(gates, at[:, i : i + block], mask[:, i : i + block]) for i in range(0, at.shape[1], block)])

    def score(self, texts: pa.Array) -> np.ndarray:
        """The highest probability of each text's windows."""
        out = np.zeros(len(texts))
        place = np.arange(WIDTH)[:, None]
        for first, x in words_in(texts):
            start, n, of = windows_of(x.first)
            if not len(of):
                continue
            gates, logit = self.gates(self.vectors(Inputs(x))), np.empty(len(of), np.float32)
            whole = np.flatnonzero(n == WIDTH)
            for rows in (whole, np.flatnonzero(n < WIDTH)):
                for i in range(0, len(rows), 2048):
                    b = rows[i : i + 2048]
                    ok = place < n[b]
                    logit[b] = self.read(gates, x.of[np.where(ok, start[b] + place, 0)], ok)
            np.maximum.at(out, first + of, _sigmoid(logit.astype(np.float64)))
        return out


def with_toxicity(docs: DataFrame, model: ToxicModel | None, text_col: str = "text", as_col: str = "toxicity") -> DataFrame:
    """docs with the score of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the network: its size is fixed
    out = docs.select(*[c for c in docs.columns if c != as_col])

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            score = np.zeros(len(texts)) if shared.value is None else shared.value.score(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, as_col])

    return out.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField(as_col, T.DoubleType())]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> ToxicModel | None:
    return fit_in_task(training_sample(docs, labels, label), lambda texts, y: ToxicModel().fit(texts, y))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")), as_col="score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
