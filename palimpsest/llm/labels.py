"""What the two classifiers share: folds, and a bounded sample of labelled texts to fit on."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import SLICE_BYTES, hash_words, ragged, text_slices, words_of

#: The sample that a classifier is fitted on: texts of each label, and bytes of text in all, half of them for each label.
SAMPLE_TEXTS, SAMPLE_BYTES = 2000, 10_000_000
#: Bytes of one text in the sample; of longer texts it holds PIECES stretches, spread evenly from the start to the end.
TEXT_BYTES, PIECES = 250_000, 50
#: Bytes of a word; longer ones are read as pieces of so many, each with the last OVERLAP bytes of the one before, so that
#: each n-gram of up to OVERLAP + 1 bytes lies in a piece. Distinct words whose n-grams are held at once.
LONGEST, OVERLAP, GRAM_BLOCK = 24, 4, 16384
#: Rows of labels with crc32(doc_id as text) mod FOLDS equal to HELD_OUT aren't learnt from.
FOLDS, HELD_OUT = 3, 1


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(fold(id_col) == HELD_OUT, F.lit(False))


def spread(text: Column, most_bytes: int = TEXT_BYTES, pieces: int = PIECES) -> Column:
    """text, or if it has over most_bytes, evenly spread stretches of it that have no more, as words in a row."""
    size = most_bytes // (4 * pieces) - 1  # characters, of four bytes at most, and a space
    stretch = lambda i: F.substring(text, (F.floor((F.char_length(text) - size) * i / (pieces - 1)) + 1).cast("int"), F.lit(size))
    return F.when(F.octet_length(text) <= most_bytes, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), stretch), " "))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, texts: int = SAMPLE_TEXTS, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, y) of at most `texts` labelled documents of either label and most_bytes in all, picked by hash of their ids.

    Each label has half of the bytes, and one text at most TEXT_BYTES of them, so
    no text and no label takes the place of the others.
    Only rows outside the held-out fold count. Rows without id or label, with
    another label than 0 or 1, or whose id has both, are left out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").select("doc_id", "y")
    picked = known.where("y = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(texts).unionByName(known.where("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(texts))
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").where("text is not null")
    some = some.withColumn("text", spread(F.col("text"), min(TEXT_BYTES, most_bytes // 2)))
    size = F.sum(F.octet_length("text")).over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id", "text"))  # over the sample's rows only
    return some.withColumn("_size", size).where(F.col("_size") <= most_bytes // 2).drop("_size")


def fit_in_task(sample: DataFrame, fit):
    """What fit(texts, labels) returns, run by one task on a bounded sample; only the model comes to the driver."""

    def run(batches):
        rows = []
        for batch in batches:
            rows += zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "y")), strict=True)
        rows.sort()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([t for _, t, _ in rows], np.array([y for *_, y in rows], np.float64)))], pa.binary())], names=["model"])

    row = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(row["model"]) if row else fit([], np.zeros(0))


def pieces_of(starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) where a word over LONGEST bytes is its overlapping pieces in a row."""
    step = LONGEST - OVERLAP
    count = 1 + np.maximum(0, -(-(ends - starts - LONGEST) // step))
    if not len(count) or count.max() == 1:
        return starts, ends, first
    total = np.concatenate([[0], np.cumsum(count)])
    begins = np.repeat(starts, count) + (np.arange(total[-1]) - np.repeat(total[:-1], count)) * step
    return begins, np.minimum(begins + LONGEST, np.repeat(ends, count)), total[first]


class Words:
    """The words of some texts, long ones in pieces: distinct ones, and which of them stand where."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, starts, ends, first = words_of(buf, off)
        self.starts, self.ends, self.first = pieces_of(starts, ends, first)
        self.hashes = hash_words(self.buf, self.starts, self.ends)
        order = np.argsort(self.hashes, kind="stable")
        h = self.hashes[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        self.distinct = h[new]
        self.of = np.empty(len(h), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.example = order[new]  # one place of each distinct word

    def grams(self, sizes: tuple[int, ...], bucket) -> tuple[np.ndarray, np.ndarray]:
        """(distinct word, bucket of its 64-bit key) of the character n-grams of '<word>', by word."""
        words, buckets = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for a in range(0, len(self.example), GRAM_BLOCK):
            owner, keys = self._grams(self.example[a : a + GRAM_BLOCK], sizes)
            order = np.argsort(owner, kind="stable")
            words.append((owner[order] + a).astype(np.int32))
            buckets.append(bucket(keys[order]).astype(np.int32))
        return np.concatenate(words), np.concatenate(buckets)

    def _grams(self, example: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        s, e = self.starts[example], self.ends[example]
        n = e - s + 2
        off = np.concatenate([[0], np.cumsum(n)])
        chars = np.empty(off[-1], np.uint64)
        inner = np.ones(off[-1], bool)
        inner[off[:-1]] = inner[off[1:] - 1] = False
        chars[inner] = self.buf[ragged(s, n - 2)]
        chars[off[:-1]], chars[off[1:] - 1] = 0x100, 0x101
        owner = np.repeat(np.arange(len(n)), n)
        left = np.repeat(off[1:], n) - np.arange(off[-1])
        words, keys = [], []
        for k in sizes:
            h = np.full(len(chars), k, np.uint64)
            for j in range(k):
                h[: len(h) - j] = h[: len(h) - j] * np.uint64(0x9E3779B97F4A7C15) + chars[j:] + np.uint64(1)
            ok = left >= k
            words.append(owner[ok])
            keys.append(h[ok])
        return np.concatenate(words), np.concatenate(keys)


def words_in(texts: list[str] | pa.Array):
    """(first row, Words) of slices of texts, smaller ones of a list, which the driver holds."""
    mine = isinstance(texts, list)
    for a, _, buf, off in text_slices(pa.array(texts, pa.string()), SLICE_BYTES // 4) if mine else text_slices(texts):
        yield a, Words(buf, off)
