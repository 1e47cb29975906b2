"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are word sequences: lower-cased words of letters and
digits, so that case and punctuation don't hide a copy. Runs of `least` words
that a text shares with an item are seeds, found by Karp-Rabin hashes of all
windows at once and confirmed word by word, by the words' own hashes; seeds that
follow each other are put together to maximal matches, in arrays. For each text
and item with matches, tiling repeatedly marks the longest match that touches no marked word of either,
down to `least` words. The share of an item's words that end up marked is its
coverage; passages count wherever they stand and in whatever order. An item is
leaked by a text that covers `threshold` of it.

The benchmark goes to all tasks in blocks of at most BLOCK_WORDS words, one pass
for each block, so that what is sent is bounded however long the benchmark is.
Texts are read in place, with no exchange.

Defined cases: null and empty texts leak nothing; null and empty items can't be
leaked; an item under `least` words must occur whole; items that repeat an id are
reported each; text rows are kept as they come, repeated or not.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, table
from .kernels import ALNUM, hash_windows, hash_words, ragged, text_slices, words_of

LEAST, THRESHOLD = 5, 0.8
#: Words of a block of the benchmark; places of shared windows that are held at once.
BLOCK_WORDS, SEEDS = 500_000, 1_000_000
LEAK = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("n_tiles", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("first_word", T.LongType())]))


def runs_of(p: np.ndarray, t: np.ndarray, n: np.ndarray, group: np.ndarray):
    """Matches (item start, text start, words, group) put together where one goes on in the next, by group and diagonal.

    Starts of equal matches of one length, each a word after the other, are one run
    too: what overlaps on a diagonal is united.
    """
    order = np.lexsort((t, t - p, group))
    p, t, n, group = p[order], t[order], n[order], group[order]
    new = np.ones(len(p), bool)
    new[1:] = (group[1:] != group[:-1]) | (t[1:] - p[1:] != t[:-1] - p[:-1]) | (t[1:] > t[:-1] + 1)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(p)) - 1
    return p[head], t[head], t[last] - t[head] + n[last], group[head]


def tiles(matches: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """(item start, text start, words) of the tiles, from all maximal matches of that form."""
    heap = [(-n, p, t) for p, t, n in matches]
    heapq.heapify(heap)
    base = min((t for _, _, t in heap), default=0)
    in_item, in_text = np.zeros(max((p - n for n, p, _ in heap), default=0), bool), np.zeros(max((t - n for n, _, t in heap), default=0) - base, bool)
    out, left = [], len(in_item)
    while heap and left >= least:
        n, p, t = heapq.heappop(heap)
        taken = in_item[p : p - n] | in_text[t - base : t - base - n]
        if not taken.any():
            in_item[p : p - n] = in_text[t - base : t - base - n] = True
            left += n
            out.append((p, t, -n))
            continue
        # What is left of the match goes back, at its new length.
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).view(np.int8)))
        for a, b in edges.reshape(-1, 2).tolist():
            if b - a >= least:
                heapq.heappush(heap, (a - b, p + a, t + a))
    return out


class Index:
    """Windows of a block of items, by hash."""

    def __init__(self, ids: list, words: list[np.ndarray], least: int):
        self.ids, self.words, self.least = ids, words, least
        self.flat, self.starts = np.concatenate(words), np.cumsum([0, *map(len, words)])[:-1]
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in sorted({min(least, len(w)) for w in words}):
            mine = [i for i, w in enumerate(words) if min(least, len(w)) == k]
            h = [hash_windows(words[i], k) for i in mine]
            item = np.repeat(mine, [len(x) for x in h])
            pos = np.concatenate([np.arange(len(x)) for x in h])
            h = np.concatenate(h)
            order = np.argsort(h, kind="stable")
            self.by_size[k] = h[order], item[order], pos[order]

    def leaks(self, words: np.ndarray, first: np.ndarray, threshold: float) -> dict[int, list[tuple]]:
        """Leaks of each text that has any; words of all texts in a row."""
        parts = []
        for k, (h, item, pos) in self.by_size.items():
            mine = hash_windows(words, k)
            lo, hi = np.searchsorted(h, mine, "left"), np.searchsorted(h, mine, "right")
            at = np.flatnonzero(hi > lo)
            doc = np.searchsorted(first, at, "right") - 1
            inside = at + k <= first[doc + 1]
            at, doc = at[inside], doc[inside]
            lo, n = lo[at], (hi - lo)[at]
            # SEEDS at a time: a word that an item and a text repeat meets itself everywhere.
            total = np.concatenate([[0], np.cumsum(n)])
            cut = np.unique(np.searchsorted(total, np.arange(0, total[-1] + SEEDS, SEEDS), "right") - 1).tolist()
            for a, b in zip(cut, [*cut[1:], len(at)], strict=True):
                which = ragged(lo[a:b], n[a:b])
                t, d, i, p = np.repeat(at[a:b], n[a:b]), np.repeat(doc[a:b], n[a:b]), item[which], pos[which]
                same = np.ones(len(t), bool)
                for j in range(k):
                    same &= words[t + j] == self.flat[self.starts[i] + p + j]
                t, d, i, p = t[same], d[same], i[same], p[same]
                if len(t):
                    parts.append(runs_of(p, t, np.full(len(t), k), d * len(self.ids) + i))
        if not parts:
            return {}
        p, t, n, group = runs_of(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        cut = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
        out: dict[int, list[tuple]] = {}
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            d, i = divmod(int(group[a]), len(self.ids))
            size = len(self.words[i])
            mark = np.zeros(size + 1, np.int64)
            np.add.at(mark, p[a:b], 1)
            np.add.at(mark, p[a:b] + n[a:b], -1)
            if (np.cumsum(mark)[:-1] > 0).sum() < threshold * size:
                continue  # not even all matches cover so much
            got = tiles(list(zip(p[a:b].tolist(), t[a:b].tolist(), n[a:b].tolist(), strict=True)), min(self.least, size))
            covered = sum(m for _, _, m in got) / size
            if covered >= threshold:
                out.setdefault(d, []).append((self.ids[i], covered, len(got), size, int(min(t for _, t, _ in got) - first[d])))
        return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, least: int):
    """The benchmark as indexes of at most BLOCK_WORDS words each; a longer item is a block of its own."""
    ids, held, size = [], [], 0
    for row in benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").orderBy("id", "text").toLocalIterator():
        for _, _, buf, off in text_slices(pa.array([row["text"]], pa.string())):
            buf, s, e, _ = words_of(buf, off, ALNUM, lower=True)
            words = hash_words(buf, s, e)
        if not len(words):
            continue
        if held and size + len(words) > BLOCK_WORDS:
            yield Index(ids, held, least)
            ids, held, size = [], [], 0
        ids, held, size = [*ids, row["id"]], [*held, words], size + len(words)
    if held:
        yield Index(ids, held, least)


def with_leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", as_col: str = "leaks") -> DataFrame:
    """docs with an array of the leaked items: item_id, coverage, n_tiles, n_words of the item, first_word in the text."""
    names = [c for c in docs.columns if c != as_col]
    out = docs.select(*names, F.array().cast(LEAK).alias(as_col))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema])
    leak_type = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int64()), ("n_words", pa.int64()), ("first_word", pa.int64())]))
    for index in _blocks(benchmark, item_col, item_text_col, least):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def find(batches, shared=shared):
            for batch in batches:
                k = batch.schema.get_field_index(as_col)
                leaks = batch.column(k).to_pylist()
                for a, _, buf, off in text_slices(batch.column(batch.schema.get_field_index(text_col))):
                    buf, s, e, first = words_of(buf, off, ALNUM, lower=True)
                    for d, found in shared.value.leaks(hash_words(buf, s, e), first, threshold).items():
                        leaks[a + d] = [*leaks[a + d], *(dict(zip(("item_id", "coverage", "n_tiles", "n_words", "first_word"), x, strict=True)) for x in found)]
                yield batch.set_column(k, as_col, pa.array(leaks, leak_type))

        out = out.mapInArrow(find, schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that leak an item.

    Null and empty texts stay; repeated rows stay or go alike; with an empty
    benchmark all stay. No column of docs is touched, whatever its name.
    """
    name = free_name(docs, "_leaks")
    return with_leaks(docs, benchmark, as_col=name, **options).where(F.size(name) == 0).drop(name)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    leaks = with_leaks(docs, table(spark, sf_dir, "benchmark")).where(F.size("leaks") > 0)
    return leaks.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")
