"""Language-model scores by Katz backoff over n-grams.

Counts of 1 to K_MAX are discounted by Good-Turing estimates, at the level of words
and of each longer n-gram; what that frees goes to words not seen after a context, by
their probability after the context without its first word, down to that of the
word alone, with backoff weights that make every context's probabilities add up
to 1. Unknown words are one class, which gets what words' discounts free. Where a
level frees nothing, as when all counts are high, RESERVE of a count is set aside
for what it hasn't seen. A text starts with one start mark, which is context only.

Texts are cut into slices of about SLICE bytes, which are written as a table of
word numbers. Level by level, each slice asks for the counts of its distinct
n-grams from buckets, where the counts of all slices add up; the answers, tables by
slice and bucket, come back in the order of the questions, with a number for
each n-gram that occurs, which is its name as a context at the next level. Words
go by 64-bit hashes, longer n-grams by the exact numbers of context and word.

An n-gram goes to its context's bucket, where the context's counts of counts and the
lower-order probability of the words seen after it are summed up; contexts with
more than a bucket's fair share of all tokens, of which there are at most HOT for
each bucket, are spread over all buckets by word, and their sums added up.
The number of buckets follows the bytes of text, so that a bucket's questions stay
of one size. An n-gram that isn't found falls back to its context's weight and the
shorter context's probability; a context that isn't found has weight 1.

Defined cases: null and empty texts consist of the end only; rows without id
count as training rows; repeated rows count and are scored each; without any
training row a text's score and base score are those of unknown words.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..written import checkpointed, checkpointed_parts, clustered, discard
from .common import blob_batch, group_edges, shuffle_partitions, table
from .kernels import U, hash_words, mix, text_slices, words_of

#: Places within a slice fit into this type.
I = np.int32
ORDER, K_MAX, RESERVE, HOT = 3, 5, 0.5, 4
FOLDS, HELD_OUT = 5, 1
#: Hash of a text's end, which is a word that is never a context. Numbers of the unknown word and of the start; words follow.
END, UNKNOWN, START, FIRST_ID = U(0x454E44), 0, 1, 2
#: Bytes of text of a slice, and for each bucket; n-grams of a bucket that are worked on at once.
SLICE, BUCKET, RANGE = 5_000_000, 20_000_000, 600_000
#: Codec of tables whose columns are compressed already.
PLAIN = "snappy"
ASK = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), ("data", pa.binary())])
ANSWER = pa.schema([("kind", pa.int32()), ("slice", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary()), ("stats", pa.list_(pa.float64())), ("context", pa.int64())])
ASK_DDL, ANSWER_DDL = "bucket int, slice long, data binary", "kind int, slice long, bucket int, data binary, stats array<double>, context long"


def discounts(n: list[float]) -> np.ndarray:
    """Factors of counts 0 to K_MAX + 1 and above, from the numbers n[r] of things seen r times, r up to K_MAX + 1.

    Katz's: Good-Turing estimates, scaled so that they free what is seen once.
    One that isn't over 0 and at most 1 is left at 1, as are all if the scale isn't positive.
    """
    d = np.ones(K_MAX + 2)
    if n[1] > 0:
        cut = (K_MAX + 1) * n[K_MAX + 1] / n[1]
        for r in range(1, K_MAX + 1):
            if n[r] > 0 and cut < 1:
                x = ((r + 1) * n[r + 1] / (n[r] * r) - cut) / (1 - cut)
                if 0 < x <= 1:
                    d[r] = x
    return d


@dataclass
class Unigrams:
    """What word counts need: tokens, kinds, discounts, the unknown class's probability, and a factor that makes room for it."""

    tokens: float = 0.0
    kinds: float = 0.0
    d: np.ndarray = field(default_factory=lambda: np.ones(K_MAX + 2))
    scale: float = 1.0
    unknown: float = 1.0

    @classmethod
    def of(cls, tokens: float, kinds: float, n: list[float]) -> Unigrams:
        if not tokens:
            return cls()
        d = discounts(n)
        used = sum(d[r] * r * n[r] for r in range(1, K_MAX + 1)) + tokens - sum(r * n[r] for r in range(1, K_MAX + 1))
        free, least = 1 - used / tokens, RESERVE / (tokens + RESERVE)
        scale = 1.0 if free >= least else (1 - least) * tokens / used
        return cls(tokens, kinds, d, scale, max(free, least))

    def p(self, count: np.ndarray) -> np.ndarray:
        """Probabilities of words by their counts; 0 stands for the unknown class."""
        c = count.astype(np.float64)
        seen = self.d[np.minimum(count, K_MAX + 1).astype(np.int64)] * c / max(self.tokens, 1) * self.scale
        return np.where(count > 0, seen, self.unknown)


def squeezed(*columns: np.ndarray) -> bytes:
    """Columns of numbers from 0 on, or of floats, as compressed bytes: of as many bytes as needed each, like bytes together."""
    head, parts = [len(columns)], []
    for c in columns:
        real = c.dtype.kind == "f"
        raw = np.ascontiguousarray(c, np.float64 if real else np.uint64)
        width = 8 if real else max(1, -(-int(raw.max(initial=0)).bit_length() // 8))
        head += [int(real), width, len(raw)]
        parts.append(raw.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    data = b"".join([np.array(head, np.uint32).tobytes(), *parts])
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(data, asbytes=True)


def loosened(data: bytes, narrow: bool = False) -> list[np.ndarray]:
    """The columns that squeezed() took, as int64 or float64; narrow: whole numbers in as few bytes as hold them."""
    data = pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    head, at, out = np.frombuffer(data, np.uint32, 3 * n, 4).reshape(n, 3).tolist(), 4 + 12 * n, []
    for real, width, size in head:
        room = 8 if not narrow or width > 4 else (0, 1, 2, 4, 4)[width]
        raw = np.zeros((size, room), np.uint8)
        raw[:, :width] = np.frombuffer(data, np.uint8, width * size, at).reshape(width, size).T
        out.append(raw.view(np.float64 if real else {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[room]).ravel())
        at += width * size
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _steps(x: np.ndarray) -> np.ndarray:
    """Rising numbers as their differences."""
    return np.diff(x.view(np.int64), prepend=np.int64(0)).view(U)


def _home(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of mixed 64-bit numbers; it rises with them."""
    return ((h >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def _slice_rows(texts: pa.Array, train: np.ndarray):
    """(sorted distinct words and ends, how often each in training, their places by falling count, words by that place, words of each text, the end's place)."""
    words, first, base = [], [np.zeros(1, np.int64)], 0
    for _, _, buf, off in text_slices(texts, SLICE // 4):
        buf, s, e, f = words_of(buf, off, lower=True)
        words.append(np.insert(hash_words(buf, s, e), f[1:], END))
        first.append(f[1:] + np.arange(1, len(f)) + base)
        base = int(first[-1][-1])
    first = np.concatenate(first)
    distinct, of = np.unique(np.concatenate(words), return_inverse=True)
    by_count = np.argsort(-np.bincount(of), kind="stable")
    place = np.empty(len(distinct), np.int64)
    place[by_count] = np.arange(len(distinct))
    times = np.bincount(of, np.repeat(train, np.diff(first)), len(distinct)).astype(np.int64)
    return distinct, times, by_count, place[of], np.diff(first), np.searchsorted(distinct, [END])


@dataclass
class Level:
    """What scoring needs of one order above words: discounts, and the figures of hot contexts by their numbers."""

    d: np.ndarray
    hot: np.ndarray
    figures: np.ndarray


def _shares(count: np.ndarray, few: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(what contexts leave to words not seen, what their seen words' discounted counts are multiplied by), from their counts and counts of counts."""
    c = np.maximum(count, 1).astype(float)
    free = (few * (np.arange(1, K_MAX + 1) * (1 - d[1 : K_MAX + 1]))).sum(1) / c
    least = RESERVE / (count + RESERVE)
    return np.maximum(free, least), np.where(free >= least, 1.0, (1 - least) / np.maximum(1 - free, 1e-300)) / c


class Slice:
    """A slice's n-grams and what is known of them, as far as answers have come."""

    def __init__(self, row: dict, answers: list[dict[int, bytes]], buckets: int, u: Unigrams, levels: list[Level]):
        self.buckets, self.u = buckets, u
        by_count, places, sizes, end = loosened(row["tokens"])
        self.tokens, self.first = by_count.astype(I)[places], np.concatenate([[0], np.cumsum(sizes)])
        self.train = np.repeat(np.asarray(row["train"], bool), np.diff(self.first))
        n = len(by_count)
        homes = sorted(answers[0])
        replies = [loosened(answers[0][b]) for b in homes]
        self.count = np.concatenate([r[0] for r in replies])
        #: Numbers and counts of the slice's words, of the unknown word, and of the start.
        self.ids = np.concatenate([*(np.where(r[1] > 0, r[1] * buckets + b + FIRST_ID, UNKNOWN) for b, r in zip(homes, replies, strict=True)), [UNKNOWN, START]])
        self.word_counts = np.append(self.count, [0, int(self.count[end[0]])])  # a text starts as often as it ends
        self.p = u.p(self.count[self.tokens])
        # For the next level: each token's context by its place in ctx_ids and ctx_counts, its lower count, what that count
        # is multiplied by, and the run of the context that it comes from.
        begins = np.zeros(len(self.tokens), bool)
        begins[self.first[:-1]] = True
        self.begins, self.ctx = begins, np.where(begins, I(n + 1), np.concatenate([np.array([n + 1], I), self.tokens[:-1]]))
        self.ctx_ids, self.ctx_counts = self.ids, self.word_counts
        self.low, self.norm = self.count[self.tokens], np.full(len(self.tokens), u.scale / max(u.tokens, 1))
        self.from_run, self.run_counts, self.few = np.zeros(len(self.tokens), I), np.zeros(0, np.int64), np.zeros((0, K_MAX))
        self.of_word = np.where(self.low > 0, self.tokens, I(n))
        by_id = np.argsort(self.ids, kind="stable")
        self.rank = np.empty(len(by_id), np.int64)
        self.rank[by_id] = np.arange(len(by_id))
        for level, reply in zip(levels, answers[1:], strict=True):
            self._grams()
            self._take(level, reply)

    def _grams(self) -> None:
        """Distinct n-grams of a context that occurs and a word, by bucket, context and word; unknown words are one."""
        ok = np.flatnonzero(self.ctx >= 0)
        ok = ok[self.ctx_counts[self.ctx[ok]] > 0]
        ctx, word = self.ctx[ok], self.of_word[ok]
        # Runs of one context in one bucket: of most contexts one, of hot ones one in each bucket where their words go.
        used = np.flatnonzero(np.bincount(ctx, minlength=len(self.ctx_ids)) > 0)
        used_ids = self.ctx_ids[used]
        where, run_ctx, run_home = np.empty(len(self.ctx_ids), I), used, used_ids % self.buckets
        where[used] = np.arange(len(used))
        run = where[ctx]
        hot = np.flatnonzero((self.ctx_counts[used] * (HOT * self.buckets) > self.u.tokens)[run])
        if len(hot):
            home = _home(mix(mix(used_ids[run[hot]].astype(U)) + self.ids[word[hot]].astype(U)), self.buckets)
            some, of = np.unique(run[hot] * self.buckets + home, return_inverse=True)
            run[hot] = len(used) + of
            run_ctx, run_home = np.append(used, used[some // self.buckets]), np.append(run_home, some % self.buckets)
        # The numbers of n-grams rise with their order in a bucket, so that above words this sorts what is nearly sorted.
        by = np.argsort(run_home * (int(used_ids.max(initial=0)) + 1) + self.ctx_ids[run_ctx], kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        key = place[run] * len(self.rank) + self.rank[word]
        order = np.argsort(key)
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        of = (np.cumsum(new) - 1).astype(I)
        #: Each token's n-gram, -1 where its context doesn't occur.
        self.gram = np.full(len(self.tokens), -1, I)
        self.gram[ok[order]] = of
        example = order[new]
        run = by[key[new] // len(self.rank)]
        ctx = run_ctx[run]
        self.home, self.ctx_id, self.word_id, self.ctx_count = run_home[run], self.ctx_ids[ctx], self.ids[word[example]], self.ctx_counts[ctx]
        self.is_hot = self.ctx_count * (HOT * self.buckets) > self.u.tokens
        self.gram_low, self.gram_norm, self.gram_from = self.low[ok[example]], self.norm[ok[example]], self.from_run[ok[example]]
        self.gram_times = np.add.reduceat(self.train[ok[order]].astype(np.int64), np.flatnonzero(new)) if len(order) else np.zeros(0, np.int64)
        head = np.ones(len(run), bool)
        head[1:] = run[1:] != run[:-1]
        self.heads, self.run = np.append(np.flatnonzero(head), len(run)), (np.cumsum(head) - 1).astype(I)
        self.cut = np.searchsorted(self.home, np.arange(self.buckets + 1))
        self.runs = np.searchsorted(self.heads, self.cut)

    def ask(self):
        """(bucket, bytes): contexts, whether they are hot, their shorter contexts' distinct factors, numbers of words; words, times, lower counts; counts and counts of counts that give the factors."""
        self._grams()
        for b in np.flatnonzero(np.diff(self.cut)):
            p, heads = slice(self.cut[b], self.cut[b + 1]), self.heads[self.runs[b] : self.runs[b + 1] + 1]
            at = heads[:-1]
            _, first, of = np.unique(self.gram_norm[at], return_index=True, return_inverse=True)
            lower = self.gram_from[at[first]] if len(self.few) else np.zeros(0, np.int64)
            # Numbers fall into a bucket and a place in it, which take less room apart.
            ctx, home, word, word_home = *np.divmod(self.ctx_id[at], self.buckets), *np.divmod(self.word_id[p], self.buckets)
            yield int(b), squeezed(_steps(ctx), home, self.is_hot[at], of, np.diff(heads), word, word_home, self.gram_times[p], self.gram_low[p], self.run_counts[lower], *self.few[lower].T.astype(np.int64))

    def _take(self, level: Level, reply: dict[int, bytes]) -> None:
        """Goes one level up with the answers to ask()."""
        n = len(self.home)
        total, ids, figures = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((len(self.heads) - 1, K_MAX + 1))
        for b, data in reply.items():
            count, index, sums, *few = loosened(data)
            p, r = slice(self.cut[b], self.cut[b + 1]), slice(self.runs[b], self.runs[b + 1])
            total[p] = count
            if len(index):
                ids[p][count > 0] = np.cumsum(index) * self.buckets + b
            figures[r, :-1] = np.stack(few, 1)
            wanted = np.minimum.reduceat(count, self.heads[r] - self.cut[b]) == 0
            figures[r, -1][wanted] = sums
        at = self.heads[:-1]
        hot = np.flatnonzero(self.is_hot[at])
        if len(hot):
            figures[hot] = level.figures[np.searchsorted(level.hot, self.ctx_id[at[hot]])]
        free, norm = _shares(self.ctx_count[at], figures[:, :-1], level.d)
        back = free / np.maximum(1 - figures[:, -1], 1e-12)
        has = self.gram >= 0
        gram = self.gram[has]
        run, count = self.run[gram], total[gram]
        self.p = self.p.copy()
        self.p[has] = np.where(count > 0, level.d[np.minimum(count, K_MAX + 1)] * count * norm[run], back[run] * self.p[has])
        self.norm, self.low = np.zeros(len(self.tokens)), np.zeros(len(self.tokens), np.int64)
        self.norm[has], self.low[has] = norm[run], count
        self.from_run[has], self.run_counts, self.few = run, self.ctx_count[at], figures[:, :-1]
        self.ctx_ids, self.ctx_counts = ids, total
        self.ctx = np.where(self.begins, I(-1), np.concatenate([np.array([-1], I), self.gram[:-1]]))

    def scores(self, row: dict, arrow_id: pa.DataType) -> pa.Table:
        count, at = self.count[self.tokens], self.first[:-1]
        plain = np.log10((count + 0.5) / (self.u.tokens + 0.5 * (self.u.kinds + 1)))
        add = lambda x: np.add.reduceat(x, at)  # noqa: E731  every text has its end
        return pa.table({"doc_id": pa.array(row["ids"], arrow_id), "held_out": pa.array(~np.asarray(row["train"], bool)), "n_tokens": pa.array(np.diff(self.first)), "n_known": pa.array(add((count > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(at), int(self.u.tokens))), "base_score": pa.array(add(plain)), "score": pa.array(add(np.log10(self.p)))})


class Bucket:
    """The questions of all slices to one bucket, worked on in ranges of contexts of about RANGE n-grams."""

    def __init__(self, parts: list[list[np.ndarray]], buckets: int, below: np.ndarray, word_factor: float):
        self.parts, self.below = parts, below
        self.ctx = [np.cumsum(p[0], dtype=np.int64) * buckets + p[1] for p in parts]
        self.factors = [_shares(p[9], np.stack(p[10:], 1), below)[1] if len(p[9]) else np.array([word_factor]) for p in parts]
        self.edges = [np.concatenate([[0], np.cumsum(p[4], dtype=np.int64)]) for p in parts]
        self.buckets, self.stats, self.seen, self.hot = buckets, np.zeros(K_MAX + 4), 0, []

    def replies(self, last: bool) -> list[bytes]:
        """To each slice: counts, numbers of what occurs, sums of contexts that need a weight, counts of counts."""
        out = [[] for _ in self.parts]
        ranges = -(-sum(int(e[-1]) for e in self.edges) // RANGE)
        some = np.sort(np.concatenate([c[:: max(1, ranges)] for c in self.ctx]))
        cuts = np.unique(some[(np.arange(1, ranges) * len(some)) // ranges])
        at = [np.concatenate([[0], np.searchsorted(c, cuts), [len(c)]]) for c in self.ctx]
        for i in range(len(cuts) + 1):
            for held, found in zip(out, self._range([(int(a[i]), int(a[i + 1])) for a in at]), strict=True):
                held.append(found)
        every = [[np.concatenate(column) for column in zip(*held, strict=True)] for held in out]
        return [squeezed(count, _steps(index[: 0 if last else None].astype(np.int64)), *rest) for count, index, *rest in every]

    def _range(self, runs: list[tuple[int, int]]) -> list[tuple]:
        """What replies() holds, of some contexts of each slice."""
        grams = [slice(e[a], e[b]) for e, (a, b) in zip(self.edges, runs, strict=True)]
        of_runs = lambda x: np.concatenate([c[a:b] for c, (a, b) in zip(x, runs, strict=True)])
        of_grams = lambda i: np.concatenate([p[i][g] for p, g in zip(self.parts, grams, strict=True)]).astype(np.int64)
        names, which = np.unique(of_runs(self.ctx), return_inverse=True)
        if not len(names):
            return [(np.zeros(0, np.uint8),) * 2 + (np.zeros(0),) + (np.zeros(0, np.uint8),) * K_MAX for _ in runs]
        sizes = of_runs([p[4] for p in self.parts]).astype(np.int64)
        ctx, word = np.repeat(which, sizes), of_grams(5) * self.buckets + of_grams(6)
        # One key where both parts fit into it.
        by = np.argsort(ctx * (int(word.max()) + 1) + word) if len(names) * (int(word.max()) + 1) < 1 << 63 else np.lexsort((word, ctx))
        ctx, word = ctx[by], word[by]
        new = np.ones(len(by), bool)
        new[1:] = (ctx[1:] != ctx[:-1]) | (word[1:] != word[:-1])
        at = np.flatnonzero(new)
        del word
        total = np.add.reduceat(of_grams(7)[by], at)
        of = np.empty(len(by), np.int64)
        of[by] = np.cumsum(new) - 1
        example, heads = by[at], group_edges(ctx[at])[:-1]  # every context has a word
        del ctx, new, by
        low, run = of_grams(8)[example], np.repeat(np.arange(len(sizes)), sizes)[example]
        p = self.below[np.minimum(low, K_MAX + 1)] * low * of_runs([f[q[3]] for f, q in zip(self.factors, self.parts, strict=True)])[run]
        hot = of_runs([q[2] for q in self.parts])[run[heads]] > 0
        del low, run, example
        seen = total > 0
        few = [_narrow(np.add.reduceat((total == r).astype(np.int64), heads)) for r in range(1, K_MAX + 1)]
        sums, index = np.add.reduceat(np.where(seen, p, 0.0), heads), np.where(seen, np.cumsum(seen) + self.seen, 0)
        self.seen += int(seen.sum())
        self.stats += _counts_of_counts(total)
        self.hot += [(int(names[i]), [*(float(f[i]) for f in few), float(sums[i])]) for i in np.flatnonzero(hot)]
        out, gram, row = [], 0, 0
        for (a, b), g, part in zip(runs, grams, self.parts, strict=True):
            n, mine = g.stop - g.start, of[gram : gram + g.stop - g.start]
            r, size = which[row : row + b - a], part[4][a:b].astype(np.int64)
            count = total[mine]
            wanted = np.minimum.reduceat(count, np.cumsum(size) - size) == 0 if n else np.zeros(0, bool)  # only what isn't found needs the context's weight
            out.append((_narrow(count), _narrow(index[mine][count > 0]), sums[r[wanted]], *(f[r] for f in few)))
            gram, row = gram + n, row + b - a
        return out


def _by_bucket(batches):
    """(bucket, [(slice, data)]) of rows that come sorted by bucket; holds one bucket."""
    now, held = None, []
    for batch in batches:
        column = batch.column("data")
        for i, (b, g) in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("slice").to_pylist(), strict=True)):
            if b != now and held:
                yield now, held
                held = []
            now = b
            held.append((g, column[i].as_py()))
    if held:
        yield now, held


def _counts_of_counts(total: np.ndarray) -> list[float]:
    """Tokens, kinds, and how many kinds occur 0, 1, ... K_MAX + 1 times."""
    few = np.bincount(np.minimum(total, K_MAX + 2), minlength=K_MAX + 3).astype(float)
    return [float(total.sum()), float((total > 0).sum()), *few[: K_MAX + 2]]


def katz_scores(docs: DataFrame, held_out, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; held_out is a condition on docs."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), (~F.coalesce(held_out, F.lit(False))).alias("train"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType
    arrow_id = to_arrow_type(id_type)
    sliced = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("slice", T.LongType()), T.StructField("size", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("train", T.ArrayType(T.BooleanType())), T.StructField("words", T.BinaryType()), T.StructField("tokens", T.BinaryType())])

    def cut(batches):
        def out():
            t = pa.concat_tables(held)
            train = np.asarray(t.column("train").combine_chunks().fill_null(True))
            distinct, times, *tokens = _slice_rows(t.column("text"), train)
            name, kinds = uuid.uuid4().int >> 65, (pa.int32(), pa.int64(), pa.int64(), pa.list_(arrow_id), pa.list_(pa.bool_()), pa.binary(), pa.binary())
            rows = (0, name, size, None, None, squeezed(_steps(distinct), times), None), (1, name, None, t.column("doc_id").to_pylist(), train.tolist(), None, squeezed(*tokens))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=sliced.names)

        held, size = [], 0
        for batch in batches:
            for a, b, buf, _ in text_slices(batch.column("text"), SLICE):
                if held and size + len(buf) > SLICE:
                    yield out()
                    held, size = [], 0
                held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
                size += len(buf)
        if held:
            yield out()

    words, slices = checkpointed_parts(rows.mapInArrow(cut, sliced), "kind", 0, 1, codec=PLAIN)
    size = words.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = max(shuffle_partitions(spark), -(-size // BUCKET))
    unclustered, slices = slices, clustered(slices.select("slice", "ids", "train", "tokens"), "slice", buckets, PLAIN)
    discard(unclustered)

    def answered(asked: DataFrame, answer) -> DataFrame:
        """Each bucket's questions answered in one place, a bucket a partition or so."""
        return checkpointed(asked.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(answer, ANSWER_DDL), PLAIN)

    def stats_of(answers: DataFrame) -> list[float]:
        """Sums over buckets of what they counted; a row a bucket, summed up by Spark."""
        r = answers.where("kind = 1").agg(*[F.coalesce(F.sum(F.get("stats", F.lit(i))), F.lit(0.0)) for i in range(K_MAX + 4)]).first()
        return [float(x) for x in r]

    def ask_words(batches):
        for batch in batches:
            for name, data in zip(batch.column("slice").to_pylist(), batch.column("words").to_pylist(), strict=True):
                steps, times = loosened(data)
                hashes = np.cumsum(steps).view(U)
                cut = np.searchsorted(_home(hashes, buckets), np.arange(buckets + 1))
                yield blob_batch([(int(b), name, squeezed(_steps(hashes[cut[b] : cut[b + 1]]), times[cut[b] : cut[b + 1]])) for b in np.flatnonzero(np.diff(cut))], ASK)

    def answer_words(batches):
        for b, asked in _by_bucket(batches):
            parts = [loosened(data) for _, data in asked]
            _, of = np.unique(np.concatenate([np.cumsum(p[0]) for p in parts]).view(U), return_inverse=True)
            total = np.bincount(of, np.concatenate([p[1] for p in parts])).astype(np.int64)
            by_count = np.argsort(-total, kind="stable")  # frequent words have small numbers
            rank = np.empty(len(total), np.int64)
            rank[by_count] = np.arange(1, len(total) + 1)
            rank[total == 0] = 0
            edges = np.cumsum([0, *(len(p[0]) for p in parts)])
            out = [(0, g, b, squeezed(total[of[x:y]], rank[of[x:y]]), None, None) for (g, _), x, y in zip(asked, edges[:-1], edges[1:], strict=True)]
            yield blob_batch([*out, (1, None, b, None, _counts_of_counts(total), None)], ANSWER)

    def replies(answers: DataFrame, level: int) -> DataFrame:
        return answers.where("kind = 0").select("slice", F.lit(level).alias("level"), "bucket", "data")

    answers = answered(words.select("slice", "words").mapInArrow(ask_words, ASK_DDL), answer_words)
    discard(words)
    tokens, kinds, *few = stats_of(answers)
    u, levels = Unigrams.of(tokens, kinds, few), []
    known = clustered(replies(answers, 0), "slice", buckets, PLAIN)
    discard(answers)

    def with_answers(run, ddl):
        """run(slice's row, its answers by level), a slice at a time."""
        n = len(levels) + 1

        def both(t: pa.Table, replies: pa.Table) -> pa.Table:
            if not t.num_rows:
                return run(None, None)
            (row,), mine = t.to_pylist(), [{} for _ in range(n)]
            data = replies.column("data")
            for i, (level, b) in enumerate(zip(replies.column("level").to_pylist(), replies.column("bucket").to_pylist(), strict=True)):
                mine[level][b] = data[i].as_py()
            return run(row, mine)

        return slices.groupBy("slice").cogroup(known.groupBy("slice")).applyInArrow(both, ddl)

    for k in range(2, order + 1):
        below, shared = (levels[-1].d if levels else u.d), spark.sparkContext.broadcast((u, levels))

        def ask(row, mine, shared=shared):
            asked = [] if row is None else [(b, row["slice"], data) for b, data in Slice(row, mine, buckets, *shared.value).ask()]
            return pa.Table.from_batches([blob_batch(asked, ASK)])

        def answer(batches, below=below, word_factor=u.scale / max(u.tokens, 1), last=k == order):
            for b, asked in _by_bucket(batches):
                names, bucket = [g for g, _ in asked], Bucket([loosened(data, narrow=True) for _, data in asked], buckets, below, word_factor)
                del asked
                replies = bucket.replies(last)
                out = [(0, g, b, data, None, None) for g, data in zip(names, replies, strict=True)]
                out += [(2, None, b, None, figures, context) for context, figures in bucket.hot]
                yield blob_batch([*out, (1, None, b, None, bucket.stats.tolist(), None)], ANSWER)

        answers = answered(with_answers(ask, ASK_DDL), answer)
        sums = [F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(K_MAX + 1)]
        hot = sorted(tuple(r) for r in answers.where("kind = 2").groupBy("context").agg(*sums).toLocalIterator())  # at most HOT contexts a bucket
        levels = [*levels, Level(discounts(stats_of(answers)[2:]), np.array([r[0] for r in hot], np.int64), np.array([r[1:] for r in hot], float).reshape(-1, K_MAX + 1))]
        both = known.unionByName(replies(answers, k - 1))
        if k < order:
            both = clustered(both, "slice", buckets, PLAIN)
            discard(known, answers)
        known = both

    fields = [("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    schema, shared = T.StructType([T.StructField("doc_id", id_type), *[T.StructField(n, t) for n, t in fields]]), spark.sparkContext.broadcast((u, levels))

    def score(row, mine):
        if row is None:
            return pa.table({n: pa.array([], f) for n, f in zip(schema.names, [arrow_id, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()], strict=True)})
        return Slice(row, mine, buckets, *shared.value).scores(row, arrow_id)

    return with_answers(score, schema)


def op9_katz_scores(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT
    return katz_scores(docs, held)
