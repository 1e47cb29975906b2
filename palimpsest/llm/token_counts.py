"""Token counts of byte-pair encodings by rank-synchronous array merging.

The distinct pre-tokens of a batch are held as one ragged array of symbols. In
each round every sequence finds its lowest rank, and all its pairs of that rank
merge at once, from the left and without overlap; sequences without a pair that
can merge leave. A merge whose new symbol forms a pair of the same or a lower
rank with a neighbour is the last one of its sequence in a round, since that pair
comes next; so rounds give what merging one pair at a time gives, and there are
few more of them than ranks in a sequence, however long it is. What survives is
counted, and the counts go back to the texts by their pre-tokens.

The model file is one of the library's own, read by its published layout: the
vocabulary, its scores and the normaliser. A pair's rank is that of the piece
that it makes, by falling score. No piece holds a space after another character,
so a text falls into pre-tokens before each run of spaces, and around characters
that stand in no longer piece; merging never crosses these bounds. A character
outside the vocabulary counts as its bytes.

Defined cases: null and empty texts have no bytes and no tokens; repeated rows
are counted each.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .kernels import hash_words, ragged, text_slices

LIMIT, CACHED = 4096, 400_000
NONE = np.int64(1 << 62)


def _fields(b: bytes):
    """(number, value) of the fields of a protocol-buffer message."""

    def number(i):
        n = shift = 0
        while True:
            n |= (b[i] & 0x7F) << shift
            i, shift = i + 1, shift + 7
            if b[i - 1] < 0x80:
                return n, i

    i = 0
    while i < len(b):
        key, i = number(i)
        if key & 7 == 0:
            value, i = number(i)
        else:
            size, i = {1: lambda i: (8, i), 2: number, 5: lambda i: (4, i)}[key & 7](i)
            value, i = b[i : i + size], i + size
        yield key >> 3, value


class PieceModel:
    """Symbols, merges and counts of a byte-pair model with byte fallback."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        trainer, norm = (dict(_fields(next((v for k, v in model if k == n), b""))) for n in (2, 3))
        if trainer.get(3) != 2 or not trainer.get(35) or norm.get(2) or norm.get(4, 1) or not norm.get(3, 1) or not norm.get(5, 1):
            raise ValueError("this counts byte-pair models with byte fallback, a dummy prefix and no other normalisation")
        pieces = [dict(_fields(v)) for k, v in model if k == 1]
        if any(p.get(3, 1) not in (1, 2, 3, 6) for p in pieces):
            raise ValueError("user-defined and unused pieces aren't counted")
        score = {p[1].decode(): struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in pieces if p.get(3, 1) == 1}
        if any("▁" in x.lstrip("▁") for x in score):
            raise ValueError("a piece crosses a space")
        chars = sorted({c for x in score for c in x})
        symbols = {x: i for i, x in enumerate(dict.fromkeys([*score, *chars]))}
        ranks = {s: i for i, s in enumerate(sorted(set(score.values()), reverse=True))}
        n = len(symbols)
        self.of_char = np.empty(0x110000, np.int32)
        for k, (lo, hi) in enumerate(((0, 0x80), (0x80, 0x800), (0x800, 0x10000), (0x10000, 0x110000))):
            self.of_char[lo:hi] = n + k  # a stranger of k + 1 bytes
        for c in chars:
            self.of_char[ord(c)] = symbols[c]
        self.of_char[0x20] = symbols["▁"]
        self.counts = np.array([1 if x in score else len(x.encode()) for x in symbols] + [1, 2, 3, 4], np.int64)
        pairs = sorted((symbols[x[:i]] << 20 | symbols[x[i:]], ranks[score[x]], symbols[x]) for x in score for i in range(1, len(x)) if x[:i] in symbols and x[i:] in symbols)
        self.keys, self.ranks, self.made = (np.array(v, np.int64) for v in zip(*pairs, strict=True))
        longer = {c for x in score if len(x) > 1 for c in x}
        #: ASCII bytes, save the space, that stand in no longer piece.
        self.alone = np.array([b < 0x80 and b != 0x20 and chr(b) not in longer for b in range(256)])

    def _pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, symbol) of pairs; NONE where they don't merge."""
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.made[at]

    def count_sequences(self, symbols: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Tokens of each sequence of symbols, off[i] to off[i + 1]."""
        out = np.zeros(len(off) - 1, np.int64)
        ids = np.flatnonzero(np.diff(off))
        n, sym = np.diff(off)[ids], symbols.astype(np.int64)
        start = np.concatenate([[0], np.cumsum(n)])
        rank, made = self._pair(sym[:-1], sym[1:]) if len(sym) > 1 else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        rank, made = np.append(rank, NONE)[: len(sym)], np.append(made, 0)[: len(sym)]
        rank[start[1:] - 1] = NONE
        while len(ids):
            best = np.minimum.reduceat(rank, start[:-1])
            live = best < NONE
            if not live.all():
                done = np.repeat(~live, n)
                out[ids[~live]] = np.bincount(np.repeat(np.arange(len(ids)), n)[done], self.counts[sym[done]], len(ids))[~live].astype(np.int64)
                ids, n, best = ids[live], n[live], best[live]
                sym, rank, made = sym[~done], rank[~done], made[~done]
                start = np.concatenate([[0], np.cumsum(n)])
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(best, n))
            # Of a run of overlapping pairs every other one merges, from the left.
            new = np.ones(len(at), bool)
            new[1:] = at[1:] != at[:-1] + 1
            head = np.flatnonzero(new)
            at = at[(at - np.repeat(at[head], np.diff(np.append(head, len(at))))) % 2 == 0]
            seq = np.searchsorted(start, at, "right") - 1
            at = at[self._first_merges(sym, made, start, best, at, seq)]
            seq = np.searchsorted(start, at, "right") - 1
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            ends = at + 2 == start[seq + 1]
            begins = at == start[seq]
            at = at - np.arange(len(at))  # a symbol of each merge before has gone
            sym, rank, made = sym[keep], rank[keep], made[keep]
            n = n - np.bincount(seq, minlength=len(n))
            start = np.concatenate([[0], np.cumsum(n)])
            rank[at[ends]] = NONE
            for p in (at[~ends], at[~begins] - 1):
                rank[p], made[p] = self._pair(sym[p], sym[p + 1])
        return out

    def _first_merges(self, sym, made, start, best, at, seq) -> np.ndarray:
        """Which of the pairs `at` merge in this round: those up to the first whose new symbol has to merge next."""
        s, r = made[at], best[seq]
        left = at > start[seq]
        l = sym[np.maximum(at - 1, 0)]
        after = np.zeros(len(at), bool)
        after[1:] = at[1:] == at[:-1] + 2
        after &= left  # the pair before has merged into the symbol on the left
        l[after] = s[np.flatnonzero(after) - 1]
        right = at + 2 < start[seq + 1]
        urgent = left & (self._pair(l, s)[0] <= r)
        urgent |= right & (self._pair(s, sym[np.minimum(at + 2, len(sym) - 1)])[0] <= r)
        if not urgent.any():
            return np.ones(len(at), bool)
        before = np.cumsum(urgent) - urgent
        first = np.searchsorted(seq, seq)  # each sequence's first pair
        return before == before[first]


class Counter:
    """Counts texts, and keeps counts of pre-tokens it has seen, up to a fixed number."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.seen, self.known = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _distinct(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of pre-tokens, given as spans of bytes."""
        n = ends - starts
        chars = buf[ragged(starts, n)]
        lead = (chars & 0xC0) != 0x80
        symbols = self.model.of_char[np.frombuffer(chars.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
        return self.model.count_sequences(symbols, np.concatenate([[0], np.cumsum(lead)])[np.concatenate([[0], np.cumsum(n)])])

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, tokens) of each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = np.asarray(pc.binary_length(texts)).astype(np.int64)
        texts, tokens = pc.replace_substring(texts, "▁", " "), np.zeros(len(texts), np.int64)
        for first, last, buf, off in text_slices(texts):
            some = np.flatnonzero(np.diff(off))
            buf = np.insert(buf, off[some], 0x20)  # the dummy prefix
            off = off + np.concatenate([[0], np.cumsum(np.diff(off) > 0)])
            space, alone = buf == 0x20, self.model.alone[buf]
            cut = np.zeros(len(buf) + 1, bool)
            cut[1:-1] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
            cut[off] = True
            cut[-1] = False
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], len(buf))[: len(starts)]
            h = hash_words(buf, starts, ends)
            order = np.argsort(h, kind="stable")
            sorted_h = h[order]
            new = np.ones(len(h), bool)
            new[1:] = sorted_h[1:] != sorted_h[:-1]
            distinct, example = sorted_h[new], order[new]
            at = np.minimum(np.searchsorted(self.seen, distinct), max(0, len(self.seen) - 1))
            hit = self.seen[at] == distinct if len(self.seen) else np.zeros(len(distinct), bool)
            n = np.zeros(len(distinct), np.int64)
            n[hit] = self.known[at[hit]] if len(self.seen) else 0
            n[~hit] = self._distinct(buf, starts[example[~hit]], ends[example[~hit]])
            if len(self.seen) + (~hit).sum() > CACHED:
                self.seen, self.known = distinct[:CACHED], n[:CACHED]
            else:
                seen, known = np.concatenate([self.seen, distinct[~hit]]), np.concatenate([self.known, n[~hit]])
                by = np.argsort(seen)
                self.seen, self.known = seen[by], known[by]
            each = np.empty(len(h), np.int64)
            each[order] = n[np.cumsum(new) - 1]
            total = np.concatenate([[0], np.cumsum(each)])[np.searchsorted(starts, off)]
            tokens[first:last] = np.diff(total)
        return size, tokens


def with_token_counts(docs: DataFrame, model_path: str, limit: int = LIMIT, text_col: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens (long) and over_limit; columns of docs so named are replaced."""
    new = [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())]
    shared = docs.sparkSession.sparkContext.broadcast(PieceModel(model_path))
    out = docs.select(*[c for c in docs.columns if c not in {n for n, _ in new}])

    def run(batches):
        counter = Counter(shared.value)
        for batch in batches:
            size, tokens = counter.counts(batch.column(batch.schema.get_field_index(text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), pa.array(tokens), pa.array(tokens > limit)], names=[*batch.schema.names, *[n for n, _ in new]])

    return out.mapInArrow(run, T.StructType([*out.schema.fields, *[T.StructField(n, t) for n, t in new]]))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", F.col("over_limit"))
