"""Array kernels over text: words, hashes and shingles of whole Arrow batches.

A batch of texts is one byte array and one offset array, as Arrow holds it.
Everything below works on those arrays at once, without a Python object per
word. Separators and letters are ASCII, so cutting bytes never cuts a UTF-8
character. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that a kernel holds at once; longer single texts are held whole.
SLICE_BYTES = 3_000_000
#: Odd multipliers of the hashes; any odd numbers do.
P_BYTE, P_WORD, P_SET = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of a word `[^\x20\x09-\x0D]+`.
WORD = ~SPACE
#: Bytes of a word `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit hangs on every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * P_BYTE)
_powers = [np.ones(1, U), np.ones(1, U)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P_BYTE ** i and its inverse modulo 2 ** 64, for i < n."""
    if len(_powers[0]) < n:
        n = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((int(P_BYTE), pow(int(P_BYTE), -1, 1 << 64))):
            p = np.full(n, U(base))
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _powers[k] = p
    return _powers[0], _powers[1]


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of consecutive texts of about `most` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, to, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def words_of(buf: np.ndarray, off: np.ndarray, kind: np.ndarray = WORD, lower: bool = False):
    """(bytes, starts, ends, first): the words' byte spans, and each text's first word (n + 1 numbers)."""
    if lower:
        buf = LOWER[buf]
    n = len(buf)
    m = kind[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    prev = np.empty(n, bool)
    prev[:1] = False
    prev[1:] = m[:-1]
    starts = np.flatnonzero(m & (~prev | edge[:-1]))
    nxt = np.empty(n, bool)
    nxt[-1:] = False
    nxt[:-1] = m[1:]
    ends = np.flatnonzero(m & (~nxt | edge[1:])) + 1
    return buf, starts, ends, np.searchsorted(starts, off)


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    p, inv = _powers_to(len(buf) + 1)
    c = np.zeros(len(buf) + 1, U)
    np.cumsum(_BYTE[buf] * p[: len(buf)], out=c[1:])
    return mix((c[ends] - c[starts]) * inv[starts] + (ends - starts).astype(U))


def hash_windows(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k words in a row, across texts too: the caller drops those that cross."""
    n = max(0, len(words) - k + 1)
    h = np.full(n, U(k))
    for j in range(k):
        h *= P_WORD
        h += words[j : j + n]
    return mix(h)


def window_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, text) of every k words in a row that lie in one text."""
    n = np.diff(first)
    left = np.repeat(first[1:], n) - np.arange(first[0], first[-1])
    at = np.flatnonzero(left >= k)
    return at, np.repeat(np.arange(len(n)), n)[at]


def shingle_sets(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each text's sorted distinct k-word shingles; under k words the whole sequence is one."""
    at, doc = window_starts(first, k)
    h = hash_windows(words, k)[at]
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        own = np.array([int(hash_windows(words[first[i] : first[i + 1]], int(n[i]))[0]) for i in short], U)
        h, doc = np.concatenate([h, own]), np.concatenate([doc, short])
    order = np.lexsort((h, doc)) if len(short) else None
    if order is None:
        cut = np.searchsorted(doc, np.arange(len(n) + 1))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            h[a:b].sort()
    else:
        h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.searchsorted(doc[keep], np.arange(len(n) + 1))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers starts[i], ..., starts[i] + lengths[i] - 1, of all i in a row."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def group_runs(hit: np.ndarray, first: np.ndarray, least: int):
    """(text, from, to) of the stretches of at least `least` words with hit, as word numbers within their text."""
    edge = np.zeros(len(hit) + 1, bool)
    edge[first] = True
    begins = np.flatnonzero(hit & (np.concatenate([[True], ~hit[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(hit & (np.concatenate([~hit[1:], [True]]) | edge[1:])) + 1
    keep = ends - begins >= least
    begins, ends = begins[keep], ends[keep]
    text = np.searchsorted(first, begins, "right") - 1
    return zip(text.tolist(), (begins - first[text]).tolist(), (ends - first[text]).tolist(), strict=True)
