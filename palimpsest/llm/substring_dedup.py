"""Substring deduplication by seed and extend on winnowed anchors.

A repeat is a run of words that also stands in a document with a smaller id. Of
every `length` consecutive words, winnowing marks at least one `seed`-word gram
as an anchor, the one with the smallest hash, in every copy the same. So a
repeat of `length` words shows as a shared anchor, and the work is:

1. anchors of all texts meet by hash; those found in two documents are seeds;
2. each seed is extended both ways within its text to all windows of `length`
   words that hold it, and the windows meet by hash, which gives the smallest
   id that has them;
3. windows that a smaller id has are united to maximal repeats and cut out.

Texts are exchanged once, in groups by row, and that exchange is read three
times. Anchors and windows travel as packed arrays. What occurs twice within a
group is settled there, and one record of it is sent on, so that a passage found
in a third of all documents costs one record a group and no pair of documents is
ever formed.

Defined cases: null and empty texts have no words and stay as they are; equal
texts under different ids lose all their windows but in the smallest id; rows
that repeat an id don't remove each other's words; rows without an id come after
all ids, and not before each other.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NO_ID, blob_batch, buckets_of, group_edges, in_groups, of_group, pack, unpack
from .kernels import U, hash_windows, hash_words, mix, text_slices, window_starts, words_of

#: h: hash of an anchor or window; uid: the row; ord: its id; pos: its first word. pos is -1 where the row itself is settled.
ANCHOR = np.dtype([("h", "u8"), ("uid", "i8"), ("pos", "i4")])
WINDOW = np.dtype([("h", "u8"), ("uid", "i8"), ("ord", "i8"), ("pos", "i4")])
FOUND = np.dtype([("uid", "i8"), ("pos", "i4")])
PACKED = pa.schema([("bucket", pa.int32()), ("found", pa.bool_()), ("data", pa.binary())])
REPLY = pa.schema([("g", pa.int32()), ("data", pa.binary())])


def _slide(x: np.ndarray, k: int, op) -> np.ndarray:
    """op over every k values in a row."""
    n, have = len(x) - k + 1, 1
    while have < k:
        step = min(have, k - have)
        x = op(x[: len(x) - step], x[step:])
        have += step
    return x[:n]


def winnow(words: np.ndarray, first: np.ndarray, seed: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first word within the text) of the anchors."""
    n, w = len(words), length - seed + 1
    at, _ = window_starts(first, length)
    if not len(at):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = hash_windows(words, seed)
    least = np.zeros(n - length + 1, U)
    least[at] = _slide(grams, w, np.minimum)[at]
    padded = np.zeros(len(grams) + w - 1, U)
    padded[w - 1 : w - 1 + len(least)] = least
    pos = np.flatnonzero((_slide(padded, w, np.maximum) == grams) & (grams > 0))
    text = np.searchsorted(first, pos, "right") - 1
    return grams[pos], text, pos - first[text]


def _settle_anchors(a: np.ndarray, n: int, groups: int):
    """Splits anchors into those known to be shared and those to be sent on."""
    a = a[np.argsort(a["h"], kind="stable")]
    cut = group_edges(a["h"])
    if len(a):
        lo, hi = (f.reduceat(a["uid"], cut[:-1]) for f in (np.minimum, np.maximum))
        shared = np.repeat(lo != hi, np.diff(cut))
        heads = a[cut[:-1][lo != hi]]
        heads["pos"] = -1
        found, rest = a[shared], np.concatenate([a[~shared], heads])
    else:
        found = rest = a
    for b, x in pack((rest["h"] % U(n)).astype(np.int64), rest, n):
        yield b, False, x
    yield from _found(found["uid"], found["pos"], n)


def _found(uid: np.ndarray, pos: np.ndarray, n: int):
    f = np.empty(len(uid), FOUND)
    f["uid"], f["pos"] = uid, pos
    for b, x in pack((mix(f["uid"].view(U)) % U(n)).astype(np.int64), f, n):
        yield b, True, x


def _settle_windows(w: np.ndarray, n: int):
    w = w[np.argsort(w["h"], kind="stable")]
    cut = group_edges(w["h"])
    if len(w):
        lo = np.repeat(np.minimum.reduceat(w["ord"], cut[:-1]), np.diff(cut))
        found, rest = w[w["ord"] > lo], w[w["ord"] == lo]
    else:
        found = rest = w
    for b, x in pack((rest["h"] % U(n)).astype(np.int64), rest, n):
        yield b, False, x
    yield from _found(found["uid"], found["pos"], n)


def _group_of(uid: np.ndarray, groups: int) -> np.ndarray:
    return uid % groups


def substring_dedup(docs: DataFrame, seed: int = 7, length: int = 13, join_kept: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with their texts' repeats cut out.

    Columns of docs, with the kept words joined by one space as text, and
    n_words, n_removed (long) and repeats (array of first and last word of each
    maximal repeat); columns of docs so named are replaced by these. Without
    join_kept, texts of which nothing is cut stay as they are.
    """
    n = groups = buckets_of(docs)
    rest = [c for c in docs.columns if c not in (text_col, "n_words", "n_removed", "repeats")]
    ident: Column = F.col(id_col).cast("long")
    rows = docs.select(
        F.struct(*[F.col(c) for c in rest]).alias("rest"),
        F.col(text_col).cast("string").alias("text"),
        F.xxhash64(ident, F.col(text_col)).alias("uid"),
        F.coalesce(ident, F.lit(NO_ID)).alias("ord"),
    ).withColumn("g", F.pmod("uid", F.lit(groups)).cast("int"))

    def anchors(batches):
        held, size = [], 0
        for batch in batches:
            uid = np.asarray(batch.column("uid"))
            for a, b, buf, off in text_slices(batch.column("text")):
                buf, s, e, first = words_of(buf, off)
                h, text, pos = winnow(hash_words(buf, s, e), first, seed, length)
                out = np.empty(len(h), ANCHOR)
                out["h"], out["uid"], out["pos"] = h, uid[a:b][text], pos
                held.append(out)
                size += len(out)
            if size > 2_000_000:
                yield from (blob_batch([r], PACKED) for r in _settle_anchors(np.concatenate(held), n, groups))
                held, size = [], 0
        if held:
            yield blob_batch(list(_settle_anchors(np.concatenate(held), n, groups)), PACKED)

    def replies(batches, dtype, settle):
        """What meets in one partition: records that are found to be shared go back to their rows' groups."""
        found, rest = [], []
        for batch in batches:
            for done, x in zip(batch.column("found").to_pylist(), batch.column("data").to_pylist(), strict=True):
                (found if done else rest).append(x)
        out, rest = unpack(found, FOUND), unpack(rest, dtype)
        more = settle(rest[np.argsort(rest["h"], kind="stable")])
        uid, pos = np.concatenate([out["uid"], more["uid"]]), np.concatenate([out["pos"], more["pos"]])
        f = np.empty(len(uid), FOUND)
        f["uid"], f["pos"] = uid, pos
        yield blob_batch(list(pack(_group_of(f["uid"], groups), f, groups)), REPLY)

    def shared_anchors(a):
        if not len(a):
            return a
        cut = group_edges(a["h"])
        many = np.minimum.reduceat(a["uid"], cut[:-1]) != np.maximum.reduceat(a["uid"], cut[:-1])
        head = np.maximum.reduceat(a["pos"] == -1, cut[:-1])
        return a[np.repeat(many | head, np.diff(cut)) & (a["pos"] >= 0)]

    def later_windows(w):
        if not len(w):
            return w
        cut = group_edges(w["h"])
        return w[w["ord"] > np.repeat(np.minimum.reduceat(w["ord"], cut[:-1]), np.diff(cut))]

    def positions(table: pa.Table) -> dict[int, np.ndarray]:
        f = unpack(table.column("data").to_pylist(), FOUND)
        f = f[np.argsort(f["uid"], kind="stable")]
        cut = group_edges(f["uid"])
        return {int(f["uid"][a]): f["pos"][a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)}

    def windows(texts: pa.Table, seeds: pa.Table) -> pa.Table:
        at, texts = positions(seeds), of_group(texts)
        if texts is None or not at:
            return pa.Table.from_batches([], PACKED)
        uids, ords = (np.asarray(texts.column(c)) for c in ("uid", "ord"))
        some = np.flatnonzero(np.isin(uids, np.fromiter(at, np.int64, len(at))))
        held = []
        for a, b, buf, off in text_slices(texts.column("text").take(pa.array(some))):
            buf, s, e, first = words_of(buf, off)
            words = hash_words(buf, s, e)
            whole = hash_windows(words, length)
            for i in range(b - a):
                row = some[a + i]
                last = first[i + 1] - first[i] - length
                if last < 0:
                    continue
                hit = np.zeros(last + 2, np.int64)  # windows that hold an anchor: from anchor - (length - seed) on
                p = at[int(uids[row])]
                np.add.at(hit, np.clip(p - (length - seed), 0, last + 1), 1)
                np.add.at(hit, np.clip(p + 1, 0, last + 1), -1)
                pos = np.flatnonzero(np.cumsum(hit)[: last + 1] > 0)
                out = np.empty(len(pos), WINDOW)
                out["h"], out["uid"], out["ord"], out["pos"] = whole[first[i] + pos], uids[row], ords[row], pos
                held.append(out)
        return pa.Table.from_batches([blob_batch(list(_settle_windows(np.concatenate(held), n)) if held else [], PACKED)])

    kept_type = T.StructType([T.StructField("rest", rows.schema["rest"].dataType), T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("repeats", T.ArrayType(T.ArrayType(T.LongType())))])

    def cut_out(texts: pa.Table, hits: pa.Table) -> pa.Table:
        at, texts = positions(hits), of_group(texts)
        out, n_words, n_removed, repeats = [], [], [], []
        for uid, text in zip(texts.column("uid").to_pylist(), texts.column("text"), strict=True):
            raw = bytes(text.as_buffer()) if text.is_valid else None
            words = raw.split() if raw else []
            pos = at.get(uid)
            spans = []
            if pos is not None:
                mark = np.zeros(len(words) + 1, np.int64)
                pos = np.unique(pos)
                np.add.at(mark, pos, 1)
                np.add.at(mark, pos + length, -1)
                gone = np.cumsum(mark)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans = [[int(a), int(b) - 1] for a, b in edges.reshape(-1, 2)]
                n_words.append(len(words))
                words = list(compress(words, ~gone))
                n_removed.append(int(gone.sum()))
            else:
                n_words.append(len(words))
                n_removed.append(0)
            out.append(b" ".join(words) if join_kept or pos is not None else raw)
            repeats.append(spans)
        rest = texts.column("rest").combine_chunks()
        return pa.table({"rest": rest, "text": pa.array(out, pa.binary()).cast(pa.string()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "repeats": pa.array(repeats, pa.list_(pa.list_(pa.int64())))})

    packed_ddl, reply_ddl = "bucket int, found boolean, data binary", "g int, data binary"
    texts = in_groups(rows, "g", groups).groupBy("g")
    seeds = rows.select("uid", "text").mapInArrow(anchors, packed_ddl).repartition("bucket").mapInArrow(lambda b: replies(b, ANCHOR, shared_anchors), reply_ddl)
    found = texts.cogroup(seeds.groupBy("g")).applyInArrow(windows, packed_ddl).repartition("bucket").mapInArrow(lambda b: replies(b, WINDOW, later_windows), reply_ddl)
    out = texts.cogroup(found.groupBy("g")).applyInArrow(cut_out, kept_type)
    return out.select(*[F.col("rest")[c].alias(c) if c != text_col else F.col("text").alias(text_col) for c in docs.columns if c in rest or c == text_col], "n_words", "n_removed", "repeats")


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    kept = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: Words that a window covers whose sequence starts in a smaller id too.
OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), win AS (
  SELECT doc_id, p AS pos, md5(array_to_string(words[p:p + 12], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 11, 1))) AS p FROM w)
), least AS (SELECT h, min(doc_id) AS d FROM win GROUP BY h),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS p FROM win JOIN least USING (h) WHERE d < doc_id
), g AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN g.n IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(g.ps, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""
