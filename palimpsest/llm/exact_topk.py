"""Exact top-k search by inner product with vector-approximation files.

Vectors hold integers, floor(scale * x). Each task reads its vectors in slabs.
A slab's approximation is a grid of 2 ** BITS cells in each dimension, whose
codes bound every score from above: a query's positive parts meet the cells'
upper edges, its negative parts the lower ones. For each query the codes are
scanned first, and then exact vectors are read by falling bound until no bound
reaches the kth best score found so far; what ties with it is read too, so that
ties go to the smaller id. A query's best of all tasks meet by its id.

Queries are rows whose id is divisible by `every`, sent to all tasks in blocks of
at most BLOCK rows, one pass over the vectors for each block; with several
blocks each one's answers are written and its queries let go before the next.

Defined cases: vectors that are null, empty or hold a null or a component that
isn't finite take no part, nor do rows without id; a row never answers a query
of its own id; repeated rows answer each, and repeated queries are asked once;
vectors of another length than the query's don't answer it; a query with fewer
than k rows to answer it gets them all. Scores beyond 2 ** 63 aren't held.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

K, SCALE, EVERY = 20, 64, 20
BITS, SLAB, BLOCK, TOGETHER, READ = 5, 8192, 32768, 256, 64


def as_integers(column: pa.Array, ids: pa.Array, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, floor(scale * x)) of the vectors that take part, by length."""
    column, ids = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (column, ids))
    n = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0)).astype(np.int64)
    flat = np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan), np.float64)
    start = np.cumsum(n) - n
    ok, out = np.asarray(ids.is_valid()) & (n > 0), {}
    ids = np.asarray(ids.cast(pa.int64()).fill_null(0))
    for size in np.unique(n[ok]):
        rows = np.flatnonzero(ok & (n == size))
        v = np.floor(flat[start[rows][:, None] + np.arange(size)] * scale)
        fine = np.isfinite(v).all(1)
        out[int(size)] = ids[rows[fine]], v[fine]
    return out


class Slab:
    """Some vectors of one length, and the cells that approximate them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bits: int = BITS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        low, high = self.vectors.min(0), self.vectors.max(0)
        self.low, self.width = low, np.maximum(1, np.ceil((high - low + 1) / (1 << bits)))
        self.codes = ((self.vectors - low) // self.width).astype(np.uint8)
        self.top = max(abs(low).max(), abs(high).max())

    def search(self, q: np.ndarray, q_ids: np.ndarray, k: int, best: list[list[tuple[int, int]]]) -> None:
        """Puts the best (-score, id) of self for each query into best."""
        size = float(abs(q).max(initial=0) * (self.top + self.width.max()) * q.shape[1])
        kind = np.float32 if size < 2**24 else np.float64 if size < 2**53 else np.int64
        # A cell's upper edge for a query: its code times the width, and where the query is positive the rest of the width.
        codes, width, last = self.codes.astype(kind).T, self.width.astype(kind), (self.width - 1).astype(kind)
        q, low = q.astype(kind), self.low.astype(kind)
        for a in range(0, len(q), TOGETHER):
            part = q[a : a + TOGETHER]
            bound = (part * width) @ codes
            bound += (part @ low + np.maximum(part, 0) @ last)[:, None]
            for i, b in enumerate(bound):
                mine, unread = best[a + i], np.ones(len(b), bool)

                def read(rows, i=i, mine=mine, unread=unread):
                    unread[rows] = False
                    score = self.vectors[rows].astype(kind) @ part[i]
                    ok = self.ids[rows] != q_ids[a + i]
                    mine.extend(zip((-score[ok]).astype(np.int64).tolist(), self.ids[rows][ok].tolist(), strict=True))
                    mine.sort()
                    del mine[k:]

                if len(mine) < k and len(b) > 2 * (k + READ):
                    read(np.argpartition(-b, k + READ)[: k + READ])  # the highest bounds, for a first kth best
                rows = np.flatnonzero(unread & (b >= -mine[k - 1][0]) if len(mine) >= k else unread)
                rows = rows[np.argsort(-b[rows], kind="stable")]
                for at in range(0, len(rows), READ):
                    if len(mine) >= k and b[rows[at]] < -mine[k - 1][0]:
                        break  # no bound from here on reaches the kth best
                    read(rows[at : at + READ])


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best rows of vectors."""
    cols = [F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")]
    rows, out = vectors.select(*cols), None

    def blocks():
        held = []
        # Repeated queries go before the cut, since a later block would ask them again.
        for r in queries.select(*cols).where("id is not null and v is not null").dropDuplicates(["id", "v"]).toLocalIterator():
            held.append((r["id"], tuple(r["v"])))
            if len(held) == BLOCK:
                yield held
                held = []
        if held:
            yield held

    for block in blocks():
        asked = as_integers(pa.array([list(v) for _, v in block], pa.list_(pa.float64())), pa.array([i for i, _ in block], pa.int64()), scale)
        shared = vectors.sparkSession.sparkContext.broadcast(asked)

        def scan(batches, shared=shared):
            best = {n: [[] for _ in ids] for n, (ids, _) in shared.value.items()}
            held: dict[int, list] = {}

            def search(n):
                ids, v = (np.concatenate(x) for x in zip(*held.pop(n), strict=True))
                if len(ids):
                    Slab(ids, v).search(shared.value[n][1], shared.value[n][0], k, best[n])

            for batch in batches:
                for n, (ids, v) in as_integers(batch.column("v"), batch.column("id"), scale).items():
                    if n not in best:
                        continue
                    for a in range(0, len(ids), SLAB):
                        held.setdefault(n, []).append((ids[a : a + SLAB], v[a : a + SLAB]))
                        if sum(len(i) for i, _ in held[n]) >= SLAB:
                            search(n)
            for n in list(held):
                search(n)
            for n, lists in best.items():
                q = np.repeat(shared.value[n][0], [len(x) for x in lists])
                found = np.array([x for y in lists for x in y], np.int64).reshape(-1, 2)
                for a in range(0, len(q), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(q[a : a + 100_000]), pa.array(found[a : a + 100_000, 1]), pa.array(-found[a : a + 100_000, 0])], names=["query_id", "vec_id", "score"])

        found = rows.mapInArrow(scan, "query_id long, vec_id long, score long")
        if len(block) == BLOCK:  # not the only one, as far as is known
            found = checkpointed(found)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


OP3_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(v.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % {EVERY} = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {K}
"""
