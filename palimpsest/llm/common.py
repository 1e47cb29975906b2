"""What the operators share: reading tables, cutting lineage, packed exchanges, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..written import checkpointed, discard

#: Stands for a missing doc_id where ids are ordered: after all others.
NO_ID = (1 << 63) - 1
#: Edges that one task joins in components(), 4 MB of them.
FEW = 1 << 18
__all__ = ["NO_ID", "blob_batch", "buckets_of", "checkpointed", "components", "connected", "free_name", "group_edges", "in_groups", "of_group", "pack", "shuffle_partitions", "table", "unpack"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, or if a column of df has it, one that none has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_of(df: DataFrame, each: int = 16_000_000) -> int:
    """Buckets of a packed exchange of df's rows: some for each shuffle partition, so that they deal out evenly, and more where
    the tables that df reads have more than `each` bytes a bucket, as their sizes on disk say."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(2 * shuffle_partitions(df.sparkSession), *(-(-size // each) for size in sizes if size < 1 << 60), 1)  # beyond that it isn't known


def pack(bucket: np.ndarray, records: np.ndarray, n: int):
    """(bucket, bytes) of records, one for each bucket that has any."""
    order = np.argsort(bucket, kind="stable")
    records, cut = records[order], np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(cut)):
        yield int(b), records[cut[b] : cut[b + 1]].tobytes()


def unpack(blobs, dtype) -> np.ndarray:
    parts = [np.frombuffer(x, dtype) for x in blobs]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def in_groups(rows: DataFrame, key: str, n: int) -> DataFrame:
    """(g, data): rows by their column key, from 0 to n - 1, those of each batch packed and compressed together.

    Texts packed so take about half of what an exchange of rows takes.
    """

    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            g = np.asarray(batch.column(batch.schema.get_field_index(key)))
            order = np.argsort(g, kind="stable")
            cut = np.searchsorted(g[order], np.arange(n + 1))
            some = np.flatnonzero(np.diff(cut))
            out = []
            for k in some:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as w:
                    w.write_batch(batch.take(pa.array(order[cut[k] : cut[k + 1]])))
                out.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(out, pa.binary())], names=["g", "data"])

    return rows.mapInArrow(run, "g int, data binary")


def of_group(part: pa.Table) -> pa.Table | None:
    """The rows that in_groups() packed; None where there are none."""
    parts = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in part.column("data")]
    return pa.concat_tables(parts).combine_chunks() if parts else None


def blob_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def group_edges(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts, and the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])


def connected(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """components() of the edges that gave labels and of these: only what the new edges join is worked on."""
    if edges.isEmpty():
        return labels
    side = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}"))
    e = edges.select("a", "b").where("a is not null and b is not null").join(side("a"), "a", "left").join(side("b"), "b", "left")
    e = checkpointed(e.select("a", "b", F.coalesce("of_a", "a").alias("x"), F.coalesce("of_b", "b").alias("y")))
    new = e.select(F.explode(F.array(F.struct("a", "x"), F.struct(F.col("b").alias("a"), F.col("y").alias("x")))).alias("r")).select(F.col("r.a").alias("node"), F.col("r.x").alias("label"))
    every = labels.select("node", "label").unionByName(new).distinct()
    up = components(e.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("up"))
    return checkpointed(every.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label")))


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, label of each) of edges that are at hand: the rounds of components() on arrays."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(x):
        up = np.arange(len(nodes))
        np.minimum.at(up, x, y)
        np.minimum.at(up, y, x)
        while (up[up] != up).any():
            up = up[up]
        label, x, y = up[label], up[x], up[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[label]


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of edges (a, b): label is the smallest node that can be reached.

    Each round hooks every node to its smallest neighbour, follows those
    pointers to their roots, and contracts the edges between the roots. Once at
    most FEW edges are left, one task does the rounds that remain: as plans they
    are many jobs each, however small, whose plans and code fill the driver.
    Nothing is collected but counts. Hubs only meet in min aggregates, which
    combine before the exchange, and in joins that adaptive execution can split.
    """
    schema = pa.schema([("node", pa.int64()), ("up", pa.int64())])

    def at_once(batches):
        t = pa.Table.from_batches(batches, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in roots(t["a"].to_numpy(), t["b"].to_numpy())], schema=schema)

    e, labels = checkpointed(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b").distinct()), None
    while True:
        last = e.count() <= FEW
        if last:
            up = checkpointed(e.coalesce(1).mapInArrow(at_once, "node long, up long"))
        else:
            both = e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*")
            up = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up")))
        while not last:
            jump = up.alias("x").join(up.alias("y"), F.col("x.up") == F.col("y.node")).select("x.node", F.col("y.up").alias("up"), (F.col("x.up") != F.col("y.up")).alias("moved"))
            jump, before = checkpointed(jump), up
            up = jump.select("node", "up")
            discard(before)
            if jump.where("moved").isEmpty():
                break
        old = [e]
        if labels is None:
            labels = up.select("node", F.col("up").alias("label"))
        else:
            old += [labels, up]
            labels = checkpointed(labels.join(up.select(F.col("node").alias("label"), "up"), "label", "left").select("node", F.coalesce("up", "label").alias("label")))
        if not last:
            a, b = up.select(F.col("node").alias("a"), F.col("up").alias("ra")), up.select(F.col("node").alias("b"), F.col("up").alias("rb"))
            e = checkpointed(e.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").distinct())
        discard(*old)
        if last:
            return labels
