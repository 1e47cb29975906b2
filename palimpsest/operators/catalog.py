"""Snapshots and their files: time travel, history, pages and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class NotFound(LookupError):
    pass


def at_snapshot(files: DataFrame, txn: int) -> DataFrame:
    """The files of one snapshot: a partition filter. NotFound where there are none."""
    out = files.where(F.col("txn_id") == txn)
    if out.limit(1).isEmpty():
        raise NotFound(f"no snapshot {txn}")
    return out


def summary_columns(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """The narrow projection that listings read, with each file's number of chunks."""
    n = chunks.groupBy("txn_id", "path").agg(F.count("*").alias("n_chunks"))
    rows = files.select("txn_id", "path", "size", "file_type", "mtime_unix").join(n, ["txn_id", "path"], "left")
    return rows.withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))


def path_history(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("path") == path).orderBy("txn_id")


def page(rows: DataFrame, order: list[str], offset: int = 0, limit: int = 0, zero: int | None = 100) -> DataFrame:
    """Rows offset to offset + limit, with total, the number of all. A limit of 0 means `zero` rows."""
    n = limit or zero or 0
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(n).crossJoin(F.broadcast(total))  # total is one row


def history_page(files: DataFrame, path: str, offset: int = 0, limit: int = 0) -> DataFrame:
    return page(files.where(F.col("path") == path), ["txn_id"], offset, limit, 100)


def browse_page(files: DataFrame, txn: int, prefix: str = "", offset: int = 0, limit: int = 0) -> DataFrame:
    """Files of a snapshot whose path starts with the text prefix, by path; a limit of 0 gives no row."""
    return page(files.where((F.col("txn_id") == txn) & F.col("path").startswith(prefix)), ["path"], offset, limit, 0)


def last_wins(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Of rows with equal keys, the last by order. max_by combines before the exchange."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def base_txn(snapshots: DataFrame, target: int) -> DataFrame:
    """The newest snapshot strictly before target."""
    return snapshots.where(F.col("txn_id") < target).agg(F.max("txn_id").alias("base_txn"))


def with_base(snapshots: DataFrame) -> DataFrame:
    """Every snapshot with the one before it."""
    return snapshots.withColumn("base_txn", F.lag("txn_id").over(Window.orderBy("txn_id")))


def diff(a: DataFrame, b: DataFrame, hash_col: str = "content_hash") -> DataFrame:
    """(path, status, size_a, size_b): added, removed, modified or unchanged. Modified is another hash or size."""
    x = a.select("path", F.col("size").alias("size_a"), F.col(hash_col).alias("hash_a"), F.lit(True).alias("in_a"))
    y = b.select("path", F.col("size").alias("size_b"), F.col(hash_col).alias("hash_b"), F.lit(True).alias("in_b"))
    status = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("hash_a").eqNullSafe(F.col("hash_b")) | ~F.col("size_a").eqNullSafe(F.col("size_b")), "modified").otherwise("unchanged")
    return x.join(y, "path", "full_outer").select("path", status.alias("status"), "size_a", "size_b")


def diff_summary(rows: DataFrame) -> DataFrame:
    n = [F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "modified", "unchanged")]
    return rows.agg(*n, F.coalesce(F.sum(F.when(F.col("status") == "added", F.col("size_b"))), F.lit(0)).alias("bytes_added"), F.coalesce(F.sum(F.when(F.col("status") == "removed", F.col("size_a"))), F.lit(0)).alias("bytes_removed"))


def reuse_ratio(a: DataFrame, b: DataFrame, col: str = "hash") -> DataFrame:
    """The share of b's distinct chunks that a has; 0 if b has none."""
    y = b.select(col).distinct()
    x = a.select(col).distinct().withColumn("seen", F.lit(1))
    return y.join(x, col, "left").agg(F.count("*").alias("chunks"), F.count("seen").alias("shared")).select("chunks", "shared", F.when(F.col("chunks") > 0, F.col("shared") / F.col("chunks")).otherwise(0.0).alias("reuse_ratio"))


def longest_prefix(rows: DataFrame, mounts: DataFrame, path: str = "path", prefix: str = "mount") -> DataFrame:
    """Each row with the longest mount that is a component prefix of its path; null without one.

    Rows meet mounts by equality with one of their ancestors, not by comparing all with all.
    """
    from .filters import ancestors, normalized

    tried = rows.select(path).distinct().select(path, F.explode(F.concat(F.array(normalized(F.col(path))), ancestors(F.col(path)))).alias(prefix))
    best = tried.join(mounts.select(prefix), prefix).groupBy(path).agg(F.max_by(prefix, F.length(prefix)).alias(prefix))
    return rows.join(best, path, "left")


def hardlinks(files: DataFrame, order: Column | str = "path") -> DataFrame:
    """Each file with the first path of its inode and stream, and whether it is a link to that.

    The first path comes from an aggregate, which combines before the exchange, so
    that an inode of very many paths doesn't sort in one task.
    """
    first = files.groupBy("inode_id", "stream").agg(F.min_by("path", order).alias("canonical"))
    return files.join(first, ["inode_id", "stream"]).withColumn("is_link", F.col("path") != F.col("canonical"))
