"""Repository-shaped tables, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 1_800_000_000
CHUNK_CHARS = 256


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def files(spark: SparkSession, d: str, txns: tuple[int, ...] = (1, 2, 3), content: bool = False) -> DataFrame:
    """Three snapshots of the documents, with deletions, edits and additions."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    out = None
    for txn in txns:
        own = docs.where({1: "doc_id % 10 <> 9", 2: "doc_id % 7 <> 0", 3: "true"}[txn])
        edited = F.lit(txn >= 2) & (F.col("doc_id") % 5 == 0)
        rows = own.select(
            F.lit(txn).cast("long").alias("txn_id"), "doc_id",
            F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt")).alias("path"),
            F.when(edited, F.concat("text", F.lit(" [edited]"))).otherwise(F.col("text")).alias("content"),
            (F.col("doc_id") * 60 + 1_700_000_000 + F.when(edited, 86400).otherwise(0)).alias("mtime_unix"),
            F.lit("file").alias("file_type"),
        )
        out = rows if out is None else out.unionByName(rows)
    out = out.withColumns({"size": F.octet_length("content").cast("long"), "content_hash": F.sha2("content", 256), "uid": F.col("doc_id") % 3, "link_target": F.lit(None).cast("string")})
    return out if content else out.drop("content")


def chunks(spark: SparkSession, d: str, txns: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Pieces of CHUNK_CHARS characters: (txn_id, path, idx, offset, length, hash)."""
    n = F.ceil(F.length("content") / CHUNK_CHARS)
    rows = files(spark, d, txns, True).where(F.length("content") > 0).select("txn_id", "path", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("idx"))
    piece = F.substr("content", (F.col("idx") * CHUNK_CHARS + 1).cast("int"), F.lit(CHUNK_CHARS))
    return rows.select("txn_id", "path", F.col("idx").cast("long").alias("idx"), (F.col("idx") * CHUNK_CHARS).cast("long").alias("offset"), F.octet_length(piece).cast("long").alias("length"), F.sha2(piece, 256).alias("hash"))


def store(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks(spark, d).groupBy("hash").agg(F.min("length").alias("stored_len"))
    return rows.select("hash", "stored_len", F.col("stored_len").alias("uncompressed_len"), F.when(F.substring("hash", 1, 1) < "8", "raw").otherwise("zstd").alias("codec"), F.substring("hash", 2, 1).alias("pack_name"))


def tombstones(spark: SparkSession, d: str) -> DataFrame:
    return store(spark, d).where(F.col("hash").endswith("f")).select("hash")


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "orders").select(F.date_trunc("day", "o_orderdate").alias("day")).distinct()
    from pyspark.sql import Window

    return days.select(F.row_number().over(Window.orderBy("day")).cast("long").alias("txn_id"), F.unix_timestamp("day").alias("created_at_unix"))


def snapshot_meta(spark: SparkSession, d: str) -> DataFrame:
    s = snapshots(spark, d)
    return s.select("txn_id", F.concat(F.lit("job"), F.col("txn_id") % 4).alias("job_id"), F.when(F.col("txn_id") % 97 == 0, F.lit(NOW + 1).cast("long")).otherwise(F.lit(0).cast("long")).alias("immutable_until"))


def job_reports(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_id is not null")
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("job"), F.col("user_id") % 6).alias("job_id"), F.unix_timestamp("ts").alias("finished_at_unix"), F.col("event_type").alias("status"))


def issues(spark: SparkSession, d: str) -> DataFrame:
    names = ["locked", "permission_denied", "reparse_junction", "hook_failed:pre", "plugin_unknown:x", "plugin_quiesce_failed:y", "unreadable", "vss_unavailable:z", "other"]
    return table(spark, d, "events").select(F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % 9 + 1).cast("int")).alias("reason"))


def audit_chain(spark: SparkSession, d: str) -> DataFrame:
    """Rows by order key; each fiftieth has another body than its hash says."""
    from pyspark.sql import Window

    w = Window.orderBy("o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey").distinct()
    body = lambda k: F.concat(F.lit('{"kind":"'), F.when(k % 3 == 0, "ops").otherwise("rar"), F.lit('","k":'), k.cast("string"), F.lit("}"))
    o = o.select("o_orderkey", F.row_number().over(w).cast("long").alias("sequence"), F.sha2(body(F.col("o_orderkey")), 256).alias("sha256"))
    return o.select(F.col("o_orderkey").alias("seq"), "sequence", F.coalesce(F.lag("sha256").over(w), F.lit("")).alias("prev_sha256"), "sha256", F.when(F.col("o_orderkey") % 50 == 0, F.lit("{}")).otherwise(body(F.col("o_orderkey"))).alias("body_json"))


def live(spark: SparkSession, d: str) -> DataFrame:
    """What lies on disk: snapshot 3 with rows missing, edited, of another type, and more."""
    f = files(spark, d, (3,))
    rows = f.where("doc_id % 13 <> 0").withColumns({
        "content_hash": F.when(F.col("doc_id") % 17 == 0, F.sha2(F.concat(F.col("content_hash"), F.lit("x")), 256)).otherwise(F.col("content_hash")),
        "file_type": F.when(F.col("doc_id") % 19 == 0, "symlink").otherwise("file"),
    })
    more = f.where("doc_id % 23 = 0").withColumn("path", F.concat(F.lit("extra/"), "path"))
    return rows.unionByName(more)


def hardlinks(spark: SparkSession, d: str) -> DataFrame:
    """Documents of equal text share an inode."""
    return files(spark, d, (3,)).select("path", F.col("content_hash").alias("inode_id"), F.lit("").alias("stream"))


def tree(spark: SparkSession, d: str) -> DataFrame:
    """Files and directories of snapshot 3, some by names that backups leave out."""
    from .operators.filters import ancestors

    f = files(spark, d, (3,))
    odd = F.element_at(F.array(*[F.lit(n) for n in ("node_modules", "Build", "__pycache__", "src")]), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = f.select(F.concat("path", F.lit(".d/"), odd, F.lit("/"), F.when(F.col("doc_id") % 6 == 0, "Thumbs.db").otherwise("a.txt")).alias("path"), F.lit("file").alias("file_type"))
    dirs = rows.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct().withColumn("file_type", F.lit("dir"))
    return rows.unionByName(dirs)
