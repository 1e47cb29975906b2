"""Cutting lineage by written tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: set[str] = set()
_local: list[str] = []


def _folder(spark: SparkSession) -> str:
    """The session's own folder under spark.checkpoint.dir; removed when the program ends.

    Without that setting a local folder serves a local master; elsewhere the
    executors would each write to a disk of their own, so that is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="palimpsest-"))
        top = _local[0]
    path = f"{top.rstrip('/')}/palimpsest-{spark.sparkContext.applicationId}"
    if path not in _folders:
        _folders.add(path)
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def checkpointed(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """The rows of df, written as a table to the folder in spark.checkpoint.dir and read from there.

    The folder is the cluster's, and all executors share it; only where none is
    set a local one is made. A table, unlike df.checkpoint(), also forgets the
    constraints of the plan before it, which otherwise grow with every round of
    an iteration, and knows its size, so that small ones are broadcast.
    """
    return checkpointed_parts(df, codec=codec)[0]


def checkpointed_parts(df: DataFrame, by: str | None = None, *values: int, codec: str = "zstd") -> list[DataFrame]:
    """checkpointed(); with a column `by`, a table of its own for the rows of each of its values, without that column."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, was = f"{_folder(spark)}/{uuid.uuid4().hex}", spark.conf.get(key, "false")
    spark.conf.set(key, "true")  # what the write has shuffled isn't read again
    try:
        out = df.write.option("compression", codec)
        (out.partitionBy(by) if by else out).parquet(path)
    finally:
        spark.conf.set(key, was)
    if not by:
        return [spark.read.schema(df.schema).parquet(path)]
    rest, found = df.drop(by).schema, []
    at = spark._jvm.org.apache.hadoop.fs.Path
    for v in values:
        part = at(f"{path}/{by}={v}")
        if not part.getFileSystem(spark._jsc.hadoopConfiguration()).exists(part):
            found.append(spark.createDataFrame([], rest))
        else:
            found.append(spark.read.schema(rest).parquet(part.toString()))
    return found


def clustered(df: DataFrame, key: str, n: int, codec: str = "zstd") -> DataFrame:
    """checkpointed(), in n buckets by key, so that grouping by that column needs no exchange of it again."""
    spark = df.sparkSession
    name = f"palimpsest_{uuid.uuid4().hex}"
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, was = f"{_folder(spark)}/{uuid.uuid4().hex}", spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", path).option("compression", codec).saveAsTable(name)
    finally:
        spark.conf.set(setting, was)
    out = spark.table(name)
    out.schema  # noqa: B018  resolved before the name goes; the files stay
    spark.sql(f"DROP TABLE {name}")
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what checkpointed() wrote, once nothing will read it again; other tables are left alone."""
    for t in tables:
        files = t.inputFiles()
        if files and any(f"/{path.rsplit('/', 1)[-1]}/" in files[0] for path in _folders):
            _remove(t.sparkSession, files[0].rsplit("/", 1)[0])
