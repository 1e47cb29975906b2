"""Watching a folder and draining a queue, one micro-batch a trigger.

The stream's checkpoint holds what has been taken, so that a restart neither
loses nor repeats a file. Batches are taken by their number, so that one that ran
but wasn't recorded isn't taken twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.repo import Repo
from ..sources.files import read_files

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(repo: Repo, folder: str, checkpoint: str, clock: Callable[[], int], interval: str | None = None, pattern: str = "*", after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Backs up a folder when files have come, at every trigger; once over what is there for no interval.

    A snapshot is the tree: the files of the batch, and those of the last
    snapshot that are still there, whose chunks it keeps.
    """
    spark = repo.spark
    stream = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    rows = stream.select("path", "content", F.unix_timestamp("modificationTime").alias("mtime_unix"))

    def take(batch: DataFrame, number: int) -> None:
        job = f"watch-{number}"
        if repo.table("meta").where(F.col("job_id") == job).isEmpty() and not batch.isEmpty():
            txn = repo.backup(read_files(spark, folder, pattern).select("path", "content", "mtime_unix"), clock(), job)
            if after:
                after(txn)

    out = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take)
    return (out.trigger(processingTime=interval) if interval else out.trigger(availableNow=True)).start()


def drain(spark: SparkSession, queue: str, schema, checkpoint: str, run: Callable[[DataFrame, int], None], interval: str | None = None) -> StreamingQuery:
    """Hands the JSON rows that have come into a queue folder to run, in batches."""
    out = spark.readStream.schema(schema).json(queue).writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return (out.trigger(processingTime=interval) if interval else out.trigger(availableNow=True)).start()


def pending(outbox: DataFrame, now: int, most: int = 300) -> DataFrame:
    """Outbox rows to try now: pending ones, and failed ones whose backoff has passed. Last state of each pair counts."""
    from ..functions.times import backoff
    from ..operators.catalog import last_wins

    rows = last_wins(outbox, ["base_txn", "target_txn"])
    return rows.where((F.col("state") == "pending") | ((F.col("state") == "failed") & (F.col("updated_at_unix") + backoff(F.col("attempts"), most) <= now)))


def may_maintain(outbox: DataFrame) -> bool:
    """Nothing may be deleted while a pair isn't synced."""
    from ..operators.catalog import last_wins

    return last_wins(outbox, ["base_txn", "target_txn"]).where("state <> 'done'").isEmpty()
