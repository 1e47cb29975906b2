"""Jobs, the queue that they wait in, and what is due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import in_window
from .catalog import last_wins

#: States of a queued run.
STATES = ("pending", "running", "done", "failed")


def upsert(jobs: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """jobs with the rows of changes in place of those of the same id, or beside them."""
    return jobs.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def remove(jobs: DataFrame, *ids: str) -> DataFrame:
    return jobs.where(~F.coalesce(F.col("id").isin(*ids), F.lit(False))) if ids else jobs


def invalid(jobs: DataFrame) -> DataFrame:
    """(id, reason) of jobs that can't run: without id or source, or of an id that occurs twice."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    one = jobs.groupBy("id").agg(F.count("*").alias("n"), F.max(blank("source").cast("int")).alias("none"))
    reason = F.when(blank("id"), "no id").when(F.col("none") == 1, "no source").when(F.col("n") > 1, "id occurs twice")
    return one.select("id", reason.alias("reason")).where("reason is not null")


def due(jobs: DataFrame, last_runs: DataFrame, now: int, minute: Column | int) -> DataFrame:
    """(id, due_unix) of enabled jobs whose interval has passed since their last run, within their window; one that never ran is due since 0."""
    ran = last_runs.groupBy(F.col("job_id").alias("id")).agg(F.max("finished_at_unix").alias("last"))
    when = F.coalesce(F.col("last") + F.col("interval_seconds"), F.lit(0))
    rows = jobs.where("enabled").join(ran, "id", "left").withColumn("due_unix", when.cast("long"))
    minute = minute if isinstance(minute, Column) else F.lit(minute)
    return rows.where((F.col("due_unix") <= now) & in_window(minute, F.col("window_start"), F.col("window_end"))).select("id", "due_unix")


def queue_states(queue: DataFrame) -> DataFrame:
    """(run_id, job_id, state, seq) of each queued run, by its last entry."""
    return last_wins(queue.select("run_id", "job_id", "state", "seq", F.col("seq").alias("order")), ["run_id"], "order").select("run_id", "job_id", "state", "seq")


def next_runs(queue: DataFrame, most: int) -> DataFrame:
    """The pending runs that come next: the first of each job that isn't running, oldest first."""
    state = queue_states(queue)
    first = state.where("state = 'pending'").groupBy("job_id").agg(F.min("run_id").alias("run_id"))
    return first.join(state.where("state = 'running'").select("job_id"), "job_id", "left_anti").orderBy("run_id").limit(most).select("run_id", "job_id")
