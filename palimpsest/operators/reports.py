"""Reports of jobs and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reasons, by their whole text or what they start with (those that end with a colon), and the count that
#: each goes to.
REASONS = (
    ("locked", "locked"),
    ("permission_denied", "permission_denied"),
    ("reparse_junction", "reparse_junction"),
    ("hook_failed:", "hook_failed"),
    ("plugin_skipped:platform:", "plugin_skipped"),
    ("plugin_unknown:", "plugin_skipped"),
    ("plugin_quiesce_failed:", "plugin_failed"),
    ("unreadable", "other"),
    ("depth_exceeded", "other"),
    ("symlink_loop", "other"),
    ("window_truncated", "other"),
    ("vss_unavailable:", "other"),
)
COUNTS = ("locked", "permission_denied", "reparse_junction", "hook_failed", "plugin_skipped", "plugin_failed")
#: Files with these reasons were read later or by other means; all other known ones were left out.
NOT_SKIPPED = ("locked", "permission_denied")


def bucket(reason: Column) -> Column:
    """The count that a reason goes to; null for an unknown one."""
    out = F.when(F.lit(False), F.lit(""))
    for text, name in REASONS:
        out = out.when(reason.startswith(text) if text.endswith(":") else reason == text, name)
    return out


def issue_counts(issues: DataFrame) -> DataFrame:
    kind = bucket(F.col("reason"))
    return issues.agg(*[F.count_if(kind == name).alias(name) for name in COUNTS], F.count_if(kind.isNotNull() & ~kind.isin(*NOT_SKIPPED)).alias("skipped"))


def job_report_page(reports: DataFrame, job: str, offset: int = 0, limit: int = 0) -> DataFrame:
    from .catalog import page

    return page(reports.where(F.col("job_id") == job), ["seq"], offset, limit, 100)


def rpo(jobs: DataFrame, reports: DataFrame, meta: DataFrame, snapshots: DataFrame, now: int) -> DataFrame:
    """Each job's last success: its first report's time, unless a snapshot of the job is as new or newer."""
    first = reports.groupBy("job_id").agg(F.min_by("finished_at_unix", "seq").alias("reported"))
    taken = meta.join(snapshots, "txn_id").groupBy("job_id").agg(F.max("created_at_unix").alias("taken"))
    last = F.when(F.col("taken") >= F.coalesce("reported", F.lit(0)), F.col("taken")).otherwise(F.col("reported"))
    days = F.when(last.isNull(), -1.0).otherwise((F.lit(now) - last) / 86400.0)
    return jobs.select("job_id").join(first, "job_id", "left").join(taken, "job_id", "left").select("job_id", last.alias("last_success_unix"), days.alias("days_since"))


def rpo_summary(meta: DataFrame, snapshots: DataFrame, now: int) -> DataFrame:
    s = snapshots.agg(F.count("*").alias("snapshots"), F.max("created_at_unix").alias("newest_unix"))
    m = meta.agg(F.count_if(F.col("immutable_until") > now).alias("immutable"))
    return s.crossJoin(m).select("snapshots", "newest_unix", "immutable", F.when(F.col("newest_unix").isNull(), -1.0).otherwise((F.lit(now) - F.col("newest_unix")) / 86400.0).alias("days_since"))


def remote_lag(snapshots: DataFrame, synced: int) -> DataFrame:
    return snapshots.agg(F.greatest(F.coalesce(F.max("txn_id"), F.lit(0)) - synced, F.lit(0)).alias("lag"))
