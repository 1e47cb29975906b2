"""Restores: the order of work, and the three-way plan against what lies on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def restore_plan(files: DataFrame) -> DataFrame:
    """Directories first, then the rest, each by path."""
    first = F.when(F.col("file_type") == "dir", 0).otherwise(1)
    return files.select("path", "file_type", "size", first.cast("long").alias("stage")).orderBy("stage", "path")


def preview(files: DataFrame) -> DataFrame:
    return files.agg(F.count_if(F.col("file_type") == "file").alias("file_count"), F.count_if(F.col("file_type") == "dir").alias("dir_count"), F.coalesce(F.sum(F.when(F.col("file_type") == "file", F.col("size"))), F.lit(0)).alias("bytes"))


def three_way(target: DataFrame, base: DataFrame, live: DataFrame) -> DataFrame:
    """(path, live_state, base_action, action) for what a restore would do.

    Each side is (path, file_type, size, mtime_unix, content_hash, link_target).
    Without a base row files are told apart by size and time; with one, by content.
    Files on disk that the target hasn't are orphans.
    """
    cols = ("file_type", "size", "mtime_unix", "content_hash", "link_target")
    side = lambda df, p: df.select("path", *[F.col(c).alias(f"{p}_{c}") for c in cols], F.lit(True).alias(f"has_{p}"))
    rows = side(target, "t").join(side(base, "b"), "path", "left").join(side(live, "l"), "path", "full_outer")
    same = lambda a, b: F.col(f"{a}_content_hash").eqNullSafe(F.col(f"{b}_content_hash"))
    planned, has_base, has_live = F.col("has_t").isNotNull(), F.col("has_b").isNotNull(), F.col("has_l").isNotNull()
    kept = same("t", "b")
    alike = F.when(F.col("t_file_type") == "dir", True).when(F.col("t_file_type") == "symlink", F.col("t_link_target").eqNullSafe(F.col("l_link_target"))).otherwise((F.col("t_size") == F.col("l_size")) & (F.col("t_mtime_unix") == F.col("l_mtime_unix")))
    other_type = F.col("t_file_type") != F.col("l_file_type")
    state = F.when(~planned, "present").when(~has_live, "missing").when(other_type, "diverged").when(~has_base, F.when(alike, "matches_target").otherwise("diverged")).when(same("t", "l"), "matches_target").when(~kept & same("b", "l"), "matches_base").otherwise("diverged")
    by_base = F.when(~planned, "").when(~has_live, F.when(has_base, F.when(kept, "same").otherwise("changed")).otherwise("absent")).when(other_type, F.when(has_base, "changed").otherwise("absent")).when(~has_base, "").otherwise(F.when(kept, "same").otherwise("changed"))
    action = F.when(~planned, "orphan").when(~has_live, "add").when(other_type, "conflict").when(~has_base, F.when(alike, "unchanged").otherwise("modify")).when(same("t", "l"), "unchanged").when(kept, "modify").when(same("b", "l"), "modify").otherwise("both_changed")
    reason = F.when(~planned, "not_in_snapshot").when(has_live & other_type, "type_mismatch").otherwise("")
    rows = rows.where(planned | (F.col("l_file_type") == "file"))
    return rows.select("path", state.alias("live_state"), by_base.alias("base_action"), action.alias("action"), reason.alias("reason"), F.coalesce("t_size", F.lit(0)).alias("target_size"))


ACTIONS = ("add", "modify", "unchanged", "conflict", "both_changed", "orphan")


def plan_summary(plan: DataFrame) -> DataFrame:
    """Counts of actions; what both sides changed is a conflict too."""
    n = [F.count_if(F.col("action") == a).alias(a) for a in ACTIONS]
    writes = F.coalesce(F.sum(F.when(F.col("action").isin("add", "modify"), F.col("target_size"))), F.lit(0))
    return plan.agg(*n, F.count_if(F.col("action").isin("conflict", "both_changed")).alias("conflicts"), writes.alias("bytes_to_write"))


def apply_plan(plan: DataFrame, on_conflict: str = "skip", on_orphan: str = "skip") -> DataFrame:
    """plan with decision: write, delete, skip, keep or fail."""
    clash = {"skip": "skip", "overwrite": "write", "fail": "fail"}[on_conflict]
    left = {"skip": "skip", "delete": "delete"}[on_orphan]
    a = F.col("action")
    return plan.withColumn("decision", F.when(a.isin("add", "modify"), "write").when(a == "unchanged", "keep").when(a == "orphan", left).otherwise(clash))


def apply_summary(plan: DataFrame) -> DataFrame:
    """Figures of a plan with decisions: files written, kept, left alone, deleted and refused, and bytes to write."""
    n = {"written": "write", "kept": "keep", "skipped": "skip", "deleted": "delete", "failed": "fail"}
    bytes_written = F.coalesce(F.sum(F.when(F.col("decision") == "write", F.col("target_size"))), F.lit(0))
    return plan.agg(*[F.count_if(F.col("decision") == d).alias(name) for name, d in n.items()], bytes_written.alias("bytes_written"))


def verify_restored(manifest: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, ok): whether chunks (path, idx, length, hash) on disk are the manifest's, all of them, in order."""
    m = manifest.select("path", "idx", F.struct("length", "hash").alias("m"))
    d = disk.select("path", "idx", F.struct("length", "hash").alias("d"))
    return m.join(d, ["path", "idx"], "full_outer").groupBy("path").agg(F.min(F.col("m").eqNullSafe(F.col("d"))).alias("ok"))


def reassemble(chunks: DataFrame) -> DataFrame:
    """(path, content) from (path, idx, payload)."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("idx", "payload"))), lambda x: x["payload"])
    return chunks.groupBy("path").agg(parts.alias("parts")).select("path", F.aggregate("parts", F.lit("").cast("binary"), lambda a, b: F.concat(a, b)).alias("content"))


def subset_leaves(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """Chunks of the files in paths, the leaves of a restored part's own root."""
    return chunks.join(paths.select("path"), "path", "left_semi").select("path", "idx", "hash")


def acceptance(files: DataFrame) -> DataFrame:
    """Files and bytes of what was restored."""
    return files.where(F.col("file_type") == "file").agg(F.count("*").alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
