"""Which snapshots a policy keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a bucket and buckets kept: hours, days, weeks, months; and the newest that always stay.
DEFAULT_TIERS, RETAIN_MIN = ((3600, 24), (86400, 7), (604800, 4), (2592000, 6)), 3


def parse_policy(spec: str) -> tuple[tuple[int, int], ...]:
    """`bucket:keep,...`; ValueError where a part isn't two positive numbers."""
    out = []
    for part in spec.split(","):
        bucket, sep, keep = part.strip().partition(":")
        if not sep or not bucket.isdigit() or not keep.isdigit() or not int(bucket) or not int(keep):
            raise ValueError(f"not a retention policy: {spec!r}")
        out.append((int(bucket), int(keep)))
    return tuple(out)


def keep_set(snapshots: DataFrame, tiers=DEFAULT_TIERS, retain_min: int = RETAIN_MIN) -> DataFrame:
    """Distinct txn_id that stay: of each tier the newest txn of its newest buckets, the newest retain_min, and the last.

    Buckets are aggregates, so that only one row a bucket is ranked.
    """
    kept = snapshots.orderBy(F.desc("txn_id")).limit(max(1, retain_min)).select("txn_id")
    for seconds, keep in tiers:
        newest = snapshots.groupBy(F.expr(f"created_at_unix div {seconds}").alias("bucket")).agg(F.max("txn_id").alias("txn_id"))
        kept = kept.unionByName(newest.orderBy(F.desc("bucket")).limit(keep).select("txn_id"))
    return kept.distinct()


def prune_plan(snapshots: DataFrame, meta: DataFrame, now: int, tiers=DEFAULT_TIERS, retain_min: int = RETAIN_MIN) -> DataFrame:
    """(txn_id, decision): keep, immutable (its date has not passed) or delete."""
    kept = keep_set(snapshots, tiers, retain_min).withColumn("kept", F.lit(True))
    rows = snapshots.select("txn_id").join(kept, "txn_id", "left").join(meta.select("txn_id", "immutable_until"), "txn_id", "left")
    decision = F.when(F.col("kept"), "keep").when(F.col("immutable_until") > now, "immutable").otherwise("delete")
    return rows.select("txn_id", decision.alias("decision"))


def newest_in_bucket(snapshots: DataFrame, seconds: int) -> DataFrame:
    """Each snapshot with its bucket and whether it is that bucket's newest."""
    w = Window.partitionBy("bucket").orderBy(F.desc("txn_id"))
    return snapshots.withColumn("bucket", F.expr(f"created_at_unix div {seconds}")).withColumn("newest", F.row_number().over(w) == 1)
