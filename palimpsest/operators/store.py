"""The content-addressed store: what is referenced, live, orphaned, missing, and what it costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a stored record's header and of a pack file's.
RECORD_HEADER, PACK_HEADER = 48, 4096


def live(store: DataFrame, tombstones: DataFrame) -> DataFrame:
    return store.join(tombstones, "hash", "left_anti")


def referenced(chunks: DataFrame) -> DataFrame:
    return chunks.select("hash").distinct()


def orphans(store: DataFrame, tombstones: DataFrame, chunks: DataFrame) -> DataFrame:
    """Stored chunks that nothing refers to, without those that are marked dead already."""
    return live(store, tombstones).join(referenced(chunks), "hash", "left_anti")


def flagged(store: DataFrame, tombstones: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of each hash that any of the tables has: its stored record, if there is one, dead, refs and ref_bytes.

    The three are put together by one exchange of their hashes, in which rows
    combine before it; all figures of a repository are aggregates of this.
    """
    zero = F.lit(0).cast("long")
    record = ("stored_len", "uncompressed_len", "codec", "pack_name")
    part = lambda df, **known: df.select("hash", *[known.get(c, F.lit(None).cast("long" if c.endswith("_len") else "string")).alias(c) for c in record], *[known.get(c, zero).cast("long").alias(c) for c in ("stored", "dead", "refs", "ref_bytes")])
    rows = part(store, stored=F.lit(1), **{c: F.col(c) for c in record if c in store.columns}).unionByName(part(tombstones, dead=F.lit(1)))
    rows = rows.unionByName(part(chunks, refs=F.lit(1), ref_bytes=F.col("length") if "length" in chunks.columns else zero))
    return rows.groupBy("hash").agg(*[F.max(c).alias(c) for c in record], *[F.max(c).alias(c) for c in ("stored", "dead")], *[F.sum(c).alias(c) for c in ("refs", "ref_bytes")])


def _conditions() -> tuple:
    return F.col("stored") > 0, F.col("dead") > 0, F.col("refs") > 0


def orphan_explain(store: DataFrame, tombstones: DataFrame, chunks: DataFrame) -> DataFrame:
    """(reason, n_chunks, bytes): unreferenced, or tombstoned, which weigh nothing."""
    stored, dead, used = _conditions()
    rows = flagged(store, tombstones, chunks).where(stored & (dead | ~used))
    reason = F.when(dead, "tombstoned").otherwise("unreferenced")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n_chunks"), F.sum(F.when(dead, F.lit(0)).otherwise(F.col("stored_len"))).alias("bytes"))


def orphan_samples(store: DataFrame, tombstones: DataFrame, chunks: DataFrame, limit: int = 0) -> DataFrame:
    """The first orphans by hash; a limit of 0 means 64."""
    return orphans(store, tombstones, chunks).select("hash", "stored_len").orderBy("hash").limit(limit or 64)


def gc_report(store: DataFrame, tombstones: DataFrame, chunks: DataFrame, execute: bool = False) -> DataFrame:
    """Referenced, orphaned and dead chunks; executing adds the orphans to the dead."""
    stored, dead, used = _conditions()
    orphan = stored & ~dead & ~used
    return flagged(store, tombstones, chunks).agg(F.count_if(used).alias("referenced"), F.count_if(orphan).alias("orphans"), F.count_if(dead | orphan if execute else dead).alias("tombstoned"))


def live_bytes(store: DataFrame, tombstones: DataFrame, chunks: DataFrame) -> DataFrame:
    """Headers and bodies of what is referenced and alive, and a header for each pack it lies in."""
    return live(store, tombstones).join(referenced(chunks), "hash", "left_semi").agg(
        F.count("*").alias("live_chunks"), F.coalesce(F.sum(F.col("stored_len") + RECORD_HEADER), F.lit(0)).alias("records"), F.count_distinct("pack_name").alias("packs")
    ).select("live_chunks", (F.col("records") + PACK_HEADER * F.col("packs")).alias("live_bytes"))


def physical_bytes(store: DataFrame) -> DataFrame:
    return store.agg(F.count("*").alias("unique_chunks"), F.coalesce(F.sum(F.col("stored_len") + RECORD_HEADER), F.lit(0)).alias("records"), F.count_distinct("pack_name").alias("packs")).select("unique_chunks", (F.col("records") + PACK_HEADER * F.col("packs")).alias("physical_bytes"))


def compress_stats(store: DataFrame, tombstones: DataFrame, chunks: DataFrame) -> DataFrame:
    used = live(store, tombstones).join(referenced(chunks), "hash", "left_semi")
    zero = F.lit(0)
    return used.agg(F.coalesce(F.sum("uncompressed_len"), zero).alias("uncompressed_bytes"), F.coalesce(F.sum("stored_len"), zero).alias("stored_bytes"), F.count_if(F.col("codec") == "raw").alias("raw_chunks"), F.count_if(F.col("codec") != "raw").alias("compressed_chunks"))


def repo_stats(store: DataFrame, tombstones: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row; amplification is physical over live bytes, 1 where nothing is live."""
    stored, dead, used = _conditions()
    alive = stored & ~dead & used
    sum_of = lambda x, when: F.coalesce(F.sum(F.when(when, x)), F.lit(0))
    record = F.col("stored_len") + RECORD_HEADER
    out = flagged(store, tombstones, chunks).agg(
        F.count_if(stored).alias("unique_chunks"), sum_of(record, stored).alias("all_records"), F.count_distinct(F.when(stored, F.col("pack_name"))).alias("all_packs"),
        F.count_if(alive).alias("live_chunks"), sum_of(record, alive).alias("live_records"), F.count_distinct(F.when(alive, F.col("pack_name"))).alias("live_packs"),
        F.coalesce(F.sum("refs"), F.lit(0)).alias("logical_chunks"), F.coalesce(F.sum("ref_bytes"), F.lit(0)).alias("logical_bytes"),
    )
    out = out.withColumns({"physical_bytes": F.col("all_records") + PACK_HEADER * F.col("all_packs"), "live_bytes": F.col("live_records") + PACK_HEADER * F.col("live_packs")})
    return out.select("unique_chunks", "physical_bytes", "live_chunks", "live_bytes", "logical_chunks", "logical_bytes", F.greatest(F.col("physical_bytes") - F.col("live_bytes"), F.lit(0)).alias("orphan_bytes"), F.when(F.col("live_bytes") > 0, F.col("physical_bytes") / F.col("live_bytes")).otherwise(1.0).alias("amplification"))


def reachability(chunks: DataFrame, store: DataFrame, tombstones: DataFrame, samples: int = 32) -> DataFrame:
    """Distinct chunks that files refer to, how many are missing, and the first few of those by hash."""
    stored, dead, used = _conditions()
    fine = F.col("hash").rlike("^[0-9a-f]{64}$")
    rows = flagged(store.select("hash"), tombstones, chunks.where("hash is not null").select("hash")).where(used).select("hash", fine.alias("fine"), (fine & (~stored | dead)).alias("gone"))
    first = rows.where("gone").orderBy("hash").limit(samples).agg(F.array_sort(F.collect_list("hash")).alias("samples"))
    counts = rows.agg(F.count_if("fine").alias("chunks_checked"), F.count_if("gone").alias("missing"), F.count_if(~F.col("fine")).alias("malformed"))
    return counts.crossJoin(first)  # one row each


def delta_chunks(target: DataFrame, base: DataFrame) -> DataFrame:
    """Chunks of target that base hasn't."""
    return referenced(target).join(referenced(base), "hash", "left_anti")


def delta_stats(target: DataFrame, base: DataFrame, store: DataFrame) -> DataFrame:
    """base_to_target_pct is 100 |base| / |target| and may pass 100; shared_ratio is the true share of target in base."""
    d = delta_chunks(target, base).join(store.select("hash", "stored_len"), "hash", "left").agg(F.count("*").alias("delta_chunks"), F.coalesce(F.sum("stored_len"), F.lit(0)).alias("delta_bytes"))
    n = referenced(target).agg(F.count("*").alias("n_target")).crossJoin(referenced(base).agg(F.count("*").alias("n_base")))
    some = F.col("n_target") > 0
    return d.crossJoin(n).select("delta_chunks", "delta_bytes", F.when(some, 100.0 * F.col("n_base") / F.col("n_target")).otherwise(0.0).alias("base_to_target_pct"), F.when(some, (F.col("n_target") - F.col("delta_chunks")) / F.col("n_target")).otherwise(0.0).alias("shared_ratio"))


def dedup_put(chunks: DataFrame, store: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Counts of a write: chunks given, distinct ones, and those that are stored already and alive."""
    known = live(store, tombstones).select("hash").withColumn("known", F.lit(1))
    return chunks.groupBy("hash").agg(F.count("*").alias("times")).join(known, "hash", "left").agg(F.coalesce(F.sum("times"), F.lit(0)).alias("logical_chunks"), F.count("*").alias("distinct_chunks"), F.count("known").alias("already_stored"))


def new_chunks(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """One row of each chunk that has to be written: one that has no record, dead or alive. The anti-join stands before any encoding."""
    return chunks.dropDuplicates(["hash"]).join(store.select("hash"), "hash", "left_anti")


def revived(chunks: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Dead chunks that are wanted again and only lose their mark."""
    return tombstones.select("hash").distinct().join(chunks.select("hash").distinct(), "hash", "left_semi")


def exists(probe: DataFrame, store: DataFrame, tombstones: DataFrame) -> DataFrame:
    known = live(store, tombstones).select("hash", F.lit(True).alias("stored"))
    return probe.select("hash").distinct().join(known, "hash", "left").select("hash", F.coalesce("stored", F.lit(False)).alias("stored"))


def compact(store: DataFrame, tombstones: DataFrame, chunks: DataFrame) -> DataFrame:
    """The records that stay: referenced and alive."""
    return live(store, tombstones).join(referenced(chunks), "hash", "left_semi")


def compact_report(store: DataFrame, tombstones: DataFrame, chunks: DataFrame) -> DataFrame:
    after = physical_bytes(compact(store, tombstones, chunks)).select(F.col("unique_chunks").alias("records_copied"), F.col("physical_bytes").alias("bytes_after"))
    return physical_bytes(store).select(F.col("physical_bytes").alias("bytes_before")).crossJoin(after).select("records_copied", "bytes_before", "bytes_after", F.when(F.col("bytes_after") > 0, F.col("bytes_before") / F.col("bytes_after")).otherwise(1.0).alias("amplification_before"))


def shard(hash_col: str = "hash"):
    """The low four bits of a hash's first byte."""
    return F.conv(F.substring(hash_col, 2, 1), 16, 10).cast("int")
