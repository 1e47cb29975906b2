"""Audit chains, Merkle trees and signed heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ZERO = "0" * 64
#: Levels that one row folds: 2 ** LEVELS leaves.
LEVELS = 12


def _level(hashes: Column) -> Column:
    """One level up: neighbours hashed together, a last odd one with itself."""
    pair = lambda i: F.sha2(F.concat(F.unhex(F.get(hashes, 2 * i)), F.unhex(F.coalesce(F.get(hashes, 2 * i + 1), F.get(hashes, 2 * i)))), 256)
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / 2).cast("int")), pair)


def fold(hashes: Column, levels: int | None = None) -> Column:
    """The root of an array of hex hashes; 64 zeros for an empty one. With levels, exactly so many are built."""
    steps = F.sequence(F.lit(1), F.lit(levels or 40))
    going = (lambda a: F.lit(True)) if levels else (lambda a: F.size(a) > 1)
    up = F.aggregate(steps, hashes, lambda a, _: F.when(going(a), _level(a)).otherwise(a))
    return F.when(F.coalesce(F.size(hashes), F.lit(0)) <= 0, F.lit(ZERO)).otherwise(F.get(up, 0))


def content_hash(chunks: DataFrame, keys: list[str], order: str = "idx", col: str = "hash") -> DataFrame:
    """Each file's root over its chunks in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, col))), lambda x: x[col])
    return chunks.groupBy(*keys).agg(ordered.alias("hashes")).select(*keys, fold(F.col("hashes")).alias("content_hash"))


def numbered(rows: DataFrame, order: list[str], written) -> DataFrame:
    """rows with pos, their place in the order, with no step that one task does alone.

    Rows are dealt by range and `written` stores them, so that every read sees the
    same ranges; a range's first number is the count of those before it.
    """
    dealt = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_in", within).join(before, "_range").withColumn("pos", F.col("_base") + F.col("_in") - 1).drop("_range", "_in", "_base")


def merkle_root(leaves: DataFrame, col: str = "hash", pos: str = "pos") -> DataFrame:
    """(n_leaves, merkle_root) of leaves at places 0, 1, ...

    Blocks of 2 ** LEVELS leaves fold in one row each, LEVELS levels high, until
    one block is left, which folds to its root.
    """
    n = leaves.agg(F.count("*").alias("n_leaves"))
    size, level = n.first()["n_leaves"], leaves.select(F.col(pos).alias("pos"), F.col(col).alias("hash"))
    block = lambda df: df.groupBy(F.expr(f"pos div {1 << LEVELS}").alias("pos")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"]).alias("h"))
    while size > 1 << LEVELS:
        level = block(level).select("pos", fold(F.col("h"), LEVELS).alias("hash"))
        size = -(-size // (1 << LEVELS))
    root = block(level).agg(F.max(fold(F.col("h"))).alias("root"))
    return n.crossJoin(root).select("n_leaves", F.coalesce("root", F.lit(ZERO)).alias("merkle_root"))


def prove(hashes: list[str], leaf: int) -> list[tuple[str, bool]]:
    """(sibling, it is on the right) from a leaf up; the sibling of an odd last one is itself."""
    import hashlib

    level, out = [bytes.fromhex(h) for h in hashes], []
    while len(level) > 1:
        other = leaf ^ 1 if leaf ^ 1 < len(level) else leaf
        out.append((level[other].hex(), leaf % 2 == 0))
        level = [hashlib.sha256(level[i] + level[min(i + 1, len(level) - 1)]).digest() for i in range(0, len(level), 2)]
        leaf //= 2
    return out


def check_proof(leaf: Column, proof: Column, root: Column) -> Column:
    """proof: array of struct (sibling, is_right)."""
    step = lambda a, s: F.when(s["is_right"], F.sha2(F.concat(F.unhex(a), F.unhex(s["sibling"])), 256)).otherwise(F.sha2(F.concat(F.unhex(s["sibling"]), F.unhex(a)), 256))
    return F.aggregate(proof, leaf, step) == root


def signature(body: Column, secret: str) -> Column:
    """A keyed hash under the name that readers expect."""
    return F.concat(F.lit("ed25519-host-v1:"), F.sha2(F.concat(body, F.lit(secret)), 256))


def verify_chain(chain: DataFrame) -> DataFrame:
    """Rows of a chain (seq, sequence, prev_sha256, sha256, body_json) with what is wrong with them.

    sequence must be the row's place, prev_sha256 the hash of the row before
    (unless that is empty), and sha256 the hash of the body.
    """
    w = Window.orderBy("seq")  # a chain is one sequence, a row a snapshot
    rows = chain.select("seq", "sequence", "prev_sha256", "sha256", "body_json", F.row_number().over(w).alias("place"), F.coalesce(F.lag("sha256").over(w), F.lit("")).alias("before"))
    return rows.select("seq", (F.col("sequence") != F.col("place")).alias("bad_sequence"), ((F.col("before") != "") & (F.col("prev_sha256") != F.col("before"))).alias("bad_link"), (F.sha2("body_json", 256) != F.col("sha256")).alias("bad_body"))


def chain_report(chain: DataFrame) -> DataFrame:
    return verify_chain(chain).agg(F.count("*").alias("entries"), F.count_if("bad_sequence").alias("bad_sequence"), F.count_if("bad_link").alias("bad_link"), F.count_if("bad_body").alias("bad_body"), F.count_if(F.col("bad_sequence") | F.col("bad_link") | F.col("bad_body")).alias("bad_entries"))


def ops_entries(chain: DataFrame) -> DataFrame:
    return chain.where(F.get_json_object("body_json", "$.kind") == "ops")


def check_anchor(chain: DataFrame, anchors: DataFrame) -> DataFrame:
    """The newest anchor held against the chain's last row, and against the row of its own sequence."""
    last = chain.agg(F.max_by("sha256", "seq").alias("last_sha256"))
    head = anchors.agg(F.max_by(F.struct("sequence", "sha256"), "seq").alias("a")).select("a.*")
    own = chain.select(F.col("sequence"), F.col("sha256").alias("own_sha256"))
    out = head.join(own, "sequence", "left").crossJoin(last)
    return out.select("sequence", (F.col("sha256") == F.col("last_sha256")).alias("is_head"), F.coalesce(F.col("sha256") == F.col("own_sha256"), F.lit(False)).alias("at_sequence"))
