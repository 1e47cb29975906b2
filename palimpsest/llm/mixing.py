"""Mixing sources to target weights, with DataFrame functions only.

The words of each source, its documents in a pseudorandom order, form one stream
that is packed into blocks of fixed length. A mix is a list of slots, each a
block of a source. Every draw of a source goes to an output shard chosen by
hash, so that a shard's source counts are multinomial given the totals that the
targets fix. A source's slots, numbered through its shards, map to its blocks by
a pseudorandom permutation, once through all blocks before any block comes
again, and meet the blocks by index. Blocks have BLOCK words, in a source of few
words as many as give it about PARTS blocks, and the last one of a source what is
left; whole rounds through a source count as its size and the rest as blocks, so
that what is taken is within two blocks of every target.

Sources weigh 5, 2, 1 in turn, by code point of their names, null last, and
share `share` times all words. No source gives more than `repeats` times its
words; the excess goes to the others by weight.

A stream is never numbered in one task: documents fall into groups by hash, as
many as the source's rows need, offsets run over the groups, and rows are
numbered within a group.

Defined cases: null and empty texts have size 0 and are taken 0 times; a null
source is a source; rows that repeat an id are rows of their own; an empty table
gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, shuffle_partitions, table

#: Words of a block and blocks that a small source has at least, mean documents of a numbered group, slots of an output shard, draws listed by one row.
BLOCK, PARTS, GROUP, SHARD_SLOTS, LISTED = 64, 256, 512, 65536, 16384
WEIGHTS = (5, 2, 1)
#: Primes of which one doesn't divide the number of a source's blocks, so that its multiples modulo that number are a permutation.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
#: A table of sources up to so many rows is sent to all tasks; a larger one is joined by exchange.
SMALL = 20_000
FIRST, LAST = Window.unboundedPreceding, Window.unboundedFollowing


def _joined(rows: DataFrame, small: DataFrame, n: int, key) -> DataFrame:
    return rows.join(F.broadcast(small) if n <= SMALL else small, key)


def targets(sizes: DataFrame, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """(source, source_no, source_size, n_rows, target), one row for each source of (source, size).

    With sources by size over weight, the common level is that of the first
    source whose share stays below its cap when all before it take theirs.
    """
    by = Window.orderBy(F.col("source").asc_nulls_last())
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    one = one.withColumn("source_no", F.row_number().over(by).cast("long"))
    one = one.withColumn("weight", F.element_at(F.array(*[F.lit(x).cast("long") for x in WEIGHTS]), ((F.col("source_no") - 1) % len(WEIGHTS) + 1).cast("int")))
    one = one.withColumns({"cap": F.col("source_size") * repeats, "order": F.col("source_size") / F.col("weight")})
    up, everyone = Window.orderBy("order", "source_no"), Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(up.rowsBetween(FIRST, -1)), F.lit(0))
    one = one.withColumn("level", (F.sum("source_size").over(everyone) * F.lit(share) - before) / F.sum("weight").over(up.rowsBetween(0, LAST)))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("order", "source_no", "level"))
    one = one.withColumn("level", F.min(fits).over(everyone)["level"])
    return one.select("source", "source_no", "source_size", "n_rows", F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), F.col("cap").cast("double")).alias("target"))


class Mix:
    """A mix of docs: its rows placed in streams, its slots, and the pieces of rows that blocks hold."""

    def __init__(self, docs: DataFrame, share: float = 1.5, repeats: int = 2, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
        self.repeats, self.tasks = repeats, shuffle_partitions(docs.sparkSession)
        size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
        sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"))
        sized = checkpointed(sized.withColumn("name", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))))
        length = F.greatest(F.lit(1), F.least(F.lit(block), F.expr(f"source_size div {PARTS}"))).cast("long")
        self.sources = checkpointed(targets(sized, share, repeats).withColumn("length", length))
        self.n = self.sources.count()
        rows = _joined(sized.alias("d"), self.sources.alias("t"), self.n, F.expr("d.source <=> t.source")).select("id", "size", "name", "source_no", "source_size", "n_rows", "target", "length")
        rows = rows.withColumn("part", F.conv(F.substring("name", 1, 8), 16, 10).cast("long") % F.ceil(F.col("n_rows") / GROUP))
        parts = rows.groupBy("source_no", "part").agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source_no").orderBy("part").rowsBetween(FIRST, -1)
        parts = parts.select("source_no", "part", F.coalesce(F.sum("words").over(run), F.lit(0)).alias("base"))
        within = Window.partitionBy("source_no", "part").orderBy("name", "size").rowsBetween(FIRST, -1)
        #: id, size, source_no, source_size, target, length (of its source's blocks), first: the row's first word in its source's stream.
        self.rows = checkpointed(rows.join(parts, ["source_no", "part"]).select("id", "size", "source_no", "source_size", "target", "length", (F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0))).alias("first")))

    def slots(self) -> DataFrame:
        """(shard, source_no, index, epoch, block): the slots of the mix."""
        s = self.sources.where("source_size > 0").select("source_no", "source_size", "length", F.ceil(F.col("source_size") / F.col("length")).alias("blocks"), F.col("target").alias("goal"))
        s = s.withColumn("rounds", F.floor(F.col("goal") / F.col("source_size")))
        draws = F.col("rounds") * F.col("blocks") + F.floor((F.col("goal") - F.col("rounds") * F.col("source_size")) / F.col("length") + 0.5)
        s = s.select("source_no", "blocks", F.least(draws, F.col("blocks") * self.repeats).cast("long").alias("draws"))
        s = s.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.sum("draws").over(Window.partitionBy()) / SHARD_SLOTS)))
        lists = s.where("draws > 0").select("*", F.explode(F.expr(f"sequence(0, (draws - 1) div {LISTED})")).alias("list")).repartition(self.tasks, "source_no", "list")
        drawn = lists.select("source_no", "shards", F.explode(F.expr(f"sequence(list * {LISTED}, least(draws, (list + 1) * {LISTED}) - 1)")).alias("draw"))
        counts = drawn.select("source_no", F.pmod(F.xxhash64("source_no", "draw"), "shards").alias("shard")).groupBy("source_no", "shard").agg(F.count("*").alias("count"))
        start = F.coalesce(F.sum("count").over(Window.partitionBy("source_no").orderBy("shard").rowsBetween(FIRST, -1)), F.lit(0))
        runs = counts.withColumn("start", start).select("source_no", "shard", "start", "count", F.explode(F.expr(f"sequence(0, (count - 1) div {LISTED})")).alias("list")).repartition(self.tasks, "source_no", "shard", "list")
        slots = runs.select("source_no", "shard", F.explode(F.expr(f"sequence(start + list * {LISTED}, start + least(count, (list + 1) * {LISTED}) - 1)")).alias("index"))
        slots = _joined(slots, s.select("source_no", "blocks"), self.n, "source_no")
        primes = f"filter(array({', '.join(f'{p}L' for p in PRIMES)}), p -> blocks % p <> 0)"
        prime = F.expr(f"element_at({primes}, cast((source_no + index div blocks) % size({primes}) + 1 as int))")
        slots = slots.withColumns({"epoch": F.expr("index div blocks"), "prime": prime})
        at = F.expr("cast(((cast(index % blocks as decimal(19, 0)) + 1) * cast(prime as decimal(19, 0))) % blocks as long)")
        return slots.select("shard", "source_no", "index", "epoch", at.alias("block"))

    def pieces(self) -> DataFrame:
        """self.rows of some size, once for each block that they reach, with block, from (first word within the row) and words."""
        rows = self.rows.where("size > 0").withColumn("block", F.explode(F.expr("sequence(first div length, (first + size - 1) div length)")))
        rows = rows.withColumn("from", F.greatest(F.lit(0), F.col("block") * F.col("length") - F.col("first")))
        return rows.withColumn("words", F.least(F.col("size"), (F.col("block") + 1) * F.col("length") - F.col("first")) - F.col("from"))

    def spans(self) -> DataFrame:
        """(shard, source_no, index, id, from, words): what the slots hold, in spans of the rows' words."""
        return self.slots().join(self.pieces(), ["source_no", "block"]).select("shard", "source_no", "index", "id", "from", "words")

    def taken(self) -> DataFrame:
        """self.rows with taken: the words that the mix takes of them, repeats counted."""
        times = self.slots().groupBy("source_no", "block").agg(F.count("*").alias("times"))
        keys = ["id", "size", "source_no", "source_size", "target", "first"]
        some = self.pieces().join(times, ["source_no", "block"], "left").groupBy(*keys).agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
        return some.unionByName(self.rows.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken")))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return Mix(table(spark, sf_dir, "documents")).taken().select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


#: The same water level, stream order, blocks and permutation.
OP8_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS name,
    CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents
), s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_rows, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM d GROUP BY source
), s1 AS (SELECT *, [5, 2, 1][CAST((no - 1) % 3 + 1 AS INTEGER)] AS weight, 2 * source_size AS cap FROM s0),
s2 AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - coalesce(CAST(sum(cap) OVER (ORDER BY source_size / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0.0))
    / CAST(sum(weight) OVER (ORDER BY source_size / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM s1
), lv AS (SELECT level FROM s2 WHERE level * weight <= cap ORDER BY source_size / weight, no LIMIT 1),
s AS (
  SELECT source, no, source_size, n_rows, coalesce(least(CAST(cap AS DOUBLE), (SELECT level FROM lv) * weight), CAST(cap AS DOUBLE)) AS target,
    greatest(1, least({BLOCK}, source_size // {PARTS})) AS len FROM s2
), r AS (
  SELECT doc_id, size, name, no, source_size, target, len, CAST(('0x' || substr(name, 1, 8)) AS BIGINT) % CAST(ceil(n_rows / {GROUP}) AS BIGINT) AS part
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
), f AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY no ORDER BY part, name, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM r
), k AS (
  SELECT no, blocks, CAST(least(2 * blocks, rounds * blocks + floor((target - rounds * source_size) / len + 0.5)) AS BIGINT) AS draws
  FROM (SELECT *, CAST(ceil(source_size / len) AS BIGINT) AS blocks, floor(target / source_size) AS rounds FROM s WHERE source_size > 0)
), x AS (SELECT no, blocks, unnest(range(draws)) AS i FROM k),
b AS (
  SELECT no, CAST((CAST(i % blocks + 1 AS HUGEINT) * list_filter([{', '.join(map(str, PRIMES))}], lambda p: blocks % p <> 0)[CAST((no + i // blocks) % len(list_filter([{', '.join(map(str, PRIMES))}], lambda p: blocks % p <> 0)) + 1 AS INTEGER)]) % blocks AS BIGINT) AS block FROM x
), times AS (SELECT no, block, count(*) AS times FROM b GROUP BY ALL),
p AS (SELECT doc_id, no, first, size, len, unnest(range(first // len, (first + size - 1) // len + 1)) AS block FROM f WHERE size > 0),
t AS (
  SELECT doc_id, no, first, CAST(sum((least(first + size, (block + 1) * len) - greatest(first, block * len)) * coalesce(times, 0)) AS BIGINT) AS taken
  FROM p LEFT JOIN times USING (no, block) GROUP BY ALL
)
SELECT f.doc_id, f.size, f.source_size, f.target, coalesce(t.taken, 0) AS taken
FROM f LEFT JOIN t ON t.no = f.no AND t.first = f.first AND f.size > 0
"""
