"""N-gram Jaccard self-join by prefix trees, and the components of its links.

A text's set holds its distinct n-word shingles. Sets link when
100 * intersection >= percent * union. Equal sets form one class, by digest, so
copies cost one set.

Two linked sets share a shingle among the first |x| - ceil(percent * |x| / 100) + 1
of each, under any one order of all shingles. The order is by how busy a
shingle's cell is: a sketch of fixed size counts all shingles of all texts in
cells by hash, so that rare ones tend to come first. Shingles of those prefixes meet by hash, and only those in two classes
stay as candidates.

A shingle in the prefixes of at most LIGHT classes is light: where it meets, pairs
of its classes whose sizes allow a link are counted, and a pair stays if it shares
as many prefix shingles as its sizes need. Heavier shingles go in rounds. In the
pivot rounds each sends its classes to one of them, in as many units as they
fill, which joins groups of near copies, however large, with visits in
proportion to their size. Then only shingles whose classes lie in different
components are left. Those of at most MIDDLE classes are counted by pairs, as light
ones are, but for pairs in different components alone: in a large table chance
brings many shingles over LIGHT, and these tie most classes together. Classes that
the others connect form clusters, and the last round joins whole clusters, and of
one that is larger than a unit may be the blocks whose sizes allow a link. After it
no link is left unseen: a pair shares light shingles, or else some of at most MIDDLE
classes, or else heavier ones alone.

Sets are joined in units of bounded size. A unit's sets are put into a prefix
tree, frequent shingles first, so that near copies share long paths. Each set
walks the tree with the overlap so far, which all sets below a node share, and
leaves a subtree when what remains of the set or of the subtree's longest set
can't reach the overlap that its shortest set needs. Sets that are connected
already aren't compared.

Defined cases: null and empty texts have an empty set, which links with nothing,
not even its like; texts under n words have their whole sequence as one shingle;
rows that repeat an id are rows of their own with one id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blob_batch, buckets_of, checkpointed, components, connected, discard, group_edges, pack, table, unpack
from .kernels import U, hash_words, mix, shingle_sets, text_slices, words_of

#: The sketch: 2 ** SKETCH_BITS counts, sent in slices.
SKETCH_BITS, SLICES = 21, 128
#: Sets of a unit besides its pivot, and of a cluster's unit; pivot rounds; classes of a light shingle, and of one that is counted by pairs after the pivot rounds; tasks that a heavy one is dealt over.
UNIT, CLUSTER, PIVOT_ROUNDS, LIGHT, MIDDLE, SALTS = 64, 3072, 2, 16, 256, 16

TOKEN = np.dtype([("h", "u8"), ("cls", "i8"), ("n", "i4"), ("sent", "i1")])


def row_uid(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Names a row by its id and text; equal rows share it."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def _sets(texts: pa.Array, n: int):
    """(first row, sorted shingles, offsets) of slices of texts, words lower-cased."""
    for a, _, buf, off in text_slices(texts):
        buf, s, e, first = words_of(buf, off, lower=True)
        yield a, *shingle_sets(hash_words(buf, s, e), first, n)


def _digests(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.zeros(len(h) + 1, U)
    np.cumsum(mix(h ^ U(0x5851F42D4C957F2D)), out=c[1:])
    return mix(c[off[1:]] - c[off[:-1]] + np.diff(off).astype(U)).view(np.int64)


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - SKETCH_BITS)).astype(np.int64)


def prefixes(h: np.ndarray, off: np.ndarray, busy: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices into h, set) of each set's prefix, under the order (busy, hash)."""
    n = np.diff(off)
    keep = n + (-percent * n // 100) + 1  # n - ceil(percent * n / 100) + 1
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, busy[_cell(h)], owner))
    take = np.arange(len(h)) - off[:-1][owner] < keep[owner]
    return order[take], owner[take]


class PrefixTree:
    """A path-compressed tree of sorted integer arrays."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        top: list = []
        # Nodes that are still to be made: members, in order, the depth that they share, and where the node goes. Near
        # copies nest deeply, so this isn't done by recursion.
        todo = [(sorted(range(len(sets)), key=lambda i: sets[i].tolist()), 0, top)]
        while todo:
            members, depth, siblings = todo.pop()
            node, rest = self._node(members, depth)
            siblings.append(node)
            end, at = node[1], 0
            while at < len(rest):
                key, to = sets[rest[at]][end], at
                while to < len(rest) and sets[rest[to]][end] == key:
                    to += 1
                todo.append((rest[at:to], end, node[-1]))
                at = to
        self.root = top[0]

    def _node(self, members: list[int], depth: int):
        """((segment, end depth, shortest, longest, smallest member, members that end here, no children yet), members that go on)."""
        a, b = self.sets[members[0]][depth:], self.sets[members[-1]][depth:]
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[:m] != b[:m])
        seg = a[: int(differ[0]) if len(differ) else m]
        end = depth + len(seg)
        sizes = [len(self.sets[i]) for i in members]
        ends, rest = [i for i, n in zip(members, sizes, strict=True) if n == end], [i for i, n in zip(members, sizes, strict=True) if n > end]
        return (seg, end, min(sizes), max(sizes), min(members), ends, []), rest

    def links(self, i: int, width: int, percent: int, skip):
        """Members j < i that link with member i, without those that skip(j)."""
        x = self.sets[i]
        has = np.zeros(width + 1, np.int32)
        has[x] = 1
        after = len(x) - np.cumsum(has)
        stack = [(self.root, 0)]
        while stack:
            (seg, end, shortest, longest, least, ends, children), overlap = stack.pop()
            if least >= i or 100 * min(len(x), longest) < percent * max(len(x), shortest):
                continue
            if not children and all(skip(j) for j in ends):
                continue
            rest = len(x)
            if len(seg):
                overlap += int(has[seg].sum())
                rest = int(after[seg[-1]])
            if (100 + percent) * (overlap + min(rest, longest - end)) < percent * (len(x) + shortest):
                continue
            for j in ends:
                if j < i and not skip(j) and (100 + percent) * overlap >= percent * (len(x) + len(self.sets[j])):
                    yield j
            stack += [(c, overlap) for c in children]


def join_unit(sets: list[np.ndarray], labels: list[int], percent: int) -> list[tuple[int, int]]:
    """Pairs of members, enough to connect all that links connect. Equal labels are connected already."""
    tokens, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, -count))] = np.arange(len(tokens))
    cut = np.cumsum([0, *map(len, sets)])
    ranked = [np.sort(rank[inverse[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    tree, root, by_label = PrefixTree(ranked), list(range(len(sets))), {}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, label in enumerate(labels):
        root[i] = by_label.setdefault(label, i)
    out = []
    for i in range(len(sets)):
        for j in tree.links(i, len(tokens), percent, lambda j, i=i: find(i) == find(j)):
            if find(i) != find(j):
                root[find(i)] = find(j)
                out.append((i, j))
    return out


def ngram_jaccard_join(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, doc_id, n_shingles, component_id, group) of each row of docs; uid is row_uid(), group the component, null for an empty set."""
    spark, buckets = docs.sparkSession, buckets_of(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_uid(id_col, text_col).alias("uid"), F.col(text_col).cast("string").alias("text"))

    fact_schema = pa.schema([("slice", pa.int32()), ("counts", pa.binary()), ("doc_id", pa.int64()), ("uid", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.int64())])

    def facts(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in batches:
            ids, uids = batch.column("doc_id"), batch.column("uid")
            for a, h, off in _sets(batch.column("text"), n):
                np.add.at(counts, _cell(h), 1)
                m = len(off) - 1
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), ids.slice(a, m), uids.slice(a, m), pa.array(np.diff(off), pa.int64()), pa.array(_digests(h, off))], schema=fact_schema)
        yield blob_batch([(i, x.tobytes(), None, None, None, None) for i, x in enumerate(counts.reshape(SLICES, -1)) if x.any()], fact_schema)

    all_facts = checkpointed(rows.mapInArrow(facts, "slice int, counts binary, doc_id long, uid long, n_shingles long, cls long"))
    found = all_facts.where("slice is null").select("doc_id", "uid", "n_shingles", "cls")

    def add_up(key, part):
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([sum(np.frombuffer(x, np.int32).astype(np.int64) for x in part.column("counts").to_pylist()).tobytes()], pa.binary())})

    counts = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.int64)
    for r in all_facts.where("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(add_up, "slice int, counts binary").toLocalIterator():
        counts[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    counts = counts.ravel()
    # 8 MB at every size of input; counts beyond its type are all the busiest.
    shared = spark.sparkContext.broadcast(np.minimum(counts, 2**31 - 1).astype(np.int32))
    del counts

    packed_schema = pa.schema([("bucket", pa.int32()), ("found", pa.bool_()), ("data", pa.binary())])

    def settle(t: np.ndarray):
        """One record of each shingle and class. A shingle that is heavy here already sends one record home, which says so."""
        t = t[np.lexsort((t["cls"], t["h"]))]
        t = t[np.concatenate([[True], (t["h"][1:] != t["h"][:-1]) | (t["cls"][1:] != t["cls"][:-1])])]
        cut = group_edges(t["h"])
        many = np.diff(cut) > LIGHT
        heads = t[cut[:-1][many]]
        heads["sent"] = 1
        known, rest = t[np.repeat(many, np.diff(cut))], np.concatenate([t[np.repeat(~many, np.diff(cut))], heads])
        for b, x in pack((rest["h"] % U(buckets)).astype(np.int64), rest, buckets):
            yield b, False, x
        for b, x in pack((mix(known["h"] ^ known["cls"].view(U)) % U(buckets)).astype(np.int64), known, buckets):
            yield b, True, x

    def tokens(batches):
        held, size = [], 0
        for batch in batches:
            for _, h, off in _sets(batch.column("text"), n):
                if not len(h):
                    continue
                at, owner = prefixes(h, off, shared.value, percent)
                t = np.zeros(len(at), TOKEN)
                t["h"], t["cls"], t["n"] = h[at], _digests(h, off)[owner], np.diff(off)[owner]
                held.append(t)
                size += len(t)
            if size > 2_000_000:
                yield from (blob_batch([r], packed_schema) for r in settle(np.concatenate(held)))
                held, size = [], 0
        if size:
            yield blob_batch(list(settle(np.concatenate(held))), packed_schema)

    met_schema = pa.schema([("heavy", pa.bool_()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32()), ("m", pa.int32()), ("c", pa.int64())])

    def batch_of(heavy: bool, a, b, n, m, c):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), heavy)), pa.array(a), pa.array(b), pa.array(n), pa.array(m), pa.array(c)], schema=met_schema)

    def meet(batches):
        """Heavy shingles as (shingle, class, size), and pairs of classes (x, y, sizes, light shingles that both have)."""
        done, rest = [], []
        for batch in batches:
            for known, x in zip(batch.column("found").to_pylist(), batch.column("data").to_pylist(), strict=True):
                (done if known else rest).append(x)
        t = unpack(rest, TOKEN)
        t = t[np.lexsort((t["cls"], t["h"]))]
        new = np.concatenate([[True], (t["h"][1:] != t["h"][:-1]) | (t["cls"][1:] != t["cls"][:-1]) | (t["sent"][1:] != t["sent"][:-1])]) if len(t) else np.zeros(0, bool)
        t = t[new]
        cut = group_edges(t["h"])
        size = np.diff(cut)
        heavy = (size > LIGHT) | (np.maximum.reduceat(t["sent"], cut[:-1]) > 0) if len(t) else np.zeros(0, bool)
        out = np.concatenate([t[np.repeat(heavy, size)], unpack(done, TOKEN)])
        out = out[out["sent"] == 0]
        yield batch_of(True, out["h"].view(np.int64), out["cls"], out["n"], np.zeros(len(out), np.int32), np.ones(len(out), np.int64))
        pairs = []
        for k in np.unique(size[~heavy & (size > 1)]):
            start = cut[:-1][~heavy & (size == k)]
            i, j = np.triu_indices(int(k), 1)
            x, y = t[(start[:, None] + i).ravel()], t[(start[:, None] + j).ravel()]
            fits = 100 * np.minimum(x["n"], y["n"]).astype(np.int64) >= percent * np.maximum(x["n"], y["n"]).astype(np.int64)
            pairs.append(np.stack([x["cls"][fits], y["cls"][fits], x["n"][fits], y["n"][fits]]))
        if pairs:
            p = np.concatenate(pairs, axis=1)
            p = p[:, np.lexsort((p[1], p[0]))]
            new = np.flatnonzero(np.concatenate([[True], (p[0, 1:] != p[0, :-1]) | (p[1, 1:] != p[1, :-1])])) if p.shape[1] else np.zeros(0, np.int64)
            c = np.diff(np.append(new, p.shape[1]))
            p = p[:, new]
            yield batch_of(False, p[0], p[1], p[2].astype(np.int32), p[3].astype(np.int32), c.astype(np.int64))

    met = rows.select("text").mapInArrow(tokens, "bucket int, found boolean, data binary").repartition("bucket").mapInArrow(meet, "heavy boolean, a long, b long, n int, m int, c long")
    met = checkpointed(met)
    heavy = checkpointed(met.where("heavy").select(F.col("a").alias("h"), F.col("b").alias("cls"), "n").distinct())
    # Sets that link share at least so many prefix shingles: all that they share up to the end of the prefix that ends
    # first, after which that set has no more than ceil(percent * n / 100) - 1 left.
    least = f"(ceil({percent} * (n + m) / {100 + percent}) - greatest(ceil({percent} * n / 100), ceil({percent} * m / 100)) + 1)"

    def worth_it(pairs: DataFrame, heavies: DataFrame) -> DataFrame:
        """(hub, cls) of the pairs (a, b, n, m, c) that may link; heavies (cls, heavies): a class's shingles that c leaves out."""
        weight = checkpointed(heavies.groupBy("cls").agg(F.count("*").alias("heavies")))
        pairs = pairs.groupBy("a", "b", "n", "m").agg(F.sum("c").alias("c"))
        pairs = pairs.join(weight.select(F.col("cls").alias("a"), F.col("heavies").alias("ha")), "a", "left").join(weight.select(F.col("cls").alias("b"), F.col("heavies").alias("hb")), "b", "left")
        pairs = pairs.where(f"c + least(coalesce(ha, 0), coalesce(hb, 0)) >= {least}")
        return checkpointed(pairs.select(F.col("a").alias("hub"), F.col("b").alias("cls")))

    light = worth_it(met.where("not heavy").drop("heavy"), heavy)
    discard(met)
    shared.destroy()  # read for the prefixes alone, which are written
    del shared

    needed = heavy.select("cls").unionByName(light.select(F.explode(F.array("hub", "cls")).alias("cls"))).distinct()
    one = found.groupBy("cls").agg(F.min("uid").alias("uid")).join(needed, "cls", "left_semi")

    set_schema = pa.schema([("cls", pa.int64()), ("shingles", pa.binary())])

    def sets(batches):
        for batch in batches:
            for a, h, off in _sets(batch.column("text"), n):
                m = len(off) - 1
                yield pa.RecordBatch.from_arrays([batch.column("cls").slice(a, m), pa.array([h[x:y].tobytes() for x, y in zip(off[:-1], off[1:], strict=True)], pa.binary())], schema=set_schema)

    texts = rows.join(one, "uid").select("cls", "text").mapInArrow(sets, "cls long, shingles binary")
    texts = checkpointed(texts)

    def joined(part: pa.Table) -> pa.Table:
        cls, seen, members = part.column("cls").to_pylist(), set(), []
        for i, c in enumerate(cls):
            if c not in seen:
                seen.add(c)
                members.append(i)
        held = part.column("shingles")
        labels = part.column("label").to_pylist()
        pairs = join_unit([np.frombuffer(held[i].as_py(), U) for i in members], [labels[i] for i in members], percent)
        return pa.table({"a": pa.array([cls[members[i]] for i, _ in pairs], pa.int64()), "b": pa.array([cls[members[j]] for _, j in pairs], pa.int64())})

    def labelled(units: DataFrame, labels: DataFrame | None) -> DataFrame:
        units = units.join(texts, "cls")
        return units.withColumn("label", F.col("cls")) if labels is None else units.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))

    def in_clusters(clusters: DataFrame, labels: DataFrame) -> DataFrame:
        """Links within the clusters (node, n, label).

        A cluster of more than CLUSTER sets falls into bands of sizes, of which
        sets link only with their own and the next; a band into blocks of about
        half as many, which meet two by two, and the next band's blocks.
        """
        total = clusters.groupBy("label").agg(F.count("*").alias("sets"))
        band = F.when(F.col("sets") <= CLUSTER, 0).otherwise(F.floor(F.log("n") / F.lit(float(np.log(100 / percent)) * (1 + 1e-9) if percent < 100 else 1e-9)))
        rows = clusters.join(total, "label").withColumn("band", band.cast("long"))
        size = checkpointed(rows.groupBy("label", "band").agg(F.ceil(F.count("*") * 2 / CLUSTER).alias("blocks")).withColumn("blocks", F.when(F.col("blocks") <= 2, 1).otherwise(F.col("blocks"))))
        near = [size.select("label", (F.col("band") - d).alias("band"), F.col("blocks").alias(name)) for d, name in ((1, "above"), (-1, "below"))]
        rows = rows.join(size, ["label", "band"]).join(near[0], ["label", "band"], "left").join(near[1], ["label", "band"], "left")
        rows = rows.withColumn("i", F.pmod(F.xxhash64("node"), "blocks"))
        others = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.array().cast("array<bigint>"))
        unit = lambda low, kind, x, y: F.struct(low.alias("low"), F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
        own = F.transform(others("blocks"), lambda j: unit(F.col("band"), 0, F.least("i", j), F.greatest("i", j)))
        up = F.transform(others("above"), lambda j: unit(F.col("band"), 1, F.col("i"), j))
        down = F.transform(others("below"), lambda j: unit(F.col("band") - 1, 1, j, F.col("i")))
        part = F.explode(F.concat(own, up, down))
        return labelled(rows.select(F.col("label").alias("hub"), F.col("node").alias("cls"), part.alias("part")), labels).groupBy("hub", "part").applyInArrow(joined, "a long, b long")

    def in_units(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
        """Links found among (hub, cls): each hub with its classes, UNIT of them at a time."""
        size = pairs.groupBy("hub").agg(F.ceil(F.count("*") / UNIT).alias("parts"))
        units = pairs.join(size, "hub").select("hub", F.pmod(F.xxhash64("cls"), "parts").alias("part"), "cls")
        units = units.unionByName(size.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hub").alias("cls")))
        return labelled(units, labels).groupBy("hub", "part").applyInArrow(joined, "a long, b long")

    labels, left = components(checkpointed(in_units(light, None))), heavy
    salt, salts = F.pmod(F.xxhash64("cls"), F.lit(SALTS)), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    fits = f"100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)"
    for k in range(PIVOT_ROUNDS + 2):
        t = left.select("h", "cls", "n").join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        mixed = t.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("classes")).where("lo <> hi").select("h", "classes")
        # A shingle of very many classes is dealt over SALTS tasks wherever rows meet by shingle.
        left = checkpointed(t.withColumn("salt", salt.cast("int")).join(mixed.select("h", "classes", salts), ["h", "salt"]).drop("salt"))
        if left.isEmpty():
            break
        pivots = left.groupBy("h").agg(F.min_by(F.struct("cls", "n"), F.xxhash64("cls", F.lit(k))).alias("hub")).select("h", "hub.*", salts)
        salted = left.withColumn("salt", salt.cast("int"))
        if k < PIVOT_ROUNDS:
            # A pair meets its hub in some of its shingles only, so half as many will do; the last round makes up for it.
            pairs = salted.alias("a").join(pivots.alias("b"), ["h", "salt"]).where(f"a.cls <> b.cls and {fits}")
            pairs = pairs.groupBy(F.col("b.cls").alias("hub"), F.col("a.cls").alias("cls"), F.col("a.n").alias("n"), F.col("b.n").alias("m")).agg(F.count("*").alias("c"))
            new = in_units(checkpointed(pairs.where(f"2 * c >= {least}").select("hub", "cls")), labels)
        elif k == PIVOT_ROUNDS:
            counted, left = left.where(F.col("classes") <= MIDDLE), left.where(F.col("classes") > MIDDLE)
            pairs = counted.alias("a").join(counted.alias("b"), "h").where(f"a.cls < b.cls and a.label <> b.label and {fits}")
            pairs = pairs.select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b"), F.col("a.n").alias("n"), F.col("b.n").alias("m"), F.lit(1).cast("long").alias("c"))
            new = in_units(worth_it(pairs, left), labels)
        else:
            ties = salted.select("h", "salt", F.col("cls").alias("a")).join(pivots.select("h", "salt", F.col("cls").alias("b")), ["h", "salt"]).select("a", "b")
            sizes = left.select(F.col("cls").alias("node"), "n").distinct()
            new = in_clusters(components(ties).join(sizes, "node"), labels)
        labels = connected(labels, checkpointed(new))
    # The result reads facts and labels alone; the steps after this one shouldn't find the sets on disk.
    discard(texts, heavy, light)

    of_class = found.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    of_label = of_class.join(labels.withColumnRenamed("node", "cls"), "cls").groupBy("label").agg(F.min("least").alias("least"))
    of_class = of_class.join(labels.withColumnRenamed("node", "cls"), "cls", "left").join(of_label.withColumnRenamed("least", "linked"), "label", "left").select("cls", F.coalesce("label", "cls").alias("group"), F.coalesce("linked", "least").alias("least"))
    out = found.join(of_class, "cls", "left")
    return out.select("uid", "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), "group")


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: Sets, links by their common shingles, and the components reached by recursion.
OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(words[p:p + 3], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS p FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS (SELECT doc_id, md5(string_agg(h, '' ORDER BY h)) AS k, count(*) AS n FROM s GROUP BY doc_id),
cls AS (SELECT k, min(doc_id) AS c, min(n) AS n FROM sets GROUP BY k),
t AS (SELECT c, h FROM s JOIN cls ON doc_id = c),
common AS (SELECT x.c AS a, y.c AS b, count(*) AS i FROM t x JOIN t y ON x.h = y.h AND x.c < y.c GROUP BY 1, 2),
link AS (
  SELECT a, b FROM common JOIN cls p ON p.c = a JOIN cls q ON q.c = b WHERE 100 * i >= 85 * (p.n + q.n - i)
), sides AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT c AS a, c AS b FROM cls UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a),
label AS (SELECT a, min(b) AS l FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(sets.n, 0) AS BIGINT) AS n_shingles, coalesce(l, w.doc_id) AS component_id
FROM w LEFT JOIN sets USING (doc_id) LEFT JOIN cls USING (k) LEFT JOIN label ON a = cls.c
"""
