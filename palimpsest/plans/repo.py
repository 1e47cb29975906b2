"""A repository of snapshots: parquet tables under one folder, and a log of commits that says what is current.

Every run writes folders of its own, named by the run, and then one small file
in `commits`, which lists the folders that make up each table from then on. The
file is created under the next number or not at all, so that a run is seen whole
or not at all, a run that dies leaves nothing that anyone reads, and of two
runs that started from the same commit the second one fails and can be tried
again. Readers go by the newest whole commit. Dropping snapshots drops folders
from the list; vacuum() deletes folders that no commit lists any more.

Folders of files and chunks belong to one snapshot, so that reading a snapshot
opens its folders only.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..operators import audit, catalog, chunking, filters, reports, restore, retention, store

PARTS = {
    "files": "txn_id long, path string, size long, mtime_unix long, file_type string, mode int, uid long, gid long, inode_id long, content_hash string, link_target string",
    "chunks": "txn_id long, path string, idx long, offset long, length long, hash string",
    "payloads": "hash string, stored_len long, uncompressed_len long, codec string, pack_name string, data binary",
    "tombstones": "hash string",
    "snapshots": "txn_id long, created_at_unix long, merkle_root string, file_count long",
    "meta": "seq long, txn_id long, job_id string, retention_tag string, immutable_until long",
    "audit": "seq long, sequence long, prev_sha256 string, sha256 string, body_json string",
}
#: Tables whose folders belong to a snapshot each.
BY_SNAPSHOT = ("files", "chunks", "snapshots", "meta")
#: Rows of a table of paths up to which it is sent to all tasks, so that contents stay where they are.
SENT_PATHS = 100_000


class Conflict(RuntimeError):
    """Another run has committed since this one began; try again."""


class Repo:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # Commits

    def _names(self, folder: str) -> list[str]:
        at = self._at(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _state(self) -> dict:
        """The newest whole commit: its number, and the folders of each table as [txn or None, folder]."""
        for name in reversed(self._names("commits")):
            stream = self._fs.open(self._at(f"{self.path}/commits/{name}"))
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            if text.endswith("\n"):  # a torn file has no end
                return json.loads(text)
        return {"number": 0, "tables": {n: [] for n in PARTS}}

    def _commit(self, was: dict, tables: dict) -> None:
        number = max([was["number"], *(int(n[:10]) for n in self._names("commits") if n.endswith(".json"))]) + 1
        if self._state()["number"] != was["number"]:
            raise Conflict(f"commit {was['number']} isn't the newest any more")
        try:
            out = self._fs.create(self._at(f"{self.path}/commits/{number:010d}.json"), False)
        except Exception as e:  # the file exists
            raise Conflict(f"commit {number} is taken") from e
        out.write((json.dumps({"number": number, "tables": was["tables"] | tables}) + "\n").encode())
        out.close()

    def _write(self, rows: DataFrame, name: str, run: str, txn: int | None = None) -> list:
        folder = f"{name}/{run}"
        rows.select([f.split()[0] for f in PARTS[name].split(", ")]).write.mode("overwrite").parquet(f"{self.path}/{folder}")
        return [txn, folder]

    def table(self, name: str, *txns: int, state: dict | None = None) -> DataFrame:
        """A table as committed; of some snapshots only, their folders alone."""
        parts = [f"{self.path}/{folder}" for txn, folder in (state or self._state())["tables"][name] if not txns or txn in txns]
        return self.spark.read.schema(PARTS[name]).parquet(*parts) if parts else self.spark.createDataFrame([], PARTS[name])

    def vacuum(self, older_than: float = 86400.0) -> int:
        """Deletes folders that no commit lists and that are older than so many seconds, as runs may be going on. Their number."""
        listed = {folder for parts in self._state()["tables"].values() for _, folder in parts}
        gone, now = 0, time.time()
        for name in (*PARTS, "_staging"):
            for run in self._names(name):
                at = self._at(f"{self.path}/{name}/{run}")
                if f"{name}/{run}" not in listed and now - self._fs.getFileStatus(at).getModificationTime() / 1000 >= older_than:
                    self._fs.delete(at, True)
                    gone += 1
        return gone

    # Writing

    def backup(self, files: DataFrame, created_at: int, job: str = "", config: chunking.ChunkConfig | None = None, tier: str = "balanced", incremental: bool = True, retention_tag: str = "", immutable_until: int = 0) -> int:
        """Takes (path, content, mtime_unix and, where given, file_type, mode, uid, gid, inode_id, link_target) as the next snapshot; its number.

        Files whose size and time are those of the last snapshot keep its chunks
        and aren't cut again; others are cut where they lie. Only chunks without a
        stored payload are encoded, at the level that the tier has for the class
        of their content; a payload that was marked dead and is wanted again
        only loses its mark. Of rows that repeat a path the last time's counts.
        """
        was, run = self._state(), uuid.uuid4().hex
        last = self._last(was)
        txn, staged = last + 1, f"{self.path}/_staging/{run}"
        for name, kind in (("file_type", "string"), ("mode", "int"), ("uid", "long"), ("gid", "long"), ("inode_id", "long"), ("link_target", "string")):
            if name not in files.columns:
                files = files.withColumn(name, F.lit("file" if name == "file_type" else None).cast(kind))
        files = files.withColumn("content", F.when(F.col("file_type") == "file", F.coalesce(F.col("content").cast("binary"), F.lit(b""))))
        about = files.select("path", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("size"), F.col("mtime_unix").cast("long").alias("mtime_unix"), "file_type", "mode", "uid", "gid", "inode_id", "link_target").where("path is not null")
        about = self._staged(about.groupBy("path").agg(F.max_by(F.struct(*about.columns[1:]), F.struct("mtime_unix", "size")).alias("r")).select("path", "r.*"), f"{staged}/about")
        content = files.where("file_type = 'file' and path is not null").select("path", "content", F.col("mtime_unix").cast("long").alias("mtime_unix"))
        old = self.table("files", last, state=was) if incremental and last else None
        if old is not None:
            same = about.where("file_type = 'file'").join(old.where("file_type = 'file'").select("path", "size", "mtime_unix"), ["path", "size", "mtime_unix"], "left_semi").select("path")
            same = self._staged(same, f"{staged}/same")
            content = content.join(self._sent(same), "path", "left_anti")
            kept = self.table("chunks", last, state=was).join(same, "path", "left_semi")
        content = content.join(self._sent(about.select("path", "mtime_unix")), ["path", "mtime_unix"], "left_semi")
        cut = chunking.chunk(content.select("path", "content"), config).select("path", "idx", "offset", "length", "hash").dropDuplicates(["path", "idx"])
        cut = self._staged(cut, f"{staged}/cut")
        every = cut if old is None else cut.unionByName(kept.select(cut.columns))

        fresh = cut.groupBy("hash").agg(F.min(F.struct("path", "offset", "length")).alias("r")).select("hash", "r.*").join(self.table("payloads", state=was).select("hash"), "hash", "left_anti")
        wanted = self._staged(fresh.groupBy("path").agg(F.collect_list(F.struct("hash", "offset", "length")).alias("pieces")), f"{staged}/wanted")
        pieces = content.dropDuplicates(["path"]) if self._repeated(files) else content
        pieces = pieces.join(self._sent(wanted), "path").select("path", "content", F.explode("pieces").alias("r")).select("path", "r.hash", F.substring("content", F.col("r.offset") + 1, F.col("r.length")).alias("piece"))
        kind = codec.content_class(filters.extension(F.col("path")), F.col("piece"))
        level = F.when(kind == "incompressible", 0).otherwise(codec.tier_level(F.lit(tier), kind))
        done = pieces.select("hash", F.octet_length("piece").cast("long").alias("uncompressed_len"), codec.encode("piece", level).alias("e"))
        done = done.select("hash", F.octet_length("e.data").cast("long").alias("stored_len"), "uncompressed_len", F.col("e.codec").alias("codec"), F.concat(F.lit(f"{txn}-"), F.hex(store.shard())).alias("pack_name"), F.col("e.data").alias("data"))
        tables = {"payloads": [*was["tables"]["payloads"], self._write(done, "payloads", run, txn)]}

        dead = self.table("tombstones", state=was)
        back = every.select("hash").distinct().join(dead, "hash", "left_semi")
        if was["tables"]["tombstones"] and not back.isEmpty():  # a chunk that is wanted again isn't dead
            tables["tombstones"] = [self._write(dead.join(back, "hash", "left_anti"), "tombstones", run)]
        chunks = self._write(every.select(F.lit(txn).cast("long").alias("txn_id"), *cut.columns), "chunks", run, txn)
        every = self.spark.read.schema(PARTS["chunks"]).parquet(f"{self.path}/{chunks[1]}")
        roots = audit.content_hash(every, ["path"])
        rows = about.join(roots, "path", "left").withColumns({"txn_id": F.lit(txn).cast("long"), "content_hash": F.when(F.col("file_type") == "file", F.coalesce("content_hash", F.lit(audit.ZERO)))})
        new = {"chunks": chunks, "files": self._write(rows, "files", run, txn)}
        leaves = audit.numbered(every.select("path", "idx", "hash"), ["path", "idx"], lambda df: self._staged(df, f"{staged}/numbered"))
        root = audit.merkle_root(leaves).select("merkle_root").first()[0]
        tables["audit"] = [*was["tables"]["audit"], self._write(self._next_entry({"kind": "rar", "txn": txn, "root": root}, was), "audit", run)]
        one = self.spark.range(1)
        new["meta"] = self._write(one.select(F.lit(txn).cast("long").alias("seq"), F.lit(txn).cast("long").alias("txn_id"), F.lit(job).alias("job_id"), F.lit(retention_tag).alias("retention_tag"), F.lit(immutable_until).cast("long").alias("immutable_until")), "meta", run, txn)
        new["snapshots"] = self._write(one.select(F.lit(txn).cast("long").alias("txn_id"), F.lit(created_at).cast("long").alias("created_at_unix"), F.lit(root).alias("merkle_root"), F.lit(about.count()).cast("long").alias("file_count")), "snapshots", run, txn)
        self._commit(was, tables | {n: [*was["tables"][n], part] for n, part in new.items()})
        self._fs.delete(self._at(staged), True)
        return txn

    def _repeated(self, files: DataFrame) -> bool:
        return not files.groupBy("path").count().where("count > 1").isEmpty()

    def _sent(self, paths: DataFrame) -> DataFrame:
        """A staged table of paths: sent to all tasks if it is small, as counted."""
        return F.broadcast(paths) if paths.count() <= SENT_PATHS else paths

    def _staged(self, df: DataFrame, path: str) -> DataFrame:
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _next_entry(self, body: dict, state: dict) -> DataFrame:
        before = self.table("audit", state=state).agg(F.max_by(F.struct("sequence", "sha256"), "seq").alias("x")).first()["x"]
        n, prev = (before["sequence"], before["sha256"]) if before else (0, "")
        text = F.lit(json.dumps(body, separators=(",", ":")))
        return self.spark.range(1).select(F.lit(n + 1).cast("long").alias("seq"), F.lit(n + 1).cast("long").alias("sequence"), F.lit(prev).alias("prev_sha256"), F.sha2(text, 256).alias("sha256"), text.alias("body_json"))

    def log(self, event: str, **details) -> None:
        """Appends an entry about an operation to the audit chain."""
        was = self._state()
        entry = self._next_entry({"kind": "ops", "event": event} | details, was)
        self._commit(was, {"audit": [*was["tables"]["audit"], self._write(entry, "audit", uuid.uuid4().hex)]})

    # Reading

    def _last(self, state: dict) -> int:
        return max((txn for txn, _ in state["tables"]["snapshots"]), default=0)

    def snapshots(self) -> DataFrame:
        return self.table("snapshots").orderBy("txn_id")

    def files(self, txn: int | None = None) -> DataFrame:
        """The files of a snapshot; of the newest for None or 0. NotFound where there is none."""
        state = self._state()
        txn = txn or self._last(state)
        if txn not in {t for t, _ in state["tables"]["snapshots"]}:
            raise catalog.NotFound(f"no snapshot {txn}")
        return self.table("files", txn, state=state)

    def chunks(self, *txns: int) -> DataFrame:
        return self.table("chunks", *txns)

    def chunk(self, digest: str) -> DataFrame:
        """(hash, payload, ok) of one stored chunk: its bytes, and whether they still have its hash. NotFound where it isn't stored."""
        rows = store.live(self.table("payloads"), self.table("tombstones")).where(F.col("hash") == digest)
        if rows.isEmpty():
            raise catalog.NotFound(f"no chunk {digest}")
        payload = codec.decode("codec", "data")
        return rows.select("hash", payload.alias("payload"), (F.sha2(payload, 256) == F.col("hash")).alias("ok"))

    def content(self, txn: int | None = None, paths: DataFrame | None = None) -> DataFrame:
        """(path, content) of a snapshot's files, or of those in paths. It is an error if a chunk has no payload, or two."""
        files = self.files(txn).where("file_type = 'file'")
        if paths is not None:
            files = files.join(paths.select("path"), "path", "left_semi")
        txn = txn or self._last(self._state())
        rows = self.table("chunks", txn).join(files.select("path"), "path", "left_semi")
        stored = self.table("payloads").join(rows.select("hash").distinct(), "hash", "left_semi").groupBy("hash").agg(F.count("*").alias("n"), F.first("codec").alias("codec"), F.first("data").alias("data"))
        one = F.when(F.col("n") == 1, F.col("data")).otherwise(F.raise_error(F.concat(F.lit("not one payload of chunk "), "hash")).cast("binary"))
        whole = restore.reassemble(rows.join(stored, "hash", "left").select("path", "idx", codec.decode("codec", one).alias("payload")))
        return files.select("path").join(whole, "path", "left").select("path", F.coalesce("content", F.lit(b"")).alias("content"))

    def diff(self, a: int, b: int) -> DataFrame:
        return catalog.diff(self.files(a), self.files(b))

    def path_history(self, path: str) -> DataFrame:
        return catalog.path_history(self.table("files"), path)

    def browse(self, txn: int, prefix: str = "", offset: int = 0, limit: int = 100) -> DataFrame:
        return catalog.browse_page(self.files(txn), txn, prefix, offset, limit)

    def orphans(self) -> DataFrame:
        return store.orphans(self.table("payloads"), self.table("tombstones"), self.chunks())

    def stats(self) -> DataFrame:
        return store.repo_stats(self.table("payloads"), self.table("tombstones"), self.chunks())

    def reachability(self, txn: int) -> DataFrame:
        return store.reachability(self.chunks(txn), self.table("payloads"), self.table("tombstones"))

    def keep_set(self, policy=retention.DEFAULT_TIERS, retain_min: int = retention.RETAIN_MIN) -> DataFrame:
        return retention.keep_set(self.table("snapshots"), policy, retain_min)

    def rpo(self, now: int) -> DataFrame:
        return reports.rpo_summary(self.table("meta"), self.table("snapshots"), now)

    def delta(self, base: int, target: int) -> DataFrame:
        """Payloads that a repository with base lacks for target."""
        return self.table("payloads").join(store.delta_chunks(self.chunks(target), self.chunks(base)), "hash", "left_semi")

    def plan_in_place(self, target: int, live: DataFrame, base: int | None = None) -> DataFrame:
        base = base or catalog.base_txn(self.table("snapshots"), target).first()[0]
        none = self.spark.createDataFrame([], PARTS["files"])
        return restore.three_way(self.files(target), self.files(base) if base else none, live)

    def verify_chain(self) -> DataFrame:
        return audit.chain_report(self.table("audit"))

    def verify(self) -> DataFrame:
        """(hash, ok) of stored chunks: whether what decodes still has its hash."""
        p = store.live(self.table("payloads"), self.table("tombstones"))
        return p.select("hash", (F.sha2(codec.decode("codec", "data"), 256) == F.col("hash")).alias("ok"))

    def verify_roots(self) -> DataFrame:
        """(txn_id, path, ok) of all files: whether their chunks' root is their content hash, and every chunk has one payload."""
        stored = store.live(self.table("payloads"), self.table("tombstones")).groupBy("hash").agg(F.count("*").alias("n"))
        chunks = self.table("chunks").join(stored, "hash", "left")
        held = chunks.groupBy("txn_id", "path").agg(F.min(F.coalesce(F.col("n") == 1, F.lit(False))).alias("held"))
        roots = audit.content_hash(self.table("chunks"), ["txn_id", "path"]).withColumnRenamed("content_hash", "root")
        files = self.table("files").where("file_type = 'file'").join(roots, ["txn_id", "path"], "left").join(held, ["txn_id", "path"], "left")
        return files.select("txn_id", "path", ((F.coalesce("root", F.lit(audit.ZERO)) == F.col("content_hash")) & F.coalesce("held", F.lit(True))).alias("ok"))

    # Restoring

    def restore(self, root: str, txn: int | None = None, paths: DataFrame | None = None) -> dict:
        """Writes a snapshot below a root that all machines mount, directories first; figures of restore.acceptance()."""
        from ..sources.files import write_tree

        files = self.files(txn)
        files = files if paths is None else files.join(paths.select("path"), "path", "left_semi")
        write_tree(files.join(self.content(txn, paths), "path", "left"), root)
        return restore.acceptance(files).first().asDict()

    def live(self, root: str, target: int, base: int | None = None) -> DataFrame:
        """What lies below root, with the content hashes of files that are as in the target or the base."""
        from ..sources.files import live_tree

        base = base or catalog.base_txn(self.table("snapshots"), target).first()[0]
        txns = [t for t in (target, base) if t]
        return live_tree(self.spark, root, self.table("files", *txns), self.chunks(*txns))

    def apply_in_place(self, root: str, target: int, base: int | None = None, on_conflict: str = "skip", on_orphan: str = "skip", dry_run: bool = False, filter: filters.FileFilter | None = None) -> dict:
        """Makes what lies below root like a snapshot, by the three-way plan; figures of restore.apply_summary().

        With on_conflict fail nothing is written if anything conflicts.
        """
        from ..sources.files import delete_files, write_tree

        live = self.live(root, target, base)
        if filter:
            live = filter.apply(live)
        plan = restore.apply_plan(self.plan_in_place(target, live, base), on_conflict, on_orphan)
        plan = self._staged(plan, f"{self.path}/_staging/{uuid.uuid4().hex}")
        figures = restore.apply_summary(plan).first().asDict()
        if dry_run or figures["failed"]:
            return figures
        write = plan.where("decision = 'write'").select("path")
        write_tree(self.files(target).join(write, "path", "left_semi").join(self.content(target, write), "path", "left"), root)
        delete_files(plan.where("decision = 'delete'").select("path"), root)
        return figures

    # Maintenance

    def prune(self, now: int, policy=retention.DEFAULT_TIERS, retain_min: int = retention.RETAIN_MIN, dry_run: bool = True) -> list[int]:
        """Snapshots that the policy drops; unless dry_run their folders leave the tables. A row a snapshot."""
        was = self._state()
        plan = retention.prune_plan(self.table("snapshots", state=was), self.table("meta", state=was), now, policy, retain_min)
        gone = [r["txn_id"] for r in plan.where("decision = 'delete'").orderBy("txn_id").toLocalIterator()]
        if gone and not dry_run:
            self._drop(was, gone)
        return gone

    def delete_snapshot(self, txn: int) -> None:
        was = self._state()
        if txn not in {t for t, _ in was["tables"]["snapshots"]}:
            raise catalog.NotFound(f"no snapshot {txn}")
        self._drop(was, [txn])

    def _drop(self, was: dict, txns: list[int]) -> None:
        gone = set(txns)
        self._commit(was, {n: [p for p in was["tables"][n] if p[0] not in gone] for n in BY_SNAPSHOT})

    def gc(self, dry_run: bool = True) -> int:
        """Marks chunks that no snapshot refers to as dead. Their number."""
        was = self._state()
        dead = store.orphans(self.table("payloads", state=was), self.table("tombstones", state=was), self.table("chunks", state=was)).select("hash")
        n = dead.count()
        if n and not dry_run:
            self._commit(was, {"tombstones": [*was["tables"]["tombstones"], self._write(dead, "tombstones", uuid.uuid4().hex)]})
        return n

    def compact(self) -> None:
        """Keeps only payloads that are referred to and alive."""
        was, run = self._state(), uuid.uuid4().hex
        kept = store.compact(self.table("payloads", state=was), self.table("tombstones", state=was), self.table("chunks", state=was))
        self._commit(was, {"payloads": [self._write(kept, "payloads", run)], "tombstones": []})

    def maintain(self, now: int, policy=retention.DEFAULT_TIERS, most: float = 1.02, outbox: DataFrame | None = None) -> dict:
        """Prune, collect, compact where it pays, verify; figures before and after. Refused while an outbox holds pairs that aren't synced."""
        if outbox is not None:
            from ..streaming.watch import may_maintain

            if not may_maintain(outbox):
                return {"refused": "unsynced"}
        before = self.stats().first().asDict()
        pruned, dead = self.prune(now, policy, dry_run=False), self.gc(dry_run=False)
        s = self.stats().first()
        if s["amplification"] > most or s["orphan_bytes"] > 0:
            self.compact()
        return {"before": before, "pruned": pruned, "orphans": dead, "bad": self.verify().where("not ok").count(), "after": self.stats().first().asDict()}

    # Bundles

    def export(self, path: str, target: int | None = None, base: int | None = None) -> None:
        """All of the repository, or what target adds to base, as a folder of tables."""
        state = self._state()
        for name in PARTS:
            rows = self.table(name, state=state)
            if target is not None and name in BY_SNAPSHOT:
                rows = self.table(name, target, state=state)
            elif target is not None and name == "payloads":
                rows = self.delta(base, target) if base else rows.join(store.referenced(self.chunks(target)), "hash", "left_semi")
            elif target is not None:
                continue
            rows.write.parquet(f"{path}/{name}")

    # Syncing

    def sync_plan(self, remote: Repo) -> DataFrame:
        """(txn_id, base_txn, chunks, bytes) of the snapshots that a remote lacks, with what each adds to the newest that both have."""
        there = {t for t, _ in remote._state()["tables"]["snapshots"]}
        mine = sorted(t for t, _ in self._state()["tables"]["snapshots"])
        base, rows = max((t for t in mine if t in there), default=None), None
        for txn in (t for t in mine if t not in there):
            new = self.delta(base, txn) if base else self.table("payloads").join(store.referenced(self.chunks(txn)), "hash", "left_semi")
            one = new.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("stored_len"), F.lit(0)).alias("bytes")).select(F.lit(txn).cast("long").alias("txn_id"), F.lit(base).cast("long").alias("base_txn"), "chunks", "bytes")
            rows = one if rows is None else rows.unionByName(one)
        return rows if rows is not None else self.spark.createDataFrame([], "txn_id long, base_txn long, chunks long, bytes long")

    def push(self, remote: Repo) -> list[int]:
        """Takes the snapshots that a remote lacks there, the oldest first, each in one commit and verified; their numbers."""
        done = []
        for row in self.sync_plan(remote).orderBy("txn_id").toLocalIterator():  # a row a snapshot
            bundle = f"{remote.path}/_staging/{uuid.uuid4().hex}"
            self.export(bundle, row["txn_id"], row["base_txn"])
            remote.apply(bundle)
            remote._fs.delete(remote._at(bundle), True)
            if not remote.verify_roots().where((F.col("txn_id") == row["txn_id"]) & ~F.col("ok")).isEmpty():
                raise RuntimeError(f"snapshot {row['txn_id']} isn't whole at {remote.path}")
            done.append(row["txn_id"])
        return done

    def pull(self, remote: Repo) -> list[int]:
        return remote.push(self)

    def apply(self, path: str) -> None:
        """Takes a bundle in, in one commit: snapshots that are there already stay as they are.

        The audit chain comes with a full bundle into a repository that has none;
        marks of dead chunks come too, save of those that are alive here.
        """
        was, run, tables = self._state(), uuid.uuid4().hex, {}
        bundle = lambda n: self.spark.read.schema(PARTS[n]).parquet(f"{path}/{n}")
        has = lambda n: self._fs.exists(self._at(f"{path}/{n}"))
        known = {t for t, _ in was["tables"]["snapshots"]}
        txns = [r["txn_id"] for r in bundle("snapshots").select("txn_id").distinct().orderBy("txn_id").toLocalIterator()]  # a row a snapshot
        new = [t for t in txns if t not in known]
        for name in BY_SNAPSHOT:
            tables[name] = [*was["tables"][name], *(self._write(bundle(name).where(F.col("txn_id") == t), name, f"{run}-{t}", t) for t in new)]
        mine = self.table("payloads", state=was).select("hash")
        tables["payloads"] = [*was["tables"]["payloads"], self._write(bundle("payloads").join(mine, "hash", "left_anti"), "payloads", run)]
        dead = self.table("tombstones", state=was)
        wanted = bundle("chunks").where(F.col("txn_id").isin(new)).select("hash").distinct()
        dead = dead.join(wanted, "hash", "left_anti")
        if has("tombstones"):
            dead = dead.unionByName(bundle("tombstones").join(mine, "hash", "left_anti").join(wanted, "hash", "left_anti")).distinct()
        tables["tombstones"] = [self._write(dead, "tombstones", run)]
        if has("audit") and not was["tables"]["audit"]:
            tables["audit"] = [self._write(bundle("audit"), "audit", run)]
        self._commit(was, tables)


__all__ = ["Conflict", "Repo"]
