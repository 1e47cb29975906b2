"""Live file trees as rows."""

from __future__ import annotations

import os
import stat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_DEPTH = 64
KINDS = ((stat.S_ISREG, "file"), (stat.S_ISDIR, "dir"), (stat.S_ISLNK, "symlink"), (stat.S_ISFIFO, "fifo"), (stat.S_ISBLK, "block"), (stat.S_ISCHR, "char"))
SCAN = "path string, file_type string, size long, mtime_unix long, mode int, uid long, gid long, inode_id long, link_target string, issue string"


def read_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """Contents of a tree on any file system that Spark reads: (path, size, mtime_unix, content)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(root).select("path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime_unix"), "content")


def _row(root: str, path: str) -> tuple:
    rel = os.path.relpath(path, root).replace(os.sep, "/")
    try:
        s = os.lstat(path)
    except PermissionError:
        return rel, None, None, None, None, None, None, None, None, "permission_denied"
    except OSError:
        return rel, None, None, None, None, None, None, None, None, "unreadable"
    kind = next((k for test, k in KINDS if test(s.st_mode)), "other")
    link = os.readlink(path) if kind == "symlink" else None
    return rel, kind, s.st_size, int(s.st_mtime), stat.S_IMODE(s.st_mode), s.st_uid, s.st_gid, s.st_ino, link, None


def scan(spark: SparkSession, root: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """A tree on a file system that all machines mount, with the root itself; issue says why a row is incomplete.

    The driver lists the root's own entries; each is walked by a task. Paths under
    a prefix in skip are never visited. Directories deeper than MAX_DEPTH are
    reported, not entered, and links are reported, not followed.
    """
    hints = tuple(s.strip("/") for s in skip)
    covered = lambda rel: any(rel == h or rel.startswith(h + "/") for h in hints)
    tops = sorted(os.listdir(root)) if os.path.isdir(root) else []

    def walk(batches):
        for batch in batches:
            for top in batch.column(0).to_pylist():
                rows, stack = [], [(os.path.join(root, top) if top else root, 1)]
                while stack:
                    path, depth = stack.pop()
                    row = _row(root, path)
                    if covered(row[0]):
                        continue
                    if row[1] == "dir" and top:
                        if depth >= MAX_DEPTH:
                            row = (*row[:-1], "depth_exceeded")
                        else:
                            try:
                                stack += [(os.path.join(path, n), depth + 1) for n in sorted(os.listdir(path), reverse=True)]
                            except PermissionError:
                                row = (*row[:-1], "permission_denied")
                            except OSError:
                                row = (*row[:-1], "unreadable")
                    rows.append(row)
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 10
                types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[f.split()[0] for f in SCAN.split(", ")])

    start = spark.createDataFrame([("",), *((t,) for t in tops)], "top string")
    return start.repartition(max(1, min(len(tops), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(walk, SCAN)


def write_files(files: DataFrame, root: str) -> int:
    """Writes (path, content) below a root that all machines mount; each file appears at once. The number of files."""
    base = os.path.abspath(root)

    def put(batches):
        for batch in batches:
            n = 0
            for r in batch.to_pylist():
                to = os.path.abspath(os.path.join(base, r["path"]))
                if not to.startswith(base + os.sep):
                    raise ValueError(f"path leaves the root: {r['path']}")
                os.makedirs(os.path.dirname(to), exist_ok=True)
                part = f"{to}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(r["content"] or b"")
                os.replace(part, to)
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _inside(base: str, path: str) -> str:
    to = os.path.abspath(os.path.join(base, path))
    if not to.startswith(base + os.sep):
        raise ValueError(f"path leaves the root: {path}")
    return to


def _each(rows: DataFrame, act) -> int:
    """Runs act(row) for every row, where the rows lie; their number."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                act(r)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_tree(files: DataFrame, root: str) -> int:
    """Writes (path, file_type, content, mode, mtime_unix, link_target) below a root that all machines mount.

    Directories come first, then files and links, each at once; times of
    directories are set last, since writing into them changes them. A null mode
    or time is left as it comes. Other types than these are left out. The number
    of rows written.
    """
    base = os.path.abspath(root)
    os.makedirs(base, exist_ok=True)

    def times(r, to):
        if r["mtime_unix"] is not None:
            os.utime(to, (r["mtime_unix"], r["mtime_unix"]))

    def make(r):
        to = _inside(base, r["path"])
        if os.path.islink(to) or os.path.isfile(to):
            os.unlink(to)
        os.makedirs(to, exist_ok=True)

    def put(r):
        to = _inside(base, r["path"])
        os.makedirs(os.path.dirname(to), exist_ok=True)
        part = f"{to}.{os.getpid()}.part"
        if r["file_type"] == "symlink":
            os.symlink(r["link_target"] or "", part)
            os.replace(part, to)
            return
        with open(part, "wb") as f:
            f.write(r["content"] or b"")
        if r["mode"] is not None:
            os.chmod(part, r["mode"])
        times(r, part)
        os.replace(part, to)

    def finish(r):
        to = _inside(base, r["path"])
        if r["mode"] is not None:
            os.chmod(to, r["mode"])
        times(r, to)

    rows = files.select("path", "file_type", F.col("content").cast("binary").alias("content"), F.col("mode").cast("int").alias("mode"), F.col("mtime_unix").cast("long").alias("mtime_unix"), "link_target").where("path <> '.'")
    folders = rows.where("file_type = 'dir'").drop("content")
    n = _each(folders, make) + _each(rows.where("file_type in ('file', 'symlink')"), put)
    _each(folders, finish)
    return n


def delete_files(paths: DataFrame, root: str) -> int:
    """Deletes files and links below a root that all machines mount; those that are gone already are no error."""
    base = os.path.abspath(root)

    def drop(r):
        to = _inside(base, r["path"])
        if os.path.islink(to) or os.path.isfile(to):
            os.unlink(to)

    return _each(paths.select("path"), drop)


def live_tree(spark: SparkSession, root: str, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """scan() with the content hash of each file that is as it was in some snapshot; null for others.

    files and chunks are those of the snapshots in question. A file of the size
    that it had is read at the places of its chunks there.
    """
    from ..operators.audit import content_hash

    base = os.path.abspath(root)

    def read(batches):
        import hashlib

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                try:
                    with open(_inside(base, r["path"]), "rb") as f:
                        f.seek(r["offset"])
                        out.append(hashlib.sha256(f.read(r["length"])).hexdigest())
                except OSError:
                    out.append("")
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.string())], names=["txn_id", "path", "idx", "hash"])

    tree = scan(spark, root).where("path <> '.'")
    known = files.where("file_type = 'file'").select("txn_id", "path", "size", F.col("content_hash").alias("was"))
    same = tree.where("file_type = 'file'").select("path", "size").join(known, ["path", "size"])
    hashes = chunks.select("txn_id", "path", "idx", "offset", "length").join(same, ["txn_id", "path"], "left_semi").mapInArrow(read, "txn_id long, path string, idx long, hash string")
    roots = same.join(content_hash(hashes, ["txn_id", "path"]), ["txn_id", "path"], "left")
    held = roots.where(F.coalesce("content_hash", F.lit("0" * 64)) == F.col("was")).groupBy("path").agg(F.max_by("was", "txn_id").alias("content_hash"))
    return tree.join(held, "path", "left").withColumn("uid", F.coalesce("uid", F.lit(0)))
