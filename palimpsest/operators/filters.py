"""Filters on file rows, and the projections of their paths."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..written import checkpointed


def normalized(path: Column) -> Column:
    """Backslashes as slashes, no slash at the end."""
    return F.rtrim(F.translate(path, "\\", "/"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(normalized(path), "/", -1)


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the name, null without one."""
    name = basename(path)
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1)))


def under(path: Column, prefix: str) -> Column:
    """Component prefix: the path itself or below it. An empty prefix holds everything."""
    p = prefix.replace("\\", "/").rstrip("/")
    if not p:
        return F.lit(True)
    n = normalized(path)
    return (n == p) | n.startswith(p + "/")


def glob_regex(pattern: str) -> str:
    """`*` is any text, slashes too, and `?` any character."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def glob(path: Column, pattern: str) -> Column:
    """A pattern with a slash is held against the whole path, another against the name."""
    whole = "/" in pattern or "\\" in pattern
    return (normalized(path) if whole else basename(path)).rlike(glob_regex(pattern.replace("\\", "/")))


def _any(clauses: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, clauses)


@dataclass
class FileFilter:
    """Clauses that all must hold; an empty one always does. max_size None: no bound."""

    include_paths: list[str] = field(default_factory=list)
    exclude_paths: list[str] = field(default_factory=list)
    include_globs: list[str] = field(default_factory=list)
    exclude_globs: list[str] = field(default_factory=list)
    name_globs: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=list)
    min_size: int = 0
    max_size: int | None = None
    mtime_after: int = 0
    mtime_before: int = 0
    uid: int = 0

    @classmethod
    def parse(cls, text: str) -> FileFilter:
        """From JSON, or from lines key=value with comma-joined lists; unknown keys are left out."""
        known = {f.name: f for f in fields(cls)}
        if text.lstrip().startswith("{"):
            values = json.loads(text)
        else:
            values = {}
            for line in text.splitlines():
                key, eq, value = line.partition("=")
                if eq and not line.lstrip().startswith("#"):
                    values[key.strip()] = value.strip()
        out = {}
        for key, value in values.items():
            if key in known:
                many = "list" in str(known[key].type)
                out[key] = [x.strip() for x in value.split(",") if x.strip()] if many and isinstance(value, str) else value if many else int(value)
        return cls(**out)

    def merged(self, other: FileFilter) -> FileFilter:
        """Lists joined, other's numbers where they are set."""
        out = {}
        for f in fields(self):
            a, b = getattr(self, f.name), getattr(other, f.name)
            out[f.name] = [*a, *(x for x in b if x not in a)] if isinstance(a, list) else b if b not in (0, None) else a
        return FileFilter(**out)

    def any_set(self) -> bool:
        return self != FileFilter()

    def condition(self, path: str = "path", size: str = "size", mtime: str = "mtime_unix", kind: str = "file_type", uid: str = "uid") -> Column:
        p, clauses = F.col(path), []
        if self.include_paths:
            clauses.append(_any([under(p, x) for x in self.include_paths]))
        if self.exclude_paths:
            clauses.append(~_any([under(p, x) for x in self.exclude_paths]))
        if self.include_globs:
            clauses.append(_any([glob(p, x) for x in self.include_globs]))
        if unwanted := self.exclude_globs or self.name_globs:  # the older list counts only where the newer is empty
            clauses.append(~_any([glob(p, x) for x in unwanted]))
        if self.extensions:
            clauses.append(F.coalesce(extension(p).isin([x.lstrip(".").lower() for x in self.extensions]), F.lit(False)))
        if self.min_size or self.max_size is not None:
            fits = F.col(size) >= self.min_size
            clauses.append((F.col(kind) != "file") | (fits if self.max_size is None else fits & (F.col(size) <= self.max_size)))
        if self.mtime_after:
            clauses.append(F.col(mtime) >= self.mtime_after)
        if self.mtime_before:
            clauses.append(F.col(mtime) <= self.mtime_before)
        if self.uid:
            clauses.append(F.col(uid) == self.uid)
        return reduce(lambda a, b: a & b, clauses) if clauses else F.lit(True)

    def apply(self, files: DataFrame, **columns: str) -> DataFrame:
        return files.where(self.condition(**columns)) if self.any_set() else files


def ancestors(path: Column) -> Column:
    """All proper directory prefixes of a path, as an array."""
    parts = F.split(normalized(path), "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat_ws("/", F.slice(parts, 1, i)))).otherwise(F.array().cast("array<string>"))


def with_ancestors(files: DataFrame, matched: DataFrame) -> DataFrame:
    """Rows of files that matched, and the rows of all their ancestor directories."""
    want = matched.select(F.explode(F.concat(F.array("path"), ancestors(F.col("path")))).alias("path")).distinct()
    return files.join(want, "path", "left_semi")


def collapse_includes(paths: DataFrame, col: str = "path") -> DataFrame:
    """Paths without those that a shorter one covers, by depth and name."""
    p = paths.select(normalized(F.col(col)).alias(col)).distinct()
    covered = p.select(col, F.explode(ancestors(F.col(col))).alias("up")).join(p.select(F.col(col).alias("up")), "up", "left_semi").select(col)
    return p.join(covered, col, "left_anti").withColumn("depth", F.size(F.split(col, "/")).cast("long"))


def remap(path: Column, mode: str, strip: int = 0, source: str = "", target: str = "", strict: bool = False) -> Column:
    """keep, strip (first components), flatten (name only) or prefix (source to target).

    Null: the row is skipped. A path that is absolute or leaves its root is null
    too; with strict it is an error.
    """
    n = normalized(path)
    bad = n.startswith("/") | n.rlike(r"(^|/)\.\.?(/|$)") | n.contains("//") | (n == "")
    if mode == "keep":
        out = n
    elif mode == "strip":
        parts = F.split(n, "/")
        out = F.when(F.size(parts) > strip, F.concat_ws("/", F.slice(parts, strip + 1, F.greatest(F.size(parts) - strip, F.lit(1)))))
    elif mode == "flatten":
        out = basename(n)
    elif mode == "prefix":
        s, t = source.replace("\\", "/").rstrip("/"), target.replace("\\", "/").rstrip("/")
        out = F.when(n == s, F.lit(t)).when(n.startswith(s + "/"), F.concat(F.lit(t), F.substr(n, F.lit(len(s) + 1)))).otherwise(n)
    else:
        raise ValueError(f"no such mode: {mode}")
    wrong = F.raise_error(F.concat(F.lit("not a path within a root: "), path)).cast("string") if strict else F.lit(None).cast("string")
    return F.when(bad, wrong).otherwise(out)


def remap_link(target: Column, source: str, to: str) -> Column:
    """A link's target moves only if it lies under source."""
    return F.when(under(target, source), remap(target, "prefix", source=source, target=to)).otherwise(target)


def copies(rows: DataFrame, dest: str, order: tuple[str, ...]) -> DataFrame:
    """rows with copy, their place in the order among the rows of one destination, from 0.

    As in audit.numbered(), rows are dealt by range and written, so a destination
    of many rows is numbered by many tasks; its rows in a range count on from
    those in the ranges before.
    """
    from pyspark.sql import Window

    dealt = checkpointed(rows.repartitionByRange(dest, *order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy(F.col("_range").alias("_r"), F.col(dest).alias("_d")).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_d").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_r", "_d", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_range", dest).orderBy(*order)) - 1
    out = dealt.withColumn("_in", within).join(before, (F.col("_range") == F.col("_r")) & F.col(dest).eqNullSafe(F.col("_d")))
    return out.withColumn("copy", F.col("_base") + F.col("_in")).drop("_range", "_r", "_d", "_base", "_in")


def resolve_conflicts(rows: DataFrame, dest: str = "dest", order: tuple[str, ...] = ("path",), policy: str = "suffix") -> DataFrame:
    """Rows with final: suffix names the nth row of one destination stem_n.ext, skip drops it, fail raises.

    A suffixed name that is a destination of its own is tried again with the
    next number, until no round finds such a one.
    """
    out = copies(rows, dest, order)
    if policy == "skip":
        return out.where("copy = 0").withColumn("final", F.col(dest)).drop("copy")
    if policy == "fail":
        return out.withColumn("final", F.when(F.col("copy") == 0, F.col(dest)).otherwise(F.raise_error(F.concat(F.lit("destination taken: "), F.col(dest))))).drop("copy")
    name, folder = basename(F.col(dest)), F.regexp_extract(dest, r"^(.*/)?", 0)
    stem = F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)(\.[^.]*)$", 1)).otherwise(name)
    tail = F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)(\.[^.]*)$", 2)).otherwise(F.lit(""))
    spelled = F.when(F.col("copy") == 0, F.col(dest)).otherwise(F.concat(folder, stem, F.lit("_"), F.col("copy").cast("string"), tail))
    taken = rows.select(F.col(dest).alias("final")).distinct()
    out = out.withColumn("final", spelled)
    while True:
        clash = out.where("copy > 0").join(taken, "final", "left_semi").select(F.col(dest).alias("d2"), F.col("copy").alias("c2"))
        if clash.isEmpty():
            return out.drop("copy")
        # All copies from the first clash of a destination on move up by one.
        first = clash.groupBy("d2").agg(F.min("c2").alias("c2"))
        out = checkpointed(out).join(first, F.col(dest).eqNullSafe(F.col("d2")), "left").withColumn("copy", F.col("copy") + (F.col("c2").isNotNull() & (F.col("copy") >= F.col("c2"))).cast("long")).drop("d2", "c2").withColumn("final", spelled)
