"""Suggestions of what to leave out of a backup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import basename, glob_regex

#: Names of directories and files that are rebuilt, cached or of no use elsewhere.
DIRECTORIES = (".git", ".svn", ".hg", "node_modules", "__pycache__", ".pytest_cache", ".mypy_cache", ".venv", "venv", "target", "build", "dist", "out", ".next", ".turbo", ".nuxt", ".output", ".gradle", ".cargo", "bin", "obj", ".cache", "coverage")
IDE_DIRECTORIES = (".idea", ".vscode")
FILES = ("thumbs.db", ".ds_store", "desktop.ini")
MOST = 32


def suggest(files: DataFrame, directories=DIRECTORIES, names=FILES) -> DataFrame:
    """(pattern, apply_as, hits, example): known names, by how many rows have them."""
    spark = files.sparkSession
    known = spark.createDataFrame([(n, "dir") for n in directories] + [(n, "file") for n in names], "pattern string, apply_as string")
    rows = files.select("path", F.lower(basename(F.col("path"))).alias("pattern"), F.col("file_type").alias("apply_as"))
    hit = rows.join(F.broadcast(known), ["pattern", "apply_as"])  # a constant list
    out = hit.groupBy("pattern", "apply_as").agg(F.count("*").alias("hits"), F.min("path").alias("example"))
    return out.orderBy(F.desc("hits"), "pattern").limit(MOST)


def suppress(suggestions: DataFrame, excludes: list[str]) -> DataFrame:
    """Suggestions without those that an exclusion covers: as a path prefix either way, or as a glob."""
    s, clauses = F.col("example"), F.lit(False)
    for x in excludes:
        p = x.rstrip("/")
        clauses = clauses | (s == p) | s.startswith(p + "/") | F.lit(p).startswith(F.concat(s, F.lit("/"))) | F.col("pattern").rlike(glob_regex(p))
    return suggestions.where(~clauses)
