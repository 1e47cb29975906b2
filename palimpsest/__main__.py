"""python -m palimpsest COMMAND REPO ...: prints JSON, a row a line."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import catalog, restore, retention, suggestions
from .operators.filters import FileFilter
from .plans.repo import Repo
from .session import session
from .sources.files import read_files, scan


def _show(rows: DataFrame) -> None:
    for line in rows.toJSON().toLocalIterator():
        print(line)


def _files(spark, source: str, wanted: FileFilter) -> DataFrame:
    """Files below source with paths relative to it."""
    rows = read_files(spark, source)
    top = source.rstrip("/").split(":", 1)[-1].replace("//", "/") + "/"
    return wanted.apply(rows.withColumns({"path": F.substring_index("path", top, -1), "file_type": F.lit("file"), "uid": F.lit(0)})).select("path", "content", "mtime_unix")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="palimpsest")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *names: str, **options):
        c = sub.add_parser(name)
        c.add_argument("repo")
        for n in names:
            c.add_argument(n, type=int if n in ("txn", "a", "b") else str)
        for n, default in options.items():
            c.add_argument("--" + n.replace("_", "-"), default=default, action="store_true" if default is False else "store", **({} if default is False else {"type": type(default)}))

    command("backup", "source", filter="", job="", tier="balanced")
    command("restore", "target", txn=0, filter="")
    command("list-snapshots")
    command("diff", "a", "b")
    command("path-history", "path", offset=0, limit=100)
    command("browse-page", "txn", prefix="", offset=0, limit=100)
    command("repo-stats")
    command("orphan-explain")
    command("rpo-summary")
    command("verify")
    command("verify-chain")
    command("prune-snapshots", policy="", retain_min=retention.RETAIN_MIN, execute=False)
    command("gc-orphans", execute=False)
    command("compact")
    command("maintain")
    command("preview", "live", txn=0)
    command("apply", "live", txn=0, on_conflict="skip", on_orphan="skip", dry_run=False)
    command("get-chunk", "digest")
    command("delete-snapshot", "txn")
    command("vacuum", older_than=86400.0)
    command("export", "path", target=0, base=0)
    command("import", "path")
    command("suggest-excludes")
    command("watch", "source", "checkpoint", interval="")
    args = p.parse_args(argv)
    spark = session()
    repo, now = Repo(spark, args.repo), int(time.time())
    tiers = retention.parse_policy(args.policy) if getattr(args, "policy", "") else retention.DEFAULT_TIERS
    wanted = FileFilter.parse(args.filter) if getattr(args, "filter", "") else FileFilter()

    if args.command == "backup":
        print(json.dumps({"txn_id": repo.backup(_files(spark, args.source, wanted), now, args.job, tier=args.tier)}))
    elif args.command == "restore":
        rows = wanted.apply(repo.files(args.txn or None))
        print(json.dumps({"files": repo.restore(args.target, args.txn or None, rows.select("path"))["file_count"]}))
    elif args.command == "list-snapshots":
        _show(repo.snapshots())
    elif args.command == "diff":
        _show(repo.diff(args.a, args.b).where("status <> 'unchanged'").orderBy("path"))
    elif args.command == "path-history":
        _show(catalog.history_page(repo.table("files"), args.path, args.offset, args.limit))
    elif args.command == "browse-page":
        _show(repo.browse(args.txn, args.prefix, args.offset, args.limit))
    elif args.command == "repo-stats":
        _show(repo.stats())
    elif args.command == "orphan-explain":
        from .operators.store import orphan_explain

        _show(orphan_explain(repo.table("payloads"), repo.table("tombstones"), repo.chunks()))
    elif args.command == "rpo-summary":
        _show(repo.rpo(now))
    elif args.command == "verify":
        _show(repo.verify().groupBy("ok").agg(F.count("*").alias("chunks")))
    elif args.command == "verify-chain":
        _show(repo.verify_chain())
    elif args.command == "prune-snapshots":
        print(json.dumps({"deleted": repo.prune(now, tiers, args.retain_min, not args.execute)}))
    elif args.command == "gc-orphans":
        print(json.dumps({"orphans": repo.gc(not args.execute)}))
    elif args.command == "compact":
        repo.compact()
    elif args.command == "maintain":
        print(json.dumps(repo.maintain(now)))
    elif args.command == "preview":
        txn = args.txn or repo.snapshots().agg(F.max("txn_id")).first()[0]
        live = repo.live(args.live, txn)
        _show(restore.plan_summary(repo.plan_in_place(txn, live)))
    elif args.command == "apply":
        txn = args.txn or repo.snapshots().agg(F.max("txn_id")).first()[0]
        print(json.dumps(repo.apply_in_place(args.live, txn, on_conflict=args.on_conflict, on_orphan=args.on_orphan, dry_run=args.dry_run)))
    elif args.command == "get-chunk":
        _show(repo.chunk(args.digest).select("hash", F.octet_length("payload").alias("length"), "ok"))
    elif args.command == "delete-snapshot":
        repo.delete_snapshot(args.txn)
    elif args.command == "vacuum":
        print(json.dumps({"deleted": repo.vacuum(args.older_than)}))
    elif args.command == "export":
        repo.export(args.path, args.target or None, args.base or None)
    elif args.command == "import":
        repo.apply(args.path)
    elif args.command == "suggest-excludes":
        _show(suggestions.suggest(scan(spark, args.repo)))
    elif args.command == "watch":
        from .streaming.watch import watch

        watch(repo, args.source, args.checkpoint, lambda: int(time.time()), args.interval or None).awaitTermination()


if __name__ == "__main__":
    main()
