from palimpsest.functions import codec
from palimpsest.operators import chunking, filters
from palimpsest.operators.audit import check_proof, fold, prove
from palimpsest.plans.repo import Repo
from pyspark.sql import functions as F

CONFIG = chunking.ChunkConfig(least=64, average=256, most=1024)


def rows(spark, files):
    return spark.createDataFrame([(k, v, 5) for k, v in files.items()], "path string, content binary, mtime_unix long")


def test_backup_restore_prune_and_bundles(spark, tmp_path):
    repo = Repo(spark, str(tmp_path / "repo"))
    one = {"a/x.txt": b"hello " * 500, "a/y.txt": b"", "b.bin": bytes(range(256)) * 20}
    two = {"a/x.txt": b"hello " * 500 + b"more", "b.bin": bytes(range(256)) * 20, "new": b"n" * 900}
    assert repo.backup(rows(spark, one), 1000, "j", CONFIG) == 1
    assert repo.backup(rows(spark, two), 100_000, "j", CONFIG) == 2
    got = {r["path"]: bytes(r["content"]) for r in repo.content(1).collect()}
    assert got == one
    assert {r["path"]: bytes(r["content"]) for r in repo.content().collect()} == two
    assert {(r["path"], r["status"]) for r in repo.diff(1, 2).collect()} == {("a/x.txt", "modified"), ("a/y.txt", "removed"), ("b.bin", "unchanged"), ("new", "added")}
    assert repo.verify().where("not ok").count() == 0
    report = repo.verify_chain().first()
    assert report["entries"] == 2 and report["bad_entries"] == 0
    repo.export(str(tmp_path / "full"))
    other = Repo(spark, str(tmp_path / "other"))
    other.apply(str(tmp_path / "full"))
    assert {r["path"]: bytes(r["content"]) for r in other.content(2).collect()} == two
    figures = repo.maintain(10**9, ((3600, 1),))
    assert figures["pruned"] == [] or figures["bad"] == 0
    assert repo.prune(10**9, ((3600, 1),), retain_min=1, dry_run=False) == [1]
    assert repo.gc(dry_run=False) > 0
    repo.compact()
    assert repo.orphans().count() == 0
    assert {r["path"]: bytes(r["content"]) for r in repo.content(2).collect()} == two


def test_watch_takes_new_files_once(spark, tmp_path):
    from palimpsest.streaming.watch import watch

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "f1").write_bytes(b"one" * 100)
    repo = Repo(spark, str(tmp_path / "repo"))
    for _ in range(2):
        watch(repo, str(folder), str(tmp_path / "cp"), lambda: 7).awaitTermination()
    assert [r["txn_id"] for r in repo.snapshots().collect()] == [1]
    (folder / "f2").write_bytes(b"two" * 100)
    watch(repo, str(folder), str(tmp_path / "cp"), lambda: 8).awaitTermination()
    assert [r["file_count"] for r in repo.snapshots().collect()] == [1, 2]
    assert {r["status"] for r in repo.diff(1, 2).collect()} == {"unchanged", "added"}


def test_scan_and_write(spark, tmp_path):
    from palimpsest.sources.files import read_files, scan, write_files

    df = spark.createDataFrame([("d/one", b"1"), ("d/e/two", b"22")], "path string, content binary")
    assert write_files(df, str(tmp_path / "t")) == 2
    found = {r["path"]: r["file_type"] for r in scan(spark, str(tmp_path / "t"), ("d/e",)).collect()}
    assert found == {".": "dir", "d": "dir", "d/one": "file"}
    assert sorted(bytes(r["content"]) for r in read_files(spark, str(tmp_path / "t")).collect()) == [b"1", b"22"]


def test_filter_clauses(spark):
    data = [("src/main.cc", "file", 10, 100, 0), ("src", "dir", 0, 50, 0), ("srcx/a.H", "file", 99, 200, 1), ("README", "file", 5, 300, 2)]
    df = spark.createDataFrame(data, "path string, file_type string, size long, mtime_unix long, uid long")
    run = lambda **k: {r["path"] for r in filters.FileFilter(**k).apply(df).collect()}
    assert run(include_paths=["src"]) == {"src/main.cc", "src"}
    assert run(exclude_globs=["*.cc"], name_globs=["*"]) == {"src", "srcx/a.H", "README"}
    assert run(extensions=["h"]) == {"srcx/a.H"}
    assert run(min_size=10) == {"src/main.cc", "src", "srcx/a.H"}
    assert run(mtime_after=100, mtime_before=200) == {"src/main.cc", "srcx/a.H"}
    assert run() == {r[0] for r in data}
    assert filters.FileFilter.parse("include_paths=a, b\nmin_size=3") == filters.FileFilter.parse('{"include_paths": ["a", "b"], "min_size": 3}')


def test_proofs(spark):
    import hashlib

    hashes = [hashlib.sha256(bytes([i])).hexdigest() for i in range(7)]
    df = spark.createDataFrame([(hashes,)], "h array<string>")
    root = df.select(fold(F.col("h")).alias("r")).first()["r"]
    for i in range(7):
        proof = spark.createDataFrame([(hashes[i], prove(hashes, i))], "leaf string, proof array<struct<sibling:string,is_right:boolean>>")
        assert proof.select(check_proof(F.col("leaf"), F.col("proof"), F.lit(root)).alias("ok")).first()["ok"]


def test_codec(spark):
    df = spark.createDataFrame([(b"a" * 1000, "txt"), (bytes(range(256)) * 4, "bin"), (b"", "x"), (b"q", "jpg")], "c binary, e string")
    out = df.select("c", codec.encode("c", F.lit(3)).alias("z"), codec.content_class(F.col("e"), F.col("c")).alias("k"), codec.rolling_checksum("c").alias("r")).collect()
    assert [r["k"] for r in out] == ["fast", "slow", "incompressible", "incompressible"]
    assert out[0]["z"]["codec"] == "zstd" and out[3]["z"]["codec"] == "raw"
    assert codec.slide_checksum(__import__("zlib").adler32(b"abcd"), ord("a"), ord("e"), 4) == __import__("zlib").adler32(b"bcde")


def test_commands(spark, tmp_path, capsys):
    import json

    from palimpsest.__main__ import main

    source = tmp_path / "src"
    (source / "d").mkdir(parents=True)
    (source / "d" / "one.txt").write_bytes(b"one" * 100)
    (source / "two.log").write_bytes(b"two" * 100)
    repo = str(tmp_path / "repo")
    main(["backup", repo, str(source), "--filter", "exclude_globs=*.log"])
    assert json.loads(capsys.readouterr().out)["txn_id"] == 1
    main(["browse-page", repo, "1"])
    assert json.loads(capsys.readouterr().out)["path"] == "d/one.txt"
    main(["restore", repo, str(tmp_path / "back")])
    assert json.loads(capsys.readouterr().out)["files"] == 1
    assert (tmp_path / "back" / "d" / "one.txt").read_bytes() == b"one" * 100
    main(["prune-snapshots", repo])
    assert json.loads(capsys.readouterr().out)["deleted"] == []


def test_conflict_suffixes_number_all_rows_by_range(spark):
    from palimpsest import catalog_queries as q
    from palimpsest.operators import filters

    from .conftest import SF

    assert q.QUERIES["conflict_suffixes"](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = [(f"p{i:05d}", "a/x.txt" if i % 7 else "b/y") for i in range(2000)] + [("q", None), ("z", "a/x_5.txt")]
    got = {r["path"]: (r["copy"], r["dest"]) for r in filters.copies(spark.createDataFrame(rows, "path string, dest string"), "dest", ("path",)).collect()}
    seen = {}
    for path, dest in sorted(rows):
        assert got[path] == (seen.setdefault(dest, 0), dest)
        seen[dest] += 1
    final = {r["path"]: r["final"] for r in filters.resolve_conflicts(spark.createDataFrame(rows, "path string, dest string")).collect()}
    assert len(final) == len(rows) and len(set(final.values())) == len(rows) and final["z"] == "a/x_5.txt"


def test_content_classes_sample_4096_bytes(spark, tmp_path):
    import math
    from collections import Counter

    from palimpsest import catalog_queries as q

    texts = ["a" * 200 + "".join(chr(33 + i * 7 % 90) for i in range(9000)), "a" * 5000 + "bcdefgh" * 900, "", None, "ü" * 3000, "xyz", "".join(chr(0x400 + i * 37 % 900) for i in range(4000))]
    rows = [(i, t, "en", "web") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["path"]: (r["bits"], r["content_class"]) for r in q.QUERIES["entropy_class"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        data = ((t or "") + (" [edited]" if i % 5 == 0 else "")).encode()[:4096]
        n = Counter(data)
        bits = -sum(c / len(data) * math.log2(c / len(data)) for c in n.values())
        packed = not data or (len(n) / len(data) > 0.95 and bits * 125 > 950)
        found = got[f"web/en/doc_{i:08d}.txt"]
        assert abs(found[0] - bits) < 1e-5
        assert found[1] == ("incompressible" if packed else "slow" if bits * 125 > 700 else "fast")
    assert {c for _, c in got.values()} == {"fast", "slow", "incompressible"}


def contents(repo, txn=None):
    return {r["path"]: bytes(r["content"]) for r in repo.content(txn).collect()}


A, B = {"a": b"hello " * 500, "b": bytes(range(256)) * 9, "e": b""}, {"a": b"hello " * 400 + b"end", "c": b"new" * 700}


def test_chunks_that_come_back_after_collection_are_stored_once(spark, tmp_path):
    repo = Repo(spark, str(tmp_path / "repo"))
    repo.backup(rows(spark, A), 1000, config=CONFIG)
    repo.backup(rows(spark, B), 2000, config=CONFIG)
    assert repo.prune(10**9, ((1, 1),), retain_min=1, dry_run=False) == [1]
    assert repo.gc(dry_run=False) > 0
    assert repo.backup(rows(spark, A), 3000, config=CONFIG) == 3
    assert contents(repo) == A and contents(repo, 2) == B
    assert repo.table("payloads").groupBy("hash").count().where("count > 1").isEmpty()
    assert repo.verify_roots().where("not ok").isEmpty() and repo.orphans().isEmpty()
    repo.compact()
    assert contents(repo, 3) == A and contents(repo, 2) == B


def test_a_run_that_dies_at_any_step_leaves_nothing_to_be_seen(spark, tmp_path, monkeypatch):
    repo = Repo(spark, str(tmp_path / "repo"))
    repo.backup(rows(spark, A), 1000, config=CONFIG)
    write, steps = Repo._write, []
    monkeypatch.setattr(Repo, "_write", lambda self, df, name, run, txn=None: steps.append(name) or write(self, df, name, run, txn))
    Repo(spark, str(tmp_path / "other")).backup(rows(spark, A), 1000, config=CONFIG)
    for k in range(len(steps) + 1):
        calls = []

        def dying(self, df, name, run, txn=None, calls=calls, k=k):
            if len(calls) == k:
                raise OSError("killed")
            calls.append(write(self, df, name, run, txn))
            return calls[-1]

        def torn(self, was, tables):
            at = self._at(f"{self.path}/commits/{was['number'] + 1:010d}.json")
            out = self._fs.create(at, False)
            out.write(b'{"number": 2, "tab')
            out.close()
            raise OSError("killed")

        with monkeypatch.context() as m:
            m.setattr(Repo, "_write", dying)
            if k == len(steps):
                m.setattr(Repo, "_commit", torn)
            try:
                repo.backup(rows(spark, B), 2000, config=CONFIG)
                raise AssertionError("not killed")
            except OSError:
                pass
        assert repo.snapshots().count() == 1 and repo.browse(1).count() == len(A) and repo.path_history("c").isEmpty()
    assert repo.backup(rows(spark, B), 2000, config=CONFIG) == 2
    assert contents(repo) == B and contents(repo, 1) == A
    assert repo.vacuum(0) > 0 and contents(repo) == B and contents(repo, 1) == A
    report = repo.verify_chain().first()
    assert (report["entries"], report["bad_entries"]) == (2, 0)


def test_the_second_of_two_runs_fails_and_can_be_tried_again(spark, tmp_path, monkeypatch):
    from palimpsest.plans.repo import Conflict

    repo, commit = Repo(spark, str(tmp_path / "repo")), Repo._commit
    repo.backup(rows(spark, A), 1000, config=CONFIG)

    def late(self, was, tables):
        monkeypatch.setattr(Repo, "_commit", commit)
        Repo(spark, self.path).backup(rows(spark, {"x": b"other" * 100}), 1500, config=CONFIG)
        commit(self, was, tables)

    monkeypatch.setattr(Repo, "_commit", late)
    try:
        repo.backup(rows(spark, B), 2000, config=CONFIG)
        raise AssertionError("no conflict")
    except Conflict:
        pass
    assert repo.backup(rows(spark, B), 2000, config=CONFIG) == 3 and contents(repo) == B and contents(repo, 2) == {"x": b"other" * 100}


def test_unchanged_files_are_not_cut_again(spark, tmp_path, monkeypatch):
    repo, cut = Repo(spark, str(tmp_path / "repo")), chunking.chunk
    repo.backup(rows(spark, A), 1000, config=CONFIG)
    seen = []
    monkeypatch.setattr(chunking, "chunk", lambda files, *a: seen.append(sorted(r["path"] for r in files.select("path").collect())) or cut(files, *a))
    changed = A | {"a": A["a"] + b"!", "n": b"q" * 99}
    repo.backup(rows(spark, changed), 2000, config=CONFIG)
    assert seen == [["a", "n"]] and contents(repo) == changed and contents(repo, 1) == A


def test_full_bundles_take_the_chain_and_dead_chunks_along(spark, tmp_path):
    repo = Repo(spark, str(tmp_path / "repo"))
    repo.backup(rows(spark, A), 1000, config=CONFIG)
    repo.backup(rows(spark, B), 2000, config=CONFIG)
    repo.delete_snapshot(1)
    dead = repo.gc(dry_run=False)
    repo.log("gc", orphans=dead)
    repo.export(str(tmp_path / "full"))
    other = Repo(spark, str(tmp_path / "other"))
    other.apply(str(tmp_path / "full"))
    assert contents(other) == B and other.table("tombstones").count() == dead and other.orphans().isEmpty()
    assert other.verify_chain().first()["entries"] == 3 and other.verify_chain().first()["bad_entries"] == 0
    other.apply(str(tmp_path / "full"))
    assert contents(other) == B and other.snapshots().count() == 1
    digest = other.chunks(2).first()["hash"]
    assert other.chunk(digest).first()["ok"]
    for call in (lambda: other.chunk("0" * 64), lambda: other.delete_snapshot(9), lambda: other.files(9)):
        try:
            call()
            raise AssertionError("found")
        except LookupError:
            pass


def test_restore_and_apply_in_place(spark, tmp_path):
    import os

    repo, root = Repo(spark, str(tmp_path / "repo")), tmp_path / "tree"
    schema = "path string, content binary, mtime_unix long, file_type string, mode int, link_target string"
    first = [("d", None, 1_600_000_000, "dir", 0o755, None), ("d/x", b"one" * 300, 1_600_000_001, "file", 0o640, None), ("k", b"keep", 1_600_000_002, "file", 0o644, None), ("l", None, 1_600_000_003, "symlink", None, "d/x"), ("gone", b"old", 5, "file", 0o644, None)]
    repo.backup(spark.createDataFrame(first, schema), 1000, config=CONFIG)
    second = [*first[:1], ("d/x", b"two" * 300, 1_600_000_009, "file", 0o640, None), *first[2:4], ("new", b"n" * 50, 1_600_000_010, "file", 0o644, None)]
    repo.backup(spark.createDataFrame(second, schema), 2000, config=CONFIG)
    assert repo.restore(str(root), 1) == {"file_count": 3, "bytes": 900 + 4 + 3}
    assert (root / "d" / "x").read_bytes() == b"one" * 300 and os.readlink(root / "l") == "d/x"
    assert int(os.stat(root / "d" / "x").st_mtime) == 1_600_000_001 and os.stat(root / "d" / "x").st_mode & 0o777 == 0o640 and int(os.stat(root / "d").st_mtime) == 1_600_000_000
    plan = repo.apply_in_place(str(root), 2, 1, dry_run=True)
    assert plan == {"written": 2, "kept": 3, "skipped": 1, "deleted": 0, "failed": 0, "bytes_written": 950} and not (root / "new").exists()
    (root / "k").write_bytes(b"mine")  # changed on disk, not between the snapshots: it is put back
    figures = repo.apply_in_place(str(root), 2, 1, on_orphan="delete")
    assert (figures["written"], figures["deleted"]) == (3, 1)
    assert (root / "d" / "x").read_bytes() == b"two" * 300 and (root / "k").read_bytes() == b"keep" and (root / "new").exists() and not (root / "gone").exists()
    (root / "d" / "x").write_bytes(b"both")
    assert repo.apply_in_place(str(root), 1, 2, on_conflict="fail")["failed"] == 1 and (root / "d" / "x").read_bytes() == b"both" and not (root / "gone").exists()
    assert repo.apply_in_place(str(root), 1, 2, on_conflict="skip")["skipped"] >= 1 and (root / "gone").read_bytes() == b"old"
    repo.apply_in_place(str(root), 1, 2, on_conflict="overwrite")
    assert (root / "d" / "x").read_bytes() == b"one" * 300


def test_push_takes_what_a_remote_lacks(spark, tmp_path):
    repo, remote = Repo(spark, str(tmp_path / "repo")), Repo(spark, str(tmp_path / "remote"))
    repo.backup(rows(spark, A), 1000, config=CONFIG)
    assert repo.push(remote) == [1] and contents(remote) == A
    repo.backup(rows(spark, A | B), 2000, config=CONFIG)
    plan = repo.sync_plan(remote).collect()
    assert [(r["txn_id"], r["base_txn"]) for r in plan] == [(2, 1)] and 0 < plan[0]["chunks"] < repo.table("payloads").count()
    assert repo.push(remote) == [2] and repo.push(remote) == [] and contents(remote) == A | B
    third = Repo(spark, str(tmp_path / "third"))
    assert third.pull(remote) == [1, 2] and contents(third, 1) == A


def test_jobs(spark):
    from palimpsest.operators import jobs

    schema = "id string, source string, window_start string, window_end string, enabled boolean, interval_seconds long"
    some = spark.createDataFrame([("a", "/a", None, None, True, 10), ("b", "", None, None, True, 10), ("c", "/c", "09:00", "10:00", True, 0), (None, "/d", None, None, False, 0)], schema)
    changed = jobs.upsert(some, spark.createDataFrame([("a", "/new", None, None, True, 99), ("e", "/e", None, None, True, 1)], schema))
    assert {r["id"]: r["source"] for r in changed.collect()} == {"a": "/new", "b": "", "c": "/c", None: "/d", "e": "/e"}
    assert {r["id"] for r in jobs.remove(changed, "a", "e").collect()} == {"b", "c", None}
    assert {(r["id"], r["reason"]) for r in jobs.invalid(some).collect()} == {("b", "no source"), (None, "no id")}
    runs = spark.createDataFrame([("a", 100), ("a", 50)], "job_id string, finished_at_unix long")
    due = lambda now, minute: {r["id"] for r in jobs.due(some, runs, now, minute).collect()}
    assert due(105, 0) == {"b"} and due(110, 545) == {"a", "b", "c"}


def test_policies_logs_and_reports(spark, tmp_path):
    import pytest

    from palimpsest.operators import retention
    from palimpsest.sources.logs import append_log, read_log, read_report, to_json
    from pyspark.sql import types as T

    assert retention.parse_policy("3600:24, 86400:7") == ((3600, 24), (86400, 7))
    for wrong in ("", "3600", "0:3", "a:b", "5:0", "5:-1"):
        with pytest.raises(ValueError):
            retention.parse_policy(wrong)
    schema = T.StructType([T.StructField("seq", T.LongType()), T.StructField("event", T.StringType())])
    append_log(spark.createDataFrame([("x",), ("y",)], "event string"), str(tmp_path / "log"))
    append_log(spark.createDataFrame([("z",)], "event string"), str(tmp_path / "log"), after=2)
    assert [(r["seq"], r["event"]) for r in read_log(spark, str(tmp_path / "log"), schema).orderBy("seq").collect()] == [(1, "x"), (2, "y"), (3, "z")]
    (tmp_path / "report.json").write_text('{\n "job": "a",\n "files": 3\n}\n')
    report = read_report(spark, str(tmp_path / "report.json"))
    assert (report.first()["job"], report.first()["files"]) == ("a", 3) and to_json(report).first()["json"] == '{"files":3,"job":"a"}'
    with pytest.raises(Exception, match="not a path within a root"):
        spark.createDataFrame([("../x",)], "p string").select(filters.remap(F.col("p"), "keep", strict=True)).collect()
