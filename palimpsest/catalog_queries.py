"""Queries over the repository-shaped views, and DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import views as V
from .functions import codec, times
from .operators import audit, catalog, chunking, filters, jobs, reports, restore, retention, store, suggestions
from .written import checkpointed

QUERIES: dict = {}
ORACLE_SQL: dict = {}
NOW = V.NOW

FILES = """files AS (
  SELECT t.txn_id, d.doc_id, concat(d.source, '/', d.lang, '/doc_', lpad(CAST(d.doc_id AS VARCHAR), 8, '0'), '.txt') AS path,
    CASE WHEN t.txn_id >= 2 AND d.doc_id % 5 = 0 THEN concat(d.text, ' [edited]') ELSE d.text END AS content,
    CAST(1700000000 + d.doc_id * 60 + CASE WHEN t.txn_id >= 2 AND d.doc_id % 5 = 0 THEN 86400 ELSE 0 END AS BIGINT) AS mtime_unix, 'file' AS file_type, d.doc_id % 3 AS uid
  FROM documents d CROSS JOIN (SELECT CAST(unnest([1, 2, 3]) AS BIGINT) AS txn_id) t
  WHERE (t.txn_id = 1 AND d.doc_id % 10 <> 9) OR (t.txn_id = 2 AND d.doc_id % 7 <> 0) OR t.txn_id = 3
), f AS (SELECT *, CAST(octet_length(encode(content)) AS BIGINT) AS size, sha256(content) AS content_hash FROM files)"""
CHUNKS = FILES + f""", pieces AS (
  SELECT txn_id, path, content, CAST(unnest(range(0, CAST(ceil(length(content) / {V.CHUNK_CHARS}.0) AS BIGINT))) AS BIGINT) AS idx FROM files WHERE length(content) > 0
), p AS (SELECT txn_id, path, idx, substr(content, CAST(idx * {V.CHUNK_CHARS} + 1 AS INT), {V.CHUNK_CHARS}) AS piece FROM pieces),
chunks AS (SELECT txn_id, path, idx, idx * {V.CHUNK_CHARS} AS "offset", CAST(octet_length(encode(piece)) AS BIGINT) AS length, sha256(piece) AS hash FROM p)"""
STORE = CHUNKS + """, store AS (
  SELECT hash, min(length) AS stored_len, min(length) AS uncompressed_len, CASE WHEN substr(hash, 1, 1) < '8' THEN 'raw' ELSE 'zstd' END AS codec, substr(hash, 2, 1) AS pack_name FROM chunks GROUP BY hash
), dead AS (SELECT hash FROM store WHERE ends_with(hash, 'f')), live AS (SELECT * FROM store ANTI JOIN dead USING (hash)),
c12 AS (SELECT DISTINCT hash FROM chunks WHERE txn_id IN (1, 2)), c1 AS (SELECT DISTINCT hash FROM chunks WHERE txn_id = 1), c3 AS (SELECT DISTINCT hash FROM chunks WHERE txn_id = 3)"""
SNAPSHOTS = """days AS (SELECT DISTINCT date_trunc('day', o_orderdate) AS day FROM orders),
snapshots AS (SELECT row_number() OVER (ORDER BY day) AS txn_id, CAST(epoch(day) AS BIGINT) AS created_at_unix FROM days),
meta AS (SELECT txn_id, concat('job', txn_id % 4) AS job_id, CASE WHEN txn_id % 97 = 0 THEN 1800000001 ELSE 0 END AS immutable_until FROM snapshots)"""
KEPT = SNAPSHOTS + ", kept AS (SELECT txn_id FROM (SELECT txn_id FROM snapshots ORDER BY txn_id DESC LIMIT 3)" + "".join(
    f" UNION SELECT txn_id FROM (SELECT max(txn_id) AS txn_id, created_at_unix // {s} AS b FROM snapshots GROUP BY b ORDER BY b DESC LIMIT {k})" for s, k in retention.DEFAULT_TIERS
) + ")"
REPORTS = "reports AS (SELECT event_id AS seq, concat('job', user_id % 6) AS job_id, CAST(floor(epoch(ts)) AS BIGINT) AS finished_at_unix, event_type AS status FROM events WHERE event_id IS NOT NULL)"
CHAIN = """o AS (SELECT DISTINCT o_orderkey AS k FROM orders), b AS (
  SELECT k, concat('{"kind":"', CASE WHEN k % 3 = 0 THEN 'ops' ELSE 'rar' END, '","k":', k, '}') AS body, row_number() OVER (ORDER BY k) AS sequence FROM o
), h AS (SELECT *, sha256(body) AS sha256 FROM b),
chain AS (SELECT k AS seq, sequence, coalesce(lag(sha256) OVER (ORDER BY k), '') AS prev_sha256, sha256, CASE WHEN k % 50 = 0 THEN '{}' ELSE body END AS body_json FROM h)"""
DIFF = FILES + """, diff AS (
  SELECT path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.content_hash <> b.content_hash OR a.size <> b.size THEN 'modified' ELSE 'unchanged' END AS status, a.size AS size_a, b.size AS size_b
  FROM (SELECT * FROM f WHERE txn_id = 1) a FULL OUTER JOIN (SELECT * FROM f WHERE txn_id = 2) b USING (path))"""
TREE = FILES + """, leaf AS (
  SELECT concat(path, '.d/', ['node_modules', 'Build', '__pycache__', 'src'][CAST(doc_id % 4 + 1 AS INT)], '/', CASE WHEN doc_id % 6 = 0 THEN 'Thumbs.db' ELSE 'a.txt' END) AS path FROM f WHERE txn_id = 3
), parts AS (SELECT path, string_split(path, '/') AS s FROM leaf),
tree AS (SELECT path, 'file' AS file_type FROM leaf UNION ALL SELECT DISTINCT array_to_string(s[1:i], '/') AS path, 'dir' AS file_type FROM (SELECT s, unnest(range(1, len(s))) AS i FROM parts)),
known AS (SELECT unnest([{d}]) AS pattern, 'dir' AS apply_as UNION ALL SELECT unnest([{n}]), 'file')""".replace("{d}", ", ".join(f"'{x}'" for x in suggestions.DIRECTORIES)).replace("{n}", ", ".join(f"'{x}'" for x in suggestions.FILES))
THREE = FILES + """, t AS (SELECT * FROM f WHERE txn_id = 2), b AS (SELECT * FROM f WHERE txn_id = 1),
l AS (
  SELECT path, CASE WHEN doc_id % 19 = 0 THEN 'symlink' ELSE 'file' END AS file_type, size, mtime_unix, CASE WHEN doc_id % 17 = 0 THEN sha256(concat(content_hash, 'x')) ELSE content_hash END AS content_hash FROM f WHERE txn_id = 3 AND doc_id % 13 <> 0
  UNION ALL SELECT concat('extra/', path), 'file', size, mtime_unix, content_hash FROM f WHERE txn_id = 3 AND doc_id % 23 = 0
), j AS (
  SELECT coalesce(t.path, l.path) AS path, t.path IS NOT NULL AS planned, b.path IS NOT NULL AS has_b, l.path IS NOT NULL AS has_l, t.file_type <> l.file_type AS other, t.content_hash = b.content_hash AS kept,
    t.content_hash = l.content_hash AS same_tl, b.content_hash = l.content_hash AS same_bl, t.size = l.size AND t.mtime_unix = l.mtime_unix AS alike, l.file_type AS lt, coalesce(t.size, 0) AS target_size
  FROM t LEFT JOIN b ON t.path = b.path FULL OUTER JOIN l ON t.path = l.path
), plan AS (
  SELECT path,
    CASE WHEN NOT planned THEN 'present' WHEN NOT has_l THEN 'missing' WHEN other THEN 'diverged' WHEN NOT has_b THEN CASE WHEN alike THEN 'matches_target' ELSE 'diverged' END WHEN same_tl THEN 'matches_target' WHEN NOT kept AND same_bl THEN 'matches_base' ELSE 'diverged' END AS live_state,
    CASE WHEN NOT planned THEN '' WHEN NOT has_l OR other THEN CASE WHEN NOT has_b THEN 'absent' WHEN other THEN 'changed' WHEN kept THEN 'same' ELSE 'changed' END WHEN NOT has_b THEN '' WHEN kept THEN 'same' ELSE 'changed' END AS base_action,
    CASE WHEN NOT planned THEN 'orphan' WHEN NOT has_l THEN 'add' WHEN other THEN 'conflict' WHEN NOT has_b THEN CASE WHEN alike THEN 'unchanged' ELSE 'modify' END WHEN same_tl THEN 'unchanged' WHEN kept OR same_bl THEN 'modify' ELSE 'both_changed' END AS action,
    CASE WHEN NOT planned THEN 'not_in_snapshot' WHEN has_l AND other THEN 'type_mismatch' ELSE '' END AS reason, target_size
  FROM j WHERE planned OR lt = 'file')"""


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _sides(s, d):
    f = V.files(s, d, (1, 2))
    return f.where("txn_id = 1"), f.where("txn_id = 2")


@query(f"WITH {DIFF} SELECT path, status, coalesce(size_a, -1) AS size_a, coalesce(size_b, -1) AS size_b FROM diff")
def snapshot_diff(s, d):
    """Sizes are -1 where a side has no such file."""
    return catalog.diff(*_sides(s, d)).na.fill(-1, ["size_a", "size_b"])


@query(f"WITH {DIFF} SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'modified') AS modified, count(*) FILTER (status = 'unchanged') AS unchanged, CAST(coalesce(sum(size_b) FILTER (status = 'added'), 0) AS BIGINT) AS bytes_added, CAST(coalesce(sum(size_a) FILTER (status = 'removed'), 0) AS BIGINT) AS bytes_removed FROM diff")
def diff_summary(s, d):
    return catalog.diff_summary(catalog.diff(*_sides(s, d)))


@query(f"WITH {CHUNKS}, x AS (SELECT DISTINCT hash FROM chunks WHERE txn_id = 1), y AS (SELECT DISTINCT hash FROM chunks WHERE txn_id = 2) SELECT count(*) AS chunks, count(x.hash) AS shared, count(x.hash) / count(*) AS reuse_ratio FROM y LEFT JOIN x USING (hash)")
def chunk_reuse_ratio(s, d):
    return catalog.reuse_ratio(V.chunks(s, d, (1,)), V.chunks(s, d, (2,)))


@query(f"WITH {FILES} SELECT txn_id, path, size, content_hash FROM f WHERE doc_id = 30")
def path_history(s, d):
    f = V.files(s, d)
    return f.where("doc_id = 30").select("txn_id", "path", "size", "content_hash").orderBy("txn_id")


@query(f"WITH {FILES}, h AS (SELECT txn_id, path, size FROM f WHERE path = (SELECT min(path) FROM f WHERE txn_id = 3)) SELECT *, (SELECT count(*) FROM h) AS total FROM h ORDER BY txn_id LIMIT 2 OFFSET 1")
def path_history_page(s, d):
    f = V.files(s, d)
    first = f.where("txn_id = 3").agg(F.min("path").alias("path"))
    rows = f.join(F.broadcast(first), "path", "left_semi").select("txn_id", "path", "size")  # first is one row
    return catalog.page(rows, ["txn_id"], 1, 2, 100)


@query(f"WITH {FILES} SELECT path, size, (SELECT count(*) FROM f WHERE txn_id = 2 AND starts_with(path, 'src1')) AS total FROM f WHERE txn_id = 2 AND starts_with(path, 'src1') ORDER BY path LIMIT 25 OFFSET 10")
def browse_page(s, d):
    return catalog.browse_page(V.files(s, d, (2,)), 2, "src1", 10, 25).select("path", "size", "total")


@query(f"WITH {FILES} SELECT source_dir, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT string_split(path, '/')[1] AS source_dir, size FROM f WHERE txn_id = 3) GROUP BY 1")
def prefix_list(s, d):
    return V.files(s, d, (3,)).groupBy(F.split("path", "/")[0].alias("source_dir")).agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


@query(f"WITH {FILES} SELECT txn_id, path, size FROM f WHERE txn_id = 2")
def time_travel(s, d):
    return catalog.at_snapshot(V.files(s, d), 2).select("txn_id", "path", "size")


@query(f"WITH {SNAPSHOTS} SELECT txn_id, coalesce(lag(txn_id) OVER (ORDER BY txn_id), 0) AS base_txn FROM snapshots")
def base_snapshot(s, d):
    return catalog.with_base(V.snapshots(s, d)).select("txn_id", F.coalesce("base_txn", F.lit(0).cast("long")).alias("base_txn"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def last_wins(s, d):
    return catalog.last_wins(V.table(s, d, "events").select("user_id", "event_id", "event_type").withColumn("seq", F.col("event_id")), ["user_id"]).select("user_id", "event_id", "event_type")


@query(f"WITH {FILES}, m AS (SELECT unnest(['src1', 'src1/en', 'src2', 'src3/de', 'src3']) AS mount) SELECT path, (SELECT max(mount) FROM m WHERE path = mount OR starts_with(path, mount || '/')) AS mount FROM f WHERE txn_id = 3")
def mount_of_path(s, d):
    mounts = s.createDataFrame([(x,) for x in ("src1", "src1/en", "src2", "src3/de", "src3")], "mount string")
    return catalog.longest_prefix(V.files(s, d, (3,)).select("path"), mounts)


@query(f"WITH {FILES} SELECT path, content_hash AS inode_id, min(path) OVER (PARTITION BY content_hash) AS canonical, path <> min(path) OVER (PARTITION BY content_hash) AS is_link FROM f WHERE txn_id = 3")
def hardlink_canonical(s, d):
    return catalog.hardlinks(V.hardlinks(s, d)).select("path", "inode_id", "canonical", "is_link")


def _filtered(s, d, **clauses):
    return filters.FileFilter(**clauses).apply(V.files(s, d, (3,))).select("path")


@query(f"WITH {FILES} SELECT path FROM f WHERE txn_id = 3 AND (starts_with(path, 'src1/') OR starts_with(path, 'src2/en/')) AND NOT starts_with(path, 'src1/de/')")
def filter_paths(s, d):
    return _filtered(s, d, include_paths=["src1", "src2/en/"], exclude_paths=["src1\\de"])


@query(f"WITH {FILES} SELECT path FROM f WHERE txn_id = 3 AND regexp_matches(path, '/en/doc_[^/]*[0-4]\\.txt$') AND NOT regexp_matches(path, '/doc_0000..50\\.txt$')")
def filter_globs(s, d):
    return _filtered(s, d, include_globs=[f"*/en/doc_*{i}.txt" for i in range(5)], exclude_globs=["doc_0000??50.txt"])


@query(f"WITH {FILES} SELECT path FROM f WHERE txn_id = 3 AND size BETWEEN 500 AND 3000")
def filter_ext_size(s, d):
    return _filtered(s, d, extensions=[".TXT", "md"], min_size=500, max_size=3000)


@query(f"WITH {FILES} SELECT path FROM f WHERE txn_id = 3 AND mtime_unix BETWEEN 1700003000 AND 1700030000 AND uid = 2")
def filter_mtime(s, d):
    return _filtered(s, d, mtime_after=1700003000, mtime_before=1700030000, uid=2)


@query(f"WITH {TREE}, m AS (SELECT string_split(path, '/') AS s, path FROM tree WHERE file_type = 'file' AND ends_with(path, 'Thumbs.db')) SELECT path, file_type FROM tree WHERE path IN (SELECT path FROM m UNION SELECT array_to_string(s[1:i], '/') FROM (SELECT s, unnest(range(1, len(s))) AS i FROM m))")
def filter_ancestors(s, d):
    t = V.tree(s, d)
    return filters.with_ancestors(t, filters.FileFilter(include_globs=["Thumbs.db"]).apply(t, kind="file_type"))


@query(f"WITH {TREE}, p AS (SELECT path FROM tree WHERE regexp_matches(path, '^src[0-9]+/(en|de)$') OR ends_with(path, 'node_modules') OR path IN ('src1', 'src4')) SELECT path, CAST(len(string_split(path, '/')) AS BIGINT) AS depth FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE starts_with(p.path, q.path || '/'))")
def collapse_includes(s, d):
    return filters.collapse_includes(V.tree(s, d).where(F.col("path").rlike("^src[0-9]+/(en|de)$") | F.col("path").endswith("node_modules") | F.col("path").isin("src1", "src4")))


@query(f"WITH {FILES} SELECT path, path AS kept, array_to_string(string_split(path, '/')[2:], '/') AS stripped, string_split(path, '/')[-1] AS flat, CASE WHEN starts_with(path, 'src1/') THEN concat('moved', substr(path, 5)) ELSE path END AS mapped FROM f WHERE txn_id = 3")
def remap_paths(s, d):
    p = F.col("path")
    return V.files(s, d, (3,)).select("path", filters.remap(p, "keep").alias("kept"), filters.remap(p, "strip", strip=1).alias("stripped"), filters.remap(p, "flatten").alias("flat"), filters.remap(p, "prefix", source="src1", target="moved").alias("mapped"))


@query(f"WITH {FILES}, r AS (SELECT path, concat('out/', string_split(path, '/')[2], '.txt') AS dest FROM f WHERE txn_id = 3), n AS (SELECT *, row_number() OVER (PARTITION BY dest ORDER BY path) - 1 AS c FROM r) SELECT path, dest, CASE WHEN c = 0 THEN dest ELSE concat(substr(dest, 1, length(dest) - 4), '_', c, '.txt') END AS final FROM n")
def conflict_suffixes(s, d):
    f = V.files(s, d, (3,)).select("path", F.concat(F.lit("out/"), F.split("path", "/")[1], F.lit(".txt")).alias("dest"))
    return filters.resolve_conflicts(f).select("path", "dest", "final")


@query(f"WITH {CHUNKS} SELECT DISTINCT hash FROM chunks WHERE txn_id IN (1, 2)")
def referenced_hashes(s, d):
    return store.referenced(V.chunks(s, d, (1, 2)))


@query(f"WITH {CHUNKS} SELECT txn_id, path, idx, \"offset\", length, hash FROM chunks WHERE txn_id = 3")
def fixed_chunks(s, d):
    return V.chunks(s, d, (3,))


@query(f"WITH {STORE} SELECT hash, stored_len FROM live ANTI JOIN c12 USING (hash)")
def orphan_chunks(s, d):
    return store.orphans(V.store(s, d), V.tombstones(s, d), V.chunks(s, d, (1, 2))).select("hash", "stored_len")


@query(f"WITH {STORE}, r AS (SELECT CASE WHEN dead.hash IS NOT NULL THEN 'tombstoned' ELSE 'unreferenced' END AS reason, stored_len FROM store LEFT JOIN dead USING (hash) LEFT JOIN c12 USING (hash) WHERE dead.hash IS NOT NULL OR c12.hash IS NULL) SELECT reason, count(*) AS n_chunks, CAST(sum(CASE WHEN reason = 'tombstoned' THEN 0 ELSE stored_len END) AS BIGINT) AS bytes FROM r GROUP BY reason")
def orphan_explain(s, d):
    return store.orphan_explain(V.store(s, d), V.tombstones(s, d), V.chunks(s, d, (1, 2)))


@query(f"WITH {STORE}, o AS (SELECT count(*) AS n FROM live ANTI JOIN c12 USING (hash)) SELECT (SELECT count(*) FROM c12) AS referenced, (SELECT n FROM o) AS orphans, (SELECT count(*) FROM dead) + (SELECT n FROM o) AS tombstoned")
def gc_report(s, d):
    return store.gc_report(V.store(s, d), V.tombstones(s, d), V.chunks(s, d, (1, 2)), execute=True)


LIVE12 = "a AS (SELECT count(*) AS unique_chunks, CAST(sum(stored_len + 48) + 4096 * count(DISTINCT pack_name) AS BIGINT) AS physical_bytes FROM store), u AS (SELECT * FROM live SEMI JOIN c12 USING (hash)), v AS (SELECT count(*) AS live_chunks, CAST(sum(stored_len + 48) + 4096 * count(DISTINCT pack_name) AS BIGINT) AS live_bytes FROM u)"


@query(f"WITH {STORE}, {LIVE12}, g AS (SELECT count(*) AS logical_chunks, CAST(sum(length) AS BIGINT) AS logical_bytes FROM chunks WHERE txn_id IN (1, 2)) SELECT *, greatest(physical_bytes - live_bytes, 0) AS orphan_bytes, physical_bytes / live_bytes AS amplification FROM a, v, g")
def repo_stats(s, d):
    return store.repo_stats(V.store(s, d), V.tombstones(s, d), V.chunks(s, d, (1, 2)))


@query(f"WITH {STORE}, {LIVE12} SELECT CAST(sum(uncompressed_len) AS BIGINT) AS uncompressed_bytes, CAST(sum(stored_len) AS BIGINT) AS stored_bytes, count(*) FILTER (codec = 'raw') AS raw_chunks, count(*) FILTER (codec <> 'raw') AS compressed_chunks FROM u")
def compress_stats(s, d):
    return store.compress_stats(V.store(s, d), V.tombstones(s, d), V.chunks(s, d, (1, 2)))


@query(f"WITH {STORE}, {LIVE12}, w AS (SELECT unique_chunks, physical_bytes FROM a) SELECT live_chunks AS records_copied, physical_bytes AS bytes_before, live_bytes AS bytes_after, physical_bytes / live_bytes AS amplification_before FROM w, v")
def compact_report(s, d):
    return store.compact_report(V.store(s, d), V.tombstones(s, d), V.chunks(s, d, (1, 2)))


@query(f"WITH {STORE}, g AS (SELECT hash FROM c3 ANTI JOIN live USING (hash)) SELECT (SELECT count(*) FROM c3) AS chunks_checked, (SELECT count(*) FROM g) AS missing, CAST(0 AS BIGINT) AS malformed, array_to_string(list_sort((SELECT list(hash) FROM (SELECT hash FROM g ORDER BY hash LIMIT 32))), ',') AS samples")
def reachability(s, d):
    out = store.reachability(V.chunks(s, d, (3,)), V.store(s, d), V.tombstones(s, d))
    return out.select("chunks_checked", "missing", "malformed", F.array_join("samples", ",").alias("samples"))


@query(f"WITH {STORE} SELECT hash FROM c3 ANTI JOIN c1 USING (hash)")
def delta_chunks(s, d):
    return store.delta_chunks(V.chunks(s, d, (3,)), V.chunks(s, d, (1,)))


@query(f"WITH {STORE}, x AS (SELECT hash FROM c3 ANTI JOIN c1 USING (hash)), n AS (SELECT (SELECT count(*) FROM c3) AS t, (SELECT count(*) FROM c1) AS b, (SELECT count(*) FROM x) AS dn) SELECT dn AS delta_chunks, (SELECT CAST(sum(stored_len) AS BIGINT) FROM x JOIN store USING (hash)) AS delta_bytes, 100.0::DOUBLE * b / t AS base_to_target_pct, (t - dn) / t AS shared_ratio FROM n")
def delta_stats(s, d):
    return store.delta_stats(V.chunks(s, d, (3,)), V.chunks(s, d, (1,)), V.store(s, d))


@query(f"WITH {STORE}, k AS (SELECT hash FROM live SEMI JOIN c1 USING (hash)) SELECT (SELECT count(*) FROM chunks WHERE txn_id = 3) AS logical_chunks, (SELECT count(*) FROM c3) AS distinct_chunks, (SELECT count(*) FROM c3 SEMI JOIN k USING (hash)) AS already_stored")
def dedup_store(s, d):
    old = V.store(s, d).join(store.referenced(V.chunks(s, d, (1,))), "hash", "left_semi")
    return store.dedup_put(V.chunks(s, d, (3,)), old, V.tombstones(s, d))


@query(f"WITH {STORE} SELECT c3.hash, live.hash IS NOT NULL AS stored FROM c3 LEFT JOIN live USING (hash)")
def dedup_probe(s, d):
    return store.exists(V.chunks(s, d, (3,)), V.store(s, d), V.tombstones(s, d))


@query(f"WITH {STORE} SELECT CAST(CAST(('0x' || substr(hash, 2, 1)) AS INT) AS INT) AS shard, count(*) AS n_chunks, CAST(sum(stored_len) AS BIGINT) AS bytes FROM store GROUP BY 1")
def store_shards(s, d):
    return V.store(s, d).groupBy(store.shard().alias("shard")).agg(F.count("*").alias("n_chunks"), F.sum("stored_len").alias("bytes"))


@query(f"WITH {KEPT} SELECT txn_id FROM kept")
def retention_keep(s, d):
    return retention.keep_set(V.snapshots(s, d))


@query(f"WITH {KEPT} SELECT txn_id, CASE WHEN kept.txn_id IS NOT NULL THEN 'keep' WHEN immutable_until > {NOW} THEN 'immutable' ELSE 'delete' END AS decision FROM snapshots LEFT JOIN kept USING (txn_id) LEFT JOIN meta USING (txn_id)")
def prune_candidates(s, d):
    return retention.prune_plan(V.snapshots(s, d), V.snapshot_meta(s, d), NOW)


CHECKED = CHAIN + """, v AS (SELECT seq, sequence <> row_number() OVER (ORDER BY seq) AS bad_sequence, coalesce(lag(sha256) OVER (ORDER BY seq), '') <> '' AND prev_sha256 <> lag(sha256) OVER (ORDER BY seq) AS bad_link, sha256(body_json) <> sha256 AS bad_body FROM chain)"""


@query(f"WITH {CHECKED} SELECT seq, bad_sequence, coalesce(bad_link, false) AS bad_link, bad_body FROM v")
def audit_chain_verify(s, d):
    return audit.verify_chain(V.audit_chain(s, d))


@query(f"WITH {CHECKED} SELECT count(*) AS entries, count(*) FILTER (bad_sequence) AS bad_sequence, count(*) FILTER (bad_link) AS bad_link, count(*) FILTER (bad_body) AS bad_body, count(*) FILTER (bad_sequence OR bad_link OR bad_body) AS bad_entries FROM v")
def audit_chain_report(s, d):
    return audit.chain_report(V.audit_chain(s, d))


@query(f"WITH {CHAIN} SELECT seq, body_json FROM chain WHERE contains(body_json, '\"kind\":\"ops\"')")
def ops_entries(s, d):
    return audit.ops_entries(V.audit_chain(s, d)).select("seq", "body_json")


@query(f"WITH {CHAIN} SELECT seq, concat('ed25519-host-v1:', sha256(concat(body_json, 'secret'))) AS signature FROM chain")
def audit_signatures(s, d):
    return V.audit_chain(s, d).select("seq", audit.signature(F.col("body_json"), "secret").alias("signature"))


@query(f"WITH {SNAPSHOTS} SELECT (SELECT count(*) FROM snapshots) AS snapshots, (SELECT max(created_at_unix) FROM snapshots) AS newest_unix, (SELECT count(*) FROM meta WHERE immutable_until > {NOW}) AS immutable, ({NOW} - (SELECT max(created_at_unix) FROM snapshots)) / 86400.0::DOUBLE AS days_since")
def rpo_summary(s, d):
    return reports.rpo_summary(V.snapshot_meta(s, d), V.snapshots(s, d), NOW)


@query(f"WITH {SNAPSHOTS}, {REPORTS}, jobs AS (SELECT concat('job', unnest(range(8))) AS job_id), r AS (SELECT job_id, arg_min(finished_at_unix, seq) AS reported FROM reports GROUP BY 1), t AS (SELECT job_id, max(created_at_unix) AS taken FROM meta JOIN snapshots USING (txn_id) GROUP BY 1), l AS (SELECT job_id, CASE WHEN taken >= coalesce(reported, 0) THEN taken ELSE reported END AS last_success_unix FROM jobs LEFT JOIN r USING (job_id) LEFT JOIN t USING (job_id)) SELECT job_id, coalesce(last_success_unix, 0) AS last_success_unix, CASE WHEN last_success_unix IS NULL THEN -1.0::DOUBLE ELSE ({NOW} - last_success_unix) / 86400.0::DOUBLE END AS days_since FROM l")
def rpo_by_job(s, d):
    jobs = s.range(8).select(F.concat(F.lit("job"), "id").alias("job_id"))
    return reports.rpo(jobs, V.job_reports(s, d), V.snapshot_meta(s, d), V.snapshots(s, d), NOW).na.fill(0, ["last_success_unix"])


@query(f"WITH {REPORTS} SELECT *, (SELECT count(*) FROM reports WHERE job_id = 'job2') AS total FROM reports WHERE job_id = 'job2' ORDER BY seq LIMIT 100 OFFSET 5")
def job_report_page(s, d):
    return reports.job_report_page(V.job_reports(s, d), "job2", 5, 0)


@query("WITH i AS (SELECT event_id % 9 AS k FROM events) SELECT count(*) FILTER (k = 0) AS locked, count(*) FILTER (k = 1) AS permission_denied, count(*) FILTER (k = 2) AS reparse_junction, count(*) FILTER (k = 3) AS hook_failed, count(*) FILTER (k = 4) AS plugin_skipped, count(*) FILTER (k = 5) AS plugin_failed, count(*) FILTER (k BETWEEN 2 AND 7) AS skipped FROM i")
def issue_counts(s, d):
    return reports.issue_counts(V.issues(s, d))


@query("WITH m AS (SELECT event_id, CAST(hour(ts) * 60 + minute(ts) AS INT) AS m FROM events) SELECT event_id, m >= 540 AND m < 1050 AS by_day, m >= 1320 OR m < 390 AS by_night, m >= 720 AS after_noon, true AS always FROM m")
def window_predicate(s, d):
    m = F.hour("ts") * 60 + F.minute("ts")
    w = lambda a, b: times.in_window(m, F.lit(a), F.lit(b))
    return V.table(s, d, "events").select("event_id", w("09:00", "17:30").alias("by_day"), w("22:00", "06:30").alias("by_night"), w("12:00", None).alias("after_noon"), w("25:00", "x").alias("always"))


@query("WITH t AS (SELECT event_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS BIGINT) AS s FROM events) SELECT event_id, CASE WHEN s < 61200 THEN 61200 - s ELSE 0 END AS by_day, CASE WHEN s < 23400 THEN 23400 - s WHEN s >= 79200 THEN 23400 + 86400 - s ELSE 0 END AS by_night FROM t")
def window_seconds_left(s, d):
    now = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    left = lambda a, b: times.seconds_until(now, F.lit(a), F.lit(b)).cast("long")
    return V.table(s, d, "events").select("event_id", left("09:00", "17:00").alias("by_day"), left("22:00", "06:30").alias("by_night"))


@query("WITH p AS (SELECT unnest(['idle', 'scanning', 'storing', 'committing_meta', 'auditing', 'aborted']) AS phase), e AS (SELECT unnest(['scan_file', 'chunk_file', 'commit_manifest', 'append_audit', 'complete']) AS event) SELECT phase, event, CASE WHEN event = 'scan_file' AND phase IN ('idle', 'aborted') THEN 'scanning' WHEN event = 'chunk_file' AND phase = 'scanning' THEN 'chunking' WHEN event = 'commit_manifest' AND phase = 'storing' THEN 'committing_meta' WHEN event = 'append_audit' AND phase = 'committing_meta' THEN 'auditing' WHEN event = 'complete' AND phase IN ('committing_meta', 'auditing') THEN 'idle' ELSE 'aborted' END AS next FROM p, e")
def next_phase(s, d):
    phases, events = ("idle", "scanning", "storing", "committing_meta", "auditing", "aborted"), ("scan_file", "chunk_file", "commit_manifest", "append_audit", "complete")
    rows = s.createDataFrame([(p, e) for p in phases for e in events], "phase string, event string")
    return rows.select("phase", "event", times.next_phase(F.col("phase"), F.col("event")).alias("next"))


@query("WITH a AS (SELECT DISTINCT CAST(l_linenumber + l_quantity % 5 AS BIGINT) AS attempt FROM lineitem) SELECT attempt, CAST(least(300, pow(2, attempt - 1)) AS BIGINT) AS seconds FROM a WHERE attempt > 0")
def backoff(s, d):
    a = V.table(s, d, "lineitem").select((F.col("l_linenumber") + F.col("l_quantity") % 5).cast("long").alias("attempt")).distinct().where("attempt > 0")
    return a.select("attempt", times.backoff(F.col("attempt")).alias("seconds"))


@query(f"WITH {FILES} SELECT CASE WHEN size * 4096 <= 262144 THEN 'small' WHEN size * 4096 >= 67108864 THEN 'large' ELSE 'default' END AS profile, count(*) AS n_files FROM f WHERE txn_id = 3 GROUP BY 1")
def chunk_profiles(s, d):
    return V.files(s, d, (3,)).groupBy(times.chunk_profile(F.col("size") * 4096).alias("profile")).agg(F.count("*").alias("n_files"))


@query(f"WITH {CHUNKS} SELECT path, idx, CAST(coalesce(sum(length) OVER (PARTITION BY path ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM chunks WHERE txn_id = 3")
def chunk_offsets(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return V.chunks(s, d, (3,)).select("path", "idx", F.coalesce(F.sum("length").over(w), F.lit(0)).alias("byte_offset"))


#: One level of a tree of (k, i, h) for each key k.
def _levels(leaves: str, key: str) -> str:
    return f"RECURSIVE {leaves}, t AS (SELECT {key} AS k, 0 AS l, i, h, n FROM leaves UNION ALL SELECT k, l + 1, i // 2, sha256(unhex(h || CASE WHEN nh IS NULL THEN h ELSE nh END)), (n + 1) // 2 FROM (SELECT *, lead(h) OVER (PARTITION BY k ORDER BY i) AS nh FROM t WHERE n > 1) WHERE i % 2 = 0)"


@query("WITH " + _levels(CHUNKS + ", leaves AS (SELECT path, idx AS i, hash AS h, count(*) OVER (PARTITION BY path) AS n FROM chunks WHERE txn_id = 3)", "path") + " SELECT k AS path, h AS content_hash FROM t WHERE n = 1")
def file_content_hash(s, d):
    return audit.content_hash(V.chunks(s, d, (3,)), ["path"])


@query("WITH " + _levels(CHUNKS + ", leaves AS (SELECT 1 AS one, row_number() OVER (ORDER BY path, idx) - 1 AS i, hash AS h, count(*) OVER () AS n FROM chunks WHERE txn_id = 3)", "one") + " SELECT (SELECT count(*) FROM leaves) AS n_leaves, h AS merkle_root FROM t WHERE n = 1")
def merkle_root(s, d):
    leaves = V.chunks(s, d, (3,)).select("path", "idx", "hash")
    return audit.merkle_root(audit.numbered(leaves, ["path", "idx"], checkpointed))


@query(f"WITH {THREE} SELECT * FROM plan")
def three_way_plan(s, d):
    f = V.files(s, d, (1, 2))
    return restore.three_way(f.where("txn_id = 2"), f.where("txn_id = 1"), V.live(s, d))


@query(f"WITH {THREE} SELECT " + ", ".join(f"count(*) FILTER (action = '{a}') AS {a}" for a in restore.ACTIONS) + ", count(*) FILTER (action IN ('conflict', 'both_changed')) AS conflicts, CAST(coalesce(sum(target_size) FILTER (action IN ('add', 'modify')), 0) AS BIGINT) AS bytes_to_write FROM plan")
def in_place_summary(s, d):
    return restore.plan_summary(three_way_plan(s, d))


@query(f"WITH {TREE} SELECT path, file_type, CAST(CASE WHEN file_type = 'dir' THEN 0 ELSE 1 END AS BIGINT) AS stage FROM tree")
def restore_plan(s, d):
    return restore.restore_plan(V.tree(s, d).withColumn("size", F.lit(0))).select("path", "file_type", "stage")


@query(f"WITH {CHUNKS}, m AS (SELECT * FROM chunks WHERE txn_id = 1), k AS (SELECT * FROM chunks WHERE txn_id = 2 AND path IN (SELECT path FROM m)) SELECT coalesce(m.path, k.path) AS path, min(CASE WHEN m.hash = k.hash AND m.length = k.length THEN 1 ELSE 0 END) = 1 AS ok FROM m FULL OUTER JOIN k ON m.path = k.path AND m.idx = k.idx GROUP BY 1")
def restored_verify(s, d):
    m = V.chunks(s, d, (1,))
    return restore.verify_restored(m, V.chunks(s, d, (2,)).join(m.select("path").distinct(), "path", "left_semi"))


SUGGESTED = TREE + """, hit AS (SELECT lower(string_split(path, '/')[-1]) AS pattern, file_type AS apply_as, path FROM tree), g AS (SELECT pattern, apply_as, count(*) AS hits, min(path) AS example FROM hit SEMI JOIN known USING (pattern, apply_as) GROUP BY 1, 2 ORDER BY hits DESC, pattern LIMIT 32)"""


@query(f"WITH {SUGGESTED} SELECT * FROM g")
def suggest_excludes(s, d):
    return suggestions.suggest(V.tree(s, d))


@query(f"WITH {SUGGESTED} SELECT * FROM g WHERE pattern <> 'build' AND NOT regexp_matches(pattern, '^thumbs.*$')")
def exclude_suppress(s, d):
    return suggestions.suppress(suggestions.suggest(V.tree(s, d)), ["build", "thumbs*"])


#: Bytes of the sample that the operator reads, as pairs of hex digits; entropy and distinct bytes of it.
SAMPLED = FILES + f""", s AS (SELECT path, hex(encode(content)) AS x FROM f WHERE txn_id = 3),
b AS (SELECT path, substr(x, i, 2) AS byte, least(length(x) // 2, {codec.SAMPLE}) AS size FROM (SELECT path, x, unnest(range(1, 2 * least(length(x) // 2, {codec.SAMPLE}) + 1, 2)) AS i FROM s)),
n AS (SELECT path, size, count(*) AS n FROM b GROUP BY path, size, byte),
e AS (SELECT path, -sum(n / size * log2(n / size)) + 0.0 AS bits, count(*) / any_value(size) AS diversity FROM n GROUP BY path),
k AS (SELECT f.path, coalesce(bits, 0.0) AS bits, coalesce(diversity, 0.0) AS diversity FROM f LEFT JOIN e USING (path) WHERE txn_id = 3)"""


@query(f"WITH {SAMPLED} SELECT path, round(bits, 6) AS bits, round(diversity, 6) AS diversity, CASE WHEN diversity > 0.95 AND bits * 125 > 950 OR bits = 0 AND diversity = 0 THEN 'incompressible' WHEN bits * 125 > 700 THEN 'slow' ELSE 'fast' END AS content_class FROM k")
def entropy_class(s, d):
    """Entropy, share of distinct bytes and class of the sample that the operator reads of each file."""
    f, content = V.files(s, d, (3,), True), F.col("content").cast("binary")
    return f.select("path", F.round(codec.entropy(content), 6).alias("bits"), F.round(codec.byte_diversity(content), 6).alias("diversity"), codec.content_class(filters.extension(F.col("path")), content).alias("content_class"))


@query(f"WITH {SNAPSHOTS} SELECT greatest(max(txn_id) - 100, 0) AS lag FROM snapshots")
def remote_lag(s, d):
    return reports.remote_lag(V.snapshots(s, d), 100)


SMALL = {"least": 256, "average": 1024, "most": 4096}


def _cdc(algo):
    def run(s, d):
        return chunking.chunk(V.files(s, d, (3,), True).select("path", "content"), chunking.ChunkConfig(algo=algo, **SMALL))

    run.__name__ = f"cdc_{algo}"
    return run


for _algo in ("gear", "gear_norm", "gear_phased", "gear_two", "polynomial"):
    query()(_cdc(_algo))


@query()
def hcrbo_incremental(s, d):
    config = chunking.ChunkConfig(**SMALL)
    f = V.files(s, d, (1, 2), True)
    return chunking.recut_files(f.where("txn_id = 2").select("path", "content"), chunking.chunk(f.where("txn_id = 1").select("path", "content"), config), config)


@query(f"WITH {STORE}, old AS (SELECT store.hash FROM store SEMI JOIN c12 USING (hash)), w AS (SELECT hash FROM c3 ANTI JOIN old USING (hash)), r AS (SELECT c3.hash FROM c3 JOIN dead USING (hash) JOIN old USING (hash)) SELECT hash, 'written' AS fate FROM w UNION ALL SELECT hash, 'revived' FROM r")
def gc_rewrite(s, d):
    """What a backup does with each chunk that has no live record: one that was collected only loses its mark."""
    old = V.store(s, d).join(store.referenced(V.chunks(s, d, (1, 2))), "hash", "left_semi")
    dead = V.tombstones(s, d).join(old.select("hash"), "hash", "left_semi")
    target = V.chunks(s, d, (3,))
    written = store.new_chunks(target.select("hash"), old).select("hash", F.lit("written").alias("fate"))
    return written.unionByName(store.revived(target, dead).select("hash", F.lit("revived").alias("fate")))


@query(f"WITH {STORE} SELECT hash, stored_len FROM live ANTI JOIN c12 USING (hash) ORDER BY hash LIMIT 64")
def orphan_samples(s, d):
    return store.orphan_samples(V.store(s, d), V.tombstones(s, d), V.chunks(s, d, (1, 2)))


@query(f"WITH {FILES} SELECT b.path, b.size FROM (SELECT * FROM f WHERE txn_id = 2) b WHERE NOT EXISTS (SELECT 1 FROM f a WHERE a.txn_id = 1 AND a.path = b.path AND a.size = b.size AND a.mtime_unix = b.mtime_unix)")
def incremental_candidates(s, d):
    """Files that a backup has to read, as size or time differ from the snapshot before."""
    old, new = _sides(s, d)
    return new.join(old.select("path", "size", "mtime_unix"), ["path", "size", "mtime_unix"], "left_anti").select("path", "size")


@query(f"WITH {FILES} SELECT string_split(path, '/')[1] AS top, max(mtime_unix) AS latest_unix FROM f WHERE txn_id = 3 GROUP BY 1")
def latest_mtime(s, d):
    return V.files(s, d, (3,)).groupBy(F.split("path", "/")[0].alias("top")).agg(F.max("mtime_unix").alias("latest_unix"))


@query(f"WITH {FILES} SELECT count(*) AS file_count, CAST(0 AS BIGINT) AS dir_count, CAST(sum(size) AS BIGINT) AS bytes FROM f WHERE txn_id = 3")
def restore_preview(s, d):
    return restore.preview(V.files(s, d, (3,)))


@query(f"WITH {FILES} SELECT count(*) AS file_count, CAST(sum(size) AS BIGINT) AS bytes FROM f WHERE txn_id = 2 AND starts_with(path, 'src1/')")
def restore_acceptance(s, d):
    return restore.acceptance(filters.FileFilter(include_paths=["src1"]).apply(V.files(s, d, (2,))))


@query("WITH " + _levels(CHUNKS + ", leaves AS (SELECT 1 AS one, row_number() OVER (ORDER BY path, idx) - 1 AS i, hash AS h, count(*) OVER () AS n FROM chunks WHERE txn_id = 3 AND starts_with(path, 'src1/'))", "one") + " SELECT (SELECT count(*) FROM leaves) AS n_leaves, h AS merkle_root FROM t WHERE n = 1")
def restored_subset_root(s, d):
    """The root over the chunks of the part that a restore took."""
    paths = filters.FileFilter(include_paths=["src1"]).apply(V.files(s, d, (3,))).select("path")
    return audit.merkle_root(audit.numbered(restore.subset_leaves(V.chunks(s, d, (3,)), paths), ["path", "idx"], checkpointed))


@query(f"WITH {THREE}, x AS (SELECT *, CASE WHEN action IN ('add', 'modify', 'conflict', 'both_changed') THEN 'write' WHEN action = 'unchanged' THEN 'keep' ELSE 'delete' END AS decision FROM plan) SELECT count(*) FILTER (decision = 'write') AS written, count(*) FILTER (decision = 'keep') AS kept, CAST(0 AS BIGINT) AS skipped, count(*) FILTER (decision = 'delete') AS deleted, CAST(0 AS BIGINT) AS failed, CAST(coalesce(sum(target_size) FILTER (decision = 'write'), 0) AS BIGINT) AS bytes_written FROM x")
def in_place_apply(s, d):
    return restore.apply_summary(restore.apply_plan(three_way_plan(s, d), "overwrite", "delete"))


@query(f"WITH {FILES} SELECT path, CASE WHEN starts_with(path, 'src1/') THEN concat('moved', substr(path, 5)) ELSE path END AS target FROM f WHERE txn_id = 3")
def remap_links(s, d):
    return V.files(s, d, (3,)).select("path", filters.remap_link(F.col("path"), "src1", "moved").alias("target"))


@query(f"WITH {FILES} SELECT path, CASE WHEN doc_id % 4 > 0 THEN size / (doc_id % 4) / 1000000 ELSE 0.0::DOUBLE END AS mb_per_s FROM f WHERE txn_id = 3")
def throughput(s, d):
    f = V.files(s, d, (3,))
    return f.select("path", times.throughput(F.col("size"), F.col("doc_id") % 4).alias("mb_per_s"))


@query(f"WITH {CHAIN}, a AS (SELECT sequence, sha256 FROM chain WHERE seq % 3 = 0 ORDER BY seq DESC LIMIT 1) SELECT sequence, sha256 = (SELECT arg_max(sha256, seq) FROM chain) AS is_head, true AS at_sequence FROM a")
def newest_anchor(s, d):
    chain = V.audit_chain(s, d)
    return audit.check_anchor(chain, chain.where("seq % 3 = 0").select("seq", "sequence", "sha256"))


@query(f"WITH {FILES} SELECT path FROM f WHERE txn_id = 3 AND (starts_with(path, 'src1/') OR starts_with(path, 'src2/')) AND NOT regexp_matches(path, '/doc_[^/]*7\\.txt$') AND size >= 700")
def filter_merged(s, d):
    """A filter file and options given beside it: lists are joined, numbers replaced."""
    both = filters.FileFilter.parse("include_paths=src1\nmin_size=9").merged(filters.FileFilter(include_paths=["src2"], exclude_globs=["doc_*7.txt"], min_size=700))
    return both.apply(V.files(s, d, (3,))).select("path")


@query(f"WITH {FILES} SELECT path, base64(encode(path)) AS encoded FROM f WHERE txn_id = 3")
def encoded_paths(s, d):
    return V.files(s, d, (3,)).select("path", F.translate(F.base64(F.col("path").cast("binary")), "\r\n", "").alias("encoded"))


JOBS = "jobs AS (SELECT concat('job', i) AS id, concat('/src/', i) AS source, CASE WHEN i % 3 = 0 THEN '22:00' END AS window_start, CASE WHEN i % 3 = 0 THEN '06:00' END AS window_end, i % 5 <> 4 AS enabled, CAST(86400 * (i % 4) AS BIGINT) AS interval_seconds FROM range(12) r(i))"


def _jobs(s):
    i = F.col("id")
    night = lambda text: F.when(i % 3 == 0, F.lit(text))
    return s.range(12).select(F.concat(F.lit("job"), i).alias("id"), F.concat(F.lit("/src/"), i).alias("source"), night("22:00").alias("window_start"), night("06:00").alias("window_end"), (i % 5 != 4).alias("enabled"), (86400 * (i % 4)).alias("interval_seconds"))


@query(f"WITH {REPORTS}, {JOBS}, r AS (SELECT job_id AS id, max(finished_at_unix) AS last FROM reports GROUP BY 1), d AS (SELECT jobs.*, coalesce(last + interval_seconds, 0) AS due_unix FROM jobs LEFT JOIN r USING (id)) SELECT id, due_unix FROM d WHERE enabled AND due_unix <= {NOW} AND window_start IS NULL")
def due_jobs(s, d):
    """At noon, so that jobs of the night wait."""
    return jobs.due(_jobs(s), V.job_reports(s, d), NOW, 720)


QUEUE = "q AS (SELECT event_id AS seq, event_id % 997 AS run_id, concat('job', event_id % 997 % 7) AS job_id, ['pending', 'running', 'done', 'failed'][CAST(user_id % 4 + 1 AS INT)] AS state FROM events WHERE event_id IS NOT NULL), st AS (SELECT run_id, arg_max(job_id, seq) AS job_id, arg_max(state, seq) AS state, max(seq) AS seq FROM q GROUP BY 1)"


def _queue(s, d):
    e = V.table(s, d, "events").where("event_id is not null")
    states = F.array(*[F.lit(x) for x in jobs.STATES])
    return e.select(F.col("event_id").alias("seq"), (F.col("event_id") % 997).alias("run_id"), F.concat(F.lit("job"), F.col("event_id") % 997 % 7).alias("job_id"), F.element_at(states, (F.col("user_id") % 4 + 1).cast("int")).alias("state"))


@query(f"WITH {QUEUE} SELECT run_id, job_id, state, seq FROM st")
def queue_states(s, d):
    return jobs.queue_states(_queue(s, d))


@query(f"WITH {QUEUE} SELECT min(run_id) AS run_id, job_id FROM st WHERE state = 'pending' AND job_id NOT IN (SELECT job_id FROM st WHERE state = 'running') GROUP BY job_id ORDER BY run_id LIMIT 5")
def next_runs(s, d):
    return jobs.next_runs(_queue(s, d), 5)


@query(f"WITH {CHUNKS}, n AS (SELECT txn_id, path, count(*) AS n FROM chunks WHERE txn_id = 2 GROUP BY ALL) SELECT f.txn_id, f.path, size, file_type, mtime_unix, coalesce(n, 0) AS n_chunks FROM f LEFT JOIN n USING (txn_id, path) WHERE f.txn_id = 2")
def file_summaries(s, d):
    return catalog.summary_columns(V.files(s, d, (2,)), V.chunks(s, d, (2,)))
