"""Tables of a repository. Sizes and ids are long, times are Unix seconds, hashes are lowercase hex."""

from __future__ import annotations

from pyspark.sql import types as T

L, S, I, B, D = T.LongType(), T.StringType(), T.IntegerType(), T.BooleanType(), T.DoubleType()


def _table(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


ANCHOR = _table(offset=L, length=L, hash=S, strength=S, rolling_checksum=L)
FILES = _table(txn_id=L, path=S, size=L, mtime_unix=L, file_type=S, mode=I, uid=L, gid=L, inode_id=L, stream=S, link_target=S, content_hash=S, chunk_hashes=T.ArrayType(S), anchors=T.ArrayType(ANCHOR))
SNAPSHOTS = _table(txn_id=L, created_at_unix=L, manifest_crc32=L, merkle_root=S, file_count=L)
SNAPSHOT_META = _table(seq=L, txn_id=L, job_id=S, retention_tag=S, immutable_until=L)
STORE = _table(hash=S, stored_len=L, uncompressed_len=L, codec=S, pack_name=S)
TOMBSTONES = _table(hash=S)
JOB_REPORTS = _table(seq=L, job_id=S, finished_at_unix=L, status=S, txn_id=L)
ISSUES = _table(txn_id=L, path=S, reason=S)
AUDIT = _table(seq=L, sequence=L, prev_sha256=S, sha256=S, body_json=S)
JOBS = _table(id=S, name=S, source=S, window_start=S, window_end=S, enabled=B)
QUEUE = _table(seq=L, job_id=S, enqueued_at_unix=L, state=S)
OUTBOX = _table(seq=L, base_txn=L, target_txn=L, state=S, attempts=I, updated_at_unix=L)
SCAN = _table(path=S, file_type=S, size=L, mtime_unix=L, mode=I, uid=L, gid=L, inode_id=L)
