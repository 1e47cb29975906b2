"""Backup windows, backoff, throughput and phases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The phase that follows each event.
PHASES = {
    ("idle", "scan_file"): "scanning",
    ("aborted", "scan_file"): "scanning",
    ("scanning", "chunk_file"): "chunking",
    ("chunking", "store_chunk"): "storing",
    ("storing", "commit_manifest"): "committing_meta",
    ("committing_meta", "complete"): "idle",
    ("committing_meta", "append_audit"): "auditing",
    ("auditing", "complete"): "idle",
}


def minute_of(text: Column) -> Column:
    """Minutes of `HH:MM`; null where it isn't one."""
    ok = text.rlike(r"^([01]\d|2[0-3]):[0-5]\d$")
    return F.when(ok, F.split(text, ":")[0].cast("int") * 60 + F.split(text, ":")[1].cast("int"))


def _given(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def in_window(now_minute: Column, start: Column, end: Column) -> Column:
    """Whether start <= now < end, past midnight if end is before start. A missing end is open; a text that is no time means always."""
    s, e = minute_of(start), minute_of(end)
    bad = (_given(start) & s.isNull()) | (_given(end) & e.isNull())
    inside = F.when(s <= e, (now_minute >= s) & (now_minute < e)).otherwise((now_minute >= s) | (now_minute < e))
    return F.when(bad | (s.isNull() & e.isNull()), True).when(e.isNull(), now_minute >= s).when(s.isNull(), now_minute < e).otherwise(inside)


def seconds_until(now_second: Column, start: Column, end: Column) -> Column:
    """Seconds until the window ends, 0 outside of it; null without an end or where a text is no time."""
    s, e, now = minute_of(start), minute_of(end), F.floor(now_second / 60)
    left = F.greatest(e * 60 - now_second, F.lit(0))
    over = F.when(now < e, left).when(now >= s, e * 60 + 86400 - now_second).otherwise(0)
    known = e.isNotNull() & (s.isNotNull() | ~_given(start))
    return F.when(known, F.when(s > e, over).when(now < e, left).otherwise(0))


def should_downgrade(now_second: Column, start: Column, end: Column, grace: int = 300) -> Column:
    return F.coalesce(seconds_until(now_second, start, end) <= (grace if grace > 0 else 300), F.lit(False))


def backoff(attempt: Column, most: int = 300) -> Column:
    """1, 2, 4, ... seconds for attempts 1, 2, 3, ..., up to most."""
    return F.when(attempt <= 0, 0).otherwise(F.least(F.lit(float(most)), F.pow(F.lit(2.0), attempt - 1))).cast("long")


def throughput(size: Column, seconds: Column, binary: bool = False) -> Column:
    return F.when(seconds > 0, size / seconds / (1 << 20 if binary else 1_000_000)).otherwise(0.0)


def next_phase(phase: Column, event: Column) -> Column:
    """aborted where the event doesn't belong to the phase."""
    out = F.when(F.lit(False), F.lit(""))
    for (p, e), to in PHASES.items():
        out = out.when((phase == p) & (event == e), to)
    return out.otherwise("aborted")


def chunk_profile(size: Column) -> Column:
    k = 1 << 10
    return F.when(size <= 256 * k, "small").when(size >= 64 * k * k, "large").otherwise("default")
