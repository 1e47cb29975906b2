"""Content classes, codec policy, encoding, and encryption."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

SAMPLE = 4096
#: Extensions of content that doesn't compress; entropy, in thousandths of 8 bits, above which content is
#: slow, and, with DISTINCT_SHARE of distinct bytes, incompressible.
PACKED = ("jpg", "jpeg", "png", "gif", "webp", "mp4", "mkv", "avi", "zip", "gz", "bz2", "xz", "7z", "rar", "mp3", "aac", "flac", "wasm", "pdf", "exe", "dll")
SLOW_PERMILLE, PACKED_PERMILLE, DISTINCT_SHARE = 700, 950, 0.95
#: Fixed values of the tiers: levels for fast and slow content, size from which long matches pay, ratio up to which LZ4 stays.
TIERS = {"fast": (1, 1, None, 0.92), "balanced": (3, 6, 131072, 0.90), "max": (6, 15, 65536, 1.0)}


@pandas_udf(T.DoubleType())
def entropy(content: pd.Series) -> pd.Series:
    """Shannon entropy in bits of the first SAMPLE bytes; 0 for none."""

    def one(x) -> float:
        n = np.bincount(np.frombuffer(x[:SAMPLE], np.uint8), minlength=256) if x else np.zeros(1)
        p = n[n > 0] / max(1, n.sum())
        return float(-(p * np.log2(p)).sum()) + 0.0

    return content.map(one).astype(float)


@pandas_udf(T.DoubleType())
def byte_diversity(content: pd.Series) -> pd.Series:
    """Distinct bytes over bytes of the sample; 0 for none."""
    return content.map(lambda x: len(set(x[:SAMPLE])) / min(len(x), SAMPLE) if x else 0.0).astype(float)


@pandas_udf(T.LongType())
def rolling_checksum(content: pd.Series) -> pd.Series:
    """(b << 16) + a with sums modulo 65521, a from 1."""
    return content.map(lambda x: zlib.adler32(x or b"")).astype("int64")


def slide_checksum(previous: int, out: int, new: int, window: int) -> int:
    """The checksum of a window one byte on."""
    base, a, b = 65521, previous & 0xFFFF, previous >> 16
    a = (a - out + new) % base
    return ((b - window * out + a - 1) % base) << 16 | a


def content_class(extension: Column, content: Column) -> Column:
    """incompressible by extension, emptiness or a sample of nearly all distinct bytes; else slow or fast by entropy."""
    permille = entropy(content) * 125
    empty = F.coalesce(F.octet_length(content), F.lit(0)) == 0
    packed = F.coalesce(extension.isin(*PACKED), F.lit(False)) | empty | ((byte_diversity(content) > DISTINCT_SHARE) & (permille > PACKED_PERMILLE))
    return F.when(packed, "incompressible").when(permille > SLOW_PERMILLE, "slow").otherwise("fast")


def tier_level(tier: Column, kind: Column, override: int = 0) -> Column:
    """The level for content of a class; an override holds for all, within 1 to 22."""
    if override > 0:
        return F.lit(max(1, min(override, 22)))
    out = F.when(F.lit(False), F.lit(0))
    for name, (fast, slow, *_) in TIERS.items():
        out = out.when(tier == name, F.when(kind == "slow", slow).otherwise(fast))
    return out.otherwise(TIERS["fast"][0])


def cpu_cost(length: Column, level: Column) -> Column:
    """Thousandths that encoding costs."""
    return (F.floor(length * 50 / (1 << 20)) + 1) * F.greatest(level, F.lit(1))


@pandas_udf(T.StructType([T.StructField("codec", T.StringType()), T.StructField("data", T.BinaryType())]))
def encode(content: pd.Series, level: pd.Series) -> pd.DataFrame:
    """zstd at the level, or raw where that isn't smaller or the level is 0."""
    import zstandard

    out = []
    for x, n in zip(content, level, strict=True):
        x = x or b""
        z = zstandard.ZstdCompressor(level=int(n)).compress(x) if n else x
        out.append(("zstd", z) if len(z) < len(x) else ("raw", x))
    return pd.DataFrame(out, columns=["codec", "data"])


@pandas_udf(T.BinaryType())
def decode(codec: pd.Series, data: pd.Series) -> pd.Series:
    import zstandard

    return pd.Series([zstandard.ZstdDecompressor().decompress(d) if c == "zstd" else d for c, d in zip(codec, data, strict=True)])


def train_dictionary(contents: DataFrame, col: str = "content", size: int = 16384, samples: int = 512, sample_bytes: int = 65536, least: int = 8) -> bytes | None:
    """A zstd dictionary from at most `samples` pieces of at most sample_bytes; None under `least` of them."""
    import zstandard

    got = [r[0] for r in contents.select(F.substring(F.col(col).cast("binary"), 1, sample_bytes)).where(F.col(col).isNotNull()).limit(samples).toLocalIterator()]
    return zstandard.train_dictionary(size, got).as_bytes() if len(got) >= least else None


def encrypt(content: Column, key: Column) -> Column:
    return F.aes_encrypt(content, key, F.lit("GCM"))


def decrypt(content: Column, key: Column) -> Column:
    return F.aes_decrypt(content, key, F.lit("GCM"))
