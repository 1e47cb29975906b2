"""Append-only logs, one JSON object a line, and reports, one object a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows with seq, their order. A log that we wrote has it; for another it is file name and place in the file."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("_at", F.monotonically_increasing_id())
    rows = lines.select(F.from_json("value", schema).alias("r"), "_at")
    names = [f.name for f in schema.fields]
    seq = F.coalesce(F.col("r.seq"), F.col("_at")) if "seq" in names else F.col("_at")
    return rows.select(seq.cast("long").alias("seq"), *[F.col(f"r.{n}").alias(n) for n in names if n != "seq"])


def append_log(rows: DataFrame, path: str, after: int = 0) -> None:
    """Appends rows; those without seq are numbered from after + 1 on."""
    if "seq" not in rows.columns:
        from pyspark.sql import Window

        rows = rows.withColumn("seq", F.row_number().over(Window.orderBy(*rows.columns)) + after)
    rows.write.mode("append").json(path)


def read_report(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def to_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("json"))
