"""Log files as physical lines, numbered within each file however Spark splits it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtrace.session import cut

LINES = "log_id string, line_no long, line string"


def read_lines(spark: SparkSession, path: str | list[str], suffix: str | None = None) -> DataFrame:
    """``log_id, line_no, line`` of text files (UTF-8, broken bytes as U+FFFD; CR, LF and CR LF end a line).

    ``log_id`` is the file's path. Lines are numbered from 1 by counts per split and running offsets; no file is sorted or
    read by one task. ``suffix``: only files that end so. An empty file has no lines.
    """
    c = F.col
    raw = spark.read.text(path).select(c("_metadata.file_path").alias("log_id"), c("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), c("value").alias("line"))
    if suffix:
        raw = raw.where(c("log_id").endswith(suffix))
    raw = cut(raw)
    splits = raw.groupBy("log_id", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("log_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(c("log_id").alias("l"), c("block").alias("b"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    out = raw.join(splits, (c("log_id") == c("l")) & (c("block") == c("b")))
    return out.select("log_id", (c("off") + c("at") - c("first") + 1).alias("line_no"), "line")


def lines_of(spark: SparkSession, lines: list[str], log_id: str = "log") -> DataFrame:
    """The same of lines in memory (tests, small pipes)."""
    return spark.createDataFrame([(log_id, i, x.rstrip("\r\n")) for i, x in enumerate(lines, 1)], LINES)
