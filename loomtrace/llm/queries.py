"""Registered queries of the training-data problems, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.codelang import language_shares, natural_language
from loomtrace.llm.garbled import find_garbled, source_model
from loomtrace.llm.mixing import mixture, mixture_shares, unfilled
from loomtrace.llm.packing import container_fill, pack, split_documents
from loomtrace.llm.quality import non_prose, text_quality
from loomtrace.llm.runs import collapse_runs
from loomtrace.session import cut, load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Runs of two or more neighbouring records of the same event."""
    return collapse_runs(load(spark, d, "log_entries"), min_count=2).select("first_seq", "last_seq")


def p1_events(spark: SparkSession, d: str) -> DataFrame:
    """The collapsed sequences: every run with its count and duration."""
    return collapse_runs(load(spark, d, "log_entries"))


def LOGS(df: DataFrame) -> tuple[str, DataFrame, str, str, bool]:  # noqa: N802
    return ("log_entries", df, "seq", "message", False)


def FILES(df: DataFrame) -> tuple[str, DataFrame, str, str, bool]:  # noqa: N802
    return ("source_files", df, "path", "content", True)


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    return find_garbled(spark, [LOGS(load(spark, d, "log_entries")), FILES(load(spark, d, "source_files"))])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Records with characters from a wrong decoding."""
    return _garbled(spark, d).select("table_name", "record_key")


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    """The same with the restored texts."""
    return _garbled(spark, d)


def _sound_files(spark: SparkSession, d: str) -> DataFrame:
    """Source files in which p2 finds no wrong decoding."""
    files = load(spark, d, "source_files")
    bad = find_garbled(spark, [FILES(files)], source_model([LOGS(load(spark, d, "log_entries")), FILES(files)]))
    bad = cut(bad.select(F.col("record_key").alias("bad")))  # the sound files are read twice
    return files.join(bad, F.col("path") == F.col("bad"), "left_anti")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines on which a comment or literal with natural language opens, with each language in it."""
    found = natural_language(_sound_files(spark, d), load(spark, d, "documents"))
    return found.select("path", "line_no", "lang").distinct()


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    """Each language's share of each file."""
    return language_shares(natural_language(_sound_files(spark, d), load(spark, d, "documents")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are larger than a container and so had to be split."""
    return split_documents(pack(load(spark, d, "documents"), load(spark, d, "pack_targets")))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each kind get."""
    targets = load(spark, d, "pack_targets")
    return container_fill(pack(load(spark, d, "documents"), targets), targets)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that cannot fill their share of the mixture even at their cap."""
    return unfilled(mixture(load(spark, d, "documents"), load(spark, d, "mix_targets")))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the mixture reaches."""
    return mixture_shares(mixture(load(spark, d, "documents"), load(spark, d, "mix_targets"))).drop("total")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts that are lists, tables or junk by more than half."""
    return non_prose(load(spark, d, "documents"))


def p8_quality(spark: SparkSession, d: str) -> DataFrame:
    """The quality statistics of every text."""
    return text_quality(load(spark, d, "documents"))


P6_FOUND = "SELECT t.target_id, d.doc_id FROM documents d JOIN pack_targets t ON strlen(d.text) > t.capacity"

P7_FOUND = """
WITH d AS (SELECT replace(lower(trim(source)), '-', '_') AS k, coalesce(strlen(text), 0) AS size FROM documents),
     s AS (SELECT k, sum(size) AS size FROM d GROUP BY k)
SELECT t.source FROM mix_targets t LEFT JOIN s ON s.k = replace(lower(trim(t.source)), '-', '_')
WHERE coalesce(s.size, 0) * t.max_repeats < t.weight * (SELECT sum(size) FROM d)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_events": p1_events, "p2_found": p2_found, "p2_restored": p2_restored, "p3_found": p3_found, "p3_shares": p3_shares, "p6_found": p6_found, "p6_containers": p6_containers,
        "p7_found": p7_found, "p7_shares": p7_shares, "p8_found": p8_found, "p8_quality": p8_quality}


def oracle_sql() -> dict[str, str]:
    return {"p6_found": P6_FOUND, "p7_found": P7_FOUND}
