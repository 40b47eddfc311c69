"""Facts of sources kept between runs: only changed files are analysed again, deleted ones are dropped."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.operators.extract import ASYNC_APIS, AsyncApi, facts
from loomtrace.session import cut
from loomtrace.sources.files import incremental, signatures

TABLES = ("functions", "calls", "async_calls", "refs")
FORMAT = 1


def _settings_key(apis: tuple[AsyncApi, ...]) -> str:
    return str((FORMAT, sorted((a.name, a.kind, a.arg, a.handle_arg if a.handle_arg is not None else -1) for a in apis)))


def cached_facts(files: DataFrame, folder: str, apis: tuple[AsyncApi, ...] = ASYNC_APIS) -> tuple[dict[str, DataFrame], DataFrame]:
    """(fact tables, the paths analysed in this run), with the state kept as Parquet in a shared folder.

    A state that is missing, unreadable or of other settings is not used. Files without path do not take part.
    """
    spark = files.sparkSession
    key = _settings_key(apis)
    try:
        old_sign = spark.read.parquet(f"{folder}/signatures").where(F.col("settings") == key)
        old = {t: cut(spark.read.parquet(f"{folder}/{t}")) for t in TABLES}
        old_sign = cut(old_sign.select("path", "signature"))
    except AnalysisException:
        old_sign, old = spark.createDataFrame([], "path string, signature string"), {}
    changed, _ = incremental(files, old_sign)
    changed = cut(changed)
    new = facts(changed, apis)
    now = cut(signatures(files))
    same = now.join(changed.select(F.col("path").alias("p")).distinct(), F.col("path") == F.col("p"), "left_anti").select(F.col("path").alias("same"))
    out = {}
    for t in TABLES:
        kept = old[t].join(same, F.col("path") == F.col("same"), "left_semi") if old else None
        out[t] = cut(new[t] if kept is None else kept.unionByName(new[t]))
    for t in TABLES:
        out[t].write.mode("overwrite").parquet(f"{folder}/{t}")
    now.withColumn("settings", F.lit(key)).write.mode("overwrite").parquet(f"{folder}/signatures")
    return out, changed.select("path").distinct()
