"""The export of sequence events: rows of dense codes with their dictionaries, as tables and as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.grammar import LEVELS
from loomtrace.operators.graph import encoded_nodes, strongest_edges
from loomtrace.operators.query import interned, kept_raw, log_spans, once, truncated
from loomtrace.session import cut

KINDS = ("STRUCTURED", "TRACE", "RAW")
ARROWS = ("", "SYNC", "ASYNC", "CALLBACK")
DICTIONARIES = {"lane": "lane", "func": "function_name", "file": "file_name", "module": "module_name", "thread": "thread_id"}


def _index(c: Column, names: tuple[str, ...]) -> Column:
    return (F.array_position(F.array(*(F.lit(x) for x in names)), c) - 1).cast("int")


def payload(events: DataFrame, functions: DataFrame, edges: DataFrame, max_message: int = 4000) -> dict[str, DataFrame]:
    """``events`` with dense codes (−1 for none), one table ``value, id`` per dictionary, ``nodes`` and ``edges``.

    Codes follow first sight; times are relative to the first known time of the log; edges with unknown ends are left out.
    """
    c = F.col
    e = cut(once(events))
    out = e
    tables: dict[str, DataFrame] = {}
    for name, column in DICTIONARIES.items():
        d = cut(interned(e, column))
        tables[name] = d
        ids = d.select(c("value").alias("_v"), c("id").alias(f"{name}_code"))
        out = out.join(ids, c(column) == c("_v"), "left").drop("_v")
    nodes = cut(encoded_nodes(functions, edges))
    out = out.join(nodes.select(c("node").alias("_n"), c("id").alias("fid")), c("function_id") == c("_n"), "left").drop("_n")
    base = log_spans(e).select(c("log_id").alias("_l"), "base_ms")
    out = out.join(base, c("log_id").eqNullSafe(c("_l"))).drop("_l")
    none = lambda x: F.coalesce(x, F.lit(-1)).cast("long")
    tables["events"] = out.select(
        "seq", "line_no", (c("ts_ms") - c("base_ms")).alias("ts"), _index(c("level"), LEVELS).alias("level"), _index(c("kind"), KINDS).alias("kind"),
        *(none(c(f"{n}_code")).alias(n) for n in ("lane", "func", "file")), none(c("line_number")).alias("line"), none(c("fid")).alias("fid"), none(c("parent_seq")).alias("parent"),
        _index(F.coalesce("arrow_kind", F.lit("")), ARROWS).alias("arrow"), "depth", "hops", truncated(c("message"), max_message).alias("msg"), none(c("module_code")).alias("module"),
        none(c("thread_code")).alias("thread"), "tick", F.coalesce(kept_raw(max_message), F.lit("")).alias("raw"),
    )
    a, b = nodes.select(c("node").alias("n1"), c("id").alias("from_id")), nodes.select(c("node").alias("n2"), c("id").alias("to_id"))
    x = strongest_edges(edges).join(a, c("caller") == c("n1")).join(b, c("callee") == c("n2"))
    tables["edges"] = x.select("from_id", "to_id", _index(c("kind"), ARROWS).alias("kind"), none(c("line")).alias("line"), F.coalesce("via", F.lit("")).alias("via"), "ord")
    tables["nodes"] = nodes
    return tables


def json_lines(table: DataFrame) -> DataFrame:
    """A table's rows as JSON arrays, one a row, to be written as text."""
    return table.select(F.to_json(F.array(*(F.col(x).cast("string") for x in table.columns))).alias("value"))


def write(tables: dict[str, DataFrame], folder: str) -> None:
    """Every table as Parquet in a folder of its name; written by all tasks."""
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{folder}/{name}")
