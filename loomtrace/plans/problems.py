"""Registered queries of the general problems, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.operators.hierarchy import call_descendants, call_hierarchy, descendants, found_links, hierarchy
from loomtrace.operators.loglines import entries, unparsed_spans
from loomtrace.session import load


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Entries of other programs: first and last record, level, component."""
    return entries(load(spark, d, "log_entries")).select("first_seq", "last_seq", "level", "component")


def p4_entries(spark: SparkSession, d: str) -> DataFrame:
    """The whole entries, with timestamp and message."""
    return entries(load(spark, d, "log_entries"))


def p4_unparsed(spark: SparkSession, d: str) -> DataFrame:
    """What no field covers: the spans of every line, with the entry it belongs to."""
    return unparsed_spans(load(spark, d, "log_entries"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Roots of all records with a parent, cycles, and functions that reach themselves."""
    return found_links(load(spark, d, "sequence_events"), load(spark, d, "source_functions"), load(spark, d, "call_edges"))


def p5_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth, root and number of descendants of every record."""
    return hierarchy(load(spark, d, "sequence_events"))


def p5_call_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth, root, number of descendants and cycles of every function of the call graph, a row for each of its roots."""
    return call_hierarchy(load(spark, d, "call_edges"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every record and of every function, those on and below cycles too."""
    a = descendants(load(spark, d, "sequence_events")).select(F.lit("parent").alias("relation"), *(F.col(c).cast("string").alias(c) for c in ("node", "descendant")), "distance")
    return a.unionByName(call_descendants(load(spark, d, "call_edges")).select(F.lit("call").alias("relation"), "node", "descendant", "distance"))


_TREE = """e AS (SELECT seq, min(parent_seq) AS parent_seq FROM sequence_events WHERE seq IS NOT NULL GROUP BY 1),
    p AS (SELECT c.seq, c.parent_seq FROM e c JOIN e u ON c.parent_seq = u.seq),
    down AS (SELECT seq, seq AS root, 0 AS depth, seq::VARCHAR AS path FROM e WHERE seq NOT IN (SELECT seq FROM p)
             UNION ALL SELECT p.seq, down.root, down.depth + 1, down.path || '/' || p.seq FROM down JOIN p ON p.parent_seq = down.seq)"""

P5_FOUND = f"""WITH RECURSIVE {_TREE}, g AS (SELECT DISTINCT caller, callee FROM call_edges WHERE caller IS NOT NULL AND callee IS NOT NULL),
    r AS (SELECT caller, callee FROM g UNION SELECT r.caller, g.callee FROM r JOIN g ON r.callee = g.caller)
    SELECT 'parent' AS relation, e.seq::VARCHAR AS node, coalesce(root::VARCHAR, 'cycle') AS root FROM e LEFT JOIN down USING (seq) WHERE e.parent_seq IS NOT NULL
    UNION ALL SELECT 'call', caller, 'cycle' FROM r WHERE caller = callee AND caller IN (SELECT function_id FROM source_functions)"""

P5_HIERARCHY = f"""WITH RECURSIVE {_TREE}, up AS (SELECT seq, parent_seq AS anc FROM p UNION SELECT up.seq, p.parent_seq FROM up JOIN p ON up.anc = p.seq),
    n AS (SELECT anc AS seq, count(*) AS descendants FROM up GROUP BY 1)
    SELECT e.seq AS node, down.root, down.depth, down.seq IS NULL AS cycle, down.path, coalesce(n.descendants, 0) AS descendants FROM e LEFT JOIN down USING (seq) LEFT JOIN n USING (seq)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p4_found": p4_found, "p4_entries": p4_entries, "p4_unparsed": p4_unparsed, "p5_found": p5_found, "p5_hierarchy": p5_hierarchy, "p5_call_hierarchy": p5_call_hierarchy, "p5_descendants": p5_descendants}


def oracle_sql() -> dict[str, str]:
    return {"p5_found": P5_FOUND, "p5_hierarchy": P5_HIERARCHY}
