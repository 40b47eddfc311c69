"""Registered queries over source files: facts, the call graph built from them, signatures, exports, a dump read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.functions.paths import basename
from loomtrace.operators import callgraph as b
from loomtrace.operators import extract as x
from loomtrace.operators import payload as pl
from loomtrace.operators.graph import adjacency
from loomtrace.operators.ordered import offsets
from loomtrace.operators.query import changed_files
from loomtrace.session import load
from loomtrace.sources import files as sf


def _files(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "source_files")


def _functions(s: SparkSession, d: str) -> DataFrame:
    return x.functions(x.structure(_files(s, d))).select("path", "name", "start_line", "end_line", "is_static")


def _function_ids(s: SparkSession, d: str) -> DataFrame:
    return b.function_table(x.functions(x.structure(_files(s, d))))[0].select("function_id", "name", "file_path", "start_line", "end_line")


def _changed(s: SparkSession, d: str) -> DataFrame:
    now = _files(s, d).where("path is not null and content is not null").select("path", "content").distinct()
    kind = F.length("path") % 5
    before = now.where(kind != 1).select("path", F.when(kind == 2, F.concat("content", F.lit("//"))).otherwise(F.col("content")).alias("content"))
    gone = now.where(kind == 3).select(F.concat("path", F.lit(".old")).alias("path"), "content")
    return changed_files(now, before.unionByName(gone))


def _dump_lines(s: SparkSession, d: str) -> DataFrame:
    """The files as one dump per first letter of their base name, one file behind the other, so that reading dumps back can be checked."""
    c = F.col
    once = _files(s, d).where("path is not null and content is not null").groupBy("path").agg(F.min("content").alias("content"))
    body = F.split(F.concat(F.lit(f"{sf.FILE_BEGIN}\nPath: Input\\"), F.replace("path", F.lit("/"), F.lit("\\")), F.lit(f"\n{sf.CONTENT_BEGIN}\n"), F.regexp_replace("content", "\r\n?", "\n"), F.lit(f"\n{sf.CONTENT_END}\n{sf.FILE_END}")), "\n")
    files = once.select("path", F.substring(basename(c("path")), 1, 1).alias("dump"), body.alias("body")).withColumn("n", F.size("body"))
    rows = offsets(files, ["dump", "path"], "n", "at").select("dump", "at", F.posexplode("body").alias("i", "line"))
    return rows.select(c("dump").alias("log_id"), (c("at") + c("i") + 1).alias("line_no"), "line")


def _payload(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return pl.payload(load(s, d, "sequence_events"), load(s, d, "source_functions"), load(s, d, "call_edges"))


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "source_functions_found": _functions,
    "source_function_ids": _function_ids,
    "source_calls": lambda s, d: x.facts(_files(s, d))["calls"].select("path", "fi", "line", "name", "kind"),
    "source_refs": lambda s, d: x.facts(_files(s, d))["refs"].select("path", "fi", "line", "name", "field_name", "via_call"),
    "source_call_graph": lambda s, d: b.build(_files(s, d)).edges,
    "source_build_stats": lambda s, d: b.build_report(_files(s, d), b.build(_files(s, d))),
    "source_adjacency": lambda s, d: adjacency(b.build(_files(s, d)).edges).select("caller", F.array_join("callees", ",").alias("callees")),
    "changed_files": _changed,
    "file_signatures": lambda s, d: sf.signatures(_files(s, d)),
    "dump_round_trip": lambda s, d: sf.from_dump(_dump_lines(s, d)).select("path", F.md5("content").alias("md5")),
    "payload_events": lambda s, d: _payload(s, d)["events"].select("seq", "ts", "level", "kind", "lane", "func", "file", "line", "fid", "parent", "arrow", "module", "thread"),
    "payload_edges": lambda s, d: _payload(s, d)["edges"].select("from_id", "to_id", "kind", "line", "via"),
}

_DICT = "row_number() OVER (ORDER BY f, v) - 1 AS id FROM (SELECT {c} AS v, min(seq) AS f FROM e WHERE {c} IS NOT NULL GROUP BY 1)"
_NODES = """n AS (SELECT node, row_number() OVER (ORDER BY l, node) - 1 AS id FROM (SELECT DISTINCT function_id AS node, 0 AS l FROM source_functions
    UNION SELECT callee, 1 FROM call_edges WHERE callee = 'UNRESOLVED_FUNCTION_POINTER'))"""

SQL: dict[str, str] = {
    "source_functions_found": """SELECT DISTINCT file_path AS path, name, start_line, end_line, is_static FROM source_functions
        WHERE file_path IN (SELECT path FROM source_files WHERE content IS NOT NULL)""",
    "source_function_ids": """SELECT DISTINCT function_id, name, file_path, start_line, end_line FROM source_functions
        WHERE file_path IN (SELECT path FROM source_files WHERE content IS NOT NULL)""",
    "changed_files": """WITH now AS (SELECT DISTINCT path, content FROM source_files WHERE path IS NOT NULL AND content IS NOT NULL)
        SELECT path, 'new' AS state FROM now WHERE length(path) % 5 = 1 UNION ALL SELECT path, 'changed' FROM now WHERE length(path) % 5 = 2
        UNION ALL SELECT path || '.old', 'deleted' FROM now WHERE length(path) % 5 = 3""",
    "file_signatures": "SELECT path, min(sha1(coalesce(content, ''))) AS signature FROM source_files WHERE path IS NOT NULL GROUP BY 1",
    "dump_round_trip": r"""SELECT path, md5(regexp_replace(min(content), '\r\n?', chr(10), 'g') || chr(10)) AS md5 FROM source_files WHERE path IS NOT NULL AND content IS NOT NULL GROUP BY 1""",
    "payload_events": f"""WITH e AS (SELECT DISTINCT ON (seq) * FROM sequence_events), {_NODES}, dl AS (SELECT v, {_DICT.format(c='lane')}), df AS (SELECT v, {_DICT.format(c='function_name')}),
        di AS (SELECT v, {_DICT.format(c='file_name')}), dm AS (SELECT v, {_DICT.format(c='module_name')}), dt AS (SELECT v, {_DICT.format(c='thread_id')}),
        b AS (SELECT log_id, arg_min(ts_ms, seq) FILTER (ts_ms IS NOT NULL) AS base FROM e GROUP BY 1)
        SELECT e.seq, e.ts_ms - b.base AS ts, list_position(['TRACE', 'DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL', 'UNKNOWN'], level) - 1 AS level, list_position(['STRUCTURED', 'TRACE', 'RAW'], kind) - 1 AS kind,
        coalesce(dl.id, -1) AS lane, coalesce(df.id, -1) AS func, coalesce(di.id, -1) AS file, coalesce(line_number, -1) AS line, coalesce(n.id, -1) AS fid, coalesce(parent_seq, -1) AS parent,
        list_position(['', 'SYNC', 'ASYNC', 'CALLBACK'], coalesce(arrow_kind, '')) - 1 AS arrow, coalesce(dm.id, -1) AS module, coalesce(dt.id, -1) AS thread
        FROM e JOIN b USING (log_id) LEFT JOIN n ON n.node = e.function_id LEFT JOIN dl ON dl.v = lane LEFT JOIN df ON df.v = function_name LEFT JOIN di ON di.v = file_name LEFT JOIN dm ON dm.v = module_name LEFT JOIN dt ON dt.v = thread_id""",
    "payload_edges": f"""WITH {_NODES}, e AS (SELECT caller, callee, arg_min({{'kind': kind, 'line': line, 'via': via}}, (CASE kind WHEN 'CALLBACK' THEN 0 WHEN 'ASYNC' THEN 1 ELSE 2 END) * 1000000000 + ord) AS b
        FROM call_edges WHERE caller IS NOT NULL AND callee IS NOT NULL GROUP BY 1, 2)
        SELECT a.id AS from_id, c.id AS to_id, list_position(['', 'SYNC', 'ASYNC', 'CALLBACK'], b.kind) - 1 AS kind, coalesce(b.line, -1) AS line, coalesce(b.via, '') AS via FROM e JOIN n a ON a.node = caller JOIN n c ON c.node = callee""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
