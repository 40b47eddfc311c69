"""Registered queries that read execution logs from their lines, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.functions.grammar import Grammar, level_of
from loomtrace.operators import logs as l
from loomtrace.session import load


def _parsed(s: SparkSession, d: str) -> DataFrame:
    return l.parse(l.physical_lines(load(s, d, "log_entries")))


def _levels(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "log_entries").where("raw is not null").dropDuplicates(["seq"])
    word = F.regexp_extract("raw", r"(?i)\b(trace|debug|info|warn(?:ing)?|error|fatal)\b", 1)
    return e.select("seq", level_of(word).alias("level"))


def _scalars(s: SparkSession, d: str) -> DataFrame:
    g, c = Grammar(), F.col
    e = load(s, d, "log_entries").where("raw is not null").dropDuplicates(["seq"]).select("seq", "raw")
    e = e.select("seq", g.ts_text(c("raw")).alias("ts_text"), g.body(c("raw")).alias("body"))
    t = g.trailer(c("body"))
    return e.select("seq", "ts_text", g.is_head(c("body")).alias("head"), t["file"].alias("file"), t["line"].alias("line"), t["func"].alias("func"), g.has_partial_trailer(c("body")).alias("torn"), F.size(g.interrupts(c("body"))).alias("cut_ins"))


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "log_parse": lambda s, d: _parsed(s, d).select("log_id", "seq", "line_no", F.col("tick").cast("string").alias("tick"), "level", "module_name", "function_name", "message", "file_name", "line_number", "kind"),
    "log_times": lambda s, d: _parsed(s, d).select("log_id", "line_no", "ts_ms"),
    "log_records": lambda s, d: l.assemble(l.physical_lines(load(s, d, "log_entries"))).select("log_id", "line_no", "kind"),
    "line_scalars": _scalars,
    "level_parse": _levels,
}

_TS = r"^\[(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?)\] ?"
_TR = r"\s\(([^\s():]+\.[A-Za-z0-9]{1,4}):(\d+) ([A-Za-z_~][\w:~<>]*)\)\s*$"
_HD = r"^\[(\d+)\] (TRACE|DEBUG|INFO|WARN|ERROR|FATAL|UNKNOWN) ?"
_TC = r"^\*{5,}(.*?)\s*\[([A-Za-z_]\w*)\((\d+)\)\]\s*$"
_B = f"""r AS (SELECT DISTINCT ON (seq) seq, log_id, line_no, raw FROM log_entries WHERE raw IS NOT NULL),
    b AS (SELECT *, nullif(regexp_extract(raw, '{_TS}', 1), '') AS tt, regexp_replace(raw, '{_TS}', '') AS body FROM r),
    h AS (SELECT *, regexp_matches(body, '{_HD}') AS head, nullif(regexp_extract(body, '{_HD}', 2), '') AS lv FROM b),
    k AS (SELECT *, CASE WHEN head THEN 'STRUCTURED' WHEN regexp_matches(trim(body), '{_TC}') THEN 'TRACE' ELSE 'RAW' END AS kind FROM h)"""

SQL: dict[str, str] = {
    "log_parse": f"""WITH {_B},
        a AS (SELECT *, CASE WHEN length(lv) < 5 THEN ltrim(regexp_replace(body, '{_HD}', '')) ELSE regexp_replace(body, '{_HD}', '') END AS af FROM k),
        m AS (SELECT *, CASE WHEN NOT head THEN NULL WHEN length(af) > 23 AND af[24] = ' ' AND trim(af[1:23]) <> '' THEN rtrim(af[1:23]) WHEN length(af) <= 23 THEN rtrim(af) ELSE regexp_extract(af, '^\\s*(\\S*)', 1) END AS md,
              CASE WHEN NOT head THEN NULL WHEN length(af) > 23 AND af[24] = ' ' AND trim(af[1:23]) <> '' THEN af[25:] WHEN length(af) <= 23 THEN '' ELSE regexp_replace(ltrim(af), '^\\S*\\s*', '') END AS rest FROM a),
        t AS (SELECT *, regexp_matches(rest, '{_TR}') AS tr, trim(body) AS tb FROM m)
        SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY line_no) - 1 AS seq, line_no, CASE WHEN head THEN CAST(CAST(regexp_extract(body, '{_HD}', 1) AS HUGEINT) AS VARCHAR) END AS tick, coalesce(lv, 'UNKNOWN') AS level, nullif(md, '') AS module_name,
        CASE WHEN kind = 'TRACE' THEN regexp_extract(tb, '{_TC}', 2) WHEN tr THEN regexp_extract(rest, '{_TR}', 3) END AS function_name,
        CASE WHEN kind = 'TRACE' THEN trim(regexp_extract(tb, '{_TC}', 1)) WHEN kind = 'RAW' THEN regexp_replace(body, '^\\s+|\\s+$', '', 'g') ELSE regexp_replace(regexp_replace(rest, '{_TR}', ''), '\\s+$', '') END AS message,
        CASE WHEN tr THEN regexp_extract(rest, '{_TR}', 1) END AS file_name, CASE WHEN kind = 'TRACE' THEN regexp_extract(tb, '{_TC}', 3)::BIGINT WHEN tr THEN regexp_extract(rest, '{_TR}', 2)::BIGINT END AS line_number, kind FROM t""",
    "log_times": f"""WITH {_B}, f AS (SELECT *, last_value(tt IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY line_no) AS t2 FROM b)
        SELECT log_id, line_no, epoch_ms(try_cast(replace(replace(t2, 'T', ' '), ',', '.') AS TIMESTAMP)) AS ts_ms FROM f""",
    "log_records": f"WITH {_B} SELECT log_id, line_no, kind FROM k",
    "line_scalars": f"""WITH {_B} SELECT seq, tt AS ts_text, head, CASE WHEN regexp_matches(body, '{_TR}') THEN regexp_extract(body, '{_TR}', 1) END AS file, CASE WHEN regexp_matches(body, '{_TR}') THEN regexp_extract(body, '{_TR}', 2)::BIGINT END AS line,
        CASE WHEN regexp_matches(body, '{_TR}') THEN regexp_extract(body, '{_TR}', 3) END AS func, regexp_matches(body, '\\s\\([^\\s():]+\\.[A-Za-z0-9]{{1,4}}(?::\\d*(?: [\\w:~<>]*)?)?$') AS torn,
        len(regexp_extract_all(body, '[\\w)\\]]\\*{{5,}}.*?\\[[A-Za-z_]\\w*\\(\\d+\\)\\]')) AS cut_ins FROM h""",
    "level_parse": r"""WITH r AS (SELECT DISTINCT ON (seq) seq, upper(regexp_extract(raw, '(?i)\b(trace|debug|info|warn(?:ing)?|error|fatal)\b', 1)) AS w FROM log_entries WHERE raw IS NOT NULL)
        SELECT seq, CASE WHEN w = 'WARNING' THEN 'WARN' WHEN w = '' THEN 'UNKNOWN' ELSE w END AS level FROM r""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
