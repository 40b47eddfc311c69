"""Registered queries over records and sequence events, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.operators import query as q
from loomtrace.operators.link import sibling_counts
from loomtrace.session import load

FROM, TO = "2026-02-01 00:00:00", "2026-04-30 23:59:59.999"
E_ = "WITH e AS (SELECT DISTINCT ON (seq) * FROM sequence_events)"
L_ = "WITH e AS (SELECT DISTINCT ON (seq) * FROM log_entries)"
HAY = "lower(concat_ws(' ', function_name, message, module_name, file_name || ':' || coalesce(line_number::VARCHAR, ''), raw))"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return q.once(load(spark, d, "sequence_events"))


def _logs(spark: SparkSession, d: str) -> DataFrame:
    return q.once(load(spark, d, "log_entries"))


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "log_time_range": lambda s, d: _logs(s, d).where(q.in_time(F.col("ts"), FROM, TO)).select("seq"),
    "log_head": lambda s, d: q.head(_logs(s, d).where(q.in_time(F.col("ts"), FROM, TO)), 200).select("seq", "log_id", "message"),
    "lane_filter": lambda s, d: q.masked(_events(s, d), lanes=("MsgBus", "Scheduler")).select("seq", "lane", "parent_seq"),
    "event_filter": lambda s, d: q.masked(_events(s, d), levels=("INFO", "WARN", "ERROR"), kinds=("STRUCTURED",), function="Dispatch", start=FROM, end=TO).select("seq", "lane", "level", "function_id"),
    "thread_filter": lambda s, d: q.masked(_events(s, d), threads=("(none)", "T01")).select("seq", "thread_id"),
    "search_text": lambda s, d: q.search(_events(s, d), "Drained").select("seq"),
    "search_next": lambda s, d: q.next_hits(_events(s, d), "drained", F.col("seq") % 20 == 0),
    "collapse_hidden": lambda s, d: q.hidden(_events(s, d), F.col("seq") % 20 == 0).select("seq"),
    "function_finder": lambda s, d: q.find_functions(load(s, d, "source_functions").dropDuplicates(["function_id"]), _events(s, d), "flush"),
    "facet_counts": lambda s, d: q.facets(_events(s, d)),
    "lane_merge": lambda s, d: q.merged_lanes(_events(s, d)),
    "first_log_per_function": lambda s, d: q.first_logs(_events(s, d)),
    "most_logged": lambda s, d: q.most_logged(_events(s, d)),
    "log_spans": lambda s, d: q.log_spans(_events(s, d)),
    "intern_functions": lambda s, d: q.interned(_events(s, d), "function_id"),
    "child_counts": lambda s, d: sibling_counts(_events(s, d)).select("seq", "children"),
    "truncated_messages": lambda s, d: _logs(s, d).select("seq", q.truncated(F.col("message"), 60).alias("message"), q.kept_raw(80).alias("raw")),
    "full_text": lambda s, d: _events(s, d).select("seq", q.full_text().alias("line")),
    "relative_time": lambda s, d: q.relative_ms(_events(s, d)).select("seq", "rel_ms", q.clock(F.col("rel_ms")).alias("clock")),
    "thread_lines": lambda s, d: q.thread_neighbours(_events(s, d)),
    "visible_rank": lambda s, d: q.visible_rank(q.masked(_events(s, d), levels=("WARN", "ERROR", "FATAL"))),
    "event_sources": lambda s, d: q.event_sources(_events(s, d), load(s, d, "source_functions"), load(s, d, "source_files")),
    "selected_sources": lambda s, d: q.selected_sources(_events(s, d), load(s, d, "source_functions"), load(s, d, "source_files")),
}

SQL: dict[str, str] = {
    "log_time_range": f"{L_} SELECT seq FROM e WHERE ts IS NULL OR ts BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'",
    "log_head": f"{L_} SELECT seq, log_id, message FROM e WHERE ts IS NULL OR ts BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}' ORDER BY seq LIMIT 200",
    "lane_filter": f"{E_} SELECT seq, lane, parent_seq FROM e WHERE lane IN ('MsgBus', 'Scheduler')",
    "event_filter": f"""{E_} SELECT seq, lane, level, function_id FROM e WHERE level IN ('INFO', 'WARN', 'ERROR') AND kind = 'STRUCTURED'
        AND (ts IS NULL OR ts BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}')
        AND (contains(lower(coalesce(function_name, '')), 'dispatch') OR contains(lower(coalesce(function_id, '')), 'dispatch'))""",
    "thread_filter": f"{E_} SELECT seq, thread_id FROM e WHERE coalesce(thread_id, '(none)') IN ('(none)', 'T01')",
    "search_text": f"{E_} SELECT seq FROM e WHERE contains({HAY}, 'drained')",
    "search_next": f"""{E_}, h AS (SELECT seq FROM e WHERE contains({HAY}, 'drained')), a AS (SELECT seq FROM e WHERE seq % 20 = 0)
        SELECT a.seq, coalesce((SELECT min(seq) FROM h WHERE h.seq > a.seq), (SELECT min(seq) FROM h)) AS next_seq, coalesce((SELECT max(seq) FROM h WHERE h.seq < a.seq), (SELECT max(seq) FROM h)) AS previous_seq,
        (SELECT count(*) FROM h WHERE h.seq <= a.seq) AS place, (SELECT count(*) FROM h) AS hits FROM a""",
    "collapse_hidden": """WITH RECURSIVE e AS (SELECT DISTINCT seq, parent_seq FROM sequence_events),
        p AS (SELECT c.seq, c.parent_seq FROM e c JOIN e u ON c.parent_seq = u.seq),
        up AS (SELECT seq, parent_seq AS anc FROM p UNION SELECT up.seq, p.parent_seq FROM up JOIN p ON up.anc = p.seq),
        loops AS (SELECT seq FROM up WHERE seq = anc), bad AS (SELECT seq FROM up WHERE anc IN (SELECT seq FROM loops))
        SELECT DISTINCT seq FROM up WHERE anc % 20 = 0 AND seq NOT IN (SELECT seq FROM bad)""",
    "function_finder": f"""{E_}, f AS (SELECT DISTINCT function_id, ord FROM source_functions WHERE contains(lower(function_id), 'flush')),
        h AS (SELECT * FROM f ORDER BY ord, function_id LIMIT 400), l AS (SELECT DISTINCT function_id FROM e)
        SELECT h.function_id, l.function_id IS NOT NULL AS logged FROM h LEFT JOIN l USING (function_id) ORDER BY logged DESC, length(h.function_id), h.function_id LIMIT 60""",
    "facet_counts": f"""{E_} SELECT facet, value, count(*) AS n FROM (SELECT unnest([{{'facet': 'lane', 'value': coalesce(lane, '(none)')}},
        {{'facet': 'level', 'value': coalesce(level, '(none)')}}, {{'facet': 'kind', 'value': coalesce(kind, '(none)')}},
        {{'facet': 'thread_id', 'value': coalesce(thread_id, '(none)')}}], recursive := true) FROM e) GROUP BY ALL""",
    "lane_merge": f"""{E_}, l AS (SELECT lane, count(*) AS n, min(seq) AS f FROM e WHERE lane IS NOT NULL GROUP BY lane)
        SELECT lane, first_value(lane) OVER (PARTITION BY lower(lane) ORDER BY n DESC, f) AS merged FROM l""",
    "first_log_per_function": f"{E_} SELECT function_id, min(seq) AS first_seq, count(*) AS records FROM e WHERE function_id IS NOT NULL GROUP BY 1",
    "most_logged": f"{E_} SELECT function_id, count(*) AS records FROM e WHERE function_id IS NOT NULL GROUP BY 1 ORDER BY records DESC, max(seq) LIMIT 1",
    "log_spans": f"""{E_} SELECT log_id, count(*) AS records, arg_min(ts_ms, seq) FILTER (ts_ms IS NOT NULL) AS base_ms,
        arg_max(ts_ms, seq) FILTER (ts_ms IS NOT NULL) AS last_ms, bool_or(thread_id IS NOT NULL) AS has_thread FROM e GROUP BY 1""",
    "intern_functions": f"""{E_} SELECT function_id AS value, row_number() OVER (ORDER BY f, function_id) - 1 AS id
        FROM (SELECT function_id, min(seq) AS f FROM e WHERE function_id IS NOT NULL GROUP BY 1)""",
    "child_counts": f"{E_} SELECT e.seq, count(c.seq) AS children FROM e LEFT JOIN e c ON c.parent_seq = e.seq GROUP BY 1",
    "truncated_messages": f"""{L_} SELECT seq, CASE WHEN length(message) > 60 THEN message[1:60] || ' …(truncated)' ELSE message END AS message,
        CASE WHEN kind <> 'STRUCTURED' OR contains(raw, chr(10)) THEN raw[1:80] END AS raw FROM e""",
    "full_text": f"""{E_} SELECT seq, '[' || coalesce(strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d %H:%M:%S.%g'), '') || '] ' || CASE WHEN raw <> '' THEN raw ELSE
        coalesce('[' || tick || '] ', '') || coalesce(level, 'UNKNOWN') || ' ' || coalesce(module_name || ' ', '') || coalesce(message, '')
        || CASE WHEN file_name IS NOT NULL THEN ' (' || file_name || ':' || coalesce(line_number, -1) || ' ' || coalesce(function_name, '') || ')' ELSE '' END END AS line FROM e""",
    "relative_time": f"""{E_}, b AS (SELECT log_id, arg_min(ts_ms, seq) FILTER (ts_ms IS NOT NULL) AS base FROM e GROUP BY 1),
        r AS (SELECT seq, ts_ms - base AS m FROM e JOIN b USING (log_id))
        SELECT seq, m AS rel_ms, CASE WHEN m < 0 THEN '-' ELSE '' END || (abs(m) // 3600000)::VARCHAR || ':' || lpad((abs(m) // 60000 % 60)::VARCHAR, 2, '0') || ':'
        || lpad((abs(m) // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad((abs(m) % 1000)::VARCHAR, 3, '0') AS clock FROM r""",
    "thread_lines": f"{E_} SELECT seq, lag(seq) OVER (PARTITION BY log_id, thread_id ORDER BY seq) AS before_seq FROM e WHERE thread_id IS NOT NULL",
    "visible_rank": f"{E_} SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS pos FROM e WHERE level IN ('WARN', 'ERROR', 'FATAL')",
    "event_sources": f"""{E_}, f AS (SELECT function_id, arg_min(file_path, ord) AS p FROM source_functions GROUP BY 1),
        b AS (SELECT lower(split_part(path, '/', -1)) AS b, min(path) AS p FROM source_files GROUP BY 1)
        SELECT e.seq, coalesce(f.p, b.p) AS path FROM e LEFT JOIN f USING (function_id) LEFT JOIN b ON b.b = lower(split_part(e.file_name, '/', -1))""",
    "selected_sources": f"""{E_} SELECT file_path AS path FROM source_functions WHERE function_id IN (SELECT function_id FROM e)
        UNION SELECT path FROM source_files WHERE lower(split_part(path, '/', -1)) IN (SELECT lower(split_part(file_name, '/', -1)) FROM e)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
