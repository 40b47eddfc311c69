"""Registered queries over call graphs and the linking of records, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.functions import paths as p
from loomtrace.operators import graph as g
from loomtrace.operators import link as k
from loomtrace.operators.query import once
from loomtrace.session import load

CENTER = "bus_core.c::bus_dispatch"


def _edges(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "call_edges")


def _functions(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "source_functions")


def _resolved(s: SparkSession, d: str) -> DataFrame:
    return k.resolve_functions(once(load(s, d, "log_entries")), _functions(s, d))


def _links(s: SparkSession, d: str) -> DataFrame:
    return k.caller_links(_resolved(s, d), g.caller_reach(_edges(s, d)))


def _modules(s: SparkSession, d: str) -> DataFrame:
    r = p.ModuleRules(file_rules=(("*config*", "Config"),))
    return load(s, d, "source_files").where("path is not null").select("path").distinct().select("path", r.from_path(F.col("path")).alias("by_path"), r.for_path(F.col("path")).alias("module"))


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "edge_dedupe": lambda s, d: g.strongest_edges(_edges(s, d)),
    "function_dedupe": lambda s, d: g.first_functions(_functions(s, d)),
    "adjacency_list": lambda s, d: g.adjacency(_edges(s, d)).select("caller", F.array_join("callees", ",").alias("callees")),
    "degrees": lambda s, d: g.degrees(_functions(s, d), _edges(s, d)),
    "caller_reach_3hop": lambda s, d: g.caller_reach(_edges(s, d)),
    "k_hop_subgraph": lambda s, d: g.subgraph(_edges(s, d), CENTER, 2, "backward"),
    "graph_stats": lambda s, d: g.build_stats(_functions(s, d), _edges(s, d)),
    "dot_lines": lambda s, d: g.edge_lines(_edges(s, d)).select("dot"),
    "detail_export": lambda s, d: g.detail_lines(_functions(s, d), _edges(s, d)),
    "encoded_nodes": lambda s, d: g.encoded_nodes(_functions(s, d), _edges(s, d)),
    "exclude_callees": lambda s, d: g.without_callees(g.strongest_edges(_edges(s, d)), _functions(s, d), ("bus_*", "*_core")).select("caller", "callee"),
    "unique_suffix_ids": lambda s, d: p.unique_suffixes(load(s, d, "source_files")),
    "split_ids": lambda s, d: g.first_functions(_functions(s, d)).select("function_id", p.split_id(F.col("function_id")).alias("x")).select("function_id", "x.suffix", "x.name"),
    "path_modules": _modules,
    "accepted_paths": lambda s, d: load(s, d, "source_files").where("path is not null").select("path").distinct().where(p.accepted(F.col("path"), exclude=("*/impl/*", "*/drv/*"))),
    "log_to_function": lambda s, d: _resolved(s, d).select("seq", "function_id"),
    "log_lanes": lambda s, d: k.lanes(_resolved(s, d)).select("seq", "lane"),
    "caller_links": _links,
    "sequence_build": lambda s, d: k.sequence_events(load(s, d, "log_entries"), _functions(s, d), _edges(s, d)).select("seq", "lane", "function_id", "parent_seq", "arrow_kind", "depth", "hops"),
}

_E = """e AS (SELECT caller, callee, min(ord) AS ord, arg_min({'kind': kind, 'line': line, 'via': via}, (CASE kind WHEN 'CALLBACK' THEN 0 WHEN 'ASYNC' THEN 1 ELSE 2 END) * 1000000000 + ord) AS b
    FROM call_edges WHERE caller IS NOT NULL AND callee IS NOT NULL GROUP BY 1, 2),
    x AS (SELECT caller, callee, b.kind AS kind, b.line AS line, b.via AS via, ord FROM e)"""
_F = "f AS (SELECT DISTINCT ON (function_id) * FROM source_functions ORDER BY function_id, ord)"
_R = "CASE kind WHEN 'CALLBACK' THEN 2 WHEN 'ASYNC' THEN 1 ELSE 0 END"
_REACH = f"""{_E}, k AS (SELECT *, {_R} AS r FROM x WHERE caller <> 'UNRESOLVED_FUNCTION_POINTER'),
    w AS (SELECT callee, caller, 1 AS hops, r, [ord] AS way FROM k WHERE caller <> callee),
    w2 AS (SELECT w.callee, k.caller, 2 AS hops, greatest(w.r, k.r) AS r, list_append(w.way, k.ord) AS way FROM w JOIN k ON w.caller = k.callee WHERE k.caller <> w.callee),
    b2 AS (SELECT callee, caller, hops, arg_min(r, way) AS r, min(way) AS way FROM w2 WHERE (callee, caller) NOT IN (SELECT (callee, caller) FROM w) GROUP BY ALL),
    w3 AS (SELECT b.callee, k.caller, 3 AS hops, greatest(b.r, k.r) AS r, list_append(b.way, k.ord) AS way FROM b2 b JOIN k ON b.caller = k.callee WHERE k.caller <> b.callee),
    b3 AS (SELECT callee, caller, hops, arg_min(r, way) AS r, min(way) AS way FROM w3
           WHERE (callee, caller) NOT IN (SELECT (callee, caller) FROM w) AND (callee, caller) NOT IN (SELECT (callee, caller) FROM b2) GROUP BY ALL),
    reach AS (SELECT callee, caller, hops, CASE r WHEN 2 THEN 'CALLBACK' WHEN 1 THEN 'ASYNC' ELSE 'SYNC' END AS kind, CASE r WHEN 0 THEN 1000 ELSE 10000 END::BIGINT AS window_ms
              FROM (SELECT callee, caller, hops, r FROM w UNION ALL SELECT callee, caller, hops, r FROM b2 UNION ALL SELECT callee, caller, hops, r FROM b3))"""
_RES = f"""{_F}, l AS (SELECT DISTINCT ON (seq) * FROM log_entries),
    n AS (SELECT function_id, module, ord, start_line, end_line, lower(split_part(file_path, '/', -1)) AS base, unnest(list_distinct([name, split_part(name, '::', -1)])) AS key FROM f),
    a AS (SELECT DISTINCT file_name, function_name, line_number FROM l WHERE function_name <> ''),
    c AS (SELECT a.*, n.function_id, n.module, (lower(split_part(a.file_name, '/', -1)) = n.base) IS NOT TRUE AS t, (a.line_number BETWEEN n.start_line AND n.end_line) IS NOT TRUE AS o, n.ord
          FROM a JOIN n ON a.function_name = n.key),
    m AS (SELECT DISTINCT ON (file_name, function_name, line_number) * FROM c ORDER BY file_name, function_name, line_number, t, o, ord),
    res AS (SELECT l.*, m.function_id, m.module AS fmod FROM l LEFT JOIN m ON l.file_name IS NOT DISTINCT FROM m.file_name AND l.function_name = m.function_name AND l.line_number IS NOT DISTINCT FROM m.line_number)"""
_LINK = f"""{_REACH}, {_RES}, q AS (SELECT res.log_id, res.seq, res.ts_ms, r.caller, r.hops, r.kind, r.window_ms FROM res JOIN reach r ON res.function_id = r.callee),
    last AS (SELECT q.*, s.seq AS cs, s.ts_ms AS ct FROM q ASOF JOIN (SELECT log_id, function_id, seq, ts_ms FROM res WHERE function_id IS NOT NULL) s ON q.log_id = s.log_id AND q.caller = s.function_id AND q.seq > s.seq),
    ok AS (SELECT * FROM last WHERE coalesce(ts_ms - ct BETWEEN 0 AND window_ms, true)),
    links AS (SELECT DISTINCT ON (log_id, seq) log_id, seq, cs AS caller_seq, kind AS arrow_kind, hops FROM ok ORDER BY log_id, seq, cs DESC, hops)"""
_LANE = """p AS (SELECT *, CASE WHEN module_name <> '' THEN nullif(trim(CASE WHEN contains(module_name, ':') AND trim(split_part(module_name, ':', 1)) <> '' THEN trim(split_part(module_name, ':', 1)) ELSE module_name END), '') END AS ll FROM res),
    fs AS (SELECT log_id, lower(ll) AS low, min(seq) AS since, arg_min(ll, seq) AS spelt FROM p WHERE ll IS NOT NULL GROUP BY ALL),
    lan AS (SELECT p.seq, coalesce(p.ll, CASE WHEN fmod IS NOT NULL THEN CASE WHEN fs.since < p.seq THEN fs.spelt ELSE fmod END END, CASE WHEN kind = 'RAW' THEN '(other)' END, '(unknown)') AS lane
            FROM p LEFT JOIN fs ON p.log_id = fs.log_id AND lower(p.fmod) = fs.low AND p.ll IS NULL)"""

SQL: dict[str, str] = {
    "edge_dedupe": f"WITH {_E} SELECT * FROM x",
    "function_dedupe": f"WITH {_F} SELECT * FROM f",
    "adjacency_list": "SELECT caller, string_agg(DISTINCT callee, ',' ORDER BY callee) AS callees FROM call_edges WHERE callee IS NOT NULL AND caller IS NOT NULL GROUP BY 1",
    "degrees": f"""WITH {_E} SELECT function_id, (SELECT count(*) FROM x WHERE x.caller = f.function_id) AS out_degree, (SELECT count(*) FROM x WHERE x.callee = f.function_id) AS in_degree
        FROM (SELECT DISTINCT function_id FROM source_functions) f""",
    "caller_reach_3hop": f"WITH {_REACH} SELECT * FROM reach",
    "k_hop_subgraph": f"""WITH {_E}, h1 AS (SELECT '{CENTER}' AS n UNION SELECT caller FROM x WHERE callee = '{CENTER}'), h2 AS (SELECT n FROM h1 UNION SELECT caller FROM x JOIN h1 ON x.callee = h1.n)
        SELECT caller, callee, kind FROM x WHERE caller IN (SELECT n FROM h2) AND callee IN (SELECT n FROM h2)""",
    "graph_stats": f"""WITH {_E} SELECT (SELECT count(DISTINCT function_id) FROM source_functions) AS functions, count(*) AS edges, count(*) FILTER (kind = 'ASYNC') AS async_edges,
        count(*) FILTER (kind = 'CALLBACK') AS callback_edges, count(*) FILTER (callee = 'UNRESOLVED_FUNCTION_POINTER') AS unresolved_callers FROM x""",
    "dot_lines": f"""WITH {_E} SELECT '  "' || caller || '" -> "' || callee || '" [style=' || CASE kind WHEN 'ASYNC' THEN 'dotted' WHEN 'CALLBACK' THEN 'dashed' ELSE 'solid' END || '];' AS dot FROM x""",
    "detail_export": f"""WITH {_E}, {_F} SELECT 'function' AS part, function_id AS key, '{{"id":"' || function_id || '","name":"' || name || '","file":"' || file_path || '","start_line":' || start_line || ',"end_line":' || end_line
        || ',"is_static":' || is_static || coalesce(',"module":"' || module || '"', '') || '}}' AS json FROM f
        UNION ALL SELECT 'edge', caller || ' ' || callee, '{{"caller":"' || caller || '","callee":"' || callee || '","kind":"' || kind || '"' || coalesce(',"line":' || line, '') || coalesce(',"via":"' || via || '"', '') || '}}' FROM x""",
    "encoded_nodes": """WITH n AS (SELECT DISTINCT function_id AS node, 0 AS l FROM source_functions UNION SELECT callee, 1 FROM call_edges WHERE callee = 'UNRESOLVED_FUNCTION_POINTER')
        SELECT node, row_number() OVER (ORDER BY l, node) - 1 AS id FROM n""",
    "exclude_callees": f"""WITH {_E} SELECT caller, callee FROM x WHERE callee NOT IN (SELECT function_id FROM source_functions WHERE name GLOB 'bus_*' OR name GLOB '*_core')""",
    "unique_suffix_ids": """WITH p AS (SELECT DISTINCT path, string_split(path, '/') AS s FROM source_files WHERE path IS NOT NULL),
        x AS (SELECT path, n, array_to_string(s[-n:], '/') AS suffix FROM p, unnest(range(1, len(s) + 1)) t(n)), u AS (SELECT suffix FROM x GROUP BY 1 HAVING count(*) = 1)
        SELECT p.path, coalesce(arg_min(x.suffix, x.n) FILTER (x.suffix IN (SELECT suffix FROM u)), p.path) AS suffix FROM p JOIN x USING (path) GROUP BY p.path""",
    "split_ids": "SELECT DISTINCT function_id, regexp_extract(function_id, '^([^.]*\\.[^:]*)::(.*)$', 1) AS suffix, regexp_extract(function_id, '^([^.]*\\.[^:]*)::(.*)$', 2) AS name FROM source_functions",
    "path_modules": r"""WITH p AS (SELECT DISTINCT path FROM source_files WHERE path IS NOT NULL),
        m AS (SELECT path, coalesce(nullif(regexp_extract(path, '^src/[^/]+/pipelines/([^/]+)/', 1), ''), nullif(regexp_extract(path, '^src/[^/]+/([^/]+)/', 1), ''),
              nullif(regexp_extract(path, '^src/([^/]+)/[^/]+$', 1), ''), nullif(regexp_extract(path, '^libs/([^/]+)/', 1), ''), CASE WHEN contains(path, '/') THEN split_part(path, '/', -2) END) AS by_path FROM p)
        SELECT path, by_path, coalesce(CASE WHEN contains(lower(split_part(path, '/', -1)), 'config') THEN 'Config' END, by_path, '(unknown)') AS module FROM m""",
    "accepted_paths": r"""SELECT DISTINCT path FROM source_files WHERE regexp_matches(lower(path), '\.(c|cc|cpp|cxx|h|hh|hpp|hxx)$') AND NOT contains(lower(path), '/impl/') AND NOT contains(lower(path), '/drv/')""",
    "log_to_function": f"WITH {_RES} SELECT seq, function_id FROM res",
    "log_lanes": f"WITH {_RES}, {_LANE} SELECT seq, lane FROM lan",
    "caller_links": f"WITH {_LINK} SELECT * FROM links",
    "sequence_build": f"""WITH RECURSIVE {_LINK}, {_LANE},
        kk AS (SELECT res.*, links.caller_seq, links.arrow_kind, links.hops, coalesce(function_id, CASE WHEN function_name <> '' THEN '?' || coalesce(file_name, '') || '::' || function_name END) AS key
              FROM res LEFT JOIN links ON res.log_id = links.log_id AND res.seq = links.seq),
        pr AS (SELECT *, lag(seq) OVER w AS ps, lag(ts_ms) OVER w AS pt FROM kk WHERE key IS NOT NULL WINDOW w AS (PARTITION BY log_id, key ORDER BY seq)),
        fo AS (SELECT *, caller_seq IS NULL AND ps IS NOT NULL AND coalesce(ts_ms - pt BETWEEN 0 AND 1000, true) AS follows FROM pr),
        rp AS (SELECT *, last_value(CASE WHEN NOT follows THEN seq END IGNORE NULLS) OVER (PARTITION BY log_id, key ORDER BY seq) AS rep FROM fo),
        t AS (SELECT a.*, b.caller_seq AS parent_seq FROM rp a JOIN rp b ON a.rep = b.seq),
        u AS (SELECT seq, parent_seq FROM t WHERE seq = rep), up AS (SELECT u.seq, p.rep AS par FROM u LEFT JOIN t p ON u.parent_seq = p.seq),
        dep AS (SELECT seq, 0 AS depth FROM up WHERE par IS NULL UNION ALL SELECT up.seq, dep.depth + 1 FROM up JOIN dep ON up.par = dep.seq)
        SELECT lan.seq, lan.lane, res.function_id, t.parent_seq, t.arrow_kind, coalesce(dep.depth, 0) AS depth, coalesce(t.hops, 0) AS hops
        FROM lan JOIN res USING (seq) LEFT JOIN t ON t.seq = lan.seq LEFT JOIN dep ON dep.seq = t.rep""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
