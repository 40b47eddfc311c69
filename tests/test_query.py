"""Queries over records: nulls, ties, repeated rows, empty tables; ordered look-back; ids; exports."""

import random

import pytest
from pyspark.sql import functions as F

from loomtrace.operators import graph as g
from loomtrace.operators import payload as pl
from loomtrace.operators import query as q
from loomtrace.operators.link import lanes, resolve_functions, sibling_counts
from loomtrace.operators.ordered import last_known, running

EVENT = (
    "seq long, log_id string, line_no long, ts timestamp_ntz, ts_ms long, thread_id string, tick decimal(20,0), level string, module_name string, function_name string, message string, "
    "file_name string, line_number long, kind string, raw string, lane string, function_id string, parent_seq long, arrow_kind string, depth int, hops int"
)


def event(seq, **kw):
    base = dict.fromkeys(x.split()[0] for x in EVENT.split(", "))
    base.update(seq=seq, log_id="l", line_no=seq, level="INFO", kind="STRUCTURED", message="m", lane="A", depth=0, hops=0)
    base.update(kw)
    return tuple(base.values())


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        event(0, ts_ms=1000, function_name="f", function_id="a.c::f", file_name="A.c", line_number=3, lane="Bus", thread_id="t1"),
        event(1, ts_ms=None, function_name="g", function_id="a.c::g", lane="bus", parent_seq=0, message="Drained 5"),
        event(2, ts_ms=900, function_id="a.c::g", lane="bus", parent_seq=1, level="ERROR", kind="RAW", raw="x drained"),
        event(3, log_id=None, message=None, lane=None, level=None, kind=None, parent_seq=99),
        event(4, ts_ms=4000, lane="Bus", thread_id="t1", parent_seq=5),
        event(5, lane="Bus", parent_seq=4),
        event(20, ts_ms=5000, message="y" * 90, kind="TRACE", raw="r" * 90),
    ]
    return spark.createDataFrame(rows + rows[:2], EVENT)


def ids(df, c="seq"):
    return sorted(r[c] for r in df.collect())


def test_filters(events):
    e = q.once(events)
    assert ids(e) == [0, 1, 2, 3, 4, 5, 20]
    assert ids(q.masked(e, lanes=("Bus",))) == [0, 4, 5]
    assert ids(q.masked(e, threads=("t1",))) == [0, 4] and 3 in ids(q.masked(e, threads=("(none)",)))
    assert ids(q.masked(e, function="A.C::G")) == [1, 2] and ids(q.masked(e, levels=())) == []
    assert ids(q.head(e, 2)) == [0, 1]


def test_search(events):
    e = q.once(events)
    assert ids(q.search(e, "DRAINED")) == [1, 2] and ids(q.search(e, "drained", "msg")) == [1] and ids(q.search(e, "a.c:3")) == [0]
    nxt = {r["seq"]: r["next_seq"] for r in q.next_hits(e, "drained", F.lit(True)).collect()}
    assert nxt == {0: 1, 1: 2, 2: 1, 3: 1, 4: 1, 5: 1, 20: 1}
    assert [tuple(r) for r in q.next_hits(e, "nothing", F.col("seq") == 0).collect()] == [(0, None, None, 0, 0)]
    assert {r["seq"]: (r["previous_seq"], r["place"], r["hits"]) for r in q.next_hits(e, "drained", F.lit(True)).collect()} == {0: (2, 0, 2), 1: (2, 1, 2), 2: (1, 2, 2), 3: (2, 2, 2), 4: (2, 2, 2), 5: (2, 2, 2), 20: (2, 2, 2)}


def test_full_text(events):
    got = {r["seq"]: r["t"] for r in q.once(events).select("seq", q.full_text().alias("t")).collect()}
    assert got[0] == "[1970-01-01 00:00:01.000] INFO m (A.c:3 f)" and got[1] == "[] INFO Drained 5" and got[2] == "[1970-01-01 00:00:00.900] x drained" and got[3] == "[] UNKNOWN "


def test_collapse_and_children(events):
    e = q.once(events)
    assert ids(q.hidden(e, F.col("seq") == 0)) == [1, 2]
    assert ids(q.hidden(e, F.col("seq") == 4)) == []
    assert {r["seq"]: r["children"] for r in sibling_counts(events).collect()} == {0: 1, 1: 1, 2: 0, 3: 0, 4: 1, 5: 1, 20: 0}


def test_aggregates(events):
    e = q.once(events)
    f = {(r["facet"], r["value"]): r["n"] for r in q.facets(e).collect()}
    assert f[("lane", "(none)")] == 1 and f[("thread_id", "t1")] == 2 and f[("lane", "bus")] == 2
    assert {r["lane"]: r["merged"] for r in q.merged_lanes(e).collect()} == {"Bus": "Bus", "bus": "Bus", "A": "A"}
    assert q.most_logged(e).collect()[0].asDict() == {"function_id": "a.c::g", "records": 2}
    s = {r["log_id"]: r for r in q.log_spans(e).collect()}
    assert (s["l"]["base_ms"], s["l"]["last_ms"], s["l"]["has_thread"]) == (1000, 5000, True) and s[None]["base_ms"] is None
    assert [(r["value"], r["id"]) for r in q.interned(e, "lane").orderBy("id").collect()] == [("Bus", 0), ("bus", 1), ("A", 2)]
    rel = {r["seq"]: r["rel_ms"] for r in q.relative_ms(e).collect()}
    assert rel[2] == -100 and rel[1] is None and rel[3] is None
    t = {r["seq"]: (r["m"], r["k"]) for r in e.select("seq", q.truncated(F.col("message"), 10).alias("m"), q.kept_raw(5).alias("k")).collect()}
    assert t[20] == ("y" * 10 + " …(truncated)", "rrrrr") and t[0] == ("m", None) and t[3][0] is None


def test_empty(spark, events):
    none = events.where("false")
    assert q.facets(none).count() == 0 and q.most_logged(none).count() == 0 and q.interned(none, "lane").count() == 0 and q.visible_rank(none).count() == 0
    assert q.hidden(none, F.lit(True)).count() == 0 and q.next_hits(none, "x", F.lit(True)).count() == 0 and q.merged_lanes(none).count() == 0


FUNCTIONS = "function_id string, name string, file_path string, start_line int, end_line int, is_static boolean, module string, ord long"
EDGES = "caller string, callee string, kind string, line int, via string, ord long"


@pytest.fixture(scope="module")
def tables(spark):
    f = spark.createDataFrame(
        [("a.c::f", "f", "src/x/a.c", 1, 9, False, "x", 0), ("a.c::g", "g", "src/x/a.c", 11, 20, False, "x", 1), ("b.c::g", "g", "src/y/b.c", 1, 5, True, None, 2), ("k.cpp::K::m", "K::m", "src/k.cpp", 1, 5, False, "k", 3), ("a.c::f", "f", "again", 0, 0, True, "z", 9), (None, "n", "n", 0, 0, True, "z", 10)],
        FUNCTIONS,
    )
    e = spark.createDataFrame(
        [("a.c::f", "a.c::g", "SYNC", 3, None, 0), ("a.c::f", "a.c::g", "ASYNC", 4, "q", 1), ("a.c::f", "a.c::g", "ASYNC", 5, "r", 2), ("a.c::f", "a.c::g", "SYNC", 3, None, 0), ("a.c::g", g.UNRESOLVED, "SYNC", None, "pointer:p", 3), (None, "a.c::g", "SYNC", 1, None, 4), ("a.c::g", None, "SYNC", 1, None, 5), ("a.c::g", "a.c::g", "SYNC", 1, None, 6)],
        EDGES,
    )
    return f, e


def test_edges_and_functions(tables):
    f, e = tables
    s = {(r["caller"], r["callee"]): (r["kind"], r["line"], r["via"], r["ord"]) for r in g.strongest_edges(e.withColumn("b", F.lit(1))).collect()}
    assert s[("a.c::f", "a.c::g")] == ("ASYNC", 4, "q", 0) and len(s) == 3
    assert {r["function_id"]: r["file_path"] for r in g.first_functions(f).collect()}["a.c::f"] == "src/x/a.c"
    d = {r["function_id"]: (r["out_degree"], r["in_degree"]) for r in g.degrees(f, e).collect()}
    assert d["a.c::f"] == (1, 0) and d["a.c::g"] == (2, 2) and d["b.c::g"] == (0, 0)
    assert {(r["callee"], r["caller"]) for r in g.caller_reach(e).collect()} == {("a.c::g", "a.c::f"), (g.UNRESOLVED, "a.c::g"), (g.UNRESOLVED, "a.c::f")}
    assert g.subgraph(e, "a.c::f", 1, "forward").count() == 2 and g.subgraph(e, "a.c::f", 3, "both", max_nodes=1).count() == 0
    with pytest.raises(ValueError):
        g.subgraph(e, "x", 1, "up")
    assert [r["node"] for r in g.encoded_nodes(f, e).orderBy("id").collect()] == ["a.c::f", "a.c::g", "b.c::g", "k.cpp::K::m", g.UNRESOLVED]
    empty = e.where("false")
    assert g.caller_reach(empty).count() == 0 and g.adjacency(empty).count() == 0 and g.strongest_edges(empty).count() == 0


def test_resolution_and_lanes(spark, tables):
    f, _ = tables
    rows = [("A.c", "g", 12), ("A.c", "g", 500), (None, "g", 3), ("zz.c", "g", None), (None, "m", None), ("a.c", "none", 1), ("a.c", "", 1), (None, None, None)]
    e = spark.createDataFrame([(i, "l", "STRUCTURED", "M:x" if i == 3 else None, a, b, c) for i, (a, b, c) in enumerate(rows)], "seq long, log_id string, kind string, module_name string, file_name string, function_name string, line_number long")
    got = {r["seq"]: r["function_id"] for r in resolve_functions(e, f).collect()}
    assert got == {0: "a.c::g", 1: "a.c::g", 2: "b.c::g", 3: "a.c::g", 4: "k.cpp::K::m", 5: None, 6: None, 7: None}
    e2 = spark.createDataFrame([(0, "l", "X: a", None, "RAW"), (1, "l", None, "x", "STRUCTURED"), (2, "m", None, "x", "STRUCTURED"), (3, "l", None, None, "RAW"), (4, "l", ":", None, "TRACE")], "seq long, log_id string, module_name string, function_module string, kind string").withColumn("file_name", F.lit(None).cast("string"))
    assert {r["seq"]: r["lane"] for r in lanes(e2).collect()} == {0: "X", 1: "X", 2: "x", 3: "(other)", 4: ":"}


def test_running_against_a_walk(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice(["a", None]), i, rnd.choice([None, rnd.randrange(50)])) for i in range(300)]
    d = spark.createDataFrame(rows, "k string, o long, v long")
    for width, own in ((1 << 16, True), (11, True), (11, False)):
        out = running(d, ["k"], "o", {"last": ("last", F.col("v")), "top": ("max", F.col("v")), "all": ("sum", F.col("v"))}, include_self=own, width=width)
        got = {r["o"]: (r["last"], r["top"], r["all"]) for r in out.collect()}
        seen = {"a": [], None: []}
        for k, o, v in rows:
            if own:
                seen[k].append(v)
            known = [x for x in seen[k] if x is not None]
            assert got[o] == ((known[-1], max(known), sum(known)) if known else (None, None, None))
            if not own:
                seen[k].append(v)
    assert last_known(d.where("false"), ["k"], "o", F.col("v"), "x").count() == 0


def test_dense_ids(spark):
    d = spark.range(1000).selectExpr("cast((id * 7919) % 1000 AS string) AS v")
    got = [r["v"] for r in g.dense_ids(d, ["v"], "id").orderBy("id").collect()]
    assert got == sorted(got) and len(got) == 1000


def test_payload(spark, events, tables, tmp_path):
    f, e = tables
    t = pl.payload(events, f, e)
    rows = {r["seq"]: r for r in t["events"].collect()}
    assert (rows[0]["lane"], rows[1]["lane"], rows[0]["thread"], rows[1]["thread"], rows[2]["ts"], rows[3]["fid"], rows[1]["fid"]) == (0, 1, 0, -1, -100, -1, 1)
    assert rows[1]["parent"] == 0 and rows[0]["parent"] == -1 and rows[2]["kind"] == 2 and rows[2]["raw"] == "x drained"
    assert t["edges"].count() == 3
    pl.write(t, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "lane")).count() == 3
    assert pl.json_lines(t["nodes"]).first()["value"].startswith("[")


def test_dot_document(spark, tables):
    f, e = tables
    logged = spark.createDataFrame([("a.c::g",), ("a.c::g",), (None,)], "function_id string")
    lines = [r["line"] for r in g.dot_document(f, e, logged).orderBy("part", "module", "node", "ord").collect()]
    assert lines == [
        "digraph callgraph {", '  subgraph "cluster_x" { label="x";', '    "a.c::f" [label="f"];', '    "a.c::g" [label="g", style=filled];', "  }", f'  "{g.UNRESOLVED}";',
        '  "a.c::f" -> "a.c::g" [style=dotted];', f'  "a.c::g" -> "{g.UNRESOLVED}" [style=solid];', '  "a.c::g" -> "a.c::g" [style=solid];', "}",
    ]
    assert g.dot_document(f, e.where("false")).count() == 2
