"""Source facts, the call graph, reach and the linking of records."""

import random

from loomtrace.operators import callgraph, extract, graph
from loomtrace.operators.link import link, sequence_events
from loomtrace.operators.logs import parse
from loomtrace.sources.text import lines_of

C_FILE = """\
// pour(9): a call in a comment
#define MAX_CUPS 4
struct tap_ops valve_table = { .closed = valve_closed, .opened = &valve_opened };
static long grams(long cups)
{
    return cups * 7;
}
#ifdef WITH_MILK
long froth(long ml) { return grams(ml); }
#else
long steam(long ml) { return ml; }
#endif
#if 0
long scrap(void) { melt(); return 0; }
#endif
int brew(struct pot *pot, int (*taste)(long))
{
    puts("steep(2) /* not code */");
    for (long i = 0; i < MAX_CUPS; i++) { grams(i); }
    pot->tap->closed(pot);
    (*pot->lid)();
    taste(grams(3));
    OsTaskCreate(&stirrer, stir_main, NULL);
    OsMsgQSend(pot->orders, pot, 16);
    when_empty(refill_cb);
    return 0;
}
"""
CPP_FILE = """\
namespace kitchen {
struct Timer { class Bell { public: void ring() { strike(); } }; int left() const { return 3; } };
class Oven : public Timer {
    void heat();
public:
    void bake() { heat(); clamp<int>(4); }
};
void Oven::heat() {
    std::thread fan(&Oven::bake, this);
    std::thread lamp{shine};
    std::thread{glow}.detach();
}
}
"""


def files(spark, **texts):
    return spark.createDataFrame([(k, v) for k, v in texts.items()], "path string, content string")


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "path string, content string")


def test_c_facts(spark):
    x = extract.facts(frame(spark, [("bar/brew.c", C_FILE)]))
    fs = {r["name"]: r for r in x["functions"].collect()}
    assert set(fs) == {"grams", "froth", "brew"}  # the first branch counts, a branch of 0 does not
    assert (fs["grams"]["is_static"], fs["brew"]["is_static"]) == (True, False)
    assert [(fs[n]["start_line"], fs[n]["end_line"]) for n in ("grams", "froth", "brew")] == [(4, 7), (9, 9), (16, 27)]
    inside = [(r["name"], r["kind"]) for r in x["calls"].where(f"fi = {fs['brew']['fi']}").collect()]
    assert sorted(inside) == sorted([("puts", "direct"), ("grams", "direct"), ("closed", "field"), ("lid", "field"), ("taste", "pointer"), ("grams", "direct"), ("when_empty", "direct")])
    started = {r["api"]: r.asDict() for r in x["async_calls"].collect()}
    assert set(started) == {"OsTaskCreate", "OsMsgQSend"}
    assert (started["OsTaskCreate"]["target"], started["OsTaskCreate"]["handle"], started["OsMsgQSend"]["key"]) == ("stir_main", "stirrer", "orders")
    refs = {(r["name"], r["field_name"], r["via_call"], r["fi"] is None) for r in x["refs"].collect()}
    assert {("valve_closed", "closed", None, True), ("valve_opened", "opened", None, True), ("refill_cb", None, "when_empty", False)} <= refs


def test_cpp_facts(spark):
    x = extract.facts(frame(spark, [("kitchen/oven.cpp", CPP_FILE)]))
    assert [r["name"] for r in x["functions"].orderBy("fi").collect()] == ["Timer::Bell::ring", "Timer::left", "Oven::bake", "Oven::heat"]
    assert sorted(r["target"] for r in x["async_calls"].collect()) == ["Oven::bake", "glow", "shine"]
    assert {r["name"] for r in x["calls"].where("fi = 2").collect()} == {"heat", "clamp"}


def test_odd_files(spark):
    odd = frame(spark, [("a.c", ""), ("b.c", None), (None, "int f() {}"), ("c.c", "}}} ((( {"), ("d.txt", "int f() {}"), ("e.c", "#if 1\n#else\n"), ("f.c", "﻿int g(void)\r\n{\r\n}\r\n")])
    x = extract.facts(odd)
    assert [(r["path"], r["name"], r["start_line"], r["end_line"]) for r in x["functions"].collect()] == [("f.c", "g", 1, 3)]


FILES = [
    ("app/menu/order.c", "static int check(int n) { return price(n); }\nint order(int n) { check(n); return table(n); }\n"),
    ("app/shop/stock.c", "static int check(int n) { return n; }\nint price(int n) { check(n); note(n); return n; }\nstatic int hidden(int n) { return n; }\n"),
    ("lib/menu/table.c", "int table(int n) { hidden(n); (*slots[n].fn)(n); return n; }\n"),
    ("lib/shop/table.c", "int table(int n) { return n; }\n"),
    ("lib/note.c", "void note(int n) { }\n"),
]


def test_build(spark):
    g = callgraph.build(frame(spark, FILES), exclude=("note",))
    ids = {r["function_id"]: r for r in g.functions.collect()}
    assert set(ids) == {"order.c::check", "order.c::order", "stock.c::check", "stock.c::price", "stock.c::hidden", "menu/table.c::table", "shop/table.c::table", "note.c::note"}
    assert ids["stock.c::price"]["module"] == "shop"
    adj = {r["caller"]: r["callees"] for r in graph.adjacency(g.edges).collect()}
    assert adj == {
        "order.c::check": ["stock.c::price"],  # seen from everywhere
        "order.c::order": ["menu/table.c::table", "order.c::check"],  # as near as the other table, and first; its own check
        "stock.c::price": ["stock.c::check"],  # its own, and nothing that is left out
        "menu/table.c::table": [graph.UNRESOLVED],  # a static function of another file is out of sight
    }
    more = frame(spark, [*FILES, ("lib/gone.c", None)])
    assert callgraph.build_report(more, g).first().asDict() == {"files": 6, "files_without_content": 1, "functions": 8, "edges": 5, "async_edges": 0, "callback_edges": 0, "unresolved_calls": 1}


QUEUE = [
    ("src/bar/counter.c", "void take_order(int id)\n{\n    pass_on(id);\n}"),
    (
        "src/mill/grind.c",
        "void pass_on(int id)\n{\n    weigh(id);\n}\nstatic void weigh(int id)\n{\n    OsMsgQSend(mill.beans, &id, 4, 0, 0);\n}\n"
        "static void mill_main(void *arg)\n{\n    OsMsgQReceive(mill.beans, &id, 4, 0);\n    crush(id);\n}\nstatic void crush(int id) { }",
    ),
    ("src/wash/rinse.c", "static os_task_t hose;\nvoid plug_in(void) { OsTaskCreate(&hose, spray, 0); }\nvoid spray(void) { }\nvoid press(void) { OsEventSend(hose, 1); }\nvoid finish(Ops *o) { o->dried(1); }\nvoid prepare(Ops *o) { o->dried = spray; }"),
]


def test_queues_events_fields(spark):
    e = {(r["caller"], r["callee"]): (r["kind"], r["via"]) for r in callgraph.build(frame(spark, QUEUE)).edges.collect()}
    assert e[("grind.c::weigh", "grind.c::mill_main")] == ("ASYNC", "OsMsgQSend:beans")
    assert e[("rinse.c::plug_in", "rinse.c::spray")] == ("ASYNC", "OsTaskCreate")
    assert e[("rinse.c::press", "rinse.c::spray")] == ("ASYNC", "OsEventSend:hose")
    assert e[("rinse.c::finish", "rinse.c::spray")] == ("CALLBACK", "field:dried")
    assert e[("rinse.c::prepare", "rinse.c::spray")] == ("CALLBACK", "register:field:dried")


def log(ts, module, message, file, line, func):
    return f"[2026-10-07 {ts}] [0] INFO  {module:<23} {message} ({file}:{line} {func})"


def test_links_end_to_end(spark):
    lines = [
        log("09:00:00.100", "Bar", "ordered", "counter.c", 3, "take_order"),
        log("09:00:00.110", "Mill", "passed", "grind.c", 3, "pass_on"),
        log("09:00:00.130", "Mill", "weighed", "grind.c", 7, "weigh"),
        log("09:00:04.900", "Mill", "crushed", "grind.c", 14, "crush"),
        log("09:00:00.090", "Bar", "again, the clock set back", "counter.c", 3, "take_order"),
        log("09:00:09.000", "door", "open", "Door.c", 1, "Door"),
    ]
    g = callgraph.build(frame(spark, QUEUE))
    ev = sequence_events(parse(lines_of(spark, lines)), g.functions, g.edges).orderBy("seq").collect()
    assert [e["lane"] for e in ev] == ["Bar", "Mill", "Mill", "Mill", "Bar", "door"]
    # crush is two links behind weigh, one of them a queue, which leaves it ten seconds
    assert [(e["parent_seq"], e["arrow_kind"], e["depth"], e["hops"]) for e in ev] == [(None, None, 0, 0), (0, "SYNC", 1, 1), (1, "SYNC", 2, 1), (2, "ASYNC", 3, 2), (None, None, 0, 0), (None, None, 0, 0)]
    assert ev[5]["function_id"] is None


def test_several_logs_keep_their_records(spark):
    order, passed, weighed = (log("09:00:00.100", "Bar", "ordered", "counter.c", 3, "take_order"), log("09:00:00.110", "Mill", "passed", "grind.c", 3, "pass_on"), log("09:00:00.130", "Mill", "weighed", "grind.c", 7, "weigh"))
    logs = {"a": [order, passed, "=====", weighed], "b": [passed, weighed]}
    g = callgraph.build(frame(spark, QUEUE))
    both = sequence_events(parse(lines_of(spark, logs["a"], "a").unionByName(lines_of(spark, logs["b"], "b"))), g.functions, g.edges)
    got = {k: [(r["seq"], r["kind"], r["parent_seq"], r["depth"]) for r in both.where(f"log_id = '{k}'").orderBy("seq").collect()] for k in logs}
    assert got == {"a": [(0, "STRUCTURED", None, 0), (1, "STRUCTURED", 0, 1), (2, "RAW", None, 0), (3, "STRUCTURED", 1, 2)], "b": [(0, "STRUCTURED", None, 0), (1, "STRUCTURED", 0, 1)]}


def brute_reach(edges, hops):
    best = {}
    for a, b, k, o in sorted(edges, key=lambda x: x[3]):
        old = best.get((a, b))
        if old is None:
            best[(a, b)] = [k, o]
        elif k > old[0]:
            old[0] = k
    into = {}
    for (a, b), (k, o) in sorted(best.items(), key=lambda x: x[1][1]):
        into.setdefault(b, []).append((a, k))
    out = {}
    for f in {x for e in edges for x in e[:2]}:
        seen, queue = {f}, [(f, 0, 0)]
        while queue:
            n, h, k = queue.pop(0)
            if h < hops:
                for a, kk in into.get(n, ()):
                    if a not in seen:
                        seen.add(a)
                        out[(f, a)] = (h + 1, max(k, kk))
                        queue.append((a, h + 1, max(k, kk)))
    return out


def test_reach_and_links_against_brute_force(spark):
    rnd = random.Random(5)
    names = [f"f{i}" for i in range(12)]
    raw = [(rnd.choice(names), rnd.choice(names), rnd.randrange(3), i) for i in range(40)]
    edges = spark.createDataFrame([(a, b, graph.KINDS[k], 1, None, o) for a, b, k, o in raw], "caller string, callee string, kind string, line int, via string, ord long")
    reach = graph.caller_reach(edges)
    want = brute_reach(raw, 3)
    got = {(r["callee"], r["caller"]): (r["hops"], graph.KINDS.index(r["kind"])) for r in reach.collect()}
    assert got == want
    ev, t = [], 0
    for s in range(400):
        t += rnd.choice([-300, 10, 50, 400, 900])
        ev.append((rnd.choice("ab"), s, None if rnd.random() < 0.1 else t, rnd.choice([*names, None]), "x.c", rnd.choice(["g", "h", None])))
    d = spark.createDataFrame(ev, "log_id string, seq long, ts_ms long, function_id string, file_name string, function_name string")
    win = (1000, 10_000, 10_000)
    recent, want2 = {}, {}
    fits = lambda a, b, w: a is None or b is None or 0 <= b - a <= w
    for lg, s, ts, fid, file, fn in ev:
        key = fid or (f"?{file}::{fn}" if fn else None)
        parent, arrow, depth, hops, best = None, None, 0, 0, None
        for (callee, caller), (h, k) in want.items():
            last = recent.get((lg, caller))
            if fid is not None and callee == fid and last and fits(last[1], ts, win[k]) and (best is None or (last[0], -h) > best[0]):
                best = ((last[0], -h), last, k, h)
        if best:
            parent, arrow, depth, hops = best[1][0], graph.KINDS[best[2]], best[1][2] + 1, best[3]
        elif key and (lg, key) in recent and fits(recent[(lg, key)][1], ts, win[0]):
            depth, parent = recent[(lg, key)][2], recent[(lg, key)][3]
        if key:
            recent[(lg, key)] = (s, ts, depth, parent)
        want2[s] = (parent, arrow, depth, hops)
    for width in (1 << 16, 37):
        got2 = {r["seq"]: (r["parent_seq"], r["arrow_kind"], r["depth"], r["hops"]) for r in link(d, edges, reach=reach, width=width).collect()}
        assert got2 == want2


def test_streamed_links(spark, tmp_path):
    from loomtrace.streaming.link import link_stream

    edges = spark.createDataFrame([("a", "b", "SYNC", 1, None, 0), ("b", "c", "ASYNC", 1, None, 1)], "caller string, callee string, kind string, line int, via string, ord long")
    schema = "log_id string, seq long, ts_ms long, function_id string, file_name string, function_name string"
    rows = [("l", i, i * 100, f, "x.c", f) for i, f in enumerate(["a", "b", "b", "c", None, "a", "c", "c"])]
    batch = spark.createDataFrame(rows, schema)
    reach = graph.caller_reach(edges)
    for k in range(2):
        spark.createDataFrame(rows[k * 4 : k * 4 + 4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = link_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), reach)
    q = stream.writeStream.format("memory").queryName("links").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(tuple(map(str, r)) for r in df.select("seq", "parent_seq", "arrow_kind", "depth", "hops").collect())
    assert key(spark.table("links")) == key(link(batch, edges, reach=reach))
