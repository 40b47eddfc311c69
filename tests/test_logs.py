"""The log grammar and the repair of torn records, against small logs."""

import random

from loomtrace.operators.logs import assemble, number, parse
from loomtrace.sources.text import lines_of, read_lines


def line(ts, level, module, message, place="", tick=0):
    return f"[2026-10-07 {ts}] [{tick}] {level:<5} {module:<23} {message}{place}"


def rows(spark, lines, **kw):
    return [r.asDict() for r in parse(lines_of(spark, lines), **kw).orderBy("seq").collect()]


def test_structured(spark):
    (r,) = rows(spark, [line("14:37:15.343", "INFO", "PCL:handle_submit()", "task1=submit begin", " (ingress_task1.c:348 handle_submit)")])
    assert (r["level"], r["module_name"], r["function_name"], r["line_number"], r["message"]) == ("INFO", "PCL:handle_submit()", "handle_submit", 348, "task1=submit begin")
    assert r["tick"] == 0 and r["thread_id"] is None and r["kind"] == "STRUCTURED" and r["ts_ms"] % 1000 == 343


def test_modules(spark):
    got = rows(
        spark,
        [
            line("14:00:00.000", "INFO", "PCL:API request Start", "x", " (a.c:1 f)"),
            "[2026-10-07 14:00:00.000] [0] INFO  conversionLayer.callback_of_long_name rest of it (a.c:1 f)",
            "[2026-10-07 14:00:00.000] [0] ERROR netif link down",
            "[2026-10-07 14:00:00.000] [18446744073709551615] WARN  M                       m",
        ],
    )
    assert [r["module_name"] for r in got] == ["PCL:API request Start", "conversionLayer.callback_of_long_name", "netif link down", "M"]
    assert got[2]["message"] == "" and got[2]["function_name"] is None
    assert str(got[3]["tick"]) == "18446744073709551615"


def test_interrupted_and_split(spark):
    got = rows(
        spark,
        [
            line("14:00:00.000", "INFO", "PCL", "a", " (runtime.c:22 ingress_submit*****STATE BUSY[BuildState(89)]"),
            "[2026-10-07 14:00:00.001] )",
            line("14:00:00.002", "INFO", "PCL", "b", " (x.c:5 HandleNextQue*****q[Dispatch(51)]"),
            "[2026-10-07 14:00:00.003] uedRequest)",
            line("14:00:00.004", "INFO", "RIM", "*****s[f(58)]"),
            "[2026-10-07 14:00:00.005]  (file.c:58 f)",
        ],
    )
    assert [(r["kind"], r["function_name"], r["line_number"]) for r in got] == [
        ("STRUCTURED", "ingress_submit", 22), ("TRACE", "BuildState", 89), ("STRUCTURED", "HandleNextQueuedRequest", 5), ("TRACE", "Dispatch", 51), ("STRUCTURED", "f", 58),
    ]
    assert got[2]["ts_ms"] % 1000 == 2 and [r["seq"] for r in got] == [0, 1, 2, 3, 4]


def test_trace_raw_blank_and_fill(spark):
    got = rows(spark, ["=====", "*****Dispatch now[Dispatch(51)]", "", "[2026-13-07 14:00:00.000] bad time", "after it", "[2026-10-07T01:02:03,123456789] good"])
    assert [r["kind"] for r in got] == ["RAW", "TRACE", "RAW", "RAW", "RAW"]
    assert [r["ts"] is None for r in got] == [True, True, True, True, False]
    assert got[4]["ts"].microsecond == 123456
    assert rows(spark, []) == []


def test_a_complete_record_takes_nothing(spark):
    got = rows(spark, [line("14:00:00.000", "INFO", "M", "m", " (a.c:1 f)"), " (b.c:2 g)", line("14:00:00.000", "INFO", "M", "open"), "foreign", " (b.c:2 g)"])
    assert [r["kind"] for r in got] == ["STRUCTURED", "RAW", "STRUCTURED", "RAW", "RAW"]


def test_blocks_do_not_matter(spark):
    lines = []
    for i in range(40):
        lines += [line(f"14:00:{i:02d}.000", "INFO", "M", f"m{i}", " (a.c:1 fu"), "nc)", "raw"]
    want = rows(spark, lines)
    assert want == rows(spark, lines, width=7) and len(want) == 80
    assert all(r["function_name"] == "func" for r in want if r["kind"] == "STRUCTURED")


def test_two_logs_are_numbered_apart(spark):
    both = lines_of(spark, ["a", "b"], "x").unionByName(lines_of(spark, ["c"], "y"))
    got = {(r["log_id"], r["seq"], r["body"]) for r in number(assemble(both)).collect()}
    assert got == {("x", 0, "a"), ("x", 1, "b"), ("y", 0, "c")}


def test_read_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\ntwo\rthree\n" + b"x\xff\n" * 5000)
    (tmp_path / "b.log").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    got = read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["line_no"] for r in got] == list(range(1, 5004))
    assert [r["line"] for r in got[:4]] == ["one", "two", "three", "x�"]


def fold(bodies):
    """(first line, kind, text) by one walk over a log's lines (no times, no interrupts), as the format is defined."""
    import re

    place = re.compile(r"\s\([^\s():]+\.[A-Za-z0-9]{1,4}:\d+ [A-Za-z_~][\w:~<>]*\)\s*$")
    torn = re.compile(r"\s\([^\s():]+\.[A-Za-z0-9]{1,4}(?::\d*(?: [\w:~<>]*)?)?$")
    pure = re.compile(r"^\s*\([^\s():]+\.[A-Za-z0-9]{1,4}:\d+ [A-Za-z_~][\w:~<>]*\)\s*$")
    head = re.compile(r"^\[\d+\] (?:INFO|WARN) ?")
    out, at = [], None
    for i, b in enumerate(bodies, 1):
        if at is not None and not place.search(out[at][2]):
            now = out[at]
            if torn.search(now[2]) and b.strip():
                if not head.match(b):
                    out[at] = (now[0], now[1], now[2] + b.strip())
                    continue
            elif pure.match(b):
                out[at] = (now[0], now[1], now[2] + "\n" + b.strip())
                continue
        at = None
        if head.match(b):
            at = len(out)
            out.append((i, "STRUCTURED", b))
        elif b.strip():
            out.append((i, "RAW", b))
    return out


def test_torn_twice(spark):
    got = rows(spark, [line("14:00:00.000", "INFO", "M", "hello", " (a.c"), ":5 fu", "nc)", "raw"])
    assert [(r["kind"], r["file_name"], r["line_number"], r["function_name"]) for r in got] == [("STRUCTURED", "a.c", 5, "func"), ("RAW", None, None, None)]


def test_random_lines_against_a_fold(spark):
    rnd = random.Random(11)
    parts = ["[0] INFO  M                       m", "[1] WARN  M                       x (a.c", "[0] INFO  M                       y (a.c:5 fu", "[0] INFO  M                       z (a.c:5 f)", "(b.c:7 g)", " (b.c:7 g)", ":5 fu", ":", "5 ", "nc)", ".c", "fu", "text of others", "", "  ", "(x.c", ")", "a b.c (y.c:1"]
    logs = {f"l{i}": [rnd.choice(parts) for _ in range(60)] for i in range(20)}
    d = None
    for k, v in logs.items():
        d = lines_of(spark, v, k) if d is None else d.unionByName(lines_of(spark, v, k))
    got: dict = {k: [] for k in logs}
    for r in assemble(d).orderBy("log_id", "line_no").collect():
        got[r["log_id"]].append((r["line_no"], r["kind"], r["body"]))
    for k, v in logs.items():
        assert got[k] == fold(v), v
