"""Lines of other programs: the parser on single lines, entries on small logs, the grammar's helper."""

import pytest
from pyspark.sql import functions as F

from loomtrace.functions.earley import Grammar, parse
from loomtrace.operators.loglines import LineParser, entries, entry_time, unparsed_spans

SCHEMA = "seq long, log_id string, kind string, message string, raw string"


@pytest.mark.parametrize(
    "line,role,level,component,message",
    [
        ("<30>1 2026-02-03T03:04:34.998Z unit-02 geoindex 7870 - - all is well", "entry", "INFO", "geoindex", "all is well"),
        ("<135>Apr 14 00:13:25 unit-18 netprobe[3240]: the event", "entry", "DEBUG", "netprobe", "the event"),
        ("<3>[37909.739595] netprobe: late", "entry", "ERROR", "netprobe", "late"),
        ("[ 3908.616843] chargectl: the console task", "entry", None, "chargectl", "the console task"),
        ("04-10 11:58:54.305  1774  1804 V ledgerd: watch", "entry", "TRACE", "ledgerd", "watch"),
        ("W/camsvc(  986): stage", "entry", "WARN", "camsvc", "stage"),
        ("2026-02-25 14:44:24,900 - kbridge.retry - WARNING - sends", "entry", "WARN", "kbridge.retry", "sends"),
        ("2026-04-27 15:33:49,066 INFO  [io-8] blobsync.io - trace", "entry", "INFO", "blobsync.io", "trace"),
        ("1779340653.060 fwupdaterd.retry INFO counts", "entry", "INFO", "fwupdaterd.retry", "counts"),
        ("2026-02-20T20:24:42+09:00 [netprobe] (F) buffer", "entry", "FATAL", "netprobe", "buffer"),
        ('"2026-02-05 13:48:05.864","tokenstore.cache","INFO","the ""x"" message"', "cont", None, None, None),
        ('"2026-02-05 13:48:05.864","tokenstore.cache","INFO","the message"', "entry", "INFO", "tokenstore.cache", "the message"),
        ("2026/05/16 04:57:45|CRIT|blobsync.io|stage", "entry", "FATAL", "blobsync.io", "stage"),
        ("24.04.2026 10:52:01;netprobe.wire;Debug;x", "entry", "DEBUG", "netprobe.wire", "x"),
        ('<entry at="2026-01-27T11:24:53" src="blobsync.retry" level="warning">', "entry", "WARN", "blobsync.retry", None),
        ('ts=2026-01-19T16:48:15Z level=info comp=cache msg="the retry" n=3', "entry", "INFO", "cache", "the retry"),
        ('msg="x y" comp=core level=warn ts=1768841295.547', "entry", "WARN", "core", "x y"),
        ('{"message":"a, b","lvl":30,"ts":"2026-01-17T23:37:48.127+09:00","name":"kbridge.index"}', "entry", "INFO", "kbridge.index", "a, b"),
        ("WARNING:kbridge.index:la tarea", "entry", "WARN", "kbridge.index", "la tarea"),
        ("2026-01-12 02:19:11 *error* the message", "entry", "ERROR", None, "the message"),
        ("2026-01-11 00:35:10 the checksum", "entry", None, None, "the checksum"),
        ("Feb 20, 2026 9:56:03 PM blobsync.auth", "head", None, "blobsync.auth", None),
        ("WARNING: the checksum", "level", "WARN", None, "the checksum"),
        ("[2026-02-10 06:49:43.185] I/ledgerd( 6367): the sensor", "entry", "INFO", "ledgerd", "the sensor"),
        ("    at kbridge.reserve(buffer.c:60)", "cont", None, None, None),
        ("ValueError: bad buffer", "cont", None, None, None),
        ("\tprobe = last seen 2026-01-08 04:00:00", "cont", None, None, None),
        ("", "cont", None, None, None),
    ],
)
def test_lines(line, role, level, component, message):
    got = LineParser()(line)
    assert (got[0], got[2], got[3], got[4]) == (role, level, component, message)


def test_shapes_are_remembered():
    p = LineParser()
    assert p("W/a(  986): x")[3] == "a" and p("E/bcd( 1234): other words here that are longer")[3] == "bcd"
    assert p("I/a(  1): x") == p("I/a(  1): x")


def logs(spark, lines, log="l", first=0):
    return spark.createDataFrame([(first + i, log, "RAW", x.strip() if x else x, x) for i, x in enumerate(lines)], SCHEMA)


def test_entries(spark):
    lines = [
        "--- boot ---", "{", '  "lvl": "WARN",', '  "pid": 3,', '  "name": "a.b",', '  "msg": "m"', "}", "extra", "Feb 20, 2026 9:56:03 PM c.d", "ERR: text", "ERR: not its level",
        "W/e( 1): x", None, "INFO: tail",
    ]
    want = [(1, 7, "WARN", "a.b"), (8, 10, "ERROR", "c.d"), (11, 13, "WARN", "e")]
    d = logs(spark, lines)
    for block in (1 << 16, 3):
        got = [(r["first_seq"], r["last_seq"], r["level"], r["component"]) for r in entries(d.unionByName(d), block=block).orderBy("first_seq").collect()]
        assert got == want


def test_other_rows_and_empty(spark):
    d = spark.createDataFrame([(1, None, "RAW", "I/a( 1): x", None), (2, None, "STRUCTURED", "I/b( 1): x", "I/b( 1): x"), (None, "l", "RAW", "I/c( 1): x", None), (3, "l", None, "x", "x")], SCHEMA)
    assert [(r["first_seq"], r["component"]) for r in entries(d.withColumn("role", d.raw).withColumn("begin", d.seq)).collect()] == [(1, "a")]
    assert entries(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "I/a( 1): " + "word " * 200_000
    assert entries(logs(spark, [long])).first()["message"].startswith("word word")


def test_very_long_lines():
    p = LineParser()
    for tail in ("0a 1b 2c 3d " * 10_000, "!? -.:;/ " * 10_000, "word " * 50_000):
        got = p("2026-02-25 14:44:24,900 - kbridge.retry - WARNING - " + tail)
        assert got[:4] == ("entry", "2026-02-25 14:44:24,900", "WARN", "kbridge.retry") and len(got[4]) > 80_000
        assert p(tail)[0] == "cont"
    got = p('{"msg":"' + "a.b-c, 5 " * 20_000 + '","lvl":"error","name":"x.y"}')
    assert got[2:4] == ("ERROR", "x.y") and len(got[4]) == 180_000


@pytest.mark.parametrize("size", [3, 5_000])
def test_fields_behind_long_messages(size):
    """A long line is parsed as the short one of the same layout is."""
    p = LineParser()
    msg = "a.b-c, 5: x=y " * size
    for line, want in {
        f'ts=2026-02-20T20:24:42Z msg="{msg}" level=error logger=net.pool': ("entry", "2026-02-20T20:24:42Z", "ERROR", "net.pool"),
        f'level=warn logger=net.pool-2 msg="{msg}" user=bob retry=3 host=a': ("entry", None, "WARN", "net.pool-2"),
        f'{{"msg":"{msg}","lvl":"error","name":"net.pool.sock","time":"2026-02-20T20:24:42.5Z"}}': ("entry", "2026-02-20T20:24:42.5Z", "ERROR", "net.pool.sock"),
        f'{{"msg":"say \\"{msg}\\" {msg}","lvl":"error","name":"net.pool.sock"}}': ("entry", None, "ERROR", "net.pool.sock"),
        f'"2026-02-20 20:24:42","net.pool","ERROR","{msg}"': ("entry", "2026-02-20 20:24:42", "ERROR", "net.pool"),
        f'<event level="error" logger="net.pool">{msg}</event>': ("entry", None, "ERROR", "net.pool"),
    }.items():
        assert p(line)[:4] == want, line[:60]
    got = p('{"msg":"' + "a.b-c, 5 " * size + '","lvl":"error","name":"x.y"}')
    assert got[2:4] == ("ERROR", "x.y")


def test_unparsed_spans(spark):
    d = logs(spark, ["boot", 'ts=2026-02-20T20:24:42Z level=info a=b comp=c n=3 msg="x y"', "\tat f(a.c:1)", '{"lvl":30,"pid":7,"msg":"m","name":"c.d"}'])
    assert [(r["first_seq"], r["unparsed"], r["unparsed_spans"]) for r in entries(d).orderBy("first_seq").collect()] == [(1, ["a=b", "n=3"], 3), (3, ['"pid":7'], 1)]
    got = [tuple(r) for r in unparsed_spans(d.unionByName(d)).orderBy("seq", "place").collect()]
    assert got == [("l", None, 0, 0, "boot"), ("l", 1, 1, 0, "a=b"), ("l", 1, 1, 1, "n=3"), ("l", 1, 2, 0, "\tat f(a.c:1)"), ("l", 3, 3, 0, '"pid":7')]


def test_times(spark):
    d = logs(spark, ["24.04.2026 10:52:01;n;Debug;x", "1779340653.060 f INFO c", "W/e( 1): x", "2026-02-20T20:24:42+09:00 [n] (F) b"])
    got = [str(r["entry_ts"]) for r in entries(d).orderBy("first_seq").collect()]
    assert got == ["2026-04-24 10:52:01", "2026-05-21 05:17:33.060000", "None", "2026-02-20 11:24:42"]
    texts = {
        "2026-02-20T20:24:42.678Z": "2026-02-20 20:24:42.678000", "2026-02-20 20:24:42,123456789": "2026-02-20 20:24:42.123456", "2026-02-20T20:24:42.5-0330": "2026-02-20 23:54:42.500000",
        "20/02/2026 20:24:42": "2026-02-20 20:24:42", "2026/02/20 20:24:42.25": "2026-02-20 20:24:42.250000", "1779340653060": "2026-05-21 05:17:33.060000", "Feb 20, 2026 9:56:03 PM": "2026-02-20 21:56:03",
        "Feb 20 09:56:03": "None", "2026-13-20 20:24:42": "None", "3908.616843": "None",
    }
    d = spark.createDataFrame(list(texts.items()), "t string, want string").select("t", F.nullif("want", F.lit("None")).cast("timestamp_ntz").alias("want"), entry_time(F.col("t")).alias("got"))
    assert d.where(~F.col("want").eqNullSafe(F.col("got"))).collect() == []


def test_weights_decide():
    g = Grammar("S 0 : A | B\nA 1 : x y\nB 2 : Many\nMany 0 : ANY | Many ANY", "S")
    t = [frozenset({"x", "ANY"}), frozenset({"y", "ANY"})]
    assert parse(g, t, frozenset("AB"))[0] == 2 and parse(g, t, frozenset("AB"))[1] == [("B", 0, 2)]
    assert parse(g, [frozenset({"z"})], frozenset("A")) is None
