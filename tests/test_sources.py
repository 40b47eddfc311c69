"""Dumps, folders, settings, paths."""

import pytest
from pyspark.sql import functions as F

from loomtrace import config
from loomtrace.functions import paths as p
from loomtrace.sources import files
from loomtrace.sources.text import lines_of

DUMP = """noise
===== FILE BEGIN =====
Path: Input\\src\\foo\\bar.c
===== CONTENT BEGIN =====
int a;
===== CONTENT END =====
===== CONTENT BEGIN =====
Path: not a path
int b;
===== CONTENT END =====
===== FILE END =====
===== FILE BEGIN =====
Path: ./src/test/t.c
===== CONTENT BEGIN =====
===== CONTENT END =====
===== FILE END =====
===== FILE BEGIN =====
Path: last.c
===== CONTENT BEGIN =====
open end""".split("\n")


def test_dump(spark):
    got = {r["path"]: r["content"] for r in files.from_dump(lines_of(spark, DUMP)).collect()}
    assert got == {"src/foo/bar.c": "int a;\n===== CONTENT END =====\n===== CONTENT BEGIN =====\nPath: not a path\nint b;\n", "src/test/t.c": "", "last.c": "open end\n"}
    assert [r["path"] for r in files.from_dump(lines_of(spark, DUMP), only=["last.c"]).collect()] == ["last.c"]
    assert {r["path"] for r in files.from_dump(lines_of(spark, DUMP), filtered=True).collect()} == {"src/foo/bar.c", "last.c"}
    assert files.from_dump(lines_of(spark, DUMP).where("false")).count() == 0 and files.empty(spark).count() == 0


def test_folder(spark, tmp_path):
    for name, data in {
        "src/app/main.c": b"\xef\xbb\xbfint a;\r\n", "src/app/sjis.c": "// 終了\r".encode("cp932"), "src/app/latin.c": b"// \xfc\xff\xe9", ".git/x.c": b"int g;", "src/test/t.c": b"int t;", "build/b.c": b"", "readme.md": b"x",
    }.items():
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(data)
    got = {r["path"]: r["content"] for r in files.from_folder(spark, str(tmp_path)).collect()}
    assert got == {"src/app/main.c": "int a;\n", "src/app/sjis.c": "// 終了\n", "src/app/latin.c": "// üÿé"}


def test_places(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.c").write_text("int a;\n")
    dump = [files.FILE_BEGIN, "Path: Input\\src\\b.c", files.CONTENT_BEGIN, "int b;", files.CONTENT_END, files.FILE_END, files.FILE_BEGIN, "Path: Input\\src\\c.c", files.CONTENT_BEGIN, files.CONTENT_END, files.FILE_END]
    (tmp_path / "all.txt").write_text("\n".join(dump))
    read = lambda place: {r["path"]: r["content"] for r in files.source_files(spark, place).collect()}
    assert read(None) == {} and read(str(tmp_path / "src")) == {"a.c": "int a;\n"} and read(str(tmp_path / "all.txt")) == {"src/b.c": "int b;\n", "src/c.c": ""}


def test_incremental(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], files.FILES)
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("d", "4"), (None, "5")], files.FILES)
    todo, gone = files.incremental(new, files.signatures(old))
    assert sorted(r["path"] for r in todo.collect()) == ["b", "d"] and [r["path"] for r in gone.collect()] == ["c"]
    one, two = files.fingerprint(old).first()[0], files.fingerprint(new).first()[0]
    assert len(one) == 24 and one != two and files.fingerprint(old.orderBy(F.desc("path"))).first()[0] == one


def test_paths(spark):
    d = spark.createDataFrame([("src/a/config.c",), ("src/b/config.c",), ("src/x/main.c",), (None,), ("main.h",)], "path string")
    assert {r["path"]: r["suffix"] for r in p.unique_suffixes(d).collect()} == {"src/a/config.c": "a/config.c", "src/b/config.c": "b/config.c", "src/x/main.c": "main.c", "main.h": "main.h"}
    one = spark.range(1)
    val = lambda c: one.select(c).first()[0]
    assert val(p.split_id(F.lit("a/config.c::Klass::method"))).asDict() == {"suffix": "a/config.c", "name": "Klass::method"}
    assert val(p.normalized(F.lit("input\\src\\a.c"), ("Input/",))) == "src/a.c" and val(p.normalized(F.lit("././/x.c"))) == "x.c"
    assert val(p.common_prefix(F.lit("a/b/c.c"), F.lit("a/b/d.c"))) == 2 and val(p.common_prefix(F.lit("a"), F.lit("a"))) == 1 and val(p.common_prefix(F.lit("a/b"), F.lit("c/b"))) == 0
    r = p.ModuleRules(aliases=(("^conv", "Conv"),), file_rules=(("*_log.c", "Log"),))
    assert [val(r.from_log(F.lit(x))) for x in ("PCL:x", "conv.y", ":x", "", " M ")] == ["PCL", "Conv", ":x", None, "M"]
    assert val(r.for_path(F.lit("src/q/ut_log.c"))) == "Log" and val(r.for_path(F.lit("src/q/w/x.c"))) == "w" and val(r.for_path(F.lit("x.c"))) == "(unknown)"
    assert p.glob("a[!b]?.c") == "(?s)^a[^b].\\.c$"


def test_settings(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('[sequence]\nsync_window_ms = 5\n[modules]\nprefix_separators = "-"\n[[async_apis]]\nname = "go"\nkind = "thread"\n')
    s = config.load(str(f))
    assert s.windows == (5, 10_000, 10_000) and s.rules.separators == ("-",) and [a.name for a in s.apis] == ["go"] and s.max_hops == 3
    assert len(config.load().apis) == 12
    with pytest.raises(ValueError):
        config.settings({"async_apis": [{"name": "x", "kind": "odd"}]})


def test_cache(spark, tmp_path):
    from loomtrace.sources.cache import cached_facts

    one = spark.createDataFrame([("a.c", "int f(void) { g(); }"), ("b.c", "int g(void) { f(); }"), ("c.c", "int h;")], files.FILES)
    x, done = cached_facts(one, str(tmp_path / "state"))
    assert sorted(r["path"] for r in done.collect()) == ["a.c", "b.c", "c.c"] and x["functions"].count() == 2
    x, done = cached_facts(one, str(tmp_path / "state"))
    assert done.count() == 0 and x["functions"].count() == 2 and x["calls"].count() == 2
    two = spark.createDataFrame([("a.c", "int f2(void) { }"), ("c.c", "int h;")], files.FILES)
    x, done = cached_facts(two, str(tmp_path / "state"))
    assert [r["path"] for r in done.collect()] == ["a.c"] and [r["name"] for r in x["functions"].collect()] == ["f2"] and x["calls"].count() == 0
    _, done = cached_facts(two, str(tmp_path / "state"), apis=())
    assert done.count() == 2


def test_merged_units(spark):
    from loomtrace.operators.extract import facts, merge_units

    body = "int f(void) { g(); }\nint k = 1; static T t = { .cb = f };\n"
    x = [facts(spark.createDataFrame([("h.h", t)], files.FILES)) for t in (body, body + "int z(void) { f(); }")]
    both = {n: x[0][n].withColumn("unit", F.lit(0)).unionByName(x[1][n].withColumn("unit", F.lit(1))) for n in x[0]}
    m = merge_units(both)
    assert [(r["name"], r["fi"]) for r in m["functions"].orderBy("fi").collect()] == [("f", 0), ("z", 1)]
    assert sorted((r["fi"], r["name"]) for r in m["calls"].collect()) == [(0, "g"), (1, "f")]
    assert m["refs"].where("fi is null and field_name = 'cb'").count() == 2


def test_clock_input(spark):
    from loomtrace.operators.query import clock, clock_input

    rows = ["2026-10-07 1:02", "1:02:03.5", "1:02:03", "25:00", "x", "", None, "1:02.5", "2026-13-01 1:00"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    base = 1791331200000  # 2026-10-07 00:00
    got = {r["i"]: r["m"] for r in d.select("i", clock_input(F.col("t"), F.lit("2026-10-07"), F.lit(base)).alias("m")).collect()}
    assert got == {0: 3720000, 1: 3723500, 2: 3723000, 3: None, 4: None, 5: None, 6: None, 7: None, 8: None}
    assert spark.range(1).select(clock(F.lit(-3723500).cast("long"))).first()[0] == "-1:02:03.500"
