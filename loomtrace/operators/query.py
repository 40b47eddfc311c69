"""Queries over sequence events: filters, search, collapsing, facets, naming, spans, text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions.paths import basename
from loomtrace.operators.graph import dense_ids
from loomtrace.operators.hierarchy import roots
from loomtrace.operators.link import numbered
from loomtrace.operators.ordered import last_known, running
from loomtrace.session import cut


def once(events: DataFrame) -> DataFrame:
    """Each record of each log once; rows without seq are left out."""
    return events.where("seq is not null").dropDuplicates(["log_id", "seq"])


def in_time(ts: Column, start: str | None, end: str | None) -> Column:
    """Inclusive range; records without a time always pass."""
    ok = F.lit(True)
    if start is not None:
        ok = ok & (ts >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        ok = ok & (ts <= F.lit(end).cast("timestamp_ntz"))
    return ts.isNull() | ok


def head(events: DataFrame, n: int) -> DataFrame:
    """The first n records by seq: a limit that is the feature."""
    return events.orderBy("seq").limit(n)


def masked(events: DataFrame, lanes=None, levels=None, kinds=None, threads=None, function: str = "", start: str | None = None, end: str | None = None) -> DataFrame:
    """Records that pass every mask given (None passes all; a missing thread is ``(none)``), the range of time, and whose
    function or function id holds a text in any case."""
    c = F.col
    ok = in_time(c("ts"), start, end)
    for column, allowed in ((c("lane"), lanes), (c("level"), levels), (c("kind"), kinds), (F.coalesce("thread_id", F.lit("(none)")), threads)):
        if allowed is not None:
            ok = ok & F.coalesce(column.isin(*allowed), F.lit(False))
    if function:
        low = function.lower()
        ok = ok & (F.lower(F.coalesce("function_name", F.lit(""))).contains(low) | F.lower(F.coalesce("function_id", F.lit(""))).contains(low))
    return events.where(ok)


def haystack(mode: str = "all") -> Column:
    """The text that a search looks through: ``func``, ``msg`` or ``all``, in lower case; missing parts are left out."""
    c = F.col
    place = F.when(c("file_name").isNotNull(), F.concat("file_name", F.lit(":"), F.coalesce(c("line_number").cast("string"), F.lit(""))))
    parts = {"func": (c("function_name"), c("function_id")), "msg": (c("message"),), "all": (c("function_name"), c("message"), c("module_name"), place, c("raw"))}[mode]
    return F.lower(F.concat_ws(" ", *parts))


def search(events: DataFrame, text: str, mode: str = "all") -> DataFrame:
    """Records whose text holds the searched one, in any case."""
    return events.where(haystack(mode).contains(text.lower()))


def next_hits(events: DataFrame, text: str, asked: Column, mode: str = "all") -> DataFrame:
    """``seq, next_seq, previous_seq, place, hits``: for each asked record the next hit behind it (from the front again after
    the last one), the hit before it (from the end again before the first), how many hits there are up to it, and in all;
    null and 0 without hits."""
    c = F.col
    e = events.select("seq", haystack(mode).contains(text.lower()).alias("hit"), asked.alias("asked")).withColumn("_back", -c("seq")).withColumn("_all", F.lit(1))
    e = cut(e.where("hit or asked"))
    hit = F.when(c("hit"), c("seq"))
    found = running(e, ["_all"], "seq", {"earlier": ("last", hit)}, include_self=False)
    found = running(found, ["_all"], "seq", {"place": ("sum", F.when(c("hit"), 1))})
    found = last_known(cut(found), ["_all"], "_back", hit, "later", include_self=False)
    ends = e.where("hit").agg(F.min("seq").alias("first_hit"), F.max("seq").alias("last_hit"), F.count(F.lit(1)).alias("hits"))
    out = found.where("asked").crossJoin(F.broadcast(ends))  # one row
    return out.select("seq", F.coalesce("later", "first_hit").alias("next_seq"), F.coalesce("earlier", "last_hit").alias("previous_seq"), F.coalesce("place", F.lit(0)).cast("long").alias("place"), "hits")


def hidden(events: DataFrame, collapsed: Column) -> DataFrame:
    """``log_id, seq`` of the records below a collapsed one. Records whose parents never end are not hidden.

    Ways up end at collapsed records: what hangs below one has it as the root of the tree so cut.
    """
    c = F.col
    e = cut(numbered(events.withColumn("_shut", F.coalesce(collapsed, F.lit(False)))).select("log_id", "seq", "id", "up", "_shut"))
    endless = roots(e, "id", "up").where("cycle").select(c("node").alias("n"))
    tops = roots(e.withColumn("up", F.when(~c("_shut"), c("up"))), "id", "up").select(c("node").alias("n"), "root")
    shut = tops.join(e.where("_shut").select(c("id").alias("s")), c("root") == c("s"), "left_semi").select("n")
    return e.join(shut, c("up") == c("n"), "left_semi").join(endless, c("id") == c("n"), "left_anti").select("log_id", "seq")


def find_functions(functions: DataFrame, events: DataFrame, text: str, first: int = 400, top: int = 60) -> DataFrame:
    """A finder's list: of the first hits by order, logged functions first, then short ids (a top-k report)."""
    hits = functions.where(F.lower("function_id").contains(text.lower())).orderBy("ord", "function_id").limit(first)
    logged = events.where("function_id is not null").select(F.col("function_id").alias("l")).distinct()
    out = hits.join(logged, F.col("function_id") == F.col("l"), "left").select("function_id", F.col("l").isNotNull().alias("logged"))
    return out.orderBy(F.desc("logged"), F.length("function_id"), "function_id").limit(top)


def facets(events: DataFrame) -> DataFrame:
    """``facet, value, n`` of lanes, levels, kinds and threads, counted in one pass; missing values are ``(none)``."""
    names = ("lane", "level", "kind", "thread_id")
    e = events.select(*(F.coalesce(n, F.lit("(none)")).alias(n) for n in names))
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("facet"), F.col(n).alias("value")) for n in names)))
    # a few distinct combinations first, so that the four-fold rows are few
    combos = e.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    return combos.select(pairs.alias("p"), "n").groupBy("p.facet", "p.value").agg(F.sum("n").alias("n"))


def merged_lanes(events: DataFrame) -> DataFrame:
    """``lane, merged``: lanes that differ only in case under their most frequent spelling (of equals, the first seen)."""
    per = events.where("lane is not null").groupBy("lane").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    best = F.min_by("lane", F.struct(-F.col("n"), F.col("first"))).over(Window.partitionBy(F.lower("lane")))  # spellings of one lane
    return per.select("lane", best.alias("merged"))


def first_logs(events: DataFrame) -> DataFrame:
    """``function_id, first_seq, records``."""
    return events.where("function_id is not null").groupBy("function_id").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("records"))


def most_logged(events: DataFrame) -> DataFrame:
    """One row: the function with most records; of equals the one whose last record came first (it reached the count first)."""
    per = events.where("function_id is not null").groupBy("function_id").agg(F.count(F.lit(1)).alias("records"), F.max("seq").alias("last_seq"))
    best = per.agg(F.max(F.struct("records", (-F.col("last_seq")).alias("l"), "function_id")).alias("b"))
    return best.where("b is not null").select("b.function_id", "b.records")


def log_spans(events: DataFrame) -> DataFrame:
    """Per log: records, first and last known time in order of seq, and whether any record has a thread."""
    known = F.col("ts_ms").isNotNull()
    return events.groupBy("log_id").agg(
        F.count(F.lit(1)).alias("records"), F.min_by("ts_ms", F.when(known, F.col("seq"))).alias("base_ms"), F.max_by("ts_ms", F.when(known, F.col("seq"))).alias("last_ms"),
        F.bool_or(F.col("thread_id").isNotNull()).alias("has_thread"),
    )


def interned(events: DataFrame, column: str) -> DataFrame:
    """``value, id``: dense ids in the order in which values are first seen; null has none."""
    first = events.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min("seq").alias("first_seq"))
    return dense_ids(first, ["first_seq", "value"], "id").select("value", "id")


def truncated(text: Column, most: int = 4000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(" …(truncated)"))).otherwise(text)


def kept_raw(most: int = 4000) -> Column:
    """The raw text where it can't be rebuilt: no STRUCTURED record on one line; cut without a mark."""
    return F.when((F.col("kind") != "STRUCTURED") | F.col("raw").contains("\n"), F.substring("raw", 1, most))


def full_text() -> Column:
    """A record's line with its time, as it stood in the log, rebuilt from its columns where ``raw`` is null or empty: tick,
    module and place are left out where they are missing."""
    c = F.col
    some = lambda x, *parts: F.when(x.isNotNull(), F.concat(*parts)).otherwise(F.lit(""))
    place = some(c("file_name"), F.lit(" ("), c("file_name"), F.lit(":"), F.coalesce(c("line_number").cast("string"), F.lit("-1")), F.lit(" "), F.coalesce("function_name", F.lit("")), F.lit(")"))
    tick = some(c("tick"), F.lit("["), c("tick").cast("string"), F.lit("] "))
    rebuilt = F.concat(tick, F.coalesce("level", F.lit("UNKNOWN")), F.lit(" "), some(c("module_name"), c("module_name"), F.lit(" ")), F.coalesce("message", F.lit("")), place)
    time = F.coalesce(F.date_format(F.timestamp_millis("ts_ms").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(""))
    return F.concat(F.lit("["), time, F.lit("] "), F.when(c("raw") != "", c("raw")).otherwise(rebuilt))


def relative_ms(events: DataFrame) -> DataFrame:
    """``seq, rel_ms``: time since the first known time of the record's log; null without a time."""
    base = log_spans(events).select(F.col("log_id").alias("l"), "base_ms")
    return events.join(base, F.col("log_id").eqNullSafe(F.col("l"))).select("seq", (F.col("ts_ms") - F.col("base_ms")).alias("rel_ms"))


def clock(ms: Column) -> Column:
    """Milliseconds of a day as H:MM:SS.mmm, with a sign where negative."""
    a = F.abs(ms)
    return F.concat(
        F.when(ms < 0, "-").otherwise(""), F.floor(a / 3600000).cast("string"), F.lit(":"), F.lpad((F.floor(a / 60000) % 60).cast("string"), 2, "0"), F.lit(":"),
        F.lpad((F.floor(a / 1000) % 60).cast("string"), 2, "0"), F.lit("."), F.lpad((a % 1000).cast("string"), 3, "0"),
    )


def clock_input(text: Column, base_date: Column, base_ms: Column) -> Column:
    """What a user types as ``[date ]H:MM[:SS[.mmm]]`` as milliseconds since ``base_ms``; the date defaults to ``base_date``
    (a text), and what is no time gives null."""
    form = r"^\s*(?:(\d{4}-\d{2}-\d{2})\s+)?(\d{1,2}:\d{2})(:\d{2})?(\.\d{1,3})?\s*$"
    part = lambda i: F.regexp_extract(text, form, i)
    whole = F.concat_ws(" ", F.coalesce(F.nullif(part(1), F.lit("")), base_date), F.concat(F.lpad(part(2), 5, "0"), F.when(part(3) != "", part(3)).otherwise(F.lit(":00")), part(4)))
    ok = text.rlike(form) & ((part(4) == "") | (part(3) != ""))
    return F.when(ok, F.floor(F.unix_micros(whole.try_cast("timestamp_ntz").cast("timestamp")) / 1000) - base_ms)


def thread_neighbours(events: DataFrame) -> DataFrame:
    """``seq, before_seq``: the record before of the same log and thread, for records with a thread."""
    e = events.where("thread_id is not null").select("log_id", "thread_id", "seq")
    return last_known(e, ["log_id", "thread_id"], "seq", F.col("seq"), "before_seq", include_self=False).select("seq", "before_seq")


def visible_rank(events: DataFrame) -> DataFrame:
    """``seq, pos``: place among the given records, from 0 in order of seq."""
    return dense_ids(events.select("seq"), ["seq"], "pos")


def event_sources(events: DataFrame, functions: DataFrame, files: DataFrame) -> DataFrame:
    """``seq, path``: the file of the record's function, else the first path whose file has the record's file name in any case."""
    c = F.col
    f = functions.where("function_id is not null").groupBy(c("function_id").alias("f")).agg(F.min_by("file_path", "ord").alias("by_function"))
    base = files.where("path is not null").groupBy(F.lower(basename(c("path"))).alias("b")).agg(F.min("path").alias("by_name"))
    e = events.select("seq", "function_id", F.lower(basename(c("file_name"))).alias("base"))
    out = e.join(f, c("function_id") == c("f"), "left").join(base, c("base") == c("b"), "left")
    return out.select("seq", F.coalesce("by_function", "by_name").alias("path"))


def selected_sources(events: DataFrame, functions: DataFrame, files: DataFrame) -> DataFrame:
    """``path`` of the files that records come from: by function or by file name."""
    c = F.col
    ids = events.where("function_id is not null").select(c("function_id").alias("f")).distinct()
    a = functions.join(ids, c("function_id") == c("f"), "left_semi").select(c("file_path").alias("path"))
    names = events.where("file_name is not null").select(F.lower(basename(c("file_name"))).alias("n")).distinct()
    b = files.where("path is not null").join(names, F.lower(basename(c("path"))) == c("n"), "left_semi").select("path")
    return a.unionByName(b).where("path is not null").distinct()


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """``path, state``: files that are new, changed (by the SHA-1 of their content) or deleted against an earlier state.

    Files without content count with an empty one; of several contents of a path the smallest signature stands for it.
    """
    sign = lambda df, s: df.where("path is not null").groupBy(F.col("path").alias(f"p{s}")).agg(F.min(F.sha1(F.coalesce("content", F.lit("")))).alias(f"s{s}"))
    both = sign(now, 1).join(sign(before, 2), F.col("p1") == F.col("p2"), "full")
    state = F.when(F.col("p2").isNull(), "new").when(F.col("p1").isNull(), "deleted").when(F.col("s1") != F.col("s2"), "changed")
    return both.select(F.coalesce("p1", "p2").alias("path"), state.alias("state")).where("state is not null")
