"""Log entries to sequence events: the function a record comes from, its lane, its most recent plausible caller, its depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.paths import ModuleRules, basename, short_name
from loomtrace.operators.graph import MAX_HOPS, SYNC_MS, caller_reach, first_functions
from loomtrace.operators.hierarchy import roots
from loomtrace.operators.ordered import WIDTH, last_known, offsets, running
from loomtrace.session import cut

TIMELESS = -(1 << 62)


def numbered(events: DataFrame) -> DataFrame:
    """Adds ``id``, a number of each record over all logs in the order of (log_id, seq), and ``up``, that of its parent.

    Each log's numbers begin behind those of the logs before it, so ``seq`` may start anew in each. ``seq`` is not negative.
    """
    c = F.col
    per = events.groupBy("log_id").agg((F.greatest(F.max("seq"), F.max("parent_seq") if "parent_seq" in events.columns else F.lit(0)) + 1).alias("_n"))
    first = offsets(per, ["log_id"], "_n", "_first").select(c("log_id").alias("_l"), "_first")
    out = events.join(first, c("log_id").eqNullSafe(c("_l"))).withColumn("id", c("_first") + c("seq"))
    if "parent_seq" in events.columns:
        out = out.withColumn("up", c("_first") + c("parent_seq"))
    return out.drop("_l", "_first")


def resolve_functions(entries: DataFrame, functions: DataFrame) -> DataFrame:
    """Adds ``function_id`` and ``function_module``: by file and name, else by name only; of several candidates those whose
    lines hold the record's line, if any; then the first. Short names of class members count as well.

    Candidates are looked up once per distinct (file, function, line); whether a name has candidates by file decides
    before lines are compared. Null or empty function names give null.
    """
    c = F.col
    f = first_functions(functions).select(c("function_id").alias("fid"), c("name").alias("fname"), F.lower(basename(c("file_path"))).alias("base"), "start_line", "end_line", c("module").alias("fmod"), c("ord").alias("ford"))
    names = f.select("*", F.explode(F.array_distinct(F.array(c("fname"), short_name(c("fname"))))).alias("key"))
    asked = entries.where("function_name is not null and function_name <> ''").select("file_name", "function_name", "line_number").distinct()
    asked = asked.withColumn("a_base", F.lower(basename(c("file_name"))))
    a = [c(x) for x in ("file_name", "function_name", "line_number")]
    first = F.struct("ford", "fid", "fmod")
    inside = F.coalesce(c("line_number").between(c("start_line"), c("end_line")), F.lit(False))
    # by file and name; a record without a file has no candidates by file
    by_file = asked.where("a_base <> ''").join(names, (c("function_name") == c("key")) & (c("a_base") == c("base")))
    by_file = by_file.groupBy(*a).agg(F.min(F.struct((~inside).alias("o"), first.alias("f"))).alias("m")).select(*a, c("m.f").alias("f"))
    # by name only: one candidate a name, and one for every line of a name that lies within several
    rest = asked.join(by_file.select(*(c(x).alias(f"r{i}") for i, x in enumerate(("file_name", "function_name", "line_number")))), c("file_name").eqNullSafe(c("r0")) & (c("function_name") == c("r1")) & c("line_number").eqNullSafe(c("r2")), "left_anti")
    some = names.join(rest.select(c("function_name").alias("n1")).distinct(), c("key") == c("n1"), "left_semi")
    any_ = some.groupBy(c("key").alias("k1")).agg(F.min(first).alias("any"))
    lines = some.where("start_line <= end_line").select("key", F.explode(F.sequence(c("start_line").cast("long"), c("end_line").cast("long"))).alias("at"), first.alias("f")).groupBy(c("key").alias("k2"), "at").agg(F.min("f").alias("there"))
    by_name = rest.join(any_, c("function_name") == c("k1")).join(lines, (c("function_name") == c("k2")) & (c("line_number") == c("at")), "left").select(*a, F.coalesce("there", "any").alias("f"))
    best = by_file.unionByName(by_name).select(c("file_name").alias("b1"), c("function_name").alias("b2"), c("line_number").alias("b3"), c("f.fid").alias("function_id"), c("f.fmod").alias("function_module"))
    on = c("file_name").eqNullSafe(c("b1")) & (c("function_name") == c("b2")) & c("line_number").eqNullSafe(c("b3"))
    return entries.join(best, on, "left").drop("b1", "b2", "b3")


def lanes(entries: DataFrame, rules: ModuleRules | None = None) -> DataFrame:
    """Adds ``lane``: the log's module, else by file name, else the function's module (both in the spelling that log
    modules of the same log used first before the record), else ``(other)`` for RAW and ``(unknown)``.

    Needs ``log_id, seq, module_name, file_name, function_module, kind``.
    """
    r = rules or ModuleRules()
    c = F.col
    e = entries.withColumn("_log_lane", r.from_log(c("module_name"))).withColumn("_other", F.coalesce(r.from_file(c("file_name")), "function_module"))
    first = e.where("_log_lane is not null").groupBy("log_id", F.lower("_log_lane").alias("_low")).agg(F.min("seq").alias("_since"), F.min_by("_log_lane", "seq").alias("_spelt"))
    first = first.select(c("log_id").alias("_l"), "_low", "_since", "_spelt")
    e = e.join(first, c("log_id").eqNullSafe(c("_l")) & (F.lower("_other") == c("_low")) & c("_log_lane").isNull(), "left")
    spelt = F.when(c("_since") < c("seq"), c("_spelt")).otherwise(c("_other"))
    lane = F.coalesce("_log_lane", F.when(c("_other").isNotNull(), spelt), F.when(c("kind") == "RAW", r.raw_lane), F.lit(r.unknown_lane))
    return e.withColumn("lane", lane).drop("_log_lane", "_other", "_l", "_low", "_since", "_spelt")


def _by_caller(probes: DataFrame, told: DataFrame, offers: DataFrame, width: int) -> DataFrame:
    """Links of some probes by asking callers for their latest records: right whatever the clocks do.

    A caller can only be the link if one of its records in this log has no time, or one within the window before the
    probe: callers are looked up by time in steps of the window (the probe's step and the one before).
    """
    c = F.col
    step = F.coalesce(F.floor(c("ts_ms") / c("window_ms")), F.lit(TIMELESS))
    some = offers.select(c("log_id").alias("o_log"), c("f").alias("o_f"), c("window_ms").alias("o_w"), "caller", c("offer.hops").alias("hops"), c("offer.kind").alias("kind"), step.alias("o_step")).distinct()
    steps = F.explode(F.array_distinct(F.array(step, step - 1, F.lit(TIMELESS))))
    near = probes.select("log_id", c("function_id").alias("f"), "seq", "ts_ms", "window_ms", steps.alias("step"))
    asked = near.join(some, c("log_id").eqNullSafe(c("o_log")) & (c("f") == c("o_f")) & (c("window_ms") == c("o_w")) & (c("step") == c("o_step")))
    asked = cut(asked.select("log_id", c("caller").alias("key"), "seq", "ts_ms", "hops", "kind", "window_ms", F.lit(True).alias("probe")).distinct())
    none = F.lit(None)
    told = told.select("log_id", c("function_id").alias("key"), "seq", "ts_ms", none.cast("int").alias("hops"), none.cast("string").alias("kind"), none.cast("long").alias("window_ms"), F.lit(False).alias("probe"))
    told = told.join(asked.select(c("log_id").alias("k1"), c("key").alias("k2")).distinct(), c("log_id").eqNullSafe(c("k1")) & (c("key") == c("k2")), "left_semi")
    both = last_known(asked.unionByName(told), ["log_id", "key"], "seq", F.when(~c("probe"), F.struct("seq", "ts_ms")), "latest", include_self=False, width=width)
    gap = c("ts_ms") - c("latest.ts_ms")
    ok = c("probe") & c("latest").isNotNull() & F.coalesce(gap.between(F.lit(0), c("window_ms")), F.lit(True))
    best = F.max(F.struct(c("latest.seq").alias("caller_seq"), (-c("hops")).alias("h"), "kind")).alias("m")
    return both.where(ok).groupBy("log_id", "seq").agg(best)


def caller_links(events: DataFrame, reach: DataFrame, width: int = WIDTH) -> DataFrame:
    """``log_id, seq, caller_seq, arrow_kind, hops``: of each record, the newest of its possible callers' latest records.

    For each caller that reaches the record's function, only its latest earlier record of the same log counts, and only
    within the caller's time window (missing times pass, negative differences fail); of those the one with the greatest
    ``seq``, then the fewest hops. ``events``: ``log_id, seq, ts_ms, function_id``.

    Every record is offered to the few functions that its own reaches, not asked for by the many that reach it: a function
    that is logged most is called by most others. Per window length the last offer before a record is its link if it is in
    time. Where it is not, older offers are late as well, unless times are missing or the clock has gone back; only such
    records ask all their callers one by one.
    """
    c = F.col
    e = cut(events.where("function_id is not null").select("log_id", "seq", "ts_ms", "function_id"))
    logged = e.select(c("function_id").alias("lf")).distinct()
    wanted = reach.join(logged, c("callee") == c("lf"), "left_semi")
    offers = cut(e.join(wanted, c("function_id") == c("caller")).select("log_id", c("callee").alias("f"), "window_ms", "caller", "seq", "ts_ms", F.struct("seq", "ts_ms", "hops", "kind").alias("offer")))
    classes = wanted.select(c("callee").alias("f"), "window_ms").distinct()
    probes = e.join(classes, c("function_id") == c("f")).select("log_id", "f", "window_ms", "seq", "ts_ms", F.lit(None).cast("struct<seq:bigint,ts_ms:bigint,hops:int,kind:string>").alias("offer"))
    is_offer = c("offer").isNotNull()
    rows = running(
        offers.drop("caller").unionByName(probes), ["log_id", "f", "window_ms"], "seq",
        {"latest": ("last", c("offer")), "max_ts": ("max", F.when(is_offer, c("ts_ms"))), "timeless": ("sum", F.when(is_offer & c("ts_ms").isNull(), 1))}, include_self=False, width=width,
    )
    gap = c("ts_ms") - c("latest.ts_ms")
    fits = F.coalesce(gap.between(F.lit(0), c("window_ms")), F.lit(True))
    doubt = ~fits & ((gap < 0) | (c("timeless") > 0) | (c("max_ts") >= c("ts_ms") - c("window_ms")))
    best = F.max(F.when(fits, F.struct(c("latest.seq").alias("caller_seq"), (-c("latest.hops")).alias("h"), c("latest.kind").alias("kind")))).alias("m")
    per = cut(rows.where(~is_offer & c("latest").isNotNull()).groupBy("log_id", "seq").agg(best, F.bool_or(doubt).alias("doubt")))
    unsure = per.where("doubt").select(c("log_id").alias("u1"), c("seq").alias("u2"))
    again = e.join(unsure, c("log_id").eqNullSafe(c("u1")) & (c("seq") == c("u2")), "left_semi").join(classes, c("function_id") == c("f")).drop("f")
    slow = _by_caller(again, e, offers, width)
    out = per.where("not doubt and m is not null").select("log_id", "seq", "m").unionByName(slow)
    return out.select("log_id", "seq", c("m.caller_seq").alias("caller_seq"), c("m.kind").alias("arrow_kind"), (-c("m.h")).alias("hops"))


def link(events: DataFrame, edges: DataFrame, max_hops: int = MAX_HOPS, sync_ms: int = SYNC_MS, reach: DataFrame | None = None, width: int = WIDTH) -> DataFrame:
    """``log_id, seq, parent_seq, arrow_kind, depth, hops`` of each record.

    A record with a caller hangs below it. One without takes over parent and depth of the record before it of the same
    function (or, without a known function, of the same file and function name) if that lies within the window for
    synchronous calls. ``events``: ``log_id, seq`` (unique together), ``ts_ms, function_id, file_name, function_name``.
    """
    c = F.col
    reach = caller_reach(edges, max_hops) if reach is None else reach
    e = events.select("log_id", "seq", "ts_ms", "function_id", F.coalesce("function_id", F.when(c("function_name") != "", F.concat(F.lit("?"), F.coalesce("file_name", F.lit("")), F.lit("::"), c("function_name")))).alias("key"))
    links = caller_links(events, reach, width)
    e = cut(e.join(links.withColumnsRenamed({"log_id": "l", "seq": "s"}), c("log_id").eqNullSafe(c("l")) & (c("seq") == c("s")), "left").drop("l", "s"))
    known = last_known(e.where("key is not null"), ["log_id", "key"], "seq", F.struct("seq", "ts_ms"), "prev", include_self=False, width=width)
    gap = c("ts_ms") - c("prev.ts_ms")
    follows = c("caller_seq").isNull() & c("prev").isNotNull() & F.coalesce(gap.between(0, sync_ms), F.lit(True))
    known = cut(known.withColumn("follows", follows))
    # a run of siblings takes everything from the record that began it
    known = last_known(known, ["log_id", "key"], "seq", F.when(~c("follows"), F.struct("seq", "caller_seq")), "begun", width=width)
    known = known.select("log_id", "seq", "arrow_kind", "hops", c("begun.seq").alias("rep"), c("begun.caller_seq").alias("parent_seq"))
    known = cut(numbered(known).withColumn("rep", c("id") - c("seq") + c("rep")))
    reps = known.select(c("id").alias("p_id"), c("rep").alias("p_rep"))
    forest = known.where("id = rep").select(c("id").alias("node"), c("up").alias("at")).join(reps, c("at") == c("p_id"), "left").select("node", c("p_rep").alias("up"))
    depth = roots(forest, "node", "up").select(c("node").alias("d"), "depth")
    out = known.join(depth, c("rep") == c("d")).select("log_id", "seq", "parent_seq", "arrow_kind", c("depth").cast("int").alias("depth"), F.coalesce("hops", F.lit(0)).alias("hops"))
    rest = e.where("key is null").select("log_id", "seq", F.lit(None).cast("long").alias("parent_seq"), F.lit(None).cast("string").alias("arrow_kind"), F.lit(0).alias("depth"), F.lit(0).alias("hops"))
    return out.unionByName(rest)


def sequence_events(entries: DataFrame, functions: DataFrame, edges: DataFrame, rules: ModuleRules | None = None, width: int = WIDTH) -> DataFrame:
    """Log entries with ``lane, function_id, parent_seq, arrow_kind, depth, hops``; repeated deliveries of a record of a log
    count once. ``seq`` may number the records of each log or of all logs; links stay within a log."""
    once = entries.where("seq is not null").dropDuplicates(["log_id", "seq"])
    e = cut(lanes(resolve_functions(once, functions), rules))
    linked = link(e, edges, width=width).withColumnsRenamed({"log_id": "l", "seq": "s"})
    on = F.col("log_id").eqNullSafe(F.col("l")) & (F.col("seq") == F.col("s"))
    return e.join(linked, on).drop("l", "s", "function_module")


def sibling_counts(events: DataFrame) -> DataFrame:
    """``log_id, seq, children``: how many records of its log name a record as parent."""
    c = F.col
    once = events.where("seq is not null").dropDuplicates(["log_id", "seq"])
    n = once.where("parent_seq is not null").groupBy(c("log_id").alias("l"), c("parent_seq").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return once.select("log_id", "seq").join(n, c("log_id").eqNullSafe(c("l")) & (c("seq") == c("p")), "left").select("log_id", "seq", F.coalesce("n", F.lit(0)).alias("children"))
