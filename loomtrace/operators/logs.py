"""Physical lines to log entries: repair of torn and interleaved lines, time carried forward, numbering.

Segments begin at head lines, so that records are put together per segment, not per log; time is carried forward by
blocks; entries are numbered by per-block counts and running offsets. No step sorts a whole log in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions.grammar import Grammar, strip
from loomtrace.operators.ordered import WIDTH, last_known
from loomtrace.session import cut


def _fold(g: Grammar, head: Column, lines: Column) -> Column:
    """A segment's open record taken through its following lines: STRUCT<body, open, used> (``used`` lines belong to it)."""

    def step(acc: Column, line: Column) -> Column:
        # a record that already has its place, or met a foreign line, takes nothing more
        torn = acc["open"] & g.has_partial_trailer(acc["body"]) & (strip(line) != "")
        next_line = acc["open"] & ~g.has_partial_trailer(acc["body"]) & g.is_pure_trailer(line)
        body = F.when(torn, F.concat(acc["body"], strip(line))).when(next_line, F.concat(acc["body"], F.lit("\n"), strip(line))).otherwise(acc["body"])
        took = torn | next_line
        return F.struct(body.alias("body"), (took & ~g.has_trailer(body)).alias("open"), (acc["used"] + took.cast("int")).alias("used"))

    start = F.struct(head.alias("body"), (~g.has_trailer(head)).alias("open"), F.lit(0).alias("used"))
    return F.aggregate(lines, start, step)


def assemble(lines: DataFrame, grammar: Grammar | None = None, width: int = WIDTH) -> DataFrame:
    """Logical records ``log_id, line_no, sub, ts_text, body, kind`` of physical lines ``log_id, line_no, line``.

    A head line begins a record; following lines are joined to it while its place at the end is torn or missing (only the
    lines right behind it are looked at). Outputs that broke into a line come out as TRACE records behind the record they
    broke. Blank lines give no record. ``sub`` orders the records of one line: 0 the record, 1.. its interrupts; ``owner``
    is the line whose record they follow.
    """
    g = grammar or Grammar()
    c = F.col
    rows = lines.select("log_id", c("line_no").cast("long").alias("line_no"), F.coalesce("line", F.lit("")).alias("line"))
    rows = rows.select("log_id", "line_no", g.ts_text(c("line")).alias("ts_text"), F.regexp_replace(g.body(c("line")), r"[\r\n]+$", "").alias("whole"))
    rows = rows.withColumn("cut_ins", F.when(c("whole").contains("*****"), g.interrupts(c("whole"))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("body", g.without_interrupts(c("whole"))).drop("whole")
    rows = rows.withColumn("is_head", g.is_head(c("body")))
    torn = g.has_partial_trailer(c("body"))
    begun = F.when(c("is_head"), F.struct(c("line_no").alias("line"), (~g.has_trailer(c("body"))).alias("open"), torn.alias("torn")))
    # read several times below: written once to the shared folder
    rows = cut(last_known(rows, ["log_id"], "line_no", begun, "begun", width=width).withColumn("segment", c("begun.line")))
    # only a head without its place takes lines: a torn one as long as it stays torn, and a place on the line behind that
    by = Window.partitionBy("log_id", "segment").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -2)
    before = F.count(F.when(~g.keeps_torn(c("body")) | ~c("begun.torn"), 1)).over(by)
    near = rows.where(~c("is_head") & c("begun.open")).withColumn("k", before).where("k = 0")
    tails = near.groupBy("log_id", "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "body"))), lambda x: x["body"]).alias("tail"), F.transform(F.array_sort(F.collect_list(F.struct("line_no", "body"))), lambda x: x["line_no"]).alias("tail_lines"))
    heads = rows.where("is_head").join(tails.withColumnsRenamed({"log_id": "t_log", "segment": "t_seg"}), c("log_id").eqNullSafe(c("t_log")) & (c("line_no") == c("t_seg")), "left")
    heads = heads.withColumn("made", _fold(g, c("body"), F.coalesce("tail", F.array().cast("array<string>"))))
    heads = heads.withColumn("last_used", F.when(c("made.used") > 0, F.get("tail_lines", c("made.used") - 1)).otherwise(c("line_no")))
    structured = heads.select("log_id", c("line_no").alias("owner"), "line_no", F.lit(0).alias("sub"), "ts_text", c("made.body").alias("body"), F.lit("STRUCTURED").alias("kind"))
    ends = heads.select(c("log_id").alias("h_log"), c("line_no").alias("h_line"), "last_used")
    rest = rows.where(~c("is_head")).join(ends, c("log_id").eqNullSafe(c("h_log")) & (c("segment") == c("h_line")), "left")
    used = F.coalesce(c("line_no") <= c("last_used"), F.lit(False))
    others = rest.where(~used & (strip(c("body")) != "")).select(
        "log_id", c("line_no").alias("owner"), "line_no", F.lit(0).alias("sub"), "ts_text", "body", F.when(g.is_trace(c("body")), "TRACE").otherwise("RAW").alias("kind")
    )
    held = rows.where("is_head").select("log_id", c("line_no").alias("owner"), "line_no", "ts_text", "cut_ins").unionByName(
        rest.select("log_id", F.when(used, c("segment")).otherwise(c("line_no")).alias("owner"), "line_no", "ts_text", "cut_ins")
    )
    traces = held.select("log_id", "owner", "line_no", "ts_text", F.posexplode("cut_ins").alias("i", "body")).select(
        "log_id", "owner", "line_no", (c("i") + 1).alias("sub"), "ts_text", "body", F.lit("TRACE").alias("kind")
    )
    return structured.unionByName(others).unionByName(traces)


def number(records: DataFrame, width: int = WIDTH) -> DataFrame:
    """Adds ``seq``, 0.. per log in order of (owner, line, sub), and ``ts_full``, the timestamp's text of the record or the last
    one before it that has one: both within blocks of lines, with the counts and last texts of the blocks before."""
    c = F.col
    rows = records.withColumn("_b", F.floor(c("owner") / width).cast("long"))
    # a record goes before what follows it; its own interrupts come behind it
    place = [c("owner"), F.when(c("sub") == 0, 0).otherwise(1), c("line_no"), c("sub")]
    order = F.struct(*(x.alias(f"o{i}") for i, x in enumerate(place)))
    blocks = rows.groupBy(c("log_id").alias("_l"), c("_b").alias("_bb")).agg(F.count(F.lit(1)).alias("_n"), F.max_by("ts_text", F.when(c("ts_text").isNotNull(), order)).alias("_ts"))
    before = Window.partitionBy("_l").orderBy("_bb").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_l", "_bb", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), F.last("_ts", ignorenulls=True).over(before).alias("_carried"))
    w = Window.partitionBy("log_id", "_b").orderBy(*place)
    rows = rows.withColumns({"_rn": F.row_number().over(w), "_own": F.last("ts_text", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    joined = rows.join(blocks, c("log_id").eqNullSafe(c("_l")) & (c("_b") == c("_bb")))
    return joined.withColumns({"seq": (c("_off") + c("_rn") - 1).cast("long"), "ts_full": F.coalesce("_own", "_carried")}).drop("_b", "_bb", "_l", "_off", "_rn", "_own", "_carried")


def parse(lines: DataFrame, grammar: Grammar | None = None, width: int = WIDTH) -> DataFrame:
    """Log entries of physical lines: ``log_id, seq, line_no, ts, ts_ms, thread_id, tick, level, module_name, function_name,
    message, file_name, line_number, kind, raw``.

    A record without a timestamp takes over the text of the last one before it, so that an impossible time stays null.
    ``seq`` numbers the records of each log. Lines without text give no record; an empty table gives an empty result.
    """
    g = grammar or Grammar()
    c = F.col
    rows = g.with_fields(number(cut(assemble(lines, g, width)), width))
    return rows.select(
        "log_id", "seq", "line_no", g.timestamp(c("ts_full")).alias("ts"), g.ts_ms(c("ts_full")).alias("ts_ms"), F.lit(None).cast("string").alias("thread_id"),
        "tick", "level", "module_name", "function_name", "message", "file_name", "line_number", "kind", c("body").alias("raw"),
    )


def physical_lines(entries: DataFrame) -> DataFrame:
    """``log_id, line_no, line``: the lines that entries with a full ``raw`` were read from; repeated deliveries count once."""
    once = entries.where("raw is not null").dropDuplicates(["log_id", "seq"])
    return once.select("log_id", "line_no", F.posexplode(F.split("raw", "\n")).alias("i", "line")).select("log_id", (F.col("line_no") + F.col("i")).alias("line_no"), "line")
