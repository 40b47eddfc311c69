"""The execution log's line grammar as Column expressions: everything stays in the JVM.

``[YYYY-MM-DD hh:mm:ss.mmm] [tick] LEVEL module message (file:line function)``; other programs' grammars can be given as
other ``Grammar`` values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: patterns of the line format
TS = r"^\[(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?)\] ?"
FILE = r"[^\s():]+\.[A-Za-z0-9]{1,4}"
FUNC = r"[A-Za-z_~][\w:~<>]*"
HEAD = r"^\[(\d+)\] (TRACE|DEBUG|INFO|WARN|ERROR|FATAL|UNKNOWN) ?"
TRAILER = rf"(?U)\s\(({FILE}):(\d+) ({FUNC})\)\s*$"
PARTIAL = rf"(?U)\s\({FILE}(?::\d*(?: [\w:~<>]*)?)?$"
PIECE = r"(?U)^[^\s()]*(?: [\w:~<>]*)?$"
PURE_TRAILER = rf"(?U)^\s*\(({FILE}):(\d+) ({FUNC})\)\s*$"
TRACE = r"(?U)(?d)^\*{5,}(.*?)\s*\[([A-Za-z_]\w*)\((\d+)\)\]\s*$"
INTERRUPT = r"(?U)(?d)(?<=[\w)\]])\*{5,}.*?\[[A-Za-z_]\w*\(\d+\)\]"
MODULE_WIDTH = 23
LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "UNKNOWN")


def strip(c: Column) -> Column:
    """Blanks of any script off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def some(c: Column) -> Column:
    """Empty strings as null."""
    return F.when(c != "", c)


def level_of(text: Column) -> Column:
    """A level's name in any case; WARNING is WARN; what is none, empty or null is UNKNOWN."""
    up = F.upper(strip(text))
    up = F.when(up == "WARNING", "WARN").otherwise(up)
    return F.when(up.isin(*LEVELS), up).otherwise("UNKNOWN")


@dataclass(frozen=True)
class Grammar:
    """A line format as functions of Columns."""

    module_width: int = MODULE_WIDTH

    def ts_text(self, line: Column) -> Column:
        """The timestamp's text, null if the line has none."""
        return some(F.regexp_extract(line, TS, 1))

    def body(self, line: Column) -> Column:
        """The line behind its timestamp and at most one blank."""
        return F.regexp_replace(line, TS, "")

    def timestamp(self, text: Column) -> Column:
        """TIMESTAMP_NTZ with microseconds; further digits are cut; an impossible date gives null."""
        plain = F.translate(F.regexp_replace(text, "T", " "), ",", ".")
        ts = plain.try_cast("timestamp_ntz")
        return F.when(~text.startswith("0000"), ts)

    def ts_ms(self, text: Column) -> Column:
        """Milliseconds since 1970 without a zone, rounded down (sessions in UTC)."""
        return F.floor(F.unix_micros(self.timestamp(text).cast("timestamp")) / 1000).cast("long")

    def is_head(self, body: Column) -> Column:
        return body.rlike(HEAD)

    def tick(self, body: Column) -> Column:
        return some(F.regexp_extract(body, HEAD, 1)).cast("decimal(38,0)")

    def level(self, body: Column) -> Column:
        return some(F.regexp_extract(body, HEAD, 2))

    def _after(self, body: Column) -> Column:
        after = F.regexp_replace(body, HEAD, "")
        return F.when(F.length(self.level(body)) < 5, F.ltrim(after)).otherwise(after)

    def module_and_rest(self, body: Column) -> Column:
        """STRUCT<module, rest> of a head: a field of fixed width, or all of a short line, or the first word."""
        return self._split(self._after(body))

    def _split(self, after: Column) -> Column:
        w = self.module_width
        fixed = (F.length(after) > w) & (F.substring(after, w + 1, 1) == " ") & (strip(F.substring(after, 1, w)) != "")
        parts = F.split(F.regexp_replace(after, r"(?U)^\s+", ""), r"(?U)\s+", 2)
        return (
            F.when(fixed, F.struct(rstrip(F.substring(after, 1, w)).alias("module"), F.substring(after, w + 2, 1 << 30).alias("rest")))
            .when(F.length(after) <= w, F.struct(rstrip(after).alias("module"), F.lit("").alias("rest")))
            .otherwise(F.struct(F.get(parts, 0).alias("module"), F.coalesce(F.get(parts, 1), F.lit("")).alias("rest")))
        )

    def has_trailer(self, text: Column) -> Column:
        return text.rlike(TRAILER)

    def trailer(self, text: Column) -> Column:
        """STRUCT<file, line, func> of the place at a text's end; null if there is none."""
        got = F.struct(
            F.regexp_extract(text, TRAILER, 1).alias("file"), F.regexp_extract(text, TRAILER, 2).cast("long").alias("line"), F.regexp_extract(text, TRAILER, 3).alias("func")
        )
        return F.when(self.has_trailer(text), got)

    def before_trailer(self, text: Column) -> Column:
        return rstrip(F.regexp_replace(text, TRAILER, ""))

    def has_partial_trailer(self, text: Column) -> Column:
        return text.rlike(PARTIAL)

    def keeps_torn(self, body: Column) -> Column:
        """Whether a line joined to a record whose place is torn may leave it torn: it holds no more than a piece of a
        place, or another torn one at its end."""
        b = strip(body)
        return b.rlike(PIECE) | F.concat(F.lit(" "), b).rlike(PARTIAL)

    def is_pure_trailer(self, body: Column) -> Column:
        return body.rlike(PURE_TRAILER)

    def is_trace(self, body: Column) -> Column:
        return strip(body).rlike(TRACE)

    def trace(self, body: Column) -> Column:
        """STRUCT<message, func, line> of a ``*****…[func(line)]`` line; null if it is none."""
        b = strip(body)
        got = F.struct(strip(F.regexp_extract(b, TRACE, 1)).alias("message"), F.regexp_extract(b, TRACE, 2).alias("func"), F.regexp_extract(b, TRACE, 3).cast("long").alias("line"))
        return F.when(b.rlike(TRACE), got)

    def interrupts(self, body: Column) -> Column:
        """Outputs of others that broke into a line, in order."""
        return F.regexp_extract_all(body, F.lit(f"({INTERRUPT})"), F.lit(1))

    def without_interrupts(self, body: Column) -> Column:
        return F.when(body.contains("*****"), F.regexp_replace(body, INTERRUPT, "")).otherwise(body)

    def with_fields(self, df: DataFrame, body: str = "body", kind: str = "kind") -> DataFrame:
        """Adds a record's columns by its kind: level, tick, module_name, function_name, message, file_name, line_number.

        Step by step, so that every pattern is matched once a row: structured rows split into head, rest and place; TRACE rows
        have a function and line; RAW rows their whole text as message.
        """
        c = F.col
        is_s, is_t = c(kind) == "STRUCTURED", c(kind) == "TRACE"
        df = df.withColumn("_lead", F.when(is_s, F.regexp_extract(c(body), f"({HEAD})", 1))).withColumn("_lvl", F.regexp_extract("_lead", HEAD, 2))
        after = F.substring(c(body), F.length("_lead") + 1, F.length(c(body)))
        df = df.withColumn("_after", F.when(F.length("_lvl") < 5, F.ltrim(after)).otherwise(after)).withColumn("_head", F.when(is_s, self._split(c("_after"))))
        # the place at the end is looked for once; its parts are taken from the short text found
        df = df.withColumn("_rest", c("_head.rest")).withColumn("_tail", F.regexp_extract("_rest", rf"(?U)(\s\({FILE}:\d+ {FUNC}\)\s*)$", 1))
        df = df.withColumn("_place", F.when(c("_tail") != "", self.trailer(c("_tail")))).withColumn("_trace", F.when(is_t, self.trace(c(body))))
        before = rstrip(F.substring("_rest", F.lit(1), F.length("_rest") - F.length("_tail")))
        return df.withColumns(
            {
                "level": F.when(is_s, c("_lvl")).otherwise("UNKNOWN"),
                "tick": some(F.regexp_extract("_lead", HEAD, 1)).cast("decimal(38,0)"),
                "module_name": some(c("_head.module")),
                "function_name": F.coalesce("_place.func", "_trace.func"),
                "message": F.when(is_s, before).when(is_t, c("_trace.message")).otherwise(strip(c(body))),
                "file_name": c("_place.file"),
                "line_number": F.coalesce("_place.line", "_trace.line"),
            }
        ).drop("_lead", "_lvl", "_after", "_head", "_rest", "_tail", "_place", "_trace")
