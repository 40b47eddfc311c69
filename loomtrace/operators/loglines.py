"""Problem 4: lines of other programs into entries with timestamp, level, component and message.

Every line is cut into lexical tokens and parsed with a weighted context-free grammar (Earley): rules describe headers,
their fields, and lines that continue an entry; the highest-scoring parse is kept, and what no field covers is exposed
as unparsed: pairs and members that are no field, and whole lines. A parse depends on the tokens' classes only, so each
task parses every distinct shape of line once and maps the spans to all lines of that shape. Lines of all lengths are
read alike.

Lines become entries with set operations: the last beginning before a line, found per block of ``seq`` (so that one log
with a third of all rows is many tasks' work) and carried over block borders by a table of one row per log and block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions.earley import Grammar, parse
from loomtrace.session import cut

BLOCK = 1 << 16
_CACHE = 100_000
_CACHED_TOKENS = 400

# fixed values: words for levels, and the level each stands for
LEVEL_WORDS = {
    "trace": "TRACE", "verbose": "TRACE", "finest": "TRACE", "finer": "TRACE", "trc": "TRACE",
    "debug": "DEBUG", "dbg": "DEBUG", "fine": "DEBUG",
    "info": "INFO", "information": "INFO", "inf": "INFO", "notice": "INFO", "config": "INFO",
    "warn": "WARN", "warning": "WARN", "wrn": "WARN",
    "err": "ERROR", "error": "ERROR", "severe": "ERROR",
    "fatal": "FATAL", "crit": "FATAL", "critical": "FATAL", "alert": "FATAL", "emerg": "FATAL", "emergency": "FATAL", "panic": "FATAL",
}
LEVEL_LETTERS = {"V": "TRACE", "T": "TRACE", "D": "DEBUG", "I": "INFO", "N": "INFO", "W": "WARN", "E": "ERROR", "F": "FATAL", "C": "FATAL", "A": "FATAL"}
SYSLOG = {0: "FATAL", 1: "FATAL", 2: "FATAL", 3: "ERROR", 4: "WARN", 5: "INFO", 6: "INFO", 7: "DEBUG"}
NUMBERS = {10: "TRACE", 20: "DEBUG", 30: "INFO", 40: "WARN", 50: "ERROR", 60: "FATAL"}
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
KEYS = {
    "level": "KLVL", "lvl": "KLVL", "severity": "KLVL", "loglevel": "KLVL", "levelname": "KLVL",
    "comp": "KCMP", "component": "KCMP", "logger": "KCMP", "name": "KCMP", "src": "KCMP", "tag": "KCMP", "module": "KCMP", "source": "KCMP", "app": "KCMP", "program": "KCMP", "caller": "KCMP",
    "ts": "KTS", "time": "KTS", "timestamp": "KTS", "at": "KTS", "date": "KTS", "t": "KTS",
    "msg": "KMSG", "message": "KMSG", "text": "KMSG",
}

# Terminals: signs stand for themselves; SP blanks; N number, N1 N2 N3 N4 N6 N10 by its digits; W any word; LVL word for a
# level; L1 letter for one; MON month; AMPM; T and Z of a timestamp; KLVL KCMP KTS KMSG keys; ANY everything, NOQ all but
# a quote, NOLT all but "<".
GRAMMAR = Grammar(
    """
Line 0 : Body | Prefix Body
Prefix 1 : [ Iso SP Clock ] SP
Body 0 : Entry | Part | Cont
Cont 0 : Unparsed
Unparsed 0 : Many
Many 0 : ANY | Many ANY
Entry 10 : Single | JulHead | JsonOpen
Single 0 : Json | Syslog | Kernel | Android | Plain | Delimited | Xml | Logfmt
# fields
Msg 0 : Many
QMsg 0 : Quotable
Quotable 0 : NOQ | Quotable NOQ | Quotable \\ '"' | \\ '"' | \\ ANY
Iso 0 : N4 - N2 - N2
Clock 0 : N2 ':' N2 ':' N2 | N1 ':' N2 ':' N2 | Clock . N | Clock , N
Zone 0 : Z | + N2 ':' N2 | - N2 ':' N2 | + N4 | - N4
IsoStamp 0 : Iso T Clock | Iso T Clock Zone | Iso SP Clock | Iso SP Clock Zone
Time 0 : IsoStamp | N2 . N2 . N4 SP Clock | N4 / N2 / N2 SP Clock | N2 / N2 / N4 SP Clock | MON SP N SP Clock | N2 - N2 SP Clock
Epoch 0 : N10 . N3 | N10 . N6 | N10 | N13
Uptime 0 : N . N6
Comp 0 : Name
Name 0 : W | Name . W | Name - W | Name / W | Name - N | Name . N | Name N
Lvl 0 : LVL
Letter 0 : L1
Pri 0 : N
Num 0 : N
Host 0 : Name
# layouts
Syslog 3 : < Pri > N1 SP Time SP Host SP Comp SP N SP - SP - SP Msg | < Pri > N1 SP Time SP Host SP Comp SP - SP - SP - SP Msg
Syslog 2 : < Pri > Time SP Host SP Comp [ N ] ':' SP Msg | < Pri > Time SP Host SP Comp ':' SP Msg | Time SP Host SP Comp [ N ] ':' SP Msg
Kernel 2 : < Pri > [ Up ] SP Comp ':' SP Msg | [ Up ] SP Comp ':' SP Msg
Up 0 : Uptime | SP Uptime
Android 3 : Time SP N SP N SP Letter SP Comp ':' SP Msg | Time SP N SP N SP Letter SP Comp SP ':' SP Msg
Android 2 : Letter / Comp ( Pid ) ':' SP Msg | Letter / Comp SP ( Pid ) ':' SP Msg
Pid 0 : N | SP N
Plain 3 : Stamp SP - SP Comp SP - SP Lvl SP - SP Msg | Stamp SP Lvl SP [ Thread ] SP Comp SP - SP Msg | Stamp SP [ Comp ] SP ( Letter ) SP Msg | Stamp SP [ Thread ] SP Lvl SP Comp SP - SP Msg
Plain 2 : Epoch SP Comp SP Lvl SP Msg | Lvl ':' Comp ':' Msg | Stamp SP * Lvl * SP Msg | Stamp SP [ Lvl ] SP Msg | Stamp SP Comp SP Lvl SP Msg | Stamp SP Lvl SP Comp ':' SP Msg
Plain 1 : Time SP Msg
Stamp 0 : Time | Epoch
Thread 0 : Name
Delimited 2 : Stamp ; Comp ; Lvl ; Msg | Stamp '|' Lvl '|' Comp '|' Msg | Stamp '|' Comp '|' Lvl '|' Msg | Stamp ; Lvl ; Comp ; Msg
Delimited 2 : '"' Stamp '"' , '"' Comp '"' , '"' Lvl '"' , '"' QMsg '"' | '"' Stamp '"' , '"' Lvl '"' , '"' Comp '"' , '"' QMsg '"'
JulHead 2 : MON SP N , SP N4 SP Clock SP AMPM SP Comp
Xml 2 : Open | Open XMsg < / W >
Open 0 : < W Attrs >
Attrs 0 : Attr | Attrs Attr
Attr 1 : SP KLVL = '"' Lvl '"' | SP KCMP = '"' Comp '"' | SP KTS = '"' Time '"'
Attr -1 : SP Extra
Extra 0 : W = '"' Quotable '"'
XMsg 0 : NOLT | XMsg NOLT
Logfmt -5 : Pairs
Pairs 0 : Pair | Pairs SP Pair
Pair 3 : KLVL = Lvl | KTS = Stamp | KTS = '"' Stamp '"'
Pair 2 : KCMP = Comp | KMSG = '"' QMsg '"'
Pair 0 : Other
Other 0 : W = Name | W = N | W = N . N | W = '"' Quotable '"'
Json 3 : { Members }
Members 0 : Member | Members , Member | Members , SP Member
Member 1 : Key
Key 1 : '"' KLVL '"' Colon '"' Lvl '"' | '"' KLVL '"' Colon Num | '"' KCMP '"' Colon '"' Comp '"' | '"' KTS '"' Colon '"' Time '"' | '"' @ KTS '"' Colon '"' Time '"' | '"' KTS '"' Colon Epoch | '"' KMSG '"' Colon '"' QMsg '"'
Key -1 : Member2 | '"' KMSG '"' Colon '"' '"'
Member2 0 : '"' W '"' Colon N | '"' W '"' Colon W | '"' W '"' Colon '"' Quotable '"' | '"' W '"' Colon '"' '"'
Colon 0 : ':' | ':' SP
JsonOpen -1 : { | SP {
# lines that belong to an entry begun before
Part 4 : JsonField | JulLevel | JsonClose | XmlPart
JsonField 0 : Key | Key , | SP Key | SP Key ,
JsonClose 0 : } | } ,
JulLevel 0 : Lvl ':' SP Msg
XmlPart 0 : < / W > | SP < W > XMsg < / W > | < W > XMsg < / W >
""",
    "Line",
)
KEEP = frozenset("Time Epoch Uptime Comp Lvl Letter Pri Num Msg QMsg XMsg Single JulHead JsonOpen JsonField JsonClose JulLevel XmlPart Unparsed Extra Other Member2".split())
_UNCOVERED = frozenset("Unparsed Extra Other Member2".split())

_TOKEN = re.compile(r"(?P<sp>[ \t]+)|(?P<t>T(?=[0-9]{2}:))|(?P<n>[0-9]+)|(?P<w>[A-Za-z_][A-Za-z0-9_]*|[^\x00-\x7f]+)|(?P<s>.)", re.S)


def _signs(c: str) -> frozenset[str]:
    out = {c, "ANY"}
    if c not in '"\\':
        out.add("NOQ")
    if c != "<":
        out.add("NOLT")
    return frozenset(out)


_FREE = {"ANY", "NOQ", "NOLT"}


def lexed(line: str) -> tuple[tuple[frozenset[str], ...], list[int]]:
    """Tokens of a line as the sets of terminals they can be, and where each begins (with the line's end).

    Three or more plain words on end are one token that no field but the message takes.
    """
    kinds: list[frozenset[str]] = []
    starts: list[int] = []
    plain: list[bool] = []
    for m in _TOKEN.finditer(line):
        text, kind = m.group(), m.lastgroup
        easy = False
        if kind == "sp":
            k = frozenset({"SP"} | _FREE)
            easy = True
        elif kind == "n":
            n = len(text)
            k = frozenset({"N", f"N{n}"} | _FREE) if n in (1, 2, 3, 4, 6, 10, 13) else frozenset({"N"} | _FREE)
        elif kind == "t":
            k = frozenset({"T"} | _FREE)
        elif kind == "w":
            low = text.lower()
            own = {"W"}
            if low in LEVEL_WORDS:
                own.add("LVL")
            if text in LEVEL_LETTERS:
                own.add("L1")
            if low in MONTHS:
                own.add("MON")
            if text in ("AM", "PM"):
                own.add("AMPM")
            if text == "Z":
                own.add("Z")
            if low in KEYS:
                own.add(KEYS[low])
            easy = len(own) == 1
            k = frozenset(own | _FREE)
        else:
            k = _signs(text)
        kinds.append(k)
        starts.append(m.start())
        plain.append(easy)
    out: list[frozenset[str]] = []
    at: list[int] = []
    i = 0
    while i < len(kinds):
        j = i
        if plain[i] and "SP" not in kinds[i]:
            while j < len(kinds) and plain[j]:
                j += 1
            while j > i and "SP" in kinds[j - 1]:
                j -= 1
        if j - i >= 5:
            out.append(frozenset(_FREE))
            at.append(starts[i])
            i = j
        else:
            out.append(kinds[i])
            at.append(starts[i])
            i += 1
    return tuple(out), [*at, len(line)]


def _level(name: str, text: str) -> str | None:
    if name == "Lvl":
        return LEVEL_WORDS[text.lower()]
    if name == "Letter":
        return LEVEL_LETTERS[text]
    number = int(text) if len(text) < 6 else -1
    return SYSLOG.get(number % 8) if name == "Pri" else NUMBERS.get(number)


ROLES = {"Single": "entry", "JulHead": "head", "JsonOpen": "open", "JsonField": "field", "JsonClose": "close", "JulLevel": "level", "XmlPart": "part"}
LINE_SCHEMA = "role string, time_text string, level string, component string, message string, unparsed array<string>"


class LineParser:
    """Parses lines with the grammar and remembers the spans of each shape of line."""

    def __init__(self) -> None:
        self.seen: dict[tuple, list[tuple[str, int, int]]] = {}

    def __call__(self, line: str) -> tuple[str, str | None, str | None, str | None, str | None, list[str]]:
        """(role, time, level, component, message, unparsed) of one line; the role of a line that continues is ``cont``.
        ``unparsed`` are the spans that no field covers."""
        kinds, at = lexed(line)
        spans = self.seen.get(kinds)
        if spans is None:
            found = parse(GRAMMAR, list(kinds), KEEP) if kinds else None
            spans = found[1] if found else [("Unparsed", 0, len(kinds))]
            if len(kinds) <= _CACHED_TOKENS:
                if len(self.seen) >= _CACHE:
                    self.seen.clear()
                self.seen[kinds] = spans
        role, time, level, component, message = "cont", None, None, None, None
        rest: list[str] = []
        for name, i, j in spans:
            text = line[at[i] : at[j]]
            if name in ROLES:
                role = ROLES[name]
            elif name in ("Time", "Epoch", "Uptime"):
                time = time or text
            elif name in ("Lvl", "Letter", "Pri", "Num"):
                level = level or _level(name, text)
            elif name == "Comp":
                component = component or text
            elif name in _UNCOVERED:
                if text:
                    rest.append(text)
            else:
                message = text if message is None else message
        if role == "head":
            time = line[: line.rfind(component)].strip() if component else line
            time = re.sub(r"^\[[^]]*\] ", "", time)
        return role, time, level, component, message, rest


def _parse_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parser = LineParser()
    for pdf in batches:
        got = pd.DataFrame([parser(x) for x in pdf["raw"]], columns=["role", "time_text", "level", "component", "message", "unparsed"], index=pdf.index)
        yield pd.concat([pdf[["log_id", "seq", "raw"]], got], axis=1)


def parse_lines(logs: DataFrame) -> DataFrame:
    """Each RAW record, once, with the role the grammar gives its line and the fields found in it.

    Reads ``seq, log_id, kind, message, raw``. Where ``raw`` is null the message stands for it; a record with neither is an
    empty line, which continues. Records over two lines are parsed as one text. Rows without ``seq`` are left out.
    """
    rows = logs.where((F.col("kind") == "RAW") & F.col("seq").isNotNull()).select("log_id", "seq", F.coalesce("raw", "message", F.lit("")).alias("raw"))
    return rows.mapInPandas(_parse_lines, "log_id string, seq long, raw string, " + LINE_SCHEMA)


# fixed values: layouts of dates with times, without fractions and zones
_FORMATS = ("yyyy-MM-dd HH:mm:ss", "dd.MM.yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "MMM d, yyyy h:mm:ss a")


def entry_time(text: F.Column) -> F.Column:
    """A header's timestamp as TIMESTAMP_NTZ with microseconds: wall-clock time as written, UTC where a zone is given and
    for seconds or milliseconds since 1970. Forms without a year (or counted from boot) give null."""
    zone = F.regexp_extract(text, r":[0-9]{2}(?:[.,][0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})$", 1)
    fraction = F.regexp_extract(text, r":[0-9]{2}[.,]([0-9]+)", 1)
    plain = F.regexp_replace(F.regexp_replace(text, "([0-9])T([0-9])", "$1 $2"), r"(:[0-9]{2})(?:[.,][0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?$", "$1")
    plain = F.regexp_replace(plain, r"(:[0-9]{2})[.,][0-9]+ ", "$1 ")
    hours, minutes = F.substring(zone, 2, 2).cast("int"), F.regexp_extract(zone, "([0-9]{2})$", 1).cast("int")
    sign = F.when(zone.startswith("-"), 1).otherwise(-1)
    shift = F.when(F.length(zone) > 1, F.make_dt_interval(F.lit(0), sign * hours, sign * minutes, F.lit(0).cast("decimal(18,6)"))).otherwise(F.make_dt_interval())
    part = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.coalesce(F.concat(F.lit("0."), F.substring(F.when(fraction != "", fraction), 1, 6)).cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)")))
    written = F.coalesce(*(F.try_to_timestamp(plain, F.lit(f)).cast("timestamp_ntz") for f in _FORMATS)) + part + shift
    micros = F.when(text.rlike(r"^[0-9]{10}(\.[0-9]+)?$"), (text.cast("decimal(20,6)") * 1000000).cast("long")).when(text.rlike(r"^[0-9]{13}$"), text.cast("long") * 1000)
    return F.coalesce(F.timestamp_micros(micros).cast("timestamp_ntz"), written)


def _with_begin(logs: DataFrame, block: int) -> DataFrame:
    """Each RAW line, once, with the beginning (seq, role) it belongs to and the RAW line before it."""
    # parsed once: the lines are read again for the borders below
    lines = cut(parse_lines(logs)).withColumn("block", F.floor(F.col("seq") / block).cast("long"))
    key = ["log_id", "block"]
    by_seq = Window.partitionBy(*key).orderBy("seq")
    begins = F.col("role").isin("entry", "head", "open")
    # repeated deliveries are copies of their neighbour; only the first counts
    lines = lines.withColumn("again", F.lag("seq").over(by_seq) == F.col("seq")).where(F.coalesce(~F.col("again"), F.lit(True)))
    lines = lines.withColumn("begin", F.last(F.when(begins, F.struct("seq", "role")), ignorenulls=True).over(by_seq))
    lines = lines.withColumn("before", F.lag("seq").over(by_seq)).select(*key, "seq", "role", "time_text", "level", "component", "message", "unparsed", "begin", "before")
    # over block borders: the last beginning of each block, carried to the following ones
    borders = lines.groupBy(*key).agg(F.max("begin").alias("last_begin"), F.max("seq").alias("last_of_block"))
    by_block = Window.partitionBy("log_id").orderBy("block")
    borders = borders.select(
        F.col("log_id").alias("b_log"), F.col("block").alias("b_block"),
        F.last("last_begin", ignorenulls=True).over(by_block.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"),
        F.lag("last_of_block").over(by_block).alias("before_block"),
    )
    joined = lines.join(borders, F.col("log_id").eqNullSafe(F.col("b_log")) & (F.col("block") == F.col("b_block")), "left")
    joined = joined.withColumn("begin", F.coalesce("begin", "carried")).withColumn("before", F.coalesce("before", "before_block"))
    return joined.drop("b_log", "b_block", "carried", "before_block")


def entries(logs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Entries of other programs among the RAW records of each log.

    One row per entry: ``log_id, first_seq, last_seq, lines, time_text, entry_ts, level, component, message, unparsed,
    unparsed_spans``. An entry begins at a header (or the opening of a record over several lines) and takes all RAW records
    of its log up to the next beginning; RAW records before a log's first beginning belong to none. ``level`` is UNKNOWN and
    ``component`` empty where the entry names none. ``unparsed`` are the spans of its first line that no field covers,
    ``unparsed_spans`` counts those of all its lines (``unparsed_spans()`` lists them). Null ``log_id`` counts as a log of its
    own; an empty table gives no entries.
    """
    joined = _with_begin(logs, block).where("begin is not null")
    opened = F.col("begin.role")
    own = F.col("seq") == F.col("begin.seq")
    second = (opened == "head") & (F.col("role") == "level") & (F.col("before") == F.col("begin.seq"))
    inside = (opened == "open") & (F.col("role") == "field")
    told = (opened == "entry") & (F.col("role") == "part")  # the text of a record over several lines
    tells = own | second | inside | told
    pick = lambda c: F.min_by(F.when(tells, F.col(c)), F.when(tells & F.col(c).isNotNull(), F.col("seq"))).alias(c)
    out = joined.groupBy("log_id", F.col("begin.seq").alias("first_seq")).agg(
        F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("lines"), pick("time_text"), pick("level"), pick("component"), pick("message"),
        F.min_by("unparsed", "seq").alias("unparsed"), F.sum(F.size("unparsed")).alias("unparsed_spans"),
    )
    return out.select(
        "log_id", "first_seq", "last_seq", "lines", "time_text", entry_time(F.col("time_text")).alias("entry_ts"),
        F.coalesce("level", F.lit("UNKNOWN")).alias("level"), F.coalesce("component", F.lit("")).alias("component"), "message", "unparsed", "unparsed_spans",
    )


def unparsed_spans(logs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``log_id, first_seq, seq, place, span``: what no field covers of each RAW record, in order, with the entry that it
    belongs to (null before a log's first one)."""
    lines = _with_begin(logs, block)
    return lines.select("log_id", F.col("begin.seq").alias("first_seq"), "seq", F.posexplode("unparsed").alias("place", "span"))
