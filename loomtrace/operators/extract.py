"""Facts of C and C++ sources as tables: functions, calls, asynchronous calls and function references.

A file becomes rows of tokens (one regular expression in the JVM); everything else is windows and groups over a file's
tokens: conditional compilation, matching braces and parentheses, headers of blocks, arguments of calls. A file is the
largest group that any step holds together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions.paths import short_name
from loomtrace.session import cut

# fixed values: words that are no function names
KEYWORDS = (
    "if", "else", "for", "while", "do", "switch", "case", "return", "sizeof", "goto", "break", "continue", "default", "typedef", "struct", "union", "enum",
    "static", "extern", "const", "volatile", "register", "inline", "auto", "_Alignof", "alignof", "_Generic", "_Static_assert", "static_assert", "defined",
    "typeof", "__typeof__", "__typeof", "decltype", "catch", "throw", "new", "delete", "operator", "template", "typename", "using", "namespace", "class",
    "public", "private", "protected", "try", "noexcept", "__attribute__", "__attribute", "__declspec", "__asm__", "asm", "__asm", "alignas", "_Alignas",
    "static_cast", "dynamic_cast", "reinterpret_cast", "const_cast", "va_arg", "offsetof", "__builtin_offsetof", "__builtin_va_arg",
)
NO_REFERENCE = ("NULL", "nullptr", "this", "true", "false")
SOURCE_ENDINGS = (".c", ".cc", ".cpp", ".cxx", ".h", ".hh", ".hpp", ".hxx", ".inl")

_IDENT = r"~?[A-Za-z_]\w*(?:\s*::\s*~?[A-Za-z_]\w*)*"
_DIRECTIVE = r"(?m:^)[ \t]*#(?:[^\n\\]|\\\r?\n|\\.)*"
TOKENS = (
    r"(?s)(//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|" + _DIRECTIVE + r"|[A-Za-z_]\w*(?:\s*::\s*~?[A-Za-z_]\w*)*"
    r"|[0-9](?:[\w.]|(?<=[eEpP])[+-])*|->|::|==|!=|<=|>=|&&|\|\||\n|[ \t\r\f]+|.)"
)
_ZERO = r"^\s*#\s*(?:el)?if\s+(?:0|\(0\)|false)\s*$"


@dataclass(frozen=True)
class AsyncApi:
    """A call that starts, wakes or feeds another task: which argument names the entry, queue or handle (from 0)."""

    name: str
    kind: str
    arg: int
    handle_arg: int | None = None


ASYNC_KINDS = ("thread", "event_send", "queue_send", "queue_receive", "callback_register")
# fixed values: the interfaces of the default configuration
ASYNC_APIS = (
    AsyncApi("OsTaskCreate", "thread", 1, 0), AsyncApi("pthread_create", "thread", 2, 0), AsyncApi("std::thread", "thread", 0), AsyncApi("xTaskCreate", "thread", 0, 5),
    AsyncApi("osThreadNew", "thread", 0), AsyncApi("OsEventSend", "event_send", 0), AsyncApi("OsMsgQSend", "queue_send", 0), AsyncApi("OsMsgQReceive", "queue_receive", 0),
    AsyncApi("mq_send", "queue_send", 0), AsyncApi("mq_receive", "queue_receive", 0), AsyncApi("xQueueSend", "queue_send", 0), AsyncApi("xQueueReceive", "queue_receive", 0),
)


def _active(directives: Column) -> Column:
    """Whether the text behind each directive is compiled: the first branch of a conditional is, but not under ``#if 0``."""
    stack_t = "array<struct<on:boolean,taken:boolean>>"

    def step(acc: Column, d: Column) -> Column:
        word = F.regexp_extract(d, r"^\s*#\s*(\w+)", 1)
        zero = F.regexp_replace(d, r"(?s)/\*.*?\*/|//.*", "").rlike(_ZERO)
        stack = acc["stack"]
        n = F.size(stack)
        below = F.slice(stack, 1, F.greatest(n - 1, F.lit(0)))
        taken = F.coalesce(F.get(stack, n - 1)["taken"], F.lit(True))
        entry = lambda on, tk: F.array(F.struct(on.alias("on"), tk.alias("taken")))
        new = (
            F.when(word.isin("if", "ifdef", "ifndef"), F.concat(stack, entry(~((word == "if") & zero), ~((word == "if") & zero))))
            .when(n == 0, stack)
            .when(word == "elif", F.concat(below, entry(~taken & ~zero, taken | ~zero)))
            .when(word == "else", F.concat(below, entry(~taken, F.lit(True))))
            .when(word == "endif", below)
            .otherwise(stack)
        )
        return F.struct(new.cast(stack_t).alias("stack"), F.concat(acc["out"], F.array(F.forall(new, lambda x: x["on"]))).alias("out"))

    start = F.struct(F.array().cast(stack_t).alias("stack"), F.array().cast("array<boolean>").alias("out"))
    return F.aggregate(directives, start, step, lambda acc: acc["out"])


def tokens(files: DataFrame) -> DataFrame:
    """``path, i, tok, line``: the tokens that are compiled, without comments, directives and blanks; literals as ``"``.

    Files without path or content have none; a path that comes with several contents is read with the smallest of them.
    """
    c = F.col
    once = files.where("path is not null and content is not null").groupBy("path").agg(F.min("content").alias("content"))
    once = once.where(F.lower("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in SOURCE_ENDINGS) + ")$"))
    text = F.regexp_replace(F.regexp_replace("content", "^\\ufeff", ""), "\r\n?", "\n")
    raw = once.select("path", F.regexp_extract_all(text, F.lit(TOKENS), F.lit(1)).alias("all"))
    is_dir = lambda x: x.rlike(r"^\s*#")
    flags = _active(F.filter("all", is_dir))
    raw = raw.withColumn("flags", flags)
    rows = raw.select("path", "flags", F.posexplode("all").alias("i", "tok"))
    by = Window.partitionBy("path").orderBy("i")
    lines = F.length("tok") - F.length(F.replace("tok", F.lit("\n"), F.lit("")))
    rows = rows.withColumn("line", (1 + F.coalesce(F.sum(lines).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("int"))
    rows = rows.withColumn("n_dir", F.count(F.when(is_dir(c("tok")), 1)).over(by))
    rows = rows.withColumn("on", F.when(c("n_dir") == 0, True).otherwise(F.get("flags", (c("n_dir") - 1).cast("int"))))
    keep = c("on") & ~is_dir(c("tok")) & ~c("tok").rlike(r"(?s)^\s+$|^//|^/\*")
    tok = F.when(c("tok").rlike("^[\"']"), "\"").when(c("tok").rlike(r"^[A-Za-z_]"), F.regexp_replace("tok", r"\s+", "")).otherwise(c("tok"))
    return rows.where(keep).select("path", "i", tok.alias("tok"), "line")


def _kinds(head: Column) -> Column:
    """What a block is by the text before its brace: ns, class, function or other."""
    words = "|".join(KEYWORDS)
    ns = head.rlike(r"(?:^|\s)(?:inline )?namespace(?: [\w:]+)?$") | head.rlike(r"extern \"$")
    aggregate = ~head.contains("(") & head.rlike(r"(?:^|[\s;])(?:class|struct|union) [A-Za-z_][\w:]*(?: final)?(?: : .*)?$")
    call = head.rlike(r"^[^=\[\]()]*?(?:^|[\s*&])" + _IDENT + r" \(")
    word = head.rlike(r"^[^()]*?(?:^|[\s*&:])(?:" + words + r") \(")
    end = head.rlike(r"\)(?: (?:const|volatile|override|final|noexcept|try|&|&&))*(?: -> [\w:<>,*& ]+)?(?: : .*[)}])?$")
    enum = head.rlike(r"(?:^|\s)enum\b")
    return F.when(ns, "ns").when(aggregate, "class").when(call & ~word & end & ~enum, "function").otherwise("other")


def structure(files: DataFrame) -> DataFrame:
    """Tokens with their block: ``path, i, tok, line, prev, prev2, next, top, fi, body``.

    ``fi`` numbers the functions of a file (from 0) and is null outside; ``body`` says whether a token lies in a block at all.
    """
    c = F.col
    t = tokens(files)
    by = Window.partitionBy("path").orderBy("i")
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    bound = c("tok").isin("{", "}", ";")
    t = t.withColumn("stmt", F.count(F.when(bound, 1)).over(upto))
    t = t.withColumn("after", F.sum(F.when(c("tok") == "{", 1).when(c("tok") == "}", -1).otherwise(0)).over(by))
    t = t.withColumns({"prev": F.lag("tok").over(by), "prev2": F.lag("tok", 2).over(by), "prev3": F.lag("tok", 3).over(by), "next": F.lead("tok").over(by)})
    t = cut(t)
    # headers only of statements that open a block
    opens = t.where("tok = '{'").select(c("path").alias("o_path"), c("stmt").alias("o_stmt"))
    heads = t.where("tok <> '{'").join(opens, (c("path") == c("o_path")) & (c("stmt") == c("o_stmt")), "left_semi").groupBy("path", "stmt").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "tok"))), lambda x: x["tok"]), " ").alias("head")
    )
    heads = heads.withColumn("head", F.regexp_replace("head", r"^(?:public|private|protected) : ", ""))
    heads = heads.withColumn("head", F.regexp_replace("head", r"(?:__attribute__|__attribute|__declspec|alignas|_Alignas) \((?: \([^()]*\)|[^()])* \) ?", ""))
    heads = heads.select(c("path").alias("h_path"), c("stmt").alias("h_stmt"), "head", _kinds(c("head")).alias("kind"))
    t = t.join(heads, (c("path") == c("h_path")) & (c("stmt") == c("h_stmt")) & (c("tok") == "{"), "left").drop("h_path", "h_stmt")
    kind = F.when(c("tok") == "{", F.coalesce("kind", F.lit("other")))
    level = F.when(c("tok") == "{", c("after")).when(c("tok") == "}", c("after") + 1)
    t = t.withColumn("level", level).withColumn("kind", F.coalesce(kind, F.last(kind, ignorenulls=True).over(Window.partitionBy("path", "level").orderBy("i"))))
    closed = F.when(c("level").isNotNull() & ~c("kind").isin("ns", "class"), F.when(c("tok") == "{", 1).otherwise(-1)).otherwise(0)
    t = t.withColumn("closed", F.sum(closed).over(by))
    top = (c("tok") == "{") & (c("closed") == 1) & ~c("kind").isin("ns", "class")
    t = t.withColumn("top", F.coalesce(top, F.lit(False)))
    t = t.withColumn("fi", F.count(F.when(c("top") & (c("kind") == "function"), 1)).over(by) - 1)
    inside = F.last(F.when(c("top"), c("kind")), ignorenulls=True).over(by)
    t = t.withColumn("body", c("closed") > 0).withColumn("fi", F.when((c("closed") > 0) & (inside == "function"), c("fi").cast("int")))
    return cut(t)


def functions(s: DataFrame) -> DataFrame:
    """``path, fi, name, start_line, end_line, is_static, params``: the functions defined in each file, in order.

    Names of members carry their classes; the first line is that of the name, the last that of the closing brace.
    """
    c = F.col
    opens = s.where("top and kind = 'function'").select("path", "fi", "i", "stmt", "after", "head")
    lead = r"^([^=\[\]()]*?)(" + _IDENT + r") \("
    opens = opens.withColumn("name", F.regexp_extract("head", lead, 2)).withColumn("is_static", F.regexp_extract("head", lead, 1).rlike(r"\bstatic\b"))
    opens = opens.withColumn("params", F.trim(F.regexp_replace(F.regexp_extract("head", lead + r"((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)", 3), r"\s+", " ")))
    # the classes around: of each level of braces the block opened last, where it is a class's
    cname = r"(?:class|struct|union) (?:[A-Z_]+_API )*([A-Za-z_]\w*)(?: final)?(?: : .*)?$"
    blocks = s.where("tok = '{'").select("path", "level", "i", F.lit(None).cast("int").alias("fi"), F.struct(c("i").alias("at"), F.when(c("kind") == "class", F.regexp_extract("head", cname, 1)).alias("cls")).alias("block"))
    asked = opens.where("after > 1").select("path", F.explode(F.sequence(F.lit(1), c("after") - 1)).alias("level"), "i", "fi", F.lit(None).cast("struct<at:int,cls:string>").alias("block"))
    by_level = Window.partitionBy("path", "level").orderBy("i")
    around = blocks.unionByName(asked).withColumn("block", F.last("block", ignorenulls=True).over(by_level)).where("fi is not null and block.cls is not null").groupBy("path", "fi").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("block")), lambda x: x["cls"]), "::").alias("prefix")
    )
    around = around.select(c("path").alias("a_path"), c("fi").alias("a_fi"), "prefix")
    # the name's last place in the header, and the block's end
    named = s.select(c("path").alias("n_path"), c("stmt").alias("n_stmt"), c("tok").alias("n_tok"), c("i").alias("n_i"), c("line").alias("n_line")).where(c("n_tok").rlike(r"^~?[A-Za-z_]"))
    bare = lambda x: F.regexp_replace(short_name(x), "^~", "")
    first = opens.join(named, (c("path") == c("n_path")) & (c("stmt") == c("n_stmt")) & (bare(c("n_tok")) == bare(c("name"))) & (c("n_i") < c("i")))
    first = first.groupBy(c("path").alias("f_path"), c("fi").alias("f_fi")).agg(F.max("n_line").alias("start_line"))
    # the first closing brace behind an opening one, read backwards
    shut = s.where("tok = '}' and closed = 0 and kind not in ('ns', 'class')").select("path", F.lit(None).cast("int").alias("fi"), "i", c("line").alias("e_line"))
    back = Window.partitionBy("path").orderBy(F.desc("i"))
    both = shut.unionByName(opens.select("path", "fi", "i", F.lit(None).cast("int").alias("e_line")))
    last = both.withColumn("end_line", F.last("e_line", ignorenulls=True).over(back)).where("fi is not null").select(c("path").alias("l_path"), c("fi").alias("l_fi"), "end_line")
    out = opens.join(around, (c("path") == c("a_path")) & (c("fi") == c("a_fi")), "left").join(first, (c("path") == c("f_path")) & (c("fi") == c("f_fi")), "left").join(last, (c("path") == c("l_path")) & (c("fi") == c("l_fi")))
    name = F.when(c("prefix").isNotNull() & ~c("name").contains("::"), F.concat("prefix", F.lit("::"), "name")).otherwise(c("name"))
    return out.select("path", "fi", name.alias("name"), "start_line", "end_line", "is_static", "params")


def _groups(s: DataFrame) -> DataFrame:
    """Tokens by the innermost parentheses they stand in: ``path, open, i, tok, arg``, ``arg`` from 0 by top-level commas."""
    c = F.col
    by = Window.partitionBy("path").orderBy("i")
    p = s.select("path", "i", "tok", F.sum(F.when(c("tok") == "(", 1).when(c("tok") == ")", -1).otherwise(0)).over(by).alias("p"))
    open_, close = c("tok") == "(", c("tok") == ")"
    roles = F.when(open_, F.array(F.struct(F.lit("open").alias("role"), c("p").alias("lvl")), F.struct(F.lit("in").alias("role"), (c("p") - 1).alias("lvl"))))
    roles = roles.when(close, F.array(F.struct(F.lit("close").alias("role"), (c("p") + 1).alias("lvl")), F.struct(F.lit("in").alias("role"), c("p").alias("lvl"))))
    roles = roles.otherwise(F.array(F.struct(F.lit("in").alias("role"), c("p").alias("lvl"))))
    r = p.select("path", "i", "tok", F.explode(roles).alias("r")).select("path", "i", "tok", "r.role", "r.lvl").where("lvl > 0")
    w = Window.partitionBy("path", "lvl").orderBy("i", F.when(c("role") == "open", 0).otherwise(1))
    r = r.withColumn("open", F.last(F.when(c("role") == "open", c("i")), ignorenulls=True).over(w)).where("role <> 'open' and open is not null")
    g = Window.partitionBy("path", "open").orderBy("i")
    depth = F.sum(F.when(c("tok").isin("[", "{"), 1).when(c("tok").isin("]", "}"), -1).otherwise(0)).over(g)
    r = r.withColumn("deep", depth)
    comma = (c("tok") == ",") & (c("deep") == 0) & (c("role") == "in")
    return r.withColumn("comma", comma).withColumn("arg", F.count(F.when(comma, 1)).over(g).cast("int"))


def _braced_threads(s: DataFrame) -> DataFrame:
    """The braces of ``std::thread t{f}`` and ``std::thread{f}`` as parentheses."""
    c = F.col
    is_thread = lambda x: x.isin("std::thread", "std::jthread")
    begins = is_thread(c("prev")) | is_thread(c("prev2")) & c("prev").rlike(r"^[A-Za-z_]\w*$")
    if_brace = s.where("tok in ('{', '}')").withColumn("t", F.last(F.when(c("tok") == "{", F.coalesce(begins, F.lit(False))), ignorenulls=True).over(Window.partitionBy("path", "level").orderBy("i")))
    swap = if_brace.where("t").select(c("path").alias("w_path"), c("i").alias("w_i"), F.when(c("tok") == "{", "(").otherwise(")").alias("w_tok"))
    return s.join(swap, (c("path") == c("w_path")) & (c("i") == c("w_i")), "left").withColumn("tok", F.coalesce("w_tok", "tok")).drop("w_path", "w_i", "w_tok")


def _templated(s: DataFrame) -> DataFrame:
    """``path, i, open``: names with template arguments between them and the parenthesis of their call, ``f<int>(1)``."""
    c = F.col
    with_sign = s.where("tok = '<'").select(c("path").alias("s_path"), c("stmt").alias("s_stmt")).distinct()
    t = s.join(with_sign, (c("path") == c("s_path")) & (c("stmt") == c("s_stmt")), "left_semi").select("path", "stmt", "i", "tok", "next")
    w = Window.partitionBy("path", "stmt").orderBy("i")
    t = t.withColumn("next_i", F.lead("i").over(w))
    sign = F.when(c("tok").isin("<", ">", "(", ")", "{", "}", ";"), F.struct("tok", "next", "next_i"))
    behind = Window.partitionBy("path", "stmt").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("sign", F.last(sign, ignorenulls=True).over(behind))
    closed = F.when((c("tok") == "<") & (c("sign.tok") == ">") & (c("sign.next") == "("), c("sign.next_i"))
    t = t.withColumn("open", F.lead(closed).over(w))
    return t.where(c("tok").rlike(r"^~?[A-Za-z_]") & c("open").isNotNull()).select("path", "i", "open")


def arguments(s: DataFrame) -> DataFrame:
    """``path, open, arg, text``: each argument's tokens, what stands in further parentheses left out."""
    g = _groups(s).where("role = 'in' and not comma")
    return g.groupBy("path", "open", "arg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "tok"))), lambda x: x["tok"]), " ").alias("text"))


def key_of(text: Column) -> Column:
    """A queue's or handle's name in an argument: its last identifier, casts and indices apart."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\[[^\]]*\]", ""), r"^(?:\( \) ?)+", "")
    return F.get(F.regexp_extract_all(bare, F.lit(r"([A-Za-z_]\w*)"), F.lit(1)), F.size(F.regexp_extract_all(bare, F.lit(r"([A-Za-z_]\w*)"), F.lit(1))) - 1)


def function_in(text: Column) -> Column:
    """The function that an argument names, behind casts and ``&``; null where it is more or less than a name."""
    name = F.regexp_extract(text, r"^(?:\( \) )*(?:& )?(?:\( \) )*([A-Za-z_][\w:]*)$", 1)
    return F.when((name != "") & ~name.isin(*KEYWORDS, *NO_REFERENCE), name)


def facts(files: DataFrame, apis: tuple[AsyncApi, ...] = ASYNC_APIS) -> dict[str, DataFrame]:
    """The four fact tables of sources: ``functions`` (see above), ``calls``, ``async_calls``, ``refs``.

    calls: ``path, fi, i, line, name, kind`` with kind direct, field or pointer (a call of a parameter is one of a pointer).
    async_calls: ``path, fi, i, line, api, kind, target, key, handle``. refs: ``path, fi, i, line, name, field_name, via_call,
    rank``; fi is null at file scope. A call of an asynchronous interface is that and nothing else.
    """
    bad = [a for a in apis if a.kind not in ASYNC_KINDS]
    if bad:
        raise ValueError(f"unknown kind of asynchronous interface: {bad[0].kind}")
    c = F.col
    s = structure(files)
    fs = cut(functions(s))
    s = cut(_braced_threads(s))
    spark = files.sparkSession
    inside = s.where("fi is not null and not top")
    is_name = c("tok").rlike(r"^~?[A-Za-z_]")
    named = inside.where(is_name & (c("next") == "(") & ~short_name(c("tok")).isin(*KEYWORDS))
    named = named.select("path", "fi", c("i").alias("i"), "line", c("tok").alias("name"), F.when(c("prev").isin("->", "."), "field").otherwise("direct").alias("kind"))
    # each name's parenthesis: the next opening one
    opens = s.where("tok = '('").select(c("path").alias("o_path"), c("i").alias("open"), "prev")
    after = Window.partitionBy("path").orderBy("i")
    place = s.select("path", "i", F.lead("i").over(after).alias("open")).select(c("path").alias("p_path"), c("i").alias("p_i"), "open")
    named = named.join(place, (c("path") == c("p_path")) & (c("i") == c("p_i"))).drop("p_path", "p_i")
    shaped = _templated(s).withColumnsRenamed({"path": "p_path", "i": "p_i"})
    shaped = inside.where(~short_name(c("tok")).isin(*KEYWORDS)).join(shaped, (c("path") == c("p_path")) & (c("i") == c("p_i")))
    named = named.unionByName(shaped.select("path", "fi", "i", "line", c("tok").alias("name"), F.when(c("prev").isin("->", "."), "field").otherwise("direct").alias("kind"), "open"))
    # (*f)(…) and (*x->f)(…)
    g = cut(_groups(s))
    deref = g.where("role = 'in'").groupBy("path", "open").agg(
        F.min_by("tok", "i").alias("first"), F.max_by("tok", F.when(is_name, c("i"))).alias("name"), F.max(c("tok").isin("->", ".")).alias("member"),
        F.bool_and(is_name | c("tok").isin("*", "->", ".", "[", "]") | c("tok").rlike("^[0-9]")).alias("plain"),
    )
    ends = g.where("role = 'close'").select(c("path").alias("g_path"), c("open").alias("g_open"), c("i").alias("end"))
    deref = deref.where("first = '*' and name is not null and plain").join(ends, (c("path") == c("g_path")) & (c("open") == c("g_open"))).select("path", "name", "member", "end")
    called = inside.where("tok = ')' and next = '('").select(c("path").alias("e_path"), c("i").alias("e_i"), "fi", "line")
    pointers = deref.join(called, (c("path") == c("e_path")) & (c("end") == c("e_i"))).select(
        "path", "fi", c("end").alias("i"), "line", F.get(F.split("name", "::"), F.lit(0)).alias("name"), F.when(c("member"), "field").otherwise("pointer").alias("kind"), c("end").alias("before")
    )
    pointers = pointers.join(place, (c("path") == c("p_path")) & (c("before") == c("p_i"))).select("path", "fi", "i", "line", "name", "kind", "open")
    calls = cut(named.unionByName(pointers))
    spec = spark.createDataFrame([(a.name, a.kind, a.arg, a.handle_arg) for a in apis] or [("", "", 0, None)], "api string, a_kind string, arg int, handle_arg int")
    args = cut(g.where("role = 'in' and not comma").groupBy("path", "open", "arg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "tok"))), lambda x: x["tok"]), " ").alias("text")))
    arg_of = lambda n: args.select(c("path").alias(f"{n}_path"), c("open").alias(f"{n}_open"), c("arg").alias(f"{n}_arg"), c("text").alias(f"{n}_text"))
    # std::thread t(f), t{f} and std::thread{f}: the variable's name may stand between, and braces for parentheses
    is_thread = lambda x: x.isin("std::thread", "std::jthread")
    threads = inside.where(is_thread(c("prev")) & is_name & c("next").isin("(", "{") | is_thread(c("tok")) & (c("next") == "{"))
    of_thread = threads.join(place, (c("path") == c("p_path")) & (c("i") == c("p_i"))).select("path", "fi", "i", "line", F.lit("std::thread").alias("name"), F.lit("direct").alias("kind"), "open")
    wanted = calls.unionByName(of_thread).join(F.broadcast(spec), c("name") == c("api"))  # the configured interfaces
    a = wanted.join(arg_of("a"), (c("path") == c("a_path")) & (c("open") == c("a_open")) & (c("arg") == c("a_arg")))
    a = a.join(arg_of("h"), (c("path") == c("h_path")) & (c("open") == c("h_open")) & (c("handle_arg") == c("h_arg")), "left")
    starts = c("a_kind").isin("thread", "callback_register")
    async_calls = a.select(
        "path", "fi", "i", "line", "api", c("a_kind").alias("kind"), F.when(starts, function_in(c("a_text"))).alias("target"), F.when(~starts, key_of(c("a_text"))).alias("key"), F.when(starts, key_of(c("h_text"))).alias("handle")
    ).where("target is not null or key is not null")
    plain = calls.join(F.broadcast(spec.select(c("api").alias("known"))), c("name") == c("known"), "left_anti")
    params = fs.select(c("path").alias("f_path"), c("fi").alias("f_fi"), "params")
    plain = plain.join(params, (c("path") == c("f_path")) & (c("fi") == c("f_fi")), "left")
    is_param = F.array_contains(F.regexp_extract_all(F.coalesce("params", F.lit("")), F.lit(r"(\w+)"), F.lit(1)), c("name"))
    out_calls = plain.select("path", "fi", "i", "line", "name", F.when((c("kind") == "direct") & is_param, "pointer").otherwise(c("kind")).alias("kind"), "open")
    arg_refs = out_calls.join(arg_of("a"), (c("path") == c("a_path")) & (c("open") == c("a_open"))).select(
        "path", "fi", "i", "line", function_in(c("a_text")).alias("name"), F.lit(None).cast("string").alias("field_name"), c("name").alias("via_call"), F.lit(0).alias("rank"), c("a_arg").alias("sub")
    ).where("name is not null")
    # assignments: skip one & or cast between = and the name
    after_eq = (c("prev") == "=") | ((c("prev") == "&") & (c("prev2") == "="))
    target = s.where(is_name & after_eq & ~c("tok").isin(*KEYWORDS, *NO_REFERENCE))
    before = Window.partitionBy("path").orderBy("i")
    spots = s.select("path", "i", *(F.lag("tok", n).over(before).alias(f"b{n}") for n in (1, 2, 3, 4))).select(c("path").alias("s_path"), c("i").alias("s_i"), "b1", "b2", "b3", "b4")
    target = target.join(spots, (c("path") == c("s_path")) & (c("i") == c("s_i")))
    amp = c("b1") == "&"
    name_before, sign_before = F.when(amp, c("b3")).otherwise(c("b2")), F.when(amp, c("b4")).otherwise(c("b3"))
    is_field = sign_before.isin(".", "->") & name_before.rlike(r"^[A-Za-z_]\w*$")
    fields = target.where(is_field & c("next").isin(";", ",", "}", ")")).select("path", "fi", "body", "i", "line", c("tok").alias("name"), name_before.alias("field_name"), F.lit(1).alias("rank"))
    assigns = target.where(c("next").isin(";", ",", "}")).select("path", "fi", "body", "i", "line", c("tok").alias("name"), F.lit(None).cast("string").alias("field_name"), F.lit(2).alias("rank"))
    listed = s.where(is_name & c("fi").isNull() & (c("prev").isin("{", ",") | ((c("prev") == "&") & c("prev2").isin("{", ","))) & c("next").isin(",", "}") & ~c("tok").isin(*KEYWORDS, *NO_REFERENCE))
    listed = listed.select("path", "fi", "body", "i", "line", c("tok").alias("name"), F.lit(None).cast("string").alias("field_name"), F.lit(3).alias("rank"))
    value_refs = fields.unionByName(assigns).unionByName(listed).select("path", "fi", "i", "line", "name", "field_name", F.lit(None).cast("string").alias("via_call"), "rank", F.lit(0).alias("sub"))
    return {"functions": fs, "calls": out_calls.drop("open"), "async_calls": async_calls, "refs": arg_refs.unionByName(value_refs)}


def merge_units(x: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Fact tables of several analyses of one file (column ``unit``, the first counts) as those of one.

    A function is known by its name and first line: the first unit that has it gives it and its calls; references at file
    scope are kept of every unit. The functions of a path are numbered anew in the order units and numbers give.
    """
    c = F.col
    fs = x["functions"]
    key = Window.partitionBy("path", "name", "start_line").orderBy("unit", "fi")
    first = fs.withColumn("_n", F.row_number().over(key)).where("_n = 1").drop("_n")
    first = cut(first.withColumn("new_fi", F.row_number().over(Window.partitionBy("path").orderBy("unit", "fi")) - 1))
    ids = first.select(c("path").alias("m_path"), c("unit").alias("m_unit"), c("fi").alias("m_fi"), "new_fi")
    on = (c("path") == c("m_path")) & (c("unit") == c("m_unit")) & (c("fi") == c("m_fi"))
    out = {"functions": first.withColumn("fi", c("new_fi")).drop("new_fi", "unit")}
    for name in ("calls", "async_calls", "refs"):
        kept = x[name].join(ids, on).withColumn("fi", c("new_fi")).drop("m_path", "m_unit", "m_fi", "new_fi", "unit")
        if name == "refs":
            kept = kept.unionByName(x[name].where("fi is null").drop("unit"))
        out[name] = kept
    return out
