"""Source facts to a call graph: ids, name resolution, callbacks, function pointers, queues and events, as joins.

Edges carry an ordinal made of the building order (references and task starts, then calls, events, queues; files by
path, places within a file), on which the choice among edges of one pair depends.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.paths import EXCLUDE_CALLEES, ModuleRules, any_glob, earliest, nearest, prefixes, short_name, unique_suffixes
from loomtrace.operators.extract import ASYNC_APIS, AsyncApi, facts
from loomtrace.operators.graph import UNRESOLVED, dense_ids, rank
from loomtrace.session import cut

# fixed values: endings of headers and of C++ files, and how many functions a field may name before it says nothing
HEADERS = r"(?i)\.(?:h|hh|hpp|hxx|inl)$"
CXX = r"(?i)\.(?:cc|cpp|cxx|hpp|hh|hxx)$"
MAX_FIELD_TARGETS = 12


@dataclass
class CallGraph:
    """``functions``: as source_functions; ``edges``: one per pair, as call_edges; ``all_edges``: before that choice."""

    functions: DataFrame
    edges: DataFrame
    all_edges: DataFrame


def function_table(fs: DataFrame, rules: ModuleRules | None = None) -> tuple[DataFrame, DataFrame]:
    """(functions, local): one row per function id, the first of each; and the id of every (path, fi)."""
    r = rules or ModuleRules()
    c = F.col
    suffix = unique_suffixes(fs, "path").withColumnRenamed("path", "s_path")
    ids = fs.join(suffix, c("path") == c("s_path")).withColumn("function_id", F.concat("suffix", F.lit("::"), "name"))
    ids = cut(ids.drop("s_path", "suffix"))
    first = earliest(ids, ["function_id"], ["path", "fi"])
    table = dense_ids(first, ["path", "fi"], "ord").select("function_id", "name", c("path").alias("file_path"), "start_line", "end_line", "is_static", r.for_path(c("path")).alias("module"), "ord")
    return cut(table), ids.select("path", "fi", "function_id", "name")


def resolve_names(asked: DataFrame, functions: DataFrame) -> DataFrame:
    """Adds ``target``: the function that a name means at a place. ``asked``: ``path, name, ctx_name``.

    Candidates: the name itself; else, inside a member function, the member of that class; else, for qualified names, any
    member of that last name. The first kind that has candidates decides: of those the one in the same file, else of
    those that are visible (not static, or in a header) the one with the longest common path. Else null.
    """
    c = F.col
    f = functions.select(c("function_id").alias("fid"), c("name").alias("fname"), c("file_path").alias("path"), (~c("is_static") | c("file_path").rlike(HEADERS)).alias("visible"), c("ord").alias("ford"))
    index = f.withColumn("key", F.explode(F.array_compact(F.array(c("fname"), F.when(c("fname").contains("::"), F.concat(F.lit("*::"), short_name(c("fname"))))))))
    # each name is looked up once per file and class
    once = asked.select(c("path").alias("q_path"), c("name").alias("q_name"), c("ctx_name").alias("q_ctx")).distinct()
    name = F.regexp_replace("q_name", "^:+", "")
    cls = F.when(c("q_ctx").contains("::") & ~name.contains("::"), F.concat(F.regexp_replace("q_ctx", r"::[^:]*$", ""), F.lit("::"), name))
    last = F.when(name.contains("::"), F.concat(F.lit("*::"), short_name(name)))
    tries = F.posexplode(F.array(name, cls, last)).alias("tier", "key")
    keys = once.select("*", tries).where("key is not null").withColumnRenamed("q_path", "path")
    any_ = index.select(c("key").alias("a_key")).distinct()
    here = index.groupBy(c("key").alias("h_key"), c("path").alias("h_path")).agg(F.min(F.struct("ford", "fid")).alias("own"))
    far = nearest(keys, index.where("visible"), ["ford", "fid"]).withColumnsRenamed({"key": "n_key", "path": "n_path"})
    hit = keys.join(any_, c("key") == c("a_key")).join(here, (c("key") == c("h_key")) & (c("path") == c("h_path")), "left").join(far, (c("key") == c("n_key")) & (c("path") == c("n_path")), "left")
    best = hit.groupBy("path", "q_name", "q_ctx").agg(F.min_by(F.struct(F.coalesce("own.fid", "best.fid").alias("target")), "tier").alias("m"))
    best = best.select(c("path").alias("b1"), c("q_name").alias("b2"), c("q_ctx").alias("b3"), c("m.target").alias("target"))
    return asked.join(best, (c("path") == c("b1")) & (c("name") == c("b2")) & c("ctx_name").eqNullSafe(c("b3")), "left").drop("b1", "b2", "b3")


def resolve_methods(asked: DataFrame, functions: DataFrame) -> DataFrame:
    """Adds ``method``: the member function of that last name with the longest common path. ``asked``: ``path, name``."""
    c = F.col
    f = functions.where(c("name").contains("::")).select(short_name(c("name")).alias("key"), c("file_path").alias("path"), "ord", "function_id")
    best = nearest(asked.withColumn("key", c("name")), f, ["ord", "function_id"]).select(c("key").alias("b1"), c("path").alias("b2"), c("best.function_id").alias("method"))
    return asked.join(best, (c("name") == c("b1")) & (c("path") == c("b2")), "left").drop("b1", "b2")


def _ctx(df: DataFrame, local: DataFrame, functions: DataFrame) -> DataFrame:
    """Adds the caller's id and name (of the first function with that id) and its file."""
    c = F.col
    loc = local.select(c("path").alias("l_path"), c("fi").alias("l_fi"), c("function_id").alias("ctx"))
    f = functions.select(c("function_id").alias("c_id"), c("name").alias("ctx_name"), c("file_path").alias("ctx_path"))
    return df.join(loc, (c("path") == c("l_path")) & (c("fi") == c("l_fi")), "left").join(f, c("ctx") == c("c_id"), "left").drop("l_path", "l_fi", "c_id")


def nearest_receivers(senders: DataFrame, receivers: DataFrame) -> DataFrame:
    """Each sender with the receivers of its key whose files share the longest path with its own, ties all: ``senders``
    has ``key, ctx, ctx_path``, ``receivers`` ``key, ctx, ctx_path, pos``."""
    c = F.col
    r = receivers.select(c("key").alias("r_key"), c("ctx").alias("r_ctx"), c("pos").alias("r_pos"), F.explode(prefixes(c("ctx_path"))).alias("r_prefix"))
    places = r.select("r_key", "r_prefix").distinct()
    ways = senders.select(c("key").alias("w_key"), c("ctx_path").alias("w_path")).distinct().select("w_key", "w_path", F.posexplode(prefixes(c("w_path"))).alias("shared", "prefix"))
    best = ways.join(places, (c("w_key") == c("r_key")) & (c("prefix") == c("r_prefix"))).groupBy("w_key", "w_path").agg(F.max_by("prefix", "shared").alias("prefix"))
    found = senders.join(best, (c("key") == c("w_key")) & (c("ctx_path") == c("w_path"))).join(r, (c("key") == c("r_key")) & (c("prefix") == c("r_prefix")))
    return found.where("r_ctx <> ctx").drop("w_key", "w_path", "prefix", "r_key", "r_prefix")


def build(files: DataFrame, rules: ModuleRules | None = None, apis: tuple[AsyncApi, ...] = ASYNC_APIS, exclude: tuple[str, ...] = EXCLUDE_CALLEES) -> CallGraph:
    """The call graph of source files (``path, content``)."""
    return graph_of(facts(files, apis), rules, exclude)


def graph_of(x: dict[str, DataFrame], rules: ModuleRules | None = None, exclude: tuple[str, ...] = EXCLUDE_CALLEES) -> CallGraph:
    """The call graph of fact tables (see ``extract.facts``)."""
    c = F.col
    table, local = function_table(x["functions"], rules)
    none_s = F.lit(None).cast("string")

    def edge(df: DataFrame, caller: str, callee: Column, kind: Column | str, via: Column, phase: int) -> DataFrame:
        k = F.lit(kind) if isinstance(kind, str) else kind
        at = F.struct(F.lit(phase).alias("phase"), c("path").alias("path"), F.coalesce(c("fi"), F.lit(1 << 30)).alias("fi"), F.coalesce(c("rank"), F.lit(0)).alias("rank"), c("i").alias("i"), F.coalesce(c("sub").cast("string"), F.lit("")).alias("sub"))
        return df.select(c(caller).alias("caller"), callee.alias("callee"), k.alias("kind"), c("line").alias("line"), via.alias("via"), at.alias("at"))

    # references
    refs = cut(_ctx(x["refs"], local, table))
    refs = cut(resolve_names(refs, table).where("target is not null"))
    fields = refs.where("field_name is not null").select("field_name", c("target").alias("f_target")).distinct()
    via = F.concat(F.lit("register:"), F.coalesce("via_call", F.when(c("field_name").isNotNull(), F.concat(F.lit("field:"), c("field_name"))), F.lit("assign")))
    out = [edge(refs.where("ctx is not null and ctx <> target"), "ctx", c("target"), "CALLBACK", via, 1)]
    # task starts and registrations
    a = cut(_ctx(x["async_calls"], local, table).withColumn("rank", F.lit(4)).withColumn("sub", F.lit(0)))
    starts = a.where("kind in ('thread', 'callback_register') and target is not null and ctx is not null").withColumn("name", c("target")).drop("target")
    starts = cut(resolve_names(starts, table).where("target is not null"))
    out.append(edge(starts, "ctx", c("target"), F.when(c("kind") == "thread", "ASYNC").otherwise("CALLBACK"), c("api"), 1))
    handles = starts.where("handle is not null").select(c("handle").alias("h"), c("target").alias("h_target")).distinct()
    # calls
    calls = cut(_ctx(x["calls"], local, table).where("ctx is not null").withColumn("rank", F.lit(0)).withColumn("sub", F.lit("")))
    direct = resolve_names(calls.where("kind = 'direct'"), table).where("target is not null")
    out.append(edge(direct, "ctx", c("target"), "SYNC", none_s, 2))
    indirect = calls.where("kind <> 'direct'")
    cxx = (c("kind") == "field") & c("path").rlike(CXX)
    indirect = resolve_methods(indirect, table).withColumn("method", F.when(cxx, c("method")))
    out.append(edge(indirect.where("method is not null"), "ctx", c("method"), "SYNC", none_s, 2))
    targets = fields.groupBy(c("field_name").alias("t_field")).agg(F.count(F.lit(1)).alias("n"))
    rest = cut(indirect.where("method is null").join(targets, (c("name") == c("t_field")) & (c("kind") == "field"), "left").where(~cxx | c("n").isNotNull()))
    known = rest.where(c("n") <= MAX_FIELD_TARGETS)
    pointed = known.join(fields, c("name") == c("field_name")).where("f_target <> ctx").withColumn("sub", c("f_target"))
    out.append(edge(pointed, "ctx", c("f_target"), "CALLBACK", F.concat(F.lit("field:"), c("name")), 2))
    unknown = rest.where(c("n").isNull() | (c("n") > MAX_FIELD_TARGETS))
    out.append(edge(unknown, "ctx", F.lit(UNRESOLVED), "SYNC", F.concat("kind", F.lit(":"), "name"), 2))
    # events and queues
    events = a.where("kind = 'event_send' and key is not null and ctx is not null").join(handles, c("key") == c("h")).where("h_target <> ctx").withColumn("sub", c("h_target"))
    out.append(edge(events, "ctx", c("h_target"), "ASYNC", F.concat("api", F.lit(":"), "key"), 3))
    send = a.where("kind = 'queue_send' and key is not null and ctx is not null")
    receive = a.where("kind = 'queue_receive' and key is not null and ctx is not null").select("key", "ctx", "ctx_path", F.format_string("%s|%012d", "path", "i").alias("pos"))
    near = nearest_receivers(send, receive).withColumn("sub", c("r_pos"))
    out.append(edge(near, "ctx", c("r_ctx"), "ASYNC", F.concat("api", F.lit(":"), "key"), 4))
    edges = out[0]
    for e in out[1:]:
        edges = edges.unionByName(e)
    bad = table.where(any_glob(c("name"), exclude) | any_glob(short_name(c("name")), exclude)).select(c("function_id").alias("bad"))
    edges = cut(edges.join(bad, c("callee") == c("bad"), "left_anti"))
    best = edges.groupBy("caller", "callee").agg(F.min("at").alias("at"), F.min_by(F.struct("kind", "line", "via"), F.struct((-rank(c("kind"))).alias("r"), "at")).alias("b"))
    final = dense_ids(best, ["at", "caller", "callee"], "ord").select("caller", "callee", "b.kind", "b.line", "b.via", "ord")
    return CallGraph(table, cut(final), edges.drop("at"))


def build_report(files: DataFrame, g: CallGraph) -> DataFrame:
    """One row: files, files without content, functions, edges, asynchronous and callback edges, and places of calls that no
    function could be found for."""
    c = F.col
    f = files.where("path is not null").groupBy("path").agg(F.max(c("content").isNotNull()).alias("read")).agg(F.count(F.lit(1)).alias("files"), F.count_if(~c("read")).alias("files_without_content"))
    e = g.edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(c("kind") == "ASYNC").alias("async_edges"), F.count_if(c("kind") == "CALLBACK").alias("callback_edges"))
    u = g.all_edges.agg(F.count_if(c("callee") == UNRESOLVED).alias("unresolved_calls"))
    return f.crossJoin(g.functions.agg(F.count(F.lit(1)).alias("functions"))).crossJoin(e).crossJoin(u)  # single rows
