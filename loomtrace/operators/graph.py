"""Call graphs as tables: strongest edges, adjacency, reach up to some hops, subgraphs, degrees, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.functions.paths import EXCLUDE_CALLEES, any_glob, short_name
from loomtrace.session import cut

UNRESOLVED = "UNRESOLVED_FUNCTION_POINTER"
KINDS = ("SYNC", "ASYNC", "CALLBACK")
SYNC_MS, ASYNC_MS, CALLBACK_MS = 1000, 10_000, 10_000
MAX_HOPS = 3


def rank(kind: Column) -> Column:
    """SYNC 0, ASYNC 1, CALLBACK 2."""
    return F.when(kind == "CALLBACK", 2).when(kind == "ASYNC", 1).otherwise(0)


def kind_of(r: Column) -> Column:
    return F.when(r == 2, "CALLBACK").when(r == 1, "ASYNC").otherwise("SYNC")


def strongest_edges(edges: DataFrame) -> DataFrame:
    """One edge per (caller, callee): the first of the strongest kind, at the place of the first edge of the pair.

    Repeated rows, null lines and extra columns do not matter; edges without an end are left out.
    """
    e = edges.where("caller is not null and callee is not null")
    best = F.min_by(F.struct("kind", "line", "via"), F.struct(-rank(F.col("kind")), "ord"))
    out = e.groupBy("caller", "callee").agg(F.min("ord").alias("ord"), best.alias("b"))
    return out.select("caller", "callee", "b.kind", "b.line", "b.via", "ord")


def first_functions(functions: DataFrame) -> DataFrame:
    """One row per function_id, the first."""
    cols = [c for c in functions.columns if c != "function_id"]
    return functions.where("function_id is not null").groupBy("function_id").agg(F.min_by(F.struct(*cols), "ord").alias("f")).select("function_id", "f.*")


def without_callees(edges: DataFrame, functions: DataFrame, patterns: tuple[str, ...] = EXCLUDE_CALLEES) -> DataFrame:
    """Edges whose callee's name, whole or short, matches none of the patterns."""
    bad = functions.where(any_glob(F.col("name"), patterns) | any_glob(short_name(F.col("name")), patterns)).select(F.col("function_id").alias("_bad")).distinct()
    return edges.join(bad, F.col("callee") == F.col("_bad"), "left_anti")


def adjacency(edges: DataFrame) -> DataFrame:
    """``caller, callees``: the sorted distinct callees of each caller."""
    return edges.where("caller is not null and callee is not null").groupBy("caller").agg(F.sort_array(F.collect_set("callee")).alias("callees"))


def degrees(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """``function_id, out_degree, in_degree``, over strongest edges; functions without edges have 0."""
    e = strongest_edges(edges)
    o = e.groupBy(F.col("caller").alias("c1")).agg(F.count(F.lit(1)).alias("out_degree"))
    i = e.groupBy(F.col("callee").alias("c2")).agg(F.count(F.lit(1)).alias("in_degree"))
    f = functions.where("function_id is not null").select("function_id").distinct()
    out = f.join(o, F.col("function_id") == F.col("c1"), "left").join(i, F.col("function_id") == F.col("c2"), "left")
    return out.select("function_id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def caller_reach(edges: DataFrame, max_hops: int = MAX_HOPS, windows: tuple[int, int, int] = (SYNC_MS, ASYNC_MS, CALLBACK_MS)) -> DataFrame:
    """``callee, caller, hops, kind, window_ms``: every function that reaches another within some hops.

    Breadth-first from each callee against the edges: a caller's hops and kind (the strongest along the way) are those of
    its first visit, in the order of the queue and of the edges; the start itself and the unresolved pointer are no callers.
    """
    e = cut(strongest_edges(edges).where(F.col("caller") != UNRESOLVED).select(F.col("caller").alias("e_caller"), F.col("callee").alias("e_callee"), rank(F.col("kind")).alias("e_rank"), F.col("ord").alias("e_ord")))
    c = F.col
    level = e.select(c("e_callee").alias("callee"), c("e_caller").alias("caller"), c("e_rank").alias("r"), F.array(c("e_ord")).alias("way")).where("callee <> caller")
    level = cut(level.withColumn("hops", F.lit(1)))
    reach = level
    for h in range(2, max_hops + 1):
        nxt = level.join(e, c("caller") == c("e_callee")).where(c("e_caller") != c("callee")).select(
            "callee", c("e_caller").alias("caller"), F.greatest("r", "e_rank").alias("r"), F.concat("way", F.array("e_ord")).alias("way")
        )
        # the queue holds first visits in order of their ways; the smallest way is the first visit
        nxt = nxt.groupBy("callee", "caller").agg(F.min(F.struct("way", "r")).alias("m")).select("callee", "caller", c("m.r").alias("r"), c("m.way").alias("way"), F.lit(h).alias("hops"))
        seen = reach.select(c("callee").alias("s1"), c("caller").alias("s2"))
        level = cut(nxt.join(seen, (c("callee") == c("s1")) & (c("caller") == c("s2")), "left_anti"))
        reach = reach.unionByName(level)
    kind = kind_of(c("r"))
    window = F.when(c("r") == 2, windows[2]).when(c("r") == 1, windows[1]).otherwise(windows[0]).cast("long")
    return reach.select("callee", "caller", "hops", kind.alias("kind"), window.alias("window_ms"))


def subgraph(edges: DataFrame, center: str, hops: int = 2, direction: str = "both", max_nodes: int | None = None) -> DataFrame:
    """Edges among the nodes within some hops of a centre, forward, backward or both: ``caller, callee, kind``.

    ``max_nodes`` is the feature of the same name of a graph view: nodes are taken nearest first, then by name.
    """
    if direction not in ("forward", "backward", "both"):
        raise ValueError(f"direction {direction!r} is none of forward, backward, both")
    spark = edges.sparkSession
    e = strongest_edges(edges).select("caller", "callee", "kind")
    ways = []
    if direction in ("forward", "both"):
        ways.append(e.select(F.col("caller").alias("a"), F.col("callee").alias("b")))
    if direction in ("backward", "both"):
        ways.append(e.select(F.col("callee").alias("a"), F.col("caller").alias("b")))
    step = ways[0] if len(ways) == 1 else ways[0].unionByName(ways[1])
    nodes = spark.createDataFrame([(center, 0)], "node string, hop int")
    front = nodes
    for h in range(1, hops + 1):
        new = front.join(step, F.col("node") == F.col("a")).select(F.col("b").alias("node"), F.lit(h).alias("hop")).distinct()
        front = cut(new.join(nodes.select(F.col("node").alias("n")), F.col("node") == F.col("n"), "left_anti"))
        nodes = nodes.unionByName(front)
    if max_nodes is not None:
        nodes = nodes.orderBy("hop", "node").limit(max_nodes)
    keep = nodes.select("node")
    out = e.join(keep.withColumnRenamed("node", "n1"), F.col("caller") == F.col("n1"), "left_semi")
    return out.join(keep.withColumnRenamed("node", "n2"), F.col("callee") == F.col("n2"), "left_semi")


def build_stats(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: functions, edges, async and callback edges, and callers of unresolved pointers."""
    e = strongest_edges(edges).agg(
        F.count(F.lit(1)).alias("edges"), F.count_if(F.col("kind") == "ASYNC").alias("async_edges"), F.count_if(F.col("kind") == "CALLBACK").alias("callback_edges"),
        F.count_if(F.col("callee") == UNRESOLVED).alias("unresolved_callers"),
    )
    return functions.agg(F.countDistinct("function_id").alias("functions")).crossJoin(e)  # two single rows


def edge_lines(edges: DataFrame) -> DataFrame:
    """``ord, line``: every edge as a DOT line, styled by kind."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    style = F.when(F.col("kind") == "ASYNC", "dotted").when(F.col("kind") == "CALLBACK", "dashed").otherwise("solid")
    return strongest_edges(edges).select("ord", F.concat(F.lit("  "), quote("caller"), F.lit(" -> "), quote("callee"), F.lit(" [style="), style, F.lit("];")).alias("dot"))


def dot_document(functions: DataFrame, edges: DataFrame, logged: DataFrame | None = None) -> DataFrame:
    """``part, module, node, ord, line``: a whole DOT graph as rows, to be read in order of the first four columns.

    Functions stand in a cluster of their module, sorted; nodes without a function stand loose; then the edges in order.
    ``logged`` (column ``function_id``) highlights nodes. Parts: 0 the head, 1 clusters, 2 loose nodes, 3 edges, 4 the end.
    """
    c = F.col
    spark = edges.sparkSession
    text = lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    e = strongest_edges(edges)
    ends = e.select(c("caller").alias("node")).unionByName(e.select(c("callee").alias("node"))).distinct()
    f = first_functions(functions).select(c("function_id").alias("f"), "name", F.coalesce("module", F.lit("")).alias("module"))
    nodes = ends.join(f, c("node") == c("f"), "left")
    if logged is not None:
        nodes = nodes.join(logged.select(c("function_id").alias("lit")).distinct(), c("node") == c("lit"), "left")
    else:
        nodes = nodes.withColumn("lit", F.lit(None).cast("string"))
    mark = F.when(c("lit").isNotNull(), ", style=filled").otherwise("")
    null_s, zero = F.lit("").alias("node"), F.lit(0).cast("long")
    inner = nodes.where("f is not null")
    line = F.concat(F.lit("    "), text(c("node")), F.lit(" [label="), text(c("name")), mark, F.lit("];"))
    rows = inner.select(F.lit(1).alias("part"), "module", "node", F.lit(1).cast("long").alias("ord"), line.alias("line"))
    mods = inner.select("module").distinct()
    rows = rows.unionByName(mods.select(F.lit(1).alias("part"), "module", null_s, zero.alias("ord"), F.concat(F.lit("  subgraph "), text(F.concat(F.lit("cluster_"), "module")), F.lit(" { label="), text(c("module")), F.lit(";")).alias("line")))
    rows = rows.unionByName(mods.select(F.lit(1).alias("part"), "module", F.lit("\uffff").alias("node"), zero.alias("ord"), F.lit("  }").alias("line")))
    rows = rows.unionByName(nodes.where("f is null").select(F.lit(2).alias("part"), F.lit("").alias("module"), "node", zero.alias("ord"), F.concat(F.lit("  "), text(c("node")), F.lit(";")).alias("line")))
    rows = rows.unionByName(edge_lines(edges).select(F.lit(3).alias("part"), F.lit("").alias("module"), null_s, c("ord").cast("long").alias("ord"), c("dot").alias("line")))
    frame = spark.createDataFrame([(0, "", "", 0, "digraph callgraph {"), (4, "", "", 0, "}")], "part int, module string, node string, ord long, line string")
    return rows.unionByName(frame)


def detail_lines(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """``part, key, json``: the graph's detail export, one JSON object a function and edge; absent fields are left out."""
    f = first_functions(functions).select(
        F.lit("function").alias("part"), F.col("function_id").alias("key"),
        F.to_json(F.struct(F.col("function_id").alias("id"), "name", F.col("file_path").alias("file"), "start_line", "end_line", "is_static", "module")).alias("json"),
    )
    e = strongest_edges(edges).select(
        F.lit("edge").alias("part"), F.concat_ws(" ", "caller", "callee").alias("key"), F.to_json(F.struct("caller", "callee", "kind", "line", "via")).alias("json")
    )
    return f.unionByName(e)


def encoded_nodes(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, id``: dense ids of all functions in order of their names, the unresolved pointer last if it is called.

    Ids come from counts per name range and running offsets, not from one sorted partition.
    """
    f = functions.where("function_id is not null").select(F.col("function_id").alias("node")).distinct().withColumn("last", F.lit(0))
    u = edges.where(F.col("callee") == UNRESOLVED).select(F.lit(UNRESOLVED).alias("node"), F.lit(1).alias("last")).distinct()
    return dense_ids(f.unionByName(u), ["last", "node"], "id").select("node", "id")


def dense_ids(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Adds 0.. in the given order: sorted by ranges, numbered within each, shifted by the counts of the ranges before."""
    by = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    by = cut(by.withColumn("_i", F.monotonically_increasing_id()))
    sizes = by.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    off = sizes.select(F.col("_p").alias("_q"), "_first", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))  # a row a partition
    return by.join(F.broadcast(off), F.col("_p") == F.col("_q")).withColumn(out, (F.col("_o") + F.col("_i") - F.col("_first")).cast("long")).drop("_p", "_q", "_i", "_first", "_o")
