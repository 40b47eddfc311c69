"""Problem 5: parent–child links to full hierarchies, with cycles reported.

Forests (every node has one parent at most): nodes are sorted by id over range partitions and cut into fragments of
neighbours, of a bounded number of nodes each. Every fragment contracts its chains by pointer doubling to *exits*, the first
ancestor outside. The exits that exist form a smaller forest, the quotient, which is solved the same way; one that hardly
shrank (links without any locality) is solved by pointer jumping over joins instead. Expanding joins every node to its
exit's solution: root and depth, the way from the root, and, from below, what hangs on the nodes that others exit to. A
chain that closes within a fragment is a local cycle; one that closes over several shows up as a cycle of a quotient.

Directed graphs (calls): blocks merge their local strongly connected components and drop nodes that no path from
outside to outside crosses; what is left is a smaller graph, dealt to other blocks, until it fits one block. If it does
not shrink, components are found by rounds of colour propagation instead. No block holds more than its share of the nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.session import cut

WIDTH = 1 << 17
PATH_CHARS = 1 << 25

_LOCAL = "id long, parent long, x long, frag long, up long, root long, depth long, exit long, exit_dist long, ring long, looped boolean, way string"


def _long(values: np.ndarray, known: np.ndarray) -> pd.Series:
    return pd.Series(pd.array(np.where(known, values, 0), "Int64")).where(pd.Series(known), pd.NA)


def _ways(up: np.ndarray, inside: np.ndarray, own: list[str], ok: np.ndarray) -> Iterator[tuple[int, list[str | None]]]:
    """The ways from each node's last local ancestor down to it, as (first node, ways), in pieces of bounded length."""
    out: list[str | None] = []
    begin = size = 0
    for v in range(len(up)):
        parts = []
        u = v
        while ok[v]:
            parts.append(own[u])
            if not inside[u]:
                break
            u = up[u]
        out.append("/".join(reversed(parts)) if ok[v] else None)
        size += len(out[-1] or "")
        if size > PATH_CHARS:
            yield begin, out
            begin, out, size = v + 1, [], 0
    yield begin, out


def _contract(pdf: pd.DataFrame, ways: bool) -> Iterator[pd.DataFrame]:
    """One fragment, sorted by id: every node's last local ancestor by pointer doubling, with distance, the parent that
    leaves the fragment, and the smallest node of the local cycle that it leads to."""
    ids = pdf["id"].to_numpy(np.int64)
    n = len(ids)
    has, parent = pdf["has"].to_numpy(bool), pdf["parent"].to_numpy(np.int64)
    held, ring = pdf["held"].to_numpy(bool), pdf["ring"].to_numpy(np.int64)  # leads to a cycle found before
    at = np.minimum(np.searchsorted(ids, parent), n - 1)
    inside = has & (ids[at] == parent) & ~held
    near = np.where(inside, at, np.arange(n))
    up = near
    w = pdf["w"].to_numpy(np.int64)
    dist = np.where(inside, w, 0)
    low = ids
    for _ in range(max(1, int(n).bit_length()) + 1):
        dist = dist + dist[up]
        low = np.minimum(low, low[up])
        up = up[up]
    loops = inside[up]  # still on the way after more than n steps
    looped = np.zeros(n, bool)
    looped[up[loops]] = True
    bad = loops | held[up]
    leaves = has[up] & ~bad
    out = pd.DataFrame(
        {
            "id": ids, "parent": _long(parent, has), "x": pdf["x"].to_numpy(np.int64), "frag": ids[0], "up": _long(ids[near], inside),
            "root": pdf["root"].to_numpy(np.int64)[up], "depth": np.where(bad, 0, dist) + pdf["base"].to_numpy(np.int64)[up], "exit": _long(parent[up], leaves),
            "exit_dist": np.where(bad, 0, dist) + w[up], "ring": _long(np.where(loops, low[up], ring[up]), bad), "looped": looped, "way": None,
        }
    )
    if not ways:
        yield out
        return
    for begin, texts in _ways(near, inside, list(pdf["way"]), ~bad):
        yield out.iloc[begin : begin + len(texts)].assign(way=texts)


def _fragments(width: int, ways: bool):
    """A sorted partition in fragments of ``width`` nodes, each contracted."""

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        for pdf in batches:
            while len(pdf):
                part, pdf = pdf.iloc[: width - n], pdf.iloc[width - n :]
                held.append(part)
                n += len(part)
                if n == width:
                    yield from _contract(pd.concat(held, ignore_index=True), ways)
                    held, n = [], 0
        if n:
            yield from _contract(pd.concat(held, ignore_index=True), ways)

    return over


def _below(pdf: pd.DataFrame) -> pd.DataFrame:
    """One fragment: of each node, what it and its local descendants weigh, and whether a cycle's node is among them."""
    pdf = pdf.sort_values("id", kind="stable")
    ids = pdf["id"].to_numpy(np.int64)
    n = len(ids)
    alive = pdf["inner"].to_numpy(bool)
    jump = np.where(alive, np.searchsorted(ids, pdf["up"].to_numpy(np.int64)), 0)
    sums = np.stack([pdf["weight"].to_numpy(np.int64), pdf["ringed"].to_numpy(np.int64)])
    for _ in range(max(1, n.bit_length())):  # sums over 1, 2, 4 … generations
        if not alive.any():
            break
        more = np.stack([np.bincount(jump[alive], weights=s[alive], minlength=n) for s in sums.astype(float)])
        sums = sums + np.minimum(more, 2.0**62).astype(np.int64)
        sums[1] = np.minimum(sums[1], 1)
        alive = alive & alive[jump]
        jump = np.where(alive, jump[jump], 0)
    return pd.DataFrame({"id": ids, "below": sums[0], "ringed": sums[1] > 0})


def _jumped(forest: DataFrame, n: int) -> DataFrame:
    """``id, root, depth, ring, looped, below, way`` of a forest by pointer jumping: rounds of self-joins, each of which doubles
    the reach of those that have not arrived. Who has not arrived after more than n steps leads to a cycle."""
    c = F.col
    state = forest.select("id", F.when(c("ring").isNull(), c("parent")).alias("at"), "w", "root", c("base").alias("depth"), "ring", c("x").alias("below"), "way", c("id").alias("low"))
    there = state.select(c("id").alias("k"))  # a parent that the table lacks is none
    state = cut(state.join(there, c("at") == c("k"), "left").withColumn("at", c("k")).drop("k"))
    steps = 1
    while steps <= n and state.where("at is not null").limit(1).count():
        known = state.select(c("id").alias("k"), c("at").alias("k_at"), c("w").alias("k_w"), c("root").alias("k_root"), c("depth").alias("k_depth"), c("ring").alias("k_ring"), c("way").alias("k_way"), c("low").alias("k_low"))
        more = state.where("at is not null").groupBy(c("at").alias("m")).agg(F.sum("below").alias("more"))
        both = state.join(known, c("at") == c("k"), "left").join(more, c("id") == c("m"), "left")
        there, on = c("k").isNotNull(), c("k_at").isNotNull()  # has not arrived; neither has the one it looks to
        state = cut(
            both.select(
                "id", c("k_at").alias("at"), (c("w") + F.when(on, c("k_w")).otherwise(0)).alias("w"), F.when(there & ~on, c("k_root")).otherwise(c("root")).alias("root"),
                F.when(there & ~on, c("w") + c("k_depth")).otherwise(c("depth")).alias("depth"), F.when(there & ~on, c("k_ring")).otherwise(c("ring")).alias("ring"),
                F.least(c("below") + F.coalesce("more", F.lit(0)), F.lit(1 << 61)).alias("below"), F.when(there, F.concat_ws("/", "k_way", "way")).otherwise(c("way")).alias("way"), F.least("low", "k_low").alias("low"),
            )
        )
        steps *= 2
    ends = state.where("at is not null").select(c("at").alias("e")).distinct()
    ends = ends.join(state.select(c("id").alias("e_id"), c("low").alias("e_low")), c("e") == c("e_id"))
    out = state.join(ends.select("e", "e_low"), c("at") == c("e"), "left").join(ends.select(c("e").alias("on_ring")), c("id") == c("on_ring"), "left")
    return out.select("id", "root", "depth", F.coalesce("ring", "e_low").alias("ring"), c("on_ring").isNotNull().alias("looped"), "below", "way")


def _solve(forest: DataFrame, width: int, sums: bool, ways: bool) -> DataFrame:
    """``id, parent, root, depth, ring, looped, below, way`` of a forest with weights: ``ring`` names the cycle that a node leads
    to, ``looped`` says whether it lies on it, ``below`` is the weight of the node and all below it (no number on a cycle)."""
    c = F.col
    zero = F.lit(0).cast("long")
    # pandas would make numbers of missing ones: whether there is a parent or a cycle are columns of their own
    rows = forest.select("id", F.coalesce("parent", zero).alias("parent"), c("parent").isNotNull().alias("has"), "w", "root", "base", F.coalesce("ring", zero).alias("ring"), c("ring").isNotNull().alias("held"), "x", *(["way"] if ways else []))
    # sorted ranges: as many partitions as Spark is set to use, whatever they hold, as fragments are cut within them
    ranged = rows.repartitionByRange("id").sortWithinPartitions("id")
    local = cut(ranged.mapInPandas(_fragments(width, ways), _LOCAL))
    entries = local.where("exit is not null").groupBy(c("exit").alias("t")).agg(F.sum("x").alias("n"))
    quotient = cut(
        local.join(entries, c("id") == c("t")).select("id", c("exit").alias("parent"), c("exit_dist").alias("w"), "root", c("depth").alias("base"), "ring", c("n").alias("x"), "way")
    )
    n = quotient.count()
    if n == 0:
        solved = quotient.select("id", "root", c("base").alias("depth"), "ring", F.lit(False).alias("looped"), c("x").alias("below"), "way")
    elif 2 * n <= local.count():
        solved = _solve(quotient, width, sums, ways)
    else:
        solved = _jumped(quotient, n)
    far = solved.select(c("id").alias("t"), c("root").alias("far_root"), c("depth").alias("far_depth"), c("ring").alias("far_ring"), c("way").alias("far_way"))
    out = local.join(far, c("exit") == c("t"), "left")
    there = c("t").isNotNull()
    out = out.select(
        "id", "parent", "x", "frag", "up", F.when(there, c("far_root")).otherwise(c("root")).alias("root"), F.when(there, c("exit_dist") + c("far_depth")).otherwise(c("depth")).alias("depth"),
        F.coalesce("ring", "far_ring").alias("ring"), "looped", F.when(there & ways, F.concat_ws("/", "far_way", "way")).otherwise(c("way")).alias("way"),
    )
    if not sums:
        return out.select("id", "parent", "root", "depth", "ring", "looped", F.lit(None).cast("long").alias("below"), "way")
    hung = solved.select(c("id").alias("t"), "below", c("looped").alias("on"))
    weighed = local.join(hung, c("id") == c("t"), "left").select("id", "frag", F.coalesce("up", "id").alias("up"), c("up").isNotNull().alias("inner"), (c("x") + F.coalesce("below", F.lit(0))).alias("weight"), F.coalesce("on", F.lit(False)).cast("long").alias("ringed"))
    below = weighed.groupBy("frag").applyInPandas(_below, "id long, below long, ringed boolean").withColumnRenamed("id", "b")
    out = out.join(below, c("id") == c("b"))
    return out.select("id", "parent", "root", "depth", "ring", (c("looped") | c("ringed")).alias("looped"), "below", "way")


def _forest(links: DataFrame, node: str, parent: str) -> DataFrame:
    """One row per node; where copies disagree about the parent, the smallest parent that is given counts."""
    rows = links.where(F.col(node).isNotNull()).groupBy(F.col(node).cast("long").alias("id")).agg(F.min(F.col(parent).cast("long")).alias("parent"))
    one, none = F.lit(1).cast("long"), F.lit(None).cast("long")
    return rows.select("id", "parent", one.alias("w"), F.col("id").alias("root"), F.lit(0).cast("long").alias("base"), none.alias("ring"), one.alias("x"), F.col("id").cast("string").alias("way"))


def roots(links: DataFrame, node: str = "seq", parent: str = "parent_seq", width: int = WIDTH) -> DataFrame:
    """``node, parent, root, depth, cycle`` of every node of a forest of integer ids.

    ``root`` is the last node present on the way up (the node itself if it has no parent, or one that the table lacks) and
    null on a way that never ends, where ``cycle`` is true and ``depth`` null. Rows without a node id are left out; repeated
    rows count once; of several parents of one node the smallest counts. A node that is its own parent is a cycle. An
    empty table gives an empty result. ``depth`` counts the links up to the root.
    """
    ok = F.col("ring").isNull()
    solved = _solve(_forest(links, node, parent), width, False, False)
    return solved.select(F.col("id").alias("node"), "parent", F.when(ok, F.col("root")).alias("root"), F.when(ok, F.col("depth")).alias("depth"), (~ok).alias("cycle"))


def ancestors(links: DataFrame, node: str = "seq", parent: str = "parent_seq", width: int = WIDTH) -> DataFrame:
    """The closure ``node, ancestor, distance`` (the node itself at 0) of all nodes whose way up ends.

    Ways are doubled: ancestors at distances below 2^k and one jump of 2^k give those below 2^(k+1); rounds follow the
    depth of the deepest node, work follows the size of the result. Nodes on or above cycles have no rows.
    """
    known = cut(roots(links, node, parent, width))
    deepest = known.agg(F.max("depth")).first()[0] or 0
    ok = known.where("not cycle")
    jump = ok.where("depth > 0").select(F.col("node").alias("n"), F.col("parent").alias("up"))
    out = ok.select("node", F.col("node").alias("ancestor"), F.lit(0).cast("long").alias("distance"))
    step = 1
    while step <= deepest:
        further = out.join(jump, F.col("ancestor") == F.col("n")).select("node", F.col("up").alias("ancestor"), (F.col("distance") + step).alias("distance"))
        out = cut(out.unionByName(further))
        twice = jump.select(F.col("n").alias("m"), F.col("up").alias("upper"))
        jump = cut(jump.join(twice, F.col("up") == F.col("m")).select("n", F.col("upper").alias("up")))
        step *= 2
    return out


def hierarchy(links: DataFrame, node: str = "seq", parent: str = "parent_seq", width: int = WIDTH, paths: bool = True) -> DataFrame:
    """``node, root, depth, cycle, path, descendants``: the path from root to node as ids joined by ``/``, and how many
    nodes lie below. Nodes on a way that never ends have no root, depth or path (null), but descendants as well; those of a
    node on a cycle are all that lead to it, itself among them. Paths are as long as trees are deep: ``paths`` false leaves
    them null. Otherwise as ``roots``."""
    c = F.col
    solved = cut(_solve(_forest(links, node, parent), width, True, paths))
    rings = solved.where("ring is not null").groupBy(c("ring").alias("r")).agg(F.count(F.lit(1)).alias("all_below"))
    ok = c("ring").isNull()
    out = solved.join(rings, c("ring") == c("r"), "left")
    return out.select(
        c("id").alias("node"), F.when(ok, c("root")).alias("root"), F.when(ok, c("depth")).alias("depth"), (~ok).alias("cycle"), F.when(ok & paths, c("way")).alias("path"),
        F.when(c("looped"), c("all_below")).otherwise(c("below") - 1).alias("descendants"),
    )


def descendants(links: DataFrame, node: str = "seq", parent: str = "parent_seq", width: int = WIDTH) -> DataFrame:
    """``node, descendant, distance``: all nodes below each node of a forest, those on and below cycles too (on a cycle a
    node is its own descendant); the shortest distance counts. Ways are doubled as in ``ancestors``."""
    known = cut(roots(links, node, parent, width))
    up = ancestors(links, node, parent, width).where("distance > 0").select(F.col("ancestor").alias("node"), F.col("node").alias("descendant"), "distance")
    jump = cut(known.where("cycle").select(F.col("node").alias("n"), F.col("parent").alias("up")))
    pairs = cut(jump.select(F.col("up").alias("node"), F.col("n").alias("descendant"), F.lit(1).cast("long").alias("distance")))
    step, n, last = 1, pairs.count(), 0
    while n > last:
        further = pairs.join(jump, F.col("node") == F.col("n")).select(F.col("up").alias("node"), "descendant", (F.col("distance") + step).alias("distance"))
        pairs = cut(pairs.unionByName(further).groupBy("node", "descendant").agg(F.min("distance").alias("distance")))
        twice = jump.select(F.col("n").alias("m"), F.col("up").alias("upper"))
        jump = cut(jump.join(twice, F.col("up") == F.col("m")).select("n", F.col("upper").alias("up")))
        step, n, last = 2 * step, pairs.count(), n
    return up.unionByName(pairs)


# --- directed graphs -------------------------------------------------------------------------------------------------


def _components(n: int, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """Component numbers of a directed graph (Tarjan's walk without recursion)."""
    order = np.argsort(heads, kind="stable")
    to = tails[order]
    begin = np.searchsorted(heads[order], np.arange(n + 1))
    index = np.full(n, -1, np.int64)
    low = np.zeros(n, np.int64)
    comp = np.full(n, -1, np.int64)
    at = begin[:-1].copy()
    stack: list[int] = []
    count = comps = 0
    for s in range(n):
        if index[s] >= 0:
            continue
        walk = [s]
        while walk:
            v = walk[-1]
            if index[v] < 0:
                index[v] = low[v] = count
                count += 1
                stack.append(v)
            deeper = False
            while at[v] < begin[v + 1]:
                u = to[at[v]]
                if index[u] < 0:
                    walk.append(u)
                    deeper = True
                    break
                if comp[u] < 0:
                    low[v] = min(low[v], low[u])
                at[v] += 1
            if deeper:
                continue
            walk.pop()
            if low[v] == index[v]:
                while True:
                    u = stack.pop()
                    comp[u] = comps
                    if u == v:
                        break
                comps += 1
    return comp


def _reach(n: int, heads: np.ndarray, tails: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Nodes that can be reached from the marked ones."""
    order = np.argsort(heads, kind="stable")
    to = tails[order]
    begin = np.searchsorted(heads[order], np.arange(n + 1))
    seen = start.copy()
    todo = list(np.nonzero(start)[0])
    while todo:
        v = todo.pop()
        for u in to[begin[v] : begin[v + 1]]:
            if not seen[u]:
                seen[u] = True
                todo.append(u)
    return seen


_ALIVE = "node string, rep string, cyclic boolean, alive boolean"


def _shrink(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block: its nodes with their component's representative, whether that is a cycle, and whether a path from outside to outside crosses it."""
    inner = pdf[pdf["callee"].notna()]
    flags = pdf[pdf["callee"].isna()]
    names = pd.Index(pd.concat([inner["caller"], inner["callee"], flags["caller"]]).unique())
    n = len(names)
    h, t = names.get_indexer(inner["caller"]), names.get_indexer(inner["callee"])
    comp = _components(n, h, t)
    size = np.bincount(comp, minlength=1)
    cyclic = size[comp] > 1
    cyclic[h[h == t]] = True
    entry, leave = np.zeros(n, bool), np.zeros(n, bool)
    entry[names.get_indexer(flags.loc[flags["entered"].astype(bool), "caller"])] = True
    leave[names.get_indexer(flags.loc[flags["left"].astype(bool), "caller"])] = True
    alive = _reach(n, h, t, entry) & _reach(n, t, h, leave)
    rep = pd.Series(names).groupby(comp).transform("min")
    return pd.DataFrame({"node": names, "rep": rep.to_numpy(), "cyclic": cyclic, "alive": alive})


def _in_blocks(edges: DataFrame, blocks: int, turn: int) -> DataFrame:
    """The edges within each block, and of each node whether edges enter it from other blocks or leave it for them.

    In the first turn a block holds whole files (what stands before ``::``), later it is drawn anew by node; edges between
    blocks count as marks of their ends only, so that a node that everyone calls is no more than a row of its block.
    """
    c = F.col
    what = (lambda x: F.regexp_extract(x, r"^(.*?)(?:::[^/]*)?$", 1)) if turn == 0 else (lambda x: x)
    of = lambda x: F.pmod(F.xxhash64(what(x), F.lit(turn)), F.lit(blocks)) if blocks > 1 else F.lit(0).cast("long")
    e = edges.withColumn("hb", of(c("caller"))).withColumn("tb", of(c("callee")))
    null = F.lit(None).cast("string")
    inner = e.where("hb = tb").select(c("hb").alias("block"), "caller", "callee", F.lit(False).alias("entered"), F.lit(False).alias("left"))
    ends = F.explode(F.array(F.struct(c("hb").alias("block"), c("caller").alias("node"), F.lit(False).alias("entered")), F.struct(c("tb").alias("block"), c("callee").alias("node"), F.lit(True).alias("entered"))))
    marks = e.where("hb <> tb").select(ends.alias("x")).groupBy("x.block", "x.node").agg(F.max("x.entered").alias("entered"), F.max(~c("x.entered")).alias("left"))
    return inner.unionByName(marks.select("block", c("node").alias("caller"), null.alias("callee"), "entered", "left"))


def cyclic_nodes(edges: DataFrame, caller: str = "caller", callee: str = "callee", block_edges: int = 50_000) -> DataFrame:
    """``node``: every node of a directed graph that reaches itself, directly or by others; each once.

    Null ends, repeated edges and extra columns do not matter; an empty table gives no rows. Blocks are so many that each
    holds about ``block_edges`` edges; a file with more than half of that is dealt by node from the start.
    """
    c = F.col
    rest = cut(edges.where(c(caller).isNotNull() & c(callee).isNotNull()).select(c(caller).cast("string").alias("caller"), c(callee).cast("string").alias("callee")).distinct())
    n = rest.count()
    found = rest.where("caller = callee").select(c("caller").alias("node"))
    turn = 0 if n <= block_edges or not _big_file(rest, block_edges // 2) else 1
    while n:
        blocks = 1 if n <= block_edges else -(-n // block_edges)
        state = cut(_in_blocks(rest, blocks, turn).groupBy("block").applyInPandas(_shrink, _ALIVE))
        found = found.unionByName(state.where("cyclic").select("node"))  # what is merged here is found here
        if blocks == 1:
            break
        alive = state.where("alive").select("node", "rep")
        a, b = alive.select(c("node").alias("c1"), c("rep").alias("r1")), alive.select(c("node").alias("c2"), c("rep").alias("r2"))
        rest = cut(rest.join(a, c("caller") == c("c1")).join(b, c("callee") == c("c2")).where("r1 <> r2").select(c("r1").alias("caller"), c("r2").alias("callee")).distinct())
        last, n = n, rest.count()
        turn += 1
        if n > block_edges and n > 0.9 * last and turn > 1:  # blocks hardly cut any more
            found = found.unionByName(_by_colours(rest).select(c("node_").alias("node")))
            break
    return found.distinct()


def _big_file(edges: DataFrame, most: int) -> bool:
    per = edges.groupBy(F.regexp_extract("caller", r"^(.*?)(?:::[^/]*)?$", 1)).count()
    return per.where(F.col("count") > most).limit(1).count() > 0


def _by_colours(edges: DataFrame) -> DataFrame:
    """``node_``: nodes on cycles, by trimming and colour propagation: colours are the largest name that reaches a node; a
    colour's own node, walked back to within its colour, gives one component a round and colour."""
    out: DataFrame | None = None
    rest = cut(edges)
    loops = rest.where("caller = callee").select(F.col("caller").alias("node_"))
    out = loops
    rest = cut(rest.where("caller <> callee"))
    while True:
        while True:  # drop what no edge enters or leaves
            before = rest.count()
            rest = rest.join(rest.select(F.col("callee").alias("k")).distinct(), F.col("caller") == F.col("k"), "left_semi")
            rest = cut(rest.join(rest.select(F.col("caller").alias("k")).distinct(), F.col("callee") == F.col("k"), "left_semi"))
            if rest.count() == before:
                break
        if before == 0:
            return out.distinct()
        colour = cut(rest.select(F.col("caller").alias("v"), F.col("caller").alias("colour")).unionByName(rest.select(F.col("callee").alias("v"), F.col("callee").alias("colour"))).distinct())
        while True:
            sent = rest.join(colour, F.col("caller") == F.col("v")).select(F.col("callee").alias("v"), "colour")
            new = cut(colour.unionByName(sent).groupBy("v").agg(F.max("colour").alias("colour")))
            moved = new.exceptAll(colour).limit(1).count()
            colour = new
            if not moved:
                break
        back = cut(colour.where("v = colour"))
        inner = rest.join(colour.select(F.col("v").alias("a"), F.col("colour").alias("ca")), F.col("caller") == F.col("a")).join(colour.select(F.col("v").alias("b"), F.col("colour").alias("cb")), F.col("callee") == F.col("b"))
        inner = cut(inner.where("ca = cb").select("caller", "callee", F.col("ca").alias("c")))
        size = back.count()
        while True:
            more = inner.join(back, (F.col("callee") == F.col("v")) & (F.col("c") == F.col("colour"))).select(F.col("caller").alias("v"), "colour")
            back = cut(back.unionByName(more).distinct())
            now = back.count()
            if now == size:
                break
            size = now
        many = back.groupBy("colour").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out = cut(out.unionByName(back.join(many, "colour", "left_semi").select(F.col("v").alias("node_"))))
        done = back.select(F.col("v").alias("k"))
        rest = cut(rest.join(done, F.col("caller") == F.col("k"), "left_anti").join(done, F.col("callee") == F.col("k"), "left_anti"))


def call_descendants(edges: DataFrame, caller: str = "caller", callee: str = "callee") -> DataFrame:
    """``node, descendant, distance, path``: all nodes that each node of a directed graph reaches, itself if it is on a
    cycle, with the fewest links to it and the smallest of the shortest paths, as an array of ids from node to descendant.

    Rounds follow the longest of the shortest paths; each extends the pairs of the last one by a link. Null ends, repeated
    edges and extra columns do not matter.
    """
    e = edges.where(F.col(caller).isNotNull() & F.col(callee).isNotNull()).select(F.col(caller).cast("string").alias("a"), F.col(callee).cast("string").alias("b")).distinct()
    e = cut(e)
    new = cut(e.select(F.col("a").alias("node"), F.col("b").alias("descendant"), F.lit(1).cast("long").alias("distance"), F.array("a", "b").alias("path")))
    out = new
    while True:
        further = new.join(e, F.col("descendant") == F.col("a")).select("node", F.col("b").alias("descendant"), (F.col("distance") + 1).alias("distance"), F.concat("path", F.array("b")).alias("path"))
        further = further.groupBy("node", "descendant").agg(F.min("distance").alias("distance"), F.min("path").alias("path"))
        new = cut(further.join(out.select("node", "descendant"), ["node", "descendant"], "left_anti"))
        if not new.limit(1).count():
            return out
        out = out.unionByName(new)


def call_hierarchy(edges: DataFrame, caller: str = "caller", callee: str = "callee") -> DataFrame:
    """``node, root, depth, path, cycle, descendants`` of every node of a directed graph and each of its roots.

    Nodes that reach each other are one component (``cycle`` is true for its nodes, and for those that call themselves). A
    root is a node that nothing outside its component leads to; of a component that is a root, its smallest node stands
    for it. ``depth`` and ``path`` (ids joined by ``/``; ids may hold some themselves) tell the shortest way down from the
    root; ``descendants`` counts the nodes that the node reaches.
    """
    pairs = cut(call_descendants(edges, caller, callee))
    back = pairs.select(F.col("descendant").alias("node"), F.col("node").alias("descendant"))
    both = pairs.select("node", "descendant").intersect(back)
    component = both.groupBy("node").agg(F.min("descendant").alias("component"))
    nodes = pairs.select("node").unionByName(pairs.select(F.col("descendant").alias("node"))).distinct().join(component, "node", "left")
    nodes = cut(nodes.select("node", F.coalesce("component", "node").alias("component"), F.col("component").isNotNull().alias("cycle")))
    entered = pairs.join(both, ["node", "descendant"], "left_anti").select(F.col("descendant").alias("node")).distinct()
    tops = nodes.where("node = component").join(entered, "node", "left_anti").select(F.col("node").alias("root"))
    ways = pairs.where("node <> descendant").join(tops, F.col("node") == F.col("root")).select(F.col("descendant").alias("node"), "root", F.col("distance").alias("depth"), F.array_join("path", "/").alias("path"))
    ways = ways.unionByName(tops.select(F.col("root").alias("node"), "root", F.lit(0).cast("long").alias("depth"), F.col("root").alias("path")))
    below = pairs.groupBy("node").agg(F.count(F.lit(1)).alias("descendants"))
    out = nodes.select("node", "cycle").join(ways, "node", "left").join(below, "node", "left")
    return out.select("node", "root", "depth", "path", "cycle", F.coalesce("descendants", F.lit(0)).alias("descendants"))


def found_links(events: DataFrame, functions: DataFrame, calls: DataFrame) -> DataFrame:
    """``relation, node, root``: every record with a parent and the root of its tree or ``cycle``, and every known function
    that reaches itself over the call edges."""
    up = roots(events).where("parent is not null").select(
        F.lit("parent").alias("relation"), F.col("node").cast("string").alias("node"), F.when(F.col("cycle"), F.lit("cycle")).otherwise(F.col("root").cast("string")).alias("root")
    )
    known = functions.where("function_id is not null").select(F.col("function_id").alias("f")).distinct()
    loops = cyclic_nodes(calls).join(known, F.col("node") == F.col("f"), "left_semi").select(F.lit("call").alias("relation"), "node", F.lit("cycle").alias("root"))
    return up.unionByName(loops)
