"""Hierarchies against walks in plain Python: chains over blocks, cycles, missing parents, repeated rows."""

import random

import pytest

from loomtrace.operators import hierarchy as h

LINK = "seq long, parent_seq long"


def walk(parent):
    out = {}
    for s in parent:
        seen, x, d = {s}, s, 0
        while True:
            p = parent[x]
            if p is None or p not in parent:
                out[s] = (x, d)
                break
            if p in seen:
                out[s] = (None, None)
                break
            seen.add(p)
            x, d = p, d + 1
    return out


@pytest.mark.parametrize("width", [1 << 17, 7, 3, 1])
def test_roots(spark, width):
    rnd = random.Random(width)
    n = 300
    parent = {i: rnd.choice([None, 10_000 + i, *([rnd.randrange(n)] * 2), *([max(0, i - 1)] * 6)]) for i in range(n)}
    parent[5] = 5
    rows = [(s, p) for s, p in parent.items()] * 2 + [(None, 3)]
    rnd.shuffle(rows)
    got = {r["node"]: (r["root"], r["depth"]) for r in h.roots(spark.createDataFrame(rows, LINK), width=width).collect()}
    assert got == walk(parent)


def full(parent):
    """(root, depth, path, descendants) by walks in plain Python; a node on a cycle is below itself."""
    top, below, way = walk(parent), dict.fromkeys(parent, 0), {}
    for s in parent:
        x, seen = parent[s], set()
        while x in parent and x not in seen:
            below[x] += 1
            seen.add(x)
            x = parent[x]
        x, path = s, [s]
        while top[s][0] is not None and x != top[s][0]:
            x = parent[x]
            path.append(x)
        way[s] = "/".join(map(str, reversed(path))) if top[s][0] is not None else None
    return {s: (*top[s], way[s], below[s]) for s in parent}


@pytest.mark.parametrize("width,near", [(1 << 17, True), (5, True), (5, False), (2, False)])
def test_hierarchy_against_walks(spark, width, near):
    rnd = random.Random(width + near)
    n = 150
    step = (lambda i: max(0, i - rnd.randrange(1, 4))) if near else (lambda i: rnd.randrange(n))
    parent = {i: rnd.choice([None, 10_000 + i, *([step(i)] * 8)]) for i in range(n)}
    parent.update({140: 141, 141: 142, 142: 140, 100: 100, 3: 9, 9: 3})
    rows = list(parent.items()) * 2
    rnd.shuffle(rows)
    got = h.hierarchy(spark.createDataFrame(rows, LINK), width=width)
    assert {r["node"]: (r["root"], r["depth"], r["path"], r["descendants"]) for r in got.collect()} == full(parent)
    assert got.where("cycle = (root IS NULL)").count() == n


def test_one_long_chain(spark):
    n = 5000
    d = spark.range(n).selectExpr("id AS seq", "id - 1 AS parent_seq")
    r = {x["node"]: x for x in h.hierarchy(d, width=100, paths=False).collect()}
    assert all(r[i]["root"] == 0 and r[i]["depth"] == i and r[i]["descendants"] == n - 1 - i for i in range(n))
    ring = spark.range(n).selectExpr("id AS seq", f"(id + 1) % {n} AS parent_seq")
    assert h.hierarchy(ring, width=100).where(f"cycle and descendants = {n}").count() == n


def test_chain_without_locality(spark):
    n = 2000
    d = spark.range(n).selectExpr(f"(id * 997) % {n} AS seq", f"CASE WHEN id > 0 THEN ((id - 1) * 997) % {n} END AS parent_seq", "id")
    r = {x["node"]: x["depth"] for x in h.roots(d, width=50).collect()}
    assert r == {(i * 997) % n: i for i in range(n)}


def test_large_ids_stay_exact(spark):
    big = (1 << 62) + 1
    got = h.hierarchy(spark.createDataFrame([(big, None), (big + 1, big), (-7, big + 1)], LINK)).collect()
    assert {(r["node"], r["root"], r["depth"], r["path"]) for r in got} == {(big, big, 0, f"{big}"), (big + 1, big, 1, f"{big}/{big + 1}"), (-7, big, 2, f"{big}/{big + 1}/-7")}


def test_paths_and_descendants(spark):
    d = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1), (7, 8), (8, 7), (9, 7), (10, 99)], LINK)
    got = {r["node"]: (r["root"], r["depth"], r["cycle"], r["path"], r["descendants"]) for r in h.hierarchy(d).collect()}
    assert got[1] == (1, 0, False, "1", 3) and got[3] == (1, 2, False, "1/2/3", 0) and got[10] == (10, 0, False, "10", 0)
    assert got[8] == (None, None, True, None, 3) and got[9] == (None, None, True, None, 0)


def test_empty_and_clashing_columns(spark):
    assert h.hierarchy(spark.createDataFrame([], LINK)).count() == 0
    d = spark.createDataFrame([(1, None, "a", 5), (2, 1, "b", 6)], "seq long, parent_seq long, root string, depth int")
    assert {(r["node"], r["root"]) for r in h.roots(d).collect()} == {(1, 1), (2, 1)}


def on_cycle(edges):
    to = {}
    for a, b in edges:
        if a is not None and b is not None:
            to.setdefault(a, set()).add(b)
    out = set()
    for s in to:
        seen, todo = set(), list(to[s])
        while todo:
            v = todo.pop()
            if v == s:
                out.add(s)
                break
            if v not in seen:
                seen.add(v)
                todo += to.get(v, ())
    return out


@pytest.mark.parametrize("block_edges", [50_000, 10, 3])
def test_cycles_of_graphs(spark, block_edges):
    rnd = random.Random(3)
    names = [f"d{i % 5}/f{i}.c::x" for i in range(60)]
    edges = [(rnd.choice(names), rnd.choice(names)) for _ in range(75)] + [("d1/f1.c::x", "d1/f1.c::x"), (None, "a"), ("a", None)]
    d = spark.createDataFrame(edges + edges[:5], "caller string, callee string")
    got = [r["node"] for r in h.cyclic_nodes(d, block_edges=block_edges).collect()]
    assert set(got) == on_cycle(edges) and len(got) == len(set(got))


def test_blocks_stay_small_whatever_the_names(spark):
    n, hub = 4000, "main.c::hub"
    edges = [(f"f{i}.c::x", hub) for i in range(n)] + [(hub, "main.c::back"), ("main.c::back", hub)] + [(f"f{i}.c::x", f"f{i + 1}.c::x") for i in range(n)]
    d = spark.createDataFrame(edges, "caller string, callee string")
    for turn in (0, 1):
        sizes = [r["count"] for r in h._in_blocks(d, 50, turn).groupBy("block").count().collect()]
        assert len(sizes) == 50 and max(sizes) < 4 * sum(sizes) / 50
    one_file = spark.createDataFrame([("main.c::a" + str(i), "main.c::a" + str(i + 1)) for i in range(300)] + [("main.c::a9", "main.c::a8")], "caller string, callee string")
    assert {r["node"] for r in h.cyclic_nodes(one_file, block_edges=40).collect()} == {"main.c::a8", "main.c::a9"}


def test_no_edges(spark):
    assert h.cyclic_nodes(spark.createDataFrame([], "caller string, callee string")).count() == 0


def below(edges):
    """(node, descendant) -> fewest links, by a walk from each node."""
    to = {}
    for a, b in edges:
        if a is not None and b is not None:
            to.setdefault(a, set()).add(b)
    out = {}
    for s in to:
        layer, d = to[s], 1
        while layer:
            out.update({(s, x): d for x in layer})
            layer, d = {y for x in layer for y in to.get(x, ()) if (s, y) not in out}, d + 1
    return out


def test_descendants_below_cycles(spark):
    rows = [(1, None), (2, 1), (3, 2), (7, 8), (8, 7), (9, 7), (11, 9), (10, 99), (5, 5), (6, 5), (12, 11), (13, 12)]
    want = below([(p, s) for s, p in rows if p != 99])
    assert {(r["node"], r["descendant"]): r["distance"] for r in h.descendants(spark.createDataFrame(rows * 2, LINK)).collect()} == want
    assert h.descendants(spark.createDataFrame([], LINK)).count() == 0


def test_call_hierarchy(spark):
    rnd = random.Random(4)
    edges = [(f"f{a}", f"f{b}") for a, b in ((rnd.randrange(30), rnd.randrange(30)) for _ in range(28))] + [("r", "f1"), ("x", "y"), ("y", "x"), ("y", "z"), ("s", "s"), (None, "r"), ("r", None)]
    reach = below(edges)
    d = spark.createDataFrame(edges * 2, "caller string, callee string")
    nodes = {x for e in edges if None not in e for x in e}
    together = {n: {m for m in nodes if (n, m) in reach and (m, n) in reach} | {n} for n in nodes}
    tops = {n for n in nodes if n == min(together[n]) and all(m in together[n] for m in nodes if (m, n) in reach)}
    want = {(n, t): (0 if n == t else reach[t, n], (n, n) in reach, sum(a == n for a, _ in reach)) for n in nodes for t in tops if n == t or (t, n) in reach}
    got = h.call_hierarchy(d).collect()
    assert {(r["node"], r["root"]): (r["depth"], r["cycle"], r["descendants"]) for r in got} == want and len(got) == len(want)
    for r in got:
        way = r["path"].split("/")
        assert (way[0], way[-1], len(way)) == (r["root"], r["node"], r["depth"] + 1) and all(e in set(edges) for e in zip(way, way[1:]))
    assert h.call_hierarchy(d.where("false")).count() == 0
