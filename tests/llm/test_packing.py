"""Packing, mixing and quality on small tables."""

import random

import numpy as np

from loomtrace.llm import mixing, packing, quality

DOCS = "doc_id long, text string, source string, lang string"
TARGETS = "target_id string, capacity long"


def docs(spark, n=400, seed=1):
    rnd = random.Random(seed)
    return [(i, "x" * rnd.choice([3, 10, 60, 200, 450, 900, 1500, 2600]), rnd.choice(["a", " A ", "b-c", "B_C", "d", None]), "en") for i in range(n)]


def test_pack(spark):
    rows = [*docs(spark), (1000, None, "a", "en"), (1001, "", "a", "en"), (1002, "é" * 600, "a", "en"), (None, "xx", "a", "en")]
    d = spark.createDataFrame(rows, DOCS).withColumn("size", packing.F.lit("clash"))
    t = spark.createDataFrame([("small", 1000), ("big", 5000), ("none", 0), (None, 5)], TARGETS)
    for shard in (20_000, 50):
        got = packing.pack(d, t, shard_items=shard).cache()
        for name, cap in (("small", 1000), ("big", 5000)):
            mine = [r for r in got.collect() if r["target_id"] == name]
            per, pieces = {}, {}
            for r in mine:
                per[(r["shard"], r["container"])] = per.get((r["shard"], r["container"]), 0) + r["size"]
                pieces.setdefault(r["doc_id"], []).append((r["piece"], r["size"]))
            assert max(per.values()) <= cap
            for i, text, *_ in rows:
                if i is not None:
                    size = len((text or "").encode())
                    assert sum(s for _, s in pieces[i]) == size
                    assert len(pieces[i]) == max(1, -(-size // cap))
            total = sum(per.values())
            assert total / (len(per) * cap) > (0.93 if shard > 1000 else 0.8)
        split = {(r["target_id"], r["doc_id"]) for r in packing.split_documents(got).collect()}
        assert split == {(n, i) for n, c in (("small", 1000), ("big", 5000)) for i, x, *_ in rows if i is not None and x and len(x.encode()) > c}
    whole = {r["target_id"]: r for r in packing.container_fill(packing.pack(d, t), t).collect()}
    assert all(r["containers"] <= 1.05 * r["bound"] + 1 for r in whole.values()) and whole["small"]["by_pattern"] > 0.3
    fill = {r["target_id"]: r for r in packing.container_fill(got, t).collect()}
    assert set(fill) == {"small", "big"} and fill["small"]["fullest"] <= 1000
    assert packing.pack(d.where("false"), t).count() == 0 and packing.pack(d, t.where("false")).count() == 0


def test_nnls():
    rng = np.random.default_rng(0)
    a = rng.random((30, 12))
    x = np.where(rng.random(30) < 0.3, rng.integers(1, 50, 30), 0)
    b = x @ a
    got = packing.nnls(a, b, 20_000, 1e-9)
    assert (got >= 0).all() and np.abs(got @ a - b).max() < 1e-2


def test_permutation():
    for n in (1, 2, 7, 1000, 1025):
        p = mixing.permuted(np.arange(n), n, 5)
        assert sorted(p) == list(range(n))
    assert list(mixing.permuted(np.arange(1000), 1000, 5)) != list(mixing.permuted(np.arange(1000), 1000, 6))


def test_mix(spark):
    rows = [(i, "y" * 300, ["a", " A", "b-c", "B_C", "z"][i % 5], "en") for i in range(500)] + [(900, "w" * 700, "rare", "en"), (901, None, "a", "en"), (None, "q", "a", "en")]
    d = spark.createDataFrame(rows, DOCS)
    t = spark.createDataFrame([("A", 0.5, 2), ("b_c", 0.4, 1), ("rare", 0.05, 3), ("absent", 0.05, 4)], "source string, weight double, max_repeats int")
    sizes = mixing.source_sizes(d, t)
    got = {r["source"]: r for r in sizes.collect()}
    total = 500 * 300 + 700 + 1
    assert got["A"]["size"] == 200 * 300 + 1 and got["A"]["total"] == total and got["A"]["enough"] and not got["rare"]["enough"] and not got["absent"]["enough"]
    assert got["b_c"]["enough"] is (200 * 300 >= 0.4 * total)
    m = mixing.mix(d, t, block=256).cache()
    uses = {}
    for r in m.collect():
        for k in range(r["begin"], r["end"]):
            uses[(r["doc_id"], k)] = uses.get((r["doc_id"], k), 0) + 1
        assert r["pass"] < {"A": 2, "b_c": 1, "rare": 3}[r["source"]]
    assert max(uses.values()) <= 3 and max(n for (i, _), n in uses.items() if i == 900) == 3
    whole = mixing.mixture(d, t, block=256)
    shares = {r["source"]: r for r in mixing.mixture_shares(whole).collect()}
    assert {r["source"] for r in mixing.unfilled(whole).collect()} == {k for k, r in got.items() if not r["enough"]} and shares["rare"]["filled"] < shares["rare"]["slots"]
    assert abs(shares["A"]["share"] / shares["b_c"]["share"] - 0.5 / 0.4) < 0.25 and shares["absent"]["tokens"] == 0
    assert sorted(map(tuple, mixing.mix(d, t, block=256).collect())) == sorted(map(tuple, m.collect()))
    assert mixing.mix(d.where("false"), t).count() == 0 and mixing.mix(d, t.where("false")).count() == 0
    assert mixing.unfilled(mixing.mixture(d.where("false"), t)).count() == 0 and mixing.mixture_shares(mixing.mixture(d, t.where("false"))).count() == 0


PROSE = "The timer wheel reads the table again from flash because the peer has not answered. A record that is idle must not hold any of the slots. "


def test_quality(spark):
    rnd = random.Random(1)
    words = PROSE.lower().replace(".", "").split()
    prose = [" ".join(rnd.sample(PROSE.split(". "), 2)) + ". " + PROSE * rnd.randrange(1, 4) for _ in range(120)]
    odd = {
        1000: ("list", "\n".join(f"- old {w} driver" for w in words[:12])),
        1001: ("table", "\n".join(f"{w} | {i} | 0x{i:x} | idle" for i, w in enumerate(words[:9]))),
        1002: ("junk", "=?%@$+_/>**[{?/*|$/]!|][{%*@+*+|$%!##>??>^&{=@$^>/?[_^<@{~![=+~" * 4),
        1003: ("junk", "\n".join(["« Back | Top | Share", "Home > Docs > Print"] * 6)),
        1004: ("table", "a,b,c\n" + "\n".join(f"slot,{i},{i * 3}" for i in range(14))),
        1005: ("list", ", ".join(["slot (4)", "timer", "old pump", "idle state", "record (7)", "close buffer"] * 3)),
    }
    rows = [(i, t, "s", "en") for i, t in enumerate(prose)] + [(k, t, "s", None) for k, (_, t) in odd.items()] + [(2000, None, "s", "en"), (2001, "  \n", "s", "en"), (2002, PROSE + "\n\n- a\n- b", "s", "zz")]
    d = spark.createDataFrame(rows, DOCS).withColumn("kind", quality.F.lit(0)).withColumn("size", quality.F.lit("x"))
    got = {r["doc_id"]: r["kind"] for r in quality.non_prose(d).collect()}
    assert got == {k: v for k, (v, _) in odd.items()}
    q = {r["doc_id"]: r for r in quality.text_quality(d).collect()}
    assert 2000 not in q and 2001 not in q and q[2002]["kind"] == "prose" and len(q[1002]["outlying"]) == 3
    one = quality.judged_segments(d).where("doc_id = 1002").first()
    assert abs(sum(one["parts"].values()) - one["distance"]) < 1e-6 * abs(one["distance"]) + 1e-6
    assert quality.text_quality(d.where("false")).count() == 0
