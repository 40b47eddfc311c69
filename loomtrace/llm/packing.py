"""Problem 6: filling containers of fixed capacity, by pattern packing with non-negative least squares.

Items larger than the capacity are split into full pieces and a rest; nothing else is ever split. The histogram of the
lengths (in ``bins`` steps of the capacity) is counted over all items. Patterns are sets of few items that fill a
container; non-negative least squares fits how often each pattern is to be repeated so that together they use up the
histogram. Items are dealt to shards of bounded size by a hash; every shard realises its part of the rounded counts by
real sizes: all items of a pattern but the last come from their bins, the last is the largest that the room left takes. What
is left over then goes, largest first, where it fits best: into the room that patterns leave and into new containers.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 48
PATTERN_ITEMS = 4
SHARD_ITEMS = 20_000

PACKED = "target_id string, shard long, container long, doc_id long, piece long, size long, by_pattern boolean"


def byte_tokens(text: Column) -> Column:
    """Size in tokens of ByT5's byte-level tokenizer without special tokens: UTF-8 bytes; null counts 0."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def patterns(bins: int = BINS, items: int = PATTERN_ITEMS) -> np.ndarray:
    """Counts of each bin (1 to ``bins``) in every pattern of one to ``items`` items; pattern × bin.

    Sums from 7/8 of a container to the whole one, of patterns of most items from the last bin.
    """
    rows = []
    for k in range(1, items + 1):
        least = bins - max(1, bins // 8) if k < items else bins - 1
        rows.extend(c for c in combinations_with_replacement(range(max(1, bins // 16), bins + 1), k) if least <= sum(c) <= bins)
    out = np.zeros((len(rows), bins + 1))
    for i, c in enumerate(rows):
        for b in c:
            out[i, b] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 5_000, tolerance: float = 1e-6) -> np.ndarray:
    """x ≥ 0 that minimises |x·a − b|², by projected gradient steps with momentum, begun anew where they go uphill, until no
    step is larger than the tolerance times the largest number."""
    if not len(a):
        return np.zeros(0)
    step = 1 / max(np.linalg.norm(a, 2) ** 2, 1e-12)
    x = y = np.zeros(len(a))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * (a @ (y @ a - b)), 0)
        if (y - new) @ (new - x) > 0:
            t = 1.0
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        done = np.abs(new - x).max() <= tolerance * max(new.max(), 1e-12)
        x, t = new, t2
        if done:
            break
    return x


class _Stock:
    """Items not placed yet, by size."""

    def __init__(self, sizes: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        self.sizes, self.items = sizes[order].tolist(), order.tolist()

    def take(self, most: int, least: int = 0) -> tuple[int, int] | None:
        """The largest item of a size up to ``most``, if it is ``least`` or larger, as (item, size); it is gone then."""
        i = bisect_right(self.sizes, most) - 1
        if i < 0 or self.sizes[i] < least:
            return None
        return self.items.pop(i), self.sizes.pop(i)


def _pack(capacity: int, sizes: np.ndarray, shape: np.ndarray, repeats: np.ndarray, share: float, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Container number of each item of a shard, and whether a pattern put it there."""
    n = len(sizes)
    where = np.full(n, -1, np.int64)
    by_pattern = np.zeros(n, bool)
    room: list[int] = []
    stock = _Stock(sizes)
    edge = lambda b: b * capacity // bins
    todo = np.round(repeats * share).astype(int)
    # patterns of large items first: the small ones left over are placed more easily
    for p in sorted(np.flatnonzero(todo), key=lambda p: (-int(np.flatnonzero(shape[p])[-1]), p)):
        need = np.repeat(np.arange(bins + 1), shape[p].astype(int))[::-1].tolist()
        for _ in range(todo[p]):
            got: list[tuple[int, int]] = []
            left = capacity
            for b in need[:-1]:
                one = stock.take(min(edge(b), left), edge(b - 1) + 1)
                if one is None:
                    break
                got.append(one)
                left -= one[1]
            else:
                one = stock.take(left, edge(need[-1] - 1) + 1)
                if one is not None:
                    got.append(one)
            if len(got) < len(need):  # the bins of this pattern have run out
                for item, size in got:
                    i = bisect_right(stock.sizes, size)
                    stock.sizes.insert(i, size)
                    stock.items.insert(i, item)
                break
            for item, size in got:
                where[item], by_pattern[item] = len(room), True
            room.append(capacity - sum(size for _, size in got))
    # residuals: largest first into the container with the least room that takes them
    free = sorted((r, c) for c, r in enumerate(room))
    for i, s in zip(reversed(stock.items), reversed(stock.sizes)):
        at = bisect_left(free, (s, -1))
        if at < len(free):
            r, c = free.pop(at)
        else:
            r, c = capacity, len(room)
            room.append(capacity)
        where[i] = c
        if r - s > 0:
            insort(free, (r - s, c))
    return where, by_pattern


def pack(docs: DataFrame, targets: DataFrame, bins: int = BINS, shard_items: int = SHARD_ITEMS, size: Column | None = None) -> DataFrame:
    """Every document into containers of every target: ``target_id, shard, container, doc_id, piece, size, by_pattern``.

    A container is (target_id, shard, container). ``piece`` counts from 0; documents no larger than the capacity have one
    piece. Null and empty texts have size 0 and lie in some container; rows without doc_id are left out, repeated rows are
    packed each. Targets without a positive capacity are left out. Empty tables give an empty result. The targets are few
    (their list is read by the driver).
    """
    spark = docs.sparkSession
    caps = {r["target_id"]: int(r["capacity"]) for r in targets.where("capacity > 0 and target_id is not null").select("target_id", "capacity").distinct().collect()}
    items = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (byte_tokens(F.col("text")) if size is None else size).alias("size"))
    if not caps:
        return spark.createDataFrame([], PACKED)
    kinds = F.explode(F.array(*(F.struct(F.lit(t).alias("target_id"), F.lit(c).cast("long").alias("capacity")) for t, c in sorted(caps.items()))))
    pieces = items.select("doc_id", "size", kinds.alias("k")).select("k.target_id", "k.capacity", "doc_id", F.col("size").alias("whole"))
    count = F.greatest(F.lit(1), F.ceil(F.col("whole") / F.col("capacity"))).cast("long")
    pieces = pieces.select("target_id", "capacity", "doc_id", "whole", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("piece"))
    pieces = pieces.withColumn("size", F.least(F.col("capacity"), F.col("whole") - F.col("piece") * F.col("capacity")))
    bin_of = F.least(F.lit(bins), F.ceil(F.col("size") * bins / F.col("capacity"))).cast("int")
    hist: dict[str, np.ndarray] = {t: np.zeros(bins + 1) for t in caps}
    for r in pieces.groupBy("target_id", bin_of.alias("b")).count().collect():  # targets × bins rows
        hist[r["target_id"]][r["b"]] = r["count"]
    shape = patterns(bins)
    plans = {}
    for t in caps:
        h = hist[t].copy()
        small = max(1, bins // 16)
        h[:small] = 0  # the smallest fill gaps
        used = shape[(shape * (h == 0)).sum(axis=1) == 0]
        plans[t] = (used, nnls(used, h), float(hist[t].sum()))
    most = max(p[2] for p in plans.values())
    shards = max(1, int(-(-most // shard_items)))

    def over(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf["target_id"].iloc[0]
        shape_t, repeats, total = plans[t]
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable")
        where, by_pattern = _pack(caps[t], pdf["size"].to_numpy(np.int64), shape_t, repeats, len(pdf) / max(total, 1), bins)
        return pdf.assign(container=where, by_pattern=by_pattern)[["target_id", "shard", "container", "doc_id", "piece", "size", "by_pattern"]]

    # items of one shard: bounded by the number of shards, whatever the data
    dealt = pieces.select("target_id", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).alias("shard"), "doc_id", "piece", "size")
    return dealt.groupBy("target_id", "shard").applyInPandas(over, PACKED)


def split_documents(packed: DataFrame) -> DataFrame:
    """``target_id, doc_id`` of the documents that had to be split."""
    return packed.where("piece = 1").select("target_id", "doc_id").distinct()


def container_fill(packed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: containers, items, tokens, the fullest container, the share of items that patterns placed, the fewest
    containers that could hold the tokens, and the share of room that is filled."""
    c = F.col
    per = packed.groupBy("target_id", "shard", "container").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("items"), F.count_if("by_pattern").alias("p"))
    per = per.groupBy("target_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), (F.sum("p") / F.sum("items")).alias("by_pattern"))
    caps = targets.select(c("target_id").alias("t"), "capacity").distinct()
    return per.join(caps, c("target_id") == c("t")).select(
        "target_id", "capacity", "containers", "items", "tokens", "fullest", "by_pattern", F.ceil(c("tokens") / c("capacity")).alias("bound"), (c("tokens") / (c("containers") * c("capacity"))).alias("filled")
    )
