"""Problem 7: mixing sources to target weights.

Texts of a source are laid end to end and cut into blocks of a fixed number of tokens. Each output shard draws how many
blocks it takes from each source (multinomial by weight); running sums over shards, by ranges, number a source's slots. A slot's
number gives its pass over the source and, by a pseudorandom permutation of that pass, the index of its block; blocks
are joined by index. A slot past the last allowed pass stays empty, so that no text is used more often than allowed, and
the shares reached are reported.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.llm.packing import byte_tokens
from loomtrace.operators.ordered import offsets
from loomtrace.session import cut

BLOCK = 1024
SHARD_BLOCKS = 2_000
PACK_ROWS = 20_000


def spelling(source: Column) -> Column:
    """A source's name without differences in case, outer blanks and ``-`` or ``_``."""
    return F.regexp_replace(F.lower(F.regexp_replace(source, r"^\s+|\s+$", "")), "-", "_")


def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n−1 at the given places: a Feistel network on the next even power of two, walked
    on until the value is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x = i.astype(np.uint64)
    todo = np.ones(len(x), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            left, right = x[todo] >> np.uint64(half), x[todo] & mask
            for r in range(4):
                f = (right + np.uint64((key * 4 + r + 1) % (1 << 62))) * np.uint64(0x9E3779B97F4A7C15)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((f >> np.uint64(32)) & mask)
            x[todo] = (left << np.uint64(half)) | right
            todo = x >= np.uint64(n)
    return x.astype(np.int64)


def _wanted(targets: DataFrame) -> list[tuple[str, str, float, int]]:
    """(normal spelling, name, weight, max_repeats) of the mixture's sources: a list as short as the mixture."""
    rows = targets.where("source is not null").select(spelling(F.col("source")).alias("key"), "source", F.coalesce("weight", F.lit(0.0)).alias("w"), F.coalesce("max_repeats", F.lit(0)).alias("m"))
    best: dict[str, tuple[str, str, float, int]] = {}
    for r in rows.orderBy("source").collect():
        best.setdefault(r["key"], (r["key"], r["source"], float(r["w"]), int(r["m"])))
    return list(best.values())


def _sized(docs: DataFrame, size: Column | None) -> DataFrame:
    """``doc_id, key, size`` of all documents: what is read of them, once."""
    size = byte_tokens(F.col("text")) if size is None else size
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), spelling(F.col("source")).alias("key"), size.alias("size"))


def _sizes_of(sized: DataFrame, targets: DataFrame) -> DataFrame:
    sums = sized.groupBy("key").agg(F.count(F.lit(1)).alias("texts"), F.sum("size").alias("size"))
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    want = targets.where("source is not null").select(spelling(F.col("source")).alias("k"), "source", "weight", "max_repeats").dropDuplicates(["k"])
    out = want.join(sums, F.col("k") == F.col("key"), "left").crossJoin(F.broadcast(total))  # one row: the sum over all
    size0 = F.coalesce("size", F.lit(0))
    return out.select(
        "source", "weight", "max_repeats", F.coalesce("texts", F.lit(0)).alias("texts"), size0.alias("size"), "total",
        (size0 * F.col("max_repeats") >= F.col("weight") * F.col("total")).alias("enough"),
    )


def source_sizes(docs: DataFrame, targets: DataFrame, size: Column | None = None) -> DataFrame:
    """``source, weight, max_repeats, texts, size, total, enough``: what each source of the mixture holds.

    ``total`` is the size of all documents, of named sources or not. ``enough`` says whether the source can fill its share at
    its cap. Sources without documents have size 0.
    """
    return _sizes_of(_sized(docs, size), targets)


@dataclass
class Mixture:
    """``blocks``: the mixture's rows, see ``mix``; ``asked``: ``source, slots``, how many slots were drawn for each source;
    ``sizes``: see ``source_sizes``."""

    blocks: DataFrame
    asked: DataFrame
    sizes: DataFrame


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None, block: int = BLOCK, seed: int = 7, size: Column | None = None) -> DataFrame:
    """The mixture as rows ``shard, slot, source, pass, block, doc_id, begin, end``: which tokens of which texts fill each slot.

    ``total`` is the size aimed at in tokens; None: the size of all documents. Documents without doc_id, of other sources, or
    without text do not take part; repeated rows of a text count as texts of their own. Slots that no allowed pass can fill
    are left out. A last block of a packing group may hold fewer tokens than the others.
    """
    return mixture(docs, targets, total, block, seed, size).blocks


def _within(df: DataFrame, key: str, order: str, size: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``size`` over the rows of the key before, by ranges of (key, order)."""
    c = F.col
    all_ = cut(offsets(df, [key, order], size, "_all"))
    base = all_.groupBy(c(key).alias("_k")).agg(F.min("_all").alias("_base"))
    return all_.join(base, c(key) == c("_k")).withColumn(out, c("_all") - c("_base")).drop("_k", "_all", "_base")


def mixture(docs: DataFrame, targets: DataFrame, total: int | None = None, block: int = BLOCK, seed: int = 7, size: Column | None = None) -> Mixture:
    """``mix`` with what it was asked for and what the sources hold; documents are read once."""
    spark = docs.sparkSession
    want = _wanted(targets)
    sized = cut(_sized(docs, size))
    sizes = _sizes_of(sized, targets)
    if total is None:
        total = sized.agg(F.sum("size")).first()[0] or 0
    rows = sized.where(F.col("doc_id").isNotNull() & (F.col("size") > 0) & F.col("key").isin(*(k for k, *_ in want)))
    n = rows.count()
    groups = max(1, -(-n // PACK_ROWS))
    # a source's texts end to end, in packing groups of bounded size; one source may hold most rows
    rows = rows.withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    w = Window.partitionBy("key", "g").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("to", F.sum("size").over(w)).withColumn("from", F.col("to") - F.col("size"))
    spans = rows.withColumn("b", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
    spans = spans.select(
        "key", "g", "b", "doc_id", (F.greatest(F.col("from"), F.col("b") * block) - F.col("from")).alias("begin"),
        (F.least(F.col("to"), (F.col("b") + 1) * block) - F.col("from")).alias("end"),
    )
    spans = cut(spans)
    per = _within(spans.groupBy("key", "g").agg((F.max("b") + 1).alias("blocks")), "key", "g", "blocks", "first")
    held = {r["key"]: int(r["n"]) for r in per.groupBy("key").agg(F.sum("blocks").alias("n")).collect()}  # a row a source
    firsts = per.select(F.col("key").alias("k2"), F.col("g").alias("g2"), "first")
    # groups × sources rows: joined as they come, Spark broadcasts them while they are small
    indexed = spans.join(firsts, (F.col("key") == F.col("k2")) & (F.col("g") == F.col("g2"))).select("key", (F.col("first") + F.col("b")).alias("block"), "doc_id", "begin", "end")
    slots = max(1, math.ceil(total / block))
    shards = -(-slots // SHARD_BLOCKS)
    weights = np.array([max(x[2], 0.0) for x in want])
    if not len(want) or weights.sum() <= 0:
        none = spark.createDataFrame([], "shard long, slot long, source string, pass long, block long, doc_id long, begin long, end long")
        return Mixture(none, sizes.select("source", F.lit(0).cast("long").alias("slots")), sizes)
    weights = weights / weights.sum()

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for s in pdf["id"]:
                here = min(SHARD_BLOCKS, slots - s * SHARD_BLOCKS)
                counts = np.random.default_rng([seed, int(s)]).multinomial(here, weights)
                out.extend((int(s), k, int(c)) for k, c in enumerate(counts))
            yield pd.DataFrame(out, columns=["shard", "k", "n"])

    draws = spark.range(0, shards).mapInPandas(drawn, "shard long, k int, n long")
    draws = _within(draws, "k", "shard", "n", "first")
    names = F.create_map(*(x for k, (_, name, *_) in enumerate(want) for x in (F.lit(k), F.lit(name))))
    asked = draws.groupBy(names[F.col("k")].alias("source")).agg(F.sum("n").alias("slots"))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard, k, n, first in pdf.itertuples(index=False):
                key, name, _, repeats = want[k]
                size = held.get(key, 0)
                number = np.arange(first, first + n)
                if not size:
                    continue
                turn = number // size
                ok = turn < repeats
                number, turn = number[ok], turn[ok]
                index = np.empty(len(number), np.int64)
                for t in np.unique(turn):
                    index[turn == t] = permuted(number[turn == t] % size, size, seed * 1009 + k * 101 + int(t))
                yield pd.DataFrame({"shard": shard, "slot": np.arange(n)[ok], "key": key, "source": name, "pass": turn, "block": index})

    order = draws.select("shard", "k", "n", "first").mapInPandas(placed, "shard long, slot long, key string, source string, pass long, block long")
    joined = order.join(indexed.withColumnRenamed("key", "key_").withColumnRenamed("block", "block_"), (F.col("key") == F.col("key_")) & (F.col("block") == F.col("block_")))
    return Mixture(joined.select("shard", "slot", "source", "pass", "block", "doc_id", "begin", "end"), asked, sizes)


def mixture_shares(m: Mixture) -> DataFrame:
    """Per source of the mixture: target weight, size of all documents, slots drawn for it and those of them that texts fill,
    tokens placed, share reached, and the passes used."""
    filled = m.blocks.groupBy(F.col("source").alias("f"), "shard", "slot", F.col("pass").alias("turn")).agg(F.sum(F.col("end") - F.col("begin")).alias("tokens"))
    got = filled.groupBy("f").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("filled"), (F.max("turn") + 1).alias("passes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = m.asked.join(m.sizes.withColumnRenamed("source", "s"), F.col("source") == F.col("s")).join(got, F.col("source") == F.col("f"), "left")
    out = out.select("source", "weight", "max_repeats", "size", "total", "enough", "slots", zero("filled"), zero("tokens"), zero("passes"))
    return out.withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(1))))  # one row a source


def unfilled(m: Mixture) -> DataFrame:
    """``source`` of those that cannot fill their share even at their cap: the mixture left slots drawn for them empty, or
    placed less than their share, and, as the exact check (a draw may ask for more or less than the share), their size times
    ``max_repeats`` is less than it."""
    short = (F.col("filled") < F.col("slots")) | (F.col("tokens") < F.col("weight") * F.col("total"))
    return mixture_shares(m).where(short & ~F.col("enough")).select("source")
