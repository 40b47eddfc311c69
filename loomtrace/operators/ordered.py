"""Ordered look-back without one task per key: running values by blocks with carry-over.

A window over a key sorts the key's rows in one task. Here the key's order is cut into blocks of ``width``; windows run
per block, and each block's outcome is carried to the following ones through a table of one row per key and block.
The input is read twice (rows and blocks): cut it first where it is dear to compute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.session import cut

WIDTH = 1 << 16


def running(df: DataFrame, keys: list[str], order: str, values: dict[str, tuple[str, Column]], include_self: bool = True, width: int = WIDTH, tie: str | None = None) -> DataFrame:
    """Adds, for each name, the running ``last`` (known), ``max`` or ``sum`` of an expression over the key's rows so far.

    ``include_self``: with the row itself, else only with those before it. ``order`` is an integer column; rows with equal
    keys and order come in order of ``tie`` where given. Null keys are keys like others. Nothing so far: null.
    """
    b = "_block"
    df = df.withColumn(b, F.floor(F.col(order) / width).cast("long")).withColumns({f"_v_{n}": e for n, (_, e) in values.items()})
    by = [order] + ([tie] if tie else [])
    w = Window.partitionBy(*keys, b).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0 if include_self else -1)
    agg = {"last": lambda c: F.last(c, ignorenulls=True), "max": F.max, "sum": F.sum}
    df = df.withColumns({f"_p_{n}": agg[how](F.col(f"_v_{n}")).over(w) for n, (how, _) in values.items()})
    place = F.struct(*by)
    of_block = [(F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), place)) if how == "last" else agg[how](F.col(f"_v_{n}"))).alias(f"_e_{n}") for n, (how, _) in values.items()]
    ends = df.groupBy(*keys, b).agg(*of_block)
    wk = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col(b).alias("_b"), *(agg[how](F.col(f"_e_{n}")).over(wk).alias(f"_c_{n}") for n, (how, _) in values.items()))
    on = F.col(b) == F.col("_b")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    both = {"last": F.coalesce, "max": F.greatest, "sum": lambda x, y: F.when(x.isNotNull() | y.isNotNull(), F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))}
    out = df.join(ends, on, "left").withColumns({n: both[how](F.col(f"_p_{n}"), F.col(f"_c_{n}")) for n, (how, _) in values.items()})
    return out.drop(b, "_b", *(f"_k_{k}" for k in keys), *(f"_{x}_{n}" for x in "vpc" for n in values))


def last_known(df: DataFrame, keys: list[str], order: str, value: Column, out: str, include_self: bool = True, width: int = WIDTH, tie: str | None = None) -> DataFrame:
    """Adds ``out``: the last non-null ``value`` of the key at or before the row (before it, without ``include_self``)."""
    return running(df, keys, order, {out: ("last", value)}, include_self, width, tie)


def offsets(df: DataFrame, order: list[str], size: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``size`` over all rows before, in the given order (unique), without one task for all rows.

    Rows are sorted by ranges; each range sums up for itself and is shifted by the sums of the ranges before.
    """
    c = F.col
    by = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    w = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = by.groupBy(c("_p").alias("_q")).agg(F.sum(size).alias("_s"))
    before = sums.select("_q", F.coalesce(F.sum("_s").over(Window.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))  # a row a partition
    return by.withColumn("_i", F.coalesce(F.sum(size).over(w), F.lit(0))).join(F.broadcast(before), c("_p") == c("_q")).withColumn(out, (c("_o") + c("_i")).cast("long")).drop("_p", "_q", "_i", "_o")
