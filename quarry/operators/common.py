"""Shared building blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, part, order: str, value: str, out: str, width: int = 4096) -> DataFrame:
    """Inclusive running sum of ``value`` over integer ``order`` within ``part``, split for hot groups.

    Rows are grouped in blocks of ``width`` consecutive ``order`` values:
    block totals (one row per block) are prefix-summed per group, then rows
    within their block.  No window ever holds more than one block of a
    group, so a group with a third of all rows still spreads over many tasks.
    Ties in ``order`` are summed together (RANGE semantics).
    """
    part = list(part)
    b = df.withColumn("__blk", F.floor(F.col(order) / width))
    totals = b.groupBy(*part, "__blk").agg(F.sum(value).alias("__bt"))
    wb = Window.partitionBy(*part).orderBy("__blk")
    boff = totals.select(*part, "__blk", (F.sum("__bt").over(wb) - F.col("__bt")).alias("__boff"))
    wr = Window.partitionBy(*part, "__blk").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    inner = b.withColumn("__in", F.sum(value).over(wr))
    return (inner.join(boff, part + ["__blk"]).withColumn(out, F.col("__boff") + F.col("__in"))
            .drop("__blk", "__boff", "__in"))


MAX_BROADCAST_ROWS = 2_000_000


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_rows: int = MAX_BROADCAST_ROWS, bound: int | None = None) -> DataFrame:
    """Join a large table with a side that is usually small (hits, new keys).

    The small side's size is proven first — by ``bound`` when the caller knows
    an upper bound (e.g. questions × k), else by counting it; within
    ``max_rows`` it is broadcast and the large side streams through without a
    shuffle, beyond it an ordinary (shuffled) join is used.
    """
    n = bound if bound is not None else small.count()
    side = F.broadcast(small) if n <= max_rows else small
    return big.join(side, on, how)


def next_row(df: DataFrame, part, order: str, cols, prefix: str = "next_", width: int = 4096) -> DataFrame:
    """``lead`` of ``cols`` over integer ``order`` within ``part``, split for hot groups.

    Rows are cut into blocks of ``width`` consecutive ``order`` values; the lead
    is taken inside a block, and a block's last row takes the first row of the
    next non-empty block (a window over one row per block).  No window holds
    more than one block of a group.
    """
    part, cols = list(part), list(cols)
    b = df.withColumn("__blk", F.floor(F.col(order) / width))
    w = Window.partitionBy(*part, "__blk").orderBy(order)
    inner = b.select("*", *[F.lead(c).over(w).alias(prefix + c) for c in cols],
                     F.lead(F.lit(1)).over(w).isNull().alias("__last"))
    firsts = b.groupBy(*part, "__blk").agg(F.min_by(F.struct(*cols), F.col(order)).alias("__first"))
    wb = Window.partitionBy(*part).orderBy("__blk")
    heads = firsts.select(*part, "__blk", F.lead("__first").over(wb).alias("__nf"))
    j = inner.join(heads, part + ["__blk"], "left")
    for c in cols:
        j = j.withColumn(prefix + c, F.when(F.col("__last"), F.col("__nf")[c]).otherwise(F.col(prefix + c)))
    return j.drop("__blk", "__last", "__nf")
