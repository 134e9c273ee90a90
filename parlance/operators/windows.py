"""Ordered per-key operators that stay exact when one key is huge.

A plain ``Window.partitionBy(dialog, slot).orderBy(turn)`` puts a whole key in
one task.  Dialogues are short, but a single key may hold a large share of the
rows, so the running operators here split every key into blocks of
``block_size`` consecutive order values and pass the state across blocks with
one small aggregate:

1. rows are hash-partitioned once by (keys, block); the row-level window runs
   per (keys, block), so no task sorts more than ``block_size`` rows of a key;
2. from the same exchange, a per-block aggregate gives each block's last value
   (one row per block);
3. a window over those block summaries (``#rows / block_size`` rows per key)
   gives every block the value carried in from earlier blocks, joined back on
   (keys, block) -- a small side against an already co-partitioned big side.

With short keys there is one block per key and the plan is the textbook window
plus a tiny aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 4096

_BLK = "__blk"
_SEED = "__seed"


def _block(order_col: str, block_size: int) -> Column:
    return F.floor(F.col(order_col) / F.lit(block_size)).cast("bigint")


def _blocked(df: DataFrame, keys: list[str], order: str, block_size: int,
             partition_by: list[str] | None) -> DataFrame:
    """Add the block column and hash-partition once by (partition keys, block).

    Both the row-level window and the per-block summary read this one
    exchange (Spark reuses it), so the input is computed and shuffled once.
    """
    d = df.withColumn(_BLK, _block(order, block_size))
    return d.repartition(*(partition_by or keys), _BLK)


def carry_forward(df: DataFrame, keys: list[str], order: str, value: str, out: str | None,
                  default=None, block_size: int = DEFAULT_BLOCK, partition_by: list[str] | None = None,
                  keep_block: str | None = None, exclusive_out: str | None = None) -> DataFrame:
    """``out`` = last non-null ``value`` at or before each row, per key.

    Equivalent to ``coalesce(last(value, true) over (partition by keys order by
    order rows unbounded preceding), default)``.  ``exclusive_out`` adds the
    same value strictly *before* the row (rows unbounded preceding .. 1
    preceding) from the same pass -- use it instead of a lag over the result,
    which would read the input twice more.  ``partition_by`` (a subset of
    ``keys``) chooses the shuffle keys, e.g. the dialogue alone so that later
    per-turn aggregates reuse the partitioning; ``keep_block`` keeps the block
    column under that name for such aggregates.
    """
    x = _blocked(df, keys, order, block_size, partition_by)
    wb = Window.partitionBy(*keys, _BLK).orderBy(order)
    local = x
    if out:
        local = local.withColumn("__local", F.last(F.col(value), ignorenulls=True).over(
            wb.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    if exclusive_out:
        local = local.withColumn("__local_x", F.last(F.col(value), ignorenulls=True).over(
            wb.rowsBetween(Window.unboundedPreceding, -1)))
    # one row per block: its last non-null value; carried over earlier blocks of the key
    summary = (x.groupBy(*keys, _BLK)
               .agg(F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order))).alias("__last")))
    bw = Window.partitionBy(*keys).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*keys, _BLK, F.last("__last", ignorenulls=True).over(bw).alias("__carry"))
    res = local.join(carry, [*keys, _BLK], "left")
    for col, loc in ((out, "__local"), (exclusive_out, "__local_x")):
        if col:
            val = F.coalesce(F.col(loc), F.col("__carry"))
            res = res.withColumn(col, F.coalesce(val, F.lit(default)) if default is not None else val)
    if keep_block:
        res = res.withColumnRenamed(_BLK, keep_block)
    return res.drop(_BLK, "__local", "__local_x", "__carry")


def running_sum_before(df: DataFrame, keys: list[str], order: str, value: str, out: str,
                       block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """``out`` = sum of ``value`` over the rows strictly before each one, per key, block-split like ``carry_forward``."""
    x = _blocked(df, keys, order, block_size, None)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    local = F.sum(value).over(before(Window.partitionBy(*keys, _BLK).orderBy(order)))
    sums = x.groupBy(*keys, _BLK).agg(F.sum(value).alias("__sum"))
    carry = sums.select(*keys, _BLK, F.sum("__sum").over(before(Window.partitionBy(*keys).orderBy(_BLK))).alias(_SEED))
    res = x.withColumn("__local", local).join(carry, [*keys, _BLK])
    return res.withColumn(out, F.coalesce("__local", F.lit(0)) + F.coalesce(_SEED, F.lit(0))).drop(_BLK, "__local", _SEED)


def previous_value(df: DataFrame, keys: list[str], order: str, value: str, out: str,
                   default=None, block_size: int = DEFAULT_BLOCK, partition_by: list[str] | None = None
                   ) -> DataFrame:
    """W6 building block: ``lag(value, 1, default)`` per key, block-split like ``carry_forward``."""
    x = _blocked(df, keys, order, block_size, partition_by)
    w = Window.partitionBy(*keys, _BLK).orderBy(order)
    local = (x.withColumn("__lag", F.lag(F.col(value)).over(w))
             .withColumn("__first", F.row_number().over(w) == 1))
    summary = x.groupBy(*keys, _BLK).agg(F.max_by(F.col(value), F.col(order)).alias("__last"))
    bw = Window.partitionBy(*keys).orderBy(_BLK)
    prev = summary.select(*keys, _BLK, F.lag("__last").over(bw).alias("__prev_blk"),
                          (F.row_number().over(bw) == 1).alias("__first_blk"))
    res = local.join(prev, [*keys, _BLK], "left")
    val = F.when(~F.col("__first"), F.col("__lag")).otherwise(F.col("__prev_blk"))
    if default is not None:
        val = F.when(F.col("__first") & F.col("__first_blk"), F.lit(default)).otherwise(val)
    return res.withColumn(out, val).drop(_BLK, "__lag", "__first", "__prev_blk", "__first_blk")
