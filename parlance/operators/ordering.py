"""Dense row indices without a global (single-task) sort.

``dense_index`` numbers rows 0..n-1 inside each group.  Rows are spread over
``buckets`` hash buckets per group; a partial aggregate counts each bucket, a
window over the (group, bucket) counts gives each bucket its offset, and the
row number inside a bucket finishes the index.  A hot group is therefore
numbered by ``buckets`` tasks in parallel, and the order is reproducible
(bucket = md5 of the order key, then the order key), so the same recipe runs
in SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUPER_BLOCK = 1024       # blocks whose offsets are summed in one group
DEFAULT_BUCKETS = 4096   # per group: a hot group is numbered by up to 4096 tasks


def md5_bucket(key: Column, buckets: int) -> Column:
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % buckets


def dense_index(df: DataFrame, group: list[str], order: str, out: str = "idx",
                buckets: int = DEFAULT_BUCKETS, count_col: str | None = None,
                range_block: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based index within ``group``.

    Default order: (md5 bucket of ``order``, ``order``) -- a reproducible
    pseudo-random order, good for draws.  With ``range_block`` the buckets are
    ``order div range_block``, which gives the exact rank by ``order`` (file
    order).  ``order`` must be unique within a group.  With ``count_col`` the
    group size is added too.
    """
    bucket = (F.floor(F.col(order) / range_block).cast("bigint") if range_block
              else md5_bucket(F.col(order), buckets))
    b = df.withColumn("__b", bucket)
    counts = b.groupBy(*group, "__b").agg(F.count(F.lit(1)).alias("__n"))
    gw = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))

    def before(w):
        return F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    if range_block:
        # as many buckets as the data has blocks: their offsets are summed in two levels
        counts = counts.withColumn("__s", F.floor(F.col("__b") / SUPER_BLOCK).cast("bigint"))
        supers = counts.groupBy(*group, "__s").agg(F.sum("__n").alias("__n"))
        supers = supers.withColumn("__soff", before(gw.orderBy("__s")))
        if count_col:
            supers = supers.withColumn(count_col, F.sum("__n").over(gw))
        offs = (counts.withColumn("__loff", before(Window.partitionBy(*group, "__s").orderBy("__b")))
                .join(supers.drop("__n"), [*group, "__s"])
                .withColumn("__off", F.col("__soff") + F.col("__loff")).drop("__s", "__soff", "__loff"))
    else:
        offs = counts.withColumn("__off", before(gw.orderBy("__b")))
        if count_col:
            offs = offs.withColumn(count_col, F.sum("__n").over(gw))
    rw = Window.partitionBy(*group, "__b").orderBy(order)
    numbered = b.withColumn("__rn", F.row_number().over(rw))
    res = numbered.join(offs.drop("__n"), [*group, "__b"]).withColumn(out, F.col("__off") + F.col("__rn") - 1)
    return res.drop("__b", "__rn", "__off")


def global_rank(df: DataFrame, order: list, out: str = "rank") -> DataFrame:
    """Add ``out`` = 0-based rank of each row by ``order`` (columns that tell all rows apart), without a one-task sort.

    Rows are range-partitioned and written with their partition's number; a partition's offset is the sum of the
    partition sizes before it (one row a partition), and the row number inside it finishes the rank.
    """
    from ..session import written
    parts = written(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranked")
    sizes = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    nth = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return (parts.withColumn("__nth", nth).join(offsets, "__p")
            .withColumn(out, F.col("__off") + F.col("__nth") - 1).drop("__p", "__nth", "__off"))


def sql_dense_index(table: str, group: list[str], order: str, out: str = "idx",
                    buckets: int = DEFAULT_BUCKETS, count_col: str | None = None, by_order: bool = False) -> str:
    """The same numbering in DuckDB SQL over ``table`` (oracle side)."""
    g = ", ".join(group)
    part = f"PARTITION BY {g}" if group else ""
    bucket = f"('0x' || substr(md5(CAST({order} AS VARCHAR)), 1, 8))::BIGINT % {buckets}"
    key = order if by_order else f"{bucket}, {order}"
    cnt = f", count(*) OVER ({part}) AS {count_col}" if count_col else ""
    return (f"SELECT *, CAST(row_number() OVER ({part} ORDER BY {key}) - 1 AS BIGINT) AS {out}{cnt} "
            f"FROM {table}")
