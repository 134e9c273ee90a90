"""Sharding by sampled splitters: near-equal bytes, equal texts together where the law allows it.

Method.  The key of a record is a 64-bit hash of its text, so equal texts are
neighbours.  A size-weighted sample of keys (exponential priorities, a fixed
expected number of rows) gives quantile boundaries of many small ranges; records are
range-partitioned by them.  A range that is overfull is subdivided: its other
keys by a second hash of the key (equal texts stay whole), and a key that by
itself outweighs a quarter of a shard by a hash of a row number that is saved
with the rows, so one text that holds a third of all rows still spreads, also
when its ids are null or equal.  The pieces are dealt to the shards by
decreasing size, always to the lightest shard.  A record's slot is its piece's
offset in the shard plus its rank in the piece; no task numbers more than one
piece.

The row numbers follow the files as they are read, so the shards of a table
are the same whenever it is read in the same splits.

What the driver holds is bounded by parameters: the sample, and one row a
piece (``shards * ranges_per_shard`` and as many subdivisions at most).

Defined cases: null text counts 0 bytes and is grouped with the empty text;
repeated rows, null ids and equal ids each get a slot of their own and are
sampled and spread like any other row; an empty table gives an empty
result.  Only the id and text columns are read, extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, whole_text

ROW_BYTES = 16          # bytes a row counts besides its text
RANGES_PER_SHARD = 32   # small ranges for each shard
SAMPLE_PER_RANGE = 16   # sampled keys for each range boundary
WHOLE_GROUP = 0.25      # equal texts stay in one piece up to this share of a shard


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row a record: id, size, crc32 of the text, key (hash of the text), row (a number for draws).

    ``row`` depends on the tasks, so the rows are to be saved before anything is drawn by it.
    """
    t = whole_text(text_col)
    raw = t.cast("binary")
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(t) + ROW_BYTES).cast("long").alias("size"),
                       F.crc32(raw).alias("text_crc32"), F.xxhash64(t).alias("key"),
                       F.monotonically_increasing_id().alias("row"))


def splitters(rows: DataFrame, n_ranges: int, total: int, per_range: int = SAMPLE_PER_RANGE) -> list[int]:
    """Quantile boundaries of a size-weighted sample of keys.

    A row's priority is exponential with its size as the rate; rows under ``n / total`` are drawn, which are
    ``n = n_ranges * per_range`` or fewer in expectation, whatever the number of rows or tasks.
    """
    unit = (F.pmod(F.xxhash64("row", F.lit("draw")), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    drawn = rows.filter(-F.log(unit) / F.col("size") < n_ranges * per_range / max(1, total)).select("key")
    keys = np.sort(np.array([r[0] for r in drawn.collect()], dtype=np.int64))
    if not len(keys):
        return []
    at = (np.arange(1, n_ranges) * len(keys)) // n_ranges
    return sorted(set(keys[at].tolist()))


def _range_of(bounds: list[int]):
    edges = np.array(bounds, dtype=np.int64)

    @F.pandas_udf(T.IntegerType())
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, key.to_numpy(), side="right").astype(np.int32))

    return range_of


def deal(pieces: list[tuple[int, int, int, int]], n_shards: int) -> list[tuple[int, int, int, int]]:
    """Pieces (range, part, bytes, rows) to shards, largest first to the lightest; gives (range, part, shard, offset)."""
    heap = [(0, s, 0) for s in range(n_shards)]
    out = []
    for rng, part, size, n in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        load, shard, rows = heapq.heappop(heap)
        out.append((rng, part, shard, rows))
        heapq.heappush(heap, (load + size, shard, rows + n))
    return out


def assign_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text",
                  ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 ..), slot (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    rows = saved(sized(docs, id_col, text_col), "shard-rows")
    n_ranges = n_shards * ranges_per_shard
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranged = saved(rows.withColumn("range", _range_of(splitters(rows, n_ranges, total))("key")), "shard-ranges")
    limit = max(1, math.ceil(total / n_ranges))
    whole = max(2 * limit, math.ceil(WHOLE_GROUP * total / n_shards))
    # keys that are too large for one piece: total / whole rows at most
    heavy = ranged.groupBy("key").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > whole)
    heavy = heavy.select("key", F.ceil(F.col("bytes") / limit).cast("int").alias("parts")).collect()
    heavy_keys = _table(spark, heavy, "key long, parts int")
    tagged = ranged.join(F.broadcast(heavy_keys), "key", "left")
    light = tagged.filter("parts is null").groupBy("range").agg(F.sum("size").alias("bytes"))
    light = light.filter(F.col("bytes") > 2 * limit).select(
        "range", F.ceil(F.col("bytes") / limit).cast("int").alias("cuts")).collect()
    cuts = _table(spark, light, "range int, cuts int")
    # part: 0 .. for the range's light keys, below 0 for the shares of heavy keys (a key's shares by row number)
    share = F.pmod(F.xxhash64("row", F.lit("share")), F.col("parts"))
    order = {r["key"]: i for i, r in enumerate(sorted(heavy, key=lambda r: r["key"]))}
    rank = _table(spark, [(k, i) for k, i in order.items()], "key long, heavy_rank int")
    parted = (tagged.join(F.broadcast(rank), "key", "left").join(F.broadcast(cuts), "range", "left")
              .withColumn("part", F.when(F.col("parts").isNotNull(),
                                         -1 - (F.col("heavy_rank").cast("long") * (n_ranges + 1) + share))
                          .otherwise(F.pmod(F.xxhash64("key", F.lit("cut")), F.coalesce("cuts", F.lit(1)))))
              .select("doc_id", "size", "text_crc32", "key", "row", "range", "part"))
    pieces = parted.groupBy("range", "part").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    dealt = _table(spark, deal([tuple(p) for p in pieces], n_shards), "range int, part long, shard int, offset long")
    in_piece = Window.partitionBy("range", "part").orderBy("key", "doc_id", "row")
    return (parted.withColumn("nth", F.row_number().over(in_piece)).join(F.broadcast(dealt), ["range", "part"])
            .select("doc_id", "size", "text_crc32", "shard",
                    (F.col("offset") + F.col("nth") - 1).cast("long").alias("slot")))


def _table(spark, rows: list, schema: str) -> DataFrame:
    """A bounded list of the driver as a DataFrame (see the module text for the bounds)."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)
