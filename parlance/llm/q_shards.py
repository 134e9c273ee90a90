"""Query op9: all documents in 40 shards of near-equal bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import read_documents
from .registry import query
from .shards import assign_shards

N_SHARDS = 40


@query("op9_sharding")
def op9_sharding(spark, sf_dir):
    out = assign_shards(read_documents(spark, sf_dir), N_SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
