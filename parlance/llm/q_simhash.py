"""Query op4: SimHash groups of the whole documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import read_documents
from .registry import query
from .simhash import near_duplicates

WIDTH, RADIUS = 3, 2


@query("op4_simhash_near_dedup")
def op4_simhash_near_dedup(spark, sf_dir):
    found = near_duplicates(read_documents(spark, sf_dir), WIDTH, RADIUS)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
