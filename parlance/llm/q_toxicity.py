"""Query op7: the toxicity score of every whole document."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import read_documents
from .registry import query
from .toxicity import held_out, scored, train


@query("op7_toxicity")
def op7_toxicity(spark, sf_dir):
    docs = read_documents(spark, sf_dir)
    model = train(docs, read_documents(spark, sf_dir, "labels"))
    return scored(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
