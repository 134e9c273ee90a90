"""Query op2: token counts of every whole document."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from .common import read_documents
from .registry import query
from .token_counts import token_counts

LIMIT = 1024


@query("op2_token_counts")
def op2_token_counts(spark, sf_dir):
    counts = token_counts(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
