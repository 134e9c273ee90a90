"""Query op13: ids of every whole document by a rank file, and the bytes they decode to."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from .bpe_tree import decode, encode, n_ids
from .common import read_documents
from .registry import query


@query("op13_byte_bpe_codec")
def op13_byte_bpe_codec(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    codec = decode(encode(docs, path, public_tokenizers.PATTERN), path)
    return codec.select("doc_id", n_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
