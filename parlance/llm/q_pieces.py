"""Query op5: every whole document encoded with the piece model and decoded again."""

from __future__ import annotations

import public_tokenizers

from .common import bounded_batches, read_documents
from .registry import query
from .sp_codec import encoded_summary


@query("op5_sentencepiece_codec")
def op5_sentencepiece_codec(spark, sf_dir):
    bounded_batches(spark)
    return encoded_summary(read_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"),
                           memo_units=1_000_000)
