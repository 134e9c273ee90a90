"""Query op3: token ids of all documents written in the packed format and read back."""

from __future__ import annotations

import public_tokenizers

from .common import read_documents
from .packed_ids import packed_documents
from .registry import query


@query("op3_token_id_output")
def op3_token_id_output(spark, sf_dir):
    return packed_documents(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
