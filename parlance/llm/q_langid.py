"""Query op8: the language of every whole document."""

from __future__ import annotations

from .common import read_documents
from .langid import held_out, predicted, train
from .registry import query


@query("op8_language_id")
def op8_language_id(spark, sf_dir):
    docs = read_documents(spark, sf_dir)
    out = predicted(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score")
