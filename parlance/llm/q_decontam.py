"""Query op1: every occurrence of a benchmark item in the whole documents table."""

from __future__ import annotations

from .common import read_documents
from .decontam import find_leaks
from .registry import query


@query("op1_benchmark_decontamination")
def op1_benchmark_decontamination(spark, sf_dir):
    return find_leaks(read_documents(spark, sf_dir), read_documents(spark, sf_dir, "benchmark"))
