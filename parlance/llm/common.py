"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path

#: The white space of the word rule, as the inside of a character class (space, \t \n \v \f \r).
SPACES = r"\x20\x09-\x0D"


def read_documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut at files that survive lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def worker_store(owner: str, name: str = "") -> dict:
    """A dict that a Python worker process keeps from task to task, for one operator (``owner``) at a time.

    An operator that asks for its store lets go of what another one left, so a
    reused worker never holds the memos of several.
    """
    holder = sys.modules.setdefault("parlance_worker_store", types.ModuleType("parlance_worker_store")).__dict__
    if holder.get("owner") != owner:
        holder["owner"], holder["stores"] = owner, {}
    return holder["stores"].setdefault(name, {})


def bounded_batches(spark: SparkSession, rows: int = 500) -> None:
    """Python workers get at most ``rows`` documents at once, so that a batch of long texts stays small."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores appended while the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_text(col: str = "text"):
    """The text, null read as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
