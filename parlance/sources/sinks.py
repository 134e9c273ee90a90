"""Writers for the output layouts (SK1-SK5).

Each returns the written path.  Nothing is funnelled through one task: files
are written per partition, ordered outputs are ordered within a partition by
their position key, and "one object per dataset" layouts become one folder
per dataset (``partitionBy``) holding ordered JSON lines.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path
from .json_ranges import local_path


def write_csv_quoted(df: DataFrame, path: str | None = None, sep: str = ",", partition_by: str | None = None) -> str:
    """SK1: header + every field quoted (embedded quotes doubled, whitespace kept)."""
    path = path or fresh_path(df.sparkSession, "csv")
    w = (df.write.option("header", True).option("quoteAll", True).option("escape", '"').option("sep", sep)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if partition_by:
        w = w.partitionBy(partition_by)
    w.csv(path)
    return path


def write_json_rows(df: DataFrame, path: str | None = None, partition_by: str | None = None) -> str:
    """SK2: JSON lines."""
    path = path or fresh_path(df.sparkSession, "json")
    w = df.write
    if partition_by:
        w = w.partitionBy(partition_by)
    w.json(path)
    return path


def write_lines(df: DataFrame, text_col: str, order_col: str, path: str | None = None) -> str:
    """SK3: one text per line in ``order_col`` order (range-partitioned, sorted inside partitions)."""
    path = path or fresh_path(df.sparkSession, "lines")
    df.repartitionByRange(order_col).sortWithinPartitions(order_col).select(text_col).write.text(path)
    return path


def write_json_arrays(df: DataFrame, group_col: str, order_col: str, path: str | None = None) -> str:
    """SK2 array form: one JSON array of records per ``group_col`` value and line (bounded groups only)."""
    path = path or fresh_path(df.sparkSession, "json-arrays")
    rec = F.struct(*[c for c in df.columns if c != group_col])
    per = df.groupBy(group_col).agg(F.sort_array(F.collect_list(F.struct(F.col(order_col).alias("__o"), rec.alias("r"))))
                                    .alias("items"))
    per.select(F.to_json(F.transform("items", lambda x: x["r"])).alias("value")).write.text(path)
    return path


def write_named_files(df: DataFrame, name_col: str, text_col: str, path: str | None = None) -> str:
    """SC9's layout: ``<name>.json`` holding one text, for each row of a table with few rows and different names.

    Files are written by the tasks, under their final name only when whole, so a task that runs twice leaves the same
    file.  The folder must be mounted by all executors.
    """
    path = path or fresh_path(df.sparkSession, "files")
    folder = local_path(path)
    if folder is None:
        raise ValueError(f"{path}: files can be named on a mounted folder only")

    def put(batches):
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for name, text in zip(b["name"], b["text"]):
                part = f"{folder}/_{uuid.uuid4().hex}"
                with open(part, "w", encoding="utf-8") as f:
                    f.write(text)
                os.replace(part, f"{folder}/{name}.json")
            yield b[["name"]]

    rows = df.select(F.col(name_col).cast("string").alias("name"), F.col(text_col).cast("string").alias("text"))
    rows.mapInPandas(put, "name string").write.format("noop").mode("overwrite").save()
    return path


def pack_submission(outputs: DataFrame, path: str | None = None, run_col: str | None = None) -> str:
    """SK5: per dataset (and run) the ordered outputs -- one folder per dataset, JSON lines sorted by ``pos``."""
    path = path or fresh_path(outputs.sparkSession, "submission")
    keys = ["dataset"] + ([run_col] if run_col else [])
    # ranges of (dataset, run, position): a large dataset is many files, whose names keep the order
    (outputs.repartitionByRange(*keys, "pos").sortWithinPartitions(*keys, "pos")
     .write.partitionBy(*keys).json(path))
    return path
