"""Prediction records (SC10, SC11).

The state decoder writes one *wide* JSON object per turn with
``<field>_<slot>`` keys.  Every metric groups by slot, so the first thing the
engine does is unpivot to one row per (dialogue, turn, slot): a row-local
``explode`` of an array of structs, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT_FIELDS = ("class_label_id", "class_prediction", "start_pos", "start_prediction",
              "end_pos", "end_prediction", "refer_id", "refer_prediction")
STR_FIELDS = ("slot_groundtruth", "slot_prediction")


def record_schema(slots) -> T.StructType:
    fields = [T.StructField("guid", T.ArrayType(T.StringType()))]
    for s in slots:
        fields += [T.StructField(f"{k}_{s}", T.LongType()) for k in INT_FIELDS]
        fields += [T.StructField(f"{k}_{s}", T.StringType()) for k in STR_FIELDS]
    return T.StructType(fields)


def unpivot_predictions(wide: DataFrame, slots, with_file: bool = False,
                        dialog_type: str = "string") -> DataFrame:
    """SC10: wide per-turn records -> (set_type, dialog_id, turn, slot, fields...).

    The guid is split once into three columns by position (set, dialogue, turn);
    dialogue ids may themselves contain '-', so the string form is never re-split.
    """
    entries = F.array(*[
        F.struct(F.lit(s).alias("slot"),
                 *[F.col(f"`{k}_{s}`").cast("bigint").alias(k) for k in INT_FIELDS],
                 *[F.col(f"`{k}_{s}`").cast("string").alias(k) for k in STR_FIELDS])
        for s in slots])
    g = F.col("guid")
    keep = ["_file"] if with_file else []
    return (wide.select(*keep,
                        F.try_element_at(g, F.lit(1)).alias("set_type"),
                        F.array_join(F.slice(g, 2, F.size(g) - 2), "-").cast(dialog_type).alias("dialog_id"),
                        F.try_element_at(g, F.lit(-1)).cast("bigint").alias("turn"),
                        F.explode(entries).alias("e"))
            .select(*keep, "set_type", "dialog_id", "turn", "e.*"))


def read_prediction_files(spark: SparkSession, pattern: str, slots, dialog_type: str = "string",
                          multi_line: bool = True) -> DataFrame:
    """SC11: glob JSON prediction files (one array of records per file) into one long table.

    The source file becomes a column, so scoring all runs is one job with the
    file as an extra group key.  ``multi_line=True`` reads the decoder's own
    files (one indented JSON array per file); ``False`` reads JSON lines whose
    lines are arrays of records.
    """
    raw = (spark.read.schema(record_schema(slots)).option("multiLine", multi_line).json(pattern)
           .withColumn("_file", F.col("_metadata.file_path")))
    return unpivot_predictions(raw, slots, with_file=True, dialog_type=dialog_type)
