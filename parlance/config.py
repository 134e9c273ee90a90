"""Dataset configuration (SC9): class types, slot list, value label maps.

A configuration file is small and bounded (tens of KB), so it is read once on
the driver and turned into literal columns (arrays / maps) that every task
evaluates locally: no join, no shuffle, size bounded by the config file, not
by the data.  The label maps themselves are a *parameter*: pass the dataset's
JSON configuration file; nothing big is embedded here.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Class-type names with special meaning in the scorers.
NONE, DONTCARE, COPY_VALUE, TRUE, FALSE, REFER, INFORM, UNPOINTABLE = (
    "none", "dontcare", "copy_value", "true", "false", "refer", "inform", "unpointable")
# Values that never match through label-map variants.
NON_VARIANT_VALUES = ("none", "dontcare", "true", "false")


@dataclass(frozen=True)
class DatasetConfig:
    class_types: tuple[str, ...]
    slots: tuple[str, ...]
    label_maps: dict = field(default_factory=dict)

    def class_index(self, name: str):
        return self.class_types.index(name) if name in self.class_types else None


def py_tokens(text: str) -> list[str]:
    """Driver-side tokenisation for *config literals only* (same rule as F1)."""
    return [t for t in (p.strip() for p in re.split(r"(\W+)", text)) if t]


def py_tokenize(text: str) -> str:
    if "Ġ" in text:
        text = text.replace(" ", "").replace("Ġ", " ").strip()
    return " ".join(py_tokens(text))


def tokenized_label_maps(label_maps: dict) -> dict:
    """Scorer form of the label maps: keys and variants tokenised (later key wins)."""
    out = {}
    for k, vs in label_maps.items():
        out[py_tokenize(k)] = [py_tokenize(v) for v in vs]
    return out


def label_map_column(label_maps: dict) -> Column:
    """map<string, array<string>> literal; bounded by the config file size."""
    if not label_maps:
        return F.create_map().cast("map<string,array<string>>")
    args = []
    for k, vs in label_maps.items():
        args += [F.lit(k), F.array(*[F.lit(v) for v in vs]).cast("array<string>")]
    return F.create_map(*args)


def variants_of(maps: Column, key) -> Column:
    """Variants of ``key`` or NULL when ``key`` has no entry."""
    return F.try_element_at(maps, key if isinstance(key, Column) else F.col(key))


CONFIG_SCHEMA = T.StructType([
    T.StructField("class_types", T.ArrayType(T.StringType())),
    T.StructField("slots", T.ArrayType(T.StringType())),
    T.StructField("label_maps", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
])


def read_config_frame(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """SC9 as a DataFrame: one row (class_types, slots, label_maps) per config file.

    ``name``: a column with the file's name without ``.json``, for a folder with the files of several data sets.
    """
    raw = spark.read.text(path, wholetext=True)
    file = [F.regexp_extract("_metadata.file_name", r"^(.*?)(\.json)?$", 1).alias(name)] if name else []
    return raw.select(*file, F.from_json("value", CONFIG_SCHEMA).alias("c")).select(*([name] if name else []), "c.*")


def config_tables(cfg_frame: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SC9 as the three relational tables class_type(idx,name), slot(idx,name), label_variant; other columns are kept."""
    kept = [c for c in cfg_frame.columns if c not in CONFIG_SCHEMA.names]
    ct = cfg_frame.select(*kept, F.posexplode("class_types").alias("idx", "name"))
    sl = cfg_frame.select(*kept, F.posexplode("slots").alias("idx", "name"))
    lv = (cfg_frame.select(*kept, F.explode("label_maps").alias("canonical", "variants"))
          .select(*kept, "canonical", F.posexplode("variants").alias("ord", "variant")))
    return ct, sl, lv


def load_dataset_config(spark: SparkSession, path: str) -> DatasetConfig:
    """SC9: read a config JSON (bounded, tiny) into a driver-side object."""
    row = read_config_frame(spark, path).first()
    return DatasetConfig(tuple(row["class_types"] or ()), tuple(row["slots"] or ()),
                         dict(row["label_maps"] or {}))


def config_from_json_text(text: str) -> DatasetConfig:
    raw = json.loads(text)
    return DatasetConfig(tuple(raw["class_types"]), tuple(raw["slots"]), dict(raw.get("label_maps", {})))
