"""Readers for the input layouts (SC1-SC9) -- explicit schemas, no inference.

Every reader takes a path (file, folder or glob) and returns a DataFrame;
position columns are minted from the file and the record offset where the
layout's order is data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import STRIP_WS_CLASS
from ..session import fresh_path
from .json_ranges import read_json_elements


def _strip(col):
    """``str.strip()``: every whitespace character at both ends (Spark's trim only removes spaces)."""
    return F.regexp_replace(col, f"^[{STRIP_WS_CLASS}]+|[{STRIP_WS_CLASS}]+$", "")

INTENT_SCHEMA = T.StructType([T.StructField("text", T.StringType()), T.StructField("category", T.StringType())])

SLOT_EXAMPLE_SCHEMA = T.StructType([
    T.StructField("userInput", T.StructType([T.StructField("text", T.StringType())])),
    T.StructField("context", T.StructType([T.StructField("requestedSlots", T.ArrayType(T.StringType()))])),
    T.StructField("labels", T.ArrayType(T.StructType([
        T.StructField("slot", T.StringType()),
        T.StructField("valueSpan", T.StructType([T.StructField("startIndex", T.IntegerType()),
                                                 T.StructField("endIndex", T.IntegerType())]))]))),
    T.StructField("pos", T.LongType()),
])

# belief state of an utterance by domain; a nested value (the ``booked`` list) stays its JSON text in the string map
METADATA_SCHEMA = "map<string,struct<book:map<string,string>,semi:map<string,string>>>"
UTTERANCE_SCHEMA = f"struct<text:string,metadata:{METADATA_SCHEMA}>"
KEYED_LOG_SCHEMA = f"map<string,struct<log:array<{UTTERANCE_SCHEMA}>>>"
# acts of a dialogue by turn; a turn without annotation holds a plain string, kept as its text
KEYED_ACTS_SCHEMA = "map<string,map<string,string>>"
TURN_ACTS_SCHEMA = "map<string,array<array<string>>>"
TRANSCRIPT_SCHEMA = ("struct<dialogue_idx:string,dialogue:array<struct<turn_idx:int,system_transcript:string,"
                     "transcript:string,turn_label:array<array<string>>>>>")
_SIM_UTTERANCE = "struct<tokens:array<string>,slots:array<struct<slot:string,start:int,exclusive_end:int>>>"
SPAN_DIALOGUE_SCHEMA = ("struct<dialogue_id:string,turns:array<struct<"
                        f"system_utterance:{_SIM_UTTERANCE},user_utterance:{_SIM_UTTERANCE},"
                        "dialogue_state:array<struct<slot:string,value:string>>>>>")
JSON_SETS_SCHEMA = "map<string,array<array<string>>>"


def json_objects(spark: SparkSession, path: str, schema: str, whole_files: bool = False) -> DataFrame:
    """One parsed value (column ``value``) a line, or a file.

    ``whole_files``: each file is one JSON value, indented or not.  A file is
    then one task's work; a large one is converted to one value a line (or to
    Parquet) once.  What cannot be parsed raises instead of reading as nothing.
    """
    raw = spark.read.text(path, wholetext=whole_files)
    raw = raw.where(F.trim("value") != "")
    return raw.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("value"))


def _elements(spark: SparkSession, path: str, schema, **ranges) -> DataFrame:
    """The elements (``key``, ``value`` parsed) of one JSON file of any size, read by many tasks (see ``json_ranges``)."""
    return read_json_elements(spark, path, **ranges).withColumn(
        "value", F.from_json("value", schema, {"mode": "FAILFAST"}))


def read_intent_csv(spark: SparkSession, path: str) -> DataFrame:
    """SC1: comma CSV with header ``text,category`` (quoted fields may hold newlines)."""
    return (spark.read.schema(INTENT_SCHEMA).option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))


def read_delim_project(spark: SparkSession, path: str, sep: str = ";",
                       cols=("scenario", "intent", "answer_from_anno")) -> DataFrame:
    """SC2: ``;``-CSV, columns picked by header name; category = scenario_intent."""
    raw = (spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"')
           .option("inferSchema", False).csv(path))
    scen, intent, text = cols
    return raw.select(F.col(text).alias("text"), F.concat_ws("_", scen, intent).alias("category"))


def read_many_files(spark: SparkSession, path: str) -> DataFrame:
    """SC3: one file per category; the category comes from the file (partition) name."""
    df = spark.read.schema("text string").option("header", True).option("multiLine", True) \
        .option("escape", '"').csv(path)
    return df.select("text", F.regexp_extract(F.col("_metadata.file_path"), r"category=([^/]+)/", 1)
                     .alias("category"))


def read_json_sets(spark: SparkSession, path: str, keep=("train", "test", "val"), whole_files: bool = False) -> DataFrame:
    """SC4: JSON objects of named sets ``{set: [[text, category], ...]}``; other sets are dropped."""
    raw = json_objects(spark, path, JSON_SETS_SCHEMA, whole_files)
    sets = raw.select(F.explode("value").alias("set_name", "rows"))
    return _set_rows(sets.where(F.col("set_name").isin(*keep)).select("set_name", F.explode("rows").alias("r")))


def read_json_sets_by_range(spark: SparkSession, path: str, keep=("train", "test", "val"), **ranges) -> DataFrame:
    """SC4 for files of any size: a set of any length is read by many tasks."""
    rows = _elements(spark, path, "array<string>", level=2, **ranges)
    return _set_rows(rows.where(F.col("parent").isin(*keep)).select(F.col("parent").alias("set_name"),
                                                                    F.col("value").alias("r")))


def _set_rows(rows: DataFrame) -> DataFrame:
    return rows.select("set_name", F.try_element_at("r", F.lit(1)).alias("text"),
                       F.try_element_at("r", F.lit(2)).alias("category"))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType = SLOT_EXAMPLE_SCHEMA,
                    multi_line: bool = False) -> DataFrame:
    """SC5: JSON arrays of objects (each array element becomes a row)."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def read_json_array_by_range(spark: SparkSession, path: str, schema: T.StructType = SLOT_EXAMPLE_SCHEMA,
                             **ranges) -> DataFrame:
    """SC5 for files of any size: one JSON array, read by many tasks."""
    return _elements(spark, path, schema, **ranges).select("value.*")


def read_keyed_logs(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """SC6: JSON objects keyed by dialogue id (``dialogues`` map column), one a line or one a file."""
    return json_objects(spark, path, KEYED_LOG_SCHEMA, whole_files).withColumnRenamed("value", "dialogues")


def read_keyed_logs_by_range(spark: SparkSession, path: str, **ranges) -> DataFrame:
    """SC6 for files of any size: one row a dialogue, each file read by many tasks (see ``json_ranges``)."""
    d = _elements(spark, path, f"struct<log:array<{UTTERANCE_SCHEMA}>>", **ranges)
    return d.select(F.create_map("key", "value").alias("dialogues"))


def read_keyed_acts(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Dialogue acts ``{dialogue: {turn: {act: [[slot, value], ...]}}}``: one row a (slot, value), in order.

    A turn whose value is a string ("No Annotation") gives one row with ``annotated`` false.
    """
    return _act_rows(json_objects(spark, path, KEYED_ACTS_SCHEMA, whole_files)
                     .select(F.explode("value").alias("dialog_id", "turns")))


def read_keyed_acts_by_range(spark: SparkSession, path: str, **ranges) -> DataFrame:
    """``read_keyed_acts`` for files of any size, read by many tasks."""
    d = _elements(spark, path, "map<string,string>", **ranges)
    return _act_rows(d.select(F.col("key").alias("dialog_id"), F.col("value").alias("turns")))


def _act_rows(dialogues: DataFrame) -> DataFrame:
    turns = dialogues.select("dialog_id", F.explode("turns").alias("turn", "acts"))
    plain = ~F.ltrim("acts").startswith("{")
    acts = F.when(~plain, F.from_json("acts", TURN_ACTS_SCHEMA))
    rows = turns.select("dialog_id", F.col("turn").cast("bigint").alias("turn"), plain.alias("plain"),
                        F.posexplode_outer(F.map_entries(acts)).alias("act_pos", "a"))
    return (rows.select("dialog_id", "turn", "plain", "act_pos", F.col("a.key").alias("act"),
                        F.posexplode_outer("a.value").alias("pair_pos", "p"))
            .where(F.col("plain") | F.col("p").isNotNull())
            .select("dialog_id", "turn", (F.coalesce("act_pos", F.lit(0)) * F.lit(1 << 20).cast("bigint")
                                          + F.coalesce("pair_pos", F.lit(0))).alias("pos"), "act",
                    F.try_element_at("p", F.lit(1)).alias("slot"), F.try_element_at("p", F.lit(2)).alias("value"),
                    (~F.col("plain")).alias("annotated")))


def read_transcripts(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Transcript dialogues: one row a turn (dialog_id, turn, system_transcript, transcript, turn_label pairs)."""
    return _transcript_turns(json_objects(spark, path, f"array<{TRANSCRIPT_SCHEMA}>", whole_files)
                             .select(F.inline("value")))


def read_transcripts_by_range(spark: SparkSession, path: str, **ranges) -> DataFrame:
    """``read_transcripts`` for files of any size, read by many tasks."""
    return _transcript_turns(_elements(spark, path, TRANSCRIPT_SCHEMA, **ranges).select("value.*"))


def _transcript_turns(d: DataFrame) -> DataFrame:
    return d.select(F.col("dialogue_idx").alias("dialog_id"), F.inline("dialogue")).withColumnRenamed("turn_idx", "turn")


def read_span_dialogues(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Span dialogues: one row a turn (dialog_id, turn, both utterances' tokens and spans, dialogue state)."""
    return _span_turns(json_objects(spark, path, f"array<{SPAN_DIALOGUE_SCHEMA}>", whole_files)
                       .select(F.inline("value")))


def read_span_dialogues_by_range(spark: SparkSession, path: str, **ranges) -> DataFrame:
    """``read_span_dialogues`` for files of any size, read by many tasks."""
    return _span_turns(_elements(spark, path, SPAN_DIALOGUE_SCHEMA, **ranges).select("value.*"))


def _span_turns(d: DataFrame) -> DataFrame:
    t = d.select(F.col("dialogue_id").alias("dialog_id"), F.posexplode("turns").alias("turn", "t"))
    return t.select("dialog_id", F.col("turn").cast("bigint").alias("turn"), "t.*")


def belief_state(utterances: DataFrame) -> DataFrame:
    """The state rows of utterances with typed ``metadata``: domain, category, name, value, booked_v.

    ``booked_v`` is the value of the first booked entry with that name; the list itself is no slot.
    """
    u = utterances.select("dialog_id", "utt_idx", F.explode("metadata").alias("domain", "m"))
    u = u.withColumn("booked", F.get(F.from_json(F.col("m.book")["booked"], "array<map<string,string>>"), F.lit(0)))
    side = lambda c: F.transform(F.map_entries(F.coalesce(F.col(f"m.{c}"), F.create_map().cast("map<string,string>"))),
                                 lambda e: F.struct(F.lit(c).alias("category"), e["key"].alias("name"),
                                                    e["value"].alias("value")))
    s = u.select("dialog_id", "utt_idx", "domain", "booked", F.inline(F.concat(side("book"), side("semi"))))
    s = s.where(~((F.col("category") == "book") & (F.col("name") == "booked")))
    return s.select("dialog_id", "utt_idx", "domain", "category", "name", "value",
                    F.try_element_at("booked", F.col("name")).alias("booked_v"))


def read_tsv_field(spark: SparkSession, path: str, field: int = 3) -> DataFrame:
    """SC7: strip each line, split on tab, keep field ``field`` (1-based)."""
    return spark.read.text(path).select(F.try_element_at(F.split(_strip(F.col("value")), "\t"), F.lit(field)).alias("value"))


def read_tagged_lines(spark: SparkSession, path: str, compat_first_colon: bool = False) -> DataFrame:
    """SC8: ``tok:TAG tok:TAG <=> INTENT`` -> tokens, tags, intent.

    Words are split at their *last* colon; ``compat_first_colon`` reproduces the
    reference, which takes the part after the first colon as the tag (Q13).
    """
    parts = F.split(_strip(F.col("value")), " <=> ")
    items = F.regexp_extract_all(F.try_element_at(parts, F.lit(1)), F.lit(f"[^{STRIP_WS_CLASS}]+"), 0)
    if compat_first_colon:
        tok = F.transform(items, lambda w: F.try_element_at(F.split(w, ":"), F.lit(1)))
        tag = F.transform(items, lambda w: F.try_element_at(F.split(w, ":"), F.lit(2)))
    else:
        tok = F.transform(items, lambda w: F.regexp_extract(w, r"^(.*):[^:]*$", 1))
        tag = F.transform(items, lambda w: F.regexp_extract(w, r":([^:]*)$", 1))
    lines = spark.read.text(path)
    return lines.select(tok.alias("tokens"), tag.alias("tags"), F.try_element_at(parts, F.lit(2)).alias("intent"))


# ------------------------------------------------------------ keyed logs

def write_keyed_logs(spark: SparkSession, utts: DataFrame) -> str:
    """SK2 for the keyed-log layout: one ``{dialog_id: {log: [...]}}`` object per line.

    One dialogue's log is one JSON object by definition of the format.
    """
    path = fresh_path(spark, "keyed-logs")
    item = F.struct("utt_idx", "text", "is_sys")
    per = utts.groupBy("dialog_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    empty = F.create_map().cast("map<string,string>")
    state = F.create_map(F.lit("hotel"), F.struct(empty.alias("book"), empty.alias("semi")))   # system side has one
    log = F.transform("items", lambda x: F.struct(
        x["text"].alias("text"), F.when(x["is_sys"], state).otherwise(
            F.create_map().cast(METADATA_SCHEMA)).alias("metadata")))
    obj = per.select(F.to_json(F.create_map(F.col("dialog_id").cast("string"),
                                            F.struct(log.alias("log")))).alias("value"))
    obj.write.text(path)
    return path
