"""Belief states and acts through the published JSON layouts (D1, D3, D4, A17, SC6, SC12): files written, loaded by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dialogue as D
from ..session import fresh_path, written
from ..sources import readers as R
from ..sources import registry
from ..sources.json_ranges import write_json_object
from . import fixtures as fx
from . import oracle as osql
from .q_dialogue import ACTS, MW, _utterances
from .registry import register

DATASET = "multiwoz21"


def _domain(name: str):
    """The state of one domain: booking and other slots, and the first booked entry as a list."""
    slots = [(i, c, n) for i, (d, c, n) in enumerate(fx.MW_SLOTS) if d == name]
    of = lambda kind: [F.col(f"v{i}").alias(n) for i, c, n in slots if c == kind]
    entry = F.struct(*[F.col(f"b{i}").alias(n) for i, c, n in slots if c == "book"] or [F.lit(None).alias("none")])
    booked = F.when(F.coalesce(*[F.col(f"b{i}") for i, _, _ in slots]).isNotNull(), F.array(entry)).otherwise(F.array())
    return F.struct(F.struct(*of("book"), booked.alias("booked")).alias("book"), F.struct(*of("semi")).alias("semi"))


def log_entries(utts: DataFrame, meta: DataFrame) -> DataFrame:
    """(dialog_id, value): each dialogue as the JSON text of its log, with the belief state of the system's turns."""
    picked = [F.max(F.when(F.col("si") == i, F.col(c))).alias(f"{p}{i}")
              for i in range(len(fx.MW_SLOTS)) for p, c in (("v", "value"), ("b", "booked_v"))]
    x = utts.join(meta.groupBy("dialog_id", "utt_idx").agg(*picked), ["dialog_id", "utt_idx"], "left")
    state = F.struct(*[F.when(F.col("is_sys"), _domain(d)).alias(d) for d in dict.fromkeys(s[0] for s in fx.MW_SLOTS)])
    entry = F.struct("utt_idx", F.struct("text", state.alias("metadata")).alias("u"))
    log = F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["u"])
    return x.groupBy("dialog_id").agg(F.to_json(F.struct(log.alias("log"))).alias("value"))


def act_entries(acts: DataFrame) -> DataFrame:
    """(dialog_id, value): each dialogue's acts as JSON text, ``{turn: {act: [[slot, value], ...]}}``."""
    pair = F.struct("pos", F.array("slot", "value").alias("p"))
    act = acts.groupBy("dialog_id", "turn", "annotated", "act").agg(
        F.min("pos").alias("first"), F.sort_array(F.collect_list(pair)).alias("pairs"))
    turn = act.groupBy("dialog_id", "turn", "annotated").agg(F.sort_array(F.collect_list(F.struct(
        "first", "act", F.col("pairs.p").alias("pairs")))).alias("acts"))
    text = F.when(F.col("annotated"), F.to_json(F.map_from_entries(F.transform(
        "acts", lambda a: F.struct(a["act"], a["pairs"]))))).otherwise(F.lit('"No Annotation"'))
    member = F.concat(F.lit('"'), F.col("turn").cast("string"), F.lit('": '), text)
    return turn.groupBy("dialog_id").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(member), ", "), F.lit("}"))
                                         .alias("value"))


@register("booked_overrides_from_file", MW + """
SELECT dialog_id, utt_idx, slot, value FROM state""")
def q_booked_overrides_from_file(spark, sf):
    """All dialogues in one JSON object, loaded by name in byte ranges; cut at misorder, belief state, booked values."""
    u, root = _utterances(spark, sf), fresh_path(spark, "dialogues")
    write_json_object(log_entries(u, fx.mw_metadata(u)), "dialog_id", "value",
                      path=registry.path_of(root, DATASET, "train"))
    e = D.explode_dialogues(registry.load(spark, DATASET, "train", root, by_range=True))
    e = written(e.withColumn("dialog_id", F.col("dialog_id").cast("bigint"))
                .withColumn("utt_idx", F.col("utt_idx").cast("bigint")), "logs")       # read by the cut and the state
    kept = D.cut_at_misorder(e.select("dialog_id", "utt_idx", "is_sys")).select("dialog_id", "utt_idx")
    return D.booked_overrides(R.belief_state(e.join(kept, ["dialog_id", "utt_idx"], "left_semi")))


# pairs of one act stand together in the file, so of two values of a slot the one whose act comes first is the first
@register("load_acts_from_file", MW + ACTS + f""",
fa AS (SELECT *, min(pos) OVER (PARTITION BY dialog_id, turn, act) * 10 + pos AS place FROM acts),
ff AS (
  SELECT dialog_id, turn, place, lower(split_part(act, '-', 1)) || '-' || lower(slot) AS full_slot, trim(lower(value)) AS value
  FROM fa
  WHERE annotated AND lower(split_part(act, '-', 2)) IN ('inform', 'recommend', 'select', 'book')
        AND lower(slot) <> 'none' AND trim(lower(value)) NOT IN ('?', 'none'))
SELECT dialog_id, turn, coalesce({osql.sql_map({k: [v] for k, v in D.ACT_SLOT_RENAME.items()})}[full_slot][1], full_slot)
         AS slot, arg_min(value, place) AS value
FROM ff GROUP BY ALL""")
def q_load_acts_from_file(spark, sf):
    """The act file beside the dialogues, loaded by name in byte ranges."""
    root = fresh_path(spark, "dialogues")
    write_json_object(act_entries(fx.mw_acts(_utterances(spark, sf))), "dialog_id", "value",
                      path=f"{root}/{DATASET}/{registry.ACTS_FILE}")
    acts = registry.load_acts(spark, DATASET, root, by_range=True)
    return D.load_acts(acts.withColumn("dialog_id", F.col("dialog_id").cast("bigint")))
