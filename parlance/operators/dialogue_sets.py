"""Turn labelling for the transcript (D7, D10, F6) and pre-tokenised span (D8, D11, F16) dialogue sets.

Neither set has referrals, so nothing depends on other slots of the same turn:
the labels are row-local rules plus, per (dialogue, slot), the class seen at
an earlier turn -- a block-split running value (``windows``), no fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import label_map_column
from ..functions.values import label_existence
from .windows import carry_forward


def _last_pos(positions: Column) -> tuple[Column, Column]:
    last = F.try_element_at(positions, F.lit(-1))
    return F.coalesce(last["start"], F.lit(-1)), F.coalesce(last["end"], F.lit(-1))


def transcript_turn_label(rows: DataFrame, label_maps: dict, label_col: str = "label") -> DataFrame:
    """Class per (turn, slot): none/dontcare as is; copy_value when the value (or a variant) is in the
    user tokens (span = last occurrence); inform when in the system tokens; else unpointable."""
    maps = label_map_column(label_maps)
    lab = F.coalesce(F.col(label_col), F.lit("none"))
    usr = label_existence("usr_toks", lab, maps)
    sys_ = label_existence("sys_toks", lab, maps)
    s, e = _last_pos(usr["positions"])
    cls = (F.when(lab.isin("none", "dontcare"), lab)
           .when(usr["found"], F.lit("copy_value"))
           .when(sys_["found"], F.lit("inform"))
           .otherwise(F.lit("unpointable")))
    return rows.withColumn("label_value", lab).withColumn("class_raw", cls) \
        .withColumn("label_start", F.when(cls == "copy_value", s).otherwise(-1).cast("bigint")) \
        .withColumn("label_end", F.when(cls == "copy_value", e).otherwise(-1).cast("bigint"))


def transcript_examples(rows: DataFrame, label_maps: dict) -> DataFrame:
    """D7 plus the dialogue rules -- unpointable -> none; a class equal to the slot's last seen class
    (other than copy_value / inform) -> none; inform label = value when inform."""
    t = transcript_turn_label(rows, label_maps)
    t = t.withColumn("__seen_upd", F.when(F.col("class_raw") != "none", F.col("class_raw")))
    t = carry_forward(t, ["dialog_id", "slot"], "turn", "__seen_upd", None, exclusive_out="seen_class")
    final = (F.when(F.col("class_raw") == "unpointable", F.lit("none"))
             .when(F.col("seen_class").isNotNull() & (F.col("class_raw") == F.col("seen_class"))
                   & ~F.col("class_raw").isin("copy_value", "inform"), F.lit("none"))
             .otherwise(F.col("class_raw")))
    return t.select("dialog_id", "turn", "slot", "label_value", "class_raw", final.alias("class_label"),
                    F.when(F.col("class_raw") == "inform", F.col("label_value")).otherwise(F.lit("none"))
                    .alias("inform_label"), "label_start", "label_end")


def span_turn_label(rows: DataFrame) -> DataFrame:
    """Per (turn, slot) from the current and previous dialogue state and the annotated spans.

    ``rows``: dialog_id, turn, slot, value (current state, NULL = absent), prev_value,
    usr_toks, sys_toks, usr_spans, sys_spans (array<struct<slot,start,exclusive_end>>).
    dontcare counts only at its first occurrence; a span whose tokens equal the
    value gives copy_value (user, first matching span) or inform (system);
    a changed value without any span is an error row (the reference raises).
    """
    v, pv = F.col("value"), F.col("prev_value")

    def first_match(toks: str, spans: str):
        init = F.struct(F.col(toks).alias("t"), F.lit(None).cast("struct<start:int,exclusive_end:int>").alias("hit"))
        return F.aggregate(F.coalesce(F.col(spans), F.array().cast("array<struct<slot:string,start:int,exclusive_end:int>>")),
                           init,
                           lambda acc, sp: F.when(acc["hit"].isNotNull(), acc).otherwise(F.struct(
                               acc["t"], F.when((sp["slot"] == F.col("slot")) & (F.array_join(
                                   F.slice(acc["t"], sp["start"] + 1, F.greatest(sp["exclusive_end"] - sp["start"], F.lit(0))),
                                   " ") == v),
                                   F.struct(sp["start"].alias("start"), sp["exclusive_end"].alias("exclusive_end")))
                               .alias("hit"))),
                           lambda acc: acc["hit"])

    u, s = first_match("usr_toks", "usr_spans"), first_match("sys_toks", "sys_spans")
    dc_first = (v == "dontcare") & (pv.isNull() | (pv != "dontcare"))
    cls = (F.when(v.isNull(), F.lit("none"))
           .when(dc_first, F.lit("dontcare"))
           .when(u.isNotNull(), F.lit("copy_value"))
           .when(s.isNotNull(), F.lit("inform"))
           .when(pv.isNull() | (v != pv), F.lit("error"))
           .otherwise(F.lit("none")))
    return rows.select("dialog_id", "turn", "slot", cls.alias("class_label"),
                       F.when(cls == "copy_value", u["start"]).otherwise(-1).alias("label_start"),
                       F.when(cls == "copy_value", u["exclusive_end"]).otherwise(-1).alias("label_end"),
                       F.when(cls == "inform", v).otherwise(F.lit("none")).alias("inform_label"),
                       F.coalesce(v, F.lit("none")).alias("value"))


def span_examples(rows: DataFrame) -> DataFrame:
    """D8 per turn plus the dialogue-state class of earlier turns (``diag_state``, none at turn 0)."""
    t = span_turn_label(rows)
    t = t.withColumn("__u", F.when(~F.col("class_label").isin("none", "error"), F.col("class_label")))
    t = carry_forward(t, ["dialog_id", "slot"], "turn", "__u", None, default="none", exclusive_out="diag_state")
    return t.drop("__u")
