"""Dialogue-state scoring queries (D15-D17, W1, A4-A8, F1, F2, F9, J8, SC10).

Each builder takes (spark, sf_dir) and returns a DataFrame over the whole
driver tables.  Names follow the operator keys of the design notes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import is_in_list, tokenize_str, word_tokens
from ..operators import dst_scoring as dst
from . import fixtures as fx
from . import oracle as osql
from .registry import register

KEY3 = "dialog_id, turn, slot"

# ---------------------------------------------------------------- DST scoring


@register("scan_predictions_long", osql.DST_LONG + """
SELECT set_type, dialog_id, turn, slot, class_label_id, class_prediction, start_pos, start_prediction,
       end_pos, end_prediction, refer_id, refer_prediction, slot_groundtruth, slot_prediction FROM dst""")
def q_scan_predictions_long(spark, sf):
    from ..sources.predictions import unpivot_predictions
    return unpivot_predictions(fx.dst_predictions_wide(spark, sf), fx.DST_SLOTS, dialog_type="bigint")


@register("word_tokenise", f"""
SELECT conv_id, turn, {osql.sql_tokstr('text')} AS tokenized,
       CAST(len({osql.sql_toks('text')}) AS BIGINT) AS n_tokens
FROM conversations""")
def q_word_tokenise(spark, sf):
    c = fx.read_table(spark, sf, "conversations")
    return c.select("conv_id", "turn", tokenize_str("text").alias("tokenized"),
                    F.size(word_tokens("text")).cast("bigint").alias("n_tokens"))


@register("detok_byte_bpe", f"""
SELECT conv_id, turn, {osql.sql_tokstr("'Ġ' || replace(text, ' ', 'Ġ')")} AS detok
FROM conversations""")
def q_detok_byte_bpe(spark, sf):
    c = fx.read_table(spark, sf, "conversations")
    bpe = F.concat(F.lit("Ġ"), F.replace(F.col("text"), F.lit(" "), F.lit("Ġ")))
    return c.select("conv_id", "turn", tokenize_str(bpe).alias("detok"))


@register("token_window_contains", osql.DST_LONG + f""",
t AS (SELECT dst.*, lower(ut.text) AS utext FROM dst JOIN ut USING (dialog_id, turn))
SELECT {KEY3}, {osql.sql_iil('utext', 'slot_groundtruth')} AS gt_in_user,
       {osql.sql_iil('slot_groundtruth', 'slot_prediction')} AS pd_in_gt
FROM t""")
def q_token_window_contains(spark, sf):
    p = fx.dst_predictions_long(spark, sf)
    u = fx.user_turns(spark, sf).select("dialog_id", "turn", F.lower("text").alias("utext"))
    t = p.join(u, ["dialog_id", "turn"])
    return t.select("dialog_id", "turn", "slot",
                    is_in_list("utext", "slot_groundtruth").alias("gt_in_user"),
                    is_in_list("slot_groundtruth", "slot_prediction").alias("pd_in_gt"))


@register("fuzzy_inform_eval", osql.DST_LONG + f""",
tk AS (SELECT *, {osql.sql_tokstr('slot_groundtruth')} AS gt_value,
              regexp_replace({osql.sql_tokstr('slot_prediction')}, '^§§ ?', '') AS iv FROM dst)
SELECT {KEY3}, {osql.sql_inform('gt_value', 'iv')} AS informed FROM tk""")
def q_fuzzy_inform_eval(spark, sf):
    from ..config import label_map_column, tokenized_label_maps
    p = fx.dst_predictions_long(spark, sf)
    maps = label_map_column(tokenized_label_maps(fx.DST_LABEL_MAPS))
    t = (p.withColumn("gt_value", tokenize_str("slot_groundtruth"))
         .withColumn("iv", F.regexp_replace(tokenize_str("slot_prediction"), "^§§ ?", "")))
    return t.select("dialog_id", "turn", "slot", dst.slot_inform_value("gt_value", "iv", maps).alias("informed"))


@register("apply_update_rule", osql.DST_PREPARED + f"""
SELECT {KEY3}, "update", update_error FROM prepared""")
def q_apply_update_rule(spark, sf):
    return dst.prepare(fx.dst_predictions_long(spark, sf), fx.DST_CONFIG).select(
        "dialog_id", "turn", "slot", "update", "update_error")


@register("carry_forward_state", osql.DST_PREPARED + f"""
SELECT {KEY3}, joint_pd FROM prepared""")
def q_carry_forward_state(spark, sf):
    return dst.prepare(fx.dst_predictions_long(spark, sf), fx.DST_CONFIG).select(
        "dialog_id", "turn", "slot", "joint_pd")


@register("value_correct", osql.DST_PREPARED + f"""
SELECT {KEY3}, gt_value, joint_pd, value_ok FROM prepared""")
def q_value_correct(spark, sf):
    return dst.prepare(fx.dst_predictions_long(spark, sf), fx.DST_CONFIG).select(
        "dialog_id", "turn", "slot", "gt_value", "joint_pd", "value_ok")


@register("joint_goal_accuracy", osql.DST_PREPARED + """,
pt AS (SELECT dialog_id, turn, min(value_ok) AS turn_ok FROM prepared GROUP BY dialog_id, turn)
SELECT count(*) AS n_turns, round(avg(turn_ok), 6) AS joint_goal_acc FROM pt""")
def q_joint_goal_accuracy(spark, sf):
    return dst.joint_goal_accuracy(dst.prepare(fx.dst_predictions_long(spark, sf), fx.DST_CONFIG))


@register("slot_value_accuracy", osql.DST_PREPARED + """
SELECT slot, count(*) AS n_turns, round(avg(value_ok), 6) AS value_acc FROM prepared GROUP BY slot""")
def q_slot_value_accuracy(spark, sf):
    return dst.slot_value_accuracy(dst.prepare(fx.dst_predictions_long(spark, sf), fx.DST_CONFIG))


def _prf_sql(tn_cond: str, scope: str) -> str:
    names = osql.sql_list(fx.DST_CLASS_TYPES)
    k = len(fx.DST_CLASS_TYPES)
    return osql.DST_LONG + f""",
pc AS (SELECT {scope} AS scope, class_label_id AS gt, class_prediction AS pd, count(*) AS n
       FROM dst GROUP BY ALL),
x AS (SELECT * FROM pc CROSS JOIN range(0, {k}) r(class_idx)),
a AS (SELECT scope, class_idx,
        sum(CASE WHEN gt = pd AND gt = class_idx THEN n ELSE 0 END) AS tp,
        sum(CASE WHEN {tn_cond} THEN n ELSE 0 END) AS tn,
        sum(CASE WHEN gt <> pd AND pd = class_idx THEN n ELSE 0 END) AS fp,
        sum(CASE WHEN gt <> pd AND gt = class_idx THEN n ELSE 0 END) AS fn
      FROM x GROUP BY scope, class_idx),
b AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS precision,
                CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS recall FROM a)
SELECT scope, CAST(class_idx AS INTEGER) AS class_idx, {names}[class_idx + 1] AS class_name,
       CAST(tp AS BIGINT) AS tp, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
       round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 1.0 END, 6) AS f1,
       round(CASE WHEN tp + tn + fp + fn > 0 THEN (tp + tn) / (tp + tn + fp + fn) ELSE 1.0 END, 6) AS accuracy
FROM b"""


@register("turn_class_prf", _prf_sql("gt <> class_idx AND pd <> class_idx", "'__all__'"))
def q_turn_class_prf(spark, sf):
    return dst.class_prf(fx.dst_predictions_long(spark, sf), fx.DST_CONFIG, tn_rule="all_rows", pooled=True)


@register("turn_class_prf_per_slot", _prf_sql("gt = pd AND gt <> class_idx", "slot"))
def q_turn_class_prf_per_slot(spark, sf):
    return dst.class_prf(fx.dst_predictions_long(spark, sf), fx.DST_CONFIG, tn_rule="hits_only", pooled=False)


@register("confusion_offdiag", osql.DST_LONG + f""",
pc AS (SELECT class_label_id AS gt, class_prediction AS pd, count(*) AS n FROM dst GROUP BY ALL),
rows_ AS (SELECT gt, sum(n) AS n_gt FROM pc GROUP BY gt),
grid AS (SELECT g.i AS gt_class, p.i AS pd_class FROM range(0, {len(fx.DST_CLASS_TYPES)}) g(i),
                range(0, {len(fx.DST_CLASS_TYPES)}) p(i)),
cells AS (SELECT gt, pd, sum(CASE WHEN gt <> pd THEN n ELSE 0 END) AS miss FROM pc GROUP BY gt, pd)
SELECT gt_class, pd_class, round(coalesce(miss, 0) / n_gt, 6) AS rate
FROM grid LEFT JOIN rows_ ON rows_.gt = grid.gt_class
LEFT JOIN cells ON grid.gt_class = cells.gt AND grid.pd_class = cells.pd""")
def q_confusion_offdiag(spark, sf):
    return dst.confusion_offdiag(fx.dst_predictions_long(spark, sf), fx.DST_CONFIG)


@register("span_and_refer_accuracy", osql.DST_LONG + """
SELECT slot,
  round(coalesce(avg(CASE WHEN class_label_id = 2 THEN (CASE WHEN class_label_id = class_prediction
        AND start_pos = start_prediction AND end_pos = end_prediction THEN 1.0 ELSE 0.0 END) END), 1.0), 6) AS span_acc,
  round(coalesce(avg(CASE WHEN class_label_id = 5 THEN (CASE WHEN class_label_id = class_prediction
        AND refer_id = refer_prediction THEN 1.0 ELSE 0.0 END) END), 1.0), 6) AS refer_acc,
  round(avg(CASE WHEN class_label_id = class_prediction THEN 1.0 ELSE 0.0 END), 6) AS class_acc
FROM dst GROUP BY slot""")
def q_span_and_refer_accuracy(spark, sf):
    return dst.span_refer_accuracy(fx.dst_predictions_long(spark, sf), fx.DST_CONFIG)


@register("joint_goal_scoring", osql.DST_PREPARED + """,
pt AS (SELECT dialog_id, turn, min(value_ok) AS turn_ok FROM prepared GROUP BY dialog_id, turn),
sr AS (SELECT slot,
  round(coalesce(avg(CASE WHEN class_label_id = 2 THEN (CASE WHEN class_label_id = class_prediction
        AND start_pos = start_prediction AND end_pos = end_prediction THEN 1.0 ELSE 0.0 END) END), 1.0), 6) AS span_acc,
  round(coalesce(avg(CASE WHEN class_label_id = 5 THEN (CASE WHEN class_label_id = class_prediction
        AND refer_id = refer_prediction THEN 1.0 ELSE 0.0 END) END), 1.0), 6) AS refer_acc,
  round(avg(CASE WHEN class_label_id = class_prediction THEN 1.0 ELSE 0.0 END), 6) AS class_acc
  FROM prepared GROUP BY slot)
SELECT 'joint_goal_acc' AS metric, '__all__' AS scope, round(avg(turn_ok), 6) AS value FROM pt
UNION ALL SELECT 'value_acc', slot, round(avg(value_ok), 6) FROM prepared GROUP BY slot
UNION ALL SELECT 'span_acc', slot, span_acc FROM sr
UNION ALL SELECT 'refer_acc', slot, refer_acc FROM sr
UNION ALL SELECT 'class_acc', slot, class_acc FROM sr""")
def q_joint_goal_scoring(spark, sf):
    return dst.score_report(fx.dst_predictions_long(spark, sf), fx.DST_CONFIG)
