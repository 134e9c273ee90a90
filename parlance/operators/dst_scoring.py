"""Dialogue-state scoring.

Input is the *long* prediction table, one row per (dialogue, turn, slot) with
the per-slot fields of a prediction record (see ``sources.predictions``).
All per-row logic is native column expressions; the only shuffles are the
running state per (dialogue, slot) and the per-turn product over slots.  Class
statistics pre-aggregate to a (slot, gt, pred) count matrix first, so their
cost after the first partial aggregate is independent of the row count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (COPY_VALUE, DONTCARE, FALSE, INFORM, NON_VARIANT_VALUES, NONE, REFER, TRUE,
                      DatasetConfig, label_map_column, tokenized_label_maps, variants_of)
from ..functions.text import contains_window, tokenize_str, word_tokens
from ..functions.values import any_variant_matches
from .windows import carry_forward

# referral/inform value marks written by the state decoder.
MARK_SPACE = "§§ "
MARK = "§§"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def slot_inform_value(gold, informed, maps: Column, gold_toks=None, informed_toks=None) -> Column:
    """map an informed value onto the gold value when they match loosely.

    ``elif`` order of the scorer: equal, containment either way, then the
    informed value's variants; the gold value's variants are only consulted when
    the informed value has no label-map entry at all.  Pass precomputed token
    arrays to avoid re-tokenising.
    """
    g, v = _c(gold), _c(informed)
    gt = _c(gold_toks) if gold_toks is not None else word_tokens(g)
    vt = _c(informed_toks) if informed_toks is not None else word_tokens(v)
    v_vars = variants_of(maps, v)
    g_vars = variants_of(maps, g)

    def both_ways(x, xt, y, yt):
        return (x == y) | contains_window(yt, xt) | contains_window(xt, yt)

    hit = (
        both_ways(g, gt, v, vt)
        | F.when(v_vars.isNotNull(), any_variant_matches(v_vars, g, gt))
          .otherwise(any_variant_matches(g_vars, v, vt))
    )
    return F.when(hit, g).otherwise(v)


def update_rule(cfg: DatasetConfig, pd_class, pd_slot, mark_len, informed, inform_ok) -> tuple[Column, Column]:
    """(update, error).  ``update`` NULL means the state is kept.

    ``mark_len`` is 3 for a ``§§ `` prefix, 2 for ``§§``, 0 otherwise;
    ``informed`` is the F9-resolved value behind the mark.
    """
    pc, pd, mk = _c(pd_class), _c(pd_slot), _c(mark_len)
    idx = cfg.class_index
    null = F.lit(None).cast("string")
    marked = F.when(_c(inform_ok), _c(informed))
    branches = [
        (idx(NONE), null, null),
        (idx(DONTCARE), F.lit(DONTCARE), null),
        (idx(COPY_VALUE), pd, null),
        (idx(TRUE), F.lit(TRUE), null),
        (idx(FALSE), F.lit(FALSE), null),
        (idx(REFER), F.when(mk > 0, marked).when(pd != NONE, pd), null),
        (idx(INFORM), F.when(mk > 0, marked), F.when(mk == 0, F.lit("unexpected slot value format"))),
    ]
    u_expr, e_expr = None, None
    seen = set()
    for i, u, e in branches:
        if i is None or i in seen:
            continue
        seen.add(i)
        u_expr = F.when(pc == i, u) if u_expr is None else u_expr.when(pc == i, u)
        e_expr = F.when(pc == i, e) if e_expr is None else e_expr.when(pc == i, e)
    return u_expr.otherwise(null), e_expr.otherwise(F.lit("unexpected class type"))


def value_correct(gold, pred, maps: Column) -> Column:
    """D16 with J5: equal, or a label-map variant of a gold value other than none/dontcare/true/false.

    The variant test is a lookup in the (config-bounded) label-map literal, so the
    implied join on (canonical, variant) needs no shuffle.
    """
    g, p = _c(gold), _c(pred)
    via_variant = F.coalesce(F.exists(variants_of(maps, g), lambda x: x == p), F.lit(False))
    return F.when(g == p, 1).when(~g.isin(*NON_VARIANT_VALUES) & via_variant, 1).otherwise(0)


def prepare(preds: DataFrame, cfg: DatasetConfig, keys=("dialog_id", "turn", "slot"),
            block_size: int = 4096) -> DataFrame:
    """SC10 -> F1/F2 -> D15 -> W1 -> D16 on the long prediction table.

    Adds gt_value, pd_value (tokenised), update, update_error, joint_pd, value_ok.
    """
    dialog, turn, slot = keys
    maps = label_map_column(tokenized_label_maps(cfg.label_maps))
    pd = F.col("pd_value")
    # few projections (each DataFrame step is analysed again on the client)
    t = preds.select("*", tokenize_str("slot_groundtruth").alias("gt_value"),
                     tokenize_str("slot_prediction").alias("pd_value"))
    mark_len = F.when(F.substring(pd, 1, 3) == MARK_SPACE, 3).when(F.substring(pd, 1, 2) == MARK, 2).otherwise(0)
    iv = (F.when(F.substring(pd, 1, 3) == MARK_SPACE, F.substring(pd, 4, 1 << 30))
          .when(F.substring(pd, 1, 2) == MARK, F.substring(pd, 3, 1 << 30)))
    t = t.select("*", mark_len.alias("mark_len"), iv.alias("iv"), word_tokens("gt_value").alias("gt_toks"),
                 word_tokens(iv).alias("iv_toks"))
    t = t.select("*", slot_inform_value("gt_value", "iv", maps, "gt_toks", "iv_toks").alias("informed"))
    u, e = update_rule(cfg, "class_prediction", "pd_value", "mark_len", "informed", F.col("iv") != NONE)
    t = t.select(*[c for c in t.columns if c not in ("mark_len", "iv", "gt_toks", "iv_toks", "informed")],
                 u.alias("update"), e.alias("update_error"))
    # shuffle by (dialogue, block) only: the per-turn goal aggregate reuses this partitioning
    s = carry_forward(t, [dialog, slot], turn, "update", "joint_pd", default=NONE, block_size=block_size,
                      partition_by=[dialog], keep_block="turn_block")
    return s.withColumn("value_ok", value_correct("gt_value", "joint_pd", maps))


def update_violations(prepared: DataFrame) -> DataFrame:
    """Rows the reference scorer aborts on (its ``exit()``), as data."""
    return prepared.where(F.col("update_error").isNotNull())


def joint_goal_accuracy(prepared: DataFrame, dialog="dialog_id", turn="turn") -> DataFrame:
    """A4: per turn the product (min) of slot correctness, averaged over turns."""
    # the block of a turn is a function of the turn: grouping by it too keeps the earlier partitioning
    keys = [dialog, "turn_block", turn] if "turn_block" in prepared.columns else [dialog, turn]
    per_turn = prepared.groupBy(*keys).agg(F.min("value_ok").alias("turn_ok"))
    return per_turn.agg(F.count(F.lit(1)).alias("n_turns"),
                        F.round(F.avg("turn_ok"), 6).alias("joint_goal_acc"))


def slot_value_accuracy(prepared: DataFrame, slot="slot") -> DataFrame:
    """A5: per slot joint value accuracy (== joint slot accuracy)."""
    return prepared.groupBy(slot).agg(F.count(F.lit(1)).alias("n_turns"),
                                      F.round(F.avg("value_ok"), 6).alias("value_acc"))


def class_pair_counts(preds: DataFrame, slot="slot") -> DataFrame:
    """(slot, gt, pd) -> n.  Partial aggregation keeps this skew-proof (at most K*K rows per slot)."""
    return (preds.groupBy(slot, F.col("class_label_id").alias("gt"), F.col("class_prediction").alias("pd"))
            .agg(F.count(F.lit(1)).alias("n")))


def class_prf(preds: DataFrame, cfg: DatasetConfig, tn_rule: str = "all_rows",
              pooled: bool = True, slot="slot") -> DataFrame:
    """TP/TN/FP/FN, precision, recall, F1, accuracy per class (pooled over slots or per slot).

    ``tn_rule='all_rows'``: every class that is neither gold nor predicted gets a TN
    on every row.  ``tn_rule='hits_only'``: only rows with a correct class count,
    and there every other class gets a TN (Q3).
    """
    pc = class_pair_counts(preds, slot)
    scope = F.lit("__all__") if pooled else F.col(slot)
    k = len(cfg.class_types)
    x = pc.select(scope.alias("scope"), "gt", "pd", "n",
                  F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("class_idx"))
    c = F.col("class_idx")
    hit = F.col("gt") == F.col("pd")
    if tn_rule == "all_rows":
        tn_cond = (F.col("gt") != c) & (F.col("pd") != c)
    elif tn_rule == "hits_only":
        tn_cond = hit & (F.col("gt") != c)
    else:
        raise ValueError(tn_rule)
    agg = x.groupBy("scope", "class_idx").agg(
        F.sum(F.when(hit & (F.col("gt") == c), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(tn_cond, F.col("n")).otherwise(0)).alias("tn"),
        F.sum(F.when(~hit & (F.col("pd") == c), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit & (F.col("gt") == c), F.col("n")).otherwise(0)).alias("fn"),
    )
    names = F.array(*[F.lit(n) for n in cfg.class_types])
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(1.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(1.0)
    tot = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    return (agg.withColumn("precision", p).withColumn("recall", r)
            .withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                     2 * F.col("precision") * F.col("recall")
                                     / (F.col("precision") + F.col("recall"))).otherwise(1.0))
            .withColumn("accuracy", F.when(tot > 0, (F.col("tp") + F.col("tn")) / tot).otherwise(1.0))
            .select("scope", "class_idx", F.element_at(names, F.col("class_idx") + 1).alias("class_name"),
                    F.col("tp").cast("bigint").alias("tp"), F.col("tn").cast("bigint").alias("tn"),
                    F.col("fp").cast("bigint").alias("fp"), F.col("fn").cast("bigint").alias("fn"),
                    *[F.round(F.col(m), 6).alias(m) for m in ("precision", "recall", "f1", "accuracy")]))


def confusion_offdiag(preds: DataFrame, cfg: DatasetConfig, slot="slot") -> DataFrame:
    """Misses gold a -> predicted b divided by the number of gold-a rows (pooled).

    The diagonal is always 0 (only misses are counted); rows of a class that
    never occurs as gold have rate NULL (printed ``----`` by the reference).
    """
    pc = class_pair_counts(preds, slot)
    k = len(cfg.class_types)
    cells = pc.groupBy("gt", "pd").agg(F.sum(F.when(F.col("gt") != F.col("pd"), F.col("n")).otherwise(0))
                                        .alias("miss"))
    rows = pc.groupBy(F.col("gt").alias("gt_class")).agg(F.sum("n").alias("n_gt"))
    # the K x K grid of the configured classes (generated, not joined); every side is at most K x K rows
    ids = F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))
    grid = (cells.sparkSession.range(1)
            .select(F.explode(ids).alias("gt_class"))
            .select("gt_class", F.explode(ids).alias("pd_class")))
    full = (grid.join(rows, "gt_class", "left")
            .join(cells, (F.col("gt_class") == F.col("gt")) & (F.col("pd_class") == F.col("pd")), "left"))
    # a class that never occurs as gold has an empty row (printed as ---- by the reference)
    return full.select("gt_class", "pd_class",
                       F.round(F.coalesce(F.col("miss"), F.lit(0)) / F.col("n_gt"), 6).alias("rate"))


def span_refer_accuracy(preds: DataFrame, cfg: DatasetConfig, slot="slot") -> DataFrame:
    """Per slot, span exactness among gold copy_value rows and referral exactness among gold refer rows.

    A wrong class counts 0; no such rows gives 1.0.
    """
    cv, rf = cfg.class_index(COPY_VALUE), cfg.class_index(REFER)
    hit = F.col("class_label_id") == F.col("class_prediction")
    pos_ok = F.when(F.col("class_label_id") == cv,
                    F.when(hit & (F.col("start_pos") == F.col("start_prediction"))
                           & (F.col("end_pos") == F.col("end_prediction")), 1.0).otherwise(0.0))
    ref_ok = (F.when(F.col("class_label_id") == rf,
                     F.when(hit & (F.col("refer_id") == F.col("refer_prediction")), 1.0).otherwise(0.0))
              if rf is not None else F.lit(None).cast("double"))
    return (preds.groupBy(slot)
            .agg(F.round(F.coalesce(F.avg(pos_ok), F.lit(1.0)), 6).alias("span_acc"),
                 F.round(F.coalesce(F.avg(ref_ok), F.lit(1.0)), 6).alias("refer_acc"),
                 F.round(F.avg(hit.cast("double")), 6).alias("class_acc")))


def score_report(preds: DataFrame, cfg: DatasetConfig, block_size: int = 4096) -> DataFrame:
    """The whole scorer as one long report (metric, scope, value).

    One pass over the prepared table: a grouping-sets aggregate computes the
    per-turn goal (min over slots) and every per-slot metric together; only the
    small per-turn result is aggregated again for joint goal accuracy.
    """
    prepared = prepare(preds, cfg, block_size=block_size)
    cv, rf = cfg.class_index(COPY_VALUE), cfg.class_index(REFER)
    hit = F.col("class_label_id") == F.col("class_prediction")
    pos_ok = F.when(F.col("class_label_id") == cv,
                    F.when(hit & (F.col("start_pos") == F.col("start_prediction"))
                           & (F.col("end_pos") == F.col("end_prediction")), 1.0).otherwise(0.0))
    ref_ok = (F.when(F.col("class_label_id") == rf, F.when(hit & (F.col("refer_id") == F.col("refer_prediction")), 1.0)
                     .otherwise(0.0)) if rf is not None else F.lit(None).cast("double"))
    x = prepared.select("dialog_id", "turn_block", "turn", "slot", "value_ok", pos_ok.alias("pos_ok"),
                        ref_ok.alias("ref_ok"), hit.cast("double").alias("cls_ok"))
    g = x.groupingSets([["dialog_id", "turn_block", "turn"], ["slot"]], "dialog_id", "turn_block", "turn", "slot").agg(
        F.grouping_id().alias("gid"), F.min("value_ok").alias("turn_ok"), F.avg("value_ok").alias("value_acc"),
        F.avg("pos_ok").alias("span_acc"), F.avg("ref_ok").alias("refer_acc"), F.avg("cls_ok").alias("class_acc"))
    # one more partial aggregate keyed by scope: all per-turn rows fold into '__all__' (joint goal),
    # each per-slot row is its own scope -- a single chain, no branch recomputes the prepared table
    per_turn_row = F.col("slot").isNull()
    h = g.select(F.when(per_turn_row, F.lit("__all__")).otherwise(F.col("slot")).alias("scope"),
                 F.when(per_turn_row, F.col("turn_ok")).alias("turn_ok"),
                 *[F.when(~per_turn_row, F.col(m)).alias(m) for m in ("value_acc", "span_acc", "refer_acc", "class_acc")])
    r = h.groupBy("scope").agg(F.avg("turn_ok").alias("joint_goal_acc"),
                               *[F.max(m).alias(m) for m in ("value_acc", "span_acc", "refer_acc", "class_acc")])
    metrics = ("joint_goal_acc", "value_acc", "span_acc", "refer_acc", "class_acc")

    def val(m):
        v = F.coalesce(F.col(m), F.lit(1.0)) if m in ("span_acc", "refer_acc") else F.col(m)
        return F.round(v, 6).cast("double")

    rows = r.select("scope", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"),
                 F.when((F.col("scope") == "__all__") == (m == "joint_goal_acc"), val(m)).alias("value"),
                 ((F.col("scope") == "__all__") == F.lit(m == "joint_goal_acc")).alias("keep"))
        for m in metrics])).alias("m"))
    return rows.where("m.keep").select("m.metric", "scope", "m.value")
