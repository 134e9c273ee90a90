"""Model input features (F17, F18, F20, F22, F23, F26, SK4), run-time metrics (A12, W2) and decoding.

Word pieces (F27) are in ``pieces``, whole training rows (D12) in ``examples``.
All of it is array expressions; random choices are md5 draws keyed by
(seed, example, position) so a retried task makes the same choice.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pieces import CLS, SEP, UNK
from .windows import carry_forward

TOKEN_CORRECTION = 4


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ------------------------------------------------------------- label layout

def expand_word_labels(labels, n_pieces, label_vocab: tuple[str, ...]) -> Column:
    """first piece keeps the word label; other pieces get its ``I-`` form if that label exists."""
    lv = F.array(*[F.lit(x) for x in label_vocab]).cast("array<string>")

    def per_word(lab, k):
        i_form = F.replace(lab, F.lit("B-"), F.lit("I-"))          # every occurrence, like str.replace
        rest = F.when(F.array_contains(lv, i_form), i_form).otherwise(lab)
        return F.concat(F.array(lab), F.array_repeat(rest, F.greatest(k - 1, F.lit(0))))

    return F.flatten(F.zip_with(_c(labels), _c(n_pieces), per_word))


def expand_word_values(values, n_pieces) -> Column:
    """Repeat a per-word value (e.g. a 0/1 label) over the word's pieces."""
    return F.flatten(F.zip_with(_c(values), _c(n_pieces), lambda v, k: F.array_repeat(v, k)))


def pair_pack(a, b, hist, max_len: int) -> tuple[Column, Column, Column]:
    """F18 + P9: ``[CLS] a [SEP] b [SEP] hist [SEP]`` with segment ids 0/1/1, padded to ``max_len``."""
    toks = F.concat(F.array(F.lit(CLS)), _c(a), F.array(F.lit(SEP)), _c(b), F.array(F.lit(SEP)), _c(hist),
                    F.array(F.lit(SEP)))
    seg = F.concat(F.array_repeat(F.lit(0), F.size(_c(a)) + 2), F.array_repeat(F.lit(1), F.size(_c(b)) + F.size(_c(hist)) + 2))
    n = F.size(toks)
    pad = F.greatest(F.lit(max_len) - n, F.lit(0))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), pad))
    return toks, F.concat(seg, F.array_repeat(F.lit(0), pad)), mask


def pack_labels(la, lb, lh, max_len: int) -> Column:
    """Label ids aligned with ``pair_pack``: 0 at the special positions and padding."""
    z = F.array(F.lit(0))
    lab = F.concat(z, _c(la), z, _c(lb), z, _c(lh), z)
    return F.concat(lab, F.array_repeat(F.lit(0), F.greatest(F.lit(max_len) - F.size(lab), F.lit(0))))


def uniform(seed: str, key: Column, i: Column, salt: str) -> Column:
    """Deterministic U[0,1) from md5(seed:key:i:salt)."""
    h = F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"), i.cast("string"), F.lit(salt)))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(1 << 32)


def slot_value_dropout(tokens, joint_label, p: float, seed: str, key) -> Column:
    """sub-tokens of labelled values become ``[UNK]`` with probability ``p``."""
    if p <= 0:
        return _c(tokens)
    k = _c(key)
    return F.zip_with(_c(tokens), F.transform(_c(joint_label), lambda lab, i: F.struct(lab.alias("l"), i.alias("i"))),
                      lambda t, e: F.when((e["l"] == 1) & (uniform(seed, k, e["i"], "drop") < p), F.lit(UNK))
                      .otherwise(t))


def mlm_mask(ids, vocab_size: int, mask_id: int, seed: str, key, prob: float = 0.15) -> tuple[Column, Column]:
    """choose ``prob`` of the non-zero ids; of those 80% ``[MASK]``, 10% random id, 10% kept; labels -1 elsewhere."""
    k = _c(key)

    def pick(x, i):
        sel = (x != 0) & (uniform(seed, k, i, "sel") < prob)
        rep = sel & (uniform(seed, k, i, "rep") < 0.8)
        rnd = sel & ~rep & (uniform(seed, k, i, "rnd") < 0.5)
        rid = (uniform(seed, k, i, "id") * vocab_size).cast("int")
        return F.struct(F.when(rep, F.lit(mask_id)).when(rnd, rid).otherwise(x).alias("x"),
                        F.when(sel, x).otherwise(F.lit(-1)).alias("y"))

    pairs = F.transform(_c(ids), pick)
    return F.transform(pairs, lambda s: s["x"]), F.transform(pairs, lambda s: s["y"])


def first_span_class(class_type: Column, labels: Column) -> tuple[Column, Column, Column]:
    """F20 with the class fix: ``copy_value`` without any 1 in the labels becomes ``none``."""
    start = F.array_position(labels, 1) - 1
    z = F.array_position(F.slice(labels, F.greatest(start, F.lit(0)) + 1, F.size(labels)), 0)
    end = F.when(start < 0, F.lit(0)).when(z == 0, F.size(labels) - 1).otherwise(start + z - 2)
    cls = F.when((class_type == "copy_value") & (start < 0), F.lit("none")).otherwise(class_type)
    return cls, F.greatest(start, F.lit(0)), end


def feature_key(**params) -> str:
    """SK4: cache key over *all* parameters (the reference's key omits the sequence length, Q16)."""
    return hashlib.sha1(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]


def input_state(*tables: DataFrame) -> list[list]:
    """File, size and modification time of everything the tables read: what a cache key knows of the input."""
    return [sorted([r["p"], r["s"], str(r["t"])] for r in t.select(
        F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"),
        F.col("_metadata.file_modification_time").alias("t")).distinct().collect()) for t in tables]


def materialise(df: DataFrame, base: str, inputs: list | None = None, **params) -> DataFrame:
    """SK4: write the features once per input and parameter set under ``base`` and read them back (lineage cut).

    ``inputs`` (see ``input_state``) and the output schema join the key, so
    changed files or a changed layout never read an old cache.  Only a folder
    that was written to its end (``_SUCCESS``) counts; any other error of the
    read is an error.
    """
    path = f"{base.rstrip('/')}/features-{feature_key(schema=df.schema.simpleString(), inputs=inputs, **params)}"
    spark = df.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# --------------------------------------------------------- run-time metrics

def running_class_state(preds: DataFrame, keys=("dialog_id", "slot"), order="turn") -> DataFrame:
    """Class-state input of each turn = last non-zero predicted class of earlier turns (0 at turn 0)."""
    u = preds.withColumn("__u", F.when(F.col("class_prediction") != 0, F.col("class_prediction")))
    c = carry_forward(u, list(keys), order, "__u", None, default=0, exclusive_out="diag_state_in")
    return c.drop("__u")


def per_turn_eval(preds: DataFrame, cfg, batch_size: int, order: str = "ex_idx") -> DataFrame:
    """class/token/refer/total accuracy per slot and goal accuracy, averaged per batch then over batches.

    Refer accuracy divides all refer hits by the referrable count (numerator not
    masked, Q4); 0/0 and x/0 count as 1.0 like the reference.
    """
    cv, rf = cfg.class_index("copy_value"), cfg.class_index("refer")
    x = preds.withColumn("batch", F.floor(F.col(order) / batch_size))
    cls_ok = (F.col("class_prediction") == F.col("class_label_id")).cast("double")
    tok_ok = ((F.col("start_prediction") == F.col("start_pos")) & (F.col("end_prediction") == F.col("end_pos"))).cast("double")
    ptr = (F.col("class_label_id") == cv).cast("double")
    ref = (F.col("class_label_id") == (rf if rf is not None else -1)).cast("double")
    ref_ok = (F.col("refer_prediction") == F.col("refer_id")).cast("double")
    total = cls_ok * (ptr * tok_ok + (1 - ptr)) * (ref * ref_ok + (1 - ref))
    x = x.withColumn("cls_ok", cls_ok).withColumn("tok_hit", tok_ok * ptr).withColumn("ptr", ptr) \
        .withColumn("ref_ok", ref_ok).withColumn("ref", ref).withColumn("total", total)
    per = x.groupBy("batch", "slot").agg(
        F.avg("cls_ok").alias("class_acc"),
        F.coalesce(F.try_divide(F.sum("tok_hit"), F.sum("ptr")), F.lit(1.0)).alias("token_acc"),
        F.coalesce(F.try_divide(F.sum("ref_ok"), F.sum("ref")), F.lit(1.0)).alias("refer_acc"),
        F.avg("total").alias("total_acc"))
    slot_m = per.groupBy("slot").agg(*[F.round(F.avg(c), 6).alias(c)
                                       for c in ("class_acc", "token_acc", "refer_acc", "total_acc")])
    goal_turn = x.groupBy("batch", order).agg(F.min("total").alias("g"))
    goal = goal_turn.groupBy("batch").agg(F.avg("g").alias("g")).agg(F.round(F.avg("g"), 6).alias("goal_acc"))
    g = goal.select(F.lit("__goal__").alias("slot"), F.lit(None).cast("double").alias("class_acc"),
                    F.lit(None).cast("double").alias("token_acc"), F.lit(None).cast("double").alias("refer_acc"),
                    F.col("goal_acc").alias("total_acc"))
    return slot_m.unionByName(g)


# One turn maps every slot to an entry (p, v): p = -1 is the constant v, p >= 0 what slot p held before the turn.
# Such maps compose, so the state after any stretch of turns is again one map.

def _composed(later: Column, earlier: Column) -> Column:
    """The map of two stretches: what the later one takes from before is looked up in the earlier one."""
    return F.transform(later, lambda e: F.when(e["p"] >= 0, F.get(earlier, e["p"])).otherwise(e))


def _turn_map(rows: Column, n: int) -> Column:
    """The map of one turn from its rows (slot_idx, found, value, referral, target) in slot order.

    Values come first, then the referrals one by one: each takes what its target holds by then.
    """
    value_at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(
        F.get(F.transform(F.filter(rows, lambda r: (r["slot_idx"] == i) & r["found"]),
                          lambda r: F.struct(F.lit(-1).alias("p"), r["value"].alias("v"))), F.lit(0)),
        F.struct(i.alias("p"), F.lit(None).cast("string").alias("v"))))
    return F.aggregate(F.filter(rows, lambda r: r["referral"]), value_at, lambda held, r: F.transform(
        held, lambda e, i: F.when(i == r["slot_idx"], F.get(held, r["target"])).otherwise(e)))


def _running(stretches: Column, start: Column, kind: str) -> Column:
    """(stretch, map up to and with it) of each one of an array of structs with a ``map``, from ``start`` on."""
    begin = F.struct(start.alias("map"), F.array().cast(kind).alias("out"))

    def step(acc, s):
        now = _composed(s["map"], acc["map"])
        return F.struct(now.alias("map"), F.concat(acc["out"], F.array(F.struct(
            s.alias("s"), now.alias("after"), acc["map"].alias("before")))).alias("out"))

    return F.aggregate(stretches, begin, step, lambda acc: acc["out"])


def decode_state(preds: DataFrame, cfg, slots: tuple[str, ...], block_size: int = 128) -> DataFrame:
    """D13 + D14: class -> value per slot (copy_value from pieces, inform ``§§`` + informed value), carried
    over turns, then referrals in slot order (id 0 wraps to the last slot, Q6); a dialogue begins with 'none'.

    A segmented scan: turns are composed within blocks of ``block_size`` turns, the blocks' maps within a dialogue
    (one row a block), and each block's result takes what it left open from the state it began with.  All of it
    is array expressions; no task holds more than a block of a dialogue, or its block summaries.
    Needs: dialog_id, turn, slot, class_prediction, refer_prediction, span_text, inform_value.
    A slot outside ``slots`` is an error; slots without a row in a turn keep their value.
    """
    n = len(slots)
    index = {name: i for i, name in enumerate(cfg.class_types)}
    is_class = lambda name: (F.col("class_prediction") == F.lit(index[name])) if name in index else F.lit(False)
    constants = [(is_class(c), F.lit(c)) for c in ("dontcare", "true", "false")]
    cases = [constants[0], (is_class("copy_value"), F.col("span_text")), *constants[1:],
             (is_class("inform"), F.concat(F.lit("§§"), "inform_value"))]
    value, found = F.lit(None).cast("string"), F.lit(False)
    for test, v in reversed(cases):
        value, found = F.when(test, v).otherwise(value), found | F.coalesce(test, F.lit(False))
    place = F.array_position(F.array(*map(F.lit, slots)), F.col("slot")).cast("int")
    slot_idx = F.when(place > 0, place - 1).otherwise(
        F.raise_error(F.concat(F.lit("not in the slot list: "), "slot")).cast("int"))
    referral = F.coalesce(is_class("refer"), F.lit(False))
    row = F.struct(slot_idx.alias("slot_idx"), "slot", found.alias("found"), value.alias("value"), referral.alias("referral"),
                   F.pmod(F.col("refer_prediction").cast("int") - 1, F.lit(n)).alias("target"))
    block = F.floor(F.col("turn") / block_size).cast("bigint").alias("block")
    # one shuffle by (dialogue, block) serves the turns, the blocks and the join below
    turns = (preds.select("dialog_id", block, "turn", row.alias("r")).repartition("dialog_id", "block")
             .groupBy("dialog_id", "block", "turn").agg(F.sort_array(F.collect_list("r")).alias("rows")))
    turns = turns.withColumn("map", _turn_map(F.col("rows"), n))
    entry = "struct<p:int,v:string>"
    own = F.array(*[F.struct(F.lit(i).alias("p"), F.lit(None).cast("string").alias("v")) for i in range(n)])
    none = F.array(*[F.struct(F.lit(-1).alias("p"), F.lit("none").alias("v")) for _ in range(n)])
    stretch = turns.schema["rows"].dataType.simpleString()
    kind = lambda s: f"array<struct<s:{s},after:array<{entry}>,before:array<{entry}>>>"
    blocks = (turns.groupBy("dialog_id", "block").agg(F.sort_array(F.collect_list(F.struct("turn", "map", "rows"))).alias("t"))
              .select("dialog_id", "block", _running(F.col("t"), own, kind(
                  f"struct<turn:{turns.schema['turn'].dataType.simpleString()},map:array<{entry}>,rows:{stretch}>")).alias("t")))
    ends = blocks.select("dialog_id", F.struct("block", F.element_at("t", -1)["after"].alias("map")).alias("b"))
    starts = (ends.groupBy("dialog_id").agg(F.sort_array(F.collect_list("b")).alias("b"))
              .select("dialog_id", F.explode(_running(F.col("b"), none, kind(f"struct<block:bigint,map:array<{entry}>>"))).alias("x"))
              .select("dialog_id", F.col("x.s.block").alias("block"), F.col("x.before").alias("held")))
    x = blocks.join(starts, ["dialog_id", "block"]).select("dialog_id", "held", F.explode("t").alias("t"))
    left_open = lambda r: F.get(F.col("t.after"), r["slot_idx"])
    out = F.transform("t.s.rows", lambda r: F.struct(
        r["slot"].alias("slot"), F.when(left_open(r)["p"] >= 0, F.get(F.col("held"), left_open(r)["p"])["v"])
        .otherwise(left_open(r)["v"]).alias("slot_prediction"), r["referral"].alias("referral")))
    return x.select("dialog_id", F.col("t.s.turn").alias("turn"), F.inline(out))
