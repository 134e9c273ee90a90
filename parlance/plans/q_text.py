"""Text/value operator queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import label_map_column, tokenized_label_maps
from ..functions import normalize as N
from ..functions import values as V
from ..functions.arrays import elementwise_or, ids_to_tokens
from ..functions.text import span_labels, token_positions, tokenize_str, undo_wordpiece, word_tokens
from . import fixtures as fx
from . import oracle as osql
from .registry import register

P = osql.phrases_cte()
K = "conv_id, turn"


@register("normalise_time", P + f"""
SELECT {K}, {N.sql_normalise_time('phrase')} AS normalised FROM phrases""")
def q_normalise_time(spark, sf):
    return fx.time_phrases(spark, sf).select("conv_id", "turn", N.normalise_time("phrase").alias("normalised"))


@register("normalise_text", P + f"""
SELECT {K}, {N.sql_normalise_text('phrase')} AS normalised FROM phrases""")
def q_normalise_text(spark, sf):
    return fx.time_phrases(spark, sf).select("conv_id", "turn", N.normalise_text("phrase").alias("normalised"))


def _sql_label(slot: str = "slot", value: str = "value"):
    t = N.sql_normalise_time(value)
    v2 = (f"(CASE WHEN contains({slot}, 'type') OR contains({slot}, 'name') OR contains({slot}, 'destination') "
          f"OR contains({slot}, 'departure') THEN replace({value}, 'guesthouse', 'guest house') ELSE {value} END)")
    return (f"(CASE WHEN {value} IN ('', 'not mentioned') THEN 'none' "
            f"WHEN contains({slot}, 'leaveAt') OR contains({slot}, 'arriveBy') OR {slot} = 'restaurant-book_time' "
            f"THEN {t} "
            f"WHEN {slot} IN ('hotel-parking', 'hotel-internet') AND {v2} IN ('yes', 'free') THEN 'true' "
            f"WHEN {slot} IN ('hotel-parking', 'hotel-internet') AND {v2} = 'no' THEN 'false' "
            f"WHEN {slot} = 'hotel-type' AND {v2} = 'hotel' THEN 'true' "
            f"WHEN {slot} = 'hotel-type' AND {v2} = 'guest house' THEN 'false' ELSE {v2} END)")


@register("normalise_label", P + f"""
SELECT {K}, slot, value, {_sql_label()} AS label FROM phrases""")
def q_normalise_label(spark, sf):
    p = fx.time_phrases(spark, sf)
    return p.select("conv_id", "turn", "slot", "value", N.normalise_label("slot", "value").alias("label"))


_ALIAS_IN = ("centre", " areas", "phone number ", "price range")


@register("fix_label_alias", P + f""",
a AS (SELECT {K}, CASE WHEN substr(h, 20, 1) < '8' THEN {osql.sql_list(_ALIAS_IN)}[('0x' || substr(h, 21, 2))::BIGINT % 4 + 1]
                       ELSE coalesce(toks[1], '') END AS raw FROM ph0)
SELECT {K}, raw, coalesce({osql.sql_map({k: [v] for k, v in N.LABEL_FIX.items()})}[trim(raw)][1], trim(raw)) AS fixed
FROM a""")
def q_fix_label_alias(spark, sf):
    c = fx.read_table(spark, sf, "conversations")
    h = fx.md5_of("tp", F.col("conv_id"), F.col("turn"))
    toks = word_tokens(F.lower("text"))
    raw = F.when(F.substring(h, 20, 1) < "8", F.element_at(F.array(*[F.lit(x) for x in _ALIAS_IN]),
                                                           (fx.hexint(h, 21, 2) % 4 + 1).cast("int"))) \
        .otherwise(F.coalesce(F.try_element_at(toks, F.lit(1)), F.lit("")))
    return c.select("conv_id", "turn", raw.alias("raw")).select("conv_id", "turn", "raw",
                                                               N.fix_label_alias("raw").alias("fixed"))


# ---------------------------------------------------- values in utterances

def _dst_with_tokens(spark, sf):
    p = fx.dst_predictions_long(spark, sf)
    u = fx.user_turns(spark, sf).select("dialog_id", "turn", "toks")
    return p.join(u, ["dialog_id", "turn"]).select(
        "dialog_id", "turn", "slot", "toks", "slot_groundtruth", "slot_prediction",
        tokenize_str("slot_groundtruth").alias("gt_value"),
        F.regexp_replace(tokenize_str("slot_prediction"), "^§§ ?", "").alias("iv"))


DT = osql.DST_LONG + f""",
dt AS (SELECT dst.dialog_id, dst.turn, dst.slot, ut.toks, slot_groundtruth, slot_prediction,
              {osql.sql_tokstr('slot_groundtruth')} AS gt_value,
              regexp_replace({osql.sql_tokstr('slot_prediction')}, '^§§ ?', '') AS iv
       FROM dst JOIN ut USING (dialog_id, turn))"""

_VT = osql.sql_toks("gt_value")
_STARTS = (f"list_filter(range(0, greatest(len(toks) - len({_VT}) + 1, 0)), "
           f"lambda i: toks[i + 1 : i + len({_VT})] = {_VT})")


@register("token_positions", DT + f"""
SELECT dialog_id, turn, slot,
       array_to_string(list_transform({_STARTS}, lambda s: CAST(s AS VARCHAR) || '-' || CAST(s + len({_VT}) AS VARCHAR)), ' ')
         AS positions
FROM dt""")
def q_token_positions(spark, sf):
    d = _dst_with_tokens(spark, sf)
    pos = token_positions("toks", word_tokens("gt_value"))
    return d.select("dialog_id", "turn", "slot", F.array_join(F.transform(
        pos, lambda p: F.concat_ws("-", p["start"].cast("string"), p["end"].cast("string"))), " ").alias("positions"))


def _sql_first_variant_hits():
    vt = osql.sql_toks("v")
    starts_v = (f"list_filter(range(0, greatest(len(toks) - len({vt}) + 1, 0)), "
                f"lambda j: toks[j + 1 : j + len({vt})] = {vt})")
    return (f"list_filter(list_transform(coalesce(({osql.DST_MAPS})[gt_value], []), lambda v: "
            f"list_transform({starts_v}, lambda s: CAST(s AS VARCHAR) || '-' || CAST(s + len({vt}) AS VARCHAR))), "
            f"lambda l: len(l) > 0)")


_OWN = f"list_transform({_STARTS}, lambda s: CAST(s AS VARCHAR) || '-' || CAST(s + len({_VT}) AS VARCHAR))"


@register("label_existence", DT + f""",
le AS (SELECT dialog_id, turn, slot,
         CASE WHEN len({_OWN}) > 0 THEN {_OWN} ELSE coalesce(({_sql_first_variant_hits()})[1], []) END AS pos FROM dt)
SELECT dialog_id, turn, slot, len(pos) > 0 AS found, array_to_string(pos, ' ') AS positions FROM le""")
def q_label_existence(spark, sf):
    d = _dst_with_tokens(spark, sf)
    maps = label_map_column(tokenized_label_maps(fx.DST_LABEL_MAPS))
    r = V.label_existence("toks", "gt_value", maps)
    return d.select("dialog_id", "turn", "slot", r["found"].alias("found"), F.array_join(F.transform(
        r["positions"], lambda p: F.concat_ws("-", p["start"].cast("string"), p["end"].cast("string"))), " ")
        .alias("positions"))


@register("last_occurrence", DT + f"""
SELECT dialog_id, turn, slot, CAST(coalesce(list_max({_STARTS}), -1) AS INTEGER) AS start_pos,
       CAST(CASE WHEN len({_STARTS}) > 0 THEN list_max({_STARTS}) + len({_VT}) ELSE -1 END AS INTEGER) AS end_pos FROM dt""")
def q_last_occurrence(spark, sf):
    d = _dst_with_tokens(spark, sf)
    vt = word_tokens("gt_value")
    starts = F.transform(token_positions("toks", vt), lambda p: p["start"])
    last = F.array_max(starts)
    return d.select("dialog_id", "turn", "slot", F.coalesce(last, F.lit(-1)).alias("start_pos"),
                    F.when(F.size(starts) > 0, last + F.size(vt)).otherwise(-1).alias("end_pos"))


@register("token_labels", DT + f""",
lo AS (SELECT dialog_id, turn, slot, len(toks) AS n, coalesce(list_max({_STARTS}), -1) AS s,
              CASE WHEN len({_STARTS}) > 0 THEN list_max({_STARTS}) + len({_VT}) ELSE -1 END AS e FROM dt)
SELECT dialog_id, turn, slot, array_to_string(list_transform(range(0, n),
         lambda i: CASE WHEN i >= s AND i < e THEN 1 ELSE 0 END), '') AS labels FROM lo""")
def q_token_labels(spark, sf):
    d = _dst_with_tokens(spark, sf)
    vt = word_tokens("gt_value")
    starts = F.transform(token_positions("toks", vt), lambda p: p["start"])
    s = F.coalesce(F.array_max(starts), F.lit(-1))
    e = F.when(F.size(starts) > 0, F.array_max(starts) + F.size(vt)).otherwise(-1)
    x = d.select("dialog_id", "turn", "slot", F.size("toks").alias("n"), s.alias("s"), e.alias("e"))
    return x.select("dialog_id", "turn", "slot",
                    F.array_join(span_labels("n", "s", "e").cast("array<string>"), "").alias("labels"))


def _sql_inform_match(vl: str, il: str, maps: str | None = None) -> str:
    def loose(a, b):
        return f"({a} = {b} OR {osql.sql_iil(b, a)} OR {osql.sql_iil(a, b)})"
    m = maps or osql.DST_MAPS
    return (f"({loose(vl, il)} OR (CASE WHEN ({m})[{il}] IS NOT NULL THEN "
            f"coalesce(list_bool_or(list_transform(({m})[{il}], lambda x_: {loose('x_', vl)})), false) "
            f"ELSE coalesce(list_bool_or(list_transform(({m})[{vl}], lambda x_: {loose('x_', il)})), false) END))")


@register("fuzzy_inform_label", DT + f""",
fi AS (SELECT dialog_id, turn, slot, array_to_string({osql.sql_toks(N.sql_normalise_text('lower(slot_groundtruth)'))}, ' ') AS vl,
              [iv, 'north', gt_value] AS informed FROM dt),
fh AS (SELECT *, list_filter(informed, lambda il: {_sql_inform_match('vl', 'il')}) AS hits FROM fi)
SELECT dialog_id, turn, slot, len(hits) > 0 AS found, coalesce(hits[1], 'none') AS informed_value FROM fh""")
def q_fuzzy_inform_label(spark, sf):
    d = _dst_with_tokens(spark, sf)
    maps = label_map_column(tokenized_label_maps(fx.DST_LABEL_MAPS))
    vl = F.array_join(word_tokens(N.normalise_text(F.lower("slot_groundtruth"))), " ")
    r = V.first_informed(vl, F.array(F.col("iv"), F.lit("north"), F.col("gt_value")), maps)
    return d.select("dialog_id", "turn", "slot", r["found"].alias("found"), r["value"].alias("informed_value"))


def _sql_delex(arr: str, value: str) -> str:
    vt = osql.sql_toks(value)
    step = (f"CASE WHEN acc[i + 1 : i + len({vt})] = {vt} THEN list_concat(acc[1 : i], "
            f"list_transform(range(0, len({vt})), lambda z: '[UNK]'), acc[i + len({vt}) + 1 :]) ELSE acc END")
    return (f"(CASE WHEN {value} = 'none' OR len({vt}) = 0 OR len({arr}) < len({vt}) THEN {arr} ELSE "
            f"list_reduce(range(0, len({arr}) - len({vt}) + 1), lambda acc, i: {step}, {arr}) END)")


@register("delex_values", DT + f""",
dx1 AS (SELECT dialog_id, turn, slot, iv, {_sql_delex('toks', 'gt_value')} AS a1 FROM dt)
SELECT dialog_id, turn, slot, array_to_string({_sql_delex('a1', 'iv')}, ' ') AS delexicalised FROM dx1""")
def q_delex_values(spark, sf):
    d = _dst_with_tokens(spark, sf)
    out = V.delex("toks", F.array(F.col("gt_value"), F.col("iv")))
    return d.select("dialog_id", "turn", "slot", F.array_join(out, " ").alias("delexicalised"))


@register("dialogue_state_dict", DT + """,
e AS (SELECT dialog_id, turn, slot, gt_value AS value, 0 AS k FROM dt
      UNION ALL SELECT dialog_id, turn, slot, iv, 1 FROM dt WHERE substr(md5(slot || CAST(turn AS VARCHAR)), 1, 1) < '8'),
l AS (SELECT dialog_id, turn, slot, arg_max(coalesce(value, '-'), k) AS value FROM e GROUP BY dialog_id, turn, slot)
SELECT dialog_id, turn, string_agg(slot || '=' || value, ';' ORDER BY slot) AS state FROM l GROUP BY dialog_id, turn""")
def q_dialogue_state_dict(spark, sf):
    """F16 over entries that name some slots twice: the last value of a slot is the one that stays."""
    d = _dst_with_tokens(spark, sf)
    again = F.substring(F.md5(F.concat("slot", F.col("turn").cast("string"))), 1, 1) < "8"
    one = lambda v: F.struct("slot", F.coalesce(F.col(v), F.lit("-")).alias("value"))
    per_turn = d.groupBy("dialog_id", "turn").agg(F.concat(
        F.sort_array(F.collect_list(one("gt_value"))),
        F.sort_array(F.collect_list(F.when(again, one("iv"))))).alias("entries"))
    m = per_turn.select("dialog_id", "turn", V.state_dict("entries").alias("state"))
    entries = F.array_sort(F.transform(F.map_entries("state"), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))))
    return m.select("dialog_id", "turn", F.array_join(F.transform(
        entries, lambda e: F.concat_ws("=", e["k"], e["v"])), ";").alias("state"))


@register("undo_wordpiece", DT + f""",
wp AS (SELECT dialog_id, turn, slot, flatten(list_transform(toks, lambda t: CASE WHEN length(t) > 4
          THEN [substr(t, 1, 4), '##' || substr(t, 5)] ELSE [t] END)) AS pieces,
          ('0x' || substr(md5(slot || ':' || CAST(dialog_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)), 1, 4))::BIGINT AS r FROM dt),
se AS (SELECT *, r % greatest(len(pieces), 1) AS s, r % greatest(len(pieces), 1) + r % 3 AS e FROM wp)
SELECT dialog_id, turn, slot, regexp_replace(replace(array_to_string(pieces[s + 1 : e + 1], ' '), ' ##', ''), '^##', '')
  AS value FROM se""")
def q_undo_wordpiece(spark, sf):
    d = _dst_with_tokens(spark, sf)
    pieces = F.flatten(F.transform("toks", lambda t: F.when(F.length(t) > 4, F.array(
        F.substring(t, 1, 4), F.concat(F.lit("##"), F.substring(t, 5, 1 << 30)))).otherwise(F.array(t))))
    r = fx.hexint(F.md5(F.concat_ws(":", "slot", F.col("dialog_id").cast("string"), F.col("turn").cast("string"))), 1, 4)
    x = d.select("dialog_id", "turn", "slot", pieces.alias("pieces"), r.alias("r"))
    x = x.select("*", (F.col("r") % F.greatest(F.size("pieces"), F.lit(1))).alias("s"))
    x = x.withColumn("e", F.col("s") + F.col("r") % 3)
    return x.select("dialog_id", "turn", "slot", undo_wordpiece("pieces", "s", "e").alias("value"))


_LETTERS = tuple(chr(ord("a") + i) for i in range(26))


@register("ids_to_tokens", osql.USER_TURNS + f"""
SELECT dialog_id, turn, array_to_string(list_transform(toks, lambda t:
  {osql.sql_list(_LETTERS)}[('0x' || substr(md5(t), 1, 4))::BIGINT % 26 + 1]), '') AS decoded FROM ut""")
def q_ids_to_tokens(spark, sf):
    u = fx.user_turns(spark, sf)
    ids = F.transform("toks", lambda t: fx.hexint(F.md5(t), 1, 4) % 26)
    vocab = F.array(*[F.lit(x) for x in _LETTERS])
    return u.select("dialog_id", "turn", F.array_join(ids_to_tokens(ids, vocab), "").alias("decoded"))


@register("index_of_label", DT + f""",
x AS (SELECT dialog_id, turn, slot, {osql.sql_list(('none',) + fx.DST_SLOTS)} AS refer_list FROM dt)
SELECT dialog_id, turn, slot, CAST(list_position(refer_list, slot) - 1 AS INTEGER) AS refer_idx,
       CAST(list_position({osql.sql_list(fx.DST_CLASS_TYPES)}, 'copy_value') - 1 AS INTEGER) AS copy_idx FROM x""")
def q_index_of_label(spark, sf):
    d = _dst_with_tokens(spark, sf)
    refer_list = F.array(*[F.lit(x) for x in ("none",) + fx.DST_SLOTS])
    classes = F.array(*[F.lit(x) for x in fx.DST_CLASS_TYPES])
    return d.select("dialog_id", "turn", "slot", (F.array_position(refer_list, F.col("slot")) - 1).cast("int")
                    .alias("refer_idx"), (F.array_position(classes, F.lit("copy_value")) - 1).cast("int")
                    .alias("copy_idx"))


@register("joint_label_or", DT + f""",
lo AS (SELECT dialog_id, turn, slot, len(toks) AS n, coalesce(list_max({_STARTS}), -1) AS s,
              CASE WHEN len({_STARTS}) > 0 THEN list_max({_STARTS}) + len({_VT}) ELSE -1 END AS e FROM dt),
pos AS (SELECT dialog_id, turn, n, unnest(range(0, n)) AS i, s, e FROM lo),
m AS (SELECT dialog_id, turn, i, max(CASE WHEN i >= s AND i < e THEN 1 ELSE 0 END) AS v FROM pos GROUP BY ALL)
SELECT dialog_id, turn, string_agg(CAST(v AS VARCHAR), '' ORDER BY i) AS joint FROM m GROUP BY dialog_id, turn""")
def q_joint_label_or(spark, sf):
    d = _dst_with_tokens(spark, sf)
    vt = word_tokens("gt_value")
    starts = F.transform(token_positions("toks", vt), lambda p: p["start"])
    s = F.coalesce(F.array_max(starts), F.lit(-1))
    e = F.when(F.size(starts) > 0, F.array_max(starts) + F.size(vt)).otherwise(-1)
    lab = d.select("dialog_id", "turn", "slot", span_labels(F.size("toks"), s, e).alias("lab"))
    # slots per turn are bounded by the slot list: collecting them per turn is a small array
    per = lab.groupBy("dialog_id", "turn").agg(F.collect_list("lab").alias("labs"))
    joint = per.select("dialog_id", "turn", elementwise_or("labs").alias("j"))
    return joint.where(F.size("j") > 0).select("dialog_id", "turn",
                                               F.array_join(F.col("j").cast("array<string>"), "").alias("joint"))
