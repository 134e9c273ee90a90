"""Dialogue preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import dialogue as D
from ..session import written
from . import fixtures as fx
from . import oracle as osql
from .q_text import _sql_label
from .registry import register

_SL = osql.sql_list
_DOM = _SL([s[0] for s in fx.MW_SLOTS])
_CAT = _SL([s[1] for s in fx.MW_SLOTS])
_NAM = _SL([s[2] for s in fx.MW_SLOTS])


def _hx(i, n, h="h"):
    return f"('0x' || substr({h}, {i}, {n}))::BIGINT"


def _win(arr, a, ln):
    return f"array_to_string({arr}[({a}) + 1 : ({a}) + ({ln})], ' ')"


MW = f"""WITH mwu AS (
  SELECT conv_id AS dialog_id, turn AS utt_idx, text,
         ((role <> 'user') <> (substr(md5('fl:' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)), 1, 2) < '08'))
           AS is_sys,
         {osql.sql_toks(N.sql_normalise_text('lower(text)'))} AS toks
  FROM conversations),
cut0 AS (SELECT *, CAST(is_sys AS INTEGER) AS s_,
                coalesce(lag(CAST(is_sys AS INTEGER)) OVER (PARTITION BY dialog_id ORDER BY utt_idx), 1) AS prev_
         FROM mwu),
bad AS (SELECT dialog_id, min(utt_idx) AS cut FROM cut0 WHERE s_ = prev_ GROUP BY dialog_id),
kept AS (SELECT mwu.* FROM mwu LEFT JOIN bad USING (dialog_id) WHERE bad.cut IS NULL OR mwu.utt_idx < bad.cut),
turns AS (
  SELECT u.dialog_id, CAST(u.utt_idx / 2 AS BIGINT) AS turn, u.utt_idx, n.utt_idx AS next_sys_idx,
         coalesce(sb.toks, []::VARCHAR[]) AS sys_toks, u.toks AS usr_toks
  FROM kept u JOIN kept n ON n.dialog_id = u.dialog_id AND n.utt_idx = u.utt_idx + 1
  LEFT JOIN kept sb ON sb.dialog_id = u.dialog_id AND sb.utt_idx = u.utt_idx - 1
  WHERE u.utt_idx % 2 = 0),
m0 AS (SELECT *, lag(toks) OVER (PARTITION BY dialog_id ORDER BY utt_idx) AS prev_toks,
              lag(toks, 2) OVER (PARTITION BY dialog_id ORDER BY utt_idx) AS prev2_toks FROM mwu),
m1 AS (
  SELECT dialog_id, utt_idx, toks, coalesce(prev_toks, []::VARCHAR[]) AS pt, coalesce(prev2_toks, []::VARCHAR[]) AS pt2, si,
         {_DOM}[si + 1] AS domain, {_CAT}[si + 1] AS category, {_NAM}[si + 1] AS name,
         md5('mw:' || CAST(dialog_id AS VARCHAR) || ':' || CAST(utt_idx AS VARCHAR) || ':' || CAST(si AS VARCHAR)) AS h
  FROM m0 CROSS JOIN range(0, {len(fx.MW_SLOTS)}) r(si) WHERE is_sys),
m2 AS (
  SELECT *,
    CASE WHEN substr(h, 1, 1) < '6' THEN
      CASE WHEN substr(h, 2, 1) < '6' THEN {_win('pt', _hx(4, 2) + ' % greatest(len(pt), 1)', '1 + ' + _hx(6, 1) + ' % 2')}
           WHEN substr(h, 2, 1) < '9' THEN {_win('pt2', '0', '1')}
           WHEN substr(h, 2, 1) < 'b' THEN 'dontcare'
           WHEN substr(h, 2, 1) < 'c' THEN ''
           WHEN substr(h, 2, 1) < 'e' THEN {_SL(fx.MW_POOL)}[{_hx(7, 2)} % 6 + 1]
           ELSE {_SL(fx.MW_SPECIAL)}[{_hx(7, 2)} % 6 + 1] END END AS upd,
    CASE WHEN category = 'book' AND substr(h, 3, 1) >= 'd'
         THEN {_win('toks', _hx(9, 2) + ' % greatest(len(toks), 1)', '1')} END AS booked_v
  FROM m1),
meta AS (
  SELECT dialog_id, utt_idx, si, domain, category, name, booked_v,
         coalesce(last_value(upd IGNORE NULLS) OVER (PARTITION BY dialog_id, si ORDER BY utt_idx
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS value
  FROM m2),
st0 AS (
  SELECT meta.dialog_id, meta.utt_idx,
         CASE WHEN category = 'book' THEN domain || '-book_' || name ELSE domain || '-' || name END AS slot,
         value, booked_v, domain || '-' || name AS bslot
  FROM meta SEMI JOIN kept USING (dialog_id, utt_idx)),
state AS (
  SELECT dialog_id, utt_idx, slot,
         CASE WHEN booked_v IS NOT NULL THEN {_sql_label('bslot', 'booked_v')} ELSE {_sql_label('slot', 'value')} END
           AS value
  FROM st0),
changes AS (
  SELECT * FROM (SELECT *, lag(value, 1, 'none') OVER (PARTITION BY dialog_id, slot ORDER BY utt_idx) AS prev_value
                 FROM state) WHERE value <> prev_value)"""

_ACT_PICK = lambda opts, i: f"{_SL(opts)}[{_hx(i, 2)} % {len(opts)} + 1]"

ACTS = f""",
a0 AS (SELECT dialog_id, utt_idx, toks, CAST(row_number() OVER (PARTITION BY dialog_id ORDER BY utt_idx) AS BIGINT) AS turn
       FROM mwu WHERE is_sys),
a1 AS (SELECT dialog_id, turn, toks, pos,
              md5('ma:' || CAST(dialog_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) || ':' || CAST(pos AS VARCHAR)) AS h,
              substr(md5('mt:' || CAST(dialog_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)), 1, 1) <> 'f' AS annotated
       FROM a0 CROSS JOIN range(0, 3) r(pos)),
acts AS (
  SELECT dialog_id, turn, pos, {_ACT_PICK([d for d, _ in fx.ACT_PAIRS], 1)} || '-' || {_ACT_PICK(fx.ACT_TYPES, 3)} AS act,
         {_ACT_PICK([sl for _, sl in fx.ACT_PAIRS], 1)} AS slot,
         ' ' || CASE WHEN substr(h, 9, 1) < '4' THEN {_win('toks', '0', '1')}
                     WHEN substr(h, 9, 1) < '8' THEN {_win('toks', _hx(10, 2) + ' % greatest(len(toks), 1)', '1')}
                     WHEN substr(h, 9, 1) < 'a' THEN '?' WHEN substr(h, 9, 1) < 'b' THEN 'None'
                     WHEN substr(h, 9, 1) < 'd' THEN translate({_win('toks', _hx(10, 2) + ' % greatest(len(toks), 1)', '1')},
                                                               'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')
                     ELSE {_SL(fx.MW_POOL)}[{_hx(12, 2)} % 6 + 1] END AS value,
         annotated
  FROM a1),
af AS (
  SELECT dialog_id, turn, pos, lower(split_part(act, '-', 1)) || '-' || lower(slot) AS full_slot, trim(lower(value)) AS value
  FROM acts
  WHERE annotated AND lower(split_part(act, '-', 2)) IN ('inform', 'recommend', 'select', 'book')
        AND lower(slot) <> 'none' AND trim(lower(value)) NOT IN ('?', 'none')),
la AS (
  SELECT dialog_id, turn, coalesce({osql.sql_map({k: [v] for k, v in D.ACT_SLOT_RENAME.items()})}[full_slot][1], full_slot)
           AS slot, arg_min(value, pos) AS value
  FROM af GROUP BY ALL)"""


def _utterances(spark, sf):
    """The logs with their normalised words, worked out once: many branches read them."""
    return written(fx.mw_utterances(spark, sf), "utterances")


def _mw(spark, sf):
    u = _utterances(spark, sf)
    kept = D.cut_at_misorder(u)
    turns = D.pair_turns(kept)
    meta = fx.mw_metadata(u).join(kept.select("dialog_id", "utt_idx"), ["dialog_id", "utt_idx"], "left_semi")
    state = D.booked_overrides(meta)
    changes = D.state_changes(state, fx.MW_SLOT_NAMES)
    acts = D.load_acts(fx.mw_acts(u))
    return u, kept, turns, state, changes, acts


@register("explode_dialogues", MW + """
SELECT dialog_id, CAST(utt_idx AS BIGINT) AS utt_idx, is_sys, CAST(len(toks) AS INTEGER) AS n_tokens FROM mwu""")
def q_explode_dialogues(spark, sf):
    from ..sources import readers as R
    u = fx.mw_utterances(spark, sf)
    # round trip through the keyed-log JSON layout: one object {dialog_id: {log: [...]}} per line
    logs = R.write_keyed_logs(spark, u)
    e = D.explode_dialogues(R.read_keyed_logs(spark, logs))
    from ..functions.text import word_tokens
    return e.select(F.col("dialog_id").cast("bigint").alias("dialog_id"), F.col("utt_idx").cast("bigint").alias("utt_idx"),
                    "is_sys", F.size(word_tokens(F.lower("text"))).cast("int").alias("n_tokens"))


@register("explode_dialogues_one_file", MW + """
SELECT dialog_id, CAST(utt_idx AS BIGINT) AS utt_idx, is_sys, text FROM mwu""")
def q_explode_dialogues_one_file(spark, sf):
    """SC6 as it is published: all dialogues in one JSON object in one file, here written by offsets, read by ranges."""
    from ..sources import readers as R
    from ..sources.json_ranges import write_json_object
    lines = spark.read.text(R.write_keyed_logs(spark, fx.mw_utterances(spark, sf)))
    logs = lines.select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "v"))
    e = D.explode_dialogues(R.read_keyed_logs_by_range(spark, write_json_object(logs, "k", "v"), range_bytes=1 << 20))
    return e.select(F.col("dialog_id").cast("bigint").alias("dialog_id"), F.col("utt_idx").cast("bigint").alias("utt_idx"),
                    "is_sys", "text")


@register("cut_at_misorder", MW + """
SELECT dialog_id, utt_idx FROM kept""")
def q_cut_at_misorder(spark, sf):
    return D.cut_at_misorder(fx.mw_utterances(spark, sf)).select("dialog_id", "utt_idx")


@register("pair_turns", MW + """
SELECT dialog_id, turn, array_to_string(sys_toks, ' ') AS sys_text, array_to_string(usr_toks, ' ') AS usr_text FROM turns""")
def q_pair_turns(spark, sf):
    _, _, turns, _, _, _ = _mw(spark, sf)
    return turns.select("dialog_id", "turn", F.array_join("sys_toks", " ").alias("sys_text"),
                        F.array_join("usr_toks", " ").alias("usr_text"))


@register("booked_overrides", MW + """
SELECT dialog_id, utt_idx, slot, value FROM state""")
def q_booked_overrides(spark, sf):
    return _mw(spark, sf)[3]


@register("state_changes", MW + """
SELECT dialog_id, utt_idx, slot, value FROM changes""")
def q_state_changes(spark, sf):
    return _mw(spark, sf)[4].select("dialog_id", "utt_idx", "slot", "value")


@register("next_turn_state", MW + """
SELECT t.dialog_id, t.turn, c.slot, c.value FROM turns t JOIN changes c
  ON c.dialog_id = t.dialog_id AND c.utt_idx = t.next_sys_idx""")
def q_next_turn_state(spark, sf):
    _, _, turns, _, changes, _ = _mw(spark, sf)
    c = changes.select("dialog_id", F.col("utt_idx").alias("next_sys_idx"), "slot", "value")
    return turns.join(c, ["dialog_id", "next_sys_idx"]).select("dialog_id", "turn", "slot", "value")


@register("filter_act_types", MW + ACTS + """
SELECT dialog_id, turn, CAST(pos AS INTEGER) AS pos, full_slot, value FROM af""")
def q_filter_act_types(spark, sf):
    a = fx.mw_acts(_utterances(spark, sf)).where(F.col("annotated"))
    parts = F.split(F.lower("act"), "-")
    v = F.trim(F.lower("value"))
    f = a.where(F.try_element_at(parts, F.lit(2)).isin(*D.INFORM_ACTS) & (F.lower("slot") != "none") & ~v.isin("?", "none"))
    return f.select("dialog_id", "turn", F.col("pos").cast("int").alias("pos"),
                    F.concat_ws("-", F.try_element_at(parts, F.lit(1)), F.lower("slot")).alias("full_slot"), v.alias("value"))


@register("rename_slots", MW + ACTS + f"""
SELECT DISTINCT full_slot, coalesce({osql.sql_map({k: [v] for k, v in D.ACT_SLOT_RENAME.items()})}[full_slot][1], full_slot)
  AS slot FROM af""")
def q_rename_slots(spark, sf):
    a = q_filter_act_types(spark, sf).select("full_slot").distinct()
    rename = F.create_map(*[x for k, val in D.ACT_SLOT_RENAME.items() for x in (F.lit(k), F.lit(val))])
    return a.select("full_slot", F.coalesce(F.try_element_at(rename, F.col("full_slot")), F.col("full_slot")).alias("slot"))


@register("load_acts", MW + ACTS + """
SELECT dialog_id, turn, slot, value FROM la""")
def q_load_acts(spark, sf):
    return D.load_acts(fx.mw_acts(_utterances(spark, sf)))


@register("act_lookup", MW + ACTS + f""",
ts AS (SELECT dialog_id, turn, slot FROM turns CROSS JOIN (SELECT unnest({_SL(fx.MW_SLOT_NAMES)}) AS slot)),
j AS (SELECT ts.*, d.value AS a, b.value AS b FROM ts
      LEFT JOIN la d ON d.dialog_id = ts.dialog_id AND d.turn = ts.turn AND d.slot = ts.slot
      LEFT JOIN la b ON b.dialog_id = ts.dialog_id AND b.turn = ts.turn AND b.slot = 'booking-' || split_part(ts.slot, '-', 2))
SELECT dialog_id, turn, slot,
       CASE WHEN coalesce(a, b) IS NULL THEN 'none' ELSE {_sql_label('slot', 'coalesce(a, b)')} END AS inform_label FROM j""")
def q_act_lookup(spark, sf):
    _, _, turns, _, _, acts = _mw(spark, sf)
    ts = turns.select("dialog_id", "turn", F.explode(F.array(*[F.lit(s) for s in fx.MW_SLOT_NAMES])).alias("slot"))
    r = D.act_lookup(ts, acts)
    return r.select("dialog_id", "turn", "slot", F.try_element_at(F.col("inform_label"), F.lit(1)).alias("inform_label"))


@register("history_newest_first", MW + """
SELECT dialog_id, turn, array_to_string(coalesce(flatten(list_reverse(array_agg(list_concat(sys_toks, usr_toks))
         OVER (PARTITION BY dialog_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))), []), ' ')
       AS history
FROM turns""")
def q_history_newest_first(spark, sf):
    h = D.history_newest_first(_mw(spark, sf)[2])
    return h.select("dialog_id", "turn", F.array_join("hst_toks", " ").alias("history"))


@register("swap_pair", MW + """
SELECT dialog_id, turn, array_to_string(usr_toks, ' ') AS text_a, array_to_string(sys_toks, ' ') AS text_b FROM turns""")
def q_swap_pair(spark, sf):
    s = D.swap_pair(_mw(spark, sf)[2], swap=True)
    return s.select("dialog_id", "turn", F.array_join("text_a", " ").alias("text_a"),
                    F.array_join("text_b", " ").alias("text_b"))


@register("values_shared_by_slots", MW + """
SELECT dialog_id, utt_idx, value, count(*) AS n_slots FROM state
WHERE value NOT IN ('none', 'dontcare', 'true', 'false') GROUP BY ALL HAVING count(*) > 1""")
def q_values_shared_by_slots(spark, sf):
    v = D.values_shared_by_slots(_mw(spark, sf)[3], keys=("dialog_id", "utt_idx"))
    return v.where(F.col("n_slots") > 1)


@register("too_long_rate", MW + """,
h AS (SELECT *, coalesce(flatten(list_reverse(array_agg(list_concat(sys_toks, usr_toks))
         OVER (PARTITION BY dialog_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))), []) AS hst FROM turns)
SELECT CAST(sum(CASE WHEN len(sys_toks) + len(usr_toks) + len(hst) > 180 - 4 THEN 1 ELSE 0 END) AS BIGINT) AS n_long,
       count(*) AS n FROM h""")
def q_too_long_rate(spark, sf):
    return D.too_long_rate(_mw(spark, sf)[2], 180)


def _labelled(spark, sf):
    _, _, turns, _, changes, acts = _mw(spark, sf)
    feats = D.turn_slot_features(turns, changes, acts, fx.MW_SLOT_NAMES, fx.MW_LABEL_MAPS)
    return D.label_turns(written(feats, "turn-slots"), fx.MW_LABEL_MAPS, slots=fx.MW_SLOT_NAMES)


@register("build_turns_multidomain")
def q_build_turns_multidomain(spark, sf):
    return _labelled(spark, sf)


@register("build_turns_multidomain_repetitions")
def q_build_turns_multidomain_repetitions(spark, sf):
    """D9 with labelled value repetitions: unchanged slots are labelled with the value they hold."""
    _, _, turns, _, changes, acts = _mw(spark, sf)
    feats = D.turn_slot_features(turns, changes, acts, fx.MW_SLOT_NAMES, fx.MW_LABEL_MAPS)
    return D.label_turns(feats, fx.MW_LABEL_MAPS, label_value_repetitions=True, tokens=turns)


@register("turn_label")
def q_turn_label(spark, sf):
    return _labelled(spark, sf).select("dialog_id", "turn", "slot", F.col("class_raw").alias("class_type"),
                                       "informed_value")


@register("slot_referral")
def q_slot_referral(spark, sf):
    return _labelled(spark, sf).where(F.col("refer_label") != "none").select("dialog_id", "turn", "slot",
                                                                              "refer_label")


@register("cumulative_seen")
def q_cumulative_seen(spark, sf):
    return _labelled(spark, sf).select("dialog_id", "turn", "slot", "seen_value", "diag_state")


@register("history_labels")
def q_history_labels(spark, sf):
    """Size and labelled places of each slot's label vector over the previous turns (system zeros, user labels).

    Both are running sums; the vectors themselves, as far as they fit a row, are gathered by ``turns_to_features``.
    """
    from ..operators.windows import running_sum_before
    turns = _mw(spark, sf)[2].select("dialog_id", "turn", F.size("sys_toks").alias("ns"), F.size("usr_toks").alias("nu"))
    x = _labelled(spark, sf).join(turns, ["dialog_id", "turn"])
    ones = F.greatest(F.least("label_end", "nu") - F.greatest(F.col("label_start"), F.lit(0)), F.lit(0))
    x = x.select("dialog_id", "turn", "slot", (F.col("ns") + F.col("nu")).alias("own"), ones.alias("own_ones"))
    for own, out in (("own", "n"), ("own_ones", "n_ones")):
        x = running_sum_before(x, ["dialog_id", "slot"], "turn", own, out)
    return x.select("dialog_id", "turn", "slot", F.col("n").cast("int").alias("n"), F.col("n_ones").cast("int").alias("n_ones"))
