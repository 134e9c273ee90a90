"""Transcript (D7, D10, F6) and pre-tokenised span (D8, D11, F16) dialogue-set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normalize import LABEL_FIX, fix_label_alias
from ..operators import dialogue_sets as DS
from ..operators.windows import carry_forward
from . import fixtures as fx
from . import oracle as osql
from .q_dialogue import MW, _mw
from .registry import register

# Transcript slots as written in the raw turn labels, and a small label map.
WOZ_RAW_SLOTS = ("area", "food", "price range")
WOZ_LABEL_MAPS = {"center": ["centre", "downtown"], "north": ["northern"]}
SIM_SLOTS = ("restaurant_name", "date", "time", "num_people", "price_range")


def _win(toks, a, n):
    return F.array_join(F.slice(toks, a + 1, n), " ")


def _woz_rows(spark, sf):
    turns = _mw(spark, sf)[2]
    x = turns.select("dialog_id", "turn", "sys_toks", "usr_toks",
                     F.posexplode(F.array(*[F.lit(s) for s in WOZ_RAW_SLOTS])).alias("si", "raw_slot"))
    h = fx.md5_of("wz", F.col("dialog_id"), F.col("turn"), F.col("si"))
    x = x.withColumn("h", h)
    hx = lambda i, n: fx.hexint(F.col("h"), i, n)
    d2 = F.substring("h", 2, 1)
    raw = (F.when(d2 < "6", _win(F.col("usr_toks"), hx(3, 2) % F.greatest(F.size("usr_toks"), F.lit(1)), 1 + hx(5, 1) % 2))
           .when(d2 < "9", _win(F.col("sys_toks"), hx(3, 2) % F.greatest(F.size("sys_toks"), F.lit(1)), F.lit(1)))
           .when(d2 < "b", F.lit("dontcare")).when(d2 < "d", F.lit(" centre ")).otherwise(F.lit("north")))
    x = x.withColumn("label", F.when(F.substring("h", 1, 1) >= "5", fix_label_alias(raw)))
    return x.select("dialog_id", "turn", fix_label_alias("raw_slot").alias("slot"), "label", "sys_toks", "usr_toks")


def _sql_woz():
    hx = lambda i, n: f"('0x' || substr(h, {i}, {n}))::BIGINT"
    win = lambda t, a, n: f"array_to_string({t}[({a}) + 1 : ({a}) + ({n})], ' ')"
    fix = lambda e: f"coalesce({osql.sql_map({k: [v] for k, v in LABEL_FIX.items()})}[trim({e})][1], trim({e}))"
    raw = (f"CASE WHEN substr(h, 2, 1) < '6' THEN {win('usr_toks', hx(3, 2) + ' % greatest(len(usr_toks), 1)', '1 + ' + hx(5, 1) + ' % 2')}"
           f" WHEN substr(h, 2, 1) < '9' THEN {win('sys_toks', hx(3, 2) + ' % greatest(len(sys_toks), 1)', '1')}"
           f" WHEN substr(h, 2, 1) < 'b' THEN 'dontcare' WHEN substr(h, 2, 1) < 'd' THEN ' centre ' ELSE 'north' END")
    return f""",
wz0 AS (SELECT dialog_id, turn, sys_toks, usr_toks, si, {osql.sql_list(WOZ_RAW_SLOTS)}[si + 1] AS raw_slot,
               md5('wz:' || CAST(dialog_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) || ':' || CAST(si AS VARCHAR)) AS h
        FROM turns CROSS JOIN range(0, {len(WOZ_RAW_SLOTS)}) r(si)),
wz AS (SELECT dialog_id, turn, {fix('raw_slot')} AS slot,
              CASE WHEN substr(h, 1, 1) >= '5' THEN {fix(raw)} END AS label, sys_toks, usr_toks FROM wz0)"""


def _sql_exist(toks: str, value: str, maps: str, tag: str) -> str:
    vt = osql.sql_toks(value)
    starts = lambda t, v: (f"list_filter(range(0, greatest(len({t}) - len({v}) + 1, 0)), "  # noqa: E731
                           f"lambda i_{tag}: {t}[i_{tag} + 1 : i_{tag} + len({v})] = {v})")
    own = starts(toks, vt)
    var_vt = osql.sql_toks(f"v_{tag}")
    variants = (f"list_filter(list_transform(coalesce(({maps})[{value}], []), lambda v_{tag}: "
                f"{{'st': {starts(toks, var_vt)}, 'ln': len({var_vt})}}), lambda x_{tag}: len(x_{tag}.st) > 0)")
    return (f"(CASE WHEN len({own}) > 0 THEN {{'found': true, 's': ({own})[-1], 'e': ({own})[-1] + len({vt})}} "
            f"WHEN len({variants}) > 0 THEN {{'found': true, 's': ({variants})[1].st[-1], "
            f"'e': ({variants})[1].st[-1] + ({variants})[1].ln}} "
            f"ELSE {{'found': false, 's': -1, 'e': -1}} END)")


_WMAPS = osql.sql_map(WOZ_LABEL_MAPS)

WOZ_SQL = MW + _sql_woz() + f""",
wl AS (SELECT dialog_id, turn, slot, coalesce(label, 'none') AS lab,
              {_sql_exist('usr_toks', "coalesce(label, 'none')", _WMAPS, 'u')} AS u,
              {_sql_exist('sys_toks', "coalesce(label, 'none')", _WMAPS, 's')} AS s FROM wz),
d7 AS (SELECT dialog_id, turn, slot, lab AS label_value,
              CASE WHEN lab IN ('none', 'dontcare') THEN lab WHEN u.found THEN 'copy_value' WHEN s.found THEN 'inform'
                   ELSE 'unpointable' END AS class_raw, u FROM wl),
d7b AS (SELECT *, CASE WHEN class_raw = 'copy_value' THEN u.s ELSE -1 END AS label_start,
               CASE WHEN class_raw = 'copy_value' THEN u.e ELSE -1 END AS label_end FROM d7),
d10 AS (SELECT *, lag(seen_incl) OVER (PARTITION BY dialog_id, slot ORDER BY turn) AS seen_class FROM (
          SELECT *, last_value(CASE WHEN class_raw <> 'none' THEN class_raw END IGNORE NULLS)
                    OVER (PARTITION BY dialog_id, slot ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen_incl
          FROM d7b))"""


@register("turn_label_transcript", WOZ_SQL + """
SELECT dialog_id, turn, slot, label_value, class_raw, label_start, label_end FROM d7b""")
def q_turn_label_transcript(spark, sf):
    r = DS.transcript_turn_label(_woz_rows(spark, sf), WOZ_LABEL_MAPS)
    return r.select("dialog_id", "turn", "slot", "label_value", "class_raw", "label_start", "label_end")


@register("build_turns_transcript", WOZ_SQL + """
SELECT dialog_id, turn, slot, label_value, class_raw,
       CASE WHEN class_raw = 'unpointable' THEN 'none'
            WHEN seen_class IS NOT NULL AND class_raw = seen_class AND class_raw NOT IN ('copy_value', 'inform') THEN 'none'
            ELSE class_raw END AS class_label,
       CASE WHEN class_raw = 'inform' THEN label_value ELSE 'none' END AS inform_label, label_start, label_end
FROM d10""")
def q_build_turns_transcript(spark, sf):
    return DS.transcript_examples(_woz_rows(spark, sf), WOZ_LABEL_MAPS)


def _sim_rows(spark, sf):
    turns = _mw(spark, sf)[2]
    x = turns.select("dialog_id", "turn", "sys_toks", "usr_toks",
                     F.posexplode(F.array(*[F.lit(s) for s in SIM_SLOTS])).alias("si", "slot"))
    x = x.withColumn("h", fx.md5_of("sm", F.col("dialog_id"), F.col("turn"), F.col("si")))
    hx = lambda i, n: fx.hexint(F.col("h"), i, n)
    d2 = F.substring("h", 2, 1)
    a_u = (hx(3, 2) % F.greatest(F.size("usr_toks"), F.lit(1))).cast("int")
    l_u = (1 + hx(5, 1) % 2).cast("int")
    a_s = (hx(3, 2) % F.greatest(F.size("sys_toks"), F.lit(1))).cast("int")
    src = F.when(F.substring("h", 1, 1) >= "6", F.when(d2 < "6", F.lit("usr")).when(d2 < "9", F.lit("sys"))
                 .when(d2 < "b", F.lit("dontcare")).otherwise(F.lit("pool")))
    new = (F.when(src == "usr", _win(F.col("usr_toks"), a_u, l_u)).when(src == "sys", _win(F.col("sys_toks"), a_s, F.lit(1)))
           .when(src == "dontcare", F.lit("dontcare")).when(src == "pool", F.lit("cheap")))
    x = x.withColumn("src", src).withColumn("upd", new) \
        .withColumn("span", F.when(src == "usr", F.struct(F.col("slot"), a_u.alias("start"), (a_u + l_u).alias("exclusive_end")))
                    .when(src == "sys", F.struct(F.col("slot"), a_s.alias("start"), (a_s + 1).alias("exclusive_end"))))
    x = carry_forward(x, ["dialog_id", "slot"], "turn", "upd", "value", exclusive_out="prev_value")
    # the annotated spans of a turn: one array per utterance (bounded by the slot list)
    spans = x.groupBy("dialog_id", "turn").agg(
        F.filter(F.collect_list(F.when(F.col("src") == "usr", F.col("span"))), lambda s: s.isNotNull()).alias("usr_spans"),
        F.filter(F.collect_list(F.when(F.col("src") == "sys", F.col("span"))), lambda s: s.isNotNull()).alias("sys_spans"))
    return x.join(spans, ["dialog_id", "turn"]).select("dialog_id", "turn", "slot", "value", "prev_value",
                                                      "usr_toks", "sys_toks", "usr_spans", "sys_spans")


def _sql_sim():
    hx = lambda i, n: f"('0x' || substr(h, {i}, {n}))::BIGINT"
    win = lambda t, a, n: f"array_to_string({t}[({a}) + 1 : ({a}) + ({n})], ' ')"
    a_u, l_u = f"{hx(3, 2)} % greatest(len(usr_toks), 1)", f"1 + {hx(5, 1)} % 2"
    a_s = f"{hx(3, 2)} % greatest(len(sys_toks), 1)"
    return MW + f""",
sm0 AS (SELECT dialog_id, turn, sys_toks, usr_toks, {osql.sql_list(SIM_SLOTS)}[si + 1] AS slot,
               md5('sm:' || CAST(dialog_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) || ':' || CAST(si AS VARCHAR)) AS h
        FROM turns CROSS JOIN range(0, {len(SIM_SLOTS)}) r(si)),
sm1 AS (SELECT *, CASE WHEN substr(h, 1, 1) >= '6' THEN CASE WHEN substr(h, 2, 1) < '6' THEN 'usr' WHEN substr(h, 2, 1) < '9'
                  THEN 'sys' WHEN substr(h, 2, 1) < 'b' THEN 'dontcare' ELSE 'pool' END END AS src FROM sm0),
sm2 AS (SELECT *, CASE src WHEN 'usr' THEN {win('usr_toks', a_u, l_u)} WHEN 'sys' THEN {win('sys_toks', a_s, '1')}
                  WHEN 'dontcare' THEN 'dontcare' WHEN 'pool' THEN 'cheap' END AS upd,
                  CASE src WHEN 'usr' THEN {{'slot': slot, 'start': CAST({a_u} AS INTEGER), 'e': CAST({a_u} + {l_u} AS INTEGER)}}
                           WHEN 'sys' THEN {{'slot': slot, 'start': CAST({a_s} AS INTEGER), 'e': CAST({a_s} + 1 AS INTEGER)}} END AS span
        FROM sm1),
sm3 AS (SELECT *, last_value(upd IGNORE NULLS) OVER (PARTITION BY dialog_id, slot ORDER BY turn
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM sm2),
sm4 AS (SELECT *, lag(value) OVER (PARTITION BY dialog_id, slot ORDER BY turn) AS prev_value FROM sm3),
sp AS (SELECT dialog_id, turn, list(span) FILTER (WHERE src = 'usr') AS usr_spans, list(span) FILTER (WHERE src = 'sys') AS sys_spans
       FROM sm2 GROUP BY dialog_id, turn),
sm AS (SELECT sm4.*, coalesce(sp.usr_spans, []) AS usr_spans, coalesce(sp.sys_spans, []) AS sys_spans
       FROM sm4 JOIN sp USING (dialog_id, turn)),
fm AS (SELECT *,
  list_filter(usr_spans, lambda x: x.slot = slot AND array_to_string(usr_toks[x.start + 1 : x.e], ' ') = value)[1] AS u,
  list_filter(sys_spans, lambda x: x.slot = slot AND array_to_string(sys_toks[x.start + 1 : x.e], ' ') = value)[1] AS s
  FROM sm),
d8 AS (SELECT dialog_id, turn, slot,
  CASE WHEN value IS NULL THEN 'none'
       WHEN value = 'dontcare' AND (prev_value IS NULL OR prev_value <> 'dontcare') THEN 'dontcare'
       WHEN u IS NOT NULL THEN 'copy_value' WHEN s IS NOT NULL THEN 'inform'
       WHEN prev_value IS NULL OR value <> prev_value THEN 'error' ELSE 'none' END AS class_label, u, value FROM fm),
d8b AS (SELECT dialog_id, turn, slot, class_label,
  CASE WHEN class_label = 'copy_value' THEN u.start ELSE -1 END AS label_start,
  CASE WHEN class_label = 'copy_value' THEN u.e ELSE -1 END AS label_end,
  CASE WHEN class_label = 'inform' THEN value ELSE 'none' END AS inform_label, coalesce(value, 'none') AS value FROM d8)"""


SIM_SQL = _sql_sim()


@register("turn_label_spans", SIM_SQL + """
SELECT * FROM d8b""")
def q_turn_label_spans(spark, sf):
    return DS.span_turn_label(_sim_rows(spark, sf))


@register("build_turns_spans", SIM_SQL + """,
d11 AS (SELECT *, last_value(CASE WHEN class_label NOT IN ('none', 'error') THEN class_label END IGNORE NULLS)
          OVER (PARTITION BY dialog_id, slot ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS incl FROM d8b)
SELECT dialog_id, turn, slot, class_label, label_start, label_end, inform_label, value,
       coalesce(lag(incl) OVER (PARTITION BY dialog_id, slot ORDER BY turn), 'none') AS diag_state FROM d11""")
def q_build_turns_spans(spark, sf):
    return DS.span_examples(_sim_rows(spark, sf))
