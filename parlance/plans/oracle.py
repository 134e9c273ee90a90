"""DuckDB SQL for the oracle check: the same recipes and operators, written as SQL.

Only used to cross-check results; the engine itself never runs DuckDB.
``sql_*`` helpers expand to inline SQL expressions (DuckDB syntax).
"""

from __future__ import annotations

from ..config import tokenized_label_maps
from ..functions.text import TOKEN_PATTERN
from .fixtures import DST_LABEL_MAPS, DST_POOL, DST_SLOTS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def sql_map(m: dict) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: {sql_list(v)}" for k, v in m.items()) + "}"


def sql_toks(x: str) -> str:
    return f"regexp_extract_all({x}, {q(TOKEN_PATTERN)}, 0)"


def sql_detok(x: str) -> str:
    return (f"(CASE WHEN contains({x}, 'Ġ') THEN trim(replace(replace({x}, ' ', ''), 'Ġ', ' ')) "
            f"ELSE {x} END)")


def sql_tokstr(x: str) -> str:
    return f"array_to_string({sql_toks(sql_detok(x))}, ' ')"


def sql_contains_window(a: str, b: str, var: str = "ix_") -> str:
    return (f"(len({b}) = 0 OR (len({a}) >= len({b}) AND len(list_filter(range(0, len({a}) - len({b}) + 1), "
            f"lambda {var}: {a}[{var} + 1 : {var} + len({b})] = {b})) > 0))")


def sql_iil(tok: str, value: str) -> str:
    return sql_contains_window(sql_toks(tok), sql_toks(value))


def hx(i: int, n: int) -> str:
    return f"('0x' || substr(h, {i}, {n}))::BIGINT"


def dg(i: int) -> str:
    return f"substr(h, {i}, 1)"


def win(a: str, length: str) -> str:
    return f"array_to_string(toks[({a}) + 1 : ({a}) + ({length})], ' ')"


DST_MAPS = sql_map(tokenized_label_maps(DST_LABEL_MAPS))

USER_TURNS = f"""WITH ut AS (
  SELECT conv_id AS dialog_id,
         CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS turn,
         text, {sql_toks('lower(text)')} AS toks
  FROM conversations WHERE role = 'user')"""

_POOL = sql_list(DST_POOL)

DST_LONG = USER_TURNS + f""",
dh AS (
  SELECT dialog_id, turn, toks, greatest(len(toks), 1) AS nn, si, {sql_list(DST_SLOTS)}[si + 1] AS slot,
         md5('dst:' || CAST(dialog_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) || ':' || CAST(si AS VARCHAR)) AS h
  FROM ut CROSS JOIN range(0, {len(DST_SLOTS)}) r(si)),
d1 AS (
  SELECT *, {hx(11, 4)} % nn AS a, 1 + {hx(15, 1)} % 2 AS ln,
         CASE WHEN {dg(1)} < '9' THEN CAST(0 AS BIGINT) ELSE {hx(2, 4)} % 7 END AS gt_class
  FROM dh),
d2 AS (
  SELECT *, CASE WHEN {dg(6)} < 'b' THEN gt_class ELSE {hx(7, 4)} % 7 END AS pd_class,
         CASE WHEN gt_class = 0 THEN (CASE WHEN {dg(16)} < '8' THEN 'none' ELSE {win('a', 'ln')} END)
              WHEN gt_class = 1 THEN 'dontcare' WHEN gt_class = 3 THEN 'true' WHEN gt_class = 4 THEN 'false'
              WHEN gt_class = 2 THEN {win('a', 'ln')}
              ELSE (CASE WHEN {dg(17)} < '8' THEN {win('a', 'ln')} ELSE {_POOL}[{hx(18, 2)} % 7 + 1] END) END AS gt_value
  FROM d1),
d3 AS (
  SELECT *, CASE WHEN {dg(20)} < '6' THEN gt_value WHEN {dg(20)} < 'a' THEN {win('a', 'ln + 1')}
                 WHEN {dg(20)} < 'd' THEN {win(hx(21, 4) + ' % nn', '1')}
                 ELSE {_POOL}[{hx(25, 2)} % 7 + 1] END AS base,
         CASE WHEN {dg(29)} < 'c' THEN a ELSE {hx(30, 2)} % nn END AS start_pd,
         {hx(30, 2)} % 6 AS refer_id_
  FROM d2),
dst AS (
  SELECT 'test' AS set_type, dialog_id, turn, slot,
         gt_class AS class_label_id, pd_class AS class_prediction,
         a AS start_pos, start_pd AS start_prediction, a + ln - 1 AS end_pos, start_pd + ln - 1 AS end_prediction,
         refer_id_ AS refer_id,
         CASE WHEN {dg(32)} < 'b' THEN refer_id_ ELSE (refer_id_ + 1) % 6 END AS refer_prediction,
         gt_value AS slot_groundtruth,
         CASE WHEN pd_class = 5 THEN (CASE WHEN {dg(27)} < '5' THEN '§§ ' || base WHEN {dg(27)} < 'a' THEN '§§' || base
                                           WHEN {dg(27)} < 'c' THEN 'none' ELSE base END)
              WHEN pd_class = 6 THEN (CASE WHEN {dg(27)} < '8' THEN '§§ ' || base ELSE '§§' || base END)
              WHEN pd_class = 2 THEN (CASE WHEN {dg(28)} = 'f' THEN 'Ġ' || replace(base, ' ', 'Ġ') ELSE base END)
              ELSE base END AS slot_prediction
  FROM d3)"""


def sql_inform(g: str, v: str, maps: str = DST_MAPS) -> str:
    vv = f"({maps})[{v}]"
    gv = f"({maps})[{g}]"
    var_v = (f"coalesce(list_bool_or(list_transform({vv}, lambda vv_: vv_ = {g} OR "
             f"{sql_iil('vv_', g)} OR {sql_iil(g, 'vv_')})), false)")
    var_g = (f"coalesce(list_bool_or(list_transform({gv}, lambda vv_: vv_ = {v} OR "
             f"{sql_iil(v, 'vv_')} OR {sql_iil('vv_', v)})), false)")
    hit = (f"({g} = {v} OR {sql_iil(v, g)} OR {sql_iil(g, v)} OR "
           f"(CASE WHEN {vv} IS NOT NULL THEN {var_v} ELSE {var_g} END))")
    return f"(CASE WHEN {hit} THEN {g} ELSE {v} END)"


def sql_marked(pd: str, g: str, unmarked: str) -> str:
    return (f"(CASE WHEN substr({pd}, 1, 3) = '§§ ' THEN (CASE WHEN substr({pd}, 4) <> 'none' "
            f"THEN {sql_inform(g, f'substr({pd}, 4)')} END) "
            f"WHEN substr({pd}, 1, 2) = '§§' THEN (CASE WHEN substr({pd}, 3) <> 'none' "
            f"THEN {sql_inform(g, f'substr({pd}, 3)')} END) ELSE {unmarked} END)")


DST_PREPARED = DST_LONG + f""",
tk AS (SELECT *, {sql_tokstr('slot_groundtruth')} AS gt_value, {sql_tokstr('slot_prediction')} AS pd_value FROM dst),
up AS (
  SELECT *,
    CASE class_prediction WHEN 0 THEN NULL WHEN 1 THEN 'dontcare' WHEN 2 THEN pd_value
         WHEN 3 THEN 'true' WHEN 4 THEN 'false'
         WHEN 5 THEN {sql_marked('pd_value', 'gt_value', "(CASE WHEN pd_value <> 'none' THEN pd_value END)")}
         WHEN 6 THEN {sql_marked('pd_value', 'gt_value', 'NULL')} END AS "update",
    CASE WHEN class_prediction = 6 AND substr(pd_value, 1, 2) <> '§§' THEN 'unexpected slot value format'
         WHEN class_prediction NOT BETWEEN 0 AND 6 THEN 'unexpected class type' END AS update_error
  FROM tk),
cf AS (
  SELECT *, coalesce(last_value("update" IGNORE NULLS) OVER (PARTITION BY dialog_id, slot ORDER BY turn
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'none') AS joint_pd
  FROM up),
prepared AS (
  SELECT *, CASE WHEN gt_value = joint_pd THEN 1
                 WHEN gt_value NOT IN ('none', 'dontcare', 'true', 'false')
                      AND coalesce(list_contains(({DST_MAPS})[gt_value], joint_pd), false) THEN 1 ELSE 0 END AS value_ok
  FROM cf)"""


def sql_tag_of(h: str) -> str:
    from .fixtures import TAG_SLOTS
    name = f"{sql_list(TAG_SLOTS)}[('0x' || substr({h}, 2, 2))::BIGINT % 3 + 1]"
    d = f"substr({h}, 1, 1)"
    return (f"(CASE WHEN {d} < '7' THEN 'O' WHEN {d} < 'a' THEN 'B-' || {name} WHEN {d} < 'd' THEN 'I-' || {name} "
            f"WHEN {d} = 'd' THEN '[PAD]' WHEN {d} = 'e' THEN 'X-' || {name} ELSE 'I-' || {name} END)")


def _md5_parts(prefix: str, *cols: str) -> str:
    return "md5(" + " || ':' || ".join([q(prefix)] + [f"CAST({c} AS VARCHAR)" for c in cols]) + ")"


TAGS = USER_TURNS + f""",
tg0 AS (
  SELECT dialog_id, turn, toks,
         list_transform(range(0, len(toks)), lambda i: {_md5_parts('bg', 'dialog_id', 'turn', 'i')}) AS gh,
         list_transform(range(0, len(toks)), lambda i: {_md5_parts('bp', 'dialog_id', 'turn', 'i')}) AS ph,
         {_md5_parts('bx', 'dialog_id', 'turn')} AS rh
  FROM ut),
tg1 AS (SELECT *, list_transform(gh, lambda h: {sql_tag_of('h')}) AS gold FROM tg0),
tags AS (
  SELECT dialog_id, turn, toks, gold, rh,
         list_transform(ph, lambda h, i: CASE WHEN substr(h, 1, 1) < 'b' THEN gold[i] ELSE {sql_tag_of('h')} END) AS pred
  FROM tg1)"""


def _type(s: str) -> str:
    return f"(CASE WHEN position('-' IN {s}) > 0 THEN split_part({s}, '-', 1) END)"


def _key(s: str) -> str:
    return f"substr({s}, position('-' IN {s}) + 1)"


def sql_bio_spans(t: str) -> str:
    """Independent formulation: each B starts a span that ends at the first closer after it."""
    closes = (f"({t}[j + 1] IN ('O', '[PAD]') OR {_type(f'{t}[j + 1]')} = 'B' "
              f"OR ({_type(f'{t}[j + 1]')} = 'I' AND {_key(f'{t}[j + 1]')} <> {_key(f'{t}[b + 1]')}))")
    return (f"list_transform(list_filter(range(0, len({t})), lambda b: {_type(f'{t}[b + 1]')} = 'B'), "
            f"lambda b: {_key(f'{t}[b + 1]')} || ':' || CAST(b AS VARCHAR) || '-' || "
            f"CAST(coalesce(list_min(list_filter(range(b + 1, len({t})), lambda j: {closes})), len({t})) AS VARCHAR))")


SPAN_PAIRS = TAGS + f""",
gs AS (SELECT dialog_id, turn, {sql_bio_spans('gold')} AS spans FROM tags),
ps AS (SELECT dialog_id, turn, {sql_bio_spans('pred')} AS spans FROM tags WHERE substr(rh, 1, 1) < 'e'),
pairs AS (
  SELECT dialog_id, turn, ps.spans AS pred_spans, gs.spans AS true_spans,
         ps.spans IS NOT NULL AS has_pred, gs.spans IS NOT NULL AS has_true
  FROM ps FULL OUTER JOIN gs USING (dialog_id, turn)),
types AS (SELECT DISTINCT split_part(s, ':', 1) AS slot_type FROM gs, unnest(gs.spans) t(s)),
tx AS (
  SELECT dialog_id, turn, slot_type, has_pred, has_true,
         list_filter(coalesce(pred_spans, []), lambda p: contains(p, slot_type)) AS p,
         list_filter(coalesce(true_spans, []), lambda l: contains(l, slot_type)) AS l
  FROM pairs CROSS JOIN types),
per_type AS (
  SELECT slot_type,
         sum(CASE WHEN has_pred AND len(p) > 0 AND has_true AND p = l THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN has_pred AND len(p) > 0 THEN 1 ELSE 0 END) AS n_pred,
         sum(CASE WHEN has_true AND len(l) > 0 THEN 1 ELSE 0 END) AS n_true
  FROM tx GROUP BY slot_type),
f AS (SELECT *, tp / (1e-5 + n_pred) AS precision, tp / (1e-5 + n_true) AS recall FROM per_type),
f1 AS (SELECT *, 2 * precision * recall / (1e-5 + precision + recall) AS f1 FROM f)"""


INTENTS = f"""WITH intents AS (
  SELECT doc_id AS pos, text, source AS category, lang,
         CASE WHEN substr(md5('split:' || CAST(doc_id AS VARCHAR)), 1, 1) < 'c' THEN 'train' ELSE 'test' END AS split,
         CASE WHEN substr(md5('ip:' || CAST(doc_id AS VARCHAR)), 1, 1) < 'b' THEN source
              ELSE 'src' || CAST(('0x' || substr(md5('ip:' || CAST(doc_id AS VARCHAR)), 2, 4))::BIGINT % 20 AS VARCHAR)
         END AS pred,
         {{ds}}[('0x' || substr(md5('ds:' || CAST(doc_id AS VARCHAR)), 1, 4))::BIGINT % 7 + 1] AS dataset
  FROM documents)"""


def intents_cte() -> str:
    from .fixtures import BENCH_DATASETS
    return INTENTS.replace("{ds}", sql_list(BENCH_DATASETS))


RUNS = """,
runs AS (
  SELECT pos, category, dataset, run,
         CASE WHEN substr(md5('ir:' || CAST(run AS VARCHAR) || ':' || CAST(pos AS VARCHAR)), 1, 1) < 'a' THEN category
              ELSE 'src' || CAST(('0x' || substr(md5('ir:' || CAST(run AS VARCHAR) || ':' || CAST(pos AS VARCHAR)), 2, 4))::BIGINT % 20 AS VARCHAR)
         END AS pred
  FROM intents CROSS JOIN range(0, 5) r(run))"""


def _pick_sql(options, start: int, h: str = "h") -> str:
    return f"{sql_list(options)}[('0x' || substr({h}, {start}, 2))::BIGINT % {len(options)} + 1]"


def phrases_cte() -> str:
    from .fixtures import (LABEL_SLOTS, LABEL_VALUES, PHRASE_MIN, PHRASE_PREP, PHRASE_SEP, PHRASE_SUFFIX,
                           PHRASE_TAIL)
    hour = "CAST(('0x' || substr(h, 1, 2))::BIGINT % 25 AS VARCHAR)"
    return f"""WITH ph0 AS (
  SELECT conv_id, turn, text, {sql_toks('lower(text)')} AS toks,
         md5('tp:' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)) AS h FROM conversations),
phrases AS (
  SELECT conv_id, turn,
    lower(text) || ' ' || {_pick_sql(PHRASE_PREP, 3)} || ' ' || {hour} || {_pick_sql(PHRASE_SEP, 5)}
      || {_pick_sql(PHRASE_MIN, 7)} || {_pick_sql(PHRASE_SUFFIX, 9)} || ' ' || {_pick_sql(PHRASE_TAIL, 11)} AS phrase,
    {_pick_sql(LABEL_SLOTS, 16)} AS slot,
    CASE WHEN substr(h, 13, 1) < '8' THEN {_pick_sql(LABEL_VALUES, 14)}
         ELSE {hour} || {_pick_sql(PHRASE_SEP, 5)} || {_pick_sql(PHRASE_MIN, 7)} || {_pick_sql(PHRASE_SUFFIX, 9)} END AS value
  FROM ph0)"""
