"""DuckDB oracle for the multi-domain slot loop.

The Spark side is carried values and an array a turn (``operators.dialogue``);
here the labelling is a per-dialogue ``list_reduce`` over turns with an inner
``list_reduce`` over the slots, carrying seen classes, seen values (slot
order) and the dialogue state.
"""

from __future__ import annotations

from ..functions import normalize as N
from ..operators import dialogue as D
from . import fixtures as fx
from . import oracle as osql
from .q_dialogue import ACTS, MW
from .q_dialogue_sets import _sql_exist
from .q_text import _sql_inform_match, _sql_label

S = fx.MW_SLOT_NAMES
N_S = len(S)
SL = osql.sql_list(S)
MAPS = osql.sql_map(fx.MW_LABEL_MAPS)
NP = "('none', 'dontcare', 'true', 'false')"
NO_REF = osql.sql_list(D.NO_REFERRAL_SLOTS)


def _people(x: str) -> str:
    return f"regexp_matches({x}, '^{D.PEOPLE_SLOT_PATTERN}')"


def _referral(i: str, value: str, sv: str) -> str:
    """First eligible slot holding the value, else the last one holding a variant (slot-list order)."""
    slot = f"{SL}[{i} + 1]"
    elig = (f"lambda j: j <> {i} AND NOT list_contains({NO_REF}, {SL}[j + 1]) AND NOT "
            f"(({_people(f'{SL}[j + 1]')} AND {slot} = '{D.STAY_SLOT}') OR "
            f"({_people(slot)} AND {SL}[j + 1] = '{D.STAY_SLOT}'))")
    cands = f"list_filter(range(0, {N_S}), {elig})"
    exact = f"list_filter({cands}, lambda j: {sv}[j + 1] = {value})"
    loose = f"list_filter({cands}, lambda j: list_contains(coalesce(({MAPS})[{value}], []), {sv}[j + 1]))"
    return (f"(CASE WHEN list_contains({NO_REF}, {slot}) OR {sv}[{i} + 1] = {value} THEN 'none' "
            f"WHEN len({exact}) > 0 THEN {SL}[({exact})[1] + 1] "
            f"WHEN len({loose}) > 0 THEN {SL}[({loose})[-1] + 1] ELSE 'none' END)")


def _slot_step(repetitions: bool = False) -> str:
    """Inner fold step over the slots of turn ``t``: accumulator ``a`` = {sc, sv, dg (new state), outs},
    element ``ri`` = {r: slot features, i: slot index}; ``acc.dg`` is the state before the turn.
    With ``repetitions`` a seen slot gets no copy_value for a value that several slots hold."""
    v, i = "ri.r.v", "ri.i"
    shared = (f"ri.r.in_usr AND a.sc[{i} + 1] <> '' AND len(list_filter(a.sv, lambda x: x = {v})) > 1"
              if repetitions else "false")
    refer = _referral(i, v, "a.sv")
    raw = (f"(CASE WHEN {v} IN {NP} THEN {v} WHEN {shared} THEN 'none' WHEN ri.r.in_usr THEN 'copy_value' WHEN ri.r.inf THEN 'inform' "
           f"WHEN {refer} <> 'none' THEN 'refer' ELSE 'unpointable' END)")
    ref = f"(CASE WHEN {v} IN {NP} OR ri.r.in_usr OR ri.r.inf THEN 'none' ELSE {refer} END)"
    repeat = f"(a.sc[{i} + 1] <> '' AND {raw} = a.sc[{i} + 1] AND {raw} NOT IN ('copy_value', 'inform'))"
    final = f"(CASE WHEN {raw} = 'unpointable' OR {repeat} THEN 'none' ELSE {raw} END)"
    fref = f"(CASE WHEN {raw} = 'unpointable' OR {repeat} THEN 'none' ELSE {ref} END)"
    upd = f"({raw} <> 'none')"
    sv2 = f"list_transform(a.sv, lambda x, j: CASE WHEN j = {i} + 1 AND {upd} THEN {v} ELSE x END)"
    out = (f"{{'turn': t.turn, 'slot': {SL}[{i} + 1], 'class_raw': {raw}, 'class_label': {final}, "
           f"'refer_label': {fref}, "
           f"'informed_value': CASE WHEN {v} NOT IN {NP} AND NOT ri.r.in_usr THEN ri.r.iv ELSE 'none' END, "
           f"'diag_state': acc.dg[{i} + 1], 'seen_value': ({sv2})[{i} + 1], "
           f"'label_start': CASE WHEN {raw} = 'copy_value' THEN ri.r.s ELSE -1 END, "
           f"'label_end': CASE WHEN {raw} = 'copy_value' THEN ri.r.e ELSE -1 END}}")
    return (f"{{'sc': list_transform(a.sc, lambda x, j: CASE WHEN j = {i} + 1 AND {upd} THEN {raw} ELSE x END), "
            f"'sv': {sv2}, "
            f"'dg': list_transform(a.dg, lambda x, j: CASE WHEN j = {i} + 1 AND {upd} THEN "
            f"(CASE WHEN {raw} = 'unpointable' THEN 'copy_value' ELSE {raw} END) ELSE x END), "
            f"'outs': list_append(a.outs, {out})}}")


def _sql(repetitions: bool = False) -> str:
    vl = osql.sql_toks(N.sql_normalise_text("lower(value_label)"))
    empty_out = ("[]::STRUCT(turn BIGINT, slot VARCHAR, class_raw VARCHAR, class_label VARCHAR, refer_label VARCHAR, "
                 "informed_value VARCHAR, diag_state VARCHAR, seen_value VARCHAR, label_start BIGINT, label_end BIGINT)[]")
    none_l = osql.sql_list(["none"] * N_S)
    empty_l = osql.sql_list([""] * N_S)
    step, again = _slot_step(repetitions), ""
    if repetitions:
        # an unchanged slot that was seen takes the entry of the value it holds; bound once in a one-element list
        step = (f"list_transform([{{'r': CASE WHEN rj.r.ch OR a.sc[rj.i + 1] = '' THEN rj.r.f ELSE "
                f"list_filter(rj.r.old, lambda o: o.v = a.sv[rj.i + 1])[1] END, 'i': rj.i}}], lambda ri: {step})[1]")
        again = f""",
og AS (SELECT tg.dialog_id, tg.turn, tg.si, p.value, tg.usr_toks, tg.il, array_to_string({osql.sql_toks(N.sql_normalise_text("lower(p.value)"))}, ' ') AS vl
       FROM tg JOIN (SELECT dialog_id, slot, value, min(utt_idx) AS utt_idx FROM changes WHERE value <> 'none' GROUP BY ALL) p
         ON p.dialog_id = tg.dialog_id AND p.slot = tg.slot AND p.utt_idx < tg.next_sys_idx),
oh AS (SELECT *, {_sql_exist('usr_toks', 'value', MAPS, 'u')} AS ex, {_sql_inform_match('vl', 'il', MAPS)} AS inf FROM og),
oi AS (SELECT dialog_id, turn, si, list({{'v': value, 'in_usr': ex.found, 's': CAST(ex.s AS BIGINT), 'e': CAST(ex.e AS BIGINT),
                                         'inf': inf, 'iv': CASE WHEN inf THEN il ELSE 'none' END}}) AS old FROM oh GROUP BY ALL),
th AS (SELECT tg.*, oi.old FROM tg LEFT JOIN oi USING (dialog_id, turn, si))"""
    turn_step = (f"list_reduce(list_transform(t.slots, lambda r, k: {{'r': r, 'i': k - 1}}), "
                 f"lambda a, {'rj' if repetitions else 'ri'}: {step}, acc)")
    entry = ("{'v': value_label, 'in_usr': ex.found, 's': CAST(ex.s AS BIGINT), 'e': CAST(ex.e AS BIGINT), "
             "'inf': inf, 'iv': CASE WHEN inf THEN il ELSE 'none' END}")
    if repetitions:
        entry = f"{{'f': {entry}, 'ch': changed, 'old': coalesce(old, [])}}"
    return MW + ACTS + f""",
ts AS (SELECT t.dialog_id, t.turn, t.next_sys_idx, t.usr_toks, si, {SL}[si + 1] AS slot
       FROM turns t CROSS JOIN range(0, {N_S}) r(si)),
tv AS (SELECT ts.*, coalesce(c.value, 'none') AS value_label, c.value IS NOT NULL AS changed FROM ts
       LEFT JOIN changes c ON c.dialog_id = ts.dialog_id AND c.utt_idx = ts.next_sys_idx AND c.slot = ts.slot),
ta AS (SELECT tv.*, coalesce(d.value, b.value) AS raw FROM tv
       LEFT JOIN la d ON d.dialog_id = tv.dialog_id AND d.turn = tv.turn AND d.slot = tv.slot
       LEFT JOIN la b ON b.dialog_id = tv.dialog_id AND b.turn = tv.turn AND b.slot = 'booking-' || split_part(tv.slot, '-', 2)),
tf AS (SELECT *, CASE WHEN raw IS NULL THEN 'none' ELSE {_sql_label('slot', 'raw')} END AS il,
              array_to_string({vl}, ' ') AS vl,
              {_sql_exist('usr_toks', 'value_label', MAPS, 'u')} AS ex FROM ta),
tg AS (SELECT *, {_sql_inform_match('vl', 'il', MAPS)} AS inf FROM tf){again},
pt AS (SELECT dialog_id, turn, list({entry} ORDER BY si) AS slots FROM {'th' if repetitions else 'tg'} GROUP BY dialog_id, turn),
pd AS (SELECT dialog_id, list({{'turn': turn, 'slots': slots}} ORDER BY turn) AS turns FROM pt GROUP BY dialog_id),
fo AS (SELECT dialog_id, list_reduce(turns, lambda acc, t: {turn_step},
                  {{'sc': {empty_l}, 'sv': {none_l}, 'dg': {none_l}, 'outs': {empty_out}}}).outs AS outs FROM pd),
lab AS (SELECT dialog_id, unnest(outs, recursive := true) FROM fo)"""


FOLD_SQL = _sql()
REPETITIONS_SQL = _sql(repetitions=True)


def _register():
    from .registry import attach_oracle
    for name, fold in (("build_turns_multidomain", FOLD_SQL), ("build_turns_multidomain_repetitions", REPETITIONS_SQL)):
        attach_oracle(name, fold + """
SELECT dialog_id, turn, slot, class_raw, class_label, refer_label, informed_value,
       CAST(CASE WHEN informed_value <> 'none' THEN 1 ELSE 0 END AS INTEGER) AS inform_slot, diag_state, seen_value,
       CAST(label_start AS INTEGER) AS label_start, CAST(label_end AS INTEGER) AS label_end FROM lab""")
    attach_oracle("turn_label", FOLD_SQL + """
SELECT dialog_id, turn, slot, class_raw AS class_type, informed_value FROM lab""")
    attach_oracle("slot_referral", FOLD_SQL + """
SELECT dialog_id, turn, slot, refer_label FROM lab WHERE refer_label <> 'none'""")
    attach_oracle("history_labels", FOLD_SQL + """,
hv AS (SELECT lab.dialog_id, lab.turn, lab.slot,
              list_concat(list_transform(range(0, len(t.sys_toks)), lambda z: 0),
                          list_transform(range(0, len(t.usr_toks)), lambda k: CASE WHEN k >= lab.label_start
                                         AND k < lab.label_end THEN 1 ELSE 0 END)) AS vec
       FROM lab JOIN turns t ON t.dialog_id = lab.dialog_id AND t.turn = lab.turn),
hh AS (SELECT dialog_id, turn, slot, coalesce(flatten(list_reverse(array_agg(vec) OVER (PARTITION BY dialog_id, slot
          ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))), []) AS hst FROM hv)
SELECT dialog_id, turn, slot, CAST(len(hst) AS INTEGER) AS n, CAST(coalesce(list_sum(hst), 0) AS INTEGER) AS n_ones FROM hh""")
    attach_oracle("cumulative_seen", FOLD_SQL + """
SELECT dialog_id, turn, slot, seen_value, diag_state FROM lab""")


_register()


def _register_features():
    from .q_features import _attach
    _attach()


_register_features()
