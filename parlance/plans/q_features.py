"""Feature and run-time queries (F17, F18, F22, F23, F27, D12-D14, W2, A12, SK4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import truncate_triple
from ..functions.text import undo_wordpiece
from ..operators import examples as EX
from ..operators import features as FE
from ..operators import pieces as P
from ..operators.ordering import dense_index
from ..session import written
from . import fixtures as fx
from . import oracle as osql
from .q_dialogue import MW, _mw
from .registry import register

SEED = "7"
MAX_LEN = 180
TAG_LABELS = ("O", "B-time", "I-time", "B-leave_time", "I-leave_time", "B-area")  # no I-area: keeps B-area


def _u(key: str, i: str, salt: str) -> str:
    return (f"(('0x' || substr(md5('{SEED}:' || {key} || ':' || CAST({i} AS VARCHAR) || ':{salt}'), 1, 8))::BIGINT"
            f" / 4294967296.0)")


@register("subword_label_expand", osql.TAGS + f"""
SELECT dialog_id, turn, array_to_string(flatten(list_transform(list_zip(gold, list_transform(toks, lambda w: 1 + length(w) // 4)),
  lambda e: list_concat([e[1]], list_transform(range(0, e[2] - 1), lambda z:
    CASE WHEN list_contains({osql.sql_list(TAG_LABELS)}, replace(e[1], 'B-', 'I-'))
         THEN replace(e[1], 'B-', 'I-') ELSE e[1] END)))), ' ') AS piece_labels
FROM tags""")
def q_subword_label_expand(spark, sf):
    t = fx.tag_sequences(spark, sf)
    n = F.transform("toks", lambda w: 1 + F.floor(F.length(w) / 4).cast("int"))
    return t.select("dialog_id", "turn", F.array_join(FE.expand_word_labels("gold", n, TAG_LABELS), " ")
                    .alias("piece_labels"))


@register("pair_pack", MW + f""",
h AS (SELECT *, coalesce(flatten(list_reverse(array_agg(list_concat(sys_toks, usr_toks))
         OVER (PARTITION BY dialog_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))), []) AS hst FROM turns),
l AS (SELECT *, len(sys_toks) AS a, len(usr_toks) AS b, len(hst) AS hh, {MAX_LEN} - 4 AS m FROM h),
y AS (SELECT *, greatest(0, a + b - m) AS xx, least(greatest(0, a + b - m), abs(a - b)) AS gap FROM l),
z AS (SELECT *, CASE WHEN a > b THEN a - gap ELSE a END AS a1, CASE WHEN b >= a THEN b - gap ELSE b END AS b1,
             xx - gap AS rest FROM y),
k AS (SELECT *, CAST(a1 - floor(rest / 2) AS BIGINT) AS ka, CAST(b1 - ceil(rest / 2) AS BIGINT) AS kb,
             CAST(greatest(0, least(hh, m - a - b)) AS BIGINT) AS kh FROM z),
p AS (SELECT dialog_id, turn, list_concat(['[CLS]'], sys_toks[1:ka], ['[SEP]'], usr_toks[1:kb], ['[SEP]'], hst[1:kh], ['[SEP]'])
             AS toks, ka, kb, kh FROM k)
SELECT dialog_id, turn, CAST(len(toks) AS INTEGER) AS n_tokens, array_to_string(toks, ' ') AS packed,
       CAST(kb + kh + 2 AS INTEGER) AS n_segment_b, CAST({MAX_LEN} - len(toks) AS INTEGER) AS n_pad FROM p""")
def q_pair_pack(spark, sf):
    turns = _mw(spark, sf)[2].withColumn("own", F.concat("sys_toks", "usr_toks"))
    t = EX.newest_that_fit(turns, MAX_LEN - FE.TOKEN_CORRECTION)
    none = F.array().cast("array<string>")
    t = t.select("dialog_id", "turn", "sys_toks", "usr_toks", F.coalesce(F.flatten(F.col("recent.own")), none).alias("hst_toks"),
                 F.size("sys_toks").alias("a"), F.size("usr_toks").alias("b"), F.col("past").cast("int").alias("h"))
    ka, kb, kh = truncate_triple("a", "b", "h", F.lit(MAX_LEN - FE.TOKEN_CORRECTION))
    t = t.select("*", ka.alias("ka"), kb.alias("kb"), kh.alias("kh"))
    toks, seg, mask = FE.pair_pack(F.slice("sys_toks", 1, F.col("ka")), F.slice("usr_toks", 1, F.col("kb")),
                                   F.slice("hst_toks", 1, F.col("kh")), MAX_LEN)
    x = t.select("dialog_id", "turn", toks.alias("toks"), seg.alias("seg"), mask.alias("mask"))
    return x.select("dialog_id", "turn", F.size("toks").cast("int").alias("n_tokens"),
                    F.array_join("toks", " ").alias("packed"),
                    F.aggregate("seg", F.lit(0), lambda a, v: a + v).cast("int").alias("n_segment_b"),
                    (F.size("mask") - F.aggregate("mask", F.lit(0), lambda a, v: a + v)).cast("int").alias("n_pad"))


@register("slot_value_dropout", osql.TAGS + f"""
SELECT dialog_id, turn, array_to_string(list_transform(list_zip(toks, gold), lambda e, i:
  CASE WHEN (e[2] LIKE 'B-%' OR e[2] LIKE 'I-%') AND {_u("CAST(dialog_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR)", "i - 1", "drop")} < 0.3
       THEN '[UNK]' ELSE e[1] END), ' ') AS tokens
FROM tags""")
def q_slot_value_dropout(spark, sf):
    t = fx.tag_sequences(spark, sf)
    joint = F.transform("gold", lambda g: F.when(g.startswith("B-") | g.startswith("I-"), 1).otherwise(0))
    key = F.concat_ws("-", F.col("dialog_id").cast("string"), F.col("turn").cast("string"))
    return t.select("dialog_id", "turn", F.array_join(FE.slot_value_dropout("toks", joint, 0.3, SEED, key), " ")
                    .alias("tokens"))


_ID = "(('0x' || substr(md5(w), 1, 4))::BIGINT % 1000 + 5)"


@register("mlm_mask", osql.USER_TURNS + f""",
ids AS (SELECT dialog_id, turn, list_transform(toks, lambda w: CAST({_ID} * (CASE WHEN length(w) > 1 THEN 1 ELSE 0 END) AS INTEGER)) AS ids
        FROM ut),
k AS (SELECT *, CAST(dialog_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS kk FROM ids),
m AS (SELECT dialog_id, turn, list_transform(ids, lambda x, i: {{
        'sel': x <> 0 AND {_u('kk', 'i - 1', 'sel')} < 0.15,
        'rep': {_u('kk', 'i - 1', 'rep')} < 0.8, 'rnd': {_u('kk', 'i - 1', 'rnd')} < 0.5,
        'rid': CAST(floor({_u('kk', 'i - 1', 'id')} * 1005) AS INTEGER), 'x': x}}) AS p FROM k)
SELECT dialog_id, turn,
  array_to_string(list_transform(p, lambda e: CASE WHEN e.sel AND e.rep THEN 4 WHEN e.sel AND e.rnd THEN e.rid ELSE e.x END), ' ') AS masked,
  array_to_string(list_transform(p, lambda e: CASE WHEN e.sel THEN e.x ELSE -1 END), ' ') AS labels
FROM m""")
def q_mlm_mask(spark, sf):
    u = fx.user_turns(spark, sf)
    ids = F.transform("toks", lambda w: ((fx.hexint(F.md5(w), 1, 4) % 1000 + 5) *
                                         F.when(F.length(w) > 1, 1).otherwise(0)).cast("int"))
    key = F.concat_ws("-", F.col("dialog_id").cast("string"), F.col("turn").cast("string"))
    x = u.select("dialog_id", "turn", ids.alias("ids"), key.alias("kk"))
    masked, labels = FE.mlm_mask("ids", 1005, 4, SEED, "kk")
    return x.select("dialog_id", "turn", F.array_join(masked.cast("array<string>"), " ").alias("masked"),
                    F.array_join(labels.cast("array<string>"), " ").alias("labels"))


def _wp_ctes(vocab_src: str, words_src: str) -> str:
    """Vocabulary from ``vocab_src`` (a CTE with ``toks``) and a ``wp(w, pieces)`` table for the distinct words of
    ``words_src`` (a CTE with a ``w`` column): greedy longest-match pieces by a recursive CTE."""
    sp = " UNION ALL ".join(f"SELECT {osql.q(t)} AS token, 0 AS grp, {i} AS k1, '' AS k2"
                            for i, t in enumerate(P.SPECIALS))
    return f""",
wd AS (SELECT unnest(toks) AS w FROM {vocab_src}),
cnt AS (SELECT w, count(*) AS n FROM wd GROUP BY w),
top AS (SELECT w AS token, 1 AS grp, -n AS k1, w AS k2 FROM cnt WHERE n >= {P.MIN_COUNT}),
chs AS (SELECT DISTINCT ch FROM (SELECT unnest(string_split(w, '')) AS ch FROM wd) WHERE ch <> ''),
allv AS ({sp} UNION ALL SELECT * FROM top UNION ALL SELECT ch, 2, 0, ch FROM chs
         UNION ALL SELECT '##' || ch, 3, 0, ch FROM chs),
vocab AS (SELECT token, row_number() OVER (ORDER BY grp, k1, k2) - 1 AS id
          FROM (SELECT DISTINCT ON (token) token, grp, k1, k2 FROM allv ORDER BY token, grp, k1, k2)),
dw AS (SELECT DISTINCT w FROM {words_src}),
hit AS (SELECT w, st, max(e) AS e FROM (
          SELECT w, st, unnest(range(st + 1, length(w) + 1)) AS e FROM (SELECT w, unnest(range(0, length(w))) AS st FROM dw))
        SEMI JOIN vocab ON token = CASE WHEN st = 0 THEN '' ELSE '##' END || substr(w, st + 1, e - st) GROUP BY w, st),
wp AS (
  WITH RECURSIVE r(w, st, pieces, failed) AS (
    SELECT w, CAST(0 AS BIGINT), []::VARCHAR[], false FROM dw
    UNION ALL
    SELECT r.w, coalesce(hit.e, r.st), CASE WHEN hit.e IS NULL THEN pieces
           ELSE list_append(pieces, CASE WHEN r.st = 0 THEN '' ELSE '##' END || substr(r.w, r.st + 1, hit.e - r.st)) END,
           hit.e IS NULL
    FROM r LEFT JOIN hit ON hit.w = r.w AND hit.st = r.st WHERE r.st < length(r.w) AND NOT r.failed)
  SELECT w, CASE WHEN failed THEN ['[UNK]'] ELSE pieces END AS pieces FROM r WHERE failed OR st >= length(w))"""


def _wordpiece_sql() -> str:
    """Oracle: the same vocabulary recipe, then greedy longest-match pieces per distinct word (recursive CTE)."""
    return osql.USER_TURNS + _wp_ctes("ut", "wd") + f""",
tw AS (SELECT dialog_id, turn, unnest(toks) AS w, unnest(range(1, len(toks) + 1)) AS k FROM ut),
enc AS (SELECT tw.dialog_id, tw.turn, flatten(list(wp.pieces ORDER BY k)) AS pieces FROM tw JOIN wp USING (w)
        GROUP BY tw.dialog_id, tw.turn)
SELECT ut.dialog_id, ut.turn, array_to_string(coalesce(enc.pieces, []), ' ') AS pieces,
       CAST(len(coalesce(enc.pieces, [])) AS INTEGER) AS n_pieces
FROM ut LEFT JOIN enc USING (dialog_id, turn)"""


@register("subword_encode", _wordpiece_sql())
def q_subword_encode(spark, sf):
    turns = fx.user_turns(spark, sf)
    enc = P.subword_encode(turns, "toks", written(P.build_vocab(turns), "vocabulary"), ["dialog_id", "turn"])
    return enc.select("dialog_id", "turn", F.array_join("pieces", " ").alias("pieces"),
                      F.size("ids").alias("n_pieces"))


def _dst_ex(spark, sf):
    p = fx.dst_predictions_long(spark, sf).withColumn("ord", fx.row_position("dialog_id"))
    turns = p.select("dialog_id", "turn", "ord").distinct()
    idx = dense_index(turns, [], "ord", "ex_idx", range_block=1 << 36)
    return p.join(idx.select("dialog_id", "turn", "ex_idx"), ["dialog_id", "turn"])


@register("per_turn_eval", osql.DST_LONG + f""",
ex AS (SELECT dialog_id, turn, row_number() OVER (ORDER BY dialog_id, turn) - 1 AS ex_idx FROM (SELECT DISTINCT dialog_id, turn FROM dst)),
x AS (SELECT dst.*, floor(ex_idx / 8) AS batch, ex_idx,
        CASE WHEN class_prediction = class_label_id THEN 1.0 ELSE 0.0 END AS cls_ok,
        CASE WHEN start_prediction = start_pos AND end_prediction = end_pos THEN 1.0 ELSE 0.0 END AS tok_ok,
        CASE WHEN class_label_id = 2 THEN 1.0 ELSE 0.0 END AS ptr,
        CASE WHEN class_label_id = 5 THEN 1.0 ELSE 0.0 END AS ref,
        CASE WHEN refer_prediction = refer_id THEN 1.0 ELSE 0.0 END AS ref_ok
      FROM dst JOIN ex USING (dialog_id, turn)),
y AS (SELECT *, cls_ok * (ptr * tok_ok + (1 - ptr)) * (ref * ref_ok + (1 - ref)) AS total FROM x),
per AS (SELECT batch, slot, avg(cls_ok) AS class_acc,
          coalesce(CASE WHEN sum(ptr) > 0 THEN sum(tok_ok * ptr) / sum(ptr) END, 1.0) AS token_acc,
          coalesce(CASE WHEN sum(ref) > 0 THEN sum(ref_ok) / sum(ref) END, 1.0) AS refer_acc,
          avg(total) AS total_acc FROM y GROUP BY batch, slot),
gt AS (SELECT batch, ex_idx, min(total) AS g FROM y GROUP BY batch, ex_idx),
gb AS (SELECT batch, avg(g) AS g FROM gt GROUP BY batch)
SELECT slot, round(avg(class_acc), 6) AS class_acc, round(avg(token_acc), 6) AS token_acc,
       round(avg(refer_acc), 6) AS refer_acc, round(avg(total_acc), 6) AS total_acc FROM per GROUP BY slot
UNION ALL SELECT '__goal__', NULL, NULL, NULL, round(avg(g), 6) FROM gb""")
def q_per_turn_eval(spark, sf):
    return FE.per_turn_eval(_dst_ex(spark, sf), fx.DST_CONFIG, batch_size=8)


@register("running_class_state", osql.DST_LONG + """,
c AS (SELECT *, coalesce(last_value(CASE WHEN class_prediction <> 0 THEN class_prediction END IGNORE NULLS)
        OVER (PARTITION BY dialog_id, slot ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS incl FROM dst)
SELECT dialog_id, turn, slot, class_prediction,
       coalesce(lag(incl) OVER (PARTITION BY dialog_id, slot ORDER BY turn), 0) AS diag_state_in FROM c""")
def q_running_class_state(spark, sf):
    p = fx.dst_predictions_long(spark, sf).select("dialog_id", "turn", "slot", "class_prediction")
    return FE.running_class_state(p).select("dialog_id", "turn", "slot", "class_prediction",
                                            F.col("diag_state_in").cast("bigint").alias("diag_state_in"))


def _decode_input(spark, sf):
    p = fx.dst_predictions_long(spark, sf)
    u = fx.user_turns(spark, sf).select("dialog_id", "turn", "toks")
    pieces = F.flatten(F.transform("toks", lambda t: F.when(F.length(t) > 4, F.array(
        F.substring(t, 1, 4), F.concat(F.lit("##"), F.substring(t, 5, 1 << 30)))).otherwise(F.array(t))))
    x = p.join(u, ["dialog_id", "turn"]).withColumn("pieces", pieces)
    slot_idx = F.array_position(F.array(*[F.lit(s) for s in fx.DST_SLOTS]), F.col("slot")) - 1
    return x.select("dialog_id", "turn", "slot", slot_idx.alias("slot_idx"), "class_prediction", "refer_prediction",
                    undo_wordpiece("pieces", "start_prediction", "end_prediction").alias("span_text"),
                    F.regexp_replace("slot_prediction", "^§§ ?", "").alias("inform_value"))


def _decode_sql() -> str:
    n = len(fx.DST_SLOTS)
    none_list = osql.sql_list(["none"] * n)
    step = (f"list_reduce(range(0, {n}), lambda a, i: CASE WHEN t.cs[i + 1] = 5 THEN list_transform(a, lambda v, j: "
            f"CASE WHEN j = i + 1 THEN a[((t.rps[i + 1] - 1) % {n} + {n}) % {n} + 1] ELSE v END) ELSE a END, "
            f"list_transform(range(0, {n}), lambda i: CASE t.cs[i + 1] WHEN 1 THEN 'dontcare' WHEN 2 THEN t.spans[i + 1] "
            f"WHEN 3 THEN 'true' WHEN 4 THEN 'false' WHEN 6 THEN '§§' || t.ivs[i + 1] ELSE acc[-1][i + 1] END))")
    return osql.DST_LONG + f""",
di AS (SELECT dst.dialog_id, dst.turn, list_position({osql.sql_list(fx.DST_SLOTS)}, dst.slot) - 1 AS slot_idx,
              class_prediction AS c, refer_prediction AS rp, start_prediction AS sp, end_prediction AS ep,
              flatten(list_transform(ut.toks, lambda w: CASE WHEN length(w) > 4 THEN [substr(w, 1, 4), '##' || substr(w, 5)]
                                                        ELSE [w] END)) AS pieces,
              regexp_replace(slot_prediction, '^§§ ?', '') AS iv
       FROM dst JOIN ut USING (dialog_id, turn)),
dj AS (SELECT *, regexp_replace(replace(array_to_string(pieces[sp + 1 : ep + 1], ' '), ' ##', ''), '^##', '') AS span FROM di),
tt AS (SELECT dialog_id, turn, list(c ORDER BY slot_idx) AS cs, list(rp ORDER BY slot_idx) AS rps,
              list(span ORDER BY slot_idx) AS spans, list(iv ORDER BY slot_idx) AS ivs FROM dj GROUP BY dialog_id, turn),
dd AS (SELECT dialog_id, list({{'turn': turn, 'cs': cs, 'rps': rps, 'spans': spans, 'ivs': ivs}} ORDER BY turn) AS turns
       FROM tt GROUP BY dialog_id),
fo AS (SELECT dialog_id, turns, list_reduce(turns, lambda acc, t: list_append(acc, {step}), [{none_list}]) AS states
       FROM dd),
ex AS (SELECT dialog_id, turns, states, unnest(generate_series(1, len(turns))) AS k FROM fo),
ex2 AS (SELECT dialog_id, turns[k].turn AS turn, turns[k].cs AS cs, states[k + 1] AS st,
               unnest(generate_series(1, {n})) AS i FROM ex)
SELECT dialog_id, turn, {osql.sql_list(fx.DST_SLOTS)}[i] AS slot, st[i] AS slot_prediction, cs[i] = 5 AS referral FROM ex2"""


DECODE_SQL = _decode_sql()


@register("decode_state", DECODE_SQL.rsplit("SELECT dialog_id, turn,", 1)[0]
          + "SELECT dialog_id, turn, " + osql.sql_list(fx.DST_SLOTS) + "[i] AS slot, st[i] AS slot_prediction FROM ex2")
def q_decode_state(spark, sf):
    return FE.decode_state(_decode_input(spark, sf), fx.DST_CONFIG, fx.DST_SLOTS).select(
        "dialog_id", "turn", "slot", "slot_prediction")


@register("resolve_refer", DECODE_SQL.rsplit("SELECT dialog_id, turn,", 1)[0]
          + "SELECT dialog_id, turn, " + osql.sql_list(fx.DST_SLOTS) + "[i] AS slot, st[i] AS slot_prediction FROM ex2 "
          + "WHERE cs[i] = 5")
def q_resolve_refer(spark, sf):
    d = FE.decode_state(_decode_input(spark, sf), fx.DST_CONFIG, fx.DST_SLOTS)
    return d.where("referral").select("dialog_id", "turn", "slot", "slot_prediction")


CLASS_TYPES = fx.DST_CLASS_TYPES
DROPOUT = 0.3
_LISTS = ("input_ids", "input_ids_unmasked", "input_mask", "segment_ids", "start_pos", "end_pos", "values", "inform",
          "inform_slot", "refer_id", "diag_state", "class_label_id")


def _feature_rows(spark, sf, advanced: bool):
    """Labelled turns as whole training rows; ``advanced`` sets all flags: labelled repetitions, delexicalised system
    utterances, swapped utterances, history labels and value dropout."""
    from ..operators.dialogue import label_turns, turn_slot_features
    _, _, turns, _, changes, acts = _mw(spark, sf)
    turns, acts = written(turns, "paired-turns"), written(acts, "acts")
    feats = turn_slot_features(turns, changes, acts, fx.MW_SLOT_NAMES, fx.MW_LABEL_MAPS)
    lab = label_turns(feats, fx.MW_LABEL_MAPS, label_value_repetitions=advanced, tokens=turns)
    vocab = written(P.build_vocab(fx.mw_utterances(spark, sf)), "vocabulary")
    if advanced:
        turns = EX.delexicalise_system(turns, acts, fx.MW_SLOT_NAMES)
    return EX.turn_features(turns, lab, vocab, fx.MW_SLOT_NAMES, CLASS_TYPES, MAX_LEN, use_history_labels=advanced,
                            swap_utterances=advanced, slot_value_dropout=DROPOUT if advanced else 0.0, seed=SEED)


def _joined(rows):
    return rows.select("dialog_id", "turn", *[F.array_join(F.col(c).cast("array<string>"), " ").alias(
        {"values": "slot_values"}.get(c, c)) for c in _LISTS], "too_long")


@register("turns_to_features")
def q_turns_to_features(spark, sf):
    """Whole training rows with the default flags (history without labels)."""
    return _joined(_feature_rows(spark, sf, advanced=False))


@register("turns_to_features_advanced")
def q_turns_to_features_advanced(spark, sf):
    """D12 with all flags of the builders set."""
    return _joined(_feature_rows(spark, sf, advanced=True))


@register("materialise_features")
def q_materialise_features(spark, sf):
    from ..session import shared_dir
    feats = _feature_rows(spark, sf, advanced=False)
    inputs = FE.input_state(fx.read_table(spark, sf, "conversations"))
    return _joined(FE.materialise(feats, shared_dir(spark) + "/feature-cache", inputs=inputs, max_len=MAX_LEN,
                                  min_count=P.MIN_COUNT, slots=fx.MW_SLOT_NAMES, dropout=0.0))


def _features_sql(advanced: bool) -> str:
    from .q_dialogue_fold import FOLD_SQL, REPETITIONS_SQL
    from .q_text import _sql_delex
    m, slots = MAX_LEN - FE.TOKEN_CORRECTION, osql.sql_list(fx.MW_SLOT_NAMES)
    refer_list, classes = osql.sql_list(("none",) + fx.MW_SLOT_NAMES), osql.sql_list(CLASS_TYPES)
    first, second = ("usr", "sys") if advanced else ("sys", "usr")
    sys_toks = (f"coalesce(list_reduce(told.v, lambda tk, vv: {_sql_delex('tk', 'vv')}, turns.sys_toks), turns.sys_toks)"
                if advanced else "turns.sys_toks")
    before = "OVER (PARTITION BY {} ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    usr_labels = "list_transform(range(0, nu), lambda i: CASE WHEN i >= label_start AND i < label_end THEN 1 ELSE 0 END)"
    own = f"list_concat({usr_labels}, zs)" if advanced else f"list_concat(zs, {usr_labels})"
    past = f"coalesce(flatten(list_reverse(array_agg(own) {before.format('dialog_id, slot')})), [])"
    if not advanced:
        past = f"list_transform({past}, lambda x: 0)"
    pack = lambda cls, sep, a, b, c: (f"list_concat(list_concat(list_concat(list_concat(list_concat(list_concat([{cls}], {a}), "  # noqa: E731
                                      f"[{sep}]), {b}), [{sep}]), {c}), [{sep}])")
    cut = lambda x: pack("{c}", "{s}", f"{x}[1 : ka]", f"{x}[pa + 1 : pa + kb]", f"{x}[pa + pb + 1 : pa + pb + kh]")
    joined = lambda x: f"array_to_string({x}, ' ')"
    draw = _u("CAST(dialog_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR)", "i - 1", "drop")
    masked = (f"list_transform(ids, lambda x, i: CASE WHEN jl[i] = 1 AND {draw} < {DROPOUT} THEN 1 ELSE x END)"
              if advanced else "ids")
    listed = {"start_pos": "greatest(st, 0)", "end_pos": "CASE WHEN st < 0 THEN 0 WHEN z = 0 THEN len(l) - 1 ELSE st + z - 2 END",
              "slot_values": "seen_value", "inform": "informed_value",
              "inform_slot": "CASE WHEN informed_value <> 'none' THEN 1 ELSE 0 END",
              "refer_id": f"list_position({refer_list}, refer_label) - 1",
              "diag_state": f"list_position({classes}, diag_state) - 1",
              "class_label_id": f"list_position({classes}, CASE WHEN class_label = 'copy_value' AND st < 0 THEN 'none' "
                                "ELSE class_label END) - 1"}
    return (REPETITIONS_SQL if advanced else FOLD_SQL) + f""",
told AS (SELECT dialog_id, turn, list(value ORDER BY list_position({slots}, slot)) AS v FROM la
         WHERE list_contains({slots}, slot) GROUP BY dialog_id, turn),
tn AS (SELECT turns.dialog_id, turns.turn, {sys_toks} AS sys_toks, usr_toks
       FROM turns LEFT JOIN told ON told.dialog_id = turns.dialog_id AND told.turn = turns.turn),
hs AS (SELECT dialog_id, turn, len({first}_toks) AS na, len({second}_toks) AS nb, len(usr_toks) AS nu, len(sys_toks) AS ns,
              list_concat({first}_toks, {second}_toks) AS o FROM tn),
hw AS (SELECT *, list_concat(o, coalesce(flatten(list_reverse(array_agg(o) {before.format('dialog_id')})), []::VARCHAR[]))
              AS words FROM hs),
words_all AS (SELECT unnest(words) AS w FROM hw)""" + _wp_ctes("mwu", "words_all") + f""",
wi AS (SELECT w, len(pieces) AS np, list(id ORDER BY k) AS ids FROM (
         SELECT w, pieces, unnest(pieces) AS token, unnest(range(1, len(pieces) + 1)) AS k FROM wp) JOIN vocab USING (token)
       GROUP BY w, pieces),
hx AS (SELECT dialog_id, turn, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS k FROM hw),
hp AS (SELECT dialog_id, turn, list(np ORDER BY k) AS np, flatten(list(ids ORDER BY k)) AS all_ids
       FROM hx JOIN wi USING (w) GROUP BY dialog_id, turn),
hq AS (SELECT hw.dialog_id, hw.turn, na, nb, nu, ns, coalesce(np, []) AS np, coalesce(all_ids, []) AS all_ids,
              coalesce(list_sum(np[1 : na]), 0) AS pa, coalesce(list_sum(np[na + 1 : na + nb]), 0) AS pb,
              coalesce(list_sum(np), 0) AS tot FROM hw LEFT JOIN hp ON hp.dialog_id = hw.dialog_id AND hp.turn = hw.turn),
hr AS (SELECT *, tot - pa - pb AS ph, greatest(0, pa + pb - {m}) AS xx, least(greatest(0, pa + pb - {m}), abs(pa - pb)) AS gap
       FROM hq),
hs2 AS (SELECT *, CASE WHEN pa > pb THEN pa - gap ELSE pa END AS a1, CASE WHEN pb >= pa THEN pb - gap ELSE pb END AS b1,
               xx - gap AS rest FROM hr),
hk AS (SELECT *, CAST(a1 - floor(rest / 2) AS BIGINT) AS ka, CAST(b1 - ceil(rest / 2) AS BIGINT) AS kb,
              CAST(greatest(0, least(ph, {m} - pa - pb)) AS BIGINT) AS kh FROM hs2),
lo AS (SELECT lab.*, {own} AS own FROM lab JOIN (SELECT dialog_id, turn, nu, list_transform(range(0, ns), lambda q: 0) AS zs
         FROM hk) h ON h.dialog_id = lab.dialog_id AND h.turn = lab.turn),
lw AS (SELECT *, list_concat(own, {past}) AS wl FROM lo),
lp AS (SELECT lw.* EXCLUDE (own, wl), ka, kb, kh, pa, pb, flatten(list_transform(list_zip(wl, np), lambda e:
              list_transform(range(0, e[2]), lambda q: e[1]))) AS pl
       FROM lw JOIN hk ON hk.dialog_id = lw.dialog_id AND hk.turn = lw.turn),
ll AS (SELECT *, list_resize({cut('pl').format(c=0, s=0)}, {MAX_LEN}, 0) AS l FROM lp),
ls AS (SELECT *, coalesce(list_position(l, 1), 0) - 1 AS st FROM ll),
lz AS (SELECT *, coalesce(list_position(l[greatest(st, 0) + 1 :], 0), 0) AS z,
              list_position({slots}, slot) AS si FROM ls),
lt AS (SELECT dialog_id, turn, list(l) AS every, {", ".join(f"array_to_string(list(CAST({e} AS VARCHAR) ORDER BY si), ' ') AS {c}"
                                                           for c, e in listed.items())} FROM lz GROUP BY dialog_id, turn),
fi AS (SELECT dialog_id, turn, tot, ka, kb, kh, {cut('all_ids').format(c=2, s=3)} AS ids FROM hk),
fj AS (SELECT fi.*, lt.* EXCLUDE (dialog_id, turn, every), list_transform(range(1, {MAX_LEN} + 1), lambda i:
              list_max(list_transform(every, lambda l: l[i]))) AS jl
       FROM fi JOIN lt ON lt.dialog_id = fi.dialog_id AND lt.turn = fi.turn),
ends AS (SELECT *, list_transform(range(0, {MAX_LEN}), lambda i: i) AS places FROM fj)
SELECT dialog_id, turn, {joined(f"list_resize({masked}, {MAX_LEN}, 0)")} AS input_ids,
       {joined(f"list_resize(ids, {MAX_LEN}, 0)")} AS input_ids_unmasked,
       {joined("list_transform(places, lambda i: CASE WHEN i < len(ids) THEN 1 ELSE 0 END)")} AS input_mask,
       {joined("list_transform(places, lambda i: CASE WHEN i >= ka + 2 AND i < len(ids) THEN 1 ELSE 0 END)")} AS segment_ids,
       {", ".join(listed)}, tot > {m} AS too_long
FROM ends"""


def _attach():
    from .registry import attach_oracle
    sql = _features_sql(advanced=False)
    attach_oracle("turns_to_features", sql)
    attach_oracle("materialise_features", sql)
    attach_oracle("turns_to_features_advanced", _features_sql(advanced=True))
