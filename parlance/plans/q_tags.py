"""Tag/span decoding and array-shaping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import spans as S
from . import fixtures as fx
from . import oracle as osql
from .registry import register

K2 = "dialog_id, turn"


def _joined(col):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), " ")


def _span_pairs(spark, sf):
    t = fx.tag_sequences(spark, sf)
    gold = t.select("dialog_id", "turn", S.bio_spans("gold").alias("spans"))
    # the prediction file lacks some rows: scoring must count them as in the full lists
    pred = t.where(F.substring("rh", 1, 1) < "e").select("dialog_id", "turn", S.bio_spans("pred").alias("spans"))
    return S.align_spans(pred, gold, keys=("dialog_id", "turn"))


@register("bio_spans", osql.TAGS + f"""
SELECT {K2}, CAST(len({osql.sql_bio_spans('gold')}) AS BIGINT) AS n_spans,
       array_to_string({osql.sql_bio_spans('gold')}, ' ') AS spans,
       array_to_string({osql.sql_bio_spans('pred')}, ' ') AS pred_spans
FROM tags""")
def q_bio_spans(spark, sf):
    t = fx.tag_sequences(spark, sf).select("dialog_id", "turn", S.bio_spans("gold").alias("g"),
                                           S.bio_spans("pred").alias("p"))
    return t.select("dialog_id", "turn", F.size("g").cast("bigint").alias("n_spans"),
                    F.array_join("g", " ").alias("spans"), F.array_join("p", " ").alias("pred_spans"))


@register("substring_type_match", osql.SPAN_PAIRS + """
SELECT slot_type, CAST(sum(len(p)) AS BIGINT) AS n_pred_spans, CAST(sum(len(l)) AS BIGINT) AS n_true_spans,
       CAST(count(*) AS BIGINT) AS n_rows
FROM tx WHERE len(p) > 0 OR len(l) > 0 GROUP BY slot_type""")
def q_substring_type_match(spark, sf):
    x = S.span_type_rows(_span_pairs(spark, sf))
    return x.groupBy("slot_type").agg(F.sum(F.size("p")).cast("bigint").alias("n_pred_spans"),
                                      F.sum(F.size("l")).cast("bigint").alias("n_true_spans"),
                                      F.count(F.lit(1)).cast("bigint").alias("n_rows"))


@register("span_f1_per_type", osql.SPAN_PAIRS + """
SELECT slot_type, CAST(tp AS BIGINT) AS tp, CAST(n_pred AS BIGINT) AS n_pred, CAST(n_true AS BIGINT) AS n_true,
       round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
FROM f1""")
def q_span_f1_per_type(spark, sf):
    r = S.span_f1_per_type(_span_pairs(spark, sf))
    return r.select("slot_type", "tp", "n_pred", "n_true",
                    *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@register("span_f1_macro", osql.SPAN_PAIRS + """
SELECT CAST(count(*) AS BIGINT) AS n_types, round(avg(f1), 6) AS macro_f1 FROM f1""")
def q_span_f1_macro(spark, sf):
    return S.span_f1_macro(S.span_f1_per_type(_span_pairs(spark, sf))).select(
        F.col("n_types").cast("bigint").alias("n_types"), "macro_f1")


# Words tagged by their slot; slot of a word = the gold tag's key when it is a B-/I- tag
@register("word_bio", osql.TAGS + f""",
ws AS (SELECT {K2}, list_transform(gold, lambda g: CASE WHEN g LIKE 'B-%' OR g LIKE 'I-%' THEN substr(g, 3) END) AS sl
       FROM tags)
SELECT {K2}, array_to_string(list_transform(sl, lambda s, i:
         CASE WHEN s IS NULL THEN 'O' WHEN i > 1 AND sl[i - 1] = s THEN 'I-' || s ELSE 'B-' || s END), ' ') AS bio
FROM ws""")
def q_word_bio(spark, sf):
    t = fx.tag_sequences(spark, sf)
    sl = F.transform("gold", lambda g: F.when(g.startswith("B-") | g.startswith("I-"), F.substring(g, 3, 1 << 30)))
    return t.select("dialog_id", "turn", F.array_join(S.word_bio("toks", sl), " ").alias("bio"))


# ------------------------------------------------------------- array shaping

@register("crop_last_turn", osql.TAGS + f""",
c AS (SELECT {K2}, toks, gold,
        coalesce(list_max(list_filter(list_transform(toks, lambda x, i: CASE WHEN x = '.' THEN i - 1 END),
                                      lambda v: v IS NOT NULL)), -1) AS last FROM tags),
k AS (SELECT *, CASE WHEN last < 0 OR last = len(toks) - 1 THEN 0 ELSE last + 1 END AS kf FROM c)
SELECT {K2}, array_to_string(list_filter(toks, lambda x, i: i - 1 >= kf), ' ') AS words,
       array_to_string(list_filter(gold, lambda x, i: i - 1 >= kf), ' ') AS tags
FROM k""")
def q_crop_last_turn(spark, sf):
    t = fx.tag_sequences(spark, sf)
    return t.select("dialog_id", "turn",
                    F.array_join(A.crop_after_last("toks", "toks", "."), " ").alias("words"),
                    F.array_join(A.crop_after_last("gold", "toks", "."), " ").alias("tags"))


@register("drop_filler_tokens", osql.TAGS + f"""
SELECT {K2}, array_to_string(list_filter(toks, lambda x, i: toks[i] NOT IN ('', 'user', ',', '.')), ' ') AS words,
       array_to_string(list_filter(gold, lambda x, i: toks[i] NOT IN ('', 'user', ',', '.')), ' ') AS tags
FROM tags""")
def q_drop_filler_tokens(spark, sf):
    t = fx.tag_sequences(spark, sf)
    banned = ("", "user", ",", ".")
    return t.select("dialog_id", "turn", F.array_join(A.drop_where("toks", "toks", banned), " ").alias("words"),
                    F.array_join(A.drop_where("gold", "toks", banned), " ").alias("tags"))


@register("strip_pad_and_specials", osql.TAGS + f""",
m AS (SELECT {K2}, gold, list_position(list_transform(gold, lambda g: CASE WHEN g = '[PAD]' THEN 0 ELSE 1 END), 0) - 1
        AS pad FROM tags)
SELECT {K2}, CASE WHEN pad = 0 THEN array_to_string(gold[2 : greatest(len(gold) - 2, 0) + 1], ' ')
                  WHEN pad > 0 THEN array_to_string(gold[2 : greatest(pad - 2, 0) + 1], ' ') END AS tags
FROM m""")
def q_strip_pad_and_specials(spark, sf):
    t = fx.tag_sequences(spark, sf)
    mask = F.transform("gold", lambda g: F.when(g == "[PAD]", 0).otherwise(1))
    return t.select("dialog_id", "turn", F.array_join(A.strip_pad_and_specials("gold", mask), " ").alias("tags"))


@register("tail_truncate", osql.USER_TURNS + f"""
SELECT {K2}, array_to_string(CASE WHEN len(toks) > 16 THEN toks[-16:] ELSE toks END, ' ') AS tail
FROM ut""")
def q_tail_truncate(spark, sf):
    t = fx.user_turns(spark, sf)
    return t.select("dialog_id", "turn", F.array_join(A.tail_truncate("toks", 16), " ").alias("tail"))


@register("pad_to_length", osql.USER_TURNS + f"""
SELECT {K2}, array_to_string(list_concat(list_transform(toks, lambda x: length(x)),
         list_transform(range(0, greatest(64 - len(toks), 0)), lambda z: 0)), ' ') AS ids
FROM ut""")
def q_pad_to_length(spark, sf):
    t = fx.user_turns(spark, sf)
    ids = F.transform("toks", lambda x: F.length(x))
    return t.select("dialog_id", "turn", _joined(A.pad_to_length(ids, 64)).alias("ids"))


@register("head_crop", osql.USER_TURNS + f"""
SELECT {K2}, array_to_string(toks[1:50], ' ') AS head FROM ut""")
def q_head_crop(spark, sf):
    t = fx.user_turns(spark, sf)
    return t.select("dialog_id", "turn", F.array_join(A.head_crop("toks", 50), " ").alias("head"))


@register("argmax_class", """
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS pred_class, label
FROM embeddings""")
def q_argmax_class(spark, sf):
    e = fx.read_table(spark, sf, "embeddings")
    return e.select("vec_id", A.argmax("embedding").cast("int").alias("pred_class"), "label")


@register("first_span", osql.TAGS + f""",
l AS (SELECT {K2}, list_transform(gold, lambda g: CASE WHEN g LIKE 'B-%' OR g LIKE 'I-%' THEN 1 ELSE 0 END) AS lab
      FROM tags),
s AS (SELECT *, coalesce(list_position(lab, 1), 0) - 1 AS st FROM l)
SELECT {K2}, greatest(st, 0) AS start_pos,
       CAST(CASE WHEN st < 0 THEN 0 ELSE coalesce(list_min(list_filter(range(0, len(lab)),
            lambda i: i > st AND lab[i + 1] <> 1)), len(lab)) - 1 END AS INTEGER) AS end_pos
FROM s""")
def q_first_span(spark, sf):
    t = fx.tag_sequences(spark, sf)
    lab = F.transform("gold", lambda g: F.when(g.startswith("B-") | g.startswith("I-"), 1).otherwise(0))
    s, e = A.first_run(lab)
    return t.select("dialog_id", "turn", s.cast("int").alias("start_pos"), e.cast("int").alias("end_pos"))


@register("truncate_triple", osql.USER_TURNS + f""",
x AS (SELECT {K2}, len(toks) AS a, CAST(length(text) % 23 AS BIGINT) AS b, CAST(turn * 7 AS BIGINT) AS h FROM ut),
y AS (SELECT *, greatest(0, a + b - 36) AS xx, least(greatest(0, a + b - 36), abs(a - b)) AS gap FROM x),
z AS (SELECT *, CASE WHEN a > b THEN a - gap ELSE a END AS a1, CASE WHEN b >= a THEN b - gap ELSE b END AS b1,
             xx - gap AS rest FROM y)
SELECT {K2}, CAST(a1 - floor(rest / 2) AS INTEGER) AS keep_a, CAST(b1 - ceil(rest / 2) AS INTEGER) AS keep_b,
       CAST(greatest(0, least(h, 36 - a - b)) AS INTEGER) AS keep_hist
FROM z""")
def q_truncate_triple(spark, sf):
    t = fx.user_turns(spark, sf).select("dialog_id", "turn", F.size("toks").alias("a"),
                                        (F.length("text") % 23).alias("b"), (F.col("turn") * 7).alias("h"))
    a, b, h = A.truncate_triple("a", "b", "h", F.lit(36))
    return t.select("dialog_id", "turn", a.cast("int").alias("keep_a"), b.cast("int").alias("keep_b"),
                    h.cast("int").alias("keep_hist"))
