"""Corpus preparation and classification queries (A1, A2, A9, A10, A13-A15, P1, P2, P11, J1, J3, J4,
T3-T6, T8, U1-U4, W3, W10, W11, F14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators.ordering import DEFAULT_BUCKETS
from . import fixtures as fx
from . import oracle as osql
from .registry import register

I = osql.intents_cte()
SEED = "0"
N_FEW = 5


def _split(spark, sf, name):
    return fx.intent_rows(spark, sf).where(F.col("split") == name)


@register("category_counts", I + """
SELECT category, count(*) AS n FROM intents GROUP BY category""")
def q_category_counts(spark, sf):
    return C.category_counts(fx.intent_rows(spark, sf))


@register("distinct_vocab", I + """
SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS idx
FROM (SELECT DISTINCT category FROM intents)""")
def q_distinct_vocab(spark, sf):
    return C.distinct_vocab(_split(spark, sf, "train"), _split(spark, sf, "test")).select(
        "category", F.col("idx").cast("int").alias("idx"))


@register("union_distinct_labels", I + """
SELECT DISTINCT pred AS label FROM intents UNION SELECT DISTINCT category FROM intents""")
def q_union_distinct_labels(spark, sf):
    r = fx.intent_rows(spark, sf)
    return r.select(F.col("pred").alias("label")).union(r.select(F.col("category").alias("label"))).distinct()


@register("label_encode", I + """,
v AS (SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS idx
      FROM (SELECT DISTINCT category FROM intents WHERE split = 'train'))
SELECT i.pos, i.category, v.idx AS label_id FROM intents i LEFT JOIN v USING (category) WHERE i.split = 'test'""")
def q_label_encode(spark, sf):
    vocab = C.distinct_vocab(_split(spark, sf, "train"))
    ok, errors = C.label_encode(_split(spark, sf, "test").select("pos", "category"), vocab)
    # unknown labels stay in the result, without an id
    return ok.unionByName(errors).select("pos", "category", F.col("label_id").cast("int").alias("label_id"))


@register("label_decode", I + """,
v AS (SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS idx
      FROM (SELECT DISTINCT category FROM intents)),
p AS (SELECT i.pos, v.idx AS pred_id FROM intents i LEFT JOIN v ON v.category = i.pred)
SELECT p.pos, p.pred_id, v.category AS pred FROM p LEFT JOIN v ON v.idx = p.pred_id""")
def q_label_decode(spark, sf):
    r = fx.intent_rows(spark, sf)
    vocab = C.distinct_vocab(r)
    enc, _ = C.label_encode(r.select("pos", F.col("pred").alias("category")), vocab, out="pred_id")
    missing = C.label_encode(r.select("pos", F.col("pred").alias("category")), vocab, out="pred_id")[1]
    ids = enc.unionByName(missing).select("pos", F.col("pred_id").cast("int").alias("pred_id"))
    return C.label_decode(ids, vocab, "pred_id", out="pred")


@register("align_pred_gold", I + """
SELECT pos, category AS gold, pred FROM intents""")
def q_align_pred_gold(spark, sf):
    r = fx.intent_rows(spark, sf)
    return C.align(r.select("pos", "pred"), r.select("pos", F.col("category").alias("gold")))


@register("accuracy", I + """,
p AS (SELECT pos, pred FROM intents WHERE substr(md5('pm:' || CAST(pos AS VARCHAR)), 1, 1) <> 'f')
SELECT CAST((SELECT count(*) FROM intents) AS BIGINT) AS n_gold, CAST((SELECT count(*) FROM p) AS BIGINT) AS n_pred,
       CAST(count(*) FILTER (WHERE p.pred = i.category) AS BIGINT) AS n_match,
       round(count(*) FILTER (WHERE p.pred = i.category) / (SELECT count(*) FROM intents), 6) AS acc_gold,
       round(count(*) FILTER (WHERE p.pred = i.category) / (SELECT count(*) FROM p), 6) AS acc_pred
FROM intents i JOIN p USING (pos)""")
def q_accuracy(spark, sf):
    r = fx.intent_rows(spark, sf)
    # the prediction list misses some rows, so the two denominators differ (Q2)
    pred = r.where(F.substring(fx.md5_of("pm", F.col("pos")), 1, 1) != "f").select("pos", "pred")
    return C.accuracy(pred, r.select("pos", F.col("category").alias("gold")))


@register("exact_match_parse", osql.TAGS + """,
ep AS (SELECT dialog_id, turn, gold, pred,
         'IN_' || CAST(('0x' || substr(md5('in:' || CAST(dialog_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)), 1, 2))::BIGINT % 4 AS VARCHAR) AS gi,
         CASE WHEN substr(md5('in:' || CAST(dialog_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)), 3, 1) < 'c'
              THEN 'IN_' || CAST(('0x' || substr(md5('in:' || CAST(dialog_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)), 1, 2))::BIGINT % 4 AS VARCHAR)
              ELSE 'IN_X' END AS pi FROM tags)
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN gi = pi AND gold = pred THEN 1.0 ELSE 0.0 END), 6) AS exact_match
FROM ep""")
def q_exact_match_parse(spark, sf):
    t = fx.tag_sequences(spark, sf)
    h = fx.md5_of("in", F.col("dialog_id"), F.col("turn"))
    gi = F.concat(F.lit("IN_"), (fx.hexint(h, 1, 2) % 4).cast("string"))
    pi = F.when(F.substring(h, 3, 1) < "c", gi).otherwise(F.lit("IN_X"))
    pairs = t.select(gi.alias("gold_intent"), pi.alias("pred_intent"),
                     F.col("gold").alias("gold_tags"), F.col("pred").alias("pred_tags"))
    return C.exact_match(pairs).select(F.col("n").cast("bigint").alias("n"), "exact_match")


def _labels_sql():
    rows = " UNION ALL ".join(f"SELECT {osql.q(k)} AS dataset, {osql.q(v)} AS label"
                              for k, v in C.DATASET_LABELS.items())
    order = " UNION ALL ".join(f"SELECT {osql.q(k)} AS label, {i} AS ord" for i, k in enumerate(C.SUMMARY_ORDER))
    return rows, order


_LR, _ORD = _labels_sql()


@register("benchmark_summary", I + f""",
sc AS (SELECT dataset, avg(CASE WHEN pred = category THEN 1.0 ELSE 0.0 END) AS score FROM intents GROUP BY dataset),
lb AS ({_LR}), od AS ({_ORD}),
per AS (SELECT lb.label, sc.score * 100 AS value FROM sc JOIN lb USING (dataset)),
allr AS (SELECT label, value FROM per UNION ALL SELECT 'Average', avg(value) FROM per)
SELECT allr.label, od.ord, round(allr.value, 6) AS value FROM allr JOIN od USING (label)""")
def q_benchmark_summary(spark, sf):
    r = fx.intent_rows(spark, sf)
    scores = C.grouped_accuracy(r.select("dataset", "pred", F.col("category").alias("gold")), ["dataset"])
    return C.benchmark_summary(scores.select("dataset", F.col("acc").alias("score"))).select(
        "label", F.col("ord").cast("int").alias("ord"), "value")


@register("run_summary", I + osql.RUNS + """,
rs AS (SELECT dataset, run, avg(CASE WHEN pred = category THEN 1.0 ELSE 0.0 END) AS score FROM runs GROUP BY dataset, run)
SELECT dataset, CAST(count(*) AS BIGINT) AS n_runs, round(avg(score), 6) AS mean, round(max(score), 6) AS max,
       round(min(score), 6) AS min, count(*) = 5 AS ok
FROM rs GROUP BY dataset""")
def q_run_summary(spark, sf):
    runs = fx.run_predictions(fx.intent_rows(spark, sf))
    per_run = C.grouped_accuracy(runs.select("dataset", "run", "pred", F.col("category").alias("gold")),
                                 ["dataset", "run"])
    return C.run_summary(per_run.select("dataset", F.col("acc").alias("score"))).select(
        "dataset", F.col("n_runs").cast("bigint").alias("n_runs"), "mean", "max", "min", "ok")


@register("validate_submission", I + """,
sub AS (SELECT DISTINCT CASE WHEN dataset = 'top' OR substr(md5('sub:' || CAST(pos AS VARCHAR)), 1, 2) = '00'
                             THEN 'snips' ELSE dataset END AS dataset FROM intents),
exp AS (SELECT unnest(['hwu', 'clinc', 'banking', 'restaurant8k', 'dstc8', 'multiwoz', 'top']) AS dataset)
SELECT dataset, 'missing' AS problem FROM exp WHERE dataset NOT IN (SELECT dataset FROM sub)
UNION ALL SELECT dataset, 'unexpected' FROM sub WHERE dataset NOT IN (SELECT dataset FROM exp)""")
def q_validate_submission(spark, sf):
    r = fx.intent_rows(spark, sf)      # one dataset's rows come under a wrong name
    wrong = (F.col("dataset") == "top") | (F.substring(fx.md5_of("sub", F.col("pos")), 1, 2) == "00")
    sub = r.select(F.when(wrong, F.lit("snips"))
                   .otherwise(F.col("dataset")).alias("dataset"))
    return C.validate_submission(sub)


# ------------------------------------------------------------------ sampling

def _few_sql():
    return I + f""",
tr AS (SELECT * FROM intents WHERE split = 'train'),
few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('{SEED}:' || CAST(pos AS VARCHAR))) AS rank
                       FROM tr) WHERE rank <= {N_FEW})"""


@register("sample_per_class", _few_sql() + """
SELECT pos, category, CAST(rank AS INTEGER) AS rank FROM few""")
def q_sample_per_class(spark, sf):
    s = C.sample_per_class(_split(spark, sf, "train"), N_FEW, seed=SEED)
    return s.select("pos", "category", F.col("rank").cast("int").alias("rank"))


@register("every_other_row", _few_sql() + f""",
cl AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS c FROM (SELECT DISTINCT category FROM few))
SELECT pos, category, CAST(c * {N_FEW} + rank - 1 AS BIGINT) AS file_pos FROM few JOIN cl USING (category)
WHERE (c * {N_FEW} + rank - 1) % 2 = 0""")
def q_every_other_row(spark, sf):
    s = C.sample_per_class(_split(spark, sf, "train"), N_FEW, seed=SEED)
    return C.every_other(s, N_FEW).select("pos", "category", F.col("file_pos").cast("bigint").alias("file_pos"))


@register("exclude_fewshot", _few_sql() + """
SELECT pos, category FROM tr WHERE NOT EXISTS (SELECT 1 FROM few f WHERE f.text IS NOT DISTINCT FROM tr.text
                                                AND f.category IS NOT DISTINCT FROM tr.category)""")
def q_exclude_fewshot(spark, sf):
    tr = _split(spark, sf, "train")
    few = C.sample_per_class(tr, N_FEW, seed=SEED)
    return C.value_anti(tr, few, ["text", "category"]).select("pos", "category")


def _strat_sql(ratio: int):
    from ..operators.ordering import sql_dense_index
    return _few_sql() + f""",
cand0 AS (SELECT * FROM tr WHERE NOT EXISTS (SELECT 1 FROM few f WHERE f.text IS NOT DISTINCT FROM tr.text
                                              AND f.category IS NOT DISTINCT FROM tr.category)),
cand AS ({sql_dense_index('cand0', ['category'], 'pos', 'cidx', DEFAULT_BUCKETS, 'n_cand')}),
te0 AS (SELECT pos, category FROM intents WHERE split = 'test'),
te AS ({sql_dense_index('te0', ['category'], 'pos', 'tidx', DEFAULT_BUCKETS, 'n_test')}),
sizes AS (SELECT category, count(*) AS n_cand FROM cand GROUP BY category),
dr AS (SELECT te.category, te.tidx AS draw, sizes.n_cand FROM te JOIN sizes USING (category)
       WHERE te.tidx < floor(te.n_test / {ratio})),
dr2 AS (SELECT *, ('0x' || substr(md5('{SEED}:' || category || ':' || CAST(draw AS VARCHAR)), 1, 8))::BIGINT
                  % greatest(n_cand, 1) AS cidx FROM dr),
val AS (SELECT dr2.category, dr2.draw, cand.pos, cand.text FROM dr2 JOIN cand USING (category, cidx))"""


@register("split_stratified", _strat_sql(2) + """
SELECT category, CAST(draw AS BIGINT) AS draw, pos FROM val""")
def q_split_stratified(spark, sf):
    r = fx.intent_rows(spark, sf)
    tr = r.where(F.col("split") == "train")
    few = C.sample_per_class(tr, N_FEW, seed=SEED)
    val, _ = C.stratified_val(tr, r.where(F.col("split") == "test"), few, ratio=2, seed=SEED)
    return val.select("category", F.col("draw").cast("bigint").alias("draw"), "pos")


@register("split_stratified_train", _strat_sql(1) + """
SELECT pos, category FROM tr WHERE pos NOT IN (SELECT pos FROM val)""")
def q_split_stratified_train(spark, sf):
    r = fx.intent_rows(spark, sf)
    tr = r.where(F.col("split") == "train")
    few = C.sample_per_class(tr, N_FEW, seed=SEED)
    _, new_train = C.stratified_val(tr, r.where(F.col("split") == "test"), few, ratio=1, seed=SEED)
    return new_train.select("pos", "category")


def _frac_sql():
    from ..operators.ordering import sql_dense_index
    return I + f""",
ix AS ({sql_dense_index('intents', [], 'pos', 'ridx', DEFAULT_BUCKETS, 'n_rows')}),
dr AS (SELECT ridx AS draw, n_rows FROM ix WHERE ridx < floor(n_rows / 10)),
dr2 AS (SELECT draw, ('0x' || substr(md5('{SEED}:' || CAST(draw AS VARCHAR)), 1, 8))::BIGINT % n_rows AS ridx FROM dr)"""


@register("sample_fraction", _frac_sql() + """
SELECT CAST(dr2.draw AS BIGINT) AS draw, ix.pos, ix.category FROM dr2 JOIN ix USING (ridx)""")
def q_sample_fraction(spark, sf):
    s = C.sample_fraction(fx.intent_rows(spark, sf), 10, seed=SEED)
    return s.select(F.col("draw").cast("bigint").alias("draw"), "pos", "category")


@register("tail_half_pool", I + """,
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY pos) - 1 AS fidx, count(*) OVER (PARTITION BY lang) AS n_rows
      FROM intents WHERE split = 'train')
SELECT lang, pos, CAST(fidx AS BIGINT) AS fidx FROM o WHERE fidx >= n_rows - ceil(n_rows / 2)""")
def q_tail_half_pool(spark, sf):
    t = C.tail_pool(_split(spark, sf, "train"), ["lang"], "pos", block=256)
    return t.select("lang", "pos", F.col("fidx").cast("bigint").alias("fidx"))


@register("split_slot_holdout", I + f""",
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY pos) - 1 AS fidx, count(*) OVER (PARTITION BY lang) AS n_rows
      FROM intents WHERE split = 'train'),
pool AS (SELECT *, fidx - (n_rows - CAST(ceil(n_rows / 2) AS BIGINT)) AS pidx, CAST(ceil(n_rows / 2) AS BIGINT) AS n_pool
         FROM o WHERE fidx >= n_rows - ceil(n_rows / 2)),
te AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY pos) - 1 AS tidx, count(*) OVER (PARTITION BY lang) AS n_test
       FROM intents WHERE split = 'test'),
sz AS (SELECT lang, max(n_pool) AS n_pool FROM pool GROUP BY lang),
dr AS (SELECT te.lang, te.tidx AS draw, sz.n_pool FROM te JOIN sz USING (lang) WHERE te.tidx < floor(te.n_test / 3)),
dr2 AS (SELECT *, ('0x' || substr(md5('{SEED}:' || lang || ':' || CAST(draw AS VARCHAR)), 1, 8))::BIGINT % n_pool AS pidx FROM dr)
SELECT dr2.lang, CAST(dr2.draw AS BIGINT) AS draw, pool.pos FROM dr2 JOIN pool USING (lang, pidx)""")
def q_split_slot_holdout(spark, sf):
    from ..operators.ordering import dense_index
    tr = _split(spark, sf, "train")
    pool = C.tail_pool(tr, ["lang"], "pos", block=256)
    pool = pool.withColumn("pidx", F.col("fidx") - (F.col("n_rows") - F.ceil(F.col("n_rows") / 2)))
    te = dense_index(_split(spark, sf, "test").select("pos", "lang"), ["lang"], "pos", "tidx",
                     count_col="n_test", range_block=256)
    sizes = pool.groupBy("lang").agg(F.count(F.lit(1)).alias("n_pool"))
    dr = (te.where(F.col("tidx") < F.floor(F.col("n_test") / 3)).select("lang", F.col("tidx").alias("draw"))
          .join(sizes, "lang")
          .withColumn("pidx", C.draw_index(SEED, F.col("n_pool"), F.col("lang"), F.col("draw"))))
    return dr.join(pool.select("lang", "pidx", "pos"), ["lang", "pidx"]).select(
        "lang", F.col("draw").cast("bigint").alias("draw"), "pos")


def _holdout_parts_sql(val: str, group: str) -> str:
    """The parts of T6 from ``val`` (draw, pos and the group), over the CTE ``intents``."""
    from ..operators.ordering import sql_dense_index
    g = f"{group}, " if group else ""
    same = "".join(f" AND d.{c} IS NOT DISTINCT FROM t.{c}" for c in [group] if c)
    test = f"UNION ALL SELECT 'test', {g}NULL, pos FROM intents WHERE split = 'test'" if group else ""
    return I + f""",
{val},
tn AS (SELECT * FROM intents WHERE split = 'train'),
dw AS (SELECT * FROM tn WHERE pos IN (SELECT pos FROM val)),
rest AS (SELECT * FROM tn t WHERE NOT EXISTS (SELECT 1 FROM dw d WHERE d.text IS NOT DISTINCT FROM t.text
         AND d.category IS NOT DISTINCT FROM t.category{same})),
fx AS ({sql_dense_index('rest', [], 'pos', 'ridx', DEFAULT_BUCKETS, 'n_rest')}),
fd AS (SELECT ridx AS draw, n_rest FROM fx WHERE ridx < floor(n_rest / 10)),
fe AS (SELECT draw, ('0x' || substr(md5('{SEED}:' || CAST(draw AS VARCHAR)), 1, 8))::BIGINT % n_rest AS ridx FROM fd)
SELECT 'train' AS part, {g}CAST(NULL AS BIGINT) AS draw, pos FROM rest
UNION ALL SELECT 'val', {g}draw, pos FROM val
UNION ALL SELECT 'few', {g}CAST(fe.draw AS BIGINT), pos FROM fe JOIN fx USING (ridx)
{test}"""


@register("split_slot_holdout_parts", _holdout_parts_sql(f"""o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY pos) - 1 AS fidx, count(*) OVER (PARTITION BY lang) AS n_rows
      FROM intents WHERE split = 'train'),
pool AS (SELECT *, fidx - (n_rows - CAST(ceil(n_rows / 2) AS BIGINT)) AS pidx, CAST(ceil(n_rows / 2) AS BIGINT) AS n_pool
         FROM o WHERE fidx >= n_rows - ceil(n_rows / 2)),
te AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY pos) - 1 AS tidx, count(*) OVER (PARTITION BY lang) AS n_test
       FROM intents WHERE split = 'test'),
sz AS (SELECT lang, max(n_pool) AS n_pool FROM pool GROUP BY lang),
dr AS (SELECT te.lang, te.tidx AS draw, sz.n_pool FROM te JOIN sz USING (lang) WHERE te.tidx < floor(te.n_test / 3)),
dr2 AS (SELECT *, ('0x' || substr(md5('{SEED}:' || lang || ':' || CAST(draw AS VARCHAR)), 1, 8))::BIGINT % n_pool AS pidx FROM dr),
val AS (SELECT dr2.lang, CAST(dr2.draw AS BIGINT) AS draw, pool.pos FROM dr2 JOIN pool USING (lang, pidx))""", "lang"))
def q_split_slot_holdout_parts(spark, sf):
    val = q_split_slot_holdout(spark, sf)
    return C.slot_holdout(_split(spark, sf, "train"), val, _split(spark, sf, "test"), ["lang"], ["text", "category"],
                          seed=SEED)


@register("split_slot_last_rows", _holdout_parts_sql(f"""o AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS fidx, count(*) OVER () AS n_rows
      FROM intents WHERE split = 'train'),
pool AS (SELECT pos, fidx - greatest(n_rows - 4000, 0) AS pidx, least(n_rows, 4000) AS n_pool FROM o WHERE fidx >= n_rows - 4000),
dr AS (SELECT k AS draw, ('0x' || substr(md5('{SEED}:' || CAST(k AS VARCHAR)), 1, 8))::BIGINT
              % (SELECT max(n_pool) FROM pool) AS pidx FROM range(1000) r(k)),
val AS (SELECT CAST(dr.draw AS BIGINT) AS draw, pool.pos FROM dr JOIN pool USING (pidx))""", ""))
def q_split_slot_last_rows(spark, sf):
    train = _split(spark, sf, "train")
    val = C.last_rows_val(train, seed=SEED, block=256)
    return C.slot_holdout(train, val, None, [], ["text", "category"], seed=SEED)


@register("shuffle_batches", I + f""",
h AS (SELECT pos, md5('{SEED}:' || CAST(pos AS VARCHAR)) AS hh FROM intents),
o AS (SELECT pos, row_number() OVER (ORDER BY ('0x' || substr(md5(hh), 1, 8))::BIGINT % {DEFAULT_BUCKETS}, hh) - 1 AS oi FROM h)
SELECT pos, CAST(oi AS BIGINT) AS order_idx, CAST(floor(oi / 32) AS BIGINT) AS batch FROM o""")
def q_shuffle_batches(spark, sf):
    b = C.batches(fx.intent_rows(spark, sf).select("pos"), 32, seed=SEED)
    return b.select("pos", F.col("order_idx").cast("bigint").alias("order_idx"),
                    F.col("batch").cast("bigint").alias("batch"))


# ------------------------------------------------------------------ set ops

@register("anti_rows", I + """,
val AS (SELECT text, category FROM intents WHERE split = 'test' AND substr(md5('v:' || CAST(pos AS VARCHAR)), 1, 1) < '4'),
dup AS (SELECT pos + 1000000000 AS pos, text, category FROM intents WHERE split = 'test'
        AND substr(md5('v:' || CAST(pos AS VARCHAR)), 1, 1) < '2'),
tr AS (SELECT pos, text, category FROM intents WHERE split = 'train' UNION ALL SELECT * FROM dup)
SELECT pos, category FROM tr WHERE NOT EXISTS (SELECT 1 FROM val v WHERE v.text IS NOT DISTINCT FROM tr.text
                                               AND v.category IS NOT DISTINCT FROM tr.category)""")
def q_anti_rows(spark, sf):
    r = fx.intent_rows(spark, sf)
    hv = F.substring(fx.md5_of("v", F.col("pos")), 1, 1)
    te = r.where(F.col("split") == "test")
    val = te.where(hv < "4").select("text", "category")
    # train rows that copy validation rows (and duplicates of them) all go
    dup = te.where(hv < "2").select((F.col("pos") + 1000000000).alias("pos"), "text", "category")
    tr = r.where(F.col("split") == "train").select("pos", "text", "category").unionByName(dup)
    return C.value_anti(tr, val, ["text", "category"]).select("pos", "category")


@register("except_rows", I + """,
a AS (SELECT category FROM intents),
b AS (SELECT DISTINCT category FROM intents WHERE substr(md5('x:' || CAST(pos AS VARCHAR)), 1, 2) = '00')
SELECT category, CAST(count(*) AS BIGINT) AS n FROM a WHERE category NOT IN (SELECT category FROM b) GROUP BY category""")
def q_except_rows(spark, sf):
    r = fx.intent_rows(spark, sf)
    other = r.where(F.substring(fx.md5_of("x", F.col("pos")), 1, 2) == "00").select("category")
    out = C.value_anti(r.select("category"), other, ["category"])
    return out.groupBy("category").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@register("union_subdomains", I + """
SELECT lang AS domain, pos, category FROM intents WHERE lang = 'en'
UNION ALL SELECT lang, pos, category FROM intents WHERE lang = 'fr'
UNION ALL SELECT lang, pos, category FROM intents WHERE lang = 'de'
UNION ALL SELECT lang, pos, category FROM intents WHERE lang = 'es'""")
def q_union_subdomains(spark, sf):
    """Sub-domain sets appended (languages of the documents stand in for the four sub-domains)."""
    r = fx.intent_rows(spark, sf)
    parts = [r.where(F.col("lang") == d).select(F.col("lang").alias("domain"), "pos", "category")
             for d in ("en", "fr", "de", "es")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _batch_examples_sql() -> str:
    from ..operators.ordering import sql_dense_index
    md = lambda *parts: "md5(" + " || ':' || ".join([f"'{SEED}'"] + [f"CAST({p} AS VARCHAR)" for p in parts]) + ")"
    draw = lambda n, *parts: f"('0x' || substr({md(*parts)}, 1, 8))::BIGINT % greatest({n}, 1)"
    return I + f""",
tr AS (SELECT pos, category FROM intents WHERE split = 'train'),
voc AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS label FROM (SELECT DISTINCT category FROM tr)),
enc AS (SELECT tr.pos, voc.label FROM tr JOIN voc USING (category)),
bh AS (SELECT pos, label, md5('{SEED}:' || CAST(pos AS VARCHAR)) AS hh FROM enc),
bo AS (SELECT pos, label, row_number() OVER (ORDER BY ('0x' || substr(md5(hh), 1, 8))::BIGINT % {DEFAULT_BUCKETS}, hh) - 1 AS oi
       FROM bh),
rws AS (SELECT pos, label, CAST(floor(oi / 32) AS BIGINT) AS batch FROM bo),
nall AS (SELECT count(*) AS n_all FROM rws),
lab_idx AS ({sql_dense_index('rws', ['label'], 'pos', 'lidx', DEFAULT_BUCKETS, 'n_label')}),
gix AS ({sql_dense_index('rws', [], 'pos', 'gidx', DEFAULT_BUCKETS)}),
sizes AS (SELECT label, max(n_label) AS n_label FROM lab_idx GROUP BY label),
mem AS (SELECT batch, label, count(*) AS m FROM rws GROUP BY batch, label),
st AS (SELECT mem.*, n_label, {draw('n_label', 'batch', 'label')} AS start FROM mem JOIN sizes USING (label)),
walk AS (SELECT batch, label, n_label, start, unnest(range(0, least(n_label, m + 1))) AS a FROM st),
cand AS (SELECT walk.batch, walk.label, walk.a, x.pos,
                EXISTS (SELECT 1 FROM rws r WHERE r.batch = walk.batch AND r.pos = x.pos) AS inside
         FROM walk JOIN lab_idx x ON x.label = walk.label AND x.lidx = (walk.start + walk.a) % walk.n_label),
picked AS (SELECT batch, pos FROM (SELECT *, row_number() OVER (PARTITION BY batch, label ORDER BY inside, a) AS r
                                   FROM cand) WHERE r = 1),
taken AS (SELECT batch, pos FROM rws UNION SELECT batch, pos FROM picked),
nt AS (SELECT batch, count(*) AS nt FROM taken GROUP BY batch),
nlab AS (SELECT batch, count(*) AS nl FROM picked GROUP BY batch),
need AS (SELECT batch, least(n_all, bs * 2) - coalesce(nl, 0) AS need, nt, n_all
         FROM (SELECT batch, count(*) AS bs FROM rws GROUP BY batch) JOIN nt USING (batch) LEFT JOIN nlab USING (batch), nall),
fs AS (SELECT *, {draw('n_all', 'batch', "'fill'")} AS start FROM need WHERE need > 0),
fw AS (SELECT batch, need, n_all, start, unnest(range(0, least(n_all, need + nt))) AS f FROM fs),
fk AS (SELECT fw.batch, fw.need, fw.f, gix.pos FROM fw JOIN gix ON gix.gidx = (fw.start + fw.f) % fw.n_all
       WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.batch = fw.batch AND t.pos = gix.pos)),
fr AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY f) AS r FROM fk)
SELECT batch, pos, 'label' AS kind, CAST(-1 AS BIGINT) AS attempt FROM picked
UNION ALL SELECT batch, pos, 'fill', CAST(f AS BIGINT) FROM fr WHERE r <= need"""


@register("batch_examples", _batch_examples_sql())
def q_batch_examples(spark, sf):
    """T7 over the training intents, batches of 32 from T8, class index as the label."""
    r = fx.intent_rows(spark, sf).where(F.col("split") == "train")
    vocab = C.distinct_vocab(r)
    enc, _ = C.label_encode(r.select("pos", "category"), vocab, out="label")
    b = C.batches(enc.select("pos", "label"), 32, seed=SEED).select("pos", "label", "batch")
    return C.batch_examples(b, seed=SEED)
