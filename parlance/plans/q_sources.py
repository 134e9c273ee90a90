"""Source/sink round trips and corpus assembly (SC1-SC8, SC11, SK1-SK3, SK5, F13-F15, W3, U1, A15).

Each source query first writes derived rows in the reference's file layout
(to a fresh folder under the session's shared checkpoint folder), then reads
them back with the engine's reader, so the oracle checks the round trip.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import STRIP_WS_CLASS
from ..functions.values import span_words_to_slot, split_words
from ..operators import corpus as C
from ..operators import spans as S
from ..operators.ordering import dense_index
from ..session import written
from ..sources import json_ranges as J
from ..sources import readers as R
from ..sources import sinks as K
from ..sources.predictions import read_prediction_files
from . import fixtures as fx
from . import oracle as osql
from .registry import register

I = osql.intents_cte()
_SL = osql.sql_list


@register("scan_intent_csv", """SELECT text, source AS category FROM documents""")
def q_scan_intent_csv(spark, sf):
    path = K.write_csv_quoted(fx.intent_rows(spark, sf).select("text", "category"))
    return R.read_intent_csv(spark, path)


@register("scan_delim_project", """SELECT text, lang || '_' || source AS category FROM documents""")
def q_scan_delim_project(spark, sf):
    d = fx.read_table(spark, sf, "documents")
    raw = d.select(F.col("doc_id").alias("userid"), F.col("lang").alias("scenario"), F.col("source").alias("intent"),
                   F.col("text").alias("answer_from_anno"), F.lit("checked").alias("status"))
    path = K.write_csv_quoted(raw, sep=";")
    return R.read_delim_project(spark, path)


@register("scan_many_files", """SELECT text, source AS category FROM documents""")
def q_scan_many_files(spark, sf):
    path = K.write_csv_quoted(fx.intent_rows(spark, sf).select("text", "category"), partition_by="category")
    return R.read_many_files(spark, path)


_SETS = ("train", "test", "val", "oos_train", "oos_val")


@register("scan_json_sets", f"""
SELECT {_SL(_SETS)}[('0x' || substr(md5('set:' || CAST(doc_id AS VARCHAR)), 1, 2))::BIGINT % 5 + 1] AS set_name,
       text, source AS category
FROM documents
WHERE {_SL(_SETS)}[('0x' || substr(md5('set:' || CAST(doc_id AS VARCHAR)), 1, 2))::BIGINT % 5 + 1] IN ('train', 'test', 'val')""")
def q_scan_json_sets(spark, sf):
    d = fx.read_table(spark, sf, "documents")
    set_name = F.element_at(F.array(*[F.lit(s) for s in _SETS]),
                            (fx.hexint(fx.md5_of("set", F.col("doc_id")), 1, 2) % 5 + 1).cast("int"))
    obj = d.select(F.to_json(F.create_map(set_name, F.array(F.array("text", "source")))).alias("value"))
    from ..session import fresh_path
    path = fresh_path(spark, "json-sets")
    obj.write.text(path)
    return R.read_json_sets(spark, path)


def _slot_sql():
    ws = STRIP_WS_CLASS
    hx = lambda i, n: f"('0x' || substr(h, {i}, {n}))::BIGINT"
    lab = []
    for k in range(2):
        lab.append(f"""{{'slot': {_SL(fx.SLOT_LABELS)}[{hx(22 + k, 1)} % 4 + 1],
          's': CASE WHEN substr(h, {20 + k}, 1) < 'e' THEN {hx(3 + 6 * k, 4)} % nn ELSE 0 END,
          'e': CASE WHEN substr(h, {20 + k}, 1) < 'c' THEN {hx(3 + 6 * k, 4)} % nn + 1 + {hx(7 + 6 * k, 2)} % 20 ELSE -1 END}}""")
    return f"""WITH se0 AS (
  SELECT conv_id * 4294967296 + turn AS pos, text, md5('se:' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)) AS h,
         greatest(length(text), 1) AS nn, length(text) AS n
  FROM conversations WHERE role = 'user'),
se1 AS (
  SELECT pos, text, n,
         CASE {hx(1, 2)} % 4 WHEN 1 THEN ['time'] WHEN 2 THEN ['date', 'time'] ELSE []::VARCHAR[] END AS ctx,
         ([{lab[0]}, {lab[1]}])[1 : {hx(25, 1)} % 3] AS labels
  FROM se0),
se2 AS (
  SELECT pos, text, ctx, labels,
    flatten(list_transform(labels, lambda l:
      list_transform(regexp_extract_all(
          CASE WHEN (CASE WHEN l.e < 0 THEN greatest(n + l.e, 0) ELSE least(l.e, n) END) > least(l.s, n)
               THEN substring(text, least(l.s, n) + 1,
                              (CASE WHEN l.e < 0 THEN greatest(n + l.e, 0) ELSE least(l.e, n) END) - least(l.s, n))
               ELSE '' END, '[^{ws}]+', 0),
        lambda w: {{'w': w, 'slot': l.slot}}))) AS entries,
    CASE WHEN len(ctx) > 0 THEN array_to_string(list_reverse(ctx), ' ') || ' ' || text ELSE text END AS full_text
  FROM se1),
se3 AS (
  SELECT pos, full_text, len(labels) AS n_labels, entries,
         list_transform(regexp_extract_all(full_text, '[^{ws}]+', 0),
           lambda w: (list_filter(entries, lambda e: e.w = w))[-1].slot) AS sl
  FROM se2)"""


SLOT_SQL = _slot_sql()


def _slot_rows(spark, sf):
    path = K.write_json_arrays(fx.slot_examples(spark, sf).withColumn("grp", F.floor(F.col("pos") / 1000)), "grp", "pos")
    return R.read_json_array(spark, path)


@register("scan_json_array", SLOT_SQL + """
SELECT pos, full_text AS text, CAST(n_labels AS INTEGER) AS n_labels FROM se3""")
def q_scan_json_array(spark, sf):
    r = _slot_rows(spark, sf)
    return r.select("pos", C.prepend_context(F.col("userInput.text"), F.col("context.requestedSlots")).alias("text"),
                    F.size(F.coalesce("labels", F.array())).cast("int").alias("n_labels"))


@register("prepend_context", SLOT_SQL + """
SELECT pos, full_text AS text FROM se3""")
def q_prepend_context(spark, sf):
    e = fx.slot_examples(spark, sf)
    return e.select("pos", C.prepend_context(F.col("userInput.text"), F.col("context.requestedSlots")).alias("text"))


@register("span_words_to_slot", SLOT_SQL + """
SELECT pos, array_to_string(list_transform(sl, lambda s, i: CASE WHEN s IS NULL THEN 'O'
         WHEN i > 1 AND sl[i - 1] = s THEN 'I-' || s ELSE 'B-' || s END), ' ') AS tags
FROM se3""")
def q_span_words_to_slot(spark, sf):
    r = _slot_rows(spark, sf)
    m = span_words_to_slot(F.col("userInput.text"), F.col("labels"))
    full = C.prepend_context(F.col("userInput.text"), F.col("context.requestedSlots"))
    x = r.select("pos", m.alias("m"), split_words(full).alias("words"))
    sl = F.transform("words", lambda w: F.try_element_at(F.col("m"), w))
    return x.select("pos", F.array_join(S.word_bio("words", sl), " ").alias("tags"))


def _top_sql():
    from .fixtures import TOP_INTENTS, TOP_SLOTS
    return osql.USER_TURNS + f""",
tp AS (
  SELECT dialog_id, turn,
    '[IN:' || {_SL(TOP_INTENTS)}[('0x' || substr(md5('ti:' || CAST(dialog_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)), 1, 2))::BIGINT % 4 + 1]
    || ' ' || array_to_string(list_transform(toks, lambda w, i:
        CASE WHEN substr(md5('tw:' || CAST(dialog_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) || ':' || CAST(i - 1 AS VARCHAR)), 1, 1) < '3'
             THEN '[SL:' || {_SL(TOP_SLOTS)}[('0x' || substr(md5('tw:' || CAST(dialog_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) || ':' || CAST(i - 1 AS VARCHAR)), 2, 2))::BIGINT % 4 + 1] || ' '
             ELSE '' END
        || regexp_replace(w, '[\\t ]', '_', 'g')
        || CASE WHEN substr(md5('tw:' || CAST(dialog_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) || ':' || CAST(i - 1 AS VARCHAR)), 1, 1) >= '3'
                 AND substr(md5('tw:' || CAST(dialog_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) || ':' || CAST(i - 1 AS VARCHAR)), 1, 1) < '6'
             THEN ' ]' ELSE '' END), ' ') || ' ]' AS parse
  FROM ut),
bio AS (
  SELECT dialog_id, turn, parse, list_reduce(string_split(parse, ' '), lambda acc, t: CASE
     WHEN starts_with(t, '[') AND acc.started = false THEN {{'intent': replace(trim(t, '['), 'IN:', 'IN_'), 'started': true, 'first': acc.first, 'tags': acc.tags, 'out': acc.out}}
     WHEN starts_with(t, '[') THEN {{'intent': acc.intent, 'started': true, 'first': true, 'tags': list_append(acc.tags, replace(replace(trim(t, '['), 'IN:', 'IN_'), 'SL:', 'SL_')), 'out': acc.out}}
     WHEN starts_with(t, ']') THEN {{'intent': acc.intent, 'started': acc.started, 'first': acc.first, 'tags': CASE WHEN len(acc.tags) > 0 THEN acc.tags[1:len(acc.tags)-1] ELSE acc.tags END, 'out': acc.out}}
     ELSE {{'intent': acc.intent, 'started': acc.started, 'first': CASE WHEN len(acc.tags) > 0 THEN false ELSE acc.first END, 'tags': acc.tags,
           'out': list_append(acc.out, t || ':' || CASE WHEN len(acc.tags) = 0 THEN 'O' WHEN acc.first THEN 'B-' || array_to_string(acc.tags, '_') ELSE 'I-' || array_to_string(acc.tags, '_') END)}}
   END, {{'intent': NULL::VARCHAR, 'started': false, 'first': true, 'tags': []::VARCHAR[], 'out': []::VARCHAR[]}}) AS r
  FROM tp),
tagged AS (SELECT dialog_id, turn, array_to_string(r.out, ' ') || ' <=> ' || r.intent AS line FROM bio)"""


TOP_SQL = _top_sql()


@register("scan_tsv_field", TOP_SQL + """
SELECT parse AS value FROM tp""")
def q_scan_tsv_field(spark, sf):
    p = fx.top_parses(spark, sf)
    lines = p.select(F.concat_ws("\t", F.col("dialog_id").cast("string"), F.col("turn").cast("string"), "parse")
                     .alias("value"), fx.row_position("dialog_id").alias("pos"))
    path = K.write_lines(lines, "value", "pos")
    return R.read_tsv_field(spark, path, 3)


@register("brackets_to_bio", TOP_SQL + """
SELECT dialog_id, turn, line FROM tagged""")
def q_brackets_to_bio(spark, sf):
    p = fx.top_parses(spark, sf)
    return p.select("dialog_id", "turn", S.brackets_to_bio("parse").alias("line"))


@register("scan_tagged_lines", TOP_SQL + """,
it AS (SELECT split_part(line, ' <=> ', 2) AS intent, string_split(trim(split_part(line, ' <=> ', 1)), ' ') AS items FROM tagged)
SELECT array_to_string(list_transform(items, lambda w: regexp_extract(w, '^(.*):[^:]*$', 1)), ' ') AS tokens,
       array_to_string(list_transform(items, lambda w: regexp_extract(w, ':([^:]*)$', 1)), ' ') AS tags, intent FROM it""")
def q_scan_tagged_lines(spark, sf):
    p = fx.top_parses(spark, sf)
    lines = p.select(S.brackets_to_bio("parse").alias("value"), fx.row_position("dialog_id").alias("pos"))
    path = K.write_lines(lines, "value", "pos")
    r = R.read_tagged_lines(spark, path)
    return r.select(F.array_join("tokens", " ").alias("tokens"), F.array_join("tags", " ").alias("tags"), "intent")


@register("bio_vocab", TOP_SQL + """,
sl AS (SELECT DISTINCT regexp_replace(regexp_extract(w, ':([^:]*)$', 1), '^[BI]-', '') AS slot
       FROM tagged, unnest(string_split(trim(split_part(line, ' <=> ', 1)), ' ')) t(w)
       WHERE regexp_extract(w, ':([^:]*)$', 1) <> 'O'),
v AS (SELECT '[PAD]' AS label, 0 AS g, '' AS s, 0 AS p UNION ALL SELECT 'O', 1, '', 0
      UNION ALL SELECT 'B-' || slot, 2, slot, 0 FROM sl UNION ALL SELECT 'I-' || slot, 2, slot, 1 FROM sl)
SELECT label, CAST(row_number() OVER (ORDER BY g, s, p) - 1 AS INTEGER) AS idx FROM v""")
def q_bio_vocab(spark, sf):
    p = fx.top_parses(spark, sf)
    items = F.split(F.trim(F.split(S.brackets_to_bio("parse"), " <=> ").getItem(0)), " ")
    tags = p.select(F.explode(items).alias("w")).select(F.regexp_extract("w", ":([^:]*)$", 1).alias("t"))
    slots = tags.where(F.col("t") != "O").select(F.regexp_replace("t", "^[BI]-", "").alias("slot"))
    return C.bio_vocab(slots).select("label", F.col("idx").cast("int").alias("idx"))


# -------------------------------------------------------------- corpus merge

@register("cumulative_history", """
WITH u AS (SELECT conv_id, turn, text FROM conversations),
h AS (SELECT conv_id, turn, trim(regexp_replace(string_agg(text, ' [SEP] ' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '\\s+', ' ', 'g')) AS history FROM u)
SELECT conv_id, turn, history FROM h WHERE turn % 2 = 0""")
def q_cumulative_history(spark, sf):
    c = fx.read_table(spark, sf, "conversations")
    h = C.cumulative_history(c, dialog="conv_id", order="turn", text="text")
    return h.where(F.col("turn") % 2 == 0).select("conv_id", "turn", "history")


@register("merge_corpus", I + """,
top AS (SELECT 2 AS source, conv_id * 4294967296 + turn AS pos, text FROM conversations WHERE role = 'user'),
hist AS (SELECT conv_id, turn, trim(regexp_replace(string_agg(text, ' [SEP] ' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '\\s+', ' ', 'g')) AS history FROM conversations)
SELECT 0 AS source, pos, text FROM intents
UNION ALL SELECT 1, item_id, text FROM benchmark
UNION ALL SELECT * FROM top
UNION ALL SELECT 3, conv_id * 4294967296 + turn, history FROM hist WHERE turn % 2 = 0""")
def q_merge_corpus(spark, sf):
    c = fx.read_table(spark, sf, "conversations")
    parts = [
        fx.intent_rows(spark, sf).select(F.lit(0).alias("source"), "pos", "text"),
        fx.read_table(spark, sf, "benchmark").select(F.lit(1).alias("source"), F.col("item_id").alias("pos"), "text"),
        c.where(F.col("role") == "user").select(F.lit(2).alias("source"), (fx.row_position("conv_id"))
                                                .alias("pos"), "text"),
        C.cumulative_history(c, dialog="conv_id", order="turn", text="text").where(F.col("turn") % 2 == 0)
        .select(F.lit(3).alias("source"), (fx.row_position("conv_id")).alias("pos"),
                F.col("history").alias("text")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("source").cast("int").alias("source"), "pos", "text")


@register("sink_json_rows", """SELECT doc_id, lang, source, text FROM documents""")
def q_sink_json_rows(spark, sf):
    d = fx.read_table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    path = K.write_json_rows(d)
    return spark.read.schema(d.schema).json(path)


@register("submission_object", I + """
SELECT dataset, pos, pred, row_number() OVER (PARTITION BY dataset ORDER BY pos, split) AS nth FROM intents""")
def q_submission_object(spark, sf):
    """SK5 as it is handed in: one JSON object ``{dataset: [output, ...]}`` in one file; read back by byte ranges."""
    out = fx.intent_rows(spark, sf).select("dataset", "pos", "split", F.to_json(F.struct("pos", "pred")).alias("output"))
    path = J.write_json_object(out, "dataset", "output", ["pos", "split"], arrays=True)
    back = written(J.read_json_elements(spark, path, level=2, range_bytes=1 << 20), "elements")   # numbered in three branches
    # the place in the file, not the position, gives the number
    back = dense_index(back, ["parent"], "at", "nth", range_block=1 << 22)
    rec = F.from_json("value", "struct<pos:bigint,pred:string>", {"mode": "FAILFAST"})
    return back.select(F.col("parent").alias("dataset"), rec.alias("r"), (F.col("nth") + 1).alias("nth")).select(
        "dataset", "r.pos", "r.pred", "nth")


@register("pack_submission", I + """
SELECT dataset, pos, pred, split AS run, row_number() OVER (PARTITION BY dataset, split ORDER BY pos) AS nth
FROM intents""")
def q_pack_submission(spark, sf):
    """One folder a dataset and run; read back in the order of the files' names and lines."""
    out = fx.intent_rows(spark, sf).select("dataset", "pos", "pred", F.col("split").alias("run"))
    path = K.pack_submission(out, run_col="run")
    back = spark.read.schema("pos bigint, pred string").json(path)
    meta = lambda k: F.regexp_extract(F.col("_metadata.file_path"), rf"{k}=([^/]+)/", 1)
    rows = back.select(meta("dataset").alias("dataset"), meta("run").alias("run"), "pos", "pred",
                       F.col("_metadata.file_name").alias("file"),
                       F.struct(F.col("_metadata.file_block_start").alias("b"),
                                F.monotonically_increasing_id().alias("line")).alias("place"))
    # the place in the files, not the position, gives the number: line in the file, after the lines of files before
    folder = Window.partitionBy("dataset", "run").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("dataset", "run", "file").agg(F.count(F.lit(1)).alias("n"))
    files = files.select("dataset", "run", "file", F.coalesce(F.sum("n").over(folder), F.lit(0)).alias("before"))
    line = F.row_number().over(Window.partitionBy("dataset", "run", "file").orderBy("place"))
    return rows.withColumn("line", line).join(files, ["dataset", "run", "file"]).select(
        "dataset", "run", "pos", "pred", (F.col("before") + F.col("line")).alias("nth"))


@register("score_prediction_files", osql.DST_PREPARED + """,
pt AS (SELECT dialog_id, turn, min(value_ok) AS turn_ok FROM prepared GROUP BY dialog_id, turn),
j AS (SELECT count(*) AS n_turns, round(avg(turn_ok), 6) AS joint_goal_acc FROM pt)
SELECT 'run_a' AS run, * FROM j UNION ALL SELECT 'run_b', * FROM j
UNION ALL SELECT 'run_c', count(*), round(avg(turn_ok), 6) FROM pt WHERE dialog_id % 2 = 0""")
def q_score_prediction_files(spark, sf):
    from ..operators import dst_scoring as dst
    from ..session import fresh_path
    wide = fx.dst_predictions_wide(spark, sf)
    base = fresh_path(spark, "predictions")
    # the third run has other dialogues, so the runs' scores differ and their order is decided
    for run in ("run_a", "run_b", "run_c"):
        rows = wide.where(F.col("guid")[1].cast("bigint") % 2 == 0) if run == "run_c" else wide
        (rows.withColumn("__g", F.floor(F.col("guid")[1].cast("bigint") / 10))
         .groupBy("__g").agg(F.to_json(F.collect_list(F.struct(*[c for c in wide.columns]))).alias("value"))
         .select("value").write.text(f"{base}/{run}"))
    long = read_prediction_files(spark, f"{base}/*/*", fx.DST_SLOTS, dialog_type="bigint", multi_line=False)
    long = long.withColumn("run", F.regexp_extract("_file", r"/(run_[abc])/", 1))
    # one job for all files: the run joins the dialogue key, so state and goals never mix runs
    keyed = long.withColumn("dialog_key", F.concat_ws(":", "run", F.col("dialog_id").cast("string")))
    p = dst.prepare(keyed.drop("_file"), fx.DST_CONFIG, keys=("dialog_key", "turn", "slot"))
    per_turn = p.groupBy("run", "dialog_key", "turn").agg(F.min("value_ok").alias("turn_ok"))
    return (per_turn.groupBy("run").agg(F.count(F.lit(1)).alias("n_turns"),
                                        F.round(F.avg("turn_ok"), 6).alias("joint_goal_acc"))
            .orderBy(F.desc("joint_goal_acc"), "run"))


_REGISTERED = ("banking", "hwu", "clinc")


@register("source_registry", I + f"""
SELECT dataset, split, text, category FROM intents WHERE dataset IN {_REGISTERED} AND split IN ('train', 'test')""")
def q_source_registry(spark, sf):
    """SC12: files in the registered layout, loaded by data set name and split."""
    from ..session import fresh_path
    from ..sources import registry
    root, rows = fresh_path(spark, "registry"), fx.intent_rows(spark, sf)
    out = None
    for name in _REGISTERED:
        for split in ("train", "test"):
            part = rows.where((F.col("dataset") == name) & (F.col("split") == split)).select("text", "category")
            K.write_csv_quoted(part, registry.path_of(root, name, split))
            back = registry.load(spark, name, split, root).select(
                F.lit(name).alias("dataset"), F.lit(split).alias("split"), "text", "category")
            out = back if out is None else out.unionByName(back)
    return out


@register("dataset_config", I + """,
c AS (SELECT DISTINCT dataset, category FROM intents),
s AS (SELECT DISTINCT dataset, split FROM intents),
p AS (SELECT DISTINCT dataset, category, pred FROM intents WHERE pred <> category)
SELECT dataset, 'class_type' AS part, row_number() OVER (PARTITION BY dataset ORDER BY category) - 1 AS idx,
       category AS name, NULL AS variant FROM c
UNION ALL SELECT dataset, 'slot', row_number() OVER (PARTITION BY dataset ORDER BY split) - 1, split, NULL FROM s
UNION ALL SELECT dataset, 'label', row_number() OVER (PARTITION BY dataset, category ORDER BY pred) - 1, category, pred
FROM p""")
def q_dataset_config(spark, sf):
    """SC9: one configuration file a data set (its classes, splits as slots, confused labels as variants), read by name."""
    from ..config import config_tables, read_config_frame
    rows = fx.intent_rows(spark, sf)
    lists = rows.groupBy("dataset").agg(F.array_sort(F.collect_set("category")).alias("class_types"),
                                        F.array_sort(F.collect_set("split")).alias("slots"))
    variants = (rows.where(F.col("pred") != F.col("category")).groupBy("dataset", "category")
                .agg(F.array_sort(F.collect_set("pred")).alias("variants"))
                .groupBy("dataset").agg(F.map_from_entries(F.collect_list(F.struct("category", "variants")))
                                        .alias("label_maps")))
    cfg = lists.join(variants, "dataset", "left").select("dataset", F.to_json(F.struct(
        "class_types", "slots", "label_maps")).alias("value"))
    ct, sl, lv = config_tables(read_config_frame(spark, K.write_named_files(cfg, "dataset", "value"), "dataset"))
    whole = lambda part: [F.lit(part).alias("part"), F.col("idx").cast("bigint").alias("idx"), "name",
                          F.lit(None).cast("string").alias("variant")]
    return (ct.select("dataset", *whole("class_type")).unionByName(sl.select("dataset", *whole("slot")))
            .unionByName(lv.select("dataset", F.lit("label").alias("part"), F.col("ord").cast("bigint").alias("idx"),
                                   F.col("canonical").alias("name"), "variant")))
