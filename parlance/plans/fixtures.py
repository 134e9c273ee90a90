"""Inputs derived from the driver tables, identically computable in DuckDB.

The driver's tables hold prose, vectors and events but no dialogue labels, so
every registered query derives its labelled input from them with md5
arithmetic (``oracle.py`` spells out the same recipe in DuckDB SQL).  All
derivations are row-local expressions over whole tables: their work grows
with the data and they add no shuffle beyond the window that numbers turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DatasetConfig
from ..functions.normalize import normalise_text
from ..functions.text import word_tokens
from ..session import read_table

# The multi-domain class types (order = class index).
DST_CLASS_TYPES = ("none", "dontcare", "copy_value", "true", "false", "refer", "inform")
# The five slots used by the derived prediction records.
DST_SLOTS = ("hotel-area", "hotel-name", "hotel-stars", "taxi-leaveAt", "restaurant-food")
# A small label map and the value pool drawn from it.
DST_LABEL_MAPS = {"centre": ["center", "downtown"], "north": ["northern", "northside"],
                  "cheap": ["inexpensive", "cheaply"]}
DST_POOL = ("centre", "center", "downtown", "north", "northern", "cheap", "inexpensive")

DST_CONFIG = DatasetConfig(DST_CLASS_TYPES, DST_SLOTS, DST_LABEL_MAPS)


def md5_of(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))


def hexint(h: Column, start: int, length: int) -> Column:
    """Integer value of ``length`` hex digits of ``h`` starting at 1-based ``start``."""
    return F.conv(F.substring(h, start, length), 16, 10).cast("bigint")


def digit(h: Column, i: int) -> Column:
    return F.substring(h, i, 1)


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User utterances numbered 0.. per conversation (dialog_id, turn, text, toks)."""
    conv = read_table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    # the number of user turns before each one, in blocks of positions: a long conversation is numbered by many tasks
    from ..operators.windows import running_sum_before
    conv = running_sum_before(conv.select("conv_id", "turn", "text", F.lit(1).alias("one")), ["conv_id"], "turn", "one", "nth")
    return conv.select(F.col("conv_id").alias("dialog_id"), F.col("nth").cast("bigint").alias("turn"),
                       "text", word_tokens(F.lower("text")).alias("toks"))


def row_position(dialog: str, turn: str = "turn") -> Column:
    """One number for (dialogue, turn) in file order; turns are 32-bit numbers, so pairs never share one."""
    return F.col(dialog).cast("bigint") * F.lit(1 << 32) + F.col(turn)


def _win(toks: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(toks, start + 1, length), " ")


def _recipe(x: DataFrame) -> DataFrame:
    """Prediction-record fields per (turn, slot) row (same recipe as ``oracle.DST_LONG``).

    The md5 and the integers cut from it are materialised in their own
    projection (an expensive expression used many times is not inlined by the
    optimizer), so each row hashes once.
    """
    h = md5_of("dst", F.col("dialog_id"), F.col("turn"), F.col("si"))
    x = x.withColumn("h", h)
    ints = {f"x{i}_{n}": hexint(F.col("h"), i, n) for i, n in
            ((2, 4), (7, 4), (11, 4), (15, 1), (18, 2), (21, 4), (25, 2), (30, 2))}
    digs = {f"g{i}": digit(F.col("h"), i) for i in (1, 6, 16, 17, 20, 27, 28, 29, 32)}
    x = x.select("dialog_id", "turn", "slot", "toks",
                 F.greatest(F.size("toks"), F.lit(1)).alias("nn"),
                 *[c.alias(k) for k, c in ints.items()], *[c.alias(k) for k, c in digs.items()])
    c = F.col
    toks = c("toks")
    pool = F.array(*[F.lit(v) for v in DST_POOL])
    x = x.select("*", (c("x11_4") % c("nn")).alias("a"), (1 + c("x15_1") % 2).alias("ln"),
                 F.when(c("g1") < "9", F.lit(0).cast("bigint")).otherwise(c("x2_4") % 7).alias("gt_class"))
    x = x.select("*", F.when(c("g6") < "b", c("gt_class")).otherwise(c("x7_4") % 7).alias("pd_class"),
                 (F.when(c("gt_class") == 0, F.when(c("g16") < "8", F.lit("none")).otherwise(_win(toks, c("a"), c("ln"))))
                  .when(c("gt_class") == 1, F.lit("dontcare"))
                  .when(c("gt_class") == 3, F.lit("true"))
                  .when(c("gt_class") == 4, F.lit("false"))
                  .when(c("gt_class") == 2, _win(toks, c("a"), c("ln")))
                  .otherwise(F.when(c("g17") < "8", _win(toks, c("a"), c("ln")))
                             .otherwise(F.element_at(pool, (c("x18_2") % 7 + 1).cast("int"))))).alias("gt_value"))
    x = x.select("*",
                 (F.when(c("g20") < "6", c("gt_value"))
                  .when(c("g20") < "a", _win(toks, c("a"), c("ln") + 1))
                  .when(c("g20") < "d", _win(toks, c("x21_4") % c("nn"), F.lit(1)))
                  .otherwise(F.element_at(pool, (c("x25_2") % 7 + 1).cast("int")))).alias("base"),
                 F.when(c("g29") < "c", c("a")).otherwise(c("x30_2") % c("nn")).alias("start_pd"),
                 (c("x30_2") % 6).alias("refer_id_"))
    base = c("base")
    pd_text = (F.when(c("pd_class") == 5,
                      F.when(c("g27") < "5", F.concat(F.lit("§§ "), base))
                      .when(c("g27") < "a", F.concat(F.lit("§§"), base))
                      .when(c("g27") < "c", F.lit("none"))
                      .otherwise(base))
               .when(c("pd_class") == 6,
                     F.when(c("g27") < "8", F.concat(F.lit("§§ "), base)).otherwise(F.concat(F.lit("§§"), base)))
               .when(c("pd_class") == 2,
                     F.when(c("g28") == "f", F.concat(F.lit("Ġ"), F.replace(base, F.lit(" "), F.lit("Ġ"))))
                     .otherwise(base))
               .otherwise(base))
    return x.select(
        F.lit("test").alias("set_type"), "dialog_id", "turn", "slot",
        c("gt_class").alias("class_label_id"), c("pd_class").alias("class_prediction"),
        c("a").alias("start_pos"), c("start_pd").alias("start_prediction"),
        (c("a") + c("ln") - 1).alias("end_pos"), (c("start_pd") + c("ln") - 1).alias("end_prediction"),
        c("refer_id_").alias("refer_id"),
        F.when(c("g32") < "b", c("refer_id_")).otherwise((c("refer_id_") + 1) % 6).alias("refer_prediction"),
        c("gt_value").alias("slot_groundtruth"), pd_text.alias("slot_prediction"))


PRED_FIELDS = ("class_label_id", "class_prediction", "start_pos", "start_prediction", "end_pos",
               "end_prediction", "refer_id", "refer_prediction", "slot_groundtruth", "slot_prediction")


def dst_predictions_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long prediction table (set_type, dialog_id, turn, slot, fields...) for every user turn x slot."""
    t = user_turns(spark, sf_dir)
    x = t.select("dialog_id", "turn", "toks",
                 F.posexplode(F.array(*[F.lit(s) for s in DST_SLOTS])).alias("si", "slot"))
    return _recipe(x)


def dst_predictions_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide per-turn records (``guid`` + ``<field>_<slot>``), the state decoder's JSON layout."""
    long = dst_predictions_long(spark, sf_dir)
    wide = (long.groupBy("dialog_id", "turn").pivot("slot", list(DST_SLOTS))
            .agg(*[F.first(k).alias(k) for k in PRED_FIELDS]))
    ren = [F.col(f"`{s}_{k}`").alias(f"{k}_{s}") for s in DST_SLOTS for k in PRED_FIELDS]
    guid = F.array(F.lit("test"), F.col("dialog_id").cast("string"), F.col("turn").cast("string"))
    return wide.select(guid.alias("guid"), *ren)


# Slot names of the derived tag sequences ('time' is a substring of 'leave_time').
TAG_SLOTS = ("time", "leave_time", "area")


def _tag_of(h: Column) -> Column:
    d = F.substring(h, 1, 1)
    name = F.element_at(F.array(*[F.lit(s) for s in TAG_SLOTS]), (hexint(h, 2, 2) % 3 + 1).cast("int"))
    return (F.when(d < "7", F.lit("O"))
            .when(d < "a", F.concat(F.lit("B-"), name))
            .when(d < "d", F.concat(F.lit("I-"), name))
            .when(d == "d", F.lit("[PAD]"))
            .when(d == "e", F.concat(F.lit("X-"), name))
            .otherwise(F.concat(F.lit("I-"), name)))


def tag_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and predicted BIO tags per user turn, one tag per word token (dialog_id, turn, toks, gold, pred)."""
    t = user_turns(spark, sf_dir)
    n = F.size("toks")
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    t = t.select("dialog_id", "turn", "toks",
                 F.transform(idx, lambda i: md5_of("bg", F.col("dialog_id"), F.col("turn"), i)).alias("gh"),
                 F.transform(idx, lambda i: md5_of("bp", F.col("dialog_id"), F.col("turn"), i)).alias("ph"))
    t = t.select("dialog_id", "turn", "toks", "ph", F.transform("gh", _tag_of).alias("gold"))
    return t.select("dialog_id", "turn", "toks", "gold",
                    # zip_with evaluates ``gold`` once (a lambda reference would be inlined per element)
                    F.zip_with("gold", "ph", lambda g, h: F.when(F.substring(h, 1, 1) < "b", g)
                               .otherwise(_tag_of(h))).alias("pred"),
                    md5_of("bx", F.col("dialog_id"), F.col("turn")).alias("rh"))


# The seven benchmark dataset keys (assignment of derived rows).
BENCH_DATASETS = ("hwu", "clinc", "banking", "restaurant8k", "dstc8", "multiwoz", "top")
N_SOURCES = 20


def intent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as labelled utterances: pos, text, category (= source), lang, split, pred, dataset."""
    d = read_table(spark, sf_dir, "documents")
    hs = md5_of("split", F.col("doc_id"))
    hp = md5_of("ip", F.col("doc_id"))
    hd = md5_of("ds", F.col("doc_id"))
    names = F.array(*[F.lit(x) for x in BENCH_DATASETS])
    return d.select(
        F.col("doc_id").alias("pos"), "text", F.col("source").alias("category"), "lang",
        F.when(F.substring(hs, 1, 1) < "c", F.lit("train")).otherwise(F.lit("test")).alias("split"),
        F.when(F.substring(hp, 1, 1) < "b", F.col("source"))
        .otherwise(F.concat(F.lit("src"), (hexint(hp, 2, 4) % N_SOURCES).cast("string"))).alias("pred"),
        F.element_at(names, (hexint(hd, 1, 4) % 7 + 1).cast("int")).alias("dataset"))


def run_predictions(intents: DataFrame, runs: int = 5) -> DataFrame:
    """Five prediction runs per row: (pos, run, category, dataset, pred)."""
    x = intents.select("pos", "category", "dataset", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    hp = md5_of("ir", F.col("run"), F.col("pos"))
    return x.withColumn("pred", F.when(F.substring(hp, 1, 1) < "a", F.col("category"))
                        .otherwise(F.concat(F.lit("src"), (hexint(hp, 2, 4) % N_SOURCES).cast("string"))))


# Pieces of the derived time/text phrases.
PHRASE_PREP = ("at", "from", "by", "until", "after", "around")
PHRASE_SEP = ("", ":", ".", " ", ";")
PHRASE_MIN = ("", "00", "15", "30", "45", "5")
PHRASE_SUFFIX = ("", "pm", "p.m.", "am", " pm", "a.m.", " p.m")
PHRASE_TAIL = ("", "three star", "four-star hotel", "don't", "guesthouse", "b & b", "b&b.", "archaelogy",
               "zero star.", "bed & breakfast")
LABEL_SLOTS = ("taxi-leaveAt", "train-arriveBy", "restaurant-book_time", "hotel-type", "hotel-parking",
               "hotel-internet", "attraction-name", "hotel-area")
LABEL_VALUES = ("", "not mentioned", "yes", "free", "no", "hotel", "guest house", "guesthouse")


def _pick(options, h: Column, start: int) -> Column:
    arr = F.array(*[F.lit(o) for o in options])
    return F.element_at(arr, (hexint(h, start, 2) % len(options) + 1).cast("int"))


def time_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, phrase, slot, value): each whole utterance (lower-cased) with time/star/b&b expressions appended."""
    c = read_table(spark, sf_dir, "conversations")
    h = md5_of("tp", F.col("conv_id"), F.col("turn"))
    hour = (hexint(h, 1, 2) % 25).cast("string")
    phrase = F.concat(F.lower("text"), F.lit(" "), _pick(PHRASE_PREP, h, 3), F.lit(" "),
                      hour, _pick(PHRASE_SEP, h, 5), _pick(PHRASE_MIN, h, 7), _pick(PHRASE_SUFFIX, h, 9),
                      F.lit(" "), _pick(PHRASE_TAIL, h, 11))
    value = F.when(F.substring(h, 13, 1) < "8", _pick(LABEL_VALUES, h, 14)).otherwise(
        F.concat(hour, _pick(PHRASE_SEP, h, 5), _pick(PHRASE_MIN, h, 7), _pick(PHRASE_SUFFIX, h, 9)))
    return c.select("conv_id", "turn", phrase.alias("phrase"), _pick(LABEL_SLOTS, h, 16).alias("slot"),
                    value.alias("value"))


# Belief-state slots of the derived multi-domain dialogues (domain, category, name).
MW_SLOTS = (("hotel", "semi", "area"), ("hotel", "semi", "name"), ("hotel", "book", "people"),
            ("hotel", "book", "stay"), ("hotel", "semi", "parking"), ("taxi", "semi", "leaveAt"),
            ("restaurant", "semi", "food"), ("restaurant", "book", "people"))
MW_POOL = ("centre", "north", "cheap", "2", "3", "guesthouse")
MW_SPECIAL = ("5pm", "yes", "free", "no", "hotel", "guest house")
ACT_PAIRS = (("Hotel", "Area"), ("Hotel", "Name"), ("Hotel", "People"), ("Hotel", "Stay"), ("Taxi", "Leave"),
             ("Restaurant", "Food"), ("Restaurant", "People"), ("Booking", "People"), ("Booking", "Stay"),
             ("Train", "Day"), ("Hotel", "none"), ("Restaurant", "Price"))
ACT_TYPES = ("Inform", "Request", "Recommend", "Select", "Book", "NoOffer")


def mw_slot_name(domain: str, category: str, name: str) -> str:
    return f"{domain}-book_{name}" if category == "book" else f"{domain}-{name}"


def mw_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dialog_id, utt_idx, text, is_sys, toks): conversations as dialogue logs."""
    c = read_table(spark, sf_dir, "conversations")
    flip = F.substring(md5_of("fl", F.col("conv_id"), F.col("turn")), 1, 2) < "08"   # a few misordered logs
    return c.select(F.col("conv_id").alias("dialog_id"), F.col("turn").alias("utt_idx"), "text",
                    ((F.col("role") != "user") != flip).alias("is_sys"),
                    word_tokens(normalise_text(F.lower("text"))).alias("toks"))


def mw_metadata(u: DataFrame) -> DataFrame:
    """Belief state of every system utterance of ``u``: (dialog_id, utt_idx, domain, category, name, value, booked).

    The state is cumulative: a slot changes at a system turn with probability
    ~3/8 and otherwise keeps its previous value (empty = not mentioned).
    """
    from ..operators.windows import carry_forward
    # the two previous utterances of each one, by position (positions are contiguous): every utterance is
    # emitted under its own position and the next two, and one grouped shuffle collects them -- no
    # dialogue-wide window
    copies = F.array(*[F.struct((F.col("utt_idx") + k).alias("p"), F.lit(k).alias("k")) for k in range(3)])
    e = u.select("dialog_id", "is_sys", "toks", F.explode(copies).alias("c"))
    g = e.groupBy("dialog_id", F.col("c.p").alias("utt_idx")).agg(
        F.max(F.when(F.col("c.k") == 0, F.col("is_sys"))).alias("is_sys"),
        F.first(F.when(F.col("c.k") == 0, F.col("toks")), ignorenulls=True).alias("toks"),
        F.first(F.when(F.col("c.k") == 1, F.col("toks")), ignorenulls=True).alias("prev_toks"),
        F.first(F.when(F.col("c.k") == 2, F.col("toks")), ignorenulls=True).alias("prev2_toks"))
    u = g.where(F.col("is_sys"))
    slots = F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(c).alias("category"), F.lit(n).alias("name"))
                      for d, c, n in MW_SLOTS])
    x = u.select("dialog_id", "utt_idx", "toks", "prev_toks", "prev2_toks", F.posexplode(slots).alias("si", "s"))
    x = x.select("dialog_id", "utt_idx", "toks", "prev_toks", "prev2_toks", "si", "s.*",
                 md5_of("mw", F.col("dialog_id"), F.col("utt_idx"), F.col("si")).alias("h"))
    h = F.col("h")
    pt = F.coalesce(F.col("prev_toks"), F.array().cast("array<string>"))
    d2 = F.substring(h, 2, 1)
    new = (F.when(d2 < "6", _win(pt, hexint(h, 4, 2) % F.greatest(F.size(pt), F.lit(1)), 1 + hexint(h, 6, 1) % 2))
           .when(d2 < "9", _win(F.coalesce(F.col("prev2_toks"), F.array().cast("array<string>")), F.lit(0), F.lit(1)))
           .when(d2 < "b", F.lit("dontcare"))
           .when(d2 < "c", F.lit(""))
           .when(d2 < "e", F.element_at(F.array(*[F.lit(v) for v in MW_POOL]), (hexint(h, 7, 2) % 6 + 1).cast("int")))
           .otherwise(F.element_at(F.array(*[F.lit(v) for v in MW_SPECIAL]), (hexint(h, 7, 2) % 6 + 1).cast("int"))))
    x = x.withColumn("upd", F.when(F.substring(h, 1, 1) < "6", new))
    x = x.withColumn("booked_v", F.when((F.col("category") == "book") & (F.substring(h, 3, 1) >= "d"),
                                        _win(F.col("toks"), hexint(h, 9, 2) % F.greatest(F.size("toks"), F.lit(1)),
                                             F.lit(1))))
    s = carry_forward(x, ["dialog_id", "si"], "utt_idx", "upd", "value", default="")
    return s.select("dialog_id", "utt_idx", "si", "domain", "category", "name", "value", "booked_v")


def mw_acts(u: DataFrame) -> DataFrame:
    """Dialogue acts per system utterance of ``u``: (dialog_id, turn = 1-based system turn, pos, act, slot, value).

    Some turns carry no annotation object at all (``annotated`` false).
    """
    from ..operators.windows import running_sum_before
    # 1-based number of each system utterance in its dialogue: how many come before, without a dialogue-wide window
    u = u.where(F.col("is_sys")).withColumn("one", F.lit(1))
    u = running_sum_before(u, ["dialog_id"], "utt_idx", "one", "turn0").withColumn("turn", F.col("turn0") + 1)
    x = u.select("dialog_id", "turn", "toks", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pos"))
    h = md5_of("ma", F.col("dialog_id"), F.col("turn"), F.col("pos"))
    h0 = md5_of("mt", F.col("dialog_id"), F.col("turn"))
    pick = lambda opts, i: F.element_at(F.array(*[F.lit(o) for o in opts]),
                                        (hexint(h, i, 2) % len(opts) + 1).cast("int"))
    dv = F.substring(h, 9, 1)
    value = (F.when(dv < "4", _win(F.col("toks"), F.lit(0), F.lit(1)))
             .when(dv < "8", _win(F.col("toks"), hexint(h, 10, 2) % F.greatest(F.size("toks"), F.lit(1)), F.lit(1)))
             .when(dv < "a", F.lit("?")).when(dv < "b", F.lit("None"))
             .when(dv < "d", F.translate(_win(F.col("toks"), hexint(h, 10, 2) % F.greatest(F.size("toks"), F.lit(1)),
                                              F.lit(1)), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
             .otherwise(F.element_at(F.array(*[F.lit(v) for v in MW_POOL]), (hexint(h, 12, 2) % 6 + 1).cast("int"))))
    return x.select("dialog_id", "turn", "pos",
                    F.concat(pick([d for d, _ in ACT_PAIRS], 1), F.lit("-"), pick(ACT_TYPES, 3)).alias("act"),
                    pick([sl for _, sl in ACT_PAIRS], 1).alias("slot"), F.concat(F.lit(" "), value).alias("value"),
                    (F.substring(h0, 1, 1) != "f").alias("annotated"))


# A small label map for the derived dialogues.
MW_LABEL_MAPS = {"centre": ["center", "downtown"], "north": ["northern"], "cheap": ["inexpensive"],
                 "guest house": ["guesthouse", "guest houses"]}
MW_SLOT_NAMES = tuple(mw_slot_name(*s) for s in MW_SLOTS)


# Intents and slot labels of the derived bracketed parses.
TOP_INTENTS = ("GET_EVENT", "GET_DIRECTIONS", "GET_INFO_TRAFFIC", "UNSUPPORTED")
TOP_SLOTS = ("LOCATION", "DATE_TIME", "IN:GET_LOCATION", "DESTINATION")


def top_parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bracketed parses over every user utterance: (dialog_id, turn, parse)."""
    t = user_turns(spark, sf_dir)
    hi = md5_of("ti", F.col("dialog_id"), F.col("turn"))
    intent = F.element_at(F.array(*[F.lit(x) for x in TOP_INTENTS]), (hexint(hi, 1, 2) % 4 + 1).cast("int"))
    slot_names = F.array(*[F.lit(x) for x in TOP_SLOTS])

    def word(w, i):
        h = md5_of("tw", F.col("dialog_id"), F.col("turn"), i)
        d = F.substring(h, 1, 1)
        opener = F.concat(F.lit("[SL:"), F.element_at(slot_names, (hexint(h, 2, 2) % 4 + 1).cast("int")), F.lit(" "))
        clean = F.regexp_replace(w, r"[\t ]", "_")
        return F.concat(F.when(d < "3", opener).otherwise(F.lit("")), clean,
                        F.when((d >= "3") & (d < "6"), F.lit(" ]")).otherwise(F.lit("")))

    parse = F.concat(F.lit("[IN:"), intent, F.lit(" "), F.array_join(F.transform("toks", word), " "), F.lit(" ]"))
    return t.select("dialog_id", "turn", parse.alias("parse"))


# Requested-slot contexts and label slots of the derived slot examples.
SLOT_CONTEXTS = ((), ("time",), ("date", "time"))
SLOT_LABELS = ("time", "date", "people", "area")


def slot_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restaurant-style slot examples over user utterances (pos, userInput, context, labels)."""
    u = read_table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    h = md5_of("se", F.col("conv_id"), F.col("turn"))
    n = F.greatest(F.length("text"), F.lit(1))
    ctx_i = (hexint(h, 1, 2) % 4).cast("int")
    ctx = (F.when(ctx_i == 1, F.array(F.lit("time"))).when(ctx_i == 2, F.array(F.lit("date"), F.lit("time")))
           .when(ctx_i == 3, F.array().cast("array<string>")))

    def label(k):
        s = (hexint(h, 3 + 6 * k, 4) % n).cast("int")
        e = s + 1 + (hexint(h, 7 + 6 * k, 2) % 20).cast("int")
        d = F.substring(h, 20 + k, 1)
        return F.struct(F.element_at(F.array(*[F.lit(x) for x in SLOT_LABELS]), (hexint(h, 22 + k, 1) % 4 + 1).cast("int"))
                        .alias("slot"),
                        F.struct(F.when(d < "e", s).alias("startIndex"), F.when(d < "c", e).alias("endIndex"))
                        .alias("valueSpan"))

    n_lab = (hexint(h, 25, 1) % 3).cast("int")
    labels = F.slice(F.array(label(0), label(1)), 1, n_lab)
    return u.select(row_position("conv_id").alias("pos"),
                    F.struct(F.col("text")).alias("userInput"),
                    F.when(ctx_i > 0, F.struct(ctx.alias("requestedSlots"))).alias("context"),
                    labels.alias("labels"))
