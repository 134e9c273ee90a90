"""Tag sequences and span scoring.

``bio_spans`` is a single left-to-right fold (``aggregate``) per row: O(n),
row-local, no explode and no shuffle.  ``span_f1`` aggregates per slot type;
the distinct spans are matched against all types once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

# Tags that close a span.
OUTSIDE_TAGS = ("O", "[PAD]")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bio_spans(tags) -> Column:
    """BIO tags -> ``["key:start-end", ...]`` (end exclusive).

    ``O``/``[PAD]`` close the open span; ``B-k`` closes and opens; ``I-k`` with
    another key closes and then acts as ``O``; other prefixes change nothing.
    """
    t = _c(tags)
    n = F.size(t)
    init = F.struct(F.lit(None).cast("string").alias("cur"), F.lit(0).alias("start"),
                    F.array().cast("array<string>").alias("spans"), F.lit(0).alias("end"))
    items = F.transform(t, lambda x, i: F.struct(x.alias("s"), i.alias("i")))

    def close(acc, i):
        return F.when(acc["cur"].isNotNull(),
                      F.concat(acc["spans"], F.array(F.format_string("%s:%d-%d", acc["cur"], acc["start"], i)))
                      ).otherwise(acc["spans"])

    def step(acc, e):
        s, i = e["s"], e["i"]
        kind = F.substring_index(s, "-", 1)
        key = F.substring(s, F.length(kind) + 2, 1 << 30)
        has_sep = F.instr(s, "-") > 0
        outside = s.isin(*OUTSIDE_TAGS)
        is_b = has_sep & (kind == "B")
        bad_i = has_sep & (kind == "I") & (acc["cur"].isNull() | (key != acc["cur"]))
        end = (i + 1).alias("end")
        return (F.when(outside | bad_i,
                       F.struct(F.lit(None).cast("string").alias("cur"), acc["start"].alias("start"),
                                close(acc, i).alias("spans"), end))
                .when(is_b, F.struct(key.alias("cur"), i.alias("start"), close(acc, i).alias("spans"), end))
                .otherwise(F.struct(acc["cur"], acc["start"], acc["spans"], end)))

    return F.aggregate(items, init, step, lambda acc: close(acc, acc["end"]))


def span_type(span) -> Column:
    return F.substring_index(_c(span), ":", 1)


def gold_types(gold: DataFrame, true_col: str = "true_spans") -> DataFrame:
    """Distinct slot types of the gold spans (``span.split(':')[0]``)."""
    return gold.select(F.explode(true_col).alias("s")).select(span_type("s").alias("slot_type")).distinct()


def contained_types(spans: DataFrame, types: DataFrame, block_types: int = 50_000, bucket_spans: int = 100_000) -> DataFrame:
    """(s, slot_type) of the distinct spans and every type that occurs in them as a substring.

    A multi-pattern automaton finds all types of a block in one pass over a span.  Types go to hash blocks of about
    ``block_types``, distinct spans to buckets of about ``bucket_spans``, and one task handles a block and a bucket: its
    size does not grow with either list.
    """
    import pandas as pd

    spans, types = spans.select("s").distinct(), types.select("slot_type").distinct()
    blocks, buckets = -(-types.count() // block_types) or 1, -(-spans.count() // bucket_spans) or 1
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    own = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    left = types.select("slot_type", own("slot_type", blocks).alias("block"), each(buckets).alias("bucket"))
    right = spans.select("s", own("s", buckets).alias("bucket"), each(blocks).alias("block"))

    def found(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        import ahocorasick
        names = left["slot_type"].tolist()
        automaton = ahocorasick.Automaton()
        for t in names:
            if t:
                automaton.add_word(t, t)
        hits = [(s, "") for s in right["s"] if "" in names]         # the empty type is in every span
        if len(automaton) and len(right):
            automaton.make_automaton()
            hits += [(s, t) for s in right["s"] for t in {t for _, t in automaton.iter(s)}]
        return pd.DataFrame(hits, columns=["s", "slot_type"])

    key = ["block", "bucket"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(found, "s string, slot_type string")


def span_type_rows(pairs: DataFrame, types: list[str] | None = None, exact: bool = False,
                   pred_col: str = "pred_spans", true_col: str = "true_spans") -> DataFrame:
    """Per example and gold slot type, the spans selected by the type test.

    ``pairs`` is the full outer alignment of predictions and gold on position
    (``has_pred``/``has_true`` flag which side exists); its other columns tell
    the rows apart.  By default the type is matched as a *substring* of the
    whole span string (Q1): the distinct spans are matched once, and the rows
    join what their spans hold.  A list of any length takes the same way.
    """
    pairs = written(pairs, "span-pairs")        # types, distinct spans and rows come from it
    if types is None:
        types_df = gold_types(pairs.where("has_true"), true_col)
    else:
        types_df = pairs.sparkSession.createDataFrame([(t,) for t in types], "slot_type string")
    keys = [c for c in pairs.columns if c not in (pred_col, true_col)]

    def side(col, tag):
        return pairs.select(*keys, F.posexplode(col).alias("i", "s"), F.lit(tag).alias("side"))
    spans = side(pred_col, "p").unionByName(side(true_col, "l"))
    own = spans.select("s").distinct()
    own = (own.select("s", span_type("s").alias("slot_type")).join(types_df, "slot_type", "left_semi") if exact
           else contained_types(own, types_df))
    grouped = spans.join(own, "s").groupBy(*keys, "slot_type").agg(
        F.sort_array(F.collect_list(F.when(F.col("side") == "p", F.struct("i", "s")))).alias("p"),
        F.sort_array(F.collect_list(F.when(F.col("side") == "l", F.struct("i", "s")))).alias("l"))
    return grouped.select("has_pred", "has_true", "slot_type", F.col("p.s").alias("p"), F.col("l.s").alias("l"))


def align_spans(pred: DataFrame, gold: DataFrame, keys=("pos",)) -> DataFrame:
    """Full outer alignment by position; counts before the zip need both sides (A3)."""
    keys = list(keys)
    return (pred.select(*keys, F.col("spans").alias("pred_spans"), F.lit(True).alias("has_pred"))
            .join(gold.select(*keys, F.col("spans").alias("true_spans"), F.lit(True).alias("has_true")),
                  keys, "full")
            .select(*keys, "pred_spans", "true_spans",
                    F.coalesce("has_pred", F.lit(False)).alias("has_pred"),
                    F.coalesce("has_true", F.lit(False)).alias("has_true")))


def span_f1_per_type(pairs: DataFrame, types: list[str] | None = None, exact: bool = False) -> DataFrame:
    """A3 per slot type: TP (proposed and ordered-list equal), proposed, to-recall, P, R, F1 (+1e-5 each)."""
    x = span_type_rows(pairs, types, exact)
    proposed = F.col("has_pred") & (F.size("p") > 0)
    labelled = F.col("has_true") & (F.size("l") > 0)
    correct = F.col("has_pred") & F.col("has_true") & (F.col("p") == F.col("l"))
    agg = x.groupBy("slot_type").agg(
        F.sum((proposed & correct).cast("long")).alias("tp"),
        F.sum(proposed.cast("long")).alias("n_pred"),
        F.sum(labelled.cast("long")).alias("n_true"))
    p = F.col("tp") / (F.lit(1e-5) + F.col("n_pred"))
    r = F.col("tp") / (F.lit(1e-5) + F.col("n_true"))
    return (agg.withColumn("precision", p).withColumn("recall", r)
            .withColumn("f1", 2 * F.col("precision") * F.col("recall")
                        / (F.lit(1e-5) + F.col("precision") + F.col("recall"))))


def span_f1_macro(per_type: DataFrame) -> DataFrame:
    """A3: unweighted mean of per-type F1 (NULL when there are no gold types, Q27)."""
    return per_type.agg(F.count(F.lit(1)).alias("n_types"), F.round(F.avg("f1"), 6).alias("macro_f1"))


def word_bio(words, word_slot) -> Column:
    """Per word ``B-``/``I-`` by comparing with the previous word's slot; ``O`` resets.

    ``word_slot`` is an array aligned with ``words`` (NULL = no slot).
    """
    ws = _c(word_slot)
    prev = F.slice(F.concat(F.array(F.lit(None).cast("string")), ws), 1, F.size(ws))
    return F.zip_with(ws, prev, lambda s, p: F.when(s.isNull(), F.lit("O"))
                      .when(p.isNotNull() & (p == s), F.concat(F.lit("I-"), s))
                      .otherwise(F.concat(F.lit("B-"), s)))


def brackets_to_bio(utterance) -> Column:
    """``[IN:X w [SL:Y w ] ]`` -> ``w:TAG w:TAG <=> IN_X`` (tags are the names of the open brackets joined by ``_``).

    By position: the first opener is the root and names the intent; every other
    bracket changes the level by one (never below 0).  Around a word of level n
    stand, for each level 1 .. n, the last opener of that level before it.  A
    word begins a span (``B-``) if an opener came after the last word that had
    a level; words of level 0 are ``O``.  NULL without a root.
    """
    turn = lambda t: F.when(t.startswith("["), 1).when(t.startswith("]"), -1).otherwise(0)
    marks = F.transform(F.split(_c(utterance), " "), lambda t, i: F.struct(t.alias("t"), i.alias("at"), turn(t).alias("turn")))
    root = F.array_position(F.transform(marks, lambda m: m["turn"]), 1) - 1
    start = F.struct(F.lit(0).alias("level"), F.array().cast("array<struct<t:string,at:int,turn:int,level:int>>").alias("seen"))

    def leveled(acc, m):
        level = F.greatest(acc["level"] + F.when(m["at"] == root, 0).otherwise(m["turn"]), F.lit(0))
        return F.struct(level.alias("level"), F.concat(acc["seen"], F.array(F.struct(
            m["t"].alias("t"), m["at"].alias("at"), m["turn"].alias("turn"), level.alias("level")))).alias("seen"))

    def name(t, *kinds):
        for k in kinds:
            t = F.replace(t, F.lit(f"{k}:"), F.lit(f"{k}_"))
        return F.regexp_replace(t, r"^\[+|\[+$", "")

    def tagged(words, openers, w):
        before = F.filter(openers, lambda o: o["at"] < w["at"])
        path = F.array_join(F.transform(F.sequence(F.lit(1), w["level"]), lambda k: name(F.element_at(
            F.filter(before, lambda o: o["level"] == k), -1)["t"], "IN", "SL")), "_")
        last = F.array_max(F.transform(F.filter(words, lambda x: (x["at"] < w["at"]) & (x["level"] > 0)), lambda x: x["at"]))
        begins = F.coalesce(last, F.lit(-1)) < F.array_max(F.transform(before, lambda o: o["at"]))
        return F.when(w["level"] == 0, F.lit("O")).otherwise(F.concat(F.when(begins, F.lit("B-")).otherwise(F.lit("I-")), path))

    def line(s):
        words = F.filter(s["seen"], lambda m: m["turn"] == 0)
        openers = F.filter(s["seen"], lambda m: (m["turn"] == 1) & (m["at"] != s["root"]))
        # one-element arrays bind the two lists once for the lambdas inside
        return F.transform(F.array(F.struct(words.alias("w"), openers.alias("o"))), lambda b: F.concat(
            F.array_join(F.transform(b["w"], lambda w: F.concat(w["t"], F.lit(":"), tagged(b["w"], b["o"], w))), " "),
            F.lit(" <=> "), name(F.get(s["seen"], s["root"])["t"], "IN")))[0]

    parse = F.struct(F.aggregate(marks, start, leveled, lambda acc: acc["seen"]).alias("seen"), root.cast("int").alias("root"))
    return F.when(root >= 0, F.transform(F.array(parse), line)[0])
