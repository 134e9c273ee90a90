"""Whole training rows (D12) of labelled dialogue turns: ids, mask, segments and the label arrays of every slot.

A row has at most ``max_len`` positions, so a turn needs only the newest
earlier turns that fit what its own text leaves.  Which ones these are follows
from running sums of piece counts (block-split, no dialogue-wide window): turn u
of pieces ``[S(u), E(u))`` on its dialogue's line of pieces shows in turn t if
``E(u) <= S(t) < E(u) + budget``.  Cutting that line into stretches of
``budget`` pieces makes it an equi-join of two stretches; only then are ids
gathered, at most ``budget`` turns a row whatever the length of the dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import pad_to_length, truncate_triple
from ..functions.values import delex
from ..session import written
from . import pieces as P
from .features import TOKEN_CORRECTION, first_span_class, uniform
from .windows import DEFAULT_BLOCK, running_sum_before


def delexicalise_system(turns: DataFrame, acts: DataFrame, slots: tuple[str, ...]) -> DataFrame:
    """``turns`` with every value that the system informs in the turn (for a slot of the list) as ``[UNK]`` in its words."""
    order = F.array_position(F.array(*map(F.lit, slots)), F.col("slot"))
    told = (acts.where(F.col("slot").isin(*slots)).groupBy("dialog_id", "turn")
            .agg(F.sort_array(F.collect_list(F.struct(order.alias("k"), "value"))).alias("__told")))
    x = turns.join(told, ["dialog_id", "turn"], "left")
    return x.withColumn("sys_toks", F.when(F.col("__told").isNotNull(), delex("sys_toks", F.col("__told.value")))
                        .otherwise(F.col("sys_toks"))).drop("__told")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def encoded_turns(turns: DataFrame, labels: DataFrame, vocab: DataFrame, slots: tuple[str, ...], swap: bool) -> DataFrame:
    """One row a turn: ids of both texts (``a``, ``b``), ``own`` = a + b, the slots' labels in slot order, and ``spans``
    (slot place, from, to in pieces of the user's text) of the labelled slots."""
    words = turns.select("dialog_id", "turn", F.concat("sys_toks", "usr_toks").alias("w"))
    enc = P.subword_encode(words, "w", vocab, ["dialog_id", "turn"]).join(
        turns.select("dialog_id", "turn", F.size("sys_toks").alias("n_sys")), ["dialog_id", "turn"])
    n = F.col("n_pieces")
    enc = enc.withColumn("sys_pieces", _sum(F.slice(n, 1, F.col("n_sys"))))
    enc = enc.withColumn("usr_n", F.slice(n, F.col("n_sys") + 1, F.greatest(F.size(n) - F.col("n_sys"), F.lit(0))))
    enc = enc.withColumn("sys_ids", F.slice("ids", 1, F.col("sys_pieces"))).withColumn(
        "usr_ids", F.slice("ids", F.col("sys_pieces") + 1, F.size("ids") - F.col("sys_pieces")))
    place = F.array_position(F.array(*map(F.lit, slots)), F.col("slot")).cast("int") - 1
    one = F.struct(place.alias("k"), "class_label", "refer_label", "informed_value", "inform_slot", "diag_state",
                   "seen_value", "label_start", "label_end")
    per_turn = labels.groupBy("dialog_id", "turn").agg(F.sort_array(F.collect_list(one)).alias("slots"))
    x = enc.join(per_turn, ["dialog_id", "turn"])
    pieces_to = lambda word: _sum(F.slice(F.col("usr_n"), F.lit(1), word))
    spans = F.transform(F.filter("slots", lambda s: s["label_start"] >= 0), lambda s: F.struct(
        s["k"].alias("k"), pieces_to(s["label_start"]).alias("from"), pieces_to(s["label_end"]).alias("to")))
    a, b = ("usr_ids", "sys_ids") if swap else ("sys_ids", "usr_ids")
    return x.select("dialog_id", "turn", F.col(a).alias("a"), F.col(b).alias("b"), "slots", spans.alias("spans"),
                    F.col("sys_pieces").cast("bigint").alias("sys_pieces"))


def newest_that_fit(rows: DataFrame, budget: int, extra: tuple[str, ...] = (), block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """``rows`` (dialog_id, turn, own, extra columns) with ``past`` (elements of ``own`` in all earlier turns) and ``recent``:
    the newest earlier turns that show in the first ``budget`` elements, newest first, as structs of ``behind`` (elements
    between it and the turn), ``own`` (cut to the budget) and the extra columns."""
    size = F.size("own").cast("bigint")
    line = rows.select("dialog_id", "turn", F.slice("own", 1, budget).alias("own"), *extra, size.alias("__size"))
    line = written(running_sum_before(line, ["dialog_id"], "turn", "__size", "past", block_size=block_size), "piece-line")
    stretch = lambda c: F.floor(c / budget).cast("bigint")
    end = F.col("past") + F.col("__size")
    shown = line.where(F.col("__size") > 0).select("dialog_id", end.alias("__end"), "own", *extra,
                                                   F.explode(F.array(stretch(end), stretch(end) + 1)).alias("__stretch"))
    wanted = line.where(F.col("past") > 0).select("dialog_id", "turn", F.col("past").alias("__at"),
                                                  stretch(F.col("past")).alias("__stretch"))
    behind = F.col("__at") - F.col("__end")
    pairs = wanted.join(shown, ["dialog_id", "__stretch"]).where((behind >= 0) & (behind < budget))
    one = F.struct(behind.alias("behind"), "own", *extra)
    recent = pairs.groupBy("dialog_id", "turn").agg(F.sort_array(F.collect_list(one)).alias("recent"))
    past = line.select("dialog_id", "turn", "past")
    return rows.join(past, ["dialog_id", "turn"]).join(recent, ["dialog_id", "turn"], "left")


def _with_history(x: DataFrame, budget: int, swap: bool, block_size: int) -> DataFrame:
    """``past``, ``hist`` (ids of the newest earlier turns) and ``hist_spans`` (the labelled spans on them)."""
    lead = F.lit(0).cast("bigint") if swap else F.col("sys_pieces")       # where the user's text begins in a turn
    own = x.select("dialog_id", "turn", F.concat("a", "b").alias("own"), F.transform("spans", lambda s: F.struct(
        s["k"].alias("k"), (lead + s["from"]).alias("from"), (lead + s["to"]).alias("to"))).alias("spans"))
    own = newest_that_fit(own, budget, ("spans",), block_size)
    moved = F.flatten(F.transform("recent", lambda u: F.transform(u["spans"], lambda s: F.struct(
        s["k"].alias("k"), (u["behind"] + s["from"]).alias("from"), (u["behind"] + s["to"]).alias("to")))))
    return x.join(own.select("dialog_id", "turn", "past", F.flatten(F.col("recent.own")).alias("hist"),
                             moved.alias("hist_spans")), ["dialog_id", "turn"])


def turn_features(turns: DataFrame, labels: DataFrame, vocab: DataFrame, slots: tuple[str, ...], class_types: tuple[str, ...],
                  max_len: int = 180, append_history: bool = True, use_history_labels: bool = False,
                  swap_utterances: bool = False, slot_value_dropout: float = 0.0, seed: str = "7",
                  block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """One row a turn with input_ids, input_ids_unmasked, input_mask, segment_ids (``max_len`` each), and by slot in
    list order: start_pos, end_pos, values, inform, inform_slot, refer_id, diag_state, class_label_id; too_long.

    ``turns``: dialog_id, turn, sys_toks, usr_toks; ``labels``: the rows of ``dialogue.label_turns``; ``vocab``: a table
    (token, id).  A 'copy_value' whose span did not fit becomes 'none'.  With dropout, the pieces of labelled values are
    ``[UNK]`` with that probability in ``input_ids``, by a draw on (seed, dialogue, turn, position).
    """
    vocab_ids = P.special_ids(vocab)
    budget = max_len - TOKEN_CORRECTION
    x = written(encoded_turns(turns, labels, vocab, slots, swap_utterances), "encoded-turns")
    no_spans = F.array().cast("array<struct<k:int,from:bigint,to:bigint>>")
    if append_history:
        x = _with_history(x, budget, swap_utterances, block_size)
    else:
        x = x.withColumns({"past": F.lit(0).cast("bigint"), "hist": F.lit(None).cast("array<int>"), "hist_spans": no_spans})
    x = x.withColumns({"hist": F.coalesce("hist", F.array().cast("array<int>")),
                       "hist_spans": F.coalesce("hist_spans", no_spans) if use_history_labels else no_spans,
                       "pa": F.size("a"), "pb": F.size("b"), "ph": F.least(F.col("past"), F.lit(1 << 30)).cast("int")})
    ka, kb, kh = truncate_triple("pa", "pb", "ph", F.lit(budget))
    x = x.withColumns({"ka": ka.cast("int"), "kb": kb.cast("int"), "kh": kh.cast("int")})
    lit = lambda t: F.array(F.lit(vocab_ids[t]))
    packed = F.concat(lit(P.CLS), F.slice("a", 1, F.col("ka")), lit(P.SEP), F.slice("b", 1, F.col("kb")), lit(P.SEP),
                      F.slice("hist", 1, F.col("kh")), lit(P.SEP))
    n = F.col("ka") + F.col("kb") + F.col("kh") + TOKEN_CORRECTION
    usr_at, usr_kept = (F.lit(1), F.col("ka")) if swap_utterances else (F.col("ka") + 2, F.col("kb"))
    hist_at = F.col("ka") + F.col("kb") + 3

    def placed(spans: str, at: Column, kept: Column) -> Column:
        """Spans as places of the row, cut where the text was."""
        cut = F.transform(spans, lambda s: F.struct(s["k"].alias("k"), (at + F.least(s["from"], kept)).cast("int").alias("from"),
                                                    (at + F.least(s["to"], kept)).cast("int").alias("to")))
        return F.filter(cut, lambda s: s["from"] < s["to"])

    x = x.select("dialog_id", "turn", "slots", packed.alias("unmasked"), n.alias("n"), (F.col("ka") + 2).alias("n_first"),
                 F.concat(placed("spans", usr_at, usr_kept), placed("hist_spans", hist_at, F.col("kh"))).alias("marks"),
                 (F.col("pa") + F.col("pb") + F.col("ph") > budget).alias("too_long"))
    # one labelled vector a slot, from the few spans
    by_slot = F.transform("slots", lambda s: F.struct(
        s.alias("s"), F.filter(F.col("marks"), lambda m: m["k"] == s["k"]).alias("m")))
    labels_of = lambda m: F.transform(F.sequence(F.lit(0), F.lit(max_len - 1)), lambda i: F.when(
        F.exists(m, lambda y: (y["from"] <= i) & (i < y["to"])), 1).otherwise(0))
    ids = F.col("unmasked")
    if slot_value_dropout > 0:
        key = F.concat_ws("-", F.col("dialog_id").cast("string"), F.col("turn").cast("string"))
        joint = F.transform("unmasked", lambda t, i: F.struct(t.alias("t"), i.alias("i"), F.exists(
            F.col("marks"), lambda y: (y["from"] <= i) & (i < y["to"])).alias("labelled")))
        ids = F.transform(joint, lambda e: F.when(
            e["labelled"] & (uniform(seed, key, e["i"], "drop") < slot_value_dropout), F.lit(vocab_ids[P.UNK])).otherwise(e["t"]))

    def finished(e: Column) -> Column:
        cls, start, end = first_span_class(e["s"]["class_label"], e["l"])
        index = lambda names, c: (F.array_position(F.array(*map(F.lit, names)), c) - 1).cast("int")
        return F.struct(
            start.cast("int").alias("start_pos"), end.cast("int").alias("end_pos"), e["s"]["seen_value"].alias("values"),
            e["s"]["informed_value"].alias("inform"), e["s"]["inform_slot"].alias("inform_slot"),
            index(("none", *slots), e["s"]["refer_label"]).alias("refer_id"),
            index(class_types, e["s"]["diag_state"]).alias("diag_state"), index(class_types, cls).alias("class_label_id"))

    with_labels = F.transform(by_slot, lambda e: F.struct(e["s"].alias("s"), labels_of(e["m"]).alias("l")))
    pad = lambda c: pad_to_length(c, max_len)
    x = x.select("dialog_id", "turn", pad(ids).alias("input_ids"), pad("unmasked").alias("input_ids_unmasked"),
                 pad(F.array_repeat(F.lit(1), F.col("n"))).alias("input_mask"),
                 pad(F.concat(F.array_repeat(F.lit(0), F.col("n_first")), F.array_repeat(
                     F.lit(1), F.col("n") - F.col("n_first")))).alias("segment_ids"),
                 F.transform(with_labels, finished).alias("by_slot"), "too_long")
    by_slot = ("start_pos", "end_pos", "values", "inform", "inform_slot", "refer_id", "diag_state", "class_label_id")
    return x.select("dialog_id", "turn", "input_ids", "input_ids_unmasked", "input_mask", "segment_ids",
                    *[F.col(f"by_slot.{c}").alias(c) for c in by_slot], "too_long")
