"""Dialogue preparation.

Relational parts are plain DataFrame operations: explode the logs, number
turns, join each user turn with the neighbouring system utterances on
``utt_idx +- 1`` (equi-joins, no dialogue-wide window), find state changes
with the block-split ``previous_value``, look acts up with two left joins.

Slot labelling needs no loop over a dialogue: seen values and classes are
values carried forward over (dialogue, slot), split into blocks of turns, and a
referral compares the slots of one turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import normalise_label
from ..session import written
from .windows import DEFAULT_BLOCK, carry_forward, previous_value, running_sum_before

# Act types that inform a value.
INFORM_ACTS = ("inform", "recommend", "select", "book")
# Slot renames of the dialogue-act annotation.
ACT_SLOT_RENAME = {
    "taxi-depart": "taxi-departure", "taxi-dest": "taxi-destination", "taxi-leave": "taxi-leaveAt",
    "taxi-arrive": "taxi-arriveBy", "train-depart": "train-departure", "train-dest": "train-destination",
    "train-leave": "train-leaveAt", "train-arrive": "train-arriveBy", "train-people": "train-book_people",
    "restaurant-price": "restaurant-pricerange", "restaurant-people": "restaurant-book_people",
    "restaurant-day": "restaurant-book_day", "restaurant-time": "restaurant-book_time",
    "hotel-price": "hotel-pricerange", "hotel-people": "hotel-book_people", "hotel-day": "hotel-book_day",
    "hotel-stay": "hotel-book_stay", "booking-people": "booking-book_people", "booking-day": "booking-book_day",
    "booking-stay": "booking-book_stay", "booking-time": "booking-book_time",
}
# Slots never referred to / from, and the people-vs-stay exclusion.
NO_REFERRAL_SLOTS = ("hotel-stars", "hotel-internet", "hotel-parking")
PEOPLE_SLOT_PATTERN = r"(hotel|restaurant)-book_people"
STAY_SLOT = "hotel-book_stay"
NON_POINTABLE = ("none", "dontcare", "true", "false")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def explode_dialogues(logs: DataFrame, map_col: str = "dialogues") -> DataFrame:
    """``map<dialog_id, struct<log: array<utterance>>>`` -> one row per utterance."""
    d = logs.select(F.explode(map_col).alias("dialog_id", "entry"))
    u = d.select("dialog_id", F.posexplode("entry.log").alias("utt_idx", "u"))
    # a system utterance carries belief-state metadata, a user one an empty object
    return u.select("dialog_id", "utt_idx", "u.*", (F.size("u.metadata") > 0).alias("is_sys"))


def cut_at_misorder(utts: DataFrame, dialog="dialog_id", order="utt_idx", is_sys="is_sys") -> DataFrame:
    """Keep a dialogue up to (not including) the first utterance that breaks user/system alternation.

    The first utterance must be a user one.  Each utterance is grouped with its
    predecessor by emitting itself under its own position and under the next
    one -- one shuffle on (dialogue, position), groups of at most two rows, so
    a long dialogue spreads over all tasks; the cut is a per-dialogue minimum
    (partial aggregate) joined back.
    """
    s = F.col(is_sys).cast("int")
    none = F.lit(None).cast("int")
    both = F.array(F.struct(F.col(order).alias("p"), s.alias("s"), none.alias("prev")),
                   F.struct((F.col(order) + 1).alias("p"), none.alias("s"), s.alias("prev")))
    copies = utts.select(dialog, F.explode(both).alias("e")).select(dialog, F.col("e.p").alias("__p"),
                                                                  F.col("e.s").alias("__s"), F.col("e.prev").alias("__prev"))
    pairs = copies.groupBy(dialog, "__p").agg(F.max("__s").alias("__s"), F.max("__prev").alias("__prev"))
    bad = (pairs.where(F.col("__s").isNotNull() & (F.col("__s") == F.coalesce(F.col("__prev"), F.lit(1))))
           .groupBy(dialog).agg(F.min("__p").alias("__cut")))
    return (utts.join(bad, dialog, "left").where(F.col("__cut").isNull() | (F.col(order) < F.col("__cut")))
            .drop("__cut"))


def pair_turns(utts: DataFrame, dialog="dialog_id", order="utt_idx", toks="toks") -> DataFrame:
    """D2 + J9: (system before, user) pairs; a user turn needs a following system utterance.

    Expects contiguous positions after ``cut_at_misorder`` (user at even
    positions).  Turn t uses utterance 2t (user), 2t-1 (system, empty for t=0)
    and takes its state changes from utterance 2t+1.  Every utterance is
    emitted under the turn(s) it belongs to and one ``groupBy(dialogue, turn)``
    assembles the pairs: one shuffle, at most three rows per group.
    """
    p = F.col(order)
    even = (p % 2 == 0)
    role_rows = F.when(even, F.array(F.struct((p / 2).cast("bigint").alias("turn"), F.lit("usr").alias("role")))) \
        .otherwise(F.array(F.struct(((p + 1) / 2).cast("bigint").alias("turn"), F.lit("sys_before").alias("role")),
                           F.struct(((p - 1) / 2).cast("bigint").alias("turn"), F.lit("sys_after").alias("role"))))
    x = utts.select(dialog, order, toks, F.explode(role_rows).alias("r")).select(dialog, "r.turn", "r.role", order, toks)
    g = x.groupBy(dialog, "turn").agg(
        F.max(F.when(F.col("role") == "usr", F.col(order))).alias(order),
        F.max(F.when(F.col("role") == "sys_after", F.col(order))).alias("next_sys_idx"),
        F.first(F.when(F.col("role") == "usr", F.col(toks)), ignorenulls=True).alias("usr_toks"),
        F.first(F.when(F.col("role") == "sys_before", F.col(toks)), ignorenulls=True).alias("sys_toks"))
    return g.where(F.col(order).isNotNull() & F.col("next_sys_idx").isNotNull()).select(
        dialog, "turn", order, "next_sys_idx", F.coalesce("sys_toks", F.array().cast("array<string>")).alias("sys_toks"),
        "usr_toks")


def booked_overrides(meta: DataFrame) -> DataFrame:
    """(dialog, utt, slot, value) with ``booked[0]`` values winning; slot ``dom-book_x`` or ``dom-x``."""
    cs = F.when(F.col("category") == "book", F.concat_ws("-", "domain", F.concat(F.lit("book_"), F.col("name")))) \
        .otherwise(F.concat_ws("-", "domain", "name"))
    booked = normalise_label(F.concat_ws("-", "domain", "name"), F.col("booked_v"))
    value = F.when(F.col("booked_v").isNotNull(), booked).otherwise(normalise_label(cs, F.col("value")))
    return meta.select("dialog_id", "utt_idx", cs.alias("slot"), value.alias("value"))


def state_changes(state: DataFrame, slots: tuple[str, ...] | None = None) -> DataFrame:
    """Slots whose value differs from the last value seen in the dialogue (initially ``none``)."""
    s = state.where(F.col("slot").isin(*slots)) if slots else state
    p = previous_value(s, ["dialog_id", "slot"], "utt_idx", "value", "prev_value", default="none")
    return p.where(F.col("value") != F.col("prev_value")).drop("prev_value")


def load_acts(acts: DataFrame) -> DataFrame:
    """D3 = P3 + P4 + A17: informing acts -> first value per (dialog, turn, slot)."""
    a = acts.where(F.col("annotated"))
    parts = F.split(F.lower("act"), "-")
    s = F.lower("slot")
    v = F.trim(F.lower("value"))
    f = a.where(F.try_element_at(parts, F.lit(2)).isin(*INFORM_ACTS) & (s != "none") & ~v.isin("?", "none"))
    rename = F.create_map(*[x for k, val in ACT_SLOT_RENAME.items() for x in (F.lit(k), F.lit(val))])
    full = F.concat_ws("-", F.try_element_at(parts, F.lit(1)), s)
    f = f.select("dialog_id", "turn", "pos", F.coalesce(F.try_element_at(rename, full), full).alias("slot"),
                 v.alias("value"))
    return f.groupBy("dialog_id", "turn", "slot").agg(F.min_by("value", "pos").alias("value"))


def act_lookup(turn_slots: DataFrame, acts: DataFrame) -> DataFrame:
    """Informed values of (dialog, turn, slot), else of (dialog, turn, 'booking-' + suffix), else ['none']."""
    direct = acts.select("dialog_id", "turn", "slot", F.col("value").alias("__a"))
    booking = acts.where(F.col("slot").startswith("booking-")).select(
        "dialog_id", "turn", F.col("slot").alias("__bk"), F.col("value").alias("__b"))
    x = turn_slots.withColumn("__bk", F.concat(F.lit("booking-"), F.try_element_at(F.split("slot", "-"), F.lit(2))))
    j = x.join(direct, ["dialog_id", "turn", "slot"], "left").join(booking, ["dialog_id", "turn", "__bk"], "left")
    raw = F.coalesce(F.col("__a"), F.col("__b"))
    return j.withColumn("inform_label", F.when(raw.isNull(), F.array(F.lit("none")))
                        .otherwise(F.array(normalise_label(F.col("slot"), raw)))).drop("__a", "__b", "__bk")


def history_newest_first(turns: DataFrame, swap: bool = False) -> DataFrame:
    """Tokens of all previous turns, newest first (each turn as sys+usr, or usr+sys when swapped).

    Output size is quadratic in dialogue length by definition; window per dialogue.
    """
    pair = F.concat("usr_toks", "sys_toks") if swap else F.concat("sys_toks", "usr_toks")
    w = Window.partitionBy("dialog_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("hst_toks", F.flatten(F.reverse(F.collect_list(pair).over(w))))


def swap_pair(turns: DataFrame, swap: bool) -> DataFrame:
    """text_a/text_b = (sys, usr), or (usr, sys) when swapped (a plan-time flag)."""
    a, b = ("usr_toks", "sys_toks") if swap else ("sys_toks", "usr_toks")
    return turns.withColumn("text_a", F.col(a)).withColumn("text_b", F.col(b))


def values_shared_by_slots(state: DataFrame, keys=("dialog_id", "turn")) -> DataFrame:
    """Per (dialog, turn, value) how many slots hold it; > 1 means the value is ambiguous."""
    return (state.where(~F.col("value").isin(*NON_POINTABLE))
            .groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n_slots")))


def too_long_rate(turns: DataFrame, max_len: int, correction: int = 4) -> DataFrame:
    """Share of examples whose sys+usr+history length exceeds ``max_len - correction``."""
    # the history of a turn is all turns before it: only its size is needed, a running sum
    own = F.size("sys_toks") + F.size("usr_toks")
    turns = running_sum_before(turns.select("dialog_id", "turn", own.cast("bigint").alias("own")), ["dialog_id"], "turn",
                               "own", "past")
    n = F.col("own") + F.col("past")
    return turns.agg(F.sum(F.when(n > max_len - correction, 1).otherwise(0)).alias("n_long"),
                     F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------- slot labelling

def _visible(o: Column, me: Column) -> Column:
    """What a slot sees of another one: its value after the turn if it comes earlier in the list, else before."""
    return F.when(o["slot_idx"] < me["slot_idx"], o["after"]).otherwise(o["before"])


def _referred(me: Column, others: Column, variants: Column) -> Column:
    """The slot of ``others`` that ``me`` (slot_idx, slot, value, before) refers to, or 'none'.

    ``others``: all slots of the turn in list order, with the value held
    ``before`` the turn and ``after`` it.  What a slot can see of another one is
    the value after this turn if that slot comes earlier in the list, else the
    value before it.  A slot holding the value itself wins (the first one);
    without one, the last slot holding a variant of the value does.
    """
    people = f"^{PEOPLE_SLOT_PATTERN}"
    about_stay = lambda o: ((o["slot"].rlike(people) & (me["slot"] == STAY_SLOT))
                            | (me["slot"].rlike(people) & (o["slot"] == STAY_SLOT)))
    open_to = F.filter(others, lambda o: (o["slot_idx"] != me["slot_idx"]) & ~o["slot"].isin(*NO_REFERRAL_SLOTS)
                       & ~about_stay(o))
    same = F.filter(open_to, lambda o: _visible(o, me) == me["value"])
    alike = F.filter(open_to, lambda o: F.coalesce(F.array_contains(variants, _visible(o, me)), F.lit(False)))
    barred = me["slot"].isin(*NO_REFERRAL_SLOTS) | (me["before"] == me["value"])
    return F.when(barred, F.lit("none")).otherwise(F.coalesce(
        F.get(same, F.lit(0))["slot"], F.try_element_at(alike, F.lit(-1))["slot"], F.lit("none")))


def _shared(me: Column, others: Column) -> Column:
    """Whether a slot that was seen before gets, from the user, a value that two or more slots hold."""
    return (me["copied"] & (me["before"] != "none")
            & (F.size(F.filter(others, lambda o: _visible(o, me) == me["value"])) > 1))


def settled_values(features: DataFrame, block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """Values held ``before`` and ``after`` each (turn, slot) when shared copies are not taken over.

    With labelled repetitions, a slot seen before does not take over a value
    from the user that two or more slots hold (``withheld``).  What slots hold
    depends in turn on what was withheld earlier, across slots, so the flags are
    found in rounds: carry the values forward under the flags so far, look at
    each turn's slots, set the flags anew, until a round changes none.  A flag
    depends on earlier (turn, slot) only, so every round settles at least the
    next link of each chain and the last one is exact; the number of rounds is
    the length of the longest chain of withheld values that depend on each
    other, whatever the length of a dialogue.  Rounds read written tables.
    """
    columns = features.columns
    rows = written(features.withColumn("withheld", F.lit(False)), "settled-start")
    while True:
        given = F.when((F.col("value_label") != "none") & ~F.col("withheld"), F.col("value_label"))
        x = carry_forward(rows.withColumn("given", given), ["dialog_id", "slot"], "turn", "given", "after",
                          default="none", exclusive_out="before", block_size=block_size).drop("given")
        copied = ~F.col("value_label").isin(*NON_POINTABLE) & F.col("in_usr")
        one = F.struct("slot_idx", F.col("value_label").alias("value"), "before", "after", copied.alias("copied"),
                       F.struct(*[c for c in x.columns if c not in ("dialog_id", "turn", "before", "after")]).alias("row"))
        turn = x.groupBy("dialog_id", "turn").agg(F.sort_array(F.collect_list(one)).alias("all"))
        shared = F.transform("all", lambda me: _shared(me, F.col("all")))
        y = turn.select("dialog_id", "turn", F.inline(F.arrays_zip("all", shared.alias("now"))))
        y = written(y.select("dialog_id", "turn", "all.row.*", "all.before", "all.after", "now"), "settled-round")
        if y.where(F.col("now") != F.col("withheld")).isEmpty():
            return y.select(*columns, "before", "after")
        rows = y.withColumn("withheld", F.col("now")).select(*columns, "withheld")


def _mention(usr_toks, value, inform_label, maps: Column) -> dict[str, Column]:
    """How a value shows in a turn (F8, F10): in the user's words, where last, and among the informed values."""
    from ..functions.normalize import normalise_text
    from ..functions.text import word_tokens
    from ..functions.values import first_informed, label_existence

    ex = label_existence(usr_toks, value, maps)
    last = F.try_element_at(ex["positions"], F.lit(-1))
    inf = first_informed(F.array_join(word_tokens(normalise_text(F.lower(_c(value)))), " "), _c(inform_label), maps)
    return {"in_usr": F.size(F.transform(ex["positions"], lambda p: p["start"])) > 0,
            "last_start": F.coalesce(last["start"], F.lit(-1)), "last_end": F.coalesce(last["end"], F.lit(-1)),
            "informed": inf["found"], "informed_value": inf["value"]}


def _with_repeated_values(features: DataFrame, tokens: DataFrame, label_maps: dict, block_size: int) -> DataFrame:
    """Unchanged slots that were seen take their value again; how it shows in the turn is worked out for it."""
    from ..config import label_map_column
    x = settled_values(features, block_size)
    again = (F.col("value_label") == "none") & ~F.col("modified") & (F.col("before") != "none")
    x = x.withColumn("again", again).withColumn("value_label", F.when(again, F.col("before")).otherwise(F.col("value_label")))
    same = x.where(~F.col("again"))
    repeated = x.where(F.col("again")).join(tokens.select("dialog_id", "turn", "usr_toks"), ["dialog_id", "turn"])
    repeated = repeated.withColumns(_mention("usr_toks", "value_label", "inform_label", label_map_column(label_maps)))
    return same.unionByName(repeated.select(*same.columns)).drop("again")


def label_turns(features: DataFrame, label_maps: dict, label_value_repetitions: bool = False,
                slots: tuple[str, ...] | None = None, block_size: int = DEFAULT_BLOCK,
                tokens: DataFrame | None = None) -> DataFrame:
    """Class, referral, informed value, span and running state of every (turn, slot).

    A slot has a class other than 'none' exactly in the turns that give it a
    value, so the seen value is the value carried forward over (dialogue, slot)
    and needs no loop; it is split into blocks of turns (``windows``).
    Referrals compare the slots of one turn (an array of the slot list).  The
    class carried forward exclusively gives both the last seen class and the
    dialogue state before the turn.

    ``label_value_repetitions``: slots that did not change are labelled with
    the value they hold (see ``settled_values``); a slot seen before gets no
    'copy_value' for a value that two or more slots hold.  It needs ``tokens``
    (dialog_id, turn, usr_toks).
    ``slots`` is accepted for callers that pass their list; the order is ``slot_idx``.

    ``features``: dialog_id, turn, slot_idx, slot, modified, value_label,
    inform_label, in_usr, last_start, last_end, informed, informed_value.
    """
    from ..config import label_map_column
    key, pointable = ["dialog_id", "slot"], ~F.col("value_label").isin(*NON_POINTABLE)
    if label_value_repetitions:
        if tokens is None:
            raise ValueError("label_value_repetitions needs the user tokens of the turns")
        x = _with_repeated_values(features, tokens, label_maps, block_size)
    else:
        x = features.withColumn("given", F.when(F.col("value_label") != "none", F.col("value_label")))
        x = carry_forward(x, key, "turn", "given", "after", default="none", exclusive_out="before",
                          block_size=block_size)
    one = F.struct("slot_idx", "slot", F.col("value_label").alias("value"), "before", "after",
                   (pointable & ~F.col("in_usr") & ~F.col("informed")).alias("may_refer"),
                   (pointable & F.col("in_usr")).alias("copied"),
                   F.when(~pointable, F.col("value_label")).when(F.col("in_usr"), "copy_value")
                   .when(F.col("informed"), "inform").alias("found"),
                   F.when(pointable & ~F.col("in_usr"), F.col("informed_value")).otherwise("none").alias("informed_value"),
                   F.when(pointable & F.col("in_usr"), F.col("last_start")).otherwise(-1).cast("int").alias("label_start"),
                   F.when(pointable & F.col("in_usr"), F.col("last_end")).otherwise(-1).cast("int").alias("label_end"))
    turn = x.groupBy("dialog_id", "turn").agg(F.sort_array(F.collect_list(one)).alias("all"))   # one entry a slot
    maps = label_map_column(label_maps)
    refer = F.transform("all", lambda me: F.when(me["may_refer"], _referred(me, F.col("all"), maps[me["value"]]))
                        .otherwise("none"))
    zipped = [F.col("all"), refer.alias("refer")]
    if label_value_repetitions:
        zipped.append(F.transform("all", lambda me: _shared(me, F.col("all"))).alias("shared"))
    y = (turn.select("dialog_id", "turn", F.inline(F.arrays_zip(*zipped)))
         .select("dialog_id", "turn", "all.*", "refer", *["shared"] * label_value_repetitions))
    if label_value_repetitions:
        y = y.withColumns({"found": F.when(F.col("shared"), "none").otherwise(F.col("found")), **{
            c: F.when(F.col("shared"), -1).otherwise(F.col(c)) for c in ("label_start", "label_end")}})
    y = (y.withColumn("class_raw", F.coalesce("found", F.when(F.col("refer") != "none", "refer").otherwise("unpointable")))
         .withColumn("marked", F.when(F.col("class_raw") != "none", F.col("class_raw"))))
    # rows and block summaries both read this: written once
    y = carry_forward(written(y, "marked-turns"), key, "turn", "marked", None, exclusive_out="last_class", block_size=block_size)
    dropped = (F.col("class_raw") == "unpointable") | (
        F.coalesce(F.col("class_raw") == F.col("last_class"), F.lit(False))
        & ~F.col("class_raw").isin("copy_value", "inform"))
    return y.select(
        "dialog_id", "turn", "slot", "class_raw",
        F.when(dropped, "none").otherwise(F.col("class_raw")).alias("class_label"),
        F.when(dropped, "none").otherwise(F.col("refer")).alias("refer_label"),
        "informed_value", (F.col("informed_value") != "none").cast("int").alias("inform_slot"),
        F.coalesce(F.when(F.col("last_class") == "unpointable", "copy_value").otherwise(F.col("last_class")),
                   F.lit("none")).alias("diag_state"),
        F.col("after").alias("seen_value"), "label_start", "label_end")


def turn_slot_features(turns: DataFrame, changes: DataFrame, acts: DataFrame, slots: tuple[str, ...],
                       label_maps: dict) -> DataFrame:
    """Row-local per-(turn, slot) inputs of the slot loop.

    ``turns`` from ``pair_turns``; ``changes`` from ``state_changes`` (slot,
    value per system utterance); ``acts`` from ``load_acts``.
    """
    from ..config import label_map_column

    maps = label_map_column(label_maps)
    x = turns.select("dialog_id", "turn", "next_sys_idx", "usr_toks",
                     F.posexplode(F.array(*[F.lit(s) for s in slots])).alias("slot_idx", "slot"))
    ch = changes.select("dialog_id", F.col("utt_idx").alias("next_sys_idx"), "slot", F.col("value").alias("__v"))
    x = x.join(ch, ["dialog_id", "next_sys_idx", "slot"], "left")
    x = x.withColumn("modified", F.col("__v").isNotNull()).withColumn("value_label", F.coalesce("__v", F.lit("none")))
    x = act_lookup(x, acts)
    shown = _mention("usr_toks", "value_label", "inform_label", maps)
    return x.select("dialog_id", "turn", "slot_idx", "slot", "modified", "value_label", "inform_label",
                    *[c.alias(k) for k, c in shown.items()])
