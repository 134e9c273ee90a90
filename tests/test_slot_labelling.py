"""Slot labelling (D5, D6, D9, W13) on hand-written dialogues, and properties on the driver's tables."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.operators import dialogue as D
from parlance.plans import fixtures as fx

SLOTS = ("hotel-area", "taxi-destination", "restaurant-area", "hotel-stars", "hotel-book_stay",
         "hotel-book_people", "hotel-parking")
MAPS = {"centre": ["center", "downtown"]}
SCHEMA = ("dialog_id long, turn long, slot_idx int, slot string, modified boolean, value_label string, in_usr boolean, "
          "last_start int, last_end int, informed boolean, informed_value string")
REPEATED = SCHEMA + ", inform_label array<string>"


def feature_rows(dialogues):
    """dialogues: {id: [turn, ...]}, a turn {slot: (value, how)}, how: 'said' (at words 2-4), 'told' or ''."""
    rows = []
    for d, turns in dialogues.items():
        for t, given in enumerate(turns):
            for i, s in enumerate(SLOTS):
                value, how = given.get(s, ("none", ""))
                rows.append((d, t, i, s, s in given, value, how == "said", 2 if how == "said" else -1,
                             4 if how == "said" else -1, how == "told", value if how == "told" else "none"))
    return rows


def labelled(spark, dialogues, block=4096):
    df = spark.createDataFrame(feature_rows(dialogues), SCHEMA)
    return {(r.dialog_id, r.turn, r.slot): r for r in D.label_turns(df, MAPS, slots=SLOTS, block_size=block).collect()}


DIALOGUES = {
    1: [{"hotel-area": ("centre", "said")},
        {"restaurant-area": ("centre", "")},            # refers to the hotel's area
        {"restaurant-area": ("centre", "")},            # already holds it: nothing to refer to
        {"taxi-destination": ("centre", "told")},
        {"taxi-destination": ("centre", "told")},       # informed again: named again
        {"hotel-parking": ("true", "")},
        {"hotel-parking": ("true", "")},                # same class as last time: not named
        {"hotel-parking": ("dontcare", "")}],
    2: [{"hotel-area": ("north", "said"), "taxi-destination": ("north", "")},   # sees an earlier slot of its own turn
        {"hotel-area": ("south", ""), "restaurant-area": ("south", "said")}],   # not a later slot of its own turn
    3: [{"hotel-area": ("downtown", "said")}, {"taxi-destination": ("center", "said")},
        {"restaurant-area": ("centre", "")},            # two variants are held: the last slot of the list wins
        {"hotel-area": ("centre", "said")}, {"restaurant-area": ("east", "said")},
        {"restaurant-area": ("centre", "")}],           # now the value itself is held: it wins over the variant
    4: [{"hotel-book_people": ("3", "said")}, {"hotel-book_stay": ("3", "")},   # people never stand for nights
        {"hotel-stars": ("3", "")},                     # stars never refer
        {"hotel-area": ("3", "")}],                     # the first slot of the list that holds it: nights
}
EXPECTED = {  # (dialogue, turn, slot): class_raw, class_label, refer_label, diag_state, seen_value
    (1, 0, "hotel-area"): ("copy_value", "copy_value", "none", "none", "centre"),
    (1, 1, "restaurant-area"): ("refer", "refer", "hotel-area", "none", "centre"),
    (1, 2, "restaurant-area"): ("unpointable", "none", "none", "refer", "centre"),
    (1, 3, "restaurant-area"): ("none", "none", "none", "copy_value", "centre"),
    (1, 3, "taxi-destination"): ("inform", "inform", "none", "none", "centre"),
    (1, 4, "taxi-destination"): ("inform", "inform", "none", "inform", "centre"),
    (1, 5, "hotel-parking"): ("true", "true", "none", "none", "true"),
    (1, 6, "hotel-parking"): ("true", "none", "none", "true", "true"),
    (1, 7, "hotel-parking"): ("dontcare", "dontcare", "none", "true", "dontcare"),
    (2, 0, "taxi-destination"): ("refer", "refer", "hotel-area", "none", "north"),
    (2, 1, "hotel-area"): ("unpointable", "none", "none", "copy_value", "south"),
    (2, 1, "restaurant-area"): ("copy_value", "copy_value", "none", "none", "south"),
    (3, 2, "restaurant-area"): ("refer", "refer", "taxi-destination", "none", "centre"),
    (3, 5, "restaurant-area"): ("refer", "refer", "hotel-area", "copy_value", "centre"),
    (4, 1, "hotel-book_stay"): ("unpointable", "none", "none", "none", "3"),
    (4, 2, "hotel-stars"): ("unpointable", "none", "none", "none", "3"),
    (4, 3, "hotel-area"): ("refer", "refer", "hotel-book_stay", "none", "3"),
    (4, 3, "hotel-book_people"): ("none", "none", "none", "copy_value", "3"),
}


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_hand_written_dialogues(spark, block):
    got = labelled(spark, DIALOGUES, block)
    assert len(got) == sum(len(t) for t in DIALOGUES.values()) * len(SLOTS)
    assert {k: (got[k].class_raw, got[k].class_label, got[k].refer_label, got[k].diag_state, got[k].seen_value)
            for k in EXPECTED} == EXPECTED
    said = got[1, 0, "hotel-area"]
    assert (said.label_start, said.label_end, said.inform_slot) == (2, 4, 0)
    told = got[1, 3, "taxi-destination"]
    assert (told.label_start, told.informed_value, told.inform_slot) == (-1, "centre", 1)


def test_one_long_dialogue_is_cut_into_blocks(spark):
    n = 3000
    turns = [{"hotel-area": (f"v{i}", "said")} if i % 7 == 0 else {} for i in range(n)]
    got = labelled(spark, {5: turns}, block=50)
    for i in range(n):
        r = got[5, i, "hotel-area"]
        assert r.seen_value == f"v{i - i % 7}"
        assert r.diag_state == ("none" if i == 0 else "copy_value")


# ---- labelled repetitions: a turn is (user words, {slot: value}, {slot: informed value})

def mention(words, value, told):
    """(in_usr, last place, informed) of a one-word value; variants of the map count."""
    forms = [value] if value in words else [v for v in MAPS.get(value, []) if v in words][:1]
    at = max((i for i, w in enumerate(words) if w in forms), default=-1)
    informed = told == value or value in MAPS.get(told, []) or (told not in MAPS and told in MAPS.get(value, []))
    return bool(forms), at, informed


def slow_labels(dialogues):
    """The labelling as one loop over turns and slots."""
    out = {}
    for d, turns in dialogues.items():
        seen, held, state = {}, dict.fromkeys(SLOTS, "none"), dict.fromkeys(SLOTS, "none")
        for t, (words, given, told) in enumerate(turns):
            new_state = dict(state)
            for s in SLOTS:
                value = given[s] if s in given else held[s] if s in seen else "none"
                il, refer, informed_value, at = told.get(s, "none"), "none", "none", -1
                if value in D.NON_POINTABLE:
                    kind = value
                else:
                    in_usr, at, informed = mention(words, value, il)
                    if in_usr:
                        kind = "copy_value"
                        if s in seen and list(held.values()).count(value) > 1:
                            kind, at = "none", -1
                    elif informed:
                        kind, informed_value = "inform", il
                    else:
                        refer = slow_referral(value, s, held)
                        kind = "refer" if refer != "none" else "unpointable"
                again = kind == seen.get(s) and kind not in ("copy_value", "inform")
                gone = kind == "unpointable" or again
                out[d, t, s] = (kind, "none" if gone else kind, "none" if gone else refer, informed_value, state[s], at)
                if kind != "none":
                    seen[s], held[s] = kind, value
                    new_state[s] = "copy_value" if kind == "unpointable" else kind
                out[d, t, s] += (held[s],)
            state = new_state
    return out


def slow_referral(value, slot, held):
    if slot in D.NO_REFERRAL_SLOTS or held[slot] == value:
        return "none"
    people = ("hotel-book_people", "restaurant-book_people")
    open_to = [o for o in SLOTS if o != slot and o not in D.NO_REFERRAL_SLOTS
               and not (o in people and slot == D.STAY_SLOT) and not (slot in people and o == D.STAY_SLOT)]
    same = [o for o in open_to if held[o] == value]
    alike = [o for o in open_to if held[o] in MAPS.get(value, [])]
    return same[0] if same else alike[-1] if alike else "none"


def fast_labels(spark, dialogues, block):
    rows, tokens = [], []
    for d, turns in dialogues.items():
        for t, (words, given, told) in enumerate(turns):
            tokens.append((d, t, words))
            for i, s in enumerate(SLOTS):
                value, il = given.get(s, "none"), told.get(s, "none")
                in_usr, at, informed = mention(words, value, il)
                rows.append((d, t, i, s, s in given, value, in_usr, at, at + 1 if in_usr else -1, informed,
                             il if informed else "none", [il]))
    got = D.label_turns(spark.createDataFrame(rows, REPEATED), MAPS, label_value_repetitions=True, block_size=block,
                        tokens=spark.createDataFrame(tokens, "dialog_id long, turn long, usr_toks array<string>"))
    return {(r.dialog_id, r.turn, r.slot): (r.class_raw, r.class_label, r.refer_label, r.informed_value, r.diag_state,
                                            r.label_start, r.seen_value) for r in got.collect()}


@pytest.mark.parametrize("block", [2, 4096])
def test_repetitions_equal_the_loop(spark, block):
    rnd = random.Random(block)
    pool = ["centre", "center", "north", "3", "none", "dontcare"]
    dialogues = {}
    for d in range(40):
        dialogues[d] = [([rnd.choice(pool + ["so"]) for _ in range(rnd.randint(0, 3))],
                         {s: rnd.choice(pool) for s in SLOTS if rnd.random() < 0.4},
                         {s: rnd.choice(pool) for s in SLOTS if rnd.random() < 0.2}) for _ in range(rnd.randint(1, 9))]
    want = slow_labels(dialogues)
    assert fast_labels(spark, dialogues, block) == want
    kinds = {v[0] for v in want.values()}
    assert kinds == {"none", "dontcare", "copy_value", "inform", "refer", "unpointable"}


def test_a_chain_of_withheld_values(spark):
    """A withheld copy leaves its slot on the old value, which lets the next one through, and so on."""
    a, b, c = "hotel-area", "taxi-destination", "restaurant-area"
    turns = [(["x", "y", "z"], {a: "x", b: "y", c: "z"}, {}),
             (["x"], {b: "x"}, {}), (["x"], {c: "x"}, {}), (["y"], {a: "y"}, {}), (["x"], {c: "x"}, {}),
             (["z"], {a: "z"}, {}), (["z"], {b: "z"}, {}), (["y"], {c: "y"}, {}), ([], {}, {})]
    want = slow_labels({1: turns})
    assert fast_labels(spark, {1: turns}, 2) == want
    assert any(kind == "none" and given for (kind, *_), given in
               ((want[1, t, s], s in turns[t][1]) for t in range(len(turns)) for s in (a, b, c)))


def test_repetitions_in_one_long_dialogue(spark):
    """Thousands of turns of one dialogue, values handed on over many blocks; rounds do not grow with the length."""
    n = 4000
    turns = [([f"v{t}"] if t % 5 == 0 else ["so"], {SLOTS[t % 3]: f"v{t}"} if t % 5 == 0 else {}, {}) for t in range(n)]
    assert fast_labels(spark, {1: turns, 2: turns[:3]}, 64) == slow_labels({1: turns, 2: turns[:3]})


def test_repetitions_need_the_words(spark):
    with pytest.raises(ValueError, match="tokens"):
        D.label_turns(spark.createDataFrame([], REPEATED), MAPS, label_value_repetitions=True)


def test_properties_on_the_driver_tables(spark):
    from parlance.plans.q_dialogue import _labelled
    rows = _labelled(spark, "/root/testdata/sf0.01").cache()
    pointable = ~F.col("class_raw").isin("none", "dontcare", "true", "false")
    broken = rows.where(
        ((F.col("refer_label") != "none") & (F.col("class_label") != "refer"))            # referrals have their class
        | (F.col("refer_label") == F.col("slot"))                                          # never to itself
        | ((F.col("class_label") != "none") & (F.col("class_label") != F.col("class_raw")))
        | (F.col("class_label") == "unpointable")
        | ((F.col("class_raw") != "none") & (F.col("seen_value") == "none"))
        | ((F.col("label_start") >= 0) != (F.col("class_raw") == "copy_value"))
        | ((F.col("inform_slot") == 1) & ~pointable))
    assert broken.count() == 0
    classes = {r[0] for r in rows.select("class_raw").distinct().collect()}
    assert {"copy_value", "none", "refer", "inform", "unpointable", "dontcare"} <= classes
    assert fx.MW_SLOT_NAMES
