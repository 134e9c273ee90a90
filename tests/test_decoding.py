"""Decoding of predicted classes into dialogue states (D13, D14) against the loop over turns."""

import random

import pytest

from parlance.config import DatasetConfig
from parlance.operators.features import decode_state

SLOTS = ("a", "b", "c", "d")
CLASSES = ("none", "dontcare", "copy_value", "true", "false", "refer", "inform")
SCHEMA = ("dialog_id long, turn long, slot string, class_prediction long, refer_prediction long, span_text string, "
          "inform_value string")


def slow_states(rows, classes=CLASSES):
    """(dialogue, turn, slot): value and whether it was referred to."""
    out, turns = {}, {}
    for d, t, s, c, r, span, told in rows:
        turns.setdefault(d, {}).setdefault(t, {})[s] = (classes[c], r, span, told)
    for d, by_turn in turns.items():
        state = dict.fromkeys(SLOTS, "none")
        for t in sorted(by_turn):
            for s in SLOTS:
                if s in by_turn[t]:
                    c, _, span, told = by_turn[t][s]
                    state[s] = {"copy_value": span, "inform": None if told is None else "§§" + told, "none": state[s],
                                "refer": state[s]}.get(c, c)
            for s in SLOTS:
                if s in by_turn[t] and by_turn[t][s][0] == "refer":
                    state[s] = state[SLOTS[by_turn[t][s][1] - 1]]
            out.update({(d, t, s): (state[s], by_turn[t][s][0] == "refer") for s in by_turn[t]})
    return out


def fast_states(spark, rows, block, classes=CLASSES):
    preds = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = decode_state(preds, DatasetConfig(classes, SLOTS, {}), SLOTS, block_size=block).collect()
    assert len(got) == len(rows)
    return {(r.dialog_id, r.turn, r.slot): (r.slot_prediction, r.referral) for r in got}


def random_rows(rnd, dialogue, turns, classes=CLASSES):
    return [(dialogue, t, s, rnd.choice([0, 0, 0, *range(len(classes))]), rnd.randint(0, len(SLOTS)), f"{dialogue}:{t}{s}",
             rnd.choice(["x", "y", None])) for t in range(turns) for s in SLOTS if rnd.random() < 0.8]


@pytest.mark.parametrize("block", [1, 3, 128])
def test_states_equal_the_loop(spark, block):
    rnd = random.Random(block)
    rows = [r for d in range(60) for r in random_rows(rnd, d, rnd.randint(1, 12))]
    assert fast_states(spark, rows, block) == slow_states(rows)


def test_classes_that_a_dataset_lacks(spark):
    classes = ("none", "dontcare", "copy_value", "inform")
    rows = random_rows(random.Random(5), 1, 10, classes)
    assert fast_states(spark, rows, 4, classes) == slow_states(rows, classes)


def test_referrals_within_a_turn_go_in_slot_order(spark):
    """b takes a's new value, a takes d's of before; id 0 is the last slot; a slot may name itself."""
    refer = CLASSES.index("refer")
    rows = [(1, 0, s, 2, 1, v, None) for s, v in zip(SLOTS, "wxyz")]
    rows += [(1, 1, "a", refer, 0, None, None), (1, 1, "b", refer, 1, None, None), (1, 1, "c", refer, 3, None, None)]
    got = fast_states(spark, rows, 1)
    assert [got[1, 1, s] for s in "abc"] == [("z", True), ("z", True), ("y", True)]


def test_one_long_dialogue_and_a_chain_over_blocks(spark):
    """A value is handed from slot to slot in every turn, over hundreds of blocks."""
    n, refer = 6000, CLASSES.index("refer")
    rows = [(7, 0, "a", 2, 1, "start", None)]
    rows += [(7, t, SLOTS[t % 4], refer, (t - 1) % 4 + 1, None, None) for t in range(1, n)]
    rows += random_rows(random.Random(9), 8, 300)
    got = fast_states(spark, rows, 16)
    assert got == slow_states(rows) and got[7, n - 1, SLOTS[(n - 1) % 4]] == ("start", True)


def test_empty_table_and_unknown_slots(spark):
    assert fast_states(spark, [], 8) == {}
    with pytest.raises(Exception, match="not in the slot list: zz"):
        fast_states(spark, [(1, 0, "zz", 0, 1, None, None)], 8)
