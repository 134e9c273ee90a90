"""Word pieces (F27) and whole training rows (D12) against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.operators import examples as EX
from parlance.operators import pieces as P
from parlance.operators.features import uniform

SLOTS = ("a", "b", "c")
CLASSES = ("none", "dontcare", "copy_value", "true", "false", "refer", "inform")
VOCAB = [*P.SPECIALS, "walk", "talk", "walking", "w", "a", "##ing", "##i", "##in", "##g", "##k", "##s", "x", "##x", "so",
         "it", "!", "##", "##é", "é"]


def slow_pieces(word, vocab):
    out, start = [], 0
    while start < len(word):
        for end in range(len(word), start, -1):
            piece = (P.CONT if start else "") + word[start:end]
            if piece in vocab:
                break
        else:
            return [P.UNK]
        out.append(piece)
        start = end
    return out


def vocabulary(spark):
    return spark.createDataFrame([(t, i) for i, t in enumerate(VOCAB)], "token string, id long")


def test_pieces_equal_the_longest_match_loop(spark):
    rnd = random.Random(3)
    words = ["walking", "walks", "talking", "waxk", "", "é", "xé", "##", "##x", "q", "xq", "x" * 300, "[UNK]", "wing"]
    words += ["".join(rnd.choice(["walk", "ing", "x", "s", "g", "k", "q", "é", "in"]) for _ in range(rnd.randint(1, 6)))
              for _ in range(300)]
    rows = [(i, [rnd.choice(words) for _ in range(rnd.randint(0, 8))]) for i in range(200)] + [(900, None), (901, []), (902, words)]
    got = P.subword_encode(spark.createDataFrame(rows, "k long, toks array<string>"), "toks", vocabulary(spark), ["k"])
    got = {r.k: r for r in got.collect()}
    assert len(got) == len(rows)
    for k, toks in rows:
        want = [slow_pieces(w, VOCAB) for w in toks or []]
        assert got[k].pieces == [p for w in want for p in w] and got[k].n_pieces == [len(w) for w in want]
        assert got[k].ids == [VOCAB.index(p) for w in want for p in w]


def test_vocabulary_of_all_words(spark):
    """No cap: every word with two occurrences has an id, in the order of its count; a word that is a character once."""
    toks = ["b"] * 5 + ["ab"] * 4 + [f"w{i}" for i in range(3000) for _ in range(2)] + ["once", "é"]
    df = spark.createDataFrame([(toks,)], "toks array<string>")
    got = {r.token: r.id for r in P.build_vocab(df).collect()}
    words = ["b", "ab", *sorted(f"w{i}" for i in range(3000))]
    chars = sorted(set("".join(toks)))
    want = [*P.SPECIALS, *words, *[c for c in chars if c not in words], *[P.CONT + c for c in chars]]
    assert got == {t: i for i, t in enumerate(want)} and "once" not in got


def test_a_vocabulary_without_specials_is_refused(spark):
    with pytest.raises(ValueError, match="CLS"):
        P.special_ids(vocabulary(spark).where("token <> '[CLS]'"))


def slow_rows(dialogues, labels, max_len, history_labels, swap, dropout, draw, append=True):
    """The builder as a loop: history lists grow turn by turn, lists are cut one element at a time."""
    out = {}
    for d, turns in dialogues.items():
        hist, hist_lab = [], {s: [] for s in SLOTS}
        for t, (sys, usr) in enumerate(turns):
            coded = lambda words: [slow_pieces(w, VOCAB) for w in words]
            usr_lab = {s: [int(labels[d, t, s]["start"] <= i < labels[d, t, s]["end"]) for i in range(len(usr))] for s in SLOTS}
            wide = lambda flags, words: [f for f, ps in zip(flags, coded(words)) for _ in ps]
            one = {"sys": [p for w in coded(sys) for p in w], "usr": [p for w in coded(usr) for p in w]}
            lab = {s: {"sys": [0] * len(one["sys"]), "usr": wide(usr_lab[s], usr)} for s in SLOTS}
            first, second = ("usr", "sys") if swap else ("sys", "usr")
            a, b, h = list(one[first]), list(one[second]), list(hist) if append else []
            too_long = len(a) + len(b) + len(h) > max_len - 4
            while len(a) + len(b) + len(h) > max_len - 4:
                (h if h else a if len(a) > len(b) else b).pop()
            row = [P.CLS, *a, P.SEP, *b, P.SEP, *h, P.SEP]
            vectors = {s: [0, *lab[s][first][:len(a)], 0, *lab[s][second][:len(b)], 0,
                           *(hist_lab[s][:len(h)] if history_labels else [0] * len(h)), 0] for s in SLOTS}
            ids = [VOCAB.index(p) for p in row]
            masked = [VOCAB.index(P.UNK) if any(vectors[s][i] for s in SLOTS) and draw(d, t, i) < dropout else x
                      for i, x in enumerate(ids)]
            pad = [0] * (max_len - len(row))
            per_slot = []
            for s in SLOTS:
                v, x = vectors[s] + pad, labels[d, t, s]
                kind = "none" if x["class"] == "copy_value" and 1 not in v else x["class"]
                start = v.index(1) if 1 in v else 0
                end = 0 if 1 not in v else start + v[start:].index(0) - 1
                per_slot.append((start, end, x["value"], x["inform"], int(x["inform"] != "none"),
                                 ("none", *SLOTS).index(x["refer"]), CLASSES.index(x["state"]), CLASSES.index(kind)))
            out[d, t] = (masked + pad, ids + pad, [1] * len(row) + pad,
                         [0] * (len(a) + 2) + [1] * (len(b) + len(h) + 2) + pad, *map(list, zip(*per_slot)), too_long)
            hist = one[first] + one[second] + hist
            for s in SLOTS:
                hist_lab[s] = lab[s][first] + lab[s][second] + hist_lab[s]
    return out


def corpus(rnd, sizes):
    words = ["walking", "talks", "so", "it", "!", "xx", "q", "wing", "é"]
    text = lambda: [rnd.choice(words) for _ in range(rnd.choice([0, 1, 3, 9]))]
    dialogues = {d: [([] if t == 0 else text(), text()) for t in range(n)] for d, n in enumerate(sizes)}
    labels = {}
    for d, turns in dialogues.items():
        for t, (_, usr) in enumerate(turns):
            for s in SLOTS:
                kind = rnd.choice(CLASSES)
                start = rnd.randrange(len(usr)) if kind == "copy_value" and usr else -1
                labels[d, t, s] = {"class": kind, "start": start, "end": min(len(usr), start + rnd.randint(1, 2)) if start >= 0 else -1,
                                   "refer": rnd.choice(SLOTS) if kind == "refer" else "none", "state": rnd.choice(CLASSES),
                                   "inform": rnd.choice(["none", "x"]), "value": rnd.choice(["none", "y"])}
    return dialogues, labels


def fast_rows(spark, dialogues, labels, **options):
    turns = spark.createDataFrame([(d, t, a, b) for d, x in dialogues.items() for t, (a, b) in enumerate(x)],
                                  "dialog_id long, turn long, sys_toks array<string>, usr_toks array<string>")
    lab = spark.createDataFrame(
        [(d, t, s, x["class"], x["refer"], x["inform"], int(x["inform"] != "none"), x["state"], x["value"], x["start"], x["end"])
         for (d, t, s), x in labels.items()],
        "dialog_id long, turn long, slot string, class_label string, refer_label string, informed_value string, inform_slot int, "
        "diag_state string, seen_value string, label_start int, label_end int")
    got = EX.turn_features(turns, lab, vocabulary(spark), SLOTS, CLASSES, **options)
    assert got.columns[2:] == ["input_ids", "input_ids_unmasked", "input_mask", "segment_ids", "start_pos", "end_pos", "values",
                               "inform", "inform_slot", "refer_id", "diag_state", "class_label_id", "too_long"]
    return {tuple(r)[:2]: tuple(r)[2:] for r in got.collect()}


@pytest.mark.parametrize("max_len,history_labels,swap,dropout,block,append", [
    (30, False, False, 0.0, 4096, True), (30, True, True, 0.5, 3, True), (9, True, False, 0.5, 2, True),
    (40, False, True, 0.0, 4096, False)])
def test_rows_equal_the_loop(spark, max_len, history_labels, swap, dropout, block, append):
    dialogues, labels = corpus(random.Random(max_len), [1, 2, 5, 9, 30])
    keys = [(d, t, i) for d, x in dialogues.items() for t in range(len(x)) for i in range(max_len)]
    draws = spark.createDataFrame(keys, "d long, t long, i int").select("d", "t", "i", uniform(
        "7", F.concat_ws("-", F.col("d").cast("string"), F.col("t").cast("string")), F.col("i"), "drop").alias("u"))
    draws = {tuple(r)[:3]: r.u for r in draws.collect()}
    got = fast_rows(spark, dialogues, labels, max_len=max_len, use_history_labels=history_labels, swap_utterances=swap,
                    slot_value_dropout=dropout, block_size=block, append_history=append)
    want = slow_rows(dialogues, labels, max_len, history_labels, swap, dropout, lambda *k: draws[k], append)
    assert got == want


def test_one_long_dialogue_gathers_only_what_fits(spark):
    """Thousands of turns: each row holds the newest few; the gathered structs stay within the budget."""
    rnd = random.Random(1)
    rows = [(1, t, [f"{t}:{i}" for i in range(rnd.choice([0, 1, 4]))]) for t in range(5000)]
    got = EX.newest_that_fit(spark.createDataFrame(rows, "dialog_id long, turn long, own array<string>"), 12, block_size=64)
    line = []
    for r in got.orderBy("turn").collect():
        shown = [x for u in r.recent or [] for x in u.own]
        assert shown[:12] == line[:12] and len(shown) < 24 and r.past == len(line) and len(r.recent or []) <= 12
        line = r.own + line


def test_system_words_are_delexicalised(spark):
    turns = spark.createDataFrame([(1, 0, ["a", "x", "é"], ["x"]), (1, 1, ["x"], ["x"])],
                                  "dialog_id long, turn long, sys_toks array<string>, usr_toks array<string>")
    acts = spark.createDataFrame([(1, 0, "b", "x"), (1, 0, "zz", "a"), (1, 0, "a", "none")],
                                 "dialog_id long, turn long, slot string, value string")
    got = {r.turn: (r.sys_toks, r.usr_toks) for r in EX.delexicalise_system(turns, acts, SLOTS).collect()}
    assert got == {0: (["a", "[UNK]", "é"], ["x"]), 1: (["x"], ["x"])}
