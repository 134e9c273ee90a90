"""Property checks against small Python folds written from the behaviour description."""

import random
import re

from pyspark.sql import functions as F

from parlance.functions import arrays as A
from parlance.functions.text import word_tokens
from parlance.operators import spans as S
from parlance.operators.ordering import dense_index
from parlance.operators.windows import carry_forward, previous_value


def py_spans(tags):
    out, cur, start = [], None, -1
    for i, s in enumerate(tags):
        if s in ("O", "[PAD]"):
            if cur is not None:
                out.append(f"{cur}:{start}-{i}")
            cur = None
            continue
        if "-" not in s:
            continue
        kind, key = s.split("-", 1)
        if kind == "B":
            if cur is not None:
                out.append(f"{cur}:{start}-{i}")
            cur, start = key, i
        elif kind == "I" and key != cur:
            if cur is not None:
                out.append(f"{cur}:{start}-{i}")
            cur = None
    if cur is not None:
        out.append(f"{cur}:{start}-{len(tags)}")
    return out


def test_bio_spans_random(spark):
    rnd = random.Random(3)
    alphabet = ["O", "[PAD]", "B-a", "I-a", "B-b", "I-b", "X-a", "I-a-b", "B-a-b"]
    rows = [(i, [rnd.choice(alphabet) for _ in range(rnd.randint(0, 12))]) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, tags array<string>")
    got = {r["i"]: r["s"] for r in df.select("i", S.bio_spans("tags").alias("s")).collect()}
    for i, tags in rows:
        assert got[i] == py_spans(tags), tags


def test_carry_forward_and_lag_random_blocks(spark):
    rnd = random.Random(5)
    rows = []
    for d in range(30):
        for t in range(rnd.randint(1, 25)):
            rows.append((d, t, rnd.choice([None, None, "x", "y", "z"])))
    df = spark.createDataFrame(rows, "d long, t long, v string")
    for block in (1, 3, 4096):
        got = {(r["d"], r["t"]): (r["c"], r["p"]) for r in
               previous_value(carry_forward(df, ["d"], "t", "v", "c", default="none", block_size=block),
                              ["d"], "t", "v", "p", default="start", block_size=block).collect()}
        for d in range(30):
            last, prev = "none", "start"
            for (dd, t, v) in [x for x in rows if x[0] == d]:
                if v is not None:
                    last = v
                assert got[(dd, t)] == (last, prev), (block, dd, t)
                prev = v


def test_dense_index_is_a_permutation(spark):
    df = spark.range(0, 500).select((F.col("id") % 7).alias("g"), F.col("id").alias("k"))
    r = dense_index(df, ["g"], "k", "ix", buckets=8, count_col="n").collect()
    by = {}
    for x in r:
        by.setdefault(x["g"], []).append(x["ix"])
    for g, ix in by.items():
        assert sorted(ix) == list(range(len(ix)))
    ranked = dense_index(df, ["g"], "k", "ix", range_block=16).collect()
    for x in ranked:
        assert x["ix"] == x["k"] // 7


def test_truncate_closed_form(spark):
    cases = [(a, b, h, m) for a in range(0, 9) for b in range(0, 9) for h in range(0, 5) for m in range(0, 14)]
    df = spark.createDataFrame(cases, "a int, b int, h int, m int")
    ka, kb, kh = A.truncate_triple("a", "b", "h", "m")
    got = df.select("a", "b", "h", "m", ka.alias("ka"), kb.alias("kb"), kh.alias("kh")).collect()
    for r in got:
        a, b, h = r["a"], r["b"], r["h"]
        while a + b + h > r["m"]:
            if h > 0:
                h -= 1
            elif a > b:
                a -= 1
            else:
                b -= 1
        assert (r["ka"], r["kb"], r["kh"]) == (a, b, h), tuple(r)


def test_tokeniser_matches_python_split(spark):
    texts = ["Hello, wörld!! it's 5½ x²  .. ,", "a\tb\n c", "§§ none", "  ", "été", "x y z"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", word_tokens("t").alias("w")).collect()
    for r in got:
        want = [x for x in (p.strip() for p in re.split(r"(\W+)", r["t"])) if x]
        assert r["w"] == want, r["t"]


def test_hot_dialogue_small_blocks(spark):
    """One dialogue holds most rows: the block-split state still equals the plain running value."""
    rnd = random.Random(11)
    rows = [(0, t, "s", rnd.choice([None, None, None, "a", "b"])) for t in range(3000)]
    rows += [(d, t, "s", rnd.choice([None, "c"])) for d in range(1, 40) for t in range(5)]
    df = spark.createDataFrame(rows, "d long, t long, slot string, v string")
    got = {(r["d"], r["t"]): r["c"] for r in
           carry_forward(df, ["d", "slot"], "t", "v", "c", default="none", block_size=64, partition_by=["d"]).collect()}
    last = {}
    for d, t, _, v in rows:
        if v is not None:
            last[d] = v
        assert got[(d, t)] == last.get(d, "none")


PHRASES = [  # phrase, normalised: one step after the other, by hand
    ("at 5pm", "at 17:00"), ("at 5 p.m. please", "at 17:00 please"), ("by 12 pm", "by 12:00"), ("from 9", "from 09:00"),
    ("until 0915", "until 09:15"), ("after 915", "after 09:15"), ("24:30", "00:30"), ("09;45", "09:45"),
    ("leave 7:15", "leave 07:15"), ("at 11:30 pm", "at 23:30"), ("5am", "05:00 am"), ("room 5", "room 5"),
    ("i don't know", "i do not know"), ("a four star hotel", "a 4 star hotel"), ("five-star.", "5 star."),
    ("zero stars", "0 stars"), ("a guesthouse", "a guest house"), ("b & b", "bed and breakfast"),
    ("bed & breakfast", "bed and breakfast"), ("the archaelogy museum", "the archaeology museum"), ("", "")]
LABELS = [  # slot, value, normalised
    ("hotel-area", "", "none"), ("hotel-area", "not mentioned", "none"), ("taxi-leaveAt", "5pm", "17:00"),
    ("train-arriveBy", "at 9", "at 09:00"), ("restaurant-book_time", "7:15", "07:15"), ("hotel-area", "5pm", "5pm"),
    ("hotel-parking", "yes", "true"), ("hotel-internet", "free", "true"), ("hotel-parking", "no", "false"),
    ("hotel-type", "hotel", "true"), ("hotel-type", "guesthouse", "false"), ("hotel-name", "a guesthouse", "a guest house"),
    ("hotel-area", "guesthouse", "guesthouse"), ("hotel-stars", "no", "no")]


def test_normalisers_on_hand_written_pairs(spark):
    from parlance.functions.normalize import normalise_label, normalise_text
    texts = spark.createDataFrame(PHRASES, "phrase string, want string").select("*", normalise_text("phrase").alias("got"))
    assert [(r.phrase, r.got) for r in texts.collect()] == PHRASES
    labels = spark.createDataFrame(LABELS, "slot string, value string, want string")
    labels = labels.select("slot", "value", normalise_label("slot", "value").alias("got"))
    assert [tuple(r) for r in labels.collect()] == LABELS


def test_normalising_twice_changes_nothing_more(spark):
    from parlance.functions.normalize import normalise_text
    from parlance.plans.fixtures import time_phrases
    once = time_phrases(spark, "/root/testdata/sf0.01").select(normalise_text("phrase").alias("t"))
    assert once.count() > 500 and once.where(normalise_text("t") != F.col("t")).count() == 0
