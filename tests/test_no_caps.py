"""Operators give the whole result: nothing is lost to a bound, a missing label or a large type list."""

import math
import random
from collections import Counter

import pytest

from parlance.operators import corpus as C
from parlance.operators import spans as S
from parlance.operators import vectors as V
from parlance.operators.ordering import dense_index


@pytest.mark.parametrize("n,size", [(100, 32), (40, 32), (64, 32), (7, 3)])
def test_batch_examples_are_complete(spark, n, size):
    rows = spark.createDataFrame([(i, i % 5 if i % 11 else None, i // size) for i in range(n)],
                                 "pos long, label long, batch long")
    got = C.batch_examples(rows, seed="s").collect()
    assert len(got) == len({(r.batch, r.pos) for r in got})
    for b in range(-(-n // size)):
        members = set(range(b * size, min(n, (b + 1) * size)))
        mine = [r for r in got if r.batch == b]
        labels = {i % 5 for i in members if i % 11}
        assert sum(r.kind == "label" for r in mine) == len(labels)
        for r in mine:
            if r.kind == "label" and any(i % 11 and i % 5 == r.pos % 5 and i not in members for i in range(n)):
                assert r.pos not in members
            if r.kind == "fill":
                assert r.pos not in members
        due = min(n, 2 * len(members))
        taken = members | {r.pos for r in mine if r.kind == "label"}
        assert len(mine) == min(due, len(labels) + n - len(taken))


def test_votes_for_any_label(spark):
    memory = spark.createDataFrame([(1, 0, [0.0, 1.0]), (2, 12, [1.0, 0.0]), (3, 900, [0.6, 0.6]), (4, None, [9.0, 9.0])],
                                   "mid long, label int, vec array<double>")
    queries = spark.createDataFrame([(10, 12, [5.0, 0.0]), (11, 77, [0.0, 5.0])], "qid long, gold int, vec array<double>")
    for block in (1, 1024):
        got = {r.qid: r for r in V.example_vote(queries, memory, block=block).collect()}
        e = [math.exp(x) for x in (0.0, 5.0, 3.0)]
        assert got[10].pred == 12 and got[10].confidence == pytest.approx(e[1] / sum(e))
        assert got[11].pred == 0
        nll = V.example_vote_nll(queries, memory, block=block).first()
        want = [-math.log(1e-6 + e[1] / sum(e)), -math.log(1e-6)]         # gold 77 is no label of the memory
        assert nll.n == 2 and nll.mean_nll == pytest.approx(sum(want) / 2)


def test_repeated_rows_of_a_vote_stay_off_the_driver(spark, monkeypatch):
    """Rows are repeated once a panel of the other side; a broadcast of them grew with the square of the table."""
    monkeypatch.setattr(V, "PANEL_BLOCKS", 2, raising=False)
    rng = random.Random(5)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(3)]
    held = [(i, rng.randrange(4) if i % 7 else None, vec()) for i in range(60)]
    held += [(100 + i, label, v) for i, label, v in held]                     # copies score the same
    asked = [(i, i % 5 if i % 3 else None, vec()) for i in range(25)]
    memory = spark.createDataFrame(held, "mid long, label int, vec array<double>")
    queries = spark.createDataFrame(asked, "qid long, gold int, vec array<double>")
    partials = V.vote_partials(queries, memory, block=4)
    partials.collect()                                                        # the joins are chosen while it runs
    assert "Broadcast" not in partials._jdf.queryExecution().executedPlan().toString()
    assert partials.groupBy("qid").count().agg({"count": "min"}).first()[0] > 1            # several panels
    votes = {r.qid: r for r in V.example_vote(queries, memory, block=4).collect()}
    best = {r.qid: r for r in V.nearest_memory(queries, memory, block=4).collect()}
    assert len(votes) == len(best) == len(asked)
    for qid, gold, q in asked:
        score = {mid: sum(a * b for a, b in zip(q, v)) for mid, label, v in held if label is not None}
        mass = Counter()
        for mid, label, _ in held:
            if label is not None:
                mass[label] += math.exp(score[mid])
        label, top = mass.most_common(1)[0]
        assert votes[qid].gold == gold and votes[qid].pred == label
        assert votes[qid].confidence == pytest.approx(top / sum(mass.values()))
        assert best[qid].best_score == pytest.approx(max(score.values()))
        assert score[best[qid].best_mid] == pytest.approx(max(score.values()))


@pytest.mark.parametrize("exact", [False, True])
def test_types_are_matched_like_the_loop(spark, exact):
    rows = [(1, ["date:0-2", "start_date:3-4", "0:5-9"], ["date:0-2", "0:5-9"], True, True),
            (2, None, ["time:1-2", ":3-4"], False, True), (3, ["a:b:0-2"], None, True, False), (4, [], ["date:0-2"] * 2, True, True),
            (5, ["0:5-9", "date:0-2"], None, True, False)]
    pairs = spark.createDataFrame(rows, "pos long, pred_spans array<string>, true_spans array<string>, has_pred boolean, "
                                        "has_true boolean")
    kind = lambda s: s.split(":")[0]
    want = Counter()
    for _, p, t, has_p, has_t in rows:
        for ty in {kind(s) for r in rows if r[4] for s in r[2] or []}:
            held = [tuple(s for s in side or [] if (kind(s) == ty if exact else ty in s)) for side in (p, t)]
            if any(held):
                want[(has_p, has_t, ty, *held)] += 1
    got = Counter((r.has_pred, r.has_true, r.slot_type, tuple(r.p), tuple(r.l)) for r in S.span_type_rows(pairs, exact=exact).collect())
    assert got == want


@pytest.mark.parametrize("block,bucket", [(50_000, 100_000), (3, 4)])
def test_many_types_in_blocks(spark, block, bucket):
    rnd = random.Random(4)
    types = {"".join(rnd.choices("ab_", k=rnd.randint(0, 4))) for _ in range(30)} | {"", "é_a"}
    spans = {"".join(rnd.choices("ab_:é", k=rnd.randint(0, 12))) for _ in range(60)}
    got = S.contained_types(spark.createDataFrame([(s,) for s in spans] * 2, "s string"),
                            spark.createDataFrame([(t,) for t in types], "slot_type string"), block, bucket).collect()
    assert sorted(map(tuple, got)) == sorted((s, t) for s in spans for t in types if t in s)


BRACKETS = [  # nested, empty and unbalanced brackets, words outside, several openers before a word
    ("[IN:GET_EVENT what [SL:DATE today ] ]", "what:O today:B-SL_DATE <=> IN_GET_EVENT"),
    ("[IN:A x [SL:B y [IN:GET_LOCATION z w ] v ] u ]",
     "x:O y:B-SL_B z:B-SL_B_IN_GET_LOCATION w:I-SL_B_IN_GET_LOCATION v:I-SL_B u:O <=> IN_A"),
    ("[IN:A [SL:B [SL:C ] x y ] [SL:B z ] ]", "x:B-SL_B y:I-SL_B z:B-SL_B <=> IN_A"),
    ("a ] [IN:A b ] ] c [SL:D e", "a:O b:O c:O e:B-SL_D <=> IN_A"), ("[IN:A [SL:B x ] y [SL:B ] z ]", "x:B-SL_B y:O z:O <=> IN_A"),
    ("no brackets", None), ("", None), ("[IN:A", " <=> IN_A")]


def test_brackets_by_position(spark):
    df = spark.createDataFrame(BRACKETS, "u string, want string").select("u", S.brackets_to_bio("u").alias("got"))
    assert [tuple(r) for r in df.collect()] == BRACKETS


def test_ranks_over_many_blocks(spark):
    df = spark.createDataFrame([(g, i * 7) for g in (1, 2) for i in range(3000)], "g long, k long").repartition(5)
    got = dense_index(df, ["g"], "k", "nth", count_col="n", range_block=2).collect()
    assert all(r.nth == r.k // 7 and r.n == 3000 for r in got) and len(got) == 6000


def test_slot_holdout_gives_every_part(spark):
    train = spark.createDataFrame([(i, "ab"[i % 2], f"t{i // 4}", "x") for i in range(200)],
                                  "pos long, lang string, text string, category string")      # each text twice a language
    test = spark.createDataFrame([(1000 + i, "ab"[i % 2]) for i in range(7)], "pos long, lang string")
    val = spark.createDataFrame([("a", 0, 196), ("a", 1, 196), ("b", 0, 191)], "lang string, draw long, pos long")
    got = C.slot_holdout(train, val, test, ["lang"], ["text", "category"]).collect()
    part = {p: [r.pos for r in got if r.part == p] for p in ("train", "val", "few", "test")}
    assert sorted(part["val"]) == [191, 196, 196] and sorted(part["test"]) == list(range(1000, 1007))
    assert sorted(part["train"]) == sorted(set(range(200)) - {196, 198, 189, 191})     # copies of a drawn row go too
    assert len(part["few"]) == 19 and set(part["few"]) <= set(part["train"])
    last = C.last_rows_val(train, last_n=40, n_val=100).collect()
    assert len(last) == 100 and min(r.pos for r in last) >= 160 and len({r.pos for r in last}) > 20
    assert len(C.last_rows_val(train).collect()) == 1000                               # fewer rows than the pool
