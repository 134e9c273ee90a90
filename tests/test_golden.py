"""Hand-written golden rows (one per quirk) for the operators."""

from pyspark.sql import functions as F

from parlance.config import DatasetConfig
from parlance.functions import arrays as A
from parlance.functions import normalize as N
from parlance.functions.text import contains_window, tokenize_str, word_tokens
from parlance.functions.values import span_words_to_slot, split_words
from parlance.operators import corpus as C
from parlance.operators import dialogue as D
from parlance.operators import dst_scoring as dst
from parlance.operators import spans as S

CFG = DatasetConfig(("none", "dontcare", "copy_value", "true", "false", "refer", "inform"), ("s",),
                    {"centre": ["center", "downtown"]})


def one(spark, expr, schema="x string", value=("",)):
    return spark.createDataFrame([value], schema).select(expr.alias("r")).first()["r"]


def test_bio_spans_golden(spark):
    cases = [("O B-a I-a I-b I-b B-b", ["a:1-3", "b:5-6"]), ("B-a B-a [PAD]", ["a:0-1", "a:1-2"]), ("I-a O", []),
             ("B-a X-a I-a", ["a:0-3"]), ("", [])]
    for tags, want in cases:
        arr = F.split(F.lit(tags), " ") if tags else F.array().cast("array<string>")
        assert one(spark, S.bio_spans(arr)) == want, tags


def test_span_f1_substring_and_order(spark):
    gold = spark.createDataFrame([(0, ["time:0-1"]), (1, ["leave_time:2-3"])], "pos long, spans array<string>")
    pred = spark.createDataFrame([(0, ["time:0-1"]), (1, [])], "pos long, spans array<string>")
    r = {x["slot_type"]: x for x in S.span_f1_per_type(S.align_spans(pred, gold)).collect()}
    assert (r["time"]["tp"], r["time"]["n_pred"], r["time"]["n_true"]) == (1, 1, 2)
    assert r["leave_time"]["tp"] == 0
    gold = spark.createDataFrame([(0, ["a:0-1", "a:2-3"])], "pos long, spans array<string>")
    pred = spark.createDataFrame([(0, ["a:2-3", "a:0-1"])], "pos long, spans array<string>")
    assert S.span_f1_per_type(S.align_spans(pred, gold)).first()["tp"] == 0


def test_update_rule_and_carry(spark):
    rows = [(0, "none", "", "z"), (1, "copy_value", "x", "z"), (2, "none", "", "z"),
            (3, "refer", "§§none", "z"), (4, "inform", "§§ y", "z")]
    idx = {n: i for i, n in enumerate(CFG.class_types)}
    df = spark.createDataFrame([(1, t, "s", idx[c], p, g, 0, 0, 0, 0, 0, 0, 0, 0) for t, c, p, g in rows],
                               "dialog_id long, turn long, slot string, class_prediction long, slot_prediction string, "
                               "slot_groundtruth string, class_label_id long, start_pos long, start_prediction long, "
                               "end_pos long, end_prediction long, refer_id long, refer_prediction long, x int")
    got = [r["joint_pd"] for r in dst.prepare(df, CFG, block_size=2).orderBy("turn").collect()]
    assert got == ["none", "x", "x", "x", "y"]


def test_fuzzy_inform_and_value_correct(spark):
    from parlance.config import label_map_column
    maps = label_map_column(CFG.label_maps)
    assert one(spark, dst.slot_inform_value(F.lit("cambridge"), F.lit("cambridge station"), maps)) == "cambridge"
    assert one(spark, dst.value_correct(F.lit("centre"), F.lit("downtown"), maps)) == 1
    assert one(spark, dst.value_correct(F.lit("none"), F.lit("centre"), maps)) == 0


def test_contains_window_empty_needle(spark):
    assert one(spark, contains_window(F.array(F.lit("a")), F.array().cast("array<string>"))) is True
    assert one(spark, contains_window(F.array().cast("array<string>"), F.array(F.lit("a")))) is False


def test_class_prf_tn_rules(spark):
    df = spark.createDataFrame([("s", 0, 1)], "slot string, class_label_id long, class_prediction long")
    cfg = DatasetConfig(("a", "b", "c"), ("s",), {})
    ev = {r["class_idx"]: r for r in dst.class_prf(df, cfg, "all_rows").collect()}
    mt = {r["class_idx"]: r for r in dst.class_prf(df, cfg, "hits_only").collect()}
    assert ev[2]["tn"] == 1 and mt[2]["tn"] == 0


def test_span_refer_empty_default(spark):
    df = spark.createDataFrame([("s", 0, 0, 0, 0, 0, 0, 0, 0)],
                               "slot string, class_label_id long, class_prediction long, start_pos long, "
                               "start_prediction long, end_pos long, end_prediction long, refer_id long, refer_prediction long")
    r = dst.span_refer_accuracy(df, CFG).first()
    assert r["span_acc"] == 1.0 and r["refer_acc"] == 1.0


def test_word_bio_by_word_string(spark):
    df = spark.createDataFrame([("from rome to rome", [("city", (5, 9))])],
                               "text string, labels array<struct<slot:string,valueSpan:struct<startIndex:int,endIndex:int>>>")
    m = span_words_to_slot(F.col("text"), F.col("labels"))
    x = df.select(m.alias("m"), split_words("text").alias("w"))
    tags = x.select(S.word_bio("w", F.transform("w", lambda w: F.try_element_at(F.col("m"), w))).alias("t")).first()["t"]
    assert tags == ["O", "B-city", "O", "B-city"]


def test_prepend_context(spark):
    assert one(spark, C.prepend_context(F.lit("five"), F.array(F.lit("time"), F.lit("date")))) == "date time five"


def test_brackets_to_bio(spark):
    s = "[IN:A x [SL:B y [IN:C [SL:D z ] ] ] ]"
    assert one(spark, S.brackets_to_bio(F.lit(s))) == "x:O y:B-SL_B z:B-SL_B_IN_C_SL_D <=> IN_A"


def test_normalise_time(spark):
    for src, want in [("at 5pm", "at 17:00"), ("12:15 pm", "12:15"), ("24:10", "00:10"), ("by 7.30", "by 07:00.30"),
                      ("four-star guesthouse", "4 star guest house")]:
        assert one(spark, N.normalise_text(F.lit(src))) == want, src


def test_truncate_and_first_span(spark):
    a, b, h = A.truncate_triple(F.lit(5), F.lit(3), F.lit(4), F.lit(6))
    assert [one(spark, c) for c in (a, b, h)] == [3, 3, 0]
    s, e = A.first_run(F.array(*[F.lit(x) for x in (0, 0, 1, 1, 0, 1)]))
    assert (one(spark, s), one(spark, e)) == (2, 3)


def test_crop_last_turn(spark):
    assert one(spark, A.crop_after_last(F.split(F.lit("a > b"), " "), F.split(F.lit("a > b"), " "), ">")) == ["b"]
    w = F.split(F.lit("a b >"), " ")
    assert one(spark, A.crop_after_last(w, w, ">")) == ["a", "b", ">"]


def test_state_changes_and_misorder(spark):
    st = spark.createDataFrame([(1, i, "s", v) for i, v in enumerate(["none", "a", "a", "none"], start=1)],
                               "dialog_id long, utt_idx long, slot string, value string")
    ch = [(r["utt_idx"], r["value"]) for r in D.state_changes(st).orderBy("utt_idx").collect()]
    assert ch == [(2, "a"), (4, "none")]
    u = spark.createDataFrame([(1, i, s) for i, s in enumerate([False, True, True, False, True])],
                              "dialog_id long, utt_idx long, is_sys boolean")
    assert sorted(r["utt_idx"] for r in D.cut_at_misorder(u).collect()) == [0, 1]


def test_first_informed_act(spark):
    acts = spark.createDataFrame([(1, 1, 0, "Hotel-Inform", "Price", " cheap", True),
                                  (1, 1, 1, "Hotel-Inform", "Price", "moderate", True)],
                                 "dialog_id long, turn long, pos int, act string, slot string, value string, annotated boolean")
    r = D.load_acts(acts).first()
    assert (r["slot"], r["value"]) == ("hotel-pricerange", "cheap")


def test_tokenize_detok(spark):
    assert one(spark, tokenize_str(F.lit("ĠtheĠcheapĠhotel"))) == "the cheap hotel"
    assert one(spark, word_tokens(F.lit("a, b  . , c"))) == ["a", ",", "b", ". ,", "c"]


def test_sample_per_class_rejects_small_classes(spark):
    import pytest
    rows = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(10)], "pos long, category string")
    with pytest.raises(ValueError):
        C.sample_per_class(rows, 5)
    assert C.sample_per_class(rows, 3).count() == 6


def test_batch_examples_invariants(spark):
    rows = spark.createDataFrame([(i, i % 5, i // 8) for i in range(64)], "pos long, label long, batch long")
    ex = C.batch_examples(rows, seed="3").collect()
    members = {(r[2], r[0]) for r in rows.collect()}
    labels = {r[0]: r[1] for r in rows.collect()}
    by = {}
    for r in ex:
        by.setdefault(r["batch"], []).append(r)
    for b, rs in by.items():
        pos = [r["pos"] for r in rs]
        assert len(pos) == len(set(pos)) == 16
        lab_picks = [r for r in rs if r["kind"] == "label"]
        want = {labels[p] for (bb, p) in members if bb == b}
        assert {labels[r["pos"]] for r in lab_picks} == want
        assert all((b, r["pos"]) not in members for r in rs)


def test_registry_round_trip(spark, tmp_path):
    from parlance.sources import registry
    from parlance.sources.sinks import write_csv_quoted
    df = spark.createDataFrame([("hi, \"you\"\nthere", "greet"), ("bye", "leave")], "text string, category string")
    write_csv_quoted(df, str(tmp_path / "hwu" / "train.csv"))
    back = registry.load(spark, "hwu", "train", str(tmp_path))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert registry.task_of("multiwoz") == "dst"


def test_config_tables(spark, tmp_path):
    from parlance.config import config_tables, load_dataset_config, read_config_frame
    p = tmp_path / "cfg.json"
    p.write_text('{"class_types": ["none", "copy_value"], "slots": ["a-b"], "label_maps": {"x": ["y", "z"]}}')
    cfg = load_dataset_config(spark, str(p))
    assert cfg.class_types == ("none", "copy_value") and cfg.label_maps == {"x": ["y", "z"]}
    ct, sl, lv = config_tables(read_config_frame(spark, str(p)))
    assert lv.count() == 2 and sl.first()["name"] == "a-b"


def test_referral_rule(spark):
    def refer(value, slot, held):
        """What ``slot`` refers to when the other slots hold ``held`` before and after the turn, in list order."""
        order = sorted({*held, slot})
        entry = lambda s, v: F.struct(F.lit(order.index(s)).alias("slot_idx"), F.lit(s).alias("slot"),
                                      F.lit(v).alias("value"), F.lit(held.get(s, "none")).alias("before"),
                                      F.lit(held.get(s, "none")).alias("after"))
        others = F.array(*[entry(s, "none") for s in order])
        variants = {"centre": ["center", "downtown"]}.get(value, [])
        return one(spark, D._referred(entry(slot, value), others, F.array(*map(F.lit, variants)).cast("array<string>")))

    assert refer("centre", "hotel-area", {"a-x": "downtown", "b-y": "center"}) == "b-y"     # the last variant
    assert refer("centre", "hotel-area", {"a-x": "downtown", "b-y": "centre"}) == "b-y"     # the value itself wins
    assert refer("centre", "hotel-area", {"a-x": "centre", "b-y": "downtown"}) == "a-x"
    assert refer("centre", "hotel-area", {"hotel-area": "centre", "b-y": "centre"}) == "none"
    assert refer("2", "hotel-book_stay", {"hotel-book_people": "2"}) == "none"
    assert refer("2", "restaurant-book_people", {"hotel-book_people": "2"}) == "hotel-book_people"
    assert refer("yes", "hotel-parking", {"a-x": "yes"}) == "none"


def test_delex_and_letter_compat(spark):
    from parlance.functions.values import delex
    toks = F.array(*[F.lit(x) for x in ["a", "n", "o", "x", "e", "a", "b"]])
    vals = F.array(F.lit("none"), F.lit("a b"))
    assert one(spark, delex(toks, vals)) == ["a", "n", "o", "x", "e", "[UNK]", "[UNK]"]
    assert one(spark, delex(toks, vals, compat_letters=True)) == ["a", "[UNK]", "[UNK]", "x", "[UNK]", "[UNK]", "[UNK]"]


def test_confusion_empty_gold_row(spark):
    df = spark.createDataFrame([("s", 0, 1), ("s", 0, 0)], "slot string, class_label_id long, class_prediction long")
    cfg = DatasetConfig(("a", "b", "c"), ("s",), {})
    r = {(x["gt_class"], x["pd_class"]): x["rate"] for x in dst.confusion_offdiag(df, cfg).collect()}
    assert len(r) == 9 and r[(0, 1)] == 0.5 and r[(0, 0)] == 0.0 and r[(2, 0)] is None


def test_update_violations_table(spark):
    idx = {n: i for i, n in enumerate(CFG.class_types)}
    rows = [(1, 0, "s", idx["inform"], "plain value", "z"), (1, 1, "s", 9, "x", "z"), (1, 2, "s", idx["inform"], "§§ y", "z")]
    df = spark.createDataFrame([r + (0,) * 8 for r in rows],
                               "dialog_id long, turn long, slot string, class_prediction long, slot_prediction string, "
                               "slot_groundtruth string, class_label_id long, start_pos long, start_prediction long, "
                               "end_pos long, end_prediction long, refer_id long, refer_prediction long, x int")
    bad = {r["turn"]: r["update_error"] for r in dst.update_violations(dst.prepare(df, CFG)).collect()}
    assert bad == {0: "unexpected slot value format", 1: "unexpected class type"}
