"""Classifiers, language model, quality rules: odd rows, planted effects, brute force."""

import math
import random
import re
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import langid, pseudo_lm, quality, toxicity

from .conftest import COMMON, prose

INSULTS = ("moron", "scum", "worthless", "idiot")


def labelled(spark, n=400):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        words, toxic = prose(i, 40).split(), i % 5 == 0
        if toxic:
            words.insert(rnd.randrange(40), rnd.choice(INSULTS))
            if rnd.random() < 0.8:
                words.insert(rnd.randrange(40), "women")
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(labels + [(None, 1), (3, None), (99999, 1)], "doc_id long, toxic int"))


def test_toxicity_held_out_accuracy_and_odd_rows(spark, odd, odd_rows, empty):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    out = toxicity.scored(docs, model).join(labels, "doc_id").filter(toxicity.held_out()).filter("toxic is not null").collect()
    assert len(out) > 40 and np.mean([(r.score >= 0.5) == bool(r.toxic) for r in out]) > 0.95
    scored = toxicity.scored(odd, model).collect()
    assert len(scored) == len(odd_rows) and all(0 <= r.score_ <= 1 and r.score is not None for r in scored)
    kept = toxicity.kept_documents(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == len(odd_rows)     # nothing learned: score 0
    assert toxicity.scored(empty, model).count() == 0


def test_swaps_keep_a_neutral_mention_clean(spark):
    feats = lambda t: np.array(sorted({f for w in toxicity.words_of(t) for f in toxicity.word_features(w)}))
    texts = [f"{prose(i, 15)} {'women are scum' if i % 3 == 0 else ''}" for i in range(60)]
    texts += [f"{prose(i, 15)} women scum" for i in range(60, 70)]
    y = np.array([int("scum" in t) for t in texts])
    swaps = [None if (w := toxicity.swapped(toxicity.words_of(t))) is None else feats(" ".join(w)) for t in texts]
    plain = toxicity.fit([feats(t) for t in texts], y, [None] * len(texts))
    fair = toxicity.fit([feats(t) for t in texts], y, swaps)
    neutral = ["women in the town"]
    assert fair.scorer()(neutral)[0] < 0.5 < plain.scorer()(neutral)[0]
    assert fair.scorer()(["you are scum"])[0] > 0.5


def texts_by_language():
    german = lambda s: " ".join(random.Random(s).choices("der die das und nicht schön groß über keit ung".split(), k=30))
    return [(i, prose(i, 30), "en") if i % 3 else (i, german(i), "de") for i in range(200)]


def test_language_accuracy_and_odd_rows(spark, odd, odd_rows, empty):
    docs = spark.createDataFrame(texts_by_language(), "doc_id long, text string, lang string")
    model = langid.train(docs)
    out = langid.predicted(docs, model).filter(langid.held_out()).collect()
    assert out and all(r.language.lang_pred == r.lang and 0 < r.language.score <= 1 for r in out)
    got = {(r.doc_id, r.text): r.language_ for r in langid.predicted(odd, model).collect()}
    for i, t, *_ in odd_rows:
        letters = t is not None and any(c.isalpha() for c in t)
        assert (got[i, t].lang_pred == "und") == (not letters) and 0 <= got[i, t].score <= 1
    nothing = langid.train(docs.withColumn("lang", docs.lang.substr(1, 0)).filter("lang is null"))
    assert {r.language.lang_pred for r in langid.predicted(docs, nothing).collect()} == {"und"}
    assert langid.predicted(empty, model).count() == 0


def test_kernel_is_the_mean_of_the_presence_cosines():
    grams, rows = langid.Grams(), np.zeros((2, langid._EDGES[-1]), dtype=bool)
    a, b = "abc abd", "Abd, xyz!"
    for row, t in zip(rows, (a, b)):
        grams.mark(t, row)
    k = langid.kernel_rows(rows) @ langid.kernel_rows(rows).T
    sets = [[{s[i:i + n] for i in range(len(s) - n + 1)} for n in (1, 2, 3)] for s in (" abc abd ", " abd xyz ")]
    want = np.mean([len(x & y) / math.sqrt(len(x) * len(y)) for x, y in zip(*sets)])
    assert k[0, 0] == pytest.approx(1) and k[0, 1] == pytest.approx(want, abs=0.05)     # n-grams share hash buckets now and then


def test_pseudo_likelihood_learns_order_and_takes_odd_rows(spark, odd, odd_rows, empty):
    rnd = random.Random(3)
    cycle = [COMMON[i % 5] for i in range(5)]
    docs = spark.createDataFrame([(i, " ".join(cycle[(i + k) % 5] for k in range(300))) for i in range(200)],
                                 "doc_id long, text string").repartition(2)
    vocab, flat = pseudo_lm.train(docs)
    counts = Counter(w for r in docs.collect() for w in r.text.split())
    assert list(vocab) == sorted(counts, key=lambda w: (-counts[w], w))
    shuffled = " ".join(rnd.sample(cycle * 40, 200))
    real = " ".join(cycle[k % 5] for k in range(200))
    pair = spark.createDataFrame([(0, real), (1, shuffled)], "doc_id long, text string")
    score = {r.doc_id: r for r in pseudo_lm.scored(pair, vocab, flat).collect()}
    assert score[0].mean_log_likelihood > score[1].mean_log_likelihood + 1
    out = {(r.doc_id, r.n_tokens): r for r in pseudo_lm.scored(odd, vocab, flat).collect()}
    net, tokens = pseudo_lm.Network(flat=flat), pseudo_lm.Tokens(vocab)
    for i, t, *_ in odd_rows:
        ids = tokens(t or "")
        row = tokens.row([ids])
        want = 0.0
        for at in range(2, 2 + len(ids)):                    # one position at a time, from both sides
            h = np.tanh(sum(net.embed[p][row[at + k]] for p, k in enumerate((-2, -1, 1, 2))))
            every = []
            for c in range(pseudo_lm.CLASSES):               # the whole vocabulary's probabilities
                zc = np.exp((h @ net.out_c + net.bias_c).astype(float))
                z = np.exp((h @ net.out[c] + net.bias[c]).astype(float))
                every.append(zc[c] / zc.sum() * z / z.sum())
            every = np.concatenate(every)
            assert every.sum() == pytest.approx(1) and len(every) == pseudo_lm.VOCABULARY
            want += np.log(every[row[at]])
        r = out[i, len(ids)]
        assert r.log_likelihood == pytest.approx(want, rel=1e-3, abs=1e-3)
        assert (r.mean_log_likelihood is None) == (not len(ids))
    assert pseudo_lm.scored(empty, *pseudo_lm.train(empty)).count() == 0


def test_every_position_is_a_training_target_once(spark):
    texts = ["one", "a b", prose(5, 40), prose(6, 700)] + [prose(7, 90)] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    vocab, flat = pseudo_lm.vocabulary(docs), pseudo_lm.Network().flat
    done = [pseudo_lm._train_pass(docs, vocab, flat, "text", k, pseudo_lm.ROUNDS)[1] for k in range(pseudo_lm.ROUNDS)]
    assert sum(done) == sum(len(t.split()) for t in texts) and min(done) > 0.3 * sum(done)
    for t in texts:
        n = len(t.split())
        shares = [pseudo_lm.share(t, n, k, pseudo_lm.ROUNDS).tolist() for k in range(pseudo_lm.ROUNDS)]
        assert sorted(sum(shares, [])) == list(range(n))


def test_vocabulary_grows_with_the_corpus(spark):
    often, seldom = [f"word{i}xy" for i in range(1500)], ["raremy", "oftemy"]     # one ending, two words
    docs = spark.createDataFrame([(i, " ".join(often)) for i in range(60)] + [(60, " ".join(seldom))],
                                 "doc_id long, text string").repartition(3)
    vocab = pseudo_lm.vocabulary(docs)
    assert sorted(vocab) == sorted(often)
    tokens = pseudo_lm.Tokens(vocab)
    ids = tokens(" ".join(often)).tolist()
    assert len(set(ids)) == 1500 and min(ids) == tokens.buckets and max(ids) < tokens.pad
    a, b = tokens("raremy oftemy")
    assert a != b and max(a, b) < tokens.buckets
    vocab, flat = pseudo_lm.train(docs)
    net = pseudo_lm.Network(tokens.pad, flat=flat)
    row = tokens.row([tokens(" ".join(often[:8]))])
    every = [sum(math.exp(net.log_probability(np.where(np.arange(len(row)) == 4, k, row).astype(np.int32), np.array([4]))[0])
                 for k in range(tokens.pad))]
    assert every[0] == pytest.approx(1, abs=1e-3)                                   # one distribution over all tokens
    out = {r.doc_id: r for r in pseudo_lm.scored(docs, vocab, flat).collect()}
    assert out[0].log_likelihood == pytest.approx(out[59].log_likelihood) and out[0].n_tokens == 1500


def test_copies_of_the_weights_do_not_grow_with_the_input_splits(spark):
    docs = spark.createDataFrame([(i, prose(i, 30)) for i in range(60)], "doc_id long, text string").repartition(40)
    one = pseudo_lm.one_a_core(docs)
    assert one.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism < 40
    assert sorted(one.collect()) == sorted(docs.collect())
    vocab, flat = pseudo_lm.vocabulary(docs), pseudo_lm.Network().flat
    sc = spark.sparkContext
    tracker = sc.statusTracker()
    sc.setJobGroup("lm-copies", "one training pass")
    pseudo_lm._train_pass(docs, vocab, flat, "text")
    sc.setLocalProperty("spark.jobGroup.id", None)
    stages = {k for j in tracker.getJobIdsForGroup("lm-copies") for k in tracker.getJobInfo(j).stageIds}
    tasks = [i.numTasks for i in map(tracker.getStageInfo, stages) if i and i.numCompletedTasks]
    assert tasks and max(tasks) <= sc.defaultParallelism


def test_tasks_and_driver_map_the_weights_and_hold_no_copy(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i, 60)) for i in range(40)], "doc_id long, text string").repartition(1)
    vocab, flat = pseudo_lm.train(docs)
    assert isinstance(flat, np.memmap) and flat.any()
    assert pseudo_lm.Weights(spark, flat).path == flat.filename                  # no second file
    assert pseudo_lm.Weights(spark, flat[::-1]).path != flat.filename != pseudo_lm.Weights(spark, flat[1:]).path
    given = pseudo_lm.Weights(spark, np.arange(3_000_000, dtype=np.float32))

    def run(batches):
        tracemalloc.start()
        total = given()[-1] + given()[::1000].sum()
        yield from (b.assign(total=float(total), held=tracemalloc.get_traced_memory()[1]) for b in batches)

    r = spark.range(1).mapInPandas(run, "id long, total double, held long").first()
    assert r.total > 1e6 and r.held < 1_000_000                                  # of 12,000,000 bytes
    with pytest.raises(ValueError):
        given()[0] = 1
    want = sorted(pseudo_lm.scored(docs, vocab, flat).collect())
    monkeypatch.setattr(pseudo_lm, "weight_file", lambda *a: None)               # a folder that is not mounted
    again, sent = pseudo_lm.train(docs)
    assert again == vocab and type(sent) is np.ndarray and np.array_equal(sent, flat)
    assert sorted(pseudo_lm.scored(docs, vocab, sent).collect()) == want


def test_scores_do_not_depend_on_the_documents_that_wait(spark, odd, monkeypatch):
    vocab, flat = pseudo_lm.train(odd)
    rows = lambda: sorted(map(str, pseudo_lm.scored(odd, vocab, flat).select(
        "doc_id", "n_tokens", F.round("log_likelihood", 2)).collect()))
    want = rows()
    monkeypatch.setattr(pseudo_lm, "HELD", 7)
    assert rows() == want and len(want) == odd.count()


def test_a_training_step_is_adagrad_on_the_whole_softmax():
    rng = np.random.default_rng(5)
    net, slow = (pseudo_lm.Network(3000) for _ in range(2))
    row = rng.integers(0, 3000, 900).astype(np.int32)
    seen = [np.zeros(s) for s in slow.shapes]
    for at in (np.arange(2, 600), np.arange(300, 898)):
        net.learn(row, at)
        sides = slow.context(row, at)
        h = np.tanh(sum(slow.embed[p][sides[:, p]] for p in range(4)).astype(float))
        cls, place = row[at] // slow.members, row[at] % slow.members
        zc = np.exp(h @ slow.out_c + slow.bias_c)
        zc = (zc / zc.sum(axis=1, keepdims=True) - np.eye(zc.shape[1])[cls]) / len(at)
        z = np.exp(np.einsum("nw,nwm->nm", h, slow.out[cls]) + slow.bias[cls])
        z = (z / z.sum(axis=1, keepdims=True) - np.eye(slow.members)[place]) / len(at)
        back = (zc @ slow.out_c.T + np.einsum("nm,nwm->nw", z, slow.out[cls])) * (1 - h * h)
        grads = [np.zeros(s) for s in slow.shapes]
        for p in range(4):
            np.add.at(grads[0][p], sides[:, p], back)
        grads[1:3] = h.T @ zc, zc.sum(axis=0)
        np.add.at(grads[3], cls, h[:, :, None] * z[:, None, :])
        np.add.at(grads[4], cls, z)
        for w, s, g in zip((slow.embed, slow.out_c, slow.bias_c, slow.out, slow.bias), seen, grads):
            s += g * g
            w -= pseudo_lm.RATE * g / np.sqrt(s + 1e-3)
    assert np.abs(net.flat - slow.flat).max() < 1e-4 < np.abs(net.flat - pseudo_lm.Network(3000).flat).max()


def test_a_large_vocabulary_costs_its_logarithm_and_sums_to_one():
    sizes = [pseudo_lm.layout(words)[0] for words in (3_000, 4_000, 50_778, 173_397, 2_000_000)]
    for words, size in zip((3_000, 4_000, 50_778, 173_397, 2_000_000), sizes):
        classes = pseudo_lm.classes_of(size)
        members = -(-size // (classes * 2 ** pseudo_lm.depth_of(size)))
        assert size == classes * members * 2 ** pseudo_lm.depth_of(size)               # no place without a token
        assert words + pseudo_lm.layout(words)[1] == size < 1.25 * words
        assert classes + members + pseudo_lm.depth_of(size) <= 64 + 66 + 12            # root of the size: 2 x 1,500
    size = pseudo_lm.layout(9_000)[0]
    net = pseudo_lm.Network(size, flat=np.random.default_rng(3).standard_normal(len(pseudo_lm.Network(size).flat)))
    assert net.depth == 2
    row = np.random.default_rng(4).integers(0, size, 5).astype(np.int32)
    rows = np.tile(row, (size, 1))
    rows[:, 2] = np.arange(size)
    every = net.log_probability(rows.ravel(), np.arange(size) * 5 + 2)
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-4)
    h = np.tanh(sum(net.embed[p][row[k]].astype(float) for p, k in enumerate((0, 1, 3, 4))))
    softmax = lambda z: np.exp(z) / np.exp(z).sum()
    vectors, bias = net.nodes
    groups = size // 4
    for t in (0, 1, 2, 3, 4_097, size - 1):                  # token by token, down its tree
        c, g = divmod(t // 4, net.members)
        want = np.log(softmax(h @ net.out_c + net.bias_c)[c] * softmax(h @ net.out[c] + net.bias[c])[g])
        for node, turn in ((t // 4, t // 2 % 2), (groups + t // 2, t % 2)):
            z = h @ vectors[node] + bias[node]
            want -= np.log1p(np.exp(-z if turn else z))
        assert every[t] == pytest.approx(want, abs=1e-4)


def test_a_training_step_is_adagrad_down_the_trees():
    size = pseudo_lm.layout(9_000)[0]
    rng = np.random.default_rng(5)
    net, slow = (pseudo_lm.Network(size) for _ in range(2))
    row = (rng.zipf(1.3, 900) % size).astype(np.int32)
    seen = [np.zeros(s) for s in slow.shapes]
    parts = (slow.embed, slow.out_c, slow.bias_c, slow.out, slow.bias, *slow.nodes)
    for at in (np.arange(2, 600), np.arange(300, 898)):
        net.learn(row, at)
        grads = [np.zeros(s) for s in slow.shapes]
        for i in at:
            sides, t = row[[i - 2, i - 1, i + 1, i + 2]], row[i]
            h = np.tanh(sum(slow.embed[p][k].astype(float) for p, k in enumerate(sides)))
            c, g = divmod(t // 4, slow.members)
            back = np.zeros(slow.width)
            for w, b, k, places in ((1, 2, c, ...), (3, 4, g, c)):
                z = np.exp(h @ parts[w][places] + parts[b][places])
                z = (z / z.sum() - np.eye(len(z))[k]) / len(at)
                grads[w][places] += np.outer(h, z)
                grads[b][places] += z
                back += parts[w][places] @ z
            for node, turn in ((t // 4, t // 2 % 2), (size // 4 + t // 2, t % 2)):
                e = (1 / (1 + np.exp(-h @ parts[5][node] - parts[6][node])) - turn) / len(at)
                grads[5][node] += e * h
                grads[6][node] += e
                back += e * parts[5][node]
            for p, k in enumerate(sides):
                grads[0][p, k] += back * (1 - h * h)
        for w, s, g in zip(parts, seen, grads):
            s += g * g
            w -= pseudo_lm.RATE * g / np.sqrt(s + 1e-3)
    assert np.abs(net.flat - slow.flat).max() < 1e-5 < np.abs(net.nodes[0] - pseudo_lm.Network(size).nodes[0]).max()


def test_sums_of_rows_and_ranks():
    rng = np.random.default_rng(6)
    for n, groups in ((1, 1), (700, 1), (700, 90), (700, 700)):
        first = np.sort(np.append(0, rng.choice(np.arange(1, n), groups - 1, replace=False)))
        x = rng.standard_normal((n, 32)).astype(np.float32)
        assert np.allclose(pseudo_lm.sums(x.copy(), first), np.add.reduceat(x, first, axis=0), atol=1e-4)
        ids = rng.integers(0, 50, n).astype(np.int32)
        ranked, order = pseudo_lm.ranked(ids)
        assert np.array_equal(order, np.argsort(ids, kind="stable")) and np.array_equal(ranked, np.sort(ids))


def test_tokens_of_words_that_are_forgotten(monkeypatch):
    vocab = {w: 64 + i for i, w in enumerate(("a", "b"))}
    text = " ".join(f"w{i} a w{i % 7} B" for i in range(400))
    want = pseudo_lm.Tokens(vocab)(text)
    monkeypatch.setattr(pseudo_lm, "OTHER_WORDS", 5)
    tokens = pseudo_lm.Tokens(vocab)
    assert all(np.array_equal(tokens(text), want) and len(tokens.ids) == 2 for _ in range(2))
    assert np.array_equal(tokens("a w3 b"), [vocab["a"], want[12], vocab["b"]])


def test_copies_are_averaged_by_their_tokens_in_few_jobs(spark):
    docs = spark.createDataFrame([(i, prose(i, 60 + 40 * (i % 3))) for i in range(30)],
                                 "doc_id long, text string").repartition(3)
    vocab, start = pseudo_lm.vocabulary(docs), pseudo_lm.Network().flat
    parts = [[r.text for r in p] for p in docs.select("text").rdd.glom().collect()]
    alone = [pseudo_lm._train_pass(spark.createDataFrame([(t,) for t in p], "text string").coalesce(1), vocab, start,
                                   "text") for p in parts if p]
    sc, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    on, before = "spark.sql.adaptive.coalescePartitions.enabled", "true"
    spark.conf.set(on, "false")
    try:
        sc.setJobGroup("lm-average", "copies averaged in several partitions")
        flat, done = pseudo_lm._train_pass(docs, vocab, start, "text")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set(on, before)
    assert done == sum(n for _, n in alone)
    assert np.abs(flat - sum(w.astype(float) * (n / done) for w, n in alone)).max() < 1e-6
    assert len(tracker.getJobIdsForGroup("lm-average")) <= 4                        # not one a partition


def test_rounds_take_turns_in_two_files_of_weights(spark):
    docs = spark.createDataFrame([(i, prose(i, 50)) for i in range(20)], "doc_id long, text string").repartition(2)
    vocab, flat = pseudo_lm.vocabulary(docs), pseudo_lm.Network().flat
    for turn in range(3):                                                           # a file a round
        flat, _ = pseudo_lm._train_pass(docs, vocab, flat, "text", turn, 3)
    folder = Path(flat.filename).parent
    before = set(folder.glob("lm-weights*"))
    again, got = pseudo_lm.train(docs, rounds=3)
    assert again == vocab and np.array_equal(got, flat)
    assert len(set(folder.glob("lm-weights*")) - before) == 2
    few = spark.createDataFrame([(0, "a")], "doc_id long, text string")             # some rounds learn nothing
    vocab, got = pseudo_lm.train(few, rounds=4)
    flat = pseudo_lm.Network().flat
    for turn in range(4):
        flat, _ = pseudo_lm._train_pass(few, vocab, flat, "text", turn, 4)
    assert np.array_equal(got, flat) and not np.array_equal(got, pseudo_lm.Network().flat)


def slow_quality(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)),
            len(covered))


def test_quality_counts_against_brute_force(spark, odd, odd_rows, empty):
    rnd = random.Random(8)
    rows = [(1000 + i, " ".join(rnd.choices(["a", "b", "c", "d|", "e\n", "\t*"], k=rnd.randint(0, 60))) or None)
            for i in range(300)]
    rows += [(r[0], r[1]) for r in odd_rows]
    q = quality.apply_rules(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "quality.*").collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in q)
    want = Counter()
    for i, t in rows:
        c = slow_quality(t)
        want[(i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert got == want
    assert all(r.kept == (not r.base_failed and not r.broken) for r in q)
    kept = quality.kept_documents(odd)
    assert kept.columns == odd.columns and {r.score for r in kept.collect()} == {9, 10, 11, 12, 13, 15}
    assert quality.apply_rules(empty).count() == 0


def test_rules_are_a_table(spark):
    docs = spark.createDataFrame([(1, prose(1, 70)), (2, prose(2, 70) + " %%%" * 40)], "doc_id long, text string")
    only = (quality.Rule("symbols", "symbols_per_word", high=0.5), quality.Rule("long", "n_words", low=75))
    got = {r.doc_id: set(r.quality.broken) for r in quality.apply_rules(docs, rules=only).collect()}
    assert got == {1: {"long"}, 2: {"symbols"}}


def test_language_sample_has_hard_bounds_and_counts_copies_once(spark, monkeypatch):
    rows = [(i, t, lang) for i, t, lang in texts_by_language()] + [(None, "one text many times over", "en")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(langid, "fit", lambda bits, langs: seen.append((bits, langs)))
    langid.train(docs, rows_per_language=15)
    bits, langs = seen[0]
    different = {(t, g) for i, t, g in rows if t and g}
    assert {g: langs.count(g) for g in set(langs)} == {
        g: min(15, sum(h == g for _, h in different)) for g in set(langs)} and len(set(langs)) > 1
    assert len({(b.tobytes(), g) for b, g in zip(bits, langs)}) >= len(langs) - 2
    langid.train(docs, train_rows=2)
    assert len(seen[1][1]) == 2


def test_thousands_of_languages(spark):
    rows = [(i, f"{w} {w[::-1]} {w}{w}", f"l{i % 3000:04d}") for i in range(6000)
            for w in ["".join(chr(97 + (i % 3000) // 26 ** k % 26) * (k + 1) for k in range(3))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert 2900 <= len(model.languages) <= 3000     # a few have held-out rows only
    got = langid.predicted(docs.limit(50), model).collect()
    assert all(r.language.lang_pred in set(model.languages) for r in got)


def test_language_fit_equals_ridge_regression_written_out():
    """The fit against normal equations in the landmark features, solved in another way."""
    rng = np.random.default_rng(3)
    presence = rng.random((30, langid._EDGES[-1])) < 0.01
    names = [["aa", "bb", "cc"][i % 3] for i in range(30)]
    model = langid.fit(presence, names, landmarks=9, ridge=0.1)
    rows = langid.kernel_rows(presence).astype(float)
    marks = np.concatenate([rows[[i for i in range(30) if names[i] == g][:3]] for g in ("aa", "bb", "cc")])
    inner = marks @ marks.T
    value, vector = np.linalg.eigh(inner)
    z = rows @ marks.T @ vector @ np.diag(value ** -0.5)
    y = np.array([[1.0 if n == g else -1.0 for g in ("aa", "bb", "cc")] for n in names])
    weight = np.sqrt(np.full(30, 1 / 30))[:, None]          # ten rows a language, three languages
    top = np.vstack([weight * z, np.sqrt(0.1 / 30) * np.eye(z.shape[1])])
    w = np.linalg.lstsq(top, np.vstack([weight * y, np.zeros((z.shape[1], 3))]), rcond=None)[0]
    assert np.allclose(rows @ model.matrix, z @ w, atol=1e-3)
