"""The divergence audit against direct sums over all kept terms."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import divergence
from parlance.llm.q_divergence import op12_source_divergence


def slow_audit(docs, min_docs=10, top=10):
    """The contract word for word: (lang, source, part, item, value, rank)."""
    count, held, groups = Counter(), Counter(), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [re.sub("[A-Z]", lambda m: m.group().lower(), t)
                 for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        count.update((lang, source, t) for t in terms)
        held.update((lang, t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (its, t), n in held.items() if its == lang and n >= min_docs]
        sources = sorted(s for its, s in groups if its == lang)

        def p(counts):
            total = sum(counts.values())
            return {t: 1 + 10 ** 9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}
        by = {s: Counter({t: count[lang, s, t] for t in kept}) for s in sources}
        share = {s: p(by[s]) for s in sources}
        whole = p(sum(by.values(), Counter()))
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = {o: sum(apart(share[s][t], share[o][t]) for t in kept) for o in sources if o != s}
            terms = {t: apart(share[s][t], whole[t]) for t in kept if by[s][t] and share[s][t] > whole[t]}
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(items.items(), key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ordered)]
    return out


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(2)
    vocabulary = [f"{a}{b}" for a in ("Ab", "été", "zé", "İx", "日", "q") for b in "abcdefghij"]
    docs = []
    for i in range(400):
        lang, source = rnd.choice(["en", "fr", "fr", None]), rnd.choice(["s1", "s2", "s3", "s10", None])
        weights = [1 + (crc32(f"{v[-1]}{source}".encode()) % 5) * (k % 3) for k, v in enumerate(vocabulary)]
        docs.append((rnd.choice([" ", "-", "1", "\n"]).join(rnd.choices(vocabulary, weights, k=rnd.randint(0, 60))), lang, source))
    docs += [(None, "en", "empty"), ("", "xx", "only"), ("rare words here", "xx", "two"), ("[]{}09", "yy", "alone")]
    docs += [("same copy of it", "de", "one")] * 9 + [("copy copy", "de", "two"), (None, None, None)]
    return docs


def tables(spark, docs):
    return spark.createDataFrame([(i, t, s, g) for i, (t, g, s) in enumerate(docs)],
                                 "doc_id long, text string, source string, lang string").repartition(3)


def test_query_equals_direct_sums(spark, corpus, tmp_path):
    tables(spark, corpus).withColumns({c: F.lit(1) for c in ("term", "entries", "n")}).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op12_source_divergence(spark, str(tmp_path)).collect()))
    assert got == sorted(slow_audit(corpus)) and len(got) > 200


def test_small_parts_hand_on_early_and_add_up(spark, corpus, monkeypatch):
    """Counts and sums that leave a task in several parts give the same totals."""
    monkeypatch.setattr(divergence, "HELD_TERMS", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    docs = tables(spark, corpus).withColumnRenamed("lang", "tongue")
    pairs = divergence.Audit(docs, lang_col="tongue", min_docs=3).pairs()
    got = {(r.lang, r.source, r.item): r.value for r in pairs.collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {r[:2] + (r[3],): r[4] for r in slow_audit(corpus, 3) if r[2] == "pair"}


@pytest.mark.parametrize("cells", [1, 1 << 20])
def test_tree_shares_paths_and_adds_each_pair_once(cells):
    rnd = random.Random(6)
    none = {s: rnd.randint(1, 50) for s in range(4)}
    rows = Counter()
    for _ in range(300):
        rows[rnd.randrange(2), tuple((s, n, none[s] + 7 * n, none[s]) for s in none if (n := rnd.randint(0, 2)))] += rnd.randint(1, 3)
    f = lambda x, y: (x - y) ** 2 // (x + y)
    want, ordered = Counter(), sorted(rows.items())
    for (group, row), times in ordered:
        for i, (b, _, p, z) in enumerate(row):
            for a, _, q, y in row[:i]:
                want[group, a, b] += times * (f(p, q) - f(p, y) - f(z, q) + f(z, y))
    flat = np.array([e for (_, row), _ in ordered for e in row])
    starts = np.cumsum([0] + [len(row) for (_, row), _ in ordered])
    group, times = np.array([g for (g, _), _ in ordered]), np.array([t for _, t in ordered])
    same = flat[:, 0] * 10 + flat[:, 1]
    got = Counter()
    for part in divergence.tree_sums(starts, group, same, times, flat[:, 0], flat[:, 2], flat[:, 3], cells):
        for g, a, b, v in zip(*(x.tolist() for x in part)):
            got[g, a, b] += v
    assert got == want
    # a node is a distinct path, its multiplicity that of all rows through it
    nodes = Counter()
    for (g, row), t in ordered:
        for d in range(1, len(row)):
            nodes[g, row[:d + 1]] += t
    tree = divergence.PatternTree(starts, group, same, times)
    assert sorted(nodes.values()) == sorted(t for _, _, many in tree.levels() for t in many.tolist())


def test_empty_table(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert op12_source_divergence(spark, str(tmp_path)).count() == 0
