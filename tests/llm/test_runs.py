"""Periodic runs against brute force, on odd rows and in small batches."""

import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parlance.llm import runs
from parlance.llm.q_runs import op11_periodic_runs, with_periodic_tails


def slow_runs(w: list, least: int = 12) -> list:
    """Every period by itself; the smallest one of a stretch counts."""
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(least, 2 * q):
                out.setdefault((s, i - s + q), q)
    return sorted(((s, k, q) for (s, k), q in out.items()), key=lambda r: (r[0], r[2]))


def slow_collapse(w, found):
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    return [x for i, x in enumerate(w) if i not in gone]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=12), st.integers(1, 5)), max_size=8), st.integers(2, 14))
def test_runs_equal_brute_force(blocks, least):
    w = list("".join(b * k for b, k in blocks))
    assert runs.runs_of([w], least) == [slow_runs(w, least)]


def test_many_documents_in_one_pass_do_not_mix():
    rnd = random.Random(3)
    docs = [[rnd.choice("ab") for _ in range(rnd.randint(0, 60))] for _ in range(300)] + [["x"] * 40] * 5 + [[]]
    for least in (2, 6, 12):
        assert runs.runs_of(docs, least) == [slow_runs(d, least) for d in docs]


def test_suffixes_are_in_order_with_their_common_words():
    rnd = random.Random(4)
    code = runs.np.array([rnd.randrange(3) for _ in range(500)])
    order, lcp = runs.repeated_suffixes(code, 1)
    suffix = [code[i:].tolist() for i in order]
    assert suffix == sorted(suffix)
    for a, b, n in zip(suffix, suffix[1:], lcp[1:].tolist()):
        assert a[:n] == b[:n] and a[n:n + 1] != b[n:n + 1]


def test_long_documents_stay_near_linear():
    """A word, a phrase and a line with changing heads, tens of thousands of words each."""
    n = 30_000
    assert runs.runs_of([["x"] * n]) == [[(0, n, 1)]]
    assert runs.runs_of([["x", "y", "z"] * (n // 3)]) == [[(0, n, 3)]]
    heads = [w for i in range(n // 9) for w in (f"h{i}", *"the same eight words in every single line".split())]
    assert runs.runs_of([heads]) == [[]]


def test_odd_rows(spark, odd, odd_rows, empty):
    got = runs.periodic_runs(odd.withColumn("periodic", F.lit(1)), batch_words=50)
    assert got.columns[-2:] == ["periodic", "periodic_"]
    rows = {}
    for r in got.collect():
        rows.setdefault((r.doc_id, r.text), []).append(r.periodic_)
    for i, t, *_ in odd_rows:
        w = words(t)
        for p in rows[i, t]:
            assert p.n_words == len(w) and [tuple(x) for x in p.runs] == slow_runs(w)
            assert p.collapsed == " ".join(slow_collapse(w, slow_runs(w)))
    assert sum(map(len, rows.values())) == len(odd_rows) and runs.periodic_runs(empty).count() == 0


def slow_query(doc_id, text):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = slow_runs(w)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None, None, None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2],
            digest("".join("%d,%d,%d\n" % r for r in found)), digest(" ".join(slow_collapse(w, found))))


def test_query_equals_brute_force(spark, odd_rows, tmp_path):
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 120)))) for i in range(100, 400)]
    rows += [(i, t) for i, t, *_ in odd_rows] + [(i, "so\tso so " * 9) for i in range(400, 440)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op11_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((slow_query(*r) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 60


def test_rewriting_leaves_other_documents_alone(spark):
    docs = spark.createDataFrame([(i, " a  b\tc ") for i in range(50)], "doc_id long, text string")
    for r in with_periodic_tails(docs).collect():
        assert zlib.crc32(str(r.doc_id).encode()) % 10 == 0 or r.text == " a  b\tc "
