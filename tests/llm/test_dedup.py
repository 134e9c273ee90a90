"""SimHash groups, shards and leaks against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from parlance.llm import components, decontam, shards, simhash

from .conftest import prose


def slow_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_groups(values, radius):
    """Index of the group's first member, for every value, from all pairs."""
    group = list(range(len(values)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= radius:
                a, b = sorted((find(i), find(j)))
                group[b] = a
    return [find(i) for i in range(len(values))]


def test_close_lanes_are_the_close_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(-2**62, 2**62, 6)
    fp = np.array([int(base[i % 6]) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False) if b < 63)
                   for i in range(200)], dtype=np.int64)
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.pad(np.packbits(bits.T, axis=1, bitorder="little"), ((0, 0), (0, 80)))
    for radius in (0, 1, 2, 3, 5):
        for d in (1, 2, 7, 8, 50):
            ok = np.ones(200 - d, dtype=bool)
            got = simhash.close_lanes(fp, ok, planes, d, radius).tolist()
            assert got == [i for i in range(200 - d) if np.bitwise_count(fp[i] ^ fp[i + d]) <= radius]


@pytest.mark.parametrize("bucket", [256, 3])
def test_links_lose_nothing(spark, bucket):
    rnd = random.Random(bucket)
    centre = rnd.getrandbits(64)
    values = {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for _ in range(250)}
    values |= {rnd.getrandbits(64) for _ in range(50)} | {0, 1, 3, 7}
    values = sorted(simhash._signed(v) for v in values)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    found = {r.node: r.root for r in components.components(simhash.links(fps, 2, bucket)).collect()}
    want = slow_groups([v & simhash._ALL for v in values], 2)
    assert [found.get(v, v) for v in values] == [values[g] for g in want]


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def edited(text, seed):
    rnd = random.Random(seed)
    words = text.split()
    words[rnd.randrange(len(words))] = "changed"
    return " ".join(words)


def test_near_duplicates_of_documents(spark, odd, odd_rows, empty):
    texts = [t for _, t, *_ in odd_rows] + [prose(s, 400) for s in range(10)]
    texts += [edited(prose(s, 400), s + k) for s in range(10) for k in range(4)]
    rows = [(100 - i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.fp, r.component_id) for r in
           simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    groups, least = slow_groups(fps, 2), defaultdict(lambda: 10**9)
    for (i, _), g in zip(rows, groups):
        least[g] = min(least[g], i)
    assert got == {i: (simhash._signed(f), least[g]) for (i, _), f, g in zip(rows, fps, groups)}
    assert simhash.near_duplicates(empty).count() == 0


def test_deduplicated_keeps_one_row_of_each_group(odd, odd_rows, empty):
    fps = [slow_fingerprint(t) for _, t, *_ in odd_rows]
    want = len(set(slow_groups(fps, 2)))
    out = simhash.deduplicated(odd)
    assert out.columns == odd.columns
    assert out.count() == want                                      # with repeated and null ids
    plain = odd.filter("doc_id is not null and (doc_id != 9 or score = 9)")
    assert {r.doc_id for r in simhash.deduplicated(plain).collect()} <= {r[0] for r in odd_rows}
    assert simhash.deduplicated(empty).count() == 0


def test_deduplicated_keeps_a_group_whose_id_is_gone_elsewhere(spark):
    a, b, c, d = (prose(s, 80) for s in (21, 22, 23, 24))
    schema = "doc_id long, text string"
    for rows, groups in (([(5, c), (5, d), (4, d)], {c, d}),                        # 5 leaves d, and is all of c
                         ([(None, a), (None, b), (3, b)], {a, b}),                  # the same with null ids
                         ([(5, c), (5, d), (4, d), (None, a), (None, b), (3, b)], {a, b, c, d})):
        got = simhash.deduplicated(spark.createDataFrame(rows, schema)).collect()
        assert sorted(r.text for r in got) == sorted(groups)
        assert {(r.doc_id, r.text) for r in got} <= set(rows)
    got = simhash.deduplicated(spark.createDataFrame([(5, c), (6, d), (4, d), (None, a), (3, a)], schema)).collect()
    assert {(r.doc_id, r.text) for r in got} == {(5, c), (4, d), (3, a)}            # unique ids: the least of each group


def test_shards_are_even_and_gapless(spark, odd, odd_rows, empty):
    rnd = random.Random(1)
    texts = [prose(s, rnd.randint(1, 60)) for s in range(300)] + ["hot text " * 5] * 400 + [prose(9, 12)] * 9
    rows = [(i, t) for i, t in enumerate(texts)]
    got = shards.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    by_shard, by_text = defaultdict(list), defaultdict(set)
    for r in got:
        assert r["size"] == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        by_shard[r.shard].append(r)
        by_text[texts[r.doc_id]].add(r.shard)
    loads = [sum(r["size"] for r in s) for s in by_shard.values()]
    assert len(loads) == 5 and max(loads) - min(loads) < 0.05 * max(loads)
    for s in by_shard.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
    assert len(by_text[prose(9, 12)]) == 1                          # equal texts stay together
    out = shards.assign_shards(odd, 4).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in odd_rows)
    assert shards.assign_shards(empty, 4).count() == 0


def distance_inside(item, text):
    """Fewest edits that turn the item into some part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def test_leaks_are_the_occurrences_within_the_edit_bound():
    rnd = random.Random(4)
    items = [(i, prose(100 + i, 20 + i)) for i in range(12)]
    index = decontam.Index(items)
    for trial in range(80):
        i = rnd.randrange(len(items))
        s = list(items[i][1])
        for _ in range(rnd.randint(0, len(s) // 9)):
            p = rnd.randrange(len(s))
            s[p:p + 1] = rnd.choice([[], [rnd.choice("abcxyz ")], [s[p], rnd.choice("qvw")]])
        text = prose(200 + trial, 40) + " " + "".join(s) + " " + prose(300 + trial, 40)
        c, _ = index.normal(text)
        _, item, k, _, _ = index.items[i]
        want = distance_inside(item.tolist(), c.tolist())
        hits = [h for h in index.leaks(text) if h[0] == i]
        assert bool(hits) == (want <= k)
        if hits:
            assert min(h[3] for h in hits) == want
            a, b = hits[0][1:3]
            assert abs((b - a) - len("".join(s).strip())) <= 2 * k + 4


def test_leaks_on_tables(spark, odd, empty):
    item = prose(50, 30)
    items = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "tiny"), (11, item.upper())], "item_id long, text string")
    docs = spark.createDataFrame([(1, prose(1, 50) + "\n" + item.replace(" ", " - ") + prose(2, 5), 5), (2, prose(3, 90), 6),
                                  (3, None, 7), (4, item + " " + item, 8), (4, item + " " + item, 8)],
                                 "doc_id long, text string, item_id long")
    for block in (decontam.INDEX_CHARS, 100):           # one block, and several
        got = Counter((r.doc_id, r.item_id) for r in decontam.find_leaks(docs, items, index_chars=block).collect())
        assert got == {(1, 7): 1, (1, 11): 1, (4, 7): 4, (4, 11): 4}
        kept = decontam.clean_documents(docs, items, index_chars=block)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert decontam.find_leaks(odd, items.limit(0)).count() == 0
    assert decontam.clean_documents(odd, items).count() == odd.count()
    assert decontam.find_leaks(empty, items).count() == 0


def test_shards_spread_a_text_whose_ids_are_null_or_equal(spark):
    """A third of all rows equal in text, with null ids, one id, or ids of their own."""
    for hot in (None, 7, "own"):
        rows = [(i if hot == "own" else hot, "the same words again " * 10) for i in range(1000)]
        rows += [(10_000 + i, f"text {i} " * (1 + i % 40)) for i in range(2000)]
        got = shards.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
        assert len(got) == len(rows)
        load, slots = {}, {}
        for r in got:
            load[r.shard] = load.get(r.shard, 0) + r["size"]
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert len(load) == 10 and max(load.values()) < 1.05 * min(load.values())


def test_shards_when_every_row_is_the_same(spark):
    got = shards.assign_shards(spark.createDataFrame([(None, None)] * 1000, "doc_id long, text string"), 4).collect()
    load = [sum(r.shard == s for r in got) for s in range(4)]
    assert sum(load) == 1000 and max(load) < 1.1 * min(load)
