"""The segment-tree encoder against the library, on odd rows and long pieces."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parlance.llm import bpe_tree
from parlance.llm.q_bpe import op13_byte_bpe_codec

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PARTS = [" ", " ", " ", " ", "  ", "\n", "\t", "a", "the", "é", "日本", " ", "　", "12", "!!", "'s", "<|endoftext|>", " x", "\x1c",
         "\x85", ".", ",", "ing", " word,", "Überraschung", "​", "🙂", "xyzzy", "aaaa", "\x00"]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


@pytest.mark.parametrize("row_bytes,memo", [(64, 400_000), (4, 10), (4096, 1)])
def test_ids_are_the_librarys(library, row_bytes, memo):
    rnd = random.Random(1)
    texts = ["".join(rnd.choices(PARTS, k=s % 200)) for s in range(400)]
    texts += ["x" * 3000, "ab" * 2000, "日本語" * 500, "", None, "=" * 129, " " * 300]
    encoder = bpe_tree.TreeEncoder(PATH, public_tokenizers.PATTERN, memo, row_bytes)
    encoder.memo.clear()
    assert [ids(x) for x in encoder.encode(texts)] == [library.encode_ordinary(t or "") for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=90))
def test_both_trees_merge_alike(raw):
    """The tree of one piece and the trees of many rows, against the leftmost least rank looked for from scratch."""
    ranks = bpe_tree.load_ranks(PATH)
    parts = [bytes([b]) for b in raw]
    while True:
        best = min(((ranks.ids[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks.ids), default=None)
        if best is None:
            break
        parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    want = [ranks.ids[p] for p in parts]
    assert bpe_tree.merge_one(raw, ranks) == want
    if len(raw) > 1:
        assert [ids(x) for x in bpe_tree.merge_rows([raw, b"ab", raw], 128, ranks)][::2] == [want, want]


def test_equal_ranks_are_merged_from_the_left(library):
    assert library.encode_ordinary("aaaaa") == ids(bpe_tree.TreeEncoder(PATH, public_tokenizers.PATTERN).encode(["aaaaa"])[0])


def test_the_narrow_twin_cuts_like_the_pattern():
    narrow = bpe_tree.re.compile(bpe_tree.narrow_twin(public_tokenizers.PATTERN))
    wide = bpe_tree.regex.compile(public_tokenizers.PATTERN)
    plain = [chr(c) for c in range(0x2100) if not bpe_tree.BEYOND.search(chr(c))]
    for kind in (r"\p{L}", r"\p{N}", r"\s", r"\S"):
        one = bpe_tree.re.compile(bpe_tree.narrow_twin(kind))
        assert [c for c in plain if one.match(c)] == [c for c in plain if bpe_tree.regex.match(kind, c)]
    rnd = random.Random(2)
    for _ in range(3000):
        text = "".join(rnd.choices([*plain, *"  \n'tsva12"], k=12))
        assert narrow.findall(text) == wide.findall(text)
    assert bpe_tree.narrow_twin(r"\p{Han}+") is None and bpe_tree.BEYOND.search("日")


def test_a_pattern_with_groups_cuts_alike(library):
    grouped = "(" + public_tokenizers.PATTERN + ")"
    text = "it's a test, isn't it?  yes"
    assert ids(bpe_tree.TreeEncoder(PATH, grouped).encode([text])[0]) == library.encode_ordinary(text)


def test_odd_rows(odd, odd_rows, empty, library):
    out = bpe_tree.decode(bpe_tree.encode(odd, PATH, public_tokenizers.PATTERN), PATH, "ids_")
    assert out.columns == [*odd.columns, "ids_", "decoded_"]       # both names are taken in the table
    got = Counter((r.doc_id, r.text, tuple(ids(r.ids_)), bytes(r.decoded_)) for r in out.collect())
    assert got == Counter((i, t, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t, *_ in odd_rows)
    assert bpe_tree.encode(empty, PATH, public_tokenizers.PATTERN).count() == 0


def test_decoding_nulls_and_unknown_ids(spark):
    rows = spark.createDataFrame([(None,), (bytearray(b""),)], "ids binary")
    assert [r.decoded for r in bpe_tree.decode(rows, PATH).collect()] == [None, b""]
    bad = spark.createDataFrame([(bytearray(np.array([60_000], "<u4").tobytes()),)], "ids binary")
    with pytest.raises(Exception, match="60000"):
        bpe_tree.decode(bad, PATH).collect()


def test_query(spark, odd, odd_rows, library, tmp_path):
    odd.select("doc_id", "text", F.lit(1).alias("ids")).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(map(tuple, op13_byte_bpe_codec(spark, str(tmp_path)).collect()))
    want = Counter()
    for i, t, *_ in odd_rows:
        code = library.encode_ordinary(t or "")
        want[i, len(code), hashlib.sha256(np.array(code, "<u4").tobytes()).hexdigest(),
             hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
