"""Token counts, packed ids, pieces: against the libraries, on odd rows and in small chunks."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from parlance.llm import packed_ids, sp_codec, token_counts
from parlance.llm.units import UnitEncoder

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "\t", "a", "the", "é", "日本", " ", "　", "12", "!!", "'s", "<|endoftext|>", " x", "\x1c",
         "\x85", ".", ",", "ing", " word,", " end."]


def mixed(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return "".join(rnd.choices(PARTS, k=n))


@pytest.fixture(scope="module")
def bpe():
    return Tokenizer.from_file(BPE)


def library(bpe, text):
    return bpe.encode(text or "", add_special_tokens=False)


@pytest.mark.parametrize("chunk,overlap", [(60, 8), (200, 30), (10_000, 100)])
def test_chunks_give_the_library_ids_and_offsets(bpe, chunk, overlap):
    counter = token_counts.ChunkedCounter(BPE, chunk, overlap)
    texts = [mixed(s, s % 300) for s in range(400)] + ["word " * 3000, "x" * 700, ""]
    assert counter.counts(texts) == [len(library(bpe, t).ids) for t in texts]
    for t in texts:
        e = library(bpe, t)
        ids, starts = counter.long(t)
        assert ids.tolist() == e.ids and starts.tolist() == [a for a, _ in e.offsets]


def test_overlaps_are_widened_where_nothing_is_stable(bpe):
    counter = token_counts.ChunkedCounter(BPE, 50, 5)
    text = "x" * 400 + " y z"
    assert len(counter.long(text)[0]) == len(library(bpe, text).ids) and counter.widened > 0


def test_counts_of_odd_rows(odd, odd_rows, bpe, empty):
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(odd, BPE).collect())
    assert got == Counter((i, len((t or "").encode()), len(library(bpe, t).ids)) for i, t, *_ in odd_rows)
    assert token_counts.token_counts(empty, BPE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 31), st.integers(0, 500), st.integers(0, 2**32 - 1), st.sampled_from([8, 64, 4096]))
def test_packing_round_trip_and_random_access(bits, n, seed, block):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, 1 << bits, n)
    segment = packed_ids.write_segment(ids, bits, block)
    assert (packed_ids.read_range(segment) == ids).all()
    a = int(rng.integers(0, n + 1))
    assert (packed_ids.read_range(segment, a, 37) == ids[a:a + 37]).all()


def test_packed_size_is_the_fewest_bits():
    assert [packed_ids.bits_for(v) for v in (2, 3, 256, 257, 50_257)] == [1, 2, 8, 9, 16]
    assert len(packed_ids.pack(np.zeros(8000, np.int64), 9)) == 9000


def test_joined_crc():
    a, b = b"some bytes", b"and others" * 99
    assert packed_ids.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert packed_ids.crc32_joined(zlib.crc32(a), 0, 0) == zlib.crc32(a)


@pytest.mark.parametrize("segment", [50, 1 << 20])
def test_packed_documents(odd, odd_rows, bpe, empty, segment, monkeypatch):
    monkeypatch.setattr(packed_ids, "SEGMENT_TOKENS", segment)
    rows = odd.filter("doc_id is not null").filter("doc_id != 9 or score = 9")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in packed_ids.packed_documents(rows, BPE).collect()}
    want, start = {}, 0
    for i, t, *_ in sorted((r for r in odd_rows if r[0] is not None and (r[0] != 9 or r[4] == 9)), key=lambda r: r[0]):
        ids = library(bpe, t).ids + [0]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want
    assert packed_ids.packed_documents(empty, BPE).count() == 0


def test_packed_repeats_and_null_ids_are_all_there(odd, odd_rows):
    got = packed_ids.packed_documents(odd, BPE).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in odd_rows)
    spans = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[0][0] == 0


@pytest.fixture(scope="module")
def pieces():
    return sp_codec.PieceModel(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_merging_pass_gives_the_library_ids(pieces):
    model, lib = pieces
    rnd = random.Random(5)
    texts = [mixed(s, s % 120) for s in range(300)]
    texts += ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyzABCé     .,", k=rnd.randint(0, 40))) for _ in range(1500)]
    for t in texts:
        ids = model.encode(t).tolist()
        assert ids == lib.encode(t)
        assert model.decode(ids) == t


def best(pieces: dict, unknown: float, text: str) -> float:
    """Greatest summed score over all segmentations, by the textbook table."""
    top = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            score = pieces.get(text[start:end], unknown if end - start == 1 else float("-inf"))
            top[end] = max(top[end], top[start] + score)
    return top[-1]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("abc▁", min_size=1, max_size=4), st.floats(-20, 0), min_size=1, max_size=15),
       st.text("abcd▁", max_size=25))
def test_viterbi_finds_the_best_score(rows, text):
    model = sp_codec.PieceModel.of(sorted(rows.items()))
    ids, score = model.viterbi(text)
    assert score == pytest.approx(best(rows, model.unknown, text))
    assert b"".join(model.raw[i] for i in ids).decode() == text.replace("▁", " ")


def one_by_one(model, parts: list[str]) -> list[tuple]:
    """What ``_side_by_side`` gives, by ``segment`` of each part alone."""
    return [model._part(p) for p in parts]


def test_parts_side_by_side_are_the_parts_alone(pieces):
    model, _ = pieces
    rnd = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzABCéäñ.,"
    parts = ["▁" * rnd.randint(0, 2) + "".join(rnd.choices(letters, k=rnd.randint(1, 60))) for _ in range(3000)]
    parts += ["▁", "a", parts[0], "thethethethe", "▁information"]
    assert model.singles.issuperset(letters + "▁")
    assert model._side_by_side(parts) == one_by_one(model, parts)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text("abc▁", min_size=2, max_size=4), st.integers(-20, 0), max_size=15),
       st.lists(st.text("abc▁", min_size=1, max_size=25), min_size=1, max_size=12))
def test_parts_side_by_side_of_small_models_with_ties(rows, parts):
    model = sp_codec.PieceModel.of(sorted(({c: -9 for c in "abc▁"} | rows).items()))
    assert model._side_by_side(parts) == one_by_one(model, parts)


def test_units_of_many_texts_and_a_small_memo(pieces, monkeypatch):
    """Groups, blocks and a memo far smaller than the texts, parts longer than SHORT, characters without a piece."""
    model, lib = sp_codec.PieceModel(PIECES), pieces[1]
    monkeypatch.setattr(sp_codec, "GROUP", 300)
    monkeypatch.setattr(sp_codec, "BLOCK", 50)
    model.memo, model.memo_units = {}, 40
    rnd = random.Random(9)
    texts = [mixed(s, s % 80) for s in range(200)] + ["ab" * 200, "", "  ", "\x00a\x00 \x00", "x\n\n y\U0001f984z ▁q"]
    texts += ["".join(rnd.choices("abcdeéß \n", k=rnd.randint(0, 90))) for _ in range(200)]
    assert [x.tolist() for x in model.encode_all(texts)] == [lib.encode(t) for t in texts]
    for t, (ids, best_ids, _) in zip(texts, model.best_scores(texts)):
        assert ids.tolist() == lib.encode(t) and model.decode(best_ids.tolist()) == t.replace("▁", " ")


def test_encoded_and_decoded_columns(odd, odd_rows, empty):
    out = sp_codec.decoded(sp_codec.encoded(odd, PIECES), PIECES, "ids_")
    assert {"ids", "ids_", "decoded", "decoded_"} <= set(out.columns)
    got = Counter((r.doc_id, r.decoded_) for r in out.collect())
    assert got == Counter((i, (t or "").replace("▁", " ")) for i, t, *_ in odd_rows)
    summary = sp_codec.encoded_summary(odd, PIECES).collect()
    assert len(summary) == len(odd_rows) and all(r.round_trip for r in summary)
    assert sp_codec.encoded_summary(empty, PIECES).count() == 0


UNITS = ["Word.", "end,", "a.\nThe", "Über!!\nÄnd,", "don't", "it's.", "x'\ns", "s'.\nt", "Un,&&&", "\n\nA", "b\n\nC", "d.\n\nE.",
         "日本.", "é́.", "12.\nTwo", "a1.", "q.\n", "\nq", "", "Žluť?\nǅ", "ªb.", "m×n.", "(p)", "R.\nS.\nT", "we'll.\nI'd"]


def texts_of_units(n: int) -> list[str]:
    rnd = random.Random(8)
    return ["", " ", "first.\nSecond third"] + [" ".join(rnd.choices(UNITS, k=rnd.randint(1, 40))) for _ in range(n)]


def test_units_cut_into_parts_and_gathered_give_the_library_ids(bpe):
    texts = texts_of_units(700) + [mixed(s, s % 200) for s in range(200)]
    ids = UnitEncoder(BPE, "test ids", lambda ids, starts: ids.astype("<u4").tobytes(), lambda x, y, n: x + y,
                      many=packed_ids.stretches, memo_units=20)
    want = [library(bpe, t).ids for t in texts]
    for _ in range(2):                                      # the second time with a memo, and past its bound
        assert [np.frombuffer(x, "<u4").tolist() for x in ids.encoded(texts)] == want
    counter = token_counts.ChunkedCounter(BPE)
    assert counter.counts(texts) == [len(w) for w in want]
    for t in texts[:200]:
        got, starts = counter.encode(t)
        assert (got.tolist(), starts.tolist()) == (library(bpe, t).ids, [a for a, _ in library(bpe, t).offsets])


def test_the_library_is_asked_once_for_a_part_and_for_what_a_full_memo_is_needed_for():
    enc = UnitEncoder(BPE, "test asked", lambda ids, starts: ids.tolist(), lambda x, y, n: x + y, memo_units=3)
    asked, ask = [], enc._ask
    enc._ask = lambda words, *lead: (asked.extend(words), ask(words, *lead))
    enc.learn([enc.units("x alpha beta gamma delta")])
    enc.learn([enc.units("x alpha.\nbeta, beta!! gamma,&&& delta alpha.")])
    assert not [w for w in asked if not w.isalpha()] and Counter(asked)["delta"] == 1
