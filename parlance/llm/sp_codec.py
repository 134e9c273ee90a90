"""SentencePiece encoding and decoding by an Aho-Corasick automaton and one Viterbi pass.

The pieces of a model are the patterns of an automaton.  A text in the model's
form (a space is U+2581, one is put in front) is cut where a non-space is
followed by a space; no piece crosses that cut, so the best segmentation is the
sum of the units' best ones; a unit is cut again between two characters that
no piece has side by side.  A part is read once: at each position the
automaton's output links give every piece that ends there, longest first, and
each relaxes the best score at that position with the score at its start plus
its own.  A character that no piece covers takes the unknown penalty and is
written as its UTF-8 bytes' pieces.  Ties keep the longer last piece.

What is relaxed depends on the model's kind.  A unigram model's ids are the
segmentation of greatest summed score.  A BPE model's scores are merge ranks,
whose sum means nothing to the model: there the pass keeps, at each position,
the piece that merging would leave last, which is the one piece that stands the
merges next to the last piece of the prefix before it (``stands``); the ids are
the library's.  ``best_score`` gives the greatest-sum segmentation for either
kind; both decode to the same text.

Units seen by a Python worker are remembered in a memo of bounded size.  New
ones are cut all at once, and their short parts share one automaton pass: a
step relaxes, in numpy, the matches that end at the same position of every part
(``_side_by_side``; ``segment`` is the same rule for one part of any length).

Defined cases: null and empty texts have no ids and decode to the empty text;
U+2581 in a text comes back as a space, as in the library; ties and repeated
rows give equal ids; extra columns are kept by ``encoded`` (a column named
like the result makes the result's name end in underscores); an empty table
gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, whole_text, worker_store

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
MEMO_UNITS = 250_000    # about 100 MB a worker
SHORT = 64              # characters of a part that is segmented beside others
BLOCK = 200_000         # characters segmented side by side, about 60 MB of arrays
GROUP = 500_000         # characters of the texts whose units are looked up together
_EDGE, _OPEN = -1, -2
_UNIT = re.compile(r" +[^ ]*|[^ ]+")


class PieceModel:
    """The pieces of a model file, their automaton, and the two directions."""

    memo_units = MEMO_UNITS

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown_id = sp.unk_id()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self._set([(sp.id_to_piece(i), i, sp.get_score(i)) for i in plain])
        ranks = [s for s in self.score.values() if s > -1e8]
        self.merging = len(set(ranks)) == len(ranks) and all(s <= 0 and s == int(s) for s in ranks)
        self.memo = worker_store("pieces", f"memo {path}")

    @classmethod
    def of(cls, pieces: list[tuple[str, float]], byte_fallback: bool = True,
           merging: bool = False) -> PieceModel:
        """A model from (piece, score) rows; ids 0 .. are unknown, the bytes, the pieces."""
        self = cls.__new__(cls)
        self.unknown_id, first = 0, 1
        self.byte_id = {b: first + b for b in range(256)} if byte_fallback else {}
        first += len(self.byte_id)
        self._set([(p, first + i, s) for i, (p, s) in enumerate(pieces)])
        self.merging, self.memo = merging, {}
        return self

    def _set(self, rows: list[tuple[str, int, float]]) -> None:
        self.auto = ahocorasick.Automaton()
        for piece, i, score in rows:
            self.auto.add_word(piece, i)
        self.auto.make_automaton()
        size = max((i for _, i, _ in rows), default=0) + 1
        self.size_of, self.score_of = np.zeros(size, np.int64), np.zeros(size)
        for piece, i, score in rows:
            self.size_of[i], self.score_of[i] = len(piece), score
        self.sizes, self.scores = self.size_of.tolist(), self.score_of.tolist()
        self.singles = {p for p, _, _ in rows if len(p) == 1}
        self.unknown = min((s for _, _, s in rows), default=0.0) - UNKNOWN_PENALTY
        self.score = {p: s for p, _, s in rows}
        self.joints = {p[k - 1:k + 1] for p in self.score for k in range(1, len(p))}
        self.joint_keys = np.array(sorted((ord(a) << 21) + ord(b) for a, b in self.joints) + [1 << 62], np.int64)
        used = set().union(*self.score) if self.score else set()
        self.gap = next(c for c in map(chr, range(len(used) + 1)) if c not in used)
        self.name = {i: p for p, i, _ in rows}
        self.pairs: dict[int, bool] = {}
        self.raw = {i: p.replace(SPACE, " ").encode() for p, i, _ in rows}
        self.raw |= {i: bytes([b]) for b, i in self.byte_id.items()}
        self.raw[self.unknown_id] = " ⁇ ".encode()
        self.raw_of = np.array([self.raw.get(i, b"") for i in range(max(self.raw) + 1)], dtype=object)

    def _cut(self, units: list[str]) -> tuple[list[str], list[int]]:
        """The units cut where no piece has the two characters side by side (leading spaces stay with what follows):
        all parts in order, and for each unit the number of parts up to its end."""
        text = "".join(units)
        ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        pair = (code[:-1] << 21) + code[1:]
        cut = (self.joint_keys[np.searchsorted(self.joint_keys, pair)] != pair) & (code[:-1] != ord(" "))
        cut[ends[:-1] - 1] = True
        stops = np.append(np.flatnonzero(cut) + 1, len(text))
        places = stops.tolist()
        return ([text[a:b] for a, b in zip([0] + places[:-1], places)],
                np.searchsorted(stops, ends, side="right").tolist())

    def merged(self, text: str) -> list[str]:
        """The pieces that merging leaves of a short text: the best-scored neighbour pair first, leftmost on ties."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stands(self, left: int, right: int) -> bool:
        """Whether two neighbouring pieces are what merging leaves of their text (left below 0: right alone)."""
        key = (left << 32) + right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.memo_units:
                self.pairs.clear()
            two = [self.name[left], self.name[right]] if left >= 0 else [self.name[right]]
            known = self.pairs[key] = self.merged("".join(two)) == two
        return known

    def segment(self, unit: str) -> tuple[list[int] | None, list[int], float]:
        """One pass over a unit (in the model's form): ids that merging gives (None for a unigram model), ids of the
        best-scored segmentation, its score."""
        n = len(unit)
        best, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
        # last[e]: id of the piece that merging leaves last in the prefix e; start of the unit and characters without
        # a piece, which never merge, are _EDGE; None: not known (yet)
        last: list[int | None] = [_EDGE] + [None] * n
        size_of = [0] * (n + 1)
        gaps = [] if self.singles.issuperset(unit) else [i for i, c in enumerate(unit) if c not in self.singles]
        gap, merging, pairs = 0, self.merging, self.pairs
        sizes, scores = self.sizes, self.scores
        for end, i in self.auto.iter(unit):
            while gap < len(gaps) and gaps[gap] <= end:      # unknown characters up to here, in order
                self._unknown(best, back, last, size_of, gaps[gap])
                gap += 1
            to, size = end + 1, sizes[i]
            start = to - size
            s = best[start] + scores[i]
            if s > best[to]:
                best[to], back[to] = s, (size, i)
            if merging and last[to] is None:
                left = last[start]
                if left is not None:
                    known = pairs.get((left << 32) + i)
                    if self.stands(left, i) if known is None else known:
                        last[to], size_of[to] = i, size
        for at in gaps[gap:]:
            self._unknown(best, back, last, size_of, at)
        ids, at = [], n
        while at:
            size, i = back[at]
            if i is None:
                ids.extend(reversed(self._bytes(unit[at - 1])))
            else:
                ids.append(i)
            at -= size
        if not merging:
            return None, ids[::-1], best[n]
        own, at = [], n
        while at:
            if last[at] >= 0:
                own.append(last[at])
            else:
                own.extend(reversed(self._bytes(unit[at - 1])))
            at -= size_of[at]
        return own[::-1], ids[::-1], best[n]

    def viterbi(self, unit: str) -> tuple[list[int], float]:
        """Ids and score of the best-scored segmentation of a unit."""
        return self.segment(unit)[1:]

    def _unknown(self, best, back, last, size_of, at) -> None:
        s = best[at] + self.unknown
        if s > best[at + 1]:
            best[at + 1], back[at + 1] = s, (1, None)
        last[at + 1], size_of[at + 1] = _EDGE, 1

    def _bytes(self, char: str) -> list[int]:
        return [self.byte_id[b] for b in char.replace(SPACE, " ").encode()] if self.byte_id else [self.unknown_id]

    def _side_by_side(self, parts: list[str]) -> list[tuple[bytes, bytes, float]]:
        """``segment`` of many parts of at most SHORT characters, each of which is a piece.

        The parts are one text with a character between them that no piece has; a place of that text is a prefix of
        its part.  Matches are taken in order of the prefix's length, so what they start from is settled.
        """
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        first = np.cumsum(size + 1) - size - 1
        found = self.auto.iter(self.gap.join(parts))
        to, ids = np.fromiter(chain.from_iterable(found), np.int64).reshape(-1, 2).T
        to = to + 1
        level = (np.arange((size + 1).sum()) - np.repeat(first, size + 1))[to]
        order = np.argsort(level.astype(np.uint8), kind="stable")      # matches of one place stay together, longest first
        bounds = np.cumsum(np.bincount(level, minlength=SHORT + 1)).tolist()
        ids, to = ids[order], to[order]
        start, score = to - self.size_of[ids], self.score_of[ids]
        best, back = np.full((size + 1).sum(), -np.inf), np.zeros((size + 1).sum(), np.int64)
        last, own = np.full(len(best), _OPEN, np.int64), np.zeros(len(best), np.int64)
        best[first], last[first] = 0.0, _EDGE
        pairs = self.pairs
        for a, b in zip(bounds, bounds[1:]):
            if a == b:
                break
            t, s = to[a:b], best[start[a:b]] + score[a:b]
            heads = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            top = np.repeat(np.maximum.reduceat(s, heads), np.diff(np.append(heads, b - a)))
            hit = np.flatnonzero(s == top)
            hit = hit[np.append(True, t[hit[1:]] != t[hit[:-1]])]
            best[t[hit]], back[t[hit]] = s[hit], hit + a
            if self.merging:
                left = last[start[a:b]]
                able = np.flatnonzero(left != _OPEN)
                stood, done = [], -1
                for j, place, key in zip(able.tolist(), t[able].tolist(),
                                         ((left[able] << 32) + ids[a:b][able]).tolist()):
                    if place != done:
                        known = pairs.get(key)
                        if self.stands(key >> 32, key & 0xFFFFFFFF) if known is None else known:
                            stood.append(j)
                            done = place
                stood = np.array(stood, np.int64)
                last[t[stood]], own[t[stood]] = ids[a:b][stood], stood + a
        greatest = _walked(back, start, ids, first, size)
        return list(zip(_walked(own, start, ids, first, size) if self.merging else greatest, greatest,
                        best[first + size].tolist()))

    def _learn(self, units: list[str]) -> None:
        """Remember units that the memo lacks."""
        parts, ends = self._cut(units)
        memo, short, n = self.memo, [], 0
        for p in dict.fromkeys(parts):
            if p in memo:
                continue
            own = p.replace(" ", SPACE)
            if len(p) > SHORT or not self.singles.issuperset(own):
                memo[p] = self._part(own)
                continue
            short.append((p, own))
            n += len(p)
            if n >= BLOCK:
                memo.update(zip([x for x, _ in short], self._side_by_side([x for _, x in short])))
                short, n = [], 0
        if short:
            memo.update(zip([x for x, _ in short], self._side_by_side([x for _, x in short])))
        at = 0
        for u, end in zip(units, ends):
            if end - at > 1:
                got = [memo[p] for p in parts[at:end]]
                memo[u] = b"".join([g[0] for g in got]), b"".join([g[1] for g in got]), sum([g[2] for g in got])
            at = end

    def _part(self, part: str) -> tuple[bytes, bytes, float]:
        own, best, score = self.segment(part)
        best = array("i", best).tobytes()
        return best if own is None else array("i", own).tobytes(), best, score

    def _coded(self, texts: list[str]) -> Iterator[list[tuple[bytes, bytes, float]]]:
        """For each text its units': ids of the model's kind, ids of the best score, that score."""
        at = 0
        while at < len(texts):
            units, n = [], 0
            while at < len(texts) and n < GROUP:
                t = texts[at]
                units.append(_UNIT.findall(" " + t.replace(SPACE, " ")) if t else [])
                n += len(t)
                at += 1
            new = set(chain.from_iterable(units)).difference(self.memo)
            if new and len(self.memo) + len(new) > self.memo_units:
                self.memo.clear()
                new = set(chain.from_iterable(units))
            if new:
                self._learn(list(new))
            for us in units:
                yield [self.memo[u] for u in us]

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids (int32) of each whole text."""
        for got in self._coded(texts):
            yield np.frombuffer(b"".join([g[0] for g in got]), np.int32)

    def encode(self, text: str) -> np.ndarray:
        """Ids (int32) of a whole text."""
        return next(self.encode_all([text]))

    def best_scores(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """For each text: ids as ``encode`` gives them, ids of the greatest summed score, and that score."""
        for got in self._coded(texts):
            own, best, scores = zip(*got) if got else ((), (), ())
            yield (np.frombuffer(b"".join(own), np.int32), np.frombuffer(b"".join(best), np.int32),
                   float(sum(scores)))

    def decoded_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of the model's own ids, with the space put in front."""
        return b"".join(self.raw_of[ids].tolist())

    def decode(self, ids) -> str:
        """The text of a sequence of ids, without the space put in front; bytes that are no UTF-8 become U+FFFD."""
        raw = self.raw
        return b"".join([raw.get(i, b"") for i in ids]).decode("utf-8", "replace").removeprefix(" ")


def _walked(back, start, ids, first, size) -> list[bytes]:
    """The ids (int32) on the way back from each part's end to its first place."""
    now, who, steps = first + size, np.arange(len(first)), []
    while len(who):
        match = back[now]
        steps.append((who, ids[match]))
        now = start[match]
        more = now > first[who]
        now, who = now[more], who[more]
    who, ids = (np.concatenate(x) for x in zip(*reversed(steps)))
    flat = ids[np.argsort(who, kind="stable")].astype(np.int32).tobytes()
    stops = (4 * np.cumsum(np.bincount(who, minlength=len(first)))).tolist()
    return [flat[a:b] for a, b in zip([0] + stops[:-1], stops)]


def load_model(path: str, memo_units: int = MEMO_UNITS) -> PieceModel:
    kept = worker_store("pieces", "models")
    if path not in kept:
        kept[path] = PieceModel(path)
    kept[path].memo_units = memo_units
    return kept[path]


def encoded(docs: DataFrame, model_path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with an array column of ids."""
    out = free_name(docs, out)

    @F.pandas_udf("array<int>")
    def ids(text: pd.Series) -> pd.Series:
        model = load_model(model_path)
        return pd.Series(list(model.encode_all(text.tolist())), dtype=object)

    return docs.withColumn(out, ids(whole_text(f"`{text_col}`")))


def encoded_and_checked(docs: DataFrame, model_path: str, text_col: str = "text", out: str = "ids",
                        check: str = "round_trip") -> DataFrame:
    """``docs`` with the ids and whether they decode to the text, both made in one pass of one worker."""
    out, check = free_name(docs, out), free_name(docs, check)
    pair = free_name(docs, "coded")

    def run(text: pd.Series) -> pd.DataFrame:
        model = load_model(model_path)
        ids = list(model.encode_all(text.tolist()))
        same = [model.decode(i.tolist()) == t.replace(SPACE, " ") for i, t in zip(ids, text)]
        return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "same": pd.Series(same, dtype=bool)})

    udf = F.pandas_udf(run, "ids array<int>, same boolean")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return docs.withColumn(pair, udf(whole_text(f"`{text_col}`"))).select(
        *kept, F.col(pair)["ids"].alias(out), F.col(pair)["same"].alias(check))


def decoded(rows: DataFrame, model_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of an id array (null: null)."""
    out = free_name(rows, out)

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        model = load_model(model_path)
        return pd.Series([None if x is None else model.decode(x.tolist()) for x in ids], dtype=object)

    return rows.withColumn(out, text(F.col(f"`{ids_col}`")))


def encoded_summary(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                    memo_units: int = MEMO_UNITS) -> DataFrame:
    """doc_id, n_chars, n_tokens, ids_crc32, best_score, best_score_tokens, best_score_crc32, round_trip.

    crc32 is over the ids as little-endian unsigned 32-bit numbers; round_trip: both sequences decode to the text.
    """

    def run(batches):
        model = load_model(model_path, memo_units)
        for b in batches:
            rows = []
            texts = b["text"].tolist()
            for t, (ids, best, score) in zip(texts, model.best_scores(texts)):
                back = (" " + t.replace(SPACE, " ")).encode() if t else b""
                rows.append((len(t), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), score, len(best),
                             zlib.crc32(best.astype("<u4").tobytes()),
                             model.decoded_bytes(ids) == back and model.decoded_bytes(best) == back))
            yield pd.DataFrame({"doc_id": b["doc_id"], **{c: [r[i] for r in rows] for i, c in enumerate(names)}})

    names = ("n_chars", "n_tokens", "ids_crc32", "best_score", "best_score_tokens", "best_score_crc32", "round_trip")
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, n_chars long, n_tokens long, ids_crc32 long, best_score double, "
                                 "best_score_tokens long, best_score_crc32 long, round_trip boolean")
