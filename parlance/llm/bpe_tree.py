"""Byte-level BPE from a rank file: every text encoded with a segment tree of pair ranks, and decoded again.

Method.  A text is cut by a pattern and each match is encoded by itself.  A
match that is a token is that token.  Otherwise its bytes are the leaves of a
segment tree: the leaf of a live byte place holds the rank of the pair that
starts there (joined with the place, so that a minimum is also the leftmost
one), an inner node the least of its two children.  The root names the next
merge; it changes three leaves (the merged place, its left neighbour and the
place that dies), each a point update along one path to the root.

Short matches of a batch are merged together, one row of a numpy matrix a
match and one tree a row; longer ones go one at a time through the same tree in
a flat list.  Matches encoded before are looked up; that memo is bounded, lives
in the Python worker and never changes a result.

Texts are not shuffled: a hot source or a long document costs its own bytes.
Spark hands them over in batches bounded by bytes.

Defined cases: null text has no ids and decodes to no bytes; so does the empty
text.  White space and letters of every script follow the pattern (Unicode
White_Space).  Repeated rows, ties and null ids are encoded row by row; an
empty table gives an empty result; extra columns are carried, a result column
whose name is taken ends in underscores.  Ids that the rank file lacks are an
error in decoding, null ids decode to null.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, whole_text, worker_store

MEMO_PIECES = 400_000     # matches that a worker process remembers before it starts over
ROW_BYTES = 64            # matches up to this length are merged together
GROUP_CHARS = 1 << 20     # characters of the texts that are cut together
GROUP_BYTES = 1 << 15     # places of the matrices (they fit a core's cache)
NO_PAIR = np.int64(1) << 48


# The letters, numbers and white space of Unicode below U+0250, as the inside of a character class, and the
# characters that the narrow twin of a pattern may meet (those, and general punctuation without its spaces).
LETTERS, NUMBERS, WHITE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
BEYOND = re.compile("[^\x00-ɏ‐-‧‰-⁞]")


def narrow_twin(pattern: str) -> str | None:
    """The pattern for the library's faster matcher, for texts without a character of ``BEYOND``; None if it has other
    escapes than letters, numbers and white space."""
    classes = {r"\p{L}": LETTERS, r"\p{N}": NUMBERS, r"\s": WHITE}
    out, inside = [], False
    for token in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.S):
        if token in classes:
            token = classes[token] if inside else f"[{classes[token]}]"
        elif token == r"\S" and not inside:
            token = f"[^{WHITE}]"
        elif token[0] == "\\":
            return None
        elif token in "[]":
            inside = token == "["
        out.append(token)
    return "".join(out)


class Ranks:
    """A rank file: token bytes, their ids, and the rank of every pair of tokens whose bytes joined are a token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens = {i: token for token, i in self.ids.items()}
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, i in self.ids.items():
            for cut in range(1, len(token)):
                a, b = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.pairs = pairs
        # the same as arrays: an open table (an entry lies at its hash or as far behind as the table is full)
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1), np.full(1 << self.bits, NO_PAIR)
        key, value = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        at = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.keys[at] < 0)
            free = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[free]], self.values[at[free]] = key[free], value[free]
            left = np.ones(len(key), bool)
            left[free] = False
            key, value, at = key[left], value[left], at[left] + 1 & (1 << self.bits) - 1
        byte = np.arange(256)
        self.of_bytes = self.of_pairs(self.single[byte][:, None].repeat(256, 1).ravel(),
                                      self.single[byte][None].repeat(256, 0).ravel())

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = (key ^ key >> 27).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank (the id of the joined token) of each pair, ``NO_PAIR`` where there is none."""
        key = left << 32 | right
        at = self._slot(key)
        found, out = self.keys[at], self.values[at]
        open_ = np.flatnonzero((found != key) & (found >= 0))
        out[found < 0] = NO_PAIR
        while len(open_):           # another pair lies there: look one place on
            at[open_] = at[open_] + 1 & (1 << self.bits) - 1
            found = self.keys[at[open_]]
            out[open_] = np.where(found == key[open_], self.values[at[open_]], NO_PAIR)
            open_ = open_[(found != key[open_]) & (found >= 0)]
        return out


def load_ranks(path: str) -> Ranks:
    kept = worker_store("bpe tree", "ranks")
    if path not in kept:
        kept[path] = Ranks(path)
    return kept[path]


def merge_one(piece: bytes, ranks: Ranks) -> list[int]:
    """The ids of one piece, by a segment tree in a flat list (leaf of place j: ``size + j``)."""
    n = len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    symbol = ranks.single[np.frombuffer(piece, np.uint8)].tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pairs, none = ranks.pairs, int(NO_PAIR)
    tree = [none] * (2 * size)
    for j in range(n - 1):
        rank = pairs.get(symbol[j] << 32 | symbol[j + 1])
        if rank is not None:
            tree[size + j] = rank * size + j
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def update(j: int, key: int) -> None:
        node = size + j
        tree[node] = key
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a < b else b
            if tree[node] == least:
                break
            tree[node] = least
            node >>= 1

    def key_of(j: int) -> int:
        rank = pairs.get(symbol[j] << 32 | symbol[after[j]]) if after[j] < n else None
        return none if rank is None else rank * size + j

    while tree[1] < none:
        rank, j = divmod(tree[1], size)
        dead = after[j]
        symbol[j], after[j] = rank, after[dead]
        if after[j] < n:
            before[after[j]] = j
        update(dead, none)
        update(j, key_of(j))
        if before[j] >= 0:
            update(before[j], key_of(before[j]))
    out, j = [], 0
    while j < n:
        out.append(symbol[j])
        j = after[j]
    return out


def merge_rows(pieces: list[bytes], size: int, ranks: Ranks) -> list[bytes]:
    """The ids (little-endian uint32) of pieces of 2 to ``size`` bytes (a power of two), one tree a matrix row.

    The matrices are kept flat: place j of row r is ``r * (size + 1) + j``, tree node m is ``r * 2 * size + m``.
    Place ``size`` of a row stands for "none" on both sides.
    """
    k, depth, wide = len(pieces), size.bit_length() - 1, size + 1
    raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(k, size)
    length = np.fromiter(map(len, pieces), np.int64, k)
    place = np.arange(size)
    alive = np.zeros((k, wide), bool)
    alive[:, :size] = place < length[:, None]
    symbol = np.zeros((k, wide), np.int64)
    symbol[:, :size] = ranks.single[raw]
    after = np.full((k, wide), size)
    after[:, :size - 1][alive[:, 1:size]] = np.broadcast_to(place[1:], (k, size - 1))[alive[:, 1:size]]
    before = np.broadcast_to(np.concatenate([[size], place]), (k, wide)).copy()
    tree = np.full((k, 2 * size), NO_PAIR)
    first = ranks.of_bytes[raw[:, :-1].astype(np.int32) << 8 | raw[:, 1:]]
    paired = alive[:, 1:size] & (first < NO_PAIR)
    tree[:, size:-1][paired] = (first * size + place[:-1])[paired]
    for d in range(depth - 1, -1, -1):
        a, b = 1 << d, 2 << d
        np.minimum(tree[:, 2 * a:2 * b:2], tree[:, 2 * a + 1:2 * b:2], out=tree[:, a:b])
    alive, symbol, after, before, tree = (m.reshape(-1) for m in (alive, symbol, after, before, tree))
    at, root = np.arange(k) * wide, np.arange(k) * 2 * size         # of the rows that still merge
    while True:
        least = tree[root + 1]
        going = least < NO_PAIR
        if not going.all():
            at, root, least = at[going], root[going], least[going]
        if not len(at):
            break
        rank, j = least >> depth, least & size - 1
        dead = after[at + j]
        follower, left = after[at + dead], before[at + j]
        symbol[at + j], after[at + j], before[at + follower] = rank, follower, j
        alive[at + dead] = False
        leaf = root + size
        tree[leaf + dead] = NO_PAIR
        new = ranks.of_pairs(rank, symbol[at + follower])
        tree[leaf + j] = np.where((follower < size) & (new < NO_PAIR), new * size + j, NO_PAIR)
        has_left = np.flatnonzero(left < size)
        new = ranks.of_pairs(symbol[at[has_left] + left[has_left]], rank[has_left])
        tree[leaf[has_left] + left[has_left]] = np.where(new < NO_PAIR, new * size + left[has_left], NO_PAIR)
        # the three paths to the root, a level at a time
        node = np.concatenate([size + dead, size + j, size + left[has_left]])
        rows = np.concatenate([root, root, root[has_left]])
        for _ in range(depth):
            node >>= 1
            child = rows + 2 * node
            tree[rows + node] = np.minimum(tree[child], tree[child + 1])
    ids = symbol[alive].astype("<u4").tobytes()
    ends = (4 * np.cumsum(alive.reshape(k, wide).sum(axis=1))).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends)]


class TreeEncoder:
    """Texts to ids (little-endian uint32 bytes)."""

    def __init__(self, path: str, pattern: str, memo_pieces: int = MEMO_PIECES, row_bytes: int = ROW_BYTES):
        self.ranks, matcher = load_ranks(path), regex.compile(pattern)
        # findall gives whole matches only where the pattern has no groups
        self.every = (lambda text: [m.group() for m in matcher.finditer(text)]) if matcher.groups else matcher.findall
        twin = None if matcher.groups else narrow_twin(pattern)
        self.narrow = twin and re.compile(twin).findall
        self.memo = worker_store("bpe tree", f"pieces {path}")
        self.memo_pieces, self.row_bytes = memo_pieces, row_bytes

    def findall(self, text: str) -> list[str]:
        return self.narrow(text) if self.narrow and not BEYOND.search(text) else self.every(text)

    def merged(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece (one match of the pattern)."""
        known, out = self.ranks.ids, [b""] * len(pieces)
        groups: dict[int, list[int]] = {}
        raws = [p.encode() for p in pieces]
        for k, raw in enumerate(raws):
            if raw in known:
                out[k] = known[raw].to_bytes(4, "little")
            elif len(raw) > self.row_bytes:
                out[k] = np.array(merge_one(raw, self.ranks), "<u4").tobytes()
            else:
                groups.setdefault((len(raw) - 1).bit_length(), []).append(k)
        for depth, group in groups.items():
            rows = max(1, GROUP_BYTES >> depth)
            for at in range(0, len(group), rows):
                part = group[at:at + rows]
                for k, ids in zip(part, merge_rows([raws[k] for k in part], 1 << depth, self.ranks)):
                    out[k] = ids
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out, at = [], 0
        while at < len(texts):
            group, held = [], 0
            while at < len(texts) and held < GROUP_CHARS:
                group.append(self.findall(texts[at] or ""))
                held += len(texts[at] or "")
                at += 1
            new = set().union(*group).difference(self.memo)
            if len(self.memo) + len(new) > self.memo_pieces:
                self.memo.clear()
                new = set().union(*group)
            new = list(new)
            self.memo.update(zip(new, self.merged(new)))
            out.extend(b"".join(map(self.memo.__getitem__, g)) for g in group)
        return out


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids",
           memo_pieces: int = MEMO_PIECES) -> DataFrame:
    """``docs`` with a binary column ``out``: the ids of the whole text as little-endian uint32."""

    @F.pandas_udf("binary")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series(TreeEncoder(path, pattern, memo_pieces).encode(texts.tolist()), dtype=object)

    return docs.withColumn(free_name(docs, out), ids(whole_text(text_col)))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with a binary column ``out``: the bytes that the ids in ``ids_col`` stand for."""

    @F.pandas_udf("binary")
    def decoded(ids: pd.Series) -> pd.Series:
        tokens = load_ranks(path).tokens
        return pd.Series([None if raw is None else b"".join(map(tokens.__getitem__, np.frombuffer(raw, "<u4").tolist()))
                          for raw in ids], dtype=object)

    return encoded.withColumn(free_name(encoded, out), decoded(F.col(f"`{ids_col}`")))


def n_ids(ids: Column) -> Column:
    return F.shiftright(F.octet_length(ids), 2).cast("long")
