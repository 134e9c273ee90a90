"""Periodic runs of words: maximal pairs read off an LCP-interval tree.

A run is a stretch of consecutive words with smallest period q that no
neighbouring word extends.  It shows as a maximal pair: the words at ``start``
and at ``start + q`` go on alike for exactly ``length - q`` words, and the words
to the left of the two places differ.  Such a pair needs no extension; it is a
run if its distance is at most the common length (two periods fit) and the run
is long enough.

Method, for each document by itself:

1. Suffix ranks by prefix doubling over (document, word); only suffixes that
   share at least ``ceil(min_length / 2)`` words with another one can take part
   (distance <= common length, and both add up to the run), so the others leave
   after a few rounds.
2. LCPs of neighbouring suffixes from the kept ranks.
3. The LCP-interval tree, bottom up over a stack.  A node keeps its places in
   order and by left word (class lists); children are merged smaller into
   larger.  When two children meet, a place of the smaller one looks for
   partners of another class within the common length.  Occurrences of the
   common words within that distance stand at equal steps (the period), so all
   later ones have one left word, and of the earlier ones only the first can
   have another left word than the place itself: a look costs a bisection and
   what it finds.
4. Pairs of one stretch with multiples of its period are dropped for the
   smallest period.

Many documents share one numpy pass (a batch of about ``BATCH_WORDS`` words, or
one longer document); nothing is shuffled, so a hot source costs its own rows.

Defined cases: null and empty texts have no words and no runs; repeated rows
are handled one by one; an empty table gives an empty result; extra columns are
carried (a result column whose name is taken ends in underscores).
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, free_name, whole_text, worker_store

MIN_LENGTH = 12           # words of the shortest run
BATCH_WORDS = 200_000     # words of one numpy pass, unless a document is longer
WORD = re.compile(f"[^{SPACES}]+")
SCHEMA_TYPE = "struct<n_words:long,runs:array<struct<start:long,length:long,period:long>>,collapsed:string>"


def repeated_suffixes(code: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that share words with another one, at least those with ``least``, in suffix order, and the LCP of
    each with the one before.

    ``code`` numbers the words so that no code occurs in two documents.  The rank of a suffix for a width is the number
    of suffixes that are less by their first ``width`` words; a suffix alone with them has its last rank.
    """
    n = len(code)
    rank = np.searchsorted(np.sort(code), code)
    active, levels, width = np.arange(n), [], 1
    while True:
        count = np.bincount(rank[active], minlength=1)
        active = active[count[rank[active]] > 1]
        levels.append(rank)
        if width <= least:
            shared = active
        if not len(active):
            break
        follow = active + width
        key = rank[active] * (n + 1) + np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        key, old = key[by], rank[active[by]]
        at = np.arange(len(by))
        new_group = np.append(True, key[1:] != key[:-1])
        old_group = np.append(True, old[1:] != old[:-1])
        first = np.maximum.accumulate(np.where(new_group, at, 0))
        rank = rank.copy()
        rank[active[by]] = old + first - np.maximum.accumulate(np.where(old_group, at, 0))
        width *= 2
    order = shared[np.argsort(rank[shared])]
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        same = (a < n) & (b < n) & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        a += same.astype(np.int64) << k
        b += same.astype(np.int64) << k
    return order, np.append(0, a - order[:-1])[:len(order)]


class Node:
    """The places below a tree node: in order, and by the word to their left (``classes``)."""

    __slots__ = ("common", "places", "classes")

    def __init__(self, common: int, places: list[int], classes: dict[int, list[int]]):
        self.common, self.places, self.classes = common, places, classes

    def absorb(self, child: "Node", left: list[int], found: list) -> None:
        """Take in a child: what lies in both, with different words to the left, is a maximal pair of length ``common``."""
        if len(child.places) > len(self.places):
            self.places, child.places = child.places, self.places
            self.classes, child.classes = child.classes, self.classes
        places, classes, common = self.places, self.classes, self.common
        for word, members in child.classes.items():
            for i in members:
                k = bisect_left(places, i - common)
                if k < len(places) and places[k] < i and left[places[k]] != word:
                    found.append((places[k], i, common))
                k = bisect_right(places, i)
                if k < len(places) and places[k] <= i + common and left[places[k]] != word:
                    partners = classes[left[places[k]]]
                    for j in partners[bisect_right(partners, i):bisect_right(partners, i + common)]:
                        found.append((i, j, common))
        for word, members in child.classes.items():
            classes[word] = _merged(classes[word], members) if word in classes else members
        self.places = _merged(places, child.places)


def _merged(large: list[int], small: list[int]) -> list[int]:
    if len(small) == 1:
        insort(large, small[0])
    else:
        large = large + small
        large.sort()        # two ordered stretches: one merge
    return large


def maximal_pairs(order: list[int], lcp: list[int], left: list[int], least: int) -> list[tuple[int, int, int]]:
    """(place, later place, common length) of the maximal pairs that go on alike for ``least`` words and their distance.

    ``left[i]``: the code of the word before place i, one of its own where a document begins.
    """
    found: list[tuple[int, int, int]] = []
    stack: list[Node] = []
    for place, ahead in zip(order, [*lcp[1:], 0]):
        if ahead < least and not stack:
            continue
        node = Node(0, [place], {left[place]: [place]})
        while stack and stack[-1].common > ahead:      # intervals that end with this suffix, innermost first
            stack[-1].absorb(node, left, found)
            node = stack.pop()
        if ahead < least:
            continue
        if stack and stack[-1].common == ahead:
            stack[-1].absorb(node, left, found)
        else:
            stack.append(Node(ahead, node.places, node.classes))
    return found


def runs_of(documents: list[list[str]], min_length: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each document (a list of words), by start and period."""
    sizes = np.fromiter(map(len, documents), np.int64, len(documents))
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    if not sizes.sum():
        return out
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(documents)), sizes)
    words, vocabulary = pd.factorize(np.array([w for d in documents for w in d], dtype=object))
    code = owner * len(vocabulary) + words
    left = np.append(-1, code[:-1])
    left[(ends - sizes)[sizes > 0]] = -1
    # the distance is at most the common length and both make the run
    order, lcp = repeated_suffixes(code, -(-min_length // 2))
    least: dict[tuple[int, int], int] = {}
    for i, j, common in maximal_pairs(order.tolist(), lcp.tolist(), left.tolist(), -(-min_length // 2)):
        stretch = (i, common + j - i)
        if stretch[1] >= min_length and j - i < least.get(stretch, 1 << 62):
            least[stretch] = j - i
    for (i, length), period in least.items():
        doc = int(owner[i])
        out[doc].append((i - int(ends[doc] - sizes[doc]), length, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without what any run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [w for w, k in zip(words, keep.tolist()) if k]


def _batches(texts: list[str | None], batch_words: int):
    group, held = [], 0
    for t in texts:
        group.append(WORD.findall(t or ""))
        held += len(group[-1])
        if held >= batch_words:
            yield group
            group, held = [], 0
    yield group


def periodic_runs(docs: DataFrame, text_col: str = "text", out: str = "periodic", min_length: int = MIN_LENGTH,
                  batch_words: int = BATCH_WORDS) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, runs (start, length, period in words), collapsed (the words
    left, joined by one space)."""
    if min_length < 2:
        raise ValueError("a run has two words at least")

    @F.arrow_udf(SCHEMA_TYPE)
    def found(texts: pa.Array) -> pa.Array:
        worker_store("runs")        # lets go of another operator's memos
        n, runs, rest = [], [], []
        for group in _batches(texts.to_pylist(), batch_words):
            for words, r in zip(group, runs_of(group, min_length)):
                n.append(len(words))
                runs.append(r)
                rest.append(" ".join(collapsed(words, r)))
        at = np.cumsum([0, *map(len, runs)]).astype(np.int32)
        flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
        each = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, each),
                                           pa.array(rest, pa.string())], ["n_words", "runs", "collapsed"])

    return docs.withColumn(free_name(docs, out), found(whole_text(text_col)))
