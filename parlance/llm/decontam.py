"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared in a normal form: letters and digits in lower case, every
run of other characters one space.  A document leaks an item if the whole item
occurs in it with at most ``k = floor(ERROR_RATE * m)`` edits (m: the item's
normal length; k is lowered where the lemma would have no power).

Filter.  An occurrence with k edits keeps at least ``m + 1 - q (k + 1)`` of the
item's q-grams, on diagonals (document position less item position) that differ
by 2k at most.  Shared q-grams are counted in overlapping diagonal bands (each
band ``2 s`` wide, a new one every ``s >= 2k + 1``), so one band sees all of
them; bands that meet the bound are kept.  Verification: a semi-global
alignment of the item with the band's stretch of the document, a vector of
diagonals a step, decides.

The benchmark's q-gram index is made in blocks of ``INDEX_CHARS`` characters
and shipped to the tasks block by block, so its size is bounded whatever the
benchmark's size; every document is held against every block.  Documents are
not shuffled.

Defined cases: null and empty texts have no leak; items with a normal form
under ``q + 1`` characters identify nothing and are ignored; repeated rows and
items each answer for themselves; an empty table on either side gives an empty
result; ``clean_documents`` keeps all columns, also with clashing names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text, worker_store

Q = 10
ERROR_RATE = 0.08
INDEX_CHARS = 8_000_000
_PRIME = 0x9E3779B97F4A7C15
_SPACE = 32
_START = np.int64(1) << 32


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and is-letter-or-digit of every code point of the basic plane."""
    lower = np.arange(65536, dtype=np.uint32)
    word = np.zeros(65536, dtype=bool)
    for c in range(65536):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        word[c] = x.isalnum()
        if len(y := x.lower()) == 1 and ord(y) < 65536:
            lower[c] = ord(y)
    return lower, word


class Normal:
    """Normal form of a text, with the place in the text of each of its characters."""

    def __init__(self):
        self.lower, self.word = _tables()

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        c = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
        low = np.minimum(c, 65535)
        word = self.word[low] | (c > 65535)
        out = np.where(word, np.where(c > 65535, c, self.lower[low]), np.uint32(_SPACE))
        keep = word.copy()
        if len(c):
            keep[1:] |= word[:-1]
        at = np.flatnonzero(keep)
        if len(at) and not word[at[-1]]:
            at = at[:-1]
        return out[at], at


def qgram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q-gram, by doubling: the hash of a + b is hash(a) * p^len(b) + hash(b)."""
    if len(c) < q:
        return np.zeros(0, dtype=np.uint64)
    power, size, block = _PRIME, 1, c.astype(np.uint64) + np.uint64(1)
    out, done = None, 0
    while True:
        if q & size:
            n = len(c) - q + 1
            part = block[done:done + n]
            out = part if out is None else out * np.uint64(power) + part
            done += size
        if size * 2 > q:
            return out ^ (out >> np.uint64(29))
        block = block[:-size] * np.uint64(power) + block[size:]
        power, size = power * power % (1 << 64), size * 2


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, error_rate: float = ERROR_RATE):
        normal, self.q, self.items = Normal(), q, []
        hashes, owners, places = [], [], []
        for item_id, text in items:
            c, _ = normal(text or "")
            if len(c) <= q:
                continue
            h = qgram_hashes(c, q)
            k = max(0, min(int(error_rate * len(c)), len(c) // q - 1))
            # one q-gram at least has to be shared for the filter to see the occurrence
            while k > 0 and len(c) + 1 - q * (k + 1) < 1:
                k -= 1
            hashes.append(h)
            owners.append(np.full(len(h), len(self.items), dtype=np.int32))
            places.append(np.arange(len(h), dtype=np.int32))
            self.items.append((item_id, c, k, max(1, len(c) + 1 - q * (k + 1)), max(2 * k + 1, 8)))
        self.normal = normal
        if self.items:
            h = np.concatenate(hashes)
            order = np.argsort(h, kind="stable")
            self.hash, self.owner, self.place = h[order], np.concatenate(owners)[order], np.concatenate(places)[order]
            self.need = np.array([i[3] for i in self.items])
            self.step = np.array([i[4] for i in self.items])
            self.bitmap_bits = max(16, int(len(h) * 32).bit_length())
            self.bitmap = np.zeros(1 << self.bitmap_bits, dtype=bool)
            self.bitmap[self._slot(h)] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return h >> np.uint64(64 - self.bitmap_bits)

    def bands(self, h: np.ndarray) -> list[tuple[int, int]]:
        """(item, first diagonal) of the bands whose shared q-grams meet the item's bound."""
        at = np.flatnonzero(self.bitmap[self._slot(h)])
        if not len(at):
            return []
        left = np.searchsorted(self.hash, h[at], side="left")
        n = np.searchsorted(self.hash, h[at], side="right") - left
        at, left, n = at[n > 0], left[n > 0], n[n > 0]
        if not len(at):
            return []
        entry = np.repeat(left, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        owner = self.owner[entry]
        # an item that shares too few q-grams with the whole document shares too few in any band
        enough = np.bincount(owner, minlength=len(self.items)) >= self.need
        keep = enough[owner]
        if not keep.any():
            return []
        owner = owner[keep].astype(np.int64)
        diagonal = np.repeat(at, n)[keep] - self.place[entry[keep]]
        band = np.floor_divide(diagonal, self.step[owner])
        key = np.concatenate([(owner << 40) + band + (1 << 32), (owner << 40) + band - 1 + (1 << 32)])
        key, count = np.unique(key, return_counts=True)
        key = key[count >= self.need[key >> 40]]
        return [(o, int(b) * int(self.step[o])) for o, b in zip((key >> 40).tolist(),
                                                               ((key & ((1 << 40) - 1)) - (1 << 32)).tolist())]

    def leaks(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, edits) of the occurrences in a text; start and end in its characters."""
        if not self.items or not text:
            return []
        c, at = self.normal(text)
        found: dict[tuple[int, int], tuple] = {}
        for o, first in self.bands(qgram_hashes(c, self.q)):
            item_id, item, k, _, step = self.items[o]
            hit = banded_alignment(item, c, first - k, first + 2 * step + k, k)
            if hit:
                edits, a, b = hit
                place = (o, a // len(item))
                better = (edits, int(at[a]), int(at[b - 1]) + 1, item_id)
                for near in ((o, place[1] - 1), place, (o, place[1] + 1)):   # neighbouring bands see one occurrence
                    if near in found and abs(found[near][1] - better[1]) <= len(item):
                        found[near] = min(found[near], better)
                        break
                else:
                    found[place] = better
        return [(x[3], x[1], x[2], x[0]) for x in found.values()]


def banded_alignment(item: np.ndarray, doc: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """The best occurrence (edits, start, end) of the whole item along diagonals ``low .. high``; None beyond k edits.

    Cell (j, d) has item[:j] aligned up to document place j + d.  A step takes one item character: along the
    diagonal (match or substitution), from d + 1 (character left out) and then rightwards within the row
    (document characters put in; a running minimum).  A cell holds edits * 2^32 + start.
    """
    m, n = len(item), len(doc)
    d = np.arange(low, high + 1)
    wall = np.int64(m + 1) * _START
    cell = np.where((d >= 0) & (d <= n), np.int64(0), wall) + np.clip(d, 0, n)
    along = np.arange(len(d), dtype=np.int64) * _START
    padded = np.full(high + m + 2 - min(low, 0), 0, dtype=np.uint32)
    lead = -min(low, 0)
    take = min(n, len(padded) - lead)
    padded[lead:lead + take] = doc[:take]
    for j in range(1, m + 1):
        place = low + j - 1 + lead                  # document character that cell (j, low) ends with
        same = padded[place:place + len(d)] == item[j - 1]
        step = cell + np.where(same, np.int64(0), _START)
        np.minimum(step[:-1], cell[1:] + _START, out=step[:-1])
        i = d + j
        step[(i < 0) | (i > n)] = wall
        cell = np.minimum.accumulate(step - along) + along
        if int(cell.min()) >= (k + 1) * int(_START):
            return None
    best = int(cell.argmin())
    edits, start = divmod(int(cell[best]), int(_START))
    return (edits, start, int(d[best]) + m) if edits <= k else None


def index_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", q: int = Q,
                 error_rate: float = ERROR_RATE, index_chars: int = INDEX_CHARS):
    """Indexes of blocks of about ``index_chars`` characters each, one at a time."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), whole_text(text_col).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // index_chars)
    for b in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text")
        yield Index([tuple(r) for r in part.collect()], q, error_rate)


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               **index_options) -> DataFrame:
    """doc_id, item_id, start, end (characters of the text), edits: one row an occurrence."""
    schema = "doc_id long, item_id long, start int, end int, edits int"
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("text != ''")
    out = spark.createDataFrame([], schema)
    for index in index_blocks(items, **index_options):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            worker_store("decontam")    # lets go of another operator's memos
            for b in batches:
                hits = [(d, *x) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                        for x in shared.value.leaks(t)]
                columns = list(zip(*hits)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64())]
                    + [pa.array(x, pa.int32()) for x in columns[2:]], names=["doc_id", "item_id", "start", "end", "edits"])

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def clean_documents(docs: DataFrame, items: DataFrame, text_col: str = "text", **index_options) -> DataFrame:
    """``docs`` without the documents that leak an item."""
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    for index in index_blocks(items, **index_options):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            worker_store("decontam")    # lets go of another operator's memos
            for b in batches:
                yield b.filter(pa.array([not t or not shared.value.leaks(t) for t in b.column(at).to_pylist()],
                                        pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
