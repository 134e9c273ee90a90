"""SimHash near-duplicates by bit-sliced comparison.

1. Fingerprints: the text's A-Z are lower-cased, words are runs of
   non-space, shingles are ``width`` words (repeats count; fewer words: the
   whole sequence), hashed by XXH64 (seed 42); a bit is set if it is set in
   over half of the hashes.
2. Equal fingerprints fold into one row.  Fingerprints within ``radius`` bits
   agree on all but ``radius`` of ``radius + 2`` bit blocks, so each
   fingerprint goes to one bucket for every choice of agreeing blocks.  A
   bucket over ``BUCKET`` members is split by the same argument over the bits
   that are still free (``radius + 1`` parts, one must agree), again and again;
   members are distinct, so the free bits run out and the splitting ends.  No
   pair is lost and no group is expanded into pairs.
3. Bit-sliced comparison: in a bucket-sorted block the fingerprints are stored
   as vertical bit planes.  For a lag d, all lanes (i, i + d) in one bucket are
   compared at once: each plane is XORed with itself shifted by d lanes and
   added to carry-save counters; once every lane of the block has passed the
   radius, the other planes are skipped.  Each bucket gives the edges of a
   spanning forest only.
4. Components of these edges (see ``components``), named by the least doc_id.

Defined cases: null and empty texts have fingerprint zero and link like any
other; repeated rows and ties share a fingerprint; a null id never names a
group unless the whole group has none; extra columns are kept by
``deduplicated``; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, saved, whole_text, worker_store
from .components import components

BITS = 64
SEED = 42
BUCKET = 256            # members of a bucket that are compared in one block
BLOCK = 4096            # lanes of a comparison block
BROADCAST_ROWS = 500_000   # ids (8 bytes each) that may be broadcast; beyond it the join is shuffled


def text_hashes(data: bytes, width: int) -> list[int]:
    words = data.lower().split()      # ASCII only, for bytes: A-Z, and the six ASCII spaces
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    starts = np.zeros(len(words), dtype=np.int64)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    np.cumsum(lens[:-1] + 1, out=starts[1:])
    ends = (starts + lens)[width - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends)]


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as a signed 64-bit integer."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at:at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row a document, fp as a signed long."""

    def run(batches):
        worker_store("simhash")         # lets go of another operator's memos
        for b in batches:
            fps = [majority(np.array(h, dtype=np.uint64)) if (h := text_hashes(t.encode(), width)) else 0
                   for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": np.array(fps, dtype=np.int64)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInPandas(
        run, "doc_id long, fp long")


def _parts(free: int, n: int) -> list[int]:
    """The set bits of ``free`` in n contiguous parts, as masks (empty parts left out)."""
    at = [b for b in range(BITS) if free >> b & 1]
    cut = [len(at) * i // n for i in range(n + 1)]
    return [m for i in range(n) if (m := sum(1 << b for b in at[cut[i]:cut[i + 1]]))]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


_ALL = (1 << BITS) - 1


def first_masks(radius: int) -> list[int]:
    """One mask of agreeing bits for every choice of ``radius`` blocks out of ``radius + 2`` that may differ."""
    blocks = _parts(_ALL, radius + 2)
    return [_ALL & ~sum(c) for c in combinations(blocks, radius)]


def next_masks(mask: int, radius: int) -> list[int]:
    return [mask | p for p in _parts(_ALL & ~mask, radius + 1)]


def _shift(plane: np.ndarray, d: int, lanes: int) -> np.ndarray:
    """Lanes d .. d + lanes - 1 of a packed plane, packed again."""
    q, r = divmod(d, 8)
    n = (lanes + 7) // 8
    a = plane[q:q + n]
    return a if r == 0 else (a >> r) | (plane[q + 1:q + 1 + n] << (8 - r))


def close_lanes(fp: np.ndarray, lanes_ok: np.ndarray, planes: np.ndarray, d: int, radius: int) -> np.ndarray:
    """Lanes i (of those allowed) whose fingerprints i and i + d differ in ``radius`` bits or fewer.

    Carry-save counters: count[k] holds bit k of every lane's distance; ``over`` the lanes past the radius.
    """
    lanes = len(lanes_ok)
    n = (lanes + 7) // 8
    over = ~np.packbits(lanes_ok, bitorder="little")
    width = radius.bit_length() + 1
    counts = [np.zeros(n, dtype=np.uint8) for _ in range(width)]
    for plane in planes:
        carry = plane[:n] ^ _shift(plane, d, lanes)
        for k in range(width):
            counts[k], carry = counts[k] ^ carry, counts[k] & carry
        past, equal = np.zeros(n, dtype=np.uint8), np.full(n, 255, dtype=np.uint8)
        for k in reversed(range(width)):      # lanes whose counter is now above the radius
            if radius >> k & 1:
                equal = equal & counts[k]
            else:
                past |= equal & counts[k]
                equal = equal & ~counts[k]
        over |= past
        if (over == 255).all():               # the whole block is past the radius: leave the other planes
            return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.unpackbits(~over, bitorder="little")[:lanes])


def bucket_edges(bucket: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning-forest edges of the links inside buckets; ``bucket`` is sorted, equal numbers are one bucket."""
    n = len(fp)
    root = np.arange(n)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    ends = np.searchsorted(bucket, bucket, side="right")
    left = ends - np.arange(n) - 1            # members that follow in the same bucket
    us, vs = [], []
    for at in range(0, n, BLOCK):
        top = min(n, at + BLOCK)
        most = int(left[at:top].max())
        stop = min(n, top + most)
        bits = np.unpackbits(fp[at:stop].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        used = np.flatnonzero(bits.min(axis=0) != bits.max(axis=0))
        packed = np.packbits(bits[:, used].T, axis=1, bitorder="little")
        planes = np.pad(packed, ((0, 0), (0, 2 + most // 8 + BLOCK // 8)))
        for d in range(1, most + 1):
            ok = left[at:top] >= d
            last = int(np.flatnonzero(ok)[-1]) + 1
            for i in close_lanes(fp, ok[:last], planes, d, radius):
                a, b = find(at + i), find(at + i + d)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    us.append(at + i)
                    vs.append(at + i + d)
    return fp[us], fp[vs]


def _compare(radius: int):
    def run(batches):
        kept = None
        for b in batches:
            if kept is not None:
                b = pd.concat([kept, b], ignore_index=True)
            if not len(b):
                continue
            whole = (b["mask"].to_numpy() != b["mask"].iat[-1]) | (b["value"].to_numpy() != b["value"].iat[-1])
            kept = b[~whole]                  # the last bucket may go on in the next batch; it has BUCKET rows at most
            yield edges(b[whole])
        if kept is not None:
            yield edges(kept)

    def edges(b):
        mask, value = b["mask"].to_numpy(), b["value"].to_numpy()
        if not len(b):
            return pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
        new = np.r_[True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])]
        u, v = bucket_edges(np.cumsum(new), b["fp"].to_numpy(), radius)
        return pd.DataFrame({"u": u, "v": v})

    return run


def links(fps: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) that span the same components as all pairs of ``fps`` (distinct, column fp) within ``radius`` bits."""
    bucket = max(bucket, 1 << radius)     # a smaller bucket could not be split: all its free bits may differ
    masks = [_signed(m) for m in first_masks(radius)]
    rows = fps.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("mask"))
    found = None
    while masks:
        rows = rows.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"))
        sizes = rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        shared = saved(rows.join(saved(sizes, "bucket-sizes"), ["mask", "value"]), "buckets")
        ready = (shared.filter(F.col("n") <= bucket).drop("n").repartition("mask", "value")
                 .sortWithinPartitions("mask", "value", "fp"))
        edges = ready.select("mask", "value", "fp").mapInPandas(_compare(radius), "u long, v long")
        found = edges if found is None else found.unionByName(edges)
        # nothing left to split once the free bits cannot make a bucket over the bound
        hot = shared.filter(F.col("n") > bucket)
        finer = {m: [_signed(x) for x in next_masks(m & _ALL, radius)] for m in masks}
        if hot.isEmpty():
            break
        masks = sorted({x for xs in finer.values() for x in xs})
        table = F.create_map(*[c for m, xs in finer.items() for c in (F.lit(m), F.array(*map(F.lit, xs)))])
        # two buckets may lead a fingerprint to one finer bucket; it is a member there once
        rows = hot.select("fp", F.explode(table[F.col("mask")]).alias("mask")).distinct()
    return found


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, fp, root (a fingerprint that names the group), component_id (its least doc_id)."""
    marked = saved(fingerprints(docs, width, id_col, text_col), "fingerprints")
    distinct = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    linked = components(links(distinct.select("fp"), radius))
    rooted = saved(distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
                   .select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = saved(rooted.join(named, "root").select("fp", "root", "component_id"), "classes")
    return marked.join(classes, "fp").select("doc_id", "fp", "root", "component_id")


def deduplicated(docs: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one with the least id (repeated ids: one of their rows)."""
    gone_id, row = free_name(docs, "gone_id"), free_name(docs, "row")
    found = saved(near_duplicates(docs, width, radius, id_col, text_col), "near-duplicates")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = found.filter(~stays).select(F.col("doc_id").alias(gone_id)).distinct()
    repeated = found.groupBy("doc_id").count().filter("count > 1")      # null counts as an id here
    ids = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(gone_id))
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if repeated.isEmpty():                    # every id names one row, so the rows to leave out are known by id
        return docs.join(F.broadcast(gone) if few else gone, ids, "left_anti")
    # an id occurs on several rows, in one group or in several: fingerprint the rows themselves and keep one row of
    # each group
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row))
    fp_rows = _with_fingerprint(keyed, row, width, id_col, text_col)
    classes = found.select("fp", "root", "component_id").distinct()
    pick = (fp_rows.join(classes, "fp").filter(F.col(f"{row}.`{id_col}`").cast("long").eqNullSafe(F.col("component_id")))
            .groupBy("root").agg(F.first(row).alias(row)))
    return pick.select(*[F.col(f"{row}.`{c}`").alias(c) for c in docs.columns])


def _with_fingerprint(keyed: DataFrame, row: str, width: int, id_col: str, text_col: str) -> DataFrame:
    @F.pandas_udf("long")
    def fp_of(text: pd.Series) -> pd.Series:
        return pd.Series([majority(np.array(h, dtype=np.uint64)) if (h := text_hashes(t.encode(), width)) else 0
                          for t in text], dtype="int64")

    return keyed.select(row, fp_of(whole_text(f"{row}.`{text_col}`")).alias("fp"))
