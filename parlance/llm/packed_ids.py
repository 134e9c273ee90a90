"""Token ids in a fixed-width bit-packed format with random access.

A packed file is a folder of Parquet parts (so that any Hadoop store works and
a lost task is written again); each row is one *segment*: consecutive documents
in ascending id order, at most ``SEGMENT_TOKENS`` ids unless a single document
is longer (a long document goes over several segments).  The payload is

    magic "PKID", u8 version, u8 bits, u16 0, u32 n_ids, u32 block, u32 n_blocks,
    u32 offset of each block's first byte, then the blocks

with all numbers little-endian.  Each id takes the fewest bits that hold the
vocabulary; a block holds ``BLOCK`` ids (a multiple of eight) and starts at a
byte, so eight ids fill exactly ``bits`` bytes and numpy packs and unpacks
whole columns of such groups.  ``read_range`` touches only the blocks it needs.

Defined cases: null and empty texts are one end id; repeated ids are written
one after the other, ordered by a hash of their text; an empty table gives a
folder without rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import fresh_path
from .common import saved, whole_text
from .units import UnitEncoder

BLOCK = 4096
SEGMENT_TOKENS = 1 << 20
_HEAD = "<4sBBHIII"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as little-endian ``bits``-wide fields; the last group of eight is padded with zeros."""
    groups = np.zeros((-(-len(ids) // 8), 8), dtype=np.uint64)
    groups.reshape(-1)[:len(ids)] = ids
    out = np.zeros((len(groups), bits + 8), dtype=np.uint8)
    for j in range(8):
        at, shift = divmod(j * bits, 8)
        field = groups[:, j] << np.uint64(shift)
        for k in range((bits + shift + 7) // 8):
            out[:, at + k] |= (field >> np.uint64(8 * k)).astype(np.uint8)
    return out[:, :bits].tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    groups = np.frombuffer(data, dtype=np.uint8).reshape(-1, bits)
    out = np.zeros((len(groups), 8), dtype=np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(8):
        at, shift = divmod(j * bits, 8)
        field = np.zeros(len(groups), dtype=np.uint64)
        for k in range((bits + shift + 7) // 8):
            field |= groups[:, at + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, j] = (field >> np.uint64(shift)) & mask
    return out.reshape(-1)[:n]


def write_segment(ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    n_blocks = -(-len(ids) // block)
    body = pack(ids, bits)
    size = block // 8 * bits
    offsets = np.arange(n_blocks, dtype="<u4") * size
    return struct.pack(_HEAD, b"PKID", 1, bits, 0, len(ids), block, n_blocks) + offsets.tobytes() + body


def read_range(segment: bytes, start: int = 0, count: int | None = None) -> np.ndarray:
    """Ids ``start .. start + count`` of a segment, by the offsets of the blocks that hold them."""
    magic, version, bits, _, n, block, n_blocks = struct.unpack_from(_HEAD, segment)
    if magic != b"PKID" or version != 1:
        raise ValueError("not a packed id segment")
    stop = n if count is None else min(n, start + count)
    if start >= stop:
        return np.zeros(0, dtype=np.uint32)
    offsets = np.frombuffer(segment, dtype="<u4", count=n_blocks, offset=struct.calcsize(_HEAD))
    body = memoryview(segment)[struct.calcsize(_HEAD) + 4 * n_blocks:]
    first, last = start // block, (stop - 1) // block
    ids_end = min(n, (last + 1) * block)
    to = int(offsets[last]) + -(-(ids_end - last * block) // 8) * bits
    ids = unpack(body[int(offsets[first]):to], ids_end - first * block, bits)
    return ids[start - first * block:stop - first * block]


SEGMENT_SCHEMA = ("part int, segment int, part_start long, doc_ids array<long>, doc_lens array<int>, "
                  "continues boolean, payload binary")


def stretches(ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[bytes]:
    """The bytes of many stretches of ids."""
    raw = ids.astype("<u4").tobytes()
    return [raw[a:b] for a, b in zip((4 * first).tolist(), (4 * last).tolist())]


def write_packed(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Encode all documents (each ended by ``end_id``) in ascending id order and write the packed folder."""

    def run(batches):
        enc = UnitEncoder(tokenizer_path, "ids", lambda ids, starts: ids.astype("<u4").tobytes(),
                          lambda x, y, n: x + y, many=stretches)
        bits, end = bits_for(max(enc.tok.get_vocab_size(), end_id + 1)), np.array([end_id], "<u4").tobytes()
        part, number, written = TaskContext.get().partitionId(), 0, 0
        ids, lens, parts, held, continues = [], [], [], 0, False

        def segment():
            nonlocal number, written
            all_ids = np.frombuffer(b"".join(parts), "<u4")
            row = (part, number, written, list(ids), list(lens), continues, write_segment(all_ids, bits))
            number, written = number + 1, written + len(all_ids)
            return row

        names = [c.split()[0] for c in SEGMENT_SCHEMA.split(", ")]
        for b in batches:
            rows = []
            for doc, code in zip(b["doc_id"].tolist(), enc.encoded(b["text"].tolist())):
                code += end
                at = 0
                while at < len(code):       # a document longer than a segment goes on in the next one
                    take = code[at:at + 4 * (SEGMENT_TOKENS - held)]
                    ids.append(doc)
                    lens.append(len(take) // 4)
                    parts.append(take)
                    held, at = held + len(take) // 4, at + len(take)
                    if held >= SEGMENT_TOKENS:
                        rows.append(segment())
                        ids, lens, parts, held, continues = [], [], [], 0, at < len(code)
            if rows:
                yield pd.DataFrame(rows, columns=names)
        if parts:
            yield pd.DataFrame([segment()], columns=names)

    t = whole_text(text_col)
    ordered = (docs.select(F.col(id_col).cast("long").alias("doc_id"), t.alias("text"))
               .withColumn("tie", F.xxhash64("text"))
               .repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie"))
    (ordered.select("doc_id", "text").mapInPandas(run, SEGMENT_SCHEMA)
     .write.option("compression", "zstd").parquet(path))


def read_packed(spark, path: str) -> DataFrame:
    """From the files: one row a document's piece in a segment, with start (ids of all documents before)."""
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    # one number a part: at most as many rows as the write had tasks
    totals = segments.groupBy("part").agg(F.sum(F.aggregate(
        "doc_lens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def run(batches):
        for b in batches:
            out = []
            for start, docs, lens, continues, payload in zip(b["start"], b["doc_ids"], b["doc_lens"], b["continues"],
                                                             b["payload"]):
                raw = memoryview(read_range(payload).astype("<u4").tobytes())
                at = 0
                for i, (doc, n) in enumerate(zip(docs, lens)):
                    n = int(n)
                    # a document over several segments: its pieces keep their order, the crcs are joined below
                    out.append((doc, start + at, n, raw[4 * at:4 * (at + n)], i == 0 and bool(continues),
                                i == len(docs) - 1))
                    at += n
            yield pd.DataFrame([(d, s, n, zlib.crc32(r), bool(c), bool(e)) for d, s, n, r, c, e in out],
                               columns=["doc_id", "start", "n_tokens", "crc", "continued", "last"])

    pieces = (segments.join(F.broadcast(before), "part")
              .select((F.col("before") + F.col("part_start")).alias("start"), "doc_ids", "doc_lens", "continues",
                      "payload")
              .mapInPandas(run, "doc_id long, start long, n_tokens long, crc long, continued boolean, last boolean"))
    return pieces


def documents_of(pieces: DataFrame) -> DataFrame:
    """Pieces of ``read_packed`` -> documents (pieces of one document are joined; crc32 is combined)."""
    # only a segment's first and last piece can belong to a document cut by the segment bound
    whole = pieces.filter(~F.col("continued") & ~F.col("last")).select("doc_id", "start", "n_tokens",
                                                                       F.col("crc").alias("ids_crc32"))
    edge = pieces.filter(F.col("continued") | F.col("last"))
    by_id = Window.partitionBy("doc_id").orderBy("start")
    grouped = edge.withColumn("group", F.sum((~F.col("continued")).cast("int")).over(by_id))

    def join(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("start")
        crc = 0
        for n, c in zip(g["n_tokens"], g["crc"]):
            crc = crc32_joined(crc, int(c), 4 * int(n))
        return pd.DataFrame({"doc_id": [g["doc_id"].iat[0]], "start": [g["start"].iat[0]],
                             "n_tokens": [g["n_tokens"].sum()], "ids_crc32": [crc]})

    joined = grouped.groupBy("doc_id", "group").applyInPandas(join, whole.schema)
    return whole.unionByName(joined)


def _times(mat: list[int], vec: int) -> int:
    out, i = 0, 0
    while vec:
        if vec & 1:
            out ^= mat[i]
        vec, i = vec >> 1, i + 1
    return out


def crc32_joined(a: int, b: int, n: int) -> int:
    """crc32 of X + Y from crc32(X), crc32(Y) and the bytes of Y: X's crc is moved over n zero bytes."""
    if n == 0:
        return a
    step = [0xEDB88320] + [1 << i for i in range(31)]      # one zero bit
    for _ in range(3):
        step = [_times(step, v) for v in step]              # one zero byte
    while n:
        if n & 1:
            a = _times(step, a)
        n >>= 1
        if n:
            step = [_times(step, v) for v in step]
    return a ^ b


def packed_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """Write the packed folder under the shared folder and read its documents back."""
    path = fresh_path(docs.sparkSession, "packed-ids")
    write_packed(docs, tokenizer_path, path, end_id, id_col, text_col)
    return documents_of(saved(read_packed(docs.sparkSession, path), "packed-pieces"))
