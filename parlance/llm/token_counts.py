"""Token counts by overlap resynchronisation.

A huge document is cut into overlapping chunks; each chunk is encoded with
offsets, and neighbouring chunks are spliced at a stable common boundary of
their overlap: a place where both encodings have a token boundary, where the
pre-tokeniser must start a new piece whatever stands around it (a space between
two non-space characters, outside any special token's string), and around which
the tokens of both encodings agree on ``AGREE`` tokens to either side.  What a
chunk adds is the tokens from its left splice to its right one.  Where the
overlap holds no such boundary, it is widened, up to the whole rest of the
document, so the counts are the library's for any text.  A document that fits
one chunk needs no splice.

Chunks of all documents are rows of one task's batch; a hot source or a long
text is worked through in pieces of bounded size.

Defined cases: null and empty texts have no tokens and no bytes; special
strings inside texts count as the library counts them; repeated rows are
counted one by one; only the id and text columns are read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .units import UnitEncoder

CHUNK = 32_768      # characters a chunk covers
OVERLAP = 1_024     # characters that neighbouring chunks share at first
AGREE = 4           # tokens that must agree on either side of a splice

_STABLE = re.compile(r"(?<=\S) (?=\S)")


class ChunkedCounter:
    """Counts, and ids with offsets, of texts of any length."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, agree: int = AGREE):
        self.short = UnitEncoder(path, "counts", lambda ids, starts: len(ids), lambda x, y, n: x + y,
                                 many=lambda ids, first, last: (last - first).tolist())
        self.enc = UnitEncoder(path, "offsets", _with_offsets, _join_offsets, offsets=True)
        self.chunk, self.overlap, self.agree = chunk, overlap, agree
        self.widened = 0

    def counts(self, texts: list[str]) -> list[int]:
        fits = [t for t in texts if len(t) <= self.chunk]
        split = [self.short.units(t) for t in fits]
        self.short.learn(split)
        spaced, bare = self.short.spaced.__getitem__, self.short.bare
        done = iter([self.short.whole(t) if s is None else bare[s[0]] + sum(map(spaced, s[1]))
                     for t, s in zip(fits, split)])
        return [next(done) if len(t) <= self.chunk else len(self.long(t)[0]) for t in texts]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and start offsets (characters) of a chunk."""
        split = self.enc.units(text)
        if split is None:
            got, at = [self.enc.whole(text)], [0]
        else:
            self.enc.learn([split])
            units = [split[0], *split[1]]
            got = [self.enc.bare[units[0]], *map(self.enc.spaced.__getitem__, units[1:])]
            lens = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
            at = np.concatenate([[0], lens[0] + np.cumsum(lens[1:] + 1) - (lens[1:] + 1)])
        n = np.fromiter((len(g[0]) >> 2 for g in got), dtype=np.int64, count=len(got))
        ids = np.frombuffer(b"".join([g[0] for g in got]), dtype=np.int32)
        starts = np.frombuffer(b"".join([g[1] for g in got]), dtype=np.int32)
        return ids, starts + np.repeat(at, n)

    def long(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and start offsets of a text of any length, spliced from its chunks."""
        ids, starts, begin = [], [], 0
        while True:
            end, overlap = min(len(text), begin + self.chunk), self.overlap
            a = self.encode(text[begin:end])
            while end < len(text):
                back = max(begin, end - overlap)
                ahead = min(len(text), end + overlap)
                cut = self.splice(text, begin, a, back, self.encode(text[back:ahead]), end)
                if cut is not None:
                    break
                # no proven boundary: widen the overlap, and the chunk with it, and try again
                overlap, self.widened = 2 * overlap, self.widened + 1
                end = min(len(text), end + overlap)
                a = self.encode(text[begin:end])
            else:
                ids.append(a[0])
                starts.append(a[1] + begin)
                return np.concatenate(ids), np.concatenate(starts)
            n = int(np.searchsorted(a[1], cut - begin))
            ids.append(a[0][:n])
            starts.append(a[1][:n] + begin)
            begin = cut

    def splice(self, text, begin, a, back, b, end) -> int | None:
        """The last proven common boundary of a (from ``begin``) and b (from ``back``) before ``end``; None if none."""
        (ia, sa), (ib, sb) = a, b
        for m in reversed(list(_STABLE.finditer(text, back + 1, max(back + 1, end - 1)))):
            p = m.start()
            if p <= begin or any(s in text[max(0, p - len(s)):p + len(s)] for s in self.enc.special):
                continue
            x, y, g = int(np.searchsorted(sa, p - begin)), int(np.searchsorted(sb, p - back)), self.agree
            if x >= len(sa) or y >= len(sb) or sa[x] != p - begin or sb[y] != p - back:
                continue
            if x < g or y < g or x + g > len(ia) or y + g > len(ib):
                continue
            if (ia[x - g:x + g] == ib[y - g:y + g]).all() and (
                    sa[x - g:x + g] + begin == sb[y - g:y + g] + back).all():
                return p
        return None


def _with_offsets(ids: np.ndarray, starts: np.ndarray) -> tuple[bytes, bytes]:
    return ids.tobytes(), starts.tobytes()


def _join_offsets(x: tuple, y: tuple, n: int) -> tuple[bytes, bytes]:
    """Values of " word" and a mark as the value of the unit of ``n`` characters (its space not counted)."""
    return x[0] + y[0], x[1] + (np.frombuffer(y[1], np.int32) + n).tobytes()


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK,
                 overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens: the library's counts, without begin, end or added special tokens."""

    def run(batches):
        counter = ChunkedCounter(path, chunk, overlap)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"],
                                "n_tokens": np.array(counter.counts(b["text"].tolist()), dtype=np.int64)})

    t = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(t).cast("long").alias("n_bytes"), t.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, n_bytes long, n_tokens long")
