"""Language identification with a blended-spectrum string kernel.

A text is the sets of its 1-, 2- and 3-grams of lower-case letters (every run
of other characters is one space).  The kernel of two texts is the mean over n
of the cosine of their presence vectors, so repeats do not count.  Landmarks
drawn from the learning rows give the Nyström map, kernel ridge regression in
it gives one weight vector a language (one against the rest), and because
every step is linear in the presence vectors the scores of a batch are one
matrix product of its presence rows with a small matrix.

Learning uses different texts only (copies count once), at most
``ROWS_PER_LANGUAGE`` a language and ``TRAIN_ROWS`` in all (documented bounds,
both hard; drawn by a hash of the text, so neither ids nor copies matter).  With
many languages each gets its share of ``TRAIN_ROWS``, one text at least; if there
are more languages than that, the most frequent are learned (ties: the name that
sorts first).  Scoring reads every whole text once, without a shuffle.

Defined cases: null text, and text without a letter, is ``und`` with score 0;
so is any text if there is nothing to learn from; ties go to the language that
sorts first; repeated rows get equal answers and are learned from once; an empty table gives an empty
result; only the named columns are read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

from .common import free_name, saved

ROWS_PER_LANGUAGE = 400
TRAIN_ROWS = 4096               # rows learned from in all, and so languages at most
SUBGROUPS = 1024
LANDMARKS = 256
RIDGE = 1e-2
BUCKET_BITS = (10, 12, 14)      # hash buckets for 1-, 2- and 3-grams
SHARPNESS = 6.0                 # of the softmax that turns regression values into a score
ROWS_AT_ONCE = 64
UNKNOWN = "und"
_EDGES = np.cumsum([0, *(1 << b for b in BUCKET_BITS)])


def letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(65536)])


class Grams:
    """Presence buckets of a text's n-grams."""

    def __init__(self):
        self.letter = letter_table()

    def codes(self, text: str) -> np.ndarray | None:
        """Letters with single spaces between and around; None if there is no letter."""
        c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        letter = self.letter[np.minimum(c, 65535)] | (c > 65535)
        if not letter.any():
            return None
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        c = np.where(letter, c, np.uint32(32))[keep]
        return np.concatenate([[np.uint32(32)], c, [np.uint32(32)]]).astype(np.uint64)

    def mark(self, text: str, row: np.ndarray) -> bool:
        """Set the text's buckets in a boolean row; whether it has a letter."""
        c = self.codes(text)
        if c is None:
            return False
        gram = np.zeros(len(c), dtype=np.uint64)
        for n, bits in enumerate(BUCKET_BITS):
            gram = gram[:len(c) - n] * np.uint64(0x100000001B3) + c[n:] + np.uint64(1)
            mixed = gram * np.uint64(0x9E3779B97F4A7C15)
            row[_EDGES[n] + (mixed >> np.uint64(64 - bits)).astype(np.int64)] = True
        return True


def kernel_rows(presence: np.ndarray) -> np.ndarray:
    """Presence rows scaled so that their dot product is the blended kernel."""
    out = presence.astype(np.float32)
    for a, b in zip(_EDGES[:-1], _EDGES[1:]):
        count = presence[:, a:b].sum(axis=1)
        out[:, a:b] /= np.sqrt(np.maximum(count, 1) * len(BUCKET_BITS))[:, None].astype(np.float32)
    return out


@dataclass
class Model:
    languages: list[str]
    matrix: np.ndarray | None      # buckets x languages

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if self.matrix is None:
            return names, scores
        grams, block = Grams(), np.zeros((ROWS_AT_ONCE, _EDGES[-1]), dtype=bool)
        for at in range(0, len(texts), ROWS_AT_ONCE):
            part = texts[at:at + ROWS_AT_ONCE]
            block[:] = False
            known = np.array([bool(t) and grams.mark(t, block[i]) for i, t in enumerate(part)])
            value = kernel_rows(block[:len(part)]) @ self.matrix
            value = np.exp(SHARPNESS * (value - value.max(axis=1, keepdims=True)))
            value /= value.sum(axis=1, keepdims=True)
            for i in np.flatnonzero(known):
                best = int(value[i].argmax())
                names[at + i], scores[at + i] = self.languages[best], float(value[i, best])
        return names, scores


def fit(presence: np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """One-against-rest kernel ridge regression in the Nyström map of evenly spread landmarks."""
    names = sorted(set(languages))
    if not names:
        return Model([], None)
    rows = kernel_rows(presence)
    by_name = [np.flatnonzero(np.array(languages) == n) for n in names]
    each = max(1, landmarks // len(names))
    marks = rows[np.concatenate([i[:each] for i in by_name])]
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    ok = value > 1e-8 * value.max()
    root = vector[:, ok] / np.sqrt(value[ok])              # K_mm^(-1/2)
    z = (rows @ marks.T).astype(np.float64) @ root
    y = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    size = np.array([len(i) for i in by_name])
    cost = (1.0 / size[np.searchsorted(names, languages)])[:, None] / len(names)
    w = np.linalg.solve(z.T @ (cost * z) + ridge / len(rows) * np.eye(z.shape[1]), z.T @ (cost * y))
    return Model(names, (marks.T.astype(np.float64) @ root @ w).astype(np.float32))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text, mod 4, is 2 (null id: not held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          rows_per_language: int = ROWS_PER_LANGUAGE, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from text and non-null language of rows outside the held-out part (see the module text for the bounds)."""
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.filter(~held_out("doc_id") & F.col("lang").isNotNull() & (F.length("text") > 0))
    known = known.select("lang", "text", F.xxhash64("text").alias("h"))
    # different texts by their hash, counted once: copies count as one row
    texts = saved(known.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("n")), "language-texts")
    sizes = texts.groupBy("lang").agg(F.sum("n").alias("n"))
    learned = sizes.orderBy(F.desc("n"), "lang").limit(train_rows).select("lang")
    n_languages = learned.count()
    if not n_languages:
        return Model([], None)
    each = max(1, min(rows_per_language, train_rows // n_languages))
    # the first rows of each language by a hash, in two rounds: no group grows beyond SUBGROUPS * each rows
    pick = texts.join(learned, "lang", "left_semi").select("lang", "h", F.xxhash64("h", F.lit("draw")).alias("u"))
    sub = Window.partitionBy("lang", F.pmod("u", F.lit(SUBGROUPS))).orderBy("u", "h")
    pick = pick.withColumn("r", F.row_number().over(sub)).filter(F.col("r") <= each)
    pick = pick.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("u", "h"))).filter(F.col("r") <= each)
    drawn = known.join(F.broadcast(pick.select("lang", "h")), ["lang", "h"])      # train_rows rows at most
    drawn = drawn.groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")

    def features(batches):
        grams = Grams()
        for b in batches:
            out = []
            for t in b["text"]:
                row = np.zeros(_EDGES[-1], dtype=bool)
                out.append(np.packbits(row).tobytes() if t and grams.mark(t, row) else None)
            yield pd.DataFrame({"lang": b["lang"], "bits": out})

    got = drawn.mapInPandas(features, "lang string, bits binary").filter("bits is not null").collect()
    got = sorted(((r["lang"], bytes(r["bits"])) for r in got), key=lambda r: (r[0], zlib.crc32(r[1]), r[1]))
    if not got:
        return Model([], None)
    bits = np.frombuffer(b"".join(r[1] for r in got), dtype=np.uint8).reshape(len(got), -1)
    return fit(np.unpackbits(bits, axis=1)[:, :_EDGES[-1]].astype(bool), [r[0] for r in got])


def predicted(docs: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct ``out`` of lang_pred and score."""
    out = free_name(docs, out)

    def run(batches):
        for text in batches:
            names, scores = model.predict(text.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    udf = F.pandas_udf(run, "lang_pred string, score double", PandasUDFType.SCALAR_ITER)
    return docs.withColumn(out, udf(F.col(f"`{text_col}`")))
