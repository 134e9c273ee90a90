"""Toxicity by a counterfactual-regularised classifier.

Features of a text are its distinct words and the first 4, 5 and 6 letters of
each (presence only, so length does not add up).  A logistic regression over
the features that tell the classes apart best is fitted in numpy on a bounded
sample of labelled rows (``TRAIN_ROWS``, a documented bound).  For every
sampled text with an identity term, a counterfactual copy has each identity
term swapped for another of its group; the loss penalises the squared change of
the score between the two, so a term's own weight cannot make a neutral mention
toxic.  Scoring is one pass over whole texts without a shuffle; what is shipped
to the tasks is the weight table, at most ``FEATURES`` entries.

Defined cases: null and empty texts have no feature and get the intercept's
score; without any labelled row to learn from every score is 0; documents are
scored row by row, so repeated rows and ties get equal scores; labels of unknown
documents and null labels are ignored; extra columns are kept by
``kept_documents``; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

from .common import free_name, whole_text, worker_store

TRAIN_ROWS = 4_500      # labelled rows that are learned from, at most
FEATURES = 1_024        # weights, or a third of the rows if that is less
PREFIXES = (4, 5, 6)
SWAP_WEIGHT = 5.0       # of the counterfactual penalty
TOXIC_WEIGHT = 2.5      # of a toxic row against another one
RIDGE = 5e-4
STEPS = 300
MEMO_WORDS = 400_000
_WORD = re.compile(r"[^\W\d_]+")

# Identity terms by group; a swap stays within the group.
IDENTITY_TERMS = {
    "gender": ("women", "men", "woman", "man", "girls", "boys", "females", "males", "transgender"),
    "religion": ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics",
                 "muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    "origin": ("immigrants", "refugees", "africans", "asians", "europeans", "americans", "arabs", "latinos",
               "african", "asian", "european", "american", "arab", "latino", "black", "white"),
    "orientation": ("gay", "lesbian", "bisexual", "straight", "queer", "homosexual", "heterosexual"),
    "age_ability": ("elderly", "old", "young", "disabled", "blind", "deaf", "autistic"),
}
_GROUP = {t: g for g in IDENTITY_TERMS.values() for t in g}


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def word_features(word: str) -> list[int]:
    h = xxhash.xxh64_intdigest
    return [h("w" + word) >> 1, *(h("p" + word[:k]) >> 1 for k in PREFIXES if len(word) >= k)]


def _packed(words: set[str]) -> bytes:
    return np.array(sorted({f for w in words for f in word_features(w)}), np.int64).tobytes()


def swapped(words: set[str]) -> set[str] | None:
    """The words with each identity term replaced by the next one of its group; None without such a term."""
    terms = words.intersection(_GROUP)
    if not terms:
        return None
    return (words - terms) | {_GROUP[t][(_GROUP[t].index(t) + 1) % len(_GROUP[t])] for t in terms}


@dataclass
class Model:
    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = float("-inf")

    def scorer(self):
        """A function of a list of texts; it remembers words for as long as it lives."""
        worker_store("toxicity")        # lets go of another operator's memos
        weight = dict(zip(self.features.tolist(), self.weights.tolist()))
        memo: dict[str, tuple] = {}

        def score(texts) -> np.ndarray:
            out = np.empty(len(texts))
            for n, t in enumerate(texts):
                seen: dict[int, float] = {}
                for w in words_of(t):
                    f = memo.get(w)
                    if f is None:
                        if len(memo) >= MEMO_WORDS:
                            memo.clear()
                        f = memo[w] = tuple((x, weight[x]) for x in word_features(w) if x in weight)
                    if f:
                        seen.update(f)
                out[n] = self.intercept + sum(seen.values())
            return 1.0 / (1.0 + np.exp(-np.clip(out, -700, 700))) if np.isfinite(self.intercept) else np.zeros(len(out))

        return score


def fit(rows: list[np.ndarray], labels: np.ndarray, swaps: list[np.ndarray | None], n_features: int = FEATURES,
        swap_weight: float = SWAP_WEIGHT, ridge: float = RIDGE, steps: int = STEPS) -> Model:
    """Weights from feature sets, 0/1 labels and the feature sets of the counterfactual copies (None: no copy)."""
    if not rows:
        return Model()
    y = labels.astype(float)
    if y.min() == y.max():
        return Model(intercept=float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    every, which = np.unique(np.concatenate(rows), return_inverse=True)
    toxic = np.bincount(which, weights=y[owner], minlength=len(every))
    seen = np.bincount(which, minlength=len(every))
    n1, n0 = y.sum(), len(y) - y.sum()
    gap = toxic / n1 - (seen - toxic) / n0
    p = seen / len(y)
    rank = gap ** 2 / np.maximum(p * (1 - p), 1e-9) * (seen >= 3)
    chosen = np.sort(np.argsort(-rank, kind="stable")[:min(n_features, max(64, len(rows) // 3))])
    chosen = chosen[rank[chosen] > 0]
    spot = np.full(len(every), -1)
    spot[chosen] = np.arange(len(chosen))

    x = np.zeros((len(rows), len(chosen)), dtype=np.float32)
    ok = spot[which] >= 0
    x[owner[ok], spot[which][ok]] = 1
    pairs = [i for i, s in enumerate(swaps) if s is not None]
    change = np.zeros((len(pairs), len(chosen)), dtype=np.float32)
    names = every[chosen]
    for n, i in enumerate(pairs):
        at = np.searchsorted(names, swaps[i])
        at = at[(at < len(names))]
        hit = at[np.isin(names[at], swaps[i])]
        change[n] = x[i]
        change[n, hit] -= 1

    cost = np.where(y > 0, TOXIC_WEIGHT, 1.0)
    cost /= cost.sum()
    w, b = np.zeros(len(chosen)), float(np.log(n1 / n0))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        q = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + b, -60, 60)))
        err = (q - y) * cost
        g = np.append(x.T @ err.astype(np.float32) + ridge * w, err.sum())
        if len(pairs):
            g[:-1] += swap_weight * 2 / len(pairs) * (change.T @ (change @ w.astype(np.float32)))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g ** 2
        move = 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    return Model(names, w, b)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text, mod 5, is 0 (null id: not held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents outside the held-out part, drawn by a hash of the id."""
    known = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
             .filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out("doc_id")))
    n = known.count()
    if n > rows:
        share = int(0.95 * rows / n * 1_000_000)
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1_000_000)) < share)
    drawn = F.broadcast(known.limit(rows))        # (id, label) rows, bounded by the parameter

    def features(batches):
        for b in batches:
            own, copies = [], []
            for t in b["text"]:
                words = words_of(t)
                other = swapped(words)
                own.append(_packed(words))
                copies.append(None if other is None else _packed(other))
            yield pd.DataFrame({"y": b["y"], "own": own, "copy": copies})

    got = (docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).join(drawn, "doc_id")
           .select("y", "text").mapInPandas(features, "y int, own binary, copy binary").limit(2 * rows).collect())
    got = sorted((bytes(r["own"]), r["y"], bytes(r["copy"] or b"")) for r in got)    # free of the rows' order
    return fit([np.frombuffer(o, np.int64) for o, _, _ in got], np.array([y for _, y, _ in got]),
               [np.frombuffer(c, np.int64) if c else None for _, _, c in got])


def scored(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score (0 to 1) of each whole text."""
    out = free_name(docs, out)

    def score(batches):
        run = model.scorer()
        for text in batches:
            yield pd.Series(run(text.tolist()))

    score = F.pandas_udf(score, "double", PandasUDFType.SCALAR_ITER)
    return docs.withColumn(out, score(whole_text(f"`{text_col}`")))


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with their own columns."""
    out = free_name(docs, "score")
    model = train(docs, labels, id_col, text_col)
    return scored(docs, model, text_col, out).filter(F.col(out) < threshold).drop(out)
