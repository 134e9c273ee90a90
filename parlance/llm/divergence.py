"""Source divergence audit: how far the term use of each source is from the other sources of its language.

Every group (language, source) gives each kept term a smoothed integer
probability ``p = 1 + floor(SCALE * (count + 2) / (N + 2 V))``.  Two groups are
apart by the sum over all V kept terms of ``floor((p - q)^2 / (p + q))``, also
over the terms that neither uses.  Most terms occur in few sources, so the sum is

    V f(zero, zero)                                       all terms as if unused
  + sum of f(count, zero) - f(zero, zero)                 terms of the one group, then of the other
  + sum of the pair corrections
    f(a, b) - f(a, zero) - f(zero, b) + f(zero, zero)     terms used by both

in exact integers.  The pair corrections come from a frequent-pattern tree.  A
term row is its nonzero (source, count) list in source order; equal rows are one
row with a multiplicity; rows are inserted along the path of their entries, and
a node's multiplicity is that of all rows through it.  The correction between a
node and an ancestor is computed once, times the node's multiplicity, however
many terms share the path.

Spark range-partitions the distinct rows in path order, so that a branch lies in
one task; a task's tree is built from one Arrow batch of rows after the other
(a path over two batches is then two nodes, whose multiplicities add up).

What one task holds: term counts of the documents it reads (handed on every
``HELD_TERMS`` entries), a batch of rows with its tree, and a term's sources.
The result has a row for each pair of sources of a language; what is held of
sources is far below that.

Defined cases: null text, language or source are read as empty; groups without
terms and languages without kept terms take part (values 0); repeated rows count
as documents of their own; ties are ordered by the item's UTF-8 bytes; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, worker_store

SCALE = 1_000_000_000     # three times three digits, see probability()
MIN_DOCS = 10             # a term is kept if this many documents of its language hold it
HELD_TERMS = 400_000

# a term: letters A-Z and a-z (made small) and everything beyond ASCII; on UTF-8 bytes the same rule
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTS = "lang string, source string, term string, n long, n_docs long"


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TERM_BYTES).split()


def _count_terms(batches):
    """Occurrences and documents by (language, source, term), summed over what a task has read."""
    worker_store("divergence")      # lets go of another operator's memos
    used: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows():
        for (lang, source), (n, docs) in used.items():
            k = len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()),
                 pa.array([t.decode() for t in n], pa.string()), pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())],
                names=[c.split()[0] for c in _COUNTS.split(", ")])
        used.clear()

    for b in batches:
        for raw, lang, source in zip(*(b.column(i).to_pylist() for i in range(3))):
            terms = terms_of(raw)
            n, docs = used.setdefault((lang, source), (Counter(), Counter()))
            n.update(terms)
            docs.update(set(terms))
        if sum(len(n) for n, _ in used.values()) > HELD_TERMS:
            yield from rows()
    yield from rows()


def kept_terms(docs: DataFrame, text_col: str, lang_col: str, source_col: str, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, entries (source, n; in source order) of the terms that ``min_docs`` documents of the language hold.

    One shuffle, by (lang, term): what the tasks counted is summed by source and then by term in the same partitions.
    """
    counted = docs.select(_name(text_col).cast("binary"), _name(lang_col), _name(source_col)).mapInArrow(_count_terms, _COUNTS)
    by_source = (counted.repartition("lang", "term").groupBy("lang", "term", "source")
                 .agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs")))
    by_term = by_source.groupBy("lang", "term").agg(
        F.sum("n_docs").alias("n_docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("entries"))
    return by_term.filter(F.col("n_docs") >= min_docs).select("lang", "term", "entries")


def _name(col: str) -> Column:
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def probability(count: Column, total: Column, n_terms: Column) -> Column:
    """``1 + floor(SCALE * (count + 2) / (total + 2 * n_terms))``, three digits at a time: long numbers do not overflow."""
    whole, left, out = total + 2 * n_terms, count + 2, F.lit(1).cast("long")
    for unit in (1_000_000, 1_000, 1):
        out = out + F.call_function("div", left * 1000, whole) * unit
        left = left * 1000 % whole
    return out


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


class PatternTree:
    """A frequent-pattern tree over rows that come in path order, level by level in arrays.

    Row r is the entries ``starts[r] .. starts[r + 1]`` of the flat arrays.  ``shared[r]`` entries at its front are
    also those of row r - 1, so its other entries open nodes.  A node at depth d lives until the next row that shares d
    entries or fewer, and has the multiplicities of all rows until there; its ancestors are the entries before it in
    the row that opened it.
    """

    def __init__(self, starts: np.ndarray, first: np.ndarray, same: np.ndarray, times: np.ndarray):
        """``first``: the row's group (no paths are shared between groups); ``same``: an entry's code (source, count)."""
        self.starts, self.size, self.times = starts[:-1], np.diff(starts), times
        rows = len(self.size)
        self.shared = np.zeros(rows, np.int64)
        alike, depth = np.flatnonzero(first[1:] == first[:-1]) + 1, 0
        while len(alike):
            alike = alike[(self.size[alike] > depth) & (self.size[alike - 1] > depth)]
            alike = alike[same[self.starts[alike] + depth] == same[self.starts[alike - 1] + depth]]
            depth += 1
            self.shared[alike] = depth

    def levels(self):
        """By depth from 1: the rows that open a node there, and the nodes' multiplicities."""
        for depth in range(1, int(self.size.max(initial=0))):
            ends = np.flatnonzero(self.shared <= depth)
            times = np.add.reduceat(self.times, ends)
            opens = self.size[ends] > depth
            yield depth, ends[opens], times[opens]


def tree_sums(starts, first, same, times, source, p, none, cells: int = 1 << 20):
    """(group, ancestor's source, node's source, sum) of the pair corrections, a triple once a step.

    Each node meets its ancestors in one row of a matrix; a step has about ``cells`` combinations.
    """
    tree = PatternTree(starts, first, same, times)
    n_sources = int(source.max(initial=0)) + 1
    for depth, rows, many in tree.levels():
        step = max(1, cells // depth)
        for at in range(0, len(rows), step):
            part = rows[at:at + step]
            node = (tree.starts[part] + depth)[:, None]
            above = tree.starts[part][:, None] + np.arange(depth)
            f = lambda a, b: (a - b) ** 2 // (a + b)
            own, own_none, its, its_none = p[node], none[node], p[above], none[above]
            value = f(own, its) - f(own, its_none) - f(own_none, its) + f(own_none, its_none)
            value *= many[at:at + step][:, None]
            key = (first[part][:, None] * n_sources + source[above]) * n_sources + source[node]
            keys, which = np.unique(key, return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, which.reshape(-1), value.reshape(-1))
            yield keys // n_sources ** 2, keys // n_sources % n_sources, keys % n_sources, sums


def _corrections(batches):
    for b in batches:
        entries = b.column("entries")
        flat = entries.flatten()
        column = lambda name: flat.field(name).to_numpy(zero_copy_only=False)
        source, lang = flat.field("source").dictionary_encode(), b.column("lang").dictionary_encode()
        code = source.indices.to_numpy().astype(np.int64)
        _, same = np.unique(np.stack([code, column("n")]), axis=1, return_inverse=True)
        starts = np.cumsum(np.append(0, entries.value_lengths().to_numpy()))
        for group, a, c, sums in tree_sums(starts, lang.indices.to_numpy().astype(np.int64), same.reshape(-1),
                                           b.column("times").to_numpy(), code, column("p"), column("none")):
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(group)), source.dictionary.take(pa.array(a)),
                 source.dictionary.take(pa.array(c)), pa.array(sums)], names=["lang", "source", "item", "value"])


class Audit:
    """The counted tables of a corpus: ``groups`` (lang, source, total, V and the language's total), ``terms``."""

    def __init__(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                 min_docs: int = MIN_DOCS):
        terms = saved(kept_terms(docs, text_col, lang_col, source_col, min_docs), "divergence-terms")
        groups = docs.select(_name(lang_col).alias("lang"), _name(source_col).alias("source")).distinct()
        used = (terms.select("lang", F.explode("entries").alias("e")).groupBy("lang", F.col("e.source").alias("source"))
                .agg(F.sum("e.n").alias("total")))
        per_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.sum(F.aggregate(
            "entries", F.lit(0).cast("long"), lambda a, e: a + e["n"])).alias("lang_total"))
        zero = F.lit(0).cast("long")
        groups = groups.join(used, ["lang", "source"], "left").join(per_lang, "lang", "left").select(
            "lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "n_terms", "lang_total")])
        self.groups = saved(groups.withColumn("none", F.when(F.col("n_terms") > 0, probability(
            zero, F.col("total"), F.col("n_terms")))), "divergence-groups")
        # one row a language: its sources' totals ride along with the term rows
        totals = self.groups.groupBy("lang", "n_terms", "lang_total").agg(
            F.map_from_entries(F.collect_list(F.struct("source", F.struct("total", "none")))).alias("totals"))
        n = F.col("n_terms")
        looked_up = F.transform("entries", lambda e: F.struct(
            e["source"].alias("source"), e["n"].alias("n"), F.col("totals")[e["source"]].alias("t")))
        entries = F.transform(looked_up, lambda e: F.struct(
            e["source"].alias("source"), e["n"].alias("n"), probability(e["n"], e["t"]["total"], n).alias("p"),
            e["t"]["none"].alias("none")))
        count = F.aggregate("entries", zero, lambda a, e: a + e["n"])
        rows = terms.join(totals, "lang").withColumn("n", count)
        # three branches read this: the probabilities are worked out once
        self.terms = saved(rows.select("lang", "term", entries.alias("entries"), probability(
            F.col("n"), F.col("lang_total"), n).alias("lang_p")), "divergence-scored")

    def pair_corrections(self) -> DataFrame:
        """lang, source, item, value: the tree's sums, a pair once or more, source before item."""
        distinct_rows = self.terms.groupBy("lang", "entries").agg(F.count(F.lit(1)).alias("times"))
        return (distinct_rows.filter(F.size("entries") > 1).repartitionByRange("lang", "entries")
                .sortWithinPartitions("lang", "entries")
                .mapInArrow(_corrections, "lang string, source string, item string, value long"))

    def pairs(self) -> DataFrame:
        """lang, source, item (each other source of the language), value."""
        other = self.groups.select("lang", F.col("source").alias("item"), F.col("none").alias("other"))
        beside = self.groups.join(other, "lang").filter(F.col("source") != F.col("item"))
        unused = beside.select("lang", "source", "item", F.coalesce(
            F.col("n_terms") * apart(F.col("none"), F.col("other")), F.lit(0)).alias("value"))
        # by how often a count occurs: terms with the same count in a source have the same distance from "none"
        counts = self.terms.select("lang", F.explode("entries").alias("e")).groupBy(
            "lang", F.col("e.source").alias("source"), F.col("e.p").alias("p"), F.col("e.none").alias("none")).agg(
            F.count(F.lit(1)).alias("times"))
        one = (counts.join(other, "lang").filter(F.col("source") != F.col("item"))
               .groupBy("lang", "source", "item").agg(F.sum(F.col("times") * (
                   apart(F.col("p"), F.col("other")) - apart(F.col("none"), F.col("other")))).alias("value")))
        # the two sides of a pair share a sum
        half = one.unionByName(self.pair_corrections())
        both = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
        return (unused.unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))

    def typical_terms(self) -> DataFrame:
        """lang, source, item (a term the group uses more than its language), value."""
        e = self.terms.select("lang", "term", "lang_p", F.explode("entries").alias("e")).filter("e.p > lang_p")
        return e.select("lang", F.col("e.source").alias("source"), F.col("term").alias("item"),
                        apart(F.col("e.p"), F.col("lang_p")).alias("value"))


def ranked(rows: DataFrame, top: int | None = None) -> DataFrame:
    """``rank`` within (lang, source): by value downwards, then by item; the first ``top`` if given."""
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    out = rows.withColumn("rank", F.row_number().over(order))
    return out if top is None else out.filter(F.col("rank") <= top)
