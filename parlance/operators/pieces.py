"""Word pieces (F27): a vocabulary table, and greedy longest-match encoding as joins with it.

The vocabulary is a table (token, id) of any size; it never passes through the
driver and is never broadcast by hand.  Only the distinct words of a table are
taken apart, and of these only the ones that are no token themselves: every
substring whose length occurs among the tokens is looked up by an equi-join,
and a fold over a word's hits, longest first at each start, walks from piece to
piece.  The pieces come back to the rows by a join on the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .ordering import global_rank

# Special tokens, in the order of their ids in a vocabulary built here.
PAD, UNK, CLS, SEP, MASK = "[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"
SPECIALS = (PAD, UNK, CLS, SEP, MASK)
CONT = "##"
MIN_COUNT = 2


def build_vocab(token_rows: DataFrame, tokens_col: str = "toks", min_count: int = MIN_COUNT) -> DataFrame:
    """(token, id): specials, every word with ``min_count`` occurrences (most frequent first), then every character
    and its ``##`` form; ids count from 0 in that order."""
    counts = token_rows.select(F.explode(tokens_col).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "word-counts")         # words and characters both come from the distinct words
    zero = F.lit(0).cast("bigint")
    words = counts.where(F.col("n") >= min_count).select(F.col("w").alias("token"), F.lit(1).alias("grp"),
                                                         (-F.col("n")).alias("k1"), F.col("w").alias("k2"))
    chars = counts.select(F.explode(F.split("w", "")).alias("ch")).where(F.col("ch") != "").distinct()
    forms = chars.select(F.explode(F.array(F.struct("ch", F.lit(2).alias("grp")), F.struct(
        F.concat(F.lit(CONT), "ch").alias("ch"), F.lit(3).alias("grp")))).alias("f"), F.col("ch").alias("k2"))
    special = token_rows.sparkSession.createDataFrame(
        [(t, 0, i, "") for i, t in enumerate(SPECIALS)], "token string, grp int, k1 bigint, k2 string")
    every = special.unionByName(words).unionByName(
        forms.select(F.col("f.ch").alias("token"), F.col("f.grp").alias("grp"), zero.alias("k1"), "k2"))
    # a token may be both a frequent word and a character: its first place counts
    first = every.groupBy("token").agg(F.min(F.struct("grp", "k1", "k2")).alias("o"))
    return global_rank(first.select("token", "o.*"), ["grp", "k1", "k2"], "id").select("token", "id")


def special_ids(vocab: DataFrame) -> dict[str, int]:
    """Ids of the five special tokens."""
    found = {r["token"]: int(r["id"]) for r in vocab.where(F.col("token").isin(*SPECIALS)).collect()}
    missing = [t for t in SPECIALS if t not in found]
    if missing:
        raise ValueError(f"vocabulary without {missing}")
    return found


def word_pieces(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """(w, pieces, ids) of the distinct words in column ``w``; a word with a part that no token covers is ``[UNK]``."""
    words = words.select("w").where(F.col("w").isNotNull()).distinct()
    whole = written(words.join(vocab.select(F.col("token").alias("w"), "id"), "w", "left"), "whole-words")
    unk = special_ids(vocab)[UNK]
    known = whole.where(F.col("id").isNotNull() | (F.col("w") == "")).select(
        "w", F.filter(F.array("w"), lambda x: x != "").alias("pieces"),
        F.filter(F.array("id"), lambda x: x.isNotNull()).alias("ids"))
    rest = whole.where(F.col("id").isNull() & (F.col("w") != "")).select("w")
    # the lengths that tokens have: as many numbers as there are different lengths
    n = F.length("token")
    lengths = vocab.select(n.alias("n"), F.when(F.col("token").startswith(CONT), n - len(CONT)).alias("c")).distinct().collect()
    lead, cont = sorted({r["n"] for r in lengths} - {0}), sorted({r["c"] for r in lengths} - {None, 0})

    def spans(start: Column, sizes: list[int]) -> Column:
        fits = F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda k: k <= F.length("w") - start)
        return F.transform(fits, lambda k: F.struct(start.alias("s"), k.alias("k")))

    later = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length("w"), F.lit(1))), lambda s: spans(s, cont)))
    part = F.substr(F.col("w"), F.col("at.s") + 1, F.col("at.k"))
    cand = rest.select("w", F.explode(F.concat(spans(F.lit(0), lead), later)).alias("at")).select(
        "w", "at", F.when(F.col("at.s") == 0, part).otherwise(F.concat(F.lit(CONT), part)).alias("token"))
    hits = cand.join(vocab, "token").groupBy("w").agg(F.sort_array(F.collect_list(F.struct(
        F.col("at.s").alias("s"), (-F.col("at.k")).alias("k"), F.col("id"), F.col("token")))).alias("hits"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("pieces"),
                     F.array().cast("array<bigint>").alias("ids"))
    walk = F.aggregate("hits", begin, lambda acc, h: F.when(h["s"] == acc["at"], F.struct(
        (h["s"] - h["k"]).alias("at"), F.concat(acc["pieces"], F.array(h["token"])).alias("pieces"),
        F.concat(acc["ids"], F.array(h["id"])).alias("ids"))).otherwise(acc))
    split = rest.join(hits.select("w", walk.alias("walk")), "w", "left")
    done = F.col("walk.at") == F.length("w")
    split = split.select("w", F.when(done, F.col("walk.pieces")).otherwise(F.array(F.lit(UNK))).alias("pieces"),
                         F.when(done, F.col("walk.ids")).otherwise(F.array(F.lit(unk).cast("bigint"))).alias("ids"))
    return known.select("w", "pieces", F.col("ids").cast("array<bigint>").alias("ids")).unionByName(split)


def subword_encode(df: DataFrame, words_col: str, vocab: DataFrame, keep: list[str]) -> DataFrame:
    """the columns ``keep`` (which tell the rows apart), pieces, ids and n_pieces (pieces of each word)."""
    rows = written(df.select(*keep, words_col), "rows-to-encode")
    each = rows.select(*keep, F.posexplode_outer(words_col).alias("pos", "w"))
    coded = each.join(word_pieces(each, vocab), "w", "left")
    one = F.struct("pos", F.coalesce("pieces", F.array().cast("array<string>")).alias("pieces"),
                   F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))
    whole = coded.groupBy(*keep).agg(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), one))).alias("words"))
    return whole.select(*keep, F.flatten(F.col("words.pieces")).alias("pieces"),
                        F.flatten(F.col("words.ids")).cast("array<int>").alias("ids"),
                        F.transform("words", lambda x: F.size(x["pieces"])).alias("n_pieces"))
