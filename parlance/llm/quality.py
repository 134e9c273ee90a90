"""Quality rules: a threshold table compiled into one Spark projection.

``RULES`` is the table: a metric, the allowed range, one row a rule.
``quality_columns`` compiles it into Column expressions over per-document
metrics (length, symbols, stop words, line ratios); no user function runs and
nothing is shuffled, so a hot source or a long document costs only its bytes.

Defined cases: null or empty text has no words, fails the base rule and is not
kept; repeated rows are judged one by one; extra input columns are carried by
``apply_rules`` untouched (a column named like the result makes the result's
name end in underscores); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, free_name

# Frequent function words of the four languages the tables hold.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "is", "in", "for", "it",
    "der", "die", "das", "und", "ein", "eine", "ist", "nicht", "mit", "von", "zu", "sich",
    "le", "la", "les", "de", "des", "et", "un", "une", "du", "que", "en", "par",
    "el", "los", "las", "y", "del", "una", "por", "con", "para", "se", "lo", "al",
)


@dataclass(frozen=True)
class Rule:
    """Keep a document only if ``low <= metric <= high`` (None: no bound)."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("max_words", "n_words", high=1_000_000),
    Rule("mean_word_length", "mean_word_chars", low=2.0, high=14.0),
    Rule("symbol_ratio", "symbols_per_word", high=0.1),
    Rule("stop_words", "n_stop_words", low=2),
    Rule("duplicate_lines", "dup_line_ratio", high=0.6),
    Rule("bullet_lines", "bullet_line_ratio", high=0.9),
    Rule("ellipsis_lines", "ellipsis_line_ratio", high=0.3),
    Rule("alphabetic_words", "alpha_word_ratio", low=0.7),
)

_STOP_FORMS = STOP_WORDS + tuple(w.capitalize() for w in STOP_WORDS)
_NON_SPACE = f"[^{SPACES}]"


# Repeated three-word windows, in layers (each reads the arrays of the one before).  Windows are compared by a
# 64-bit hash.  The hashes are sorted; neighbours that are equal give a 64-bit mask of the repeated hashes, which
# leaves the few windows that can be repeated; these are sorted with their positions, the equal ones are marked,
# and the union of their three-word ranges is summed: O(n log n), never a comparison of all windows.

def _hashes(words: Column) -> Column:
    each = F.transform(words, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))
    return F.slice(each, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))


def _candidates(hashes: Column, ordered: Column) -> Column:
    twice = F.filter(ordered, lambda x, i: F.coalesce(F.get(ordered, i - 1) == x, F.lit(False)))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int"))
    mask = F.aggregate(twice, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(bit(x)))
    pairs = F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    # a one-element transform binds the mask once for the lambda inside
    return F.get(F.transform(F.array(mask), lambda m: F.when(m != 0, F.filter(
        pairs, lambda p: m.bitwiseAND(bit(p["h"])) != 0))), F.lit(0))


def _covered(s: Column) -> Column:
    marked = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                      | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
    at = F.sort_array(F.transform(marked, lambda x: x["i"]))
    n = F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
                    lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
                    lambda a: a["n"])
    return F.coalesce(n, F.lit(0))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def measures(text: Column) -> tuple[dict[str, Column], dict[str, callable]]:
    """The arrays cut from the text, and the numbers over them (as functions of the arrays)."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    arrays = {
        "words": F.array_remove(F.split(F.regexp_replace(t, r"[\x09-\x0D]", " "), " "), ""),
        "lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(_NON_SPACE)),
        "n_symbols": F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", "")),
    }
    numbers = {
        "n_words": lambda a: F.size(a["words"]),
        "word_chars": lambda a: F.length(F.array_join(a["words"], "")),
        "n_symbols": lambda a: a["n_symbols"],
        "n_dup_lines": lambda a: F.size(a["lines"]) - F.size(F.array_distinct(a["lines"])),
        "n_repeat_words": lambda a: _covered(a["sorted_windows"]),
        "n_lines": lambda a: F.size(a["lines"]),
        "n_stop_words": lambda a: F.size(F.array_intersect(a["words"], F.array(*map(F.lit, _STOP_FORMS)))),
        "n_bullet_lines": lambda a: F.size(F.filter(a["lines"], lambda x: x.rlike(f"^[{SPACES}]*[-*•]"))),
        "n_ellipsis_lines": lambda a: F.size(F.filter(a["lines"], lambda x: x.rlike(
            f"(\\.\\.\\.|…)[{SPACES}]*$"))),
        "n_alpha_words": lambda a: F.size(F.filter(a["words"], lambda x: x.rlike(r"\p{L}"))),
    }
    return arrays, numbers


def _metrics(c) -> dict[str, Column]:
    return {
        "n_words": c("n_words"),
        "mean_word_chars": _ratio(c("word_chars"), c("n_words")),
        "symbols_per_word": _ratio(c("n_symbols"), c("n_words")),
        "n_stop_words": c("n_stop_words"),
        "dup_line_ratio": _ratio(c("n_dup_lines"), c("n_lines")),
        "bullet_line_ratio": _ratio(c("n_bullet_lines"), c("n_lines")),
        "ellipsis_line_ratio": _ratio(c("n_ellipsis_lines"), c("n_lines")),
        "alpha_word_ratio": _ratio(c("n_alpha_words"), c("n_words")),
    }


def compiled(rules: tuple[Rule, ...], metric: dict[str, Column]) -> Column:
    """The table as one expression: the names of the rules a document breaks."""
    broken = []
    for r in rules:
        m, bad = metric[r.metric], F.lit(False)
        if r.low is not None:
            bad = bad | (m < F.lit(r.low))
        if r.high is not None:
            bad = bad | (m > F.lit(r.high))
        broken.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*broken))


def apply_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES,
                out: str = "quality") -> DataFrame:
    """``docs`` with one struct column ``out``: counts, ``broken`` (rule names), ``base_failed``, ``kept``.

    ``base_failed``: fewer than 50 words, or over half of the words in repeated three-word windows.
    """
    out = free_name(docs, out)
    arrays, numbers = measures(F.col(f"`{text_col}`"))
    a = docs.withColumn(out, F.struct(*[e.alias(k) for k, e in arrays.items()]))
    for name, make in (("hashes", lambda q: _hashes(q["words"])),
                       ("ordered", lambda q: F.sort_array(q["hashes"])),
                       ("sorted_windows", lambda q: F.sort_array(_candidates(q["hashes"], q["ordered"])))):
        a = a.withColumn(out, F.col(out).withField(name, make(F.col(out))))
    n = a.withColumn(out, F.struct(*[f(F.col(out)).cast("long").alias(k) for k, f in numbers.items()]))
    c = lambda k: F.col(out)[k]
    base = (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))
    broken = compiled(rules, _metrics(c))
    return n.withColumn(out, F.struct(*[c(k).alias(k) for k in numbers], broken.alias("broken"),
                                      base.alias("base_failed"), (~base & (F.size(broken) == 0)).alias("kept")))


def kept_documents(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with their own columns.

    The row number beside the verdict keeps the optimiser from copying the filter into every layer below, which
    would compute the metrics many times over.
    """
    out = free_name(docs, "quality")
    judged = apply_rules(docs, text_col, rules, out)
    nth = free_name(judged, "nth")
    return (judged.withColumn(nth, F.monotonically_increasing_id()).filter(F.col(out)["kept"] & (F.col(nth) >= 0))
            .drop(out, nth))
